"""Operators whose work follows the data: each against a plain reading of its rule, and on inputs that wind or are deep."""

import hashlib
import math
import pathlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import layers as Y
from tessera.operators import rigs as R
from tessera.operators import segment as S
from tessera.queries import queries
from tessera.sources import fixtures, io
from tessera.sources import shared
from tessera.streaming import streams as K

BONE = "rig_id int, bone_id string, ord int, parent_id string, hx double, hy double, tx double, ty double, radius double, falloff string"


def random_bones(n, seed=1, size=300):
    rng = np.random.RandomState(seed)
    out = []
    for k in range(n):
        hx, hy = rng.uniform(0, size, 2)
        tx, ty = (hx, hy) if k % 7 == 0 else (hx + rng.uniform(-40, 40), hy + rng.uniform(-40, 40))
        out.append((1, f"b{k}", k, None, float(hx), float(hy), float(tx), float(ty), float(rng.uniform(1, 25)), ("smooth", "linear", "hard")[k % 3]))
    return out


def distance(x, y, b):
    vx, vy, wx, wy = b[6] - b[4], b[7] - b[5], x - b[4], y - b[5]
    n = vx * vx + vy * vy
    t = 0.0 if n <= 1e-12 else min(1.0, max(0.0, (wx * vx + wy * vy) / n))
    return math.hypot(wx - t * vx, wy - t * vy)


def test_weights_and_nearest_bones_equal_all_pairs(spark):
    rows = random_bones(40)
    bones = spark.createDataFrame(rows, BONE)
    spots = [(1, y, x) for y in range(0, 400, 9) for x in range(0, 500, 9)]
    points = spark.createDataFrame(spots, "rig_id int, y int, x int")
    got = {}
    for r in R.bone_weights(points.union(points.limit(3)), bones).collect():
        assert r["bone_id"] not in got.setdefault((r["y"], r["x"]), {})
        got[r["y"], r["x"]][r["bone_id"]] = r["w"]
    near = {(r["y"], r["x"]): (r["bone_id"], r["part"], r["dist"]) for r in R.nearest_bone(points, bones, 30.0).collect()}
    orphans = 0
    for _, y, x in spots:
        w = {}
        for b in rows:
            v = min(1.0, max(0.0, 1 - distance(x, y, b) / max(b[8], 1e-6)))
            v = float(v > 0) if b[9] == "hard" else v if b[9] == "linear" else v * v
            if v > 0:
                w[b[1]] = v
        orphans += not w
        w = {k: v / sum(w.values()) for k, v in w.items()} or {min(rows, key=lambda b: (distance(x, y, b), b[2]))[1]: 1.0}  # noqa: B023
        assert got[y, x].keys() == w.keys() and all(abs(got[y, x][k] - v) < 1e-9 for k, v in w.items())
        best = min((d, b[2], k, part, b[1]) for b in rows for k, (part, d) in enumerate((("head", math.hypot(x - b[4], y - b[5])), ("tail", math.hypot(x - b[6], y - b[7])), ("body", distance(x, y, b)))))
        assert near.get((y, x)) == ((best[4], best[3], pytest.approx(best[0])) if best[0] <= 30 else None)
    assert orphans > 100 and len(got) == len(spots)
    pairs = R.near_bones(points, bones, F.col("radius")).count()
    assert pairs < len(spots) * len(rows) / 6


def test_points_are_dealt(spark):
    rigs = spark.createDataFrame([(1, 64, 64)], "rig_id int, width int, height int")
    assert R.grid_points(rigs).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_long_chain_and_a_cycle_of_bones(spark):
    n = 300
    rows = [(1, f"b{k}", k, f"b{k - 1}" if k else None, float(k), 0.0, k + 1.0, 0.0, 5.0, "smooth") for k in range(n)]
    rows += [(2, "a", 0, "b", *[0.0] * 4, 1.0, "hard"), (2, "b", 1, "a", *[0.0] * 4, 1.0, "hard"), (2, "c", 2, "b", *[0.0] * 4, 1.0, "hard"), (2, "d", 3, "gone", *[0.0] * 4, 1.0, "hard"), (2, "e", 4, "d", *[0.0] * 4, 1.0, "hard")]
    bones = spark.createDataFrame(rows, BONE)
    world = R.bone_world(bones, bones.selectExpr("rig_id", "0 frame", "bone_id", "0.0D rot", "1.0D tx", "2.0D ty"))
    got = {(r["rig_id"], r["bone_id"]): (r["c"], r["f"]) for r in world.collect()}
    assert got == {**{(1, f"b{k}"): (k + 1.0, 2 * k + 2.0) for k in range(n)}, (2, "d"): (1.0, 2.0), (2, "e"): (2.0, 4.0)}


def test_fields_in_a_task_and_by_joins_give_one_map(spark, monkeypatch):
    rng = np.random.RandomState(2)
    rows = [(1, f, y, x, *(float(v) for v in (1 + rng.normal() / 9, rng.normal() / 9, rng.normal() * 2, rng.normal() / 9, 1 + rng.normal() / 9, rng.normal() * 2))) for f in (0, 1) for y in range(9) for x in range(12) if (y, x) != (3, 4)]
    fields = spark.createDataFrame(rows, "rig_id int, frame int, y int, x int, a double, b double, c double, d double, e double, f double")
    of = lambda: {tuple(r)[:4]: (round(r["sy"], 9), round(r["sx"], 9)) for r in R.backward_map(fields, 4).collect()}
    want = of()
    monkeypatch.setattr(shared, "WHOLE", 20)
    assert of() == want and len(want) > 150


def regions(on):
    """The least (y, x) of each pixel's 8-connected region."""
    left, out = set(on), {}
    for start in sorted(on):
        if start in left:
            left.discard(start)
            queue = deque([start])
            while queue:
                y, x = queue.popleft()
                out[y, x] = start
                for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if p in left:
                        left.discard(p)
                        queue.append(p)
    return out


def spiral(n):
    on, y, x, dy, dx = set(), 0, 0, 0, 1
    grid = np.zeros((n, n), bool)
    while True:
        grid[y, x] = True
        on.add((y, x))
        ahead = lambda k: 0 <= y + k * dy < n and 0 <= x + k * dx < n  # noqa: B023, E731
        if not ahead(1) or ahead(2) and grid[y + 2 * dy, x + 2 * dx] or grid[y + dy, x + dx]:
            dy, dx = dx, -dy
            if not ahead(1) or grid[y + dy, x + dx] or ahead(2) and grid[y + 2 * dy, x + 2 * dx]:
                return on
        y, x = y + dy, x + dx


def test_regions_over_strips_equal_a_search(spark):
    rng = np.random.RandomState(5)
    frames = {0: {(y, x) for y in range(40) for x in range(30) if rng.rand() < 0.4}, 1: spiral(41), 2: {(y, x) for y in range(50) for x in range(21) if x % 2 == 0 or y == 49}, 3: {(7, 3)}}
    on = spark.createDataFrame([(1, f, y, x, 255) for f, s in frames.items() for y, x in s] + [(2, 0, 1, 1, 0)], "clip_id int, frame int, y int, x int, m int")
    want = {(f, y, x): a * (1 << 31) + b for f, s in frames.items() for (y, x), (a, b) in regions(s).items()}
    for strip, group in ((64, 64), (2, 2), (3, 5), (8, 3)):
        got = {(r["frame"], r["y"], r["x"]): r["label"] for r in S.connected_regions(on, strip, group).collect()}
        assert got == want, (strip, group)
    assert S.connected_regions(on.where("m > 300")).collect() == []


def test_a_comb_of_a_whole_frame_is_one_region(spark):
    comb = spark.range(1080 * 1920).selectExpr("1 clip_id", "0 frame", "cast(id div 1920 as int) y", "cast(id % 1920 as int) x").where("x % 2 = 0 or y = 1079").withColumn("m", F.lit(255))
    assert [tuple(r) for r in S.connected_regions(comb).groupBy("label").count().collect()] == [(0, 1080 * 960 + 960)]


def grid(spark, h, w, seed=0):
    rng = np.random.RandomState(seed)
    return spark.createDataFrame([(c, 0, y, x, *(int(v) for v in rng.randint(0, 256, 3)), 255 if rng.rand() < 0.5 else 0) for c in (1, 2) for y in range(h) for x in range(w)], "clip_id int, frame int, y int, x int, b int, g int, r int, a int")


def test_fills_in_a_task_and_by_joins_are_one(spark, monkeypatch):
    plate = grid(spark, 24, 20)
    region = plate.where("(y between 3 and 20 and x between 2 and 16 and clip_id = 1) or (y < 2 and x < 2)").select("clip_id", "frame", "y", "x").union(spark.createDataFrame([(3, 0, 1, 1), (1, 0, 99, 99)], "clip_id int, frame int, y int, x int"))
    of = lambda: sorted(map(tuple, Y.fill_region(plate, region, 3).collect()))
    want = of()
    monkeypatch.setattr(shared, "WHOLE", 100)
    assert of() == want
    old = {tuple(r)[:4]: tuple(r)[4:] for r in plate.collect()}
    changed = {r[:4] for r in want if r[4:] != old[r[:4]]}
    assert changed <= {tuple(r) for r in region.collect()} and len(changed) > 250
    assert sorted(map(tuple, Y.fill_region(plate, plate.select("clip_id", "frame", "y", "x"), 3).collect())) == sorted((*k, *v) for k, v in old.items())


def test_plates_healed_in_a_task_and_by_joins_are_one(spark, monkeypatch):
    plate = grid(spark, 14, 12).union(grid(spark, 14, 12, 4).withColumn("frame", F.lit(3)))
    rng = np.random.RandomState(8)
    strokes = spark.createDataFrame([(c, k // 3, int(rng.randint(-1, 13)), int(rng.randint(-1, 15)), int(rng.randint(1, 4))) for c in (1, 2) for k in range(9)], "plate_id int, stroke int, x int, y int, radius int")

    def of():
        parts = Y.heal_parts(plate, strokes, 2, 11, 13, 3)
        return {k: sorted(map(tuple, parts[k].select(sorted(parts[k].columns)).collect())) for k in ("plate", "content", "mask", "bbox", "replaced")}

    want = of()
    assert len(want["plate"]) == 4 * 13 * 11
    monkeypatch.setattr(shared, "AT_ONCE", 200)  # a frame or two a call
    assert of() == want
    plan = Y.heal(plate, strokes, 2, 11, 13, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Join" in line and "y#" in line]  # pixels join nothing
    monkeypatch.setattr(shared, "WHOLE", 100)
    assert of() == want


def test_plates_of_another_size_are_healed_in_a_task_and_by_joins_alike(spark, monkeypatch):
    # A frame without rows, places that a plate lacks, clips that are larger and smaller than the plates' size, and a pixel outside.
    plate = grid(spark, 20, 17).union(grid(spark, 20, 17, 4).withColumn("frame", F.lit(3))).where("(y * 7 + x) % 11 > 0 and (clip_id = 1 or y < 15)")
    plate = plate.union(spark.createDataFrame([(1, 0, 21, 18, 9, 8, 7, 255)], plate.schema))
    rng = np.random.RandomState(8)
    strokes = spark.createDataFrame([(c, k // 3, int(rng.randint(-1, 13)), int(rng.randint(-1, 15)), int(rng.randint(1, 4))) for c in (1, 2) for k in range(9)], "plate_id int, stroke int, x int, y int, radius int")

    def of():
        parts = Y.heal_parts(plate, strokes, 2, 11, 13, 3, (17, 20))
        return {k: sorted(map(tuple, parts[k].select(*Y.KEY, *"bgra").collect())) for k in ("plate", "content")}

    want = of()
    assert len(want["content"]) == 2 * 4 * 13 * 11 and len(want["plate"]) == plate.count() - 1
    monkeypatch.setattr(shared, "AT_ONCE", 200)
    assert of() == want
    for part in ("plate", "content"):
        plan = Y.heal_parts(plate, strokes, 2, 11, 13, 3, (17, 20))[part]._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Join" in line and "y#" in line]  # pixels join nothing
    monkeypatch.setattr(shared, "WHOLE", 100)
    assert of() == want


def test_pixels_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(shared, "AT_ONCE", 3000)
    plates = spark.range(40, numPartitions=2).selectExpr("nullif(id, 3) clip_id", "explode(sequence(0, 1)) frame", "id").selectExpr("clip_id", "frame", "explode(sequence(0, 15)) y", "id").selectExpr("clip_id", "frame", "y", "explode(sequence(0, 19)) x", "nullif(y * 9, 18) b", "cast(id as string) name")
    for df in (plates, plates.orderBy("x", "y"), plates.limit(0)):
        rows = shared.packed(df).transform(shared.cut)
        assert sorted(map(repr, shared.unpacked(rows, df.schema).collect())) == sorted(map(repr, df.collect()))
    rows = shared.packed(plates)
    n, pixels, tall, wide, size = rows.selectExpr("count(*)", "sum(n)", "max(height)", "max(width)", "sum(length(data))").first()
    assert (pixels, tall, wide) == (plates.count(), 16, 20) and n < 120 and size < 4 * pixels


def test_frames_come_whole_and_many_at_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "AT_ONCE", 50)
    sizes = {(c, f): 1 + (7 * f + len(c or "")) % 40 for c in ("a", "bb", None) for f in range(30)}
    df = spark.createDataFrame([(c, f, k) for (c, f), n in sizes.items() for k in range(n)], "clip_id string, frame int, k int")

    def run(table):
        number = shared.frame_numbers(table)
        first = np.unique(number, return_index=True)[1]
        count = np.bincount(number)
        return table.select(["clip_id", "frame"]).take(first).append_column("n", pa.array(count)).append_column("calls", pa.array(np.full(len(count), len(count))))

    got = shared.frames_at_once(df, run, "clip_id string, frame int, n bigint, calls bigint").collect()
    assert {(r["clip_id"], r["frame"]): r["n"] for r in got} == sizes and len(got) == len(sizes)
    assert max(r["calls"] for r in got) > 1
    assert shared.frames_at_once(df.limit(0), run, "clip_id string, frame int, n bigint, calls bigint").collect() == []


def test_a_deep_fill_takes_no_round_a_ring(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plate = spark.range(200 * 200).selectExpr("1 clip_id", "0 frame", "cast(id div 200 as int) y", "cast(id % 200 as int) x", "50 b", "60 g", "70 r", "255 a")
    out = Y.fill_region(plate, plate.where("y between 1 and 198 and x between 1 and 198").select("clip_id", "frame", "y", "x"), 2)
    assert out.where("b <> 50 or g <> 60 or r <> 70").count() == 0 and out.count() == 40_000
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)) < 30


def test_outlines_equal_the_ellipse(spark):
    rows = {tuple(r)[:4]: tuple(r)[4:] for r in grid(spark, 11, 9, 3).collect()}
    for t in (0, 1, 3, 4):
        out = {tuple(r)[:4]: tuple(r)[4:] for r in S.outline(grid(spark, 11, 9, 3), (10, 200, 250), t).collect()}
        for (c, f, y, x), (b, _, _, a) in rows.items():
            d = max((rows[c, f, y + dy, x + dx][3] for dy, dx in S.ellipse(t) if (c, f, y + dy, x + dx) in rows), default=0)
            fa, ba = a / 255, d / 255
            oa = fa + ba * (1 - fa)
            assert out[c, f, y, x][0] == math.floor(min(255.0, (b * fa + 10 * ba * (1 - fa)) / (oa + 1e-6))) and out[c, f, y, x][3] == math.floor(min(255.0, oa * 255))


def test_fingerprints_are_trees_of_leaves(spark):
    rows = [("x", k, f"v{k}") for k in range(100)] + [("y", 1, None)]
    df = spark.createDataFrame(rows, "layer string, k int, v string")

    def tree(lines):
        while True:
            lines = [hashlib.sha1(";".join(lines[i : i + 4]).encode()).hexdigest() for i in range(0, len(lines), 4)]
            if len(lines) == 1:
                return lines[0]

    want = {"x": tree([f"v{k}" for k in range(100)]), "y": tree(["~"])}
    for d in (df, df.repartition(7), df.orderBy(F.desc("k"))):
        assert {r["layer"]: r["fingerprint"] for r in Y.content_fingerprint(d, ["layer"], ["k"], ["v"], 4).collect()} == want
    assert Y.content_fingerprint(df.limit(0), ["layer"], ["k"], ["v"]).collect() == []


def test_damaged_corrections_are_errors(spark):
    schema = "id int, rig_id string, bbox_x int, bbox_y int, bbox_width int, bbox_height int, fade int, canvas_width int, canvas_height int"
    good, bad = (1, "r", -2, 3, 5, 5, None, 64, 64), [(2, "r", None, 3, 5, 5, 1, 64, 64), (3, "r", 1, 3, 5, 5, 1, None, None), (4, None, 1, 3, 5, -5, 1, 64, 64), (5, "r", 1, 1, 5, 5, 1, 64, 0), (6, "r", 1, 1, 5, -1, 1, 64, 64)]
    df = spark.createDataFrame([good, *bad], schema)
    assert {r["id"]: r["reason"] for r in Y.correction_errors(df).collect()} == {2: "missing: bbox_x", 3: "missing: canvas_width, canvas_height", 4: "missing: rig_id", 5: "the canvas has no size", 6: "the box has a negative size"}
    assert [tuple(r) for r in Y.load_corrections(df, 64, 64, strict=False).collect()] == [(1, "r", 0, 3, 3, 8, 1)]
    for k in range(5):
        with pytest.raises(Exception, match=f"correction {bad[k][0]}: "):
            Y.load_corrections(spark.createDataFrame([good, bad[k]], schema), 64, 64).collect()


def stream(spark, tmp_path, batches, schema):
    """A stream of one file a batch, in that order."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in os.listdir(tmp_path / "in"):
            path = str(tmp_path / "in" / f)
            if f.startswith("part") and os.stat(path).st_mtime > 2_000_000:
                os.utime(path, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(spark.createDataFrame([], schema).selectExpr("*", "cast(t as timestamp) ts").drop("ts").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).selectExpr("*", "cast(t as timestamp) ts").drop("t")


def event(k, t, chunk, result, job=1):
    return (job, chunk, k, f"2024-01-01 {t}", result)


EVENT = "job_id bigint, chunk_id int, event_id bigint, t string, result string"


def test_late_attempts_are_taken_in_order_of_time(spark, tmp_path):
    # Three failures before a success, whose rows arrive last; and time that moves on.
    batches = [[event(4, "00:04:00", 7, "ok")], [event(3, "00:03:00", 7, "failed"), event(1, "00:01:00", 7, "failed")], [event(2, "00:02:00", 7, "failed"), event(9, "00:05:00", 8, "ok")], [event(-1, "05:00:00", -1, "tick", -1)]]
    out = K.run_available(K.stream_attempts(stream(spark, tmp_path, batches, EVENT), "1 hour"))
    assert sorted((r["chunk_id"], r["event_id"], r["outcome"]) for r in out.collect()) == [(7, 3, "failed"), (8, 9, "completed")]


def test_a_job_is_forgotten_after_a_while(spark, tmp_path):
    days = [[(1, 1, 1, "2024-01-01 00:00:00", "failed"), (1, 1, 2, "2024-01-01 00:01:00", "failed")], [(-1, -1, -1, "2024-01-09 00:00:00", "tick")], [(-1, -1, -2, "2024-01-20 00:00:00", "tick")], [(1, 1, 3, "2024-02-01 00:00:00", "failed")], [(-1, -1, -3, "2024-03-01 00:00:00", "tick")]]
    assert K.run_available(K.stream_attempts(stream(spark, tmp_path, days, EVENT), "1 hour", "3 days")).collect() == []
    (tmp_path / "kept").mkdir()
    out = K.run_available(K.stream_attempts(stream(spark, tmp_path / "kept", days, EVENT), "1 hour", "90 days"))
    assert [(r["event_id"], r["outcome"]) for r in out.collect()] == [(3, "failed")]


class Calls:
    """A processor's states and timers in memory, and the number of calls to them, each a round trip to the state store."""

    def __init__(self):
        self.n, self.timers = 0, set()

    def getValueState(self, *_):  # noqa: N802
        return Kept(self)

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.add(at)


class Kept:
    def __init__(self, calls):
        self.calls, self.v, self.map, self.list = calls, None, {}, []

    def __getattribute__(self, name):
        if name[0] != "_" and name not in ("calls", "v", "map", "list"):
            self.calls.n += 1
        return object.__getattribute__(self, name)

    def get(self):
        return iter(self.list) if self.list else self.v

    def exists(self):
        return bool(self.v or self.list)

    def update(self, v):
        self.v = v

    def put(self, v):
        self.list = list(v)

    def appendList(self, v):  # noqa: N802
        self.list = self.list + list(v)

    def containsKey(self, k):  # noqa: N802
        return k in self.map

    def getValue(self, k):  # noqa: N802
        return self.map.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.map[k] = v

    def clear(self):
        self.v, self.map, self.list = None, {}, []


@pytest.mark.parametrize("processor, told", [(K._Attempts(1000), 50), (K._Silence(1000), 1)])
def test_calls_to_the_state_do_not_follow_the_rows(processor, told):
    class Time:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    calls, out = Calls(), []
    processor.init(calls)
    for k in range(4):  # in no order of time, and none due
        batch = pd.DataFrame({"us": [1000 * (9 - k) + i for i in range(100)], "event_id": range(100 * k, 100 * k + 100), "chunk_id": [i % 50 for i in range(100)], "result": ["tick" if i == 7 else "ok" for i in range(100)]})
        out += list(processor.handleInputRows((1,), iter([batch]), Time(0)))
    assert out == [] and calls.n <= 16
    while calls.timers:
        out += list(processor.handleExpiredTimer((1,), Time(100_000), None))
        calls.timers.remove(min(calls.timers))
    assert sum(map(len, out)) == told and calls.n < 50
    assert not [s for s in vars(processor).values() if isinstance(s, Kept) and (s.v or s.map or s.list)]


def test_calls_to_the_state_do_not_follow_the_jobs_of_a_run(spark, tmp_path):
    class Time:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    calls, out, processor = Calls(), [], K._Silence(1000)
    processor.init(calls)
    ids = [(job, k) for k in range(6) for job in range(64, 128)]
    batch = pd.DataFrame({"us": [1000 * (job + 300 * k + (k > 3) * 2000) for job, k in ids], "event_id": range(len(ids)), "job_id": [job for job, _ in ids], "result": "ok"})
    for part in (batch[::2], batch[1::2]):
        out += list(processor.handleInputRows((1,), iter([part]), Time(0)))
    for mark in range(500, 8000, 500):
        for at in sorted(t for t in calls.timers if t <= mark):
            out += list(processor.handleExpiredTimer((1,), Time(mark), None))
            calls.timers.remove(at)
    got = sorted(map(tuple, pd.concat(out).itertuples(index=False)))
    assert got == sorted((job, 1000 * (job + last), n) for job in range(64, 128) for last, n in ((900, 4), (3500, 2)))
    assert calls.n < 400 and not calls.timers
    assert not [s for s in vars(processor).values() if isinstance(s, Kept) and (s.v or s.map or s.list)]

    # Jobs of several runs, below 0, and none at all.
    jobs = [-65, -1, 0, 63, 64, None, 1 << 40]
    first = [(job, f"00:0{k % 6}:00", k, "ok") for k, job in enumerate(jobs)]
    rows = [(j, f"2024-01-01 {t}", k, r) for j, t, k, r in first] + [(5, "2024-01-03 00:00:00", 99, "tick")]
    df = spark.createDataFrame(rows, "job_id long, t string, event_id long, result string").selectExpr("job_id", "cast(t as timestamp) ts", "event_id", "result")
    df.write.parquet(str(tmp_path / "in"))
    out = K.run_available(K.stream_stall(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    assert {(r["job_id"], str(r["silent_from"])[11:], r["n"]) for r in out.collect()} == {(job, t, 1) for job, t, _, _ in first}


def test_a_silence_is_told_while_it_lasts(spark, tmp_path):
    # Job 1 never comes back; job 2's events tell that time passes. Job 3's gap is filled by a late row.
    batches = [[event(1, "00:00:00", 0, "ok"), event(2, "00:05:00", 0, "ok"), event(3, "00:00:00", 0, "ok", 3), event(4, "00:18:00", 0, "ok", 3)], [event(5, "00:09:00", 0, "ok", 3), event(6, "00:30:00", 0, "ok", 2)], [event(7, "02:00:00", 0, "ok", 2)]]
    out = K.run_available(K.stream_stall(stream(spark, tmp_path, batches, EVENT), "10 minutes", "20 minutes"))
    assert sorted((r["job_id"], str(r["silent_from"])[11:], r["n"]) for r in out.collect()) == [(1, "00:05:00", 2), (2, "00:30:00", 1), (3, "00:18:00", 3)]


def test_motion_of_sparse_tiles(spark, tmp_path):
    rng = np.random.RandomState(6)
    rows = [(1, f, int(y), int(x), int(rng.randint(0, 60))) for f in range(12) for y, x in {(rng.randint(0, 130), rng.randint(0, 70)) for _ in range(60)} | {(5, 5), (63, 64)}]
    last, want = {}, {}
    for c, f, y, x, v in rows:
        if (y, x) in last and abs(last[y, x] - v) > 15:
            want.setdefault((y, x), f)
        last[y, x] = v
    schema = "clip_id int, frame int, y int, x int, v int"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k][::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = K.run_available(K.stream_motion(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))))
    assert {(r["y"], r["x"]): r["frame"] for r in got.collect()} == want


def test_ranges_of_frames_prune_folders_and_columns(spark, tmp_path):
    frames = spark.range(3).selectExpr("id clip_id").selectExpr("clip_id", "explode(sequence(0, 49)) frame").selectExpr("clip_id", "frame", "explode(sequence(0, 1)) y").selectExpr("clip_id", "frame", "y", "0 x", "int(frame) b", "1 g", "2 r", "255 a")
    path = f"{tmp_path}/frames"
    io.write_pixels(frames, path, 10)
    got = io.read_pixels(spark, path, [2], (12, 17), 10).select("clip_id", "frame", "y", "b")
    assert {tuple(r) for r in got.collect()} == {(2, f, y, f) for f in range(12, 18) for y in (0, 1)}
    assert all("/clip_id=2/chunk=1/" in r[0] for r in got.select(F.input_file_name()).distinct().collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "clip_id" in filters and "chunk" in filters and "GreaterThanOrEqual(frame,12)" in plan
    assert plan[plan.index("ReadSchema") :].split("struct<")[1].split(">")[0] == "frame:int,y:int,b:int"


def test_places_in_a_group_that_holds_most_rows(spark):
    rows = [(0 if k % 3 else k % 5, (k * 37) % 600) for k in range(600)] + [(None, 3), (7, -4)]
    df = spark.createDataFrame(rows, "label int, id int")
    got = fixtures.placed(df, "label", F.floor(F.col("id") / 16), "id")
    want = sorted((g, i, n) for g in {r[0] for r in rows} - {None} for n, i in enumerate(sorted(i for h, i in rows if h == g)))
    assert sorted(tuple(r) for r in got.select("label", "id", "place").collect()) == want
    assert fixtures.placed(df.limit(0), "label", F.floor(F.col("id") / 16), "id").count() == 0


def test_files_of_strokes_are_written_by_many_tasks(spark, sf_dir):
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("strokes-*"))
    assert queries()["a6_read_strokes"](spark, sf_dir).count() > 0
    (made,) = set(root.glob("strokes-*")) - before
    files = [f.name for f in made.glob("plate_id=*/part-*")]
    assert len(files) > 8 and len({f.split("-")[1] for f in files}) > 1
