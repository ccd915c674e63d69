"""Small hand-made cases of the operators without SQL, and invariants."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import registry
from tessera.operators import color as C
from tessera.operators import layers as Y
from tessera.operators import loops as L
from tessera.operators import pixels as P
from tessera.operators import rigs as R
from tessera.operators import segment as S
from tessera.sources import io as O
from tessera.streaming import streams as K

PX = "clip_id int, frame int, y int, x int, b int, g int, r int, a int"


def frames(spark, n, size=2):
    return spark.range(n * size * size).selectExpr("1 clip_id", f"cast(id div {size * size} as int) frame", f"cast(id div {size} % {size} as int) y", f"cast(id % {size} as int) x").selectExpr("*", "frame b", "frame g", "frame r", "255 a")


def grid(spark, h, w, inside, on, off):
    d = spark.range(h * w).selectExpr("1 clip_id", "0 frame", f"cast(id div {w} as int) y", f"cast(id % {w} as int) x")
    pick = lambda k: F.when(F.expr(inside), on[k]).otherwise(off[k])
    return d.select("*", *(pick(k).alias(c) for k, c in enumerate(["b", "g", "r", "a"])))


def lengths(df):
    return df.agg(F.max("frame") + 1).first()[0]


def test_loop_lengths(spark):
    ten, twenty = frames(spark, 10), frames(spark, 20)
    ping = L.pingpong(ten)
    assert lengths(ping) == 19
    assert {r["b"] for r in ping.where("frame in (0, 18)").collect()} == {0}
    assert [lengths(x) for x in (L.reverse_loop(ten), L.hold_loop(ten, 2), L.fade_loop(twenty, (0, 0, 0, 0), 5), L.blend_loop(ten, "add"))] == [20, 12, 20, 15]
    assert lengths(L.morph_loop(ten, 3)) == 13 and lengths(L.morph_loop(frames(spark, 5), 3)) == 5


def test_clusters_are_greedy_and_ordered(spark):
    samples = spark.createDataFrame([(1, 0, 10, 10, 10), (1, 1, 12, 10, 10), (1, 2, 100, 0, 0), (1, 3, 103, 0, 0)], "clip_id int, ord int, b int, g int, r int")
    out = sorted(map(tuple, C.cluster_colors(samples, 5).collect()))
    assert out == [(1, 0, 11, 10, 10), (1, 1, 101, 0, 0)]


def test_key_frame_and_hsv(spark):
    f = grid(spark, 100, 100, "y between 40 and 59 and x between 40 and 59", (0, 0, 255, 255), (0, 255, 0, 255))
    m = S.key_mask(f, C.color_ranges(C.background_color(f)))
    assert m.where("m = 255").count() == 400
    target = spark.createDataFrame([(1, 0, 255, 0, 20)], "clip_id int, b int, g int, r int, tolerance int")
    by = {(r["y"], r["x"]): r["m"] for r in S.hsv_mask(f, target).where("(y = 0 and x = 0) or (y = 50 and x = 50)").collect()}
    assert by == {(0, 0): 255, (50, 50): 0}


def test_erode_removes_noise(spark):
    m = grid(spark, 20, 20, "(y between 5 and 14 and x between 5 and 14) or (y = 2 and x = 2)", (255, 0, 0, 0), (0, 0, 0, 0)).withColumnRenamed("b", "m").select(*P.KEY, "m")
    by = {(r["y"], r["x"]): r["m"] for r in S.erode(m, 3).collect()}
    assert by[2, 2] == 0 and by[5, 5] == 0 and by[6, 6] == 255


def test_regions_and_fill(spark):
    m = spark.createDataFrame([(1, 0, y, x, 255) for y, x in ((0, 0), (1, 1), (2, 2), (0, 5), (1, 5))], "clip_id int, frame int, y int, x int, m int")
    sizes = sorted(r["count"] for r in S.connected_regions(m).groupBy("label").count().collect())
    assert sizes == [2, 3]
    plate = grid(spark, 8, 8, "y >= 2 and y < 5 and x >= 3 and x < 6", (250, 250, 250, 0), (40, 50, 60, 255))
    region = plate.where("a = 0")
    out = Y.fill_region(plate, region, 5)
    assert out.where("b <> 40 or g <> 50 or r <> 60 or a <> 255").count() == 0 and out.count() == 64


def test_comb_shaped_region_settles(spark):
    """Teeth joined at the bottom, each tip lower than the next: labels that only hop need a round a tooth."""
    n = 240
    on = [(1, 0, y, 2 * c, 255) for c in range(n) for y in range(n - c, n + 1)] + [(1, 0, n + 1, 2 * c + 1, 255) for c in range(n)]
    labels = S.connected_regions(spark.createDataFrame(on, "clip_id int, frame int, y int, x int, m int"))
    assert [(r["label"], r["count"]) for r in labels.groupBy("label").count().collect()] == [((1 << 31) + 2 * (n - 1), len(on))]


def test_blur_keeps_constants(spark):
    f = grid(spark, 6, 5, "true", (7, 8, 9, 255), (0, 0, 0, 0))
    assert S.gaussian_blur(f, 5).where("b <> 7 or g <> 8 or r <> 9 or a <> 255").count() == 0


def test_bind_pose_is_identity(spark):
    rigs = spark.createDataFrame([(1, 12, 10)], "rig_id int, width int, height int")
    bones = spark.createDataFrame([(1, "a", 0, None, 3.0, 3.0, 6.0, 6.0, 5.0, "smooth"), (1, "b", 1, "a", 6.0, 6.0, 9.0, 6.0, 4.0, "linear")], "rig_id int, bone_id string, ord int, parent_id string, hx double, hy double, tx double, ty double, radius double, falloff string")
    still = grid(spark, 10, 12, "x > 3 and y > 2", (9, 8, 7, 255), (0, 0, 0, 0)).drop("frame")
    none = spark.createDataFrame([], "rig_id int, frame int, bone_id string, rot double, tx double, ty double")
    frames_ = spark.createDataFrame([(1, 0)], "rig_id int, frame int")
    out = R.deform(still, rigs, bones, none, frames_).drop("frame")
    assert out.select(*still.columns).exceptAll(still).count() == 0 and out.count() == 120
    w = R.bone_weights(R.grid_points(rigs), bones).groupBy("y", "x").agg(F.sum("w").alias("w"))
    assert w.where("abs(w - 1) > 1e-5").count() == 0 and w.count() == 120


def test_corrections_apply_in_order(spark):
    ground = spark.createDataFrame([("r", 0, 0, 200, 100, 50)], "rig_id string, y int, x int, b int, g int, r int")
    painted = spark.createDataFrame([("r", 2, 0, 0, 255, 1, 2, 3), ("r", 1, 0, 0, 255, 9, 9, 9), ("r", 3, 0, 0, 0, 5, 5, 5)], "rig_id string, id int, y int, x int, al int, b int, g int, r int")
    assert [tuple(r)[3:] for r in Y.apply_corrections(ground, painted).collect()] == [(1, 2, 3)]


def test_rgba_errors(spark):
    df = spark.createDataFrame([("invalid",)], "c string")
    with pytest.raises(Exception, match="Invalid color format"):
        df.select(P.parse_color_rgba(F.col("c"))).collect()


def test_documents_and_strokes(spark, tmp_path):
    doc = {"id": "one", "schema_version": 1, "canvas": {"width": 8, "height": 9}, "bones": [{"id": "a", "rest": {"head": [1, 2], "tail": [3, 4]}}, {"id": "b", "parent": "a", "rest": {"head": [1, 2], "tail": [3, 4]}, "radius": 3, "falloff": "hard"}], "keyframes": [{"frame": 2, "pose": {"a": {"rot": 0.5}}}]}
    (tmp_path / "rigs").mkdir()
    (tmp_path / "rigs" / "one.json").write_text(json.dumps(doc))
    (tmp_path / "rigs" / "bad.json").write_text("{not json")
    rigs, bones, keys, errors = O.read_rigs(spark, str(tmp_path / "rigs"))
    assert [tuple(r)[:8] for r in rigs.collect()] == [("one", "one", 1, 8, 9, 2.0, 1.0, 24.0)]
    assert sorted((r["bone_id"], r["ord"], r["radius"], r["falloff"]) for r in bones.collect()) == [("a", 0, 10.0, "smooth"), ("b", 1, 3.0, "hard")]
    assert [tuple(r) for r in keys.collect()] == [("one", 2, "a", 0.5, 0.0, 0.0)] and errors.count() == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"strokes": [{"points": [[1, 2], [3, 4]], "radius": 5}]}')
    (tmp_path / "s" / "b.json").write_text('[{"points": [[7, 8]]}]')
    (tmp_path / "s" / "c.json").write_text('"nothing"')
    strokes, bad = O.read_strokes(spark, str(tmp_path / "s"))
    got = sorted((r["file"].rsplit("/", 1)[1], r["stroke"], r["pt"], r["x"], r["y"], r["radius"]) for r in strokes.collect())
    assert got == [("a.json", 0, 0, 1.0, 2.0, 5), ("a.json", 0, 1, 3.0, 4.0, 5), ("b.json", 0, 0, 7.0, 8.0, None)]
    assert bad.count() == 1


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x06"
    gif = b"GIF89a" + struct.pack("<HH", 33, 44)
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 50, -60)
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (199).to_bytes(3, "little")
    vp8 = b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 0x4000 | 320, 240)
    tiff = b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0)
    exif = b"Exif\0\0" + tiff
    jpg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 300, 400) + b"\0\0\0\0"
    for name, data in {"a.png": png, "b.gif": gif, "c.bmp": bmp, "d.webp": vp8x, "e.webp": vp8, "f.jpg": jpg, "g.txt": b"hello"}.items():
        (tmp_path / name).write_bytes(data)
    out = {r["path"].rsplit("/", 1)[1]: (r["format"], r["width"], r["height"]) for r in O.scan_image_headers(spark, str(tmp_path)).collect()}
    assert out == {"a.png": ("png", 640, 480), "b.gif": ("gif", 33, 44), "c.bmp": ("bmp", 50, 60), "d.webp": ("webp", 100, 200), "e.webp": ("webp", 320, 240), "f.jpg": ("jpeg", 300, 400), "g.txt": (None, None, None)}


def test_frames_must_agree(spark, tmp_path):
    O.write_pixels(frames(spark, 3), str(tmp_path / "ok"), 2)
    assert O.read_pixels(spark, str(tmp_path / "ok")).count() == 12
    with pytest.raises(ValueError, match="shape"):
        O.write_pixels(frames(spark, 3).where("frame < 2 or x < 1"), str(tmp_path / "bad"))


def test_registry_rejects_what_it_does_not_know(spark):
    with pytest.raises(ValueError, match="unknown operator"):
        registry.run(frames(spark, 2), [("melt", {})])
    with pytest.raises(TypeError):
        registry.run(frames(spark, 2), [("pingpong", {"speed": 2})])


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "job_id long, t string").selectExpr("job_id", "cast(t as timestamp) ts")
    df.write.parquet(str(tmp_path / "in"))
    out = K.run_available(K.stream_stall(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    assert sorted((r["job_id"], r["n"]) for r in out.collect()) == [(1, 1), (1, 2)]


def test_row_distances_equal_the_definition():
    rng = np.random.RandomState(3)
    g = rng.choice([0.0, 1.0, 4.0, 9.0, 1e18], (40, 23))
    p = np.arange(23)
    want = (g[:, None, :] + (p[:, None] - p[None, :]) ** 2).min(2)
    assert np.array_equal(Y.nearest_squares(g), want)
    assert np.array_equal(Y.nearest_squares(np.full((2, 5), 1e18)), np.full((2, 5), 1e18))


def test_a_chain_of_bones_of_any_length(spark):
    n = 70
    rows = [(1, f"b{k}", k, f"b{k - 1}" if k else None, float(k), 0.0, float(k + 1), 0.0, 5.0, "smooth") for k in range(n)]
    bones = spark.createDataFrame(rows, "rig_id int, bone_id string, ord int, parent_id string, hx double, hy double, tx double, ty double, radius double, falloff string")
    assert R.bone_closure(bones).count() == n * (n - 1) // 2
    assert R.bone_closure(bones).where("depth = 69").count() == 1
    few = bones.where("ord < 12")
    world = R.bone_world(few, few.selectExpr("rig_id", "0 frame", "bone_id", "0.0D rot", "1.0D tx", "0.0D ty"))
    assert world.count() == 12 and world.where("bone_id = 'b11'").first()["c"] == 12


def test_rig_rules_in_the_order_of_the_document(spark):
    bone = "rig_id int, bone_id string, ord int, parent_id string, hx double, hy double, tx double, ty double, radius double, falloff string"
    fine = lambda r, b, o=0, **k: (r, b, o, k.get("parent"), k.get("hx", 1.0), 1.0, 2.0, 2.0, k.get("radius", 5.0), k.get("falloff", "hard"))
    nan = float("nan")
    bones = spark.createDataFrame([
        *(fine(r, "a") for r in (0, 1, 2, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19)), fine(3, "a", 0, falloff="steep"), fine(3, "", 1), fine(4, "a", 0), fine(4, "a", 1, radius=0.0), fine(5, "a", 0, hx=nan), fine(6, "a", 0, radius=-1.0, parent="z"), fine(7, "a", 0, parent="b"), fine(7, "b", 1, parent="a"), fine(8, "a", 0, parent="z"),
    ], bone)
    keys = spark.createDataFrame([(10, -1, "a", 0.0, 0.0, 0.0), (11, 3, "a", nan, 0.0, 0.0), (11, 5, "z", 0.0, 0.0, 0.0), (0, 3, "a", 0.5, None, 0.0)], "rig_id int, frame int, bone_id string, rot double, tx double, ty double")
    rig = lambda r, **k: (r, k.get("schema", "good"), k.get("version", 1), k.get("width", 8), 8, k.get("power"), k.get("scale"), k.get("frames"), k.get("fps"), k.get("character"), k.get("background"), k.get("fade"), k.get("color"))
    rigs = spark.createDataFrame([
        rig(0), rig(1, schema="bad", version=2), rig(2, version=2), *(rig(k) for k in range(3, 12)), rig(12, power=-1.0), rig(13, scale=0.0), rig(14, frames=0), rig(15, fps=nan), rig(16, character=""), rig(17, background=""), rig(18, fade=-2), rig(19, color=[1.0, 2.0]),
    ], "rig_id int, schema string, schema_version int, width int, height int, power double, radius_scale double, frames int, fps double, character string, background string, fade int, color array<double>")
    got = {r["rig_id"]: r["rule"] for r in R.audit_rigs(rigs, bones, keys, schema="good").collect()}
    assert got == {1: "schema", 2: "version", 3: "falloff", 4: "duplicate_bone", 5: "rest", 6: "radius", 7: "cycle", 8: "unknown_parent", 9: "no_bones", 10: "keyframe_frame", 11: "pose", 12: "power", 13: "radius_scale", 14: "frames", 15: "fps", 16: "character", 17: "background", 18: "fade", 19: "color"}


def test_loops_with_options(spark):
    twenty = frames(spark, 20)
    assert lengths(L.make_loop(twenty, "speedramp", ramp_factor=0.5)) == 10 and lengths(L.make_loop(twenty, "speedramp")) == 20
    assert lengths(L.make_loop(twenty, "morph", morph_steps=3)) == 23 and lengths(L.make_loop(twenty, "periodic", cycle=7)) == 7
    assert lengths(L.make_loop(twenty, "pingpong", fps=10, until=1.0)) == 29 and lengths(L.make_loop(twenty, "no such")) == 39
    assert L.make_loop(twenty, analyze_only=True).columns[:2] == ["clip_id", "recommended"]
    faded = L.make_loop(twenty, "fade", fade_color="#ffffff", fade_frames=5, fade_type="out").where("frame = 19").first()
    assert (faded["b"], faded["g"], faded["r"]) > (200, 200, 200)
    with pytest.raises(Exception, match="a loop needs 4 frames"):
        L.make_loop(frames(spark, 3), "hold").collect()


def test_layers_of_two_sizes_fail(spark):
    a, b = frames(spark, 2, 2), frames(spark, 2, 3)
    with pytest.raises(Exception, match="layers differ in size: clip 1 is 2x2 and 3x3"):
        P.composite_over(a, b).collect()
    assert P.composite_over(a, b, strict=False).count() == 18
    with pytest.raises(Exception, match="still and mask differ in size"):
        P.split_layers(a, b.withColumnRenamed("b", "m")).collect()


def test_heal_and_its_parts(spark):
    plate = grid(spark, 12, 12, "y between 5 and 6 and x between 5 and 6", (250, 0, 0, 255), (10, 20, 30, 255))
    strokes = spark.createDataFrame([(1, 0, 5.0, 5.0, 4)], "plate_id int, stroke int, x double, y double, radius int")
    parts = Y.heal_parts(plate, strokes, 2, 12, 12, 3)
    assert parts["plate"].where("b > 60").count() == 0 and parts["content"].where("b <> 10").count() == 0 and parts["plate"].count() == 144
    assert parts["replaced"].where("b = 250").count() == 4 and parts["mask"].where("m > 0").count() == len(Y.disc(4))
    assert [tuple(r) for r in parts["bbox"].collect()] == [(1, 1, 1, 9, 9, 2)]
    large = grid(spark, 24, 24, "y between 10 and 13 and x between 10 and 13", (250, 0, 0, 255), (10, 20, 30, 255))
    other = Y.heal_parts(large, strokes, 2, 12, 12, 3, (24, 24))
    assert other["plate"].count() == 576 and other["plate"].where("b > 130").count() == 0 and other["content"].count() == 144
    with pytest.raises(Exception, match="no painted point on plate 1"):
        Y.heal(plate, strokes.where("stroke > 0"), 2, 12, 12)


def test_corrections_are_part_of_the_patch(spark):
    rigs = spark.createDataFrame([(1, 12, 10)], "rig_id int, width int, height int")
    bones = spark.createDataFrame([(1, "a", 0, None, 3.0, 3.0, 6.0, 6.0, 9.0, "hard")], "rig_id int, bone_id string, ord int, parent_id string, hx double, hy double, tx double, ty double, radius double, falloff string")
    keys = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 0.0), (1, 1, "a", 0.0, 3.0, 0.0)], "rig_id int, frame int, bone_id string, rot double, tx double, ty double")
    still = grid(spark, 10, 12, "x between 3 and 5 and y between 3 and 5", (9, 8, 7, 255), (0, 0, 0, 0)).drop("frame")
    plate = grid(spark, 10, 12, "true", (50, 60, 70, 255), (0, 0, 0, 0))
    at = spark.createDataFrame([(1, 0), (1, 1)], "rig_id int, frame int")
    painted = spark.createDataFrame([(1, 5, 4, 7, 255, 1, 2, 3)], "rig_id int, id int, y int, x int, al int, b int, g int, r int")
    out = {(r["y"], r["x"]): (r["b"], r["g"], r["r"], r["a"]) for r in Y.build_patch(still, rigs, bones, keys, at, plate, 0, 2, painted).collect()}
    assert out[4, 7] == (1, 2, 3, 255) and out[4, 6] == (50, 60, 70, 255) and out[0, 0] == (50, 60, 70, 0)


def test_layers_that_are_given_up(spark):
    still = grid(spark, 12, 12, "y between 4 and 7 and x between 4 and 7", (0, 0, 255, 255), (0, 255, 0, 255)).selectExpr("explode(array(1, 2, 3, 4)) clip_id", "frame", "y", "x", "b", "g", "r", "a")
    stored = still.where("clip_id = 1").selectExpr("clip_id", "frame", "y", "x", "9 m")
    settings = spark.createDataFrame([(1, True, True, True), (2, True, True, False), (3, True, False, True), (4, False, True, True)], "rig_id int, split boolean, has_character boolean, has_background boolean")
    masks = Y.resolve_layers(stored, still, settings).transform(Y.cut)
    assert {r["clip_id"]: r["n"] for r in masks.where("m > 0").groupBy("clip_id").agg(F.count("m").alias("n")).collect()} == {1: 144, 2: 16}
    hole = still.selectExpr("clip_id", "frame", "y", "x", "case when r > 0 then 255 else 0 end m")
    plates = Y.resolve_plates(still.where("clip_id = 1"), still, hole.where("clip_id <> 3"), settings, 2)
    assert {r["clip_id"] for r in plates.select("clip_id").distinct().collect()} == {1}
    both = Y.resolve_plates(still.where("clip_id = 1"), still, hole, None, 2)
    assert both.where("clip_id > 1 and (g <> 255 or a <> 255)").count() == 0 and both.count() == 4 * 144
