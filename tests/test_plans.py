"""Plans whose exploded sides must never be broadcast: the planner sees them by the few rows that they come from."""

import duckdb
import numpy as np
import pytest

from tessera import queries as Q
from tessera.operators import layers, loops, rigs
from tessera.sources import shared


def exploded_broadcasts(df):
    """Broadcasts of the plan that ran, whose side holds exploded rows."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    found = 0
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[k + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            found += any("Generate" in other for other in below)
    return found


@pytest.mark.parametrize("name", ["f5_retime_repeat", "g1_pingpong", "g2_reverse_loop", "g6_speedramp_slow", "g1_pingpong_until", "i7_correction_band", "i8_heal_other_size", "h12_supplier_map", "h14_supplier_deform", "h15_supplier_footprints", "i10_supplier_patch"])
def test_exploded_sides_are_not_broadcast(spark, sf_dir, name):
    assert exploded_broadcasts(Q.queries()[name](spark, sf_dir)) == 0


@pytest.mark.parametrize("name", ["h12_supplier_map", "h14_supplier_deform", "h15_supplier_footprints", "i10_supplier_patch"])
def test_no_step_of_a_rig_a_supplier_is_broadcast(spark, sf_dir, monkeypatch, name):
    ran, cut = [], shared.cut
    for module in (shared, rigs, layers):
        monkeypatch.setattr(module, "cut", lambda df: ran.append(df) or cut(df))
    last = Q.queries()[name](spark, sf_dir)
    last.collect()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*ran, last)]
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p.split("== Initial Plan ==")[0]]


def test_painted_rows_are_put_together_as_bits(spark):
    rng = np.random.RandomState(5)
    rows = [(int(rng.randint(2)), k, float(rng.randint(-40, 400)) / 2, float(rng.randint(-40, 240)) / 2, float(r)) for k, r in enumerate([0, 1, 2, 3, 50, 90] * 6)] + [(3, 99, None, 4.0, 2.0)]
    got = layers.stroke_mask(spark.createDataFrame(rows, "plate_id int, stroke int, x double, y double, radius double"), 140, 70)
    want = set()
    for plate, _, cx, cy, radius in rows[:-1]:
        for dy, dx in layers.disc(int(radius) or layers.DEFAULT_RADIUS):
            y, x = round(cy + dy), round(cx + dx)  # half to even
            want |= {(plate, y, x)} if 0 <= y < 70 and 0 <= x < 140 else set()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()  # whose groups are lists, and are sorted out to disk


def rows_of_both(spark, where, name, **tables):
    """The rows of a query over ``tables`` and of its SQL."""
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for table, df in tables.items():
        df.write.parquet(f"{where}/{table}.parquet")
        c.sql(f"create view {table} as select * from '{where}/{table}.parquet/*.parquet'")
    got = Q.queries()[name](spark, str(where))
    want = c.sql(f"select {', '.join(got.columns)} from ({Q.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_a_fingerprint_of_more_than_a_leaf_equals_its_sql(spark, sf_dir, tmp_path):
    small = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation")}
    supplier = spark.range(25_000).selectExpr("id s_suppkey", "cast(id % 25 as int) s_nationkey")
    got, want = rows_of_both(spark, tmp_path, "i11_content_fingerprint", supplier=supplier, **small)
    assert got == want and len(got) == 5


def test_best_matches_over_blocks_equal_all_pairs(spark, monkeypatch):
    rng = np.random.RandomState(3)
    rows = [(c, f, y, x, *(int(v) for v in rng.randint(0, 60, 3))) for c in (1, 2) for f in range(11) for y in range(3) for x in range(2) if rng.rand() < 0.8]
    rows += [(1, 4, y, x, *p) for c, f, y, x, *p in rows if (c, f) == (1, 2)]  # a frame twice
    df = spark.createDataFrame(rows, "clip_id int, frame int, y int, x int, b int, g int, r int")
    monkeypatch.setattr(loops, "BLOCK", 4)
    first, last = df.where("frame < 9 or clip_id = 2"), df.where("frame > 1")
    best = {}
    for c in (1, 2):
        for s in range(9 if c == 1 else 11):
            for e in range(2, 11):
                d = [sum((p - q) ** 2 for p, q in zip(a[4:], b[4:], strict=True)) for a in rows for b in rows if a[:2] == (c, s) and b[:2] == (c, e) and a[2:4] == b[2:4]]
                if d:
                    best[c] = min(best.get(c, (9.0, 0, 0)), (-max(0.0, 100 - sum(d) / (3 * len(d)) / 10), s, e))
    got = {r["clip_id"]: (-r["score"], r["start_frame"], r["end_frame"]) for r in loops.best_match_point(first, last, 30).collect()}
    assert got == best
    pairs = loops._block_bests(first, last)
    assert pairs.groupBy("clip_id").count().where("count > 4").count() == 2
