"""Pixel, signal, rig, correction and ledger tables, derived by Spark from relational tables.

``SQL`` has each one in DuckDB's dialect, for checks by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vector ids to a block of frames.
IDS = 1 << 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(c: Column) -> Column:
    return c.cast("int")


def placed(rows: DataFrame, by: str, block: Column, *order: str) -> DataFrame:
    """``rows`` with ``place``, each row's place from 0 among those of the same ``by``, in that order.

    ``block`` must rise with the order. Each block is sorted by itself, and the counts of the
    blocks before it are added, so a group that holds most rows is spread over many tasks.
    Rows without ``by`` are left out.
    """
    rows = rows.withColumn("_block", block)
    counts = rows.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(by, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(by, "_block").orderBy(*order)) - 1
    return rows.join(offsets, [by, "_block"]).withColumn("place", _int(within + F.col("_before"))).drop("_block", "_before")


def _by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place among their user's, in order of time; blocks are weeks."""
    return placed(_table(spark, sf_dir, "events"), "user_id", F.date_trunc("week", "ts"), "ts", "event_id")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 frames from vectors of 64 values; a clip per label."""
    level = lambda k: _int(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e")[(F.col("i") + k) % 64].cast("double") + 0.6) / 1.2 * 255))))
    f = placed(_table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", F.floor(F.col("vec_id") / IDS), "vec_id")
    f = f.select(F.col("label").alias("clip_id"), F.col("place").alias("frame"), F.col("embedding").alias("e"))
    p = f.select("clip_id", "frame", "e", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return p.select("clip_id", "frame", _int(F.floor(F.col("i") / 8)).alias("y"), _int(F.col("i") % 8).alias("x"), level(0).alias("b"), level(21).alias("g"), level(42).alias("r"), F.lit(255).alias("a"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value per clip and frame; a clip per user."""
    return _by_time(spark, sf_dir).select(F.col("user_id").alias("clip_id"), F.col("place").alias("frame"), "value")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x64 frames, one pixel per order, alpha by status; the last frame is partial."""
    k = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("bigint")
    return _table(spark, sf_dir, "orders").select(
        F.lit(0).alias("clip_id"), _int(F.floor(k / 4096)).alias("frame"), _int(F.floor((k % 4096) / 64)).alias("y"), _int(k % 64).alias("x"),
        _int(F.col("o_custkey") % 256).alias("b"), _int(price % 256).alias("g"), _int(F.floor(F.col("o_totalprice") / 256).cast("bigint") % 256).alias("r"),
        F.when(F.col("o_orderstatus") == "F", 255).when(F.col("o_orderstatus") == "O", 128).otherwise(0).alias("a"),
    )


def wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sparse frames 400 wide, a pixel per order line."""
    k = F.col("l_orderkey")
    g = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"), F.max("l_partkey").alias("part"))
    return g.select(
        F.lit(0).alias("clip_id"), _int(F.col("l_linenumber") - 1).alias("frame"), _int(F.floor(k / 400)).alias("y"), _int(k % 400).alias("x"),
        _int(F.floor("p").cast("bigint") % 256).alias("b"), _int(F.col("q").cast("bigint") * 5 % 256).alias("g"), _int(F.col("part") % 256).alias("r"), F.lit(255).alias("a"),
    )


def bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rigs as forests: region, nation, supplier."""
    d = lambda c: c.cast("double")
    n, s, null = F.col("n_nationkey"), F.col("s_suppkey"), F.lit(None).cast("string")
    names = ["rig_id", "bone_id", "ord", "parent_id", "hx", "hy", "tx", "ty", "radius", "falloff"]
    lit = lambda v: F.lit(float(v))
    roots = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.lit(0), null, lit(32), lit(56), lit(32), lit(40), lit(20), F.lit("smooth"))
    mid = _table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("bigint"), F.concat(F.lit("N"), n.cast("string")), _int(1 + n), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), d(8 + (n * 11) % 48), d(8 + (n * 7) % 48), d(14 + (n * 11) % 48), d(2 + (n * 7) % 48), d(10 + n % 7),
        F.when(n % 3 == 0, "smooth").when(n % 3 == 1, "linear").otherwise("hard"),
    )
    low = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == n).select(
        F.col("n_regionkey").cast("bigint"), F.concat(F.lit("S"), s.cast("string")), _int(100 + s), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), d(4 + (s * 5) % 56), d(4 + (s * 9) % 56), d(8 + (s * 5) % 56), d(8 + (s * 9) % 56), d(6 + s % 5), F.lit("smooth")
    )
    return roots.toDF(*names).unionByName(mid.toDF(*names)).unionByName(low.toDF(*names))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of the nations' bones at frames 0, 12, 24 and 36; some are missing."""
    n, f = F.col("n_nationkey"), F.col("frame")
    k = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.array(*map(F.lit, (0, 12, 24, 36)))).alias("frame"))
    return k.where((n + F.floor(f / 12)) % 4 != 0).select(
        F.col("n_regionkey").cast("bigint").alias("rig_id"), "frame", F.concat(F.lit("N"), n.cast("string")).alias("bone_id"), (((n * 13 + f) % 21 - 10) / F.lit(20.0)).alias("rot"), ((n + f) % 5 - 2).cast("double").alias("tx"), ((n + 2 * f) % 5 - 2).cast("double").alias("ty")
    )


def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of chunk attempts: about four a chunk, a job per user."""
    return _by_time(spark, sf_dir).select(
        F.col("user_id").alias("job_id"), _int(F.floor(F.col("place") / 4)).alias("chunk_id"), F.concat(F.lit("player-"), (F.col("event_id") % 4).cast("string")).alias("player_id"), "event_id", "ts",
        F.when(F.col("event_type").isin("error", "signup"), "failed").otherwise("ok").alias("result"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of corrections; some reach past the canvas, some have another canvas."""
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        e.alias("id"), F.col("user_id").cast("string").alias("rig_id"), (e % 64 - 4).alias("bbox_x"), ((e * 3) % 64 - 4).alias("bbox_y"), (4 + e % 9).alias("bbox_width"), (4 + e % 7).alias("bbox_height"), (e % 6).alias("fade"),
        F.when(e % 10 == 0, 32).otherwise(64).alias("canvas_width"), F.lit(64).alias("canvas_height"), F.col("ts").alias("inserted_at"),
    )


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brush points; radius 0 is not given."""
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("plate_id"), e.alias("stroke"), _int((e * 5) % 64).alias("x"), _int((e * 11) % 64).alias("y"), _int(e % 5).alias("radius"))


SQL = {
    "pixels": """
select clip_id, frame, i // 8 y, i % 8 x,
  cast(least(255, greatest(0, floor((cast(e[i + 1] as double) + 0.6) / 1.2 * 255))) as int) b,
  cast(least(255, greatest(0, floor((cast(e[(i + 21) % 64 + 1] as double) + 0.6) / 1.2 * 255))) as int) g,
  cast(least(255, greatest(0, floor((cast(e[(i + 42) % 64 + 1] as double) + 0.6) / 1.2 * 255))) as int) r, 255 a
from (select clip_id, frame, e, cast(unnest(range(0, 64)) as int) i from
  (select label clip_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) frame, embedding e from embeddings))""",
    "signal": "select user_id clip_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) frame, value from events",
    "mosaic": """
select 0 clip_id, cast(floor(o_orderkey / 4096) as int) frame, cast(floor((o_orderkey % 4096) / 64) as int) y, cast(o_orderkey % 64 as int) x, cast(o_custkey % 256 as int) b,
  cast(cast(floor(o_totalprice) as bigint) % 256 as int) g, cast(cast(floor(o_totalprice / 256) as bigint) % 256 as int) r, case o_orderstatus when 'F' then 255 when 'O' then 128 else 0 end a from orders""",
    "wall": """
select 0 clip_id, cast(l_linenumber - 1 as int) frame, cast(floor(l_orderkey / 400) as int) y, cast(l_orderkey % 400 as int) x, cast(cast(floor(max(l_extendedprice)) as bigint) % 256 as int) b,
  cast(cast(max(l_quantity) as bigint) * 5 % 256 as int) g, cast(max(l_partkey) % 256 as int) r, 255 a from lineitem group by l_orderkey, l_linenumber""",
    "bones": """
select cast(r_regionkey as bigint) rig_id, concat('R', r_regionkey) bone_id, 0 ord, cast(null as varchar) parent_id, 32.0::double hx, 56.0::double hy, 32.0::double tx, 40.0::double ty, 20.0::double radius, 'smooth' falloff from region
union all select n_regionkey, concat('N', n_nationkey), 1 + n_nationkey, concat('R', n_regionkey), 8 + (n_nationkey * 11) % 48, 8 + (n_nationkey * 7) % 48, 14 + (n_nationkey * 11) % 48, 2 + (n_nationkey * 7) % 48, 10 + n_nationkey % 7, case n_nationkey % 3 when 0 then 'smooth' when 1 then 'linear' else 'hard' end from nation
union all select n_regionkey, concat('S', s_suppkey), 100 + s_suppkey, concat('N', s_nationkey), 4 + (s_suppkey * 5) % 56, 4 + (s_suppkey * 9) % 56, 8 + (s_suppkey * 5) % 56, 8 + (s_suppkey * 9) % 56, 6 + s_suppkey % 5, 'smooth' from supplier join nation on s_nationkey = n_nationkey""",
    "keyframes": """
select cast(n_regionkey as bigint) rig_id, f frame, concat('N', n_nationkey) bone_id, ((n_nationkey * 13 + f) % 21 - 10) / 20.0::double rot, cast((n_nationkey + f) % 5 - 2 as double) tx, cast((n_nationkey + 2 * f) % 5 - 2 as double) ty
from nation cross join (select unnest([0, 12, 24, 36]) f) k where (n_nationkey + f // 12) % 4 <> 0""",
    "chunk_events": """
select user_id job_id, cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 4) as int) chunk_id, concat('player-', event_id % 4) player_id, event_id, ts,
  case when event_type in ('error', 'signup') then 'failed' else 'ok' end result from events""",
    "corrections": """
select event_id id, cast(user_id as varchar) rig_id, event_id % 64 - 4 bbox_x, (event_id * 3) % 64 - 4 bbox_y, 4 + event_id % 9 bbox_width, 4 + event_id % 7 bbox_height, event_id % 6 fade,
  case when event_id % 10 = 0 then 32 else 64 end canvas_width, 64 canvas_height, ts inserted_at from events where event_type = 'purchase'""",
    "strokes": "select user_id plate_id, event_id stroke, cast((event_id * 5) % 64 as int) x, cast((event_id * 11) % 64 as int) y, cast(event_id % 5 as int) radius from events where event_type = 'click'",
}


def oracle(body: str, *names: str) -> str:
    """``body`` over the derived tables ``names``; a body that begins with ``,`` defines more tables first."""
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + body
