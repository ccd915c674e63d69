"""Colour analytics: ranges, samples, clusters, borders, statistics, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import CHANNELS, KEY, clips_of

#: Shifts of all channels around a base colour, in order.
VARIATIONS = (15, -15, 20, -20, 25, -25, 10)
DEFAULT_BACKGROUND = (115, 188, 129)


def color_ranges(base: DataFrame, num_ranges: int = 5, tol: int = 25) -> DataFrame:
    """(clip_id, ord, b, g, r, tolerance): the base colour and ``num_ranges - 1`` shifts of it.

    The first has ``tol``, the others five more; 0 ranges give all but the last shift.
    """
    shifts = _shifts(num_ranges)
    rows = F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("s"), F.lit(tol).alias("t")), *(F.struct(F.lit(k + 1).alias("ord"), F.lit(s).alias("s"), F.lit(tol + 5).alias("t")) for k, s in enumerate(shifts)))
    clamp = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.col(c) + F.col("v.s"))).alias(c)
    return base.select("clip_id", *CHANNELS, F.explode(rows).alias("v")).select("clip_id", F.col("v.ord").alias("ord"), *(clamp(c) for c in CHANNELS), F.col("v.t").alias("tolerance"))


def _shifts(num_ranges: int) -> tuple[int, ...]:
    return VARIATIONS[: num_ranges - 1]


def corner_samples(pixels: DataFrame, corner: int = 5) -> DataFrame:
    """(clip_id, ord, b, g, r): the truncated means of four corners of frames 0, 1 and the last.

    A clip of one frame has frame 0 twice, of two frames frame 1 twice.
    """
    clips = clips_of(pixels)
    picks = F.expr("filter(array(named_struct('k', 0, 'f', 0), named_struct('k', 1, 'f', 1), named_struct('k', 2, 'f', total_frames - 1)), p -> p.f < total_frames and p.f >= 0)")
    rows = clips.select("clip_id", "width", "height", F.explode(picks).alias("p")).select("clip_id", "width", "height", F.col("p.k").alias("k"), F.col("p.f").alias("frame"))
    d = pixels.join(rows, ["clip_id", "frame"])
    top, bottom, left, right = F.col("y") < corner, F.col("y") >= F.col("height") - corner, F.col("x") < corner, F.col("x") >= F.col("width") - corner
    at = F.array_compact(F.array(F.when(top & left, 0), F.when(top & right, 1), F.when(bottom & left, 2), F.when(bottom & right, 3)))
    d = d.select("clip_id", (F.col("k") * 4).alias("k4"), *CHANNELS, F.explode(at).alias("c"))
    return d.groupBy("clip_id", (F.col("k4") + F.col("c")).alias("ord")).agg(*(F.floor(F.avg(c)).cast("int").alias(c) for c in CHANNELS))


def cluster_colors(samples: DataFrame, tol: float) -> DataFrame:
    """(clip_id, ord, b, g, r): greedy clusters of a clip's samples in order, each a truncated mean.

    A sample joins the first cluster whose first member is within ``tol``.
    """
    ordered = samples.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", *CHANNELS))).alias("s"))
    kind = "array<struct<b:int,g:int,r:int,sb:bigint,sg:bigint,sr:bigint,n:bigint>>"
    fold = f"""aggregate(s, cast(array() as {kind}), (acc, p) -> case
      when exists(acc, c -> sqrt(pow(c.b - p.b, 2) + pow(c.g - p.g, 2) + pow(c.r - p.r, 2)) <= {float(tol)}D) then
        transform(acc, (c, i) -> case when i = array_position(transform(acc, d -> sqrt(pow(d.b - p.b, 2) + pow(d.g - p.g, 2) + pow(d.r - p.r, 2)) <= {float(tol)}D), true) - 1
          then named_struct('b', c.b, 'g', c.g, 'r', c.r, 'sb', c.sb + p.b, 'sg', c.sg + p.g, 'sr', c.sr + p.r, 'n', c.n + 1) else c end)
      else concat(acc, array(named_struct('b', p.b, 'g', p.g, 'r', p.r, 'sb', cast(p.b as bigint), 'sg', cast(p.g as bigint), 'sr', cast(p.r as bigint), 'n', 1L))) end)"""
    out = ordered.select("clip_id", F.posexplode(F.expr(fold)).alias("ord", "c"))
    return out.select("clip_id", "ord", *(F.floor(F.col(f"c.s{c}") / F.col("c.n")).cast("int").alias(c) for c in CHANNELS))


def background_color(pixels: DataFrame, corner: int = 5, tol: float = 30) -> DataFrame:
    """(clip_id, b, g, r): the first cluster of each clip's corners, once a clip."""
    first = cluster_colors(corner_samples(pixels, corner), tol).where("ord = 0").select("clip_id", *CHANNELS)
    default = dict(zip(CHANNELS, DEFAULT_BACKGROUND, strict=True))
    return pixels.select("clip_id").distinct().join(first, "clip_id", "left").na.fill(default)


def border_color(pixels: DataFrame, bw: int = 10, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """(*by, b, g, r): the truncated mean of four border strips; pixels of two strips count twice.

    The strips are at most a quarter of the frame; with none, the bottom and right ones are the frame.
    """
    d = pixels.join(clips_of(pixels), "clip_id").withColumn("bw", F.least(F.lit(bw), F.floor(F.col("height") / 4).cast("int"), F.floor(F.col("width") / 4).cast("int")))
    n = lambda c: c.cast("int")
    none = F.col("bw") == 0
    w = n(F.col("y") < F.col("bw")) + n(none | (F.col("y") >= F.col("height") - F.col("bw"))) + n(F.col("x") < F.col("bw")) + n(none | (F.col("x") >= F.col("width") - F.col("bw")))
    d = d.withColumn("w", w).where("w > 0")
    return d.groupBy(*by).agg(*(F.floor(F.sum(F.col(c) * F.col("w")) / F.sum("w")).cast("int").alias(c) for c in CHANNELS))


def dominant_color(pixels: DataFrame) -> DataFrame:
    """(clip_id, hex): medians of frame 0's opaque pixels, else of its centre, else of all of it."""
    d = pixels.where("frame = 0").join(clips_of(pixels), "clip_id")
    centre = F.col("y").between(F.floor(F.col("height") / 4), F.floor(3 * F.col("height") / 4) - 1) & F.col("x").between(F.floor(F.col("width") / 4), F.floor(3 * F.col("width") / 4) - 1)
    level = F.when(F.col("a") > 0, 0).when(centre, 1).otherwise(2)
    d = d.withColumn("level", level)
    best = d.groupBy("clip_id").agg(F.min("level").alias("best"))
    d = d.join(best, "clip_id").where((F.col("level") == F.col("best")) | (F.col("best") == 2))
    med = lambda c: F.floor(F.expr(f"percentile({c}, 0.5)")).cast("int")
    return d.groupBy("clip_id").agg(F.format_string("#%02x%02x%02x", med("r"), med("g"), med("b")).alias("hex"))


def frame_stats(pixels: DataFrame, on: Column | None = None) -> DataFrame:
    """(clip_id, frame, mean_b, mean_g, mean_r, min_v, max_v, fg, bbox_*) with the box of pixels with ``on`` (a > 0)."""
    on = F.col("a") > 0 if on is None else on
    low, high = (lambda c: F.min(F.when(on, F.col(c)))), (lambda c: F.max(F.when(on, F.col(c))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return pixels.groupBy("clip_id", "frame").agg(
        *(F.avg(c).alias(f"mean_{c}") for c in CHANNELS), F.min(F.least(*CHANNELS)).alias("min_v"), F.max(F.greatest(*CHANNELS)).alias("max_v"), F.count_if(on).alias("fg"),
        zero(low("x")).alias("bbox_x"), zero(low("y")).alias("bbox_y"), zero(high("x") - low("x") + 1).alias("bbox_width"), zero(high("y") - low("y") + 1).alias("bbox_height"),
    )


def crop(pixels: DataFrame, bbox: DataFrame) -> DataFrame:
    """Pixels within each frame's half-open box (clip_id, frame, bbox_*), from its corner."""
    b = bbox.select("clip_id", "frame", "bbox_x", "bbox_y", "bbox_width", "bbox_height")
    d = pixels.join(b, ["clip_id", "frame"]).where("x >= bbox_x and x < bbox_x + bbox_width and y >= bbox_y and y < bbox_y + bbox_height")
    return d.select("clip_id", "frame", (F.col("y") - F.col("bbox_y")).alias("y"), (F.col("x") - F.col("bbox_x")).alias("x"), *CHANNELS, "a")
