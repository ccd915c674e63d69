"""Resizing, padding, trimming, retiming, joining and chunking of clips."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import CHANNELS, KEY, clips_of, densify

BGRA = [*CHANNELS, "a"]


def upto(n: Column) -> Column:
    """Rows 0 to n - 1; none for n < 1."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")))


def _axis(clips: DataFrame, size: str, to: Column, name: str) -> DataFrame:
    """(clip_id, t<name>, <name>, w<name>): the two source places of each target place, half-pixel centres, clamped."""
    d = clips.select("clip_id", size, to.cast("int").alias("to")).select("clip_id", size, "to", upto(F.col("to")).alias(f"t{name}"))
    s = F.least(F.greatest((F.col(f"t{name}") + 0.5) * F.col(size) / F.col("to") - 0.5, F.lit(0.0)), F.col(size) - F.lit(1.0))
    low = F.floor(s).cast("int")
    d = d.select("clip_id", f"t{name}", low.alias("low"), (s - low).alias("f"), size)
    two = F.array(F.struct(F.col("low").alias("p"), (1 - F.col("f")).alias("w")), F.struct(F.least(F.col("low") + 1, F.col(size) - 1).alias("p"), F.col("f").alias("w")))
    return d.select("clip_id", f"t{name}", F.explode(two).alias("s")).select("clip_id", f"t{name}", F.col("s.p").alias(name), F.col("s.w").alias(f"w{name}")).where(f"w{name} > 0")


def resize(df: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear; -1 for one side keeps the aspect. The weights are one small table per axis and clip."""
    if width < 1 and height < 1:
        raise ValueError("width or height must be given")
    clips = clips_of(df)
    w = F.lit(width) if width > 0 else F.greatest(F.lit(1), F.rint(F.col("width") * height / F.col("height")).cast("int"))
    h = F.lit(height) if height > 0 else F.greatest(F.lit(1), F.rint(F.col("height") * width / F.col("width")).cast("int"))
    d = densify(df, clips).join(_axis(clips, "width", w, "x").hint("merge"), ["clip_id", "x"])
    d = d.groupBy("clip_id", "frame", "y", "tx").agg(*(F.sum(F.col(c) * F.col("wx")).alias(c) for c in BGRA))
    d = d.join(_axis(clips, "height", h, "y").hint("merge"), ["clip_id", "y"])
    d = d.groupBy("clip_id", "frame", "ty", "tx").agg(*(F.rint(F.round(F.sum(F.col(c) * F.col("wy")), 6)).cast("int").alias(c) for c in BGRA))
    return d.withColumnsRenamed({"ty": "y", "tx": "x"})


def resize_grids(v: np.ndarray, width: int, height: int) -> np.ndarray:
    """``resize`` of whole frames (n, height, width)."""

    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.minimum(np.maximum((np.arange(to) + 0.5) * n / to - 0.5, 0.0), n - 1.0)
        low = np.floor(s).astype(int)
        return low, np.minimum(low + 1, n - 1), s - low

    low, high, f = axis(v.shape[2], width)
    v = v[:, :, low] * (1 - f) + v[:, :, high] * f
    low, high, f = axis(v.shape[1], height)
    v = v[:, low] * (1 - f)[:, None] + v[:, high] * f[:, None]
    return np.rint(np.floor(v * 1e6 + 0.5) / 1e6)


def pad(df: DataFrame, width: int, height: int) -> DataFrame:
    """Each clip scaled to fit, in the middle of a transparent frame of that size."""
    clips = clips_of(df)
    scale = F.least(F.lit(float(width)) / F.col("width"), F.lit(float(height)) / F.col("height"))
    fit = clips.select("clip_id", "width", "height", F.floor(F.col("width") * scale).cast("int").alias("nw"), F.floor(F.col("height") * scale).cast("int").alias("nh"))
    d = densify(df, clips).join(_axis(fit, "width", F.col("nw"), "x").hint("merge"), ["clip_id", "x"])
    d = d.groupBy("clip_id", "frame", "y", "tx").agg(*(F.sum(F.col(c) * F.col("wx")).alias(c) for c in BGRA))
    d = d.join(_axis(fit, "height", F.col("nh"), "y").hint("merge"), ["clip_id", "y"])
    d = d.groupBy("clip_id", "frame", "ty", "tx").agg(*(F.rint(F.round(F.sum(F.col(c) * F.col("wy")), 6)).cast("int").alias(c) for c in BGRA))
    d = d.join(fit, "clip_id").select("clip_id", "frame", (F.col("ty") + F.floor((height - F.col("nh")) / 2)).cast("int").alias("y"), (F.col("tx") + F.floor((width - F.col("nw")) / 2)).cast("int").alias("x"), *BGRA)
    return densify(d, clips.select("clip_id", F.lit(width).alias("width"), F.lit(height).alias("height"), "total_frames"))


def frame_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("clip_id").agg((F.max("frame") + 1).cast("int").alias("n"))


def scan_range(df: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames from ``start`` to ``end``, inclusive (clip_id, total_frames, start, end); end null or below 0 is the last."""
    last = F.col("total_frames") - 1
    end = F.least(F.when(F.col("end").isNull() | (F.col("end") < 0), last).otherwise(F.col("end")), last)
    start = F.greatest(F.lit(0), F.least("start", F.greatest(end, F.lit(0))))
    bounds = clips.select("clip_id", start.alias("_lo"), end.alias("_hi"))
    return df.join(bounds, "clip_id").where("frame between _lo and _hi").drop("_lo", "_hi")


def trim(df: DataFrame, fps: float, start: float = 0.0, end: float | None = None, duration: float | None = None) -> DataFrame:
    """Frames of [start, end) seconds, numbered from 0; ``duration`` comes before ``end``."""
    stop = start + duration if duration is not None else end
    t = F.col("frame") / F.lit(float(fps))
    d = df.where(t >= start) if stop is None else df.where((t >= start) & (t < stop))
    first = d.groupBy("clip_id").agg(F.min("frame").alias("_first"))
    return d.join(first, "clip_id").withColumn("frame", (F.col("frame") - F.col("_first")).cast("int")).drop("_first")


def reindex(df: DataFrame, index: DataFrame) -> DataFrame:
    """The frames that ``index`` (clip_id, out_frame, src_frame) names, under their new numbers.

    An index is exploded from a row a clip, which is the size that a planner sees, so it is never broadcast.
    """
    rest = [c for c in df.columns if c not in ("clip_id", "frame")]
    i = index.select("clip_id", F.col("src_frame").alias("frame"), "out_frame").hint("merge")
    return df.join(i, ["clip_id", "frame"]).select("clip_id", F.col("out_frame").cast("int").alias("frame"), *rest)


def retime_index(counts: DataFrame, fps_in: float, fps_out: float) -> DataFrame:
    """Nearest source frames for a new rate; the number of frames keeps the duration."""
    m = F.rint(F.col("n") * (fps_out / fps_in))
    i = counts.select("clip_id", "n", upto(m).alias("out_frame"))
    return i.select("clip_id", "out_frame", F.least(F.col("n") - 1, F.rint(F.col("out_frame") * (fps_in / fps_out)).cast("int")).alias("src_frame"))


def retime_drop(df: DataFrame, fps_in: float, fps_out: float) -> DataFrame:
    return df if fps_in < fps_out else reindex(df, retime_index(frame_counts(df), fps_in, fps_out))


def retime_repeat(df: DataFrame, fps_in: float, fps_out: float) -> DataFrame:
    return reindex(df, retime_index(frame_counts(df), fps_in, fps_out))


def retime_interpolate(df: DataFrame, fps_in: float, fps_out: float, columns: tuple[str, ...] = ("b", "g", "r", "a")) -> DataFrame:
    """Each new frame between the two source frames around its time; pixels are rounded, other values not."""
    counts = frame_counts(df)
    i = counts.select("clip_id", "n", upto(F.rint(F.col("n") * (fps_out / fps_in))).alias("out_frame"))
    s = F.least(F.col("n") - F.lit(1.0), F.col("out_frame") * (fps_in / fps_out))
    i = i.select("clip_id", "out_frame", F.floor(s).cast("int").alias("lo"), F.least(F.col("n") - 1, F.floor(s).cast("int") + 1).alias("hi"), (s - F.floor(s)).alias("f"))
    two = F.array(F.struct(F.col("lo").alias("frame"), (1 - F.col("f")).alias("w")), F.struct(F.col("hi").alias("frame"), F.col("f").alias("w")))
    i = i.select("clip_id", "out_frame", F.explode(two).alias("s")).select("clip_id", "out_frame", F.col("s.frame").alias("frame"), F.col("s.w").alias("w")).where("w > 0")
    place = [c for c in df.columns if c not in ("clip_id", "frame", *columns)]
    whole = dict(df.dtypes)
    total = lambda c: F.rint(F.round(F.sum(F.col(c) * F.col("w")), 6)).cast("int") if whole[c] == "int" else F.sum(F.col(c) * F.col("w"))
    out = df.join(i, ["clip_id", "frame"]).groupBy("clip_id", F.col("out_frame").cast("int").alias("frame"), *place).agg(*(total(c).alias(c) for c in columns))
    return out.select(*df.columns)


def block_match_flow(first: DataFrame, second: DataFrame, block: int = 4, search: int = 2) -> DataFrame:
    """(clip_id, by, bx, dy, dx): each block's displacement with the least difference, from gray frames (clip_id, y, x, v).

    Ties go to the smallest |dy| + |dx|, then dy, then dx; pixels moved out of the frame count as 0.
    """
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-search, search + 1) for dx in range(-search, search + 1)))
    d = first.select("clip_id", "y", "x", F.col("v").alias("v1"), F.explode(moves).alias("m")).select("clip_id", "y", "x", "v1", "m.dy", "m.dx")
    to = second.select("clip_id", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("v").alias("v2"))
    d = d.withColumn("y2", F.col("y") + F.col("dy")).withColumn("x2", F.col("x") + F.col("dx")).join(to, ["clip_id", "y2", "x2"], "left")
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    g = d.groupBy("clip_id", at("y").alias("by"), at("x").alias("bx"), "dy", "dx").agg(F.sum(F.abs(F.col("v1") - F.coalesce("v2", F.lit(0)))).alias("sad"))
    best = F.min(F.struct("sad", (F.abs("dy") + F.abs("dx")).alias("far"), "dy", "dx")).alias("m")
    return g.groupBy("clip_id", "by", "bx").agg(best).select("clip_id", "by", "bx", "m.dy", "m.dx")


def concat_clips(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks (clip_id, chunk, start_frame, total) of each clip, one after the other by start.

    ``df`` numbers frames within its chunk. An offset is the total of the chunks before.
    """
    w = Window.partitionBy("clip_id").orderBy("start_frame", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    at = chunks.select("clip_id", "chunk", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("_at"))
    return df.join(at, ["clip_id", "chunk"]).withColumn("frame", (F.col("frame") + F.col("_at")).cast("int")).drop("_at", "chunk")


def frame_chunks(clips: DataFrame, size: int | None = None, players: int = 1, whole: bool = False) -> DataFrame:
    """(clip_id, chunk, start_frame, end_frame), ends inclusive; ``whole`` gives one chunk a clip.

    The size is at least 10, and by default a quarter of each player's share.
    """
    s = F.col("total_frames") if whole else F.lit(size) if size else F.greatest(F.lit(10), F.floor(F.col("total_frames") / (players * 4)))
    d = clips.where("total_frames > 0").select("clip_id", "total_frames", s.cast("int").alias("s"))
    d = d.select("clip_id", "total_frames", "s", F.posexplode(F.expr("sequence(0, total_frames - 1, s)")).alias("chunk", "start_frame"))
    return d.select("clip_id", "chunk", "start_frame", F.least(F.col("start_frame") + F.col("s"), "total_frames").cast("int").alias("end_")).select("clip_id", "chunk", "start_frame", (F.col("end_") - 1).alias("end_frame"))


def pipeline(df: DataFrame, steps: list[tuple[Callable, dict]]) -> DataFrame:
    """The steps (operator, arguments) one after the other; the first that fails stops it."""
    for fn, kwargs in steps:
        df = df.transform(lambda d, fn=fn, kwargs=kwargs: fn(d, **kwargs))
    return df


def per_frame(df: DataFrame, fn: Callable, schema: str | None = None, **kwargs) -> DataFrame:
    """A user's ``fn(table, **kwargs) -> table`` on the Arrow table of each frame."""
    return df.groupBy("clip_id", "frame").applyInArrow(lambda t: fn(t, **kwargs), schema or df.schema)


def frame_plan(clips: DataFrame) -> DataFrame:
    """(clip_id, total_frames, fps, error) of (clip_id, kind, probed, opt_frames, duration_s, fps).

    A video has its probed count, a rig its option, else its duration, at 24 frames a second
    if none is given, an image one frame; no frames are an error.
    """
    fps = F.coalesce("fps", F.lit(24.0))
    n = F.when(F.col("kind") == "image", 1).when(F.col("kind") == "video", F.coalesce("probed", F.lit(0))).otherwise(F.coalesce(F.col("opt_frames"), F.rint(F.col("duration_s") * fps).cast("int"), F.lit(0)))
    d = clips.select("clip_id", n.cast("int").alias("total_frames"), fps.alias("fps"))
    return d.withColumn("error", F.when(F.col("total_frames") <= 0, "no frames"))


def remap(pixels: DataFrame, to: DataFrame) -> DataFrame:
    """Each target (clip_id, frame, y, x, sy, sx) from its four source neighbours, transparent outside, rounded."""
    ly, lx = F.floor("sy").cast("int"), F.floor("sx").cast("int")
    fy, fx = F.col("sy") - ly, F.col("sx") - lx
    near = [F.struct((ly + j).alias("py"), (lx + i).alias("px"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("w")) for j in (0, 1) for i in (0, 1)]
    d = to.select(*KEY, F.explode(F.array(*near)).alias("s")).select(*KEY, F.col("s.py").alias("py"), F.col("s.px").alias("px"), F.col("s.w").alias("w"))
    has = "frame" in pixels.columns
    src = pixels.select(*(["clip_id", "frame"] if has else ["clip_id"]), F.col("y").alias("py"), F.col("x").alias("px"), *BGRA)
    d = d.join(src, [*(["clip_id", "frame"] if has else ["clip_id"]), "py", "px"], "left")
    return d.groupBy(*KEY).agg(*(F.rint(F.round(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("w")), 6)).cast("int").alias(c) for c in BGRA))
