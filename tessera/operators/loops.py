"""Frame-order operators: loops, cycles, similarity.

A loop is a table of (clip_id, out_frame, src_frame) joined to the frames, so it works on
signals and pixels alike and on many clips at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .geometry import BGRA, block_match_flow, frame_counts, reindex, remap, upto
from .pixels import CHANNELS, KEY, blend_column, gray_column, parse_color_rgba

#: Frames of a block that is held against another, at most, and their pixels.
BLOCK, BLOCK_PIXELS = 2048, 1 << 17


def _index(df: DataFrame, m: Column, src: Column) -> DataFrame:
    return frame_counts(df).select("clip_id", "n", upto(m).alias("i")).select("clip_id", F.col("i").alias("out_frame"), src.cast("int").alias("src_frame"))


def pingpong(df: DataFrame, fps: float = 30, until: float | None = None) -> DataFrame:
    """Forward, then back; with ``until`` seconds (negative: from the end), what follows it alone."""
    t = F.lit(0)
    if until is not None:
        k = int(until * fps)
        t = F.least(F.col("n"), F.greatest(F.lit(0), (F.col("n") + k) if k < 0 else F.lit(k)))
    m = F.when(F.col("n") - t < 2, F.col("n")).otherwise(2 * F.col("n") - 1 - t)
    return reindex(df, _index(df, m, F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(2 * F.col("n") - 2 - F.col("i"))))


def reverse_loop(df: DataFrame) -> DataFrame:
    return reindex(df, _index(df, F.when(F.col("n") < 2, F.col("n")).otherwise(2 * F.col("n")), F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(2 * F.col("n") - 1 - F.col("i"))))


def hold_loop(df: DataFrame, hold: int = 2) -> DataFrame:
    return reindex(df, _index(df, F.when((F.col("n") < 4) | F.lit(hold < 1), F.col("n")).otherwise(F.col("n") + hold), F.least(F.col("i"), F.col("n") - 1)))


def speedramp(df: DataFrame, factor: float) -> DataFrame:
    if factor == 1.0:
        return df
    f = max(0.5, min(2.0, factor))
    m = F.when(F.col("n") < 4, F.col("n")).otherwise(F.floor(F.col("n") * F.lit(f)))
    src = F.when((F.col("n") < 4) | (F.col("i") == m - 1), F.when(F.col("n") < 4, F.col("i")).otherwise(F.col("n") - 1)).otherwise(F.floor(F.col("i") * ((F.col("n") - 1) / (m - 1))))
    return reindex(df, _index(df, m, src))


def fade_loop(df: DataFrame, rgba: tuple[int, int, int, int] = (0, 0, 0, 0), frames: int = 10, kind: str = "both") -> DataFrame:
    """Fades out and in at the seam. The colour's r, g, b, a go to b, g, r, a in that order."""
    d = df.join(frame_counts(df), "clip_id")
    f = F.least(F.lit(frames), F.floor(F.col("n") / 4)).cast("int")
    i = F.col("frame")
    start = F.col("n") - 2 * f
    out = F.when((F.col("n") >= 2 * frames) & (f > 0) & (i >= start), F.least(F.lit(1.0), (i - start) / f)) if kind in ("out", "both") else F.lit(None).cast("double")
    into = F.when((F.col("n") >= 2 * frames) & (f > 0) & (i < 2 * f), F.greatest(F.lit(0.0), 1 - i / f)) if kind in ("in", "both") else F.lit(None).cast("double")
    for alpha in (out, into):
        d = d.withColumn("_al", alpha)
        for c, v in zip(BGRA, rgba, strict=True):
            d = d.withColumn(c, F.when(F.col("_al").isNull(), F.col(c)).otherwise(F.rint(F.round(F.col(c) * (1 - F.col("_al")) + v * F.col("_al"), 6)).cast("int")))
    return d.select(*df.columns)


def blend_loop(df: DataFrame, mode: str = "add", k: int = 5) -> DataFrame:
    """The clip without its last k frames, k blends of first and reversed last frames, the clip without its first k."""
    short = F.col("n") < 2 * k
    plain = _index(df, F.when(short, F.col("n")).otherwise(2 * F.col("n") - k), F.when(short | (F.col("i") < F.col("n") - k), F.col("i")).otherwise(F.col("i") - F.col("n") + 2 * k - k))
    counts = frame_counts(df)
    outside = plain.join(counts, "clip_id").where(short | (F.col("out_frame") < F.col("n") - k) | (F.col("out_frame") >= F.col("n"))).select("clip_id", "out_frame", "src_frame")
    base = reindex(df, outside)
    pairs = counts.where(~short).select("clip_id", "n", upto(F.lit(k)).alias("i"))
    one = lambda src: reindex(df, pairs.select("clip_id", (F.col("n") - k + F.col("i")).alias("out_frame"), src.alias("src_frame")))
    last, first = one(F.col("n") - 1 - F.col("i")), one(F.col("i"))
    place = [c for c in df.columns if c not in BGRA]
    second = first.select(*place, *(F.col(c).alias(f"{c}2") for c in BGRA))
    blended = last.join(second, place).select(*place, *(blend_column(F.col(c), F.col(f"{c}2"), mode).alias(c) for c in BGRA))
    return base.unionByName(blended.select(*df.columns))


def frame_diff_signal(df: DataFrame, until: int | None = None) -> DataFrame:
    """(clip_id, frame, value): the mean absolute change of all channels from the frame before; frame 0 has none."""
    w = Window.partitionBy("clip_id", "y", "x").orderBy("frame")
    d = df if until is None else df.where(F.col("frame") < until)
    lags = d.select("clip_id", "frame", *(F.abs(F.col(c) - F.lag(c).over(w)).alias(c) for c in CHANNELS))
    return lags.where("frame > 0").groupBy("clip_id", "frame").agg((F.avg(F.col("b") + F.col("g") + F.col("r")) / 3).alias("value"))


def detect_cycle(diffs: DataFrame, max_period: int = 120) -> DataFrame:
    """(clip_id, cycle): the first peak of the raw autocorrelation of a clip's frame changes, or null.

    A clip is one row of at most ``max_period`` values, so its lags are folds over arrays.
    """
    rows = diffs.where(F.col("frame") < max_period).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("s")).withColumn("v", F.col("s")["value"])
    ac = F.expr("transform(sequence(0, size(v) - 1), k -> aggregate(sequence(0, size(v) - 1 - k), 0D, (acc, i) -> acc + v[i] * v[i + k]))")
    d = rows.withColumn("ac", ac).withColumn("mean", F.expr("aggregate(ac, 0D, (x, y) -> x + y) / size(ac)"))
    peaks = F.expr("filter(sequence(0, size(ac) - 1), k -> k >= 2 and k <= size(ac) - 2 and ac[k] > ac[k - 1] and ac[k] > ac[k + 1] and ac[k] > mean * 1.2D)")
    return d.select("clip_id", F.when(F.size("v") >= 9, F.get(peaks, 0)).alias("cycle"))


def periodic_loop(df: DataFrame, diffs: DataFrame, cycle: int | None = None) -> DataFrame:
    """The first cycle of each clip: as given, as detected in ``diffs``, or half of the clip."""
    c = F.lit(cycle).cast("int") if cycle is not None else F.col("cycle")
    d = frame_counts(df).join(detect_cycle(diffs), "clip_id", "left")
    k = F.when(c.isNull() | (c >= F.col("n")), F.floor(F.col("n") / 2)).otherwise(c)
    keep = d.select("clip_id", F.when(F.col("n") < 10, F.col("n")).otherwise(F.greatest(F.lit(1), F.least(k, F.col("n") - 1))).alias("_k"))
    return df.join(keep, "clip_id").where("frame < _k").drop("_k")


def analyze_loop(df: DataFrame) -> DataFrame:
    """(clip_id, recommended, alternatives, frame_count, first_last_diff, avg_motion, detected_cycle)."""
    counts = frame_counts(df)
    diffs = frame_diff_signal(df, 120)
    motion = diffs.where("frame < 30").groupBy("clip_id").agg(F.avg("value").alias("avg_motion"))
    ends = df.join(counts, "clip_id").where("frame = 0 or frame = n - 1")
    first = ends.where("frame = 0").select("clip_id", "y", "x", *(F.col(c).alias(f"{c}1") for c in CHANNELS))
    last = ends.where("frame = n - 1").select("clip_id", "y", "x", *CHANNELS)
    gap = first.join(last, ["clip_id", "y", "x"]).groupBy("clip_id").agg((F.avg(sum((F.abs(F.col(c) - F.col(f"{c}1")) for c in CHANNELS), F.lit(0))) / 3).alias("first_last_diff"))
    d = counts.join(gap, "clip_id", "left").join(motion, "clip_id", "left").join(detect_cycle(diffs), "clip_id", "left").na.fill(0.0, ["avg_motion", "first_last_diff"])
    cand = lambda ok, k, name: F.when(ok, F.struct(F.lit(-k).alias("k"), F.lit(name).alias("name")))
    still = F.col("avg_motion") < 20
    methods = F.array_sort(F.array_compact(F.array(
        cand(F.col("cycle") < F.col("n") * 0.8, 90, "periodic"), cand(still, 80, "fade"), cand(~still & (F.col("first_last_diff") < 30), 85, "cut"), cand(F.lit(True), 70, "pingpong"), cand(F.col("avg_motion") > 50, 65, "morph"),
    )))
    names = F.when(F.col("n") < 10, F.array(F.lit("hold"))).otherwise(F.transform(methods, lambda x: x["name"]))
    alternatives = F.when(F.col("n") < 10, "hold").otherwise(F.concat_ws(",", F.slice(names, 2, 3)))
    return d.select("clip_id", names[0].alias("recommended"), alternatives.alias("alternatives"), F.col("n").alias("frame_count"), "first_last_diff", "avg_motion", F.col("cycle").alias("detected_cycle"))


def frame_similarity(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("clip_id", "frame"), method: str = "mse") -> DataFrame:
    """(*by, score): 100 less a tenth of the mean squared difference, or less 5 times the mean flow, at least 0."""
    if method == "flow":
        if tuple(by) != ("clip_id",):
            raise ValueError("flow compares one pair of frames a clip")
        f = block_match_flow(a.withColumn("v", gray_column()), b.withColumn("v", gray_column()))
        return f.groupBy("clip_id").agg(F.greatest(F.lit(0.0), 100 - 5 * F.avg(F.hypot("dy", "dx"))).alias("score"))
    if method != "mse":
        raise ValueError(f"unknown similarity method: {method}")
    other = b.select(*by, "y", "x", *(F.col(c).alias(f"{c}2") for c in CHANNELS))
    mse = F.sum(sum((F.pow(F.col(c) - F.col(f"{c}2"), F.lit(2)) for c in CHANNELS), F.lit(0.0))) / (3 * F.count(F.lit(1)))
    return a.join(other, [*by, "y", "x"]).groupBy(*by).agg(F.greatest(F.lit(0.0), 100 - mse / 10).alias("score"))


def _best(scores: DataFrame, thr: float) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("s")).alias("s"), (-F.col("e")).alias("e"))).alias("m")
    d = scores.where("score > 0").groupBy("clip_id").agg(best)
    ok = F.col("m.score") >= thr
    return d.select("clip_id", F.when(ok, -F.col("m.s")).alias("start_frame"), F.when(ok, -F.col("m.e")).alias("end_frame"), F.col("m.score").alias("score"))


def _pair_scores(heads: DataFrame, tails: DataFrame) -> DataFrame:
    """The score of each head frame s with each tail frame e of its clip: both lists are bounded by the scan range.

    A row of pixels of all its clip's frames is one group: squared differences by products of
    matrices, so pixels aren't multiplied by pairs. Values are bytes, so sums are exact.
    """
    cols = ["clip_id", "y", "x", *CHANNELS]
    both = heads.select(*cols, F.col("s").alias("f"), F.lit(True).alias("head")).unionByName(tails.select(*cols, F.col("e").alias("f"), F.lit(False).alias("head")))
    kind = heads.schema["clip_id"].dataType.simpleString()
    parts = both.groupBy("clip_id", "y").applyInArrow(_row_pairs, f"clip_id {kind}, s int, e int, sq double, n bigint")
    sums = parts.groupBy("clip_id", "s", "e").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"))
    return sums.select("clip_id", "s", "e", F.greatest(F.lit(0.0), 100 - F.col("sq") / (3 * F.col("n")) / 10).alias("score"))


def _row_pairs(table: pa.Table) -> pa.Table:
    """(clip_id, s, e, sum of squared differences, pixels in both) for one row of pixels of heads and tails."""
    head = table.column("head").to_numpy(zero_copy_only=False).astype(bool)
    f, x = table.column("f").to_numpy(), np.unique(table.column("x").to_numpy(), return_inverse=True)[1]
    v = np.stack([table.column(c).to_numpy().astype(float) for c in CHANNELS], 1)
    made = []
    for side in (head, ~head):
        frames, row = np.unique(f[side], return_inverse=True)
        value, here = np.zeros((len(frames), x.max() + 1, 3)), np.zeros((len(frames), x.max() + 1))
        value[row, x[side]], here[row, x[side]] = v[side], 1
        made.append((frames, value, here))
    (s, a, i), (e, b, j) = made
    # Where a pixel is missing on one side it counts on neither.
    cross = a.reshape(len(s), -1) @ b.reshape(len(e), -1).T
    sq, n = (a**2).sum(2) @ j.T + i @ (b**2).sum(2).T - 2 * cross, i @ j.T
    at, to = np.nonzero(n)
    clip = table.column("clip_id").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(at), np.int64)))
    return pa.table([clip, s[at].astype(np.int32), e[to].astype(np.int32), sq[at, to], n[at, to].astype(np.int64)], ["clip_id", "s", "e", "sq", "n"])


def best_loop_points(df: DataFrame, scan: int = 100, thr: float = 70) -> DataFrame:
    """(clip_id, start_frame, end_frame, score): the most alike head and tail frames; nulls below ``thr``."""
    d = df.join(frame_counts(df), "clip_id").withColumn("k", F.when(F.col("n") < 2 * scan, F.floor(F.col("n") / 4)).otherwise(scan).cast("int"))
    heads = d.where(F.col("frame") < F.least("k", F.col("n") - F.col("k"))).withColumn("s", F.col("frame"))
    tails = d.where(F.col("frame") >= F.greatest("k", F.col("n") - F.col("k"))).withColumn("e", F.col("frame"))
    return df.select("clip_id").distinct().join(_best(_pair_scores(heads, tails), thr), "clip_id", "left").na.fill(0.0, ["score"])


def best_match_point(first: DataFrame, last: DataFrame, thr: float = 85) -> DataFrame:
    """As ``best_loop_points`` for two tables of frames; a clip that one of them lacks has nulls and 0.

    All frames of a clip are held against all, which is quadratic. Both sides are dealt in blocks of
    frames, and a task gives the best pair of two blocks, so no task holds a clip and no table its pairs.
    """
    best = _best(_block_bests(first, last), thr)
    clips = first.select("clip_id").union(last.select("clip_id")).distinct()
    return clips.join(best, "clip_id", "left").na.fill(0.0, ["score"])


def _block_bests(heads: DataFrame, tails: DataFrame) -> DataFrame:
    """(clip_id, s, e, score): the best pair of each block of a clip's heads with each block of its tails."""
    cols = ["clip_id", "frame", "y", "x", *CHANNELS]
    both = heads.select(*cols, F.lit(True).alias("head")).unionByName(tails.select(*cols, F.lit(False).alias("head")))
    canvas = (F.max("y") + 1).cast("bigint") * (F.max("x") + 1)
    per = both.groupBy("clip_id").agg(F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_PIXELS / F.greatest(F.lit(1), canvas)))).alias("_per"))
    frames = both.groupBy("clip_id", "head", "frame").agg(F.collect_list(F.struct("y", "x", *CHANNELS)).alias("px"))
    frames = frames.join(per, "clip_id").select("clip_id", "head", F.col("frame").cast("int").alias("f"), F.floor(F.col("frame") / F.col("_per")).alias("_block"), "px").transform(cut)
    others = frames.groupBy("clip_id", (~F.col("head")).alias("head")).agg(F.collect_set("_block").alias("_others"))
    met = frames.join(others, ["clip_id", "head"]).select("clip_id", "head", "f", "px", "_block", F.explode("_others").alias("_other"))
    sides = [F.when(F.col("head"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("_block", "_other", "_hb"), ("_other", "_block", "_tb"))]
    kind = heads.schema["clip_id"].dataType.simpleString()
    return met.select("clip_id", "head", "f", "px", *sides).groupBy("clip_id", "_hb", "_tb").applyInArrow(_block_best, f"clip_id {kind}, s int, e int, score double")


def _block_best(table: pa.Table) -> pa.Table:
    """The best pair of a block of heads and one of tails: the first s, then e, of those with the highest score."""
    table = table.combine_chunks()
    px = table.column("px").combine_chunks()
    px = px.chunk(0) if isinstance(px, pa.ChunkedArray) else px
    which = np.repeat(np.arange(len(table)), np.diff(px.offsets.to_numpy()))
    y, x, *v = (c.to_numpy(zero_copy_only=False).astype(float) for c in px.flatten().flatten())
    places, at = np.unique(y * (x.max() + 1) + x, return_inverse=True)
    head, f = table.column("head").to_numpy().astype(bool), table.column("f").to_numpy()
    made = []
    for side in (head, ~head):
        frames, row = np.unique(f[side], return_inverse=True)
        own = np.full(len(f), -1)
        own[side] = row
        some = own[which] >= 0
        cell, n = own[which[some]] * len(places) + at[some], len(frames) * len(places)
        dense = lambda w=None: np.bincount(cell, w, n).reshape(len(frames), -1).astype(float)  # noqa: B023, E731
        value = [c[some] for c in v]
        made.append((frames, np.hstack([dense(c) for c in value]), dense(sum(c * c for c in value)), dense()))
    (s, a, a2, i), (e, b, b2, j) = made
    # Sums over the places of both; a pixel that is missing on one side counts on neither. Values are bytes, so sums are exact.
    n = i @ j.T
    sq = a2 @ j.T + i @ b2.T - 2 * (a @ b.T)
    score = np.where(n > 0, np.maximum(0.0, 100 - sq / (3 * np.maximum(n, 1)) / 10), -1.0)
    row, col = np.unravel_index(np.argmax(score), score.shape)
    best = float(score[row, col])
    clip = table.column("clip_id").slice(0, 1 if best > 0 else 0)
    k = len(clip)
    return pa.table([clip, pa.array([int(s[row])] * k, pa.int32()), pa.array([int(e[col])] * k, pa.int32()), pa.array([best] * k, pa.float64())], ["clip_id", "s", "e", "score"])


def morph_loop(df: DataFrame, steps: int = 10, block: int = 4, search: int = 2) -> DataFrame:
    """The clip and ``steps`` frames that move and fade from its last to its first frame."""
    counts = frame_counts(df)
    d = df.join(counts, "clip_id")
    first = d.where("frame = 0 and n >= 10")
    last = d.where("frame = n - 1 and n >= 10")
    flow = block_match_flow(last.withColumn("v", gray_column()), first.withColumn("v", gray_column()), block, search)
    grid = last.select("clip_id", "n", "y", "x", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx")).join(flow, ["clip_id", "by", "bx"])
    grid = grid.select("clip_id", "n", "y", "x", "dy", "dx", upto(F.lit(steps)).alias("i")).withColumn("t", (F.col("i") + 1) / F.lit(steps + 1.0))
    frame = (F.col("n") + F.col("i")).cast("int").alias("frame")
    moved = lambda src, k: remap(src.drop("frame"), grid.select("clip_id", frame, "y", "x", (F.col("y") - F.col("dy") * k).alias("sy"), (F.col("x") - F.col("dx") * k).alias("sx")))
    a, b = moved(last.drop("n"), F.col("t")), moved(first.drop("n"), F.col("t") - 1)
    t = grid.select("clip_id", frame, "y", "x", "t")
    b = b.select(*KEY, *(F.col(c).alias(f"{c}2") for c in BGRA))
    mid = a.join(b, KEY).join(t, KEY).select(*KEY, *(F.rint(F.col(c) * (1 - F.col("t")) + F.col(f"{c}2") * F.col("t")).cast("int").alias(c) for c in BGRA))
    return df.unionByName(mid.select(*df.columns)) if steps > 0 else df


def make_loop(
    df: DataFrame, method: str = "auto", *, fade_color: str | tuple = "transparent", fade_frames: int = 10, fade_type: str = "both", morph_steps: int = 10, cycle: int | None = None, hold: int = 2,
    blend_mode: str = "add", ramp_factor: float = 1.0, fps: float = 30, until: float | None = None, analyze_only: bool = False,
) -> DataFrame:
    """Each clip by the named method, or by the one that its analysis recommends.

    With ``auto`` and ``analyze_only``, the analysis. ``fade_color``: r, g, b, a, or a colour's
    notation; ``ramp_factor`` 1 leaves a clip as it is. A method of no name here is pingpong.
    A clip of fewer than 4 frames fails the job.
    """
    short = frame_counts(df).where("n < 4").select("clip_id", F.lit(True).alias("_short"))
    error = F.raise_error(F.concat(F.lit("a loop needs 4 frames; too few in clip "), F.col("clip_id").cast("string"))).cast(df.schema["clip_id"].dataType)
    df = df.join(short, "clip_id", "left").select(*(F.when(F.col("_short"), error).otherwise(F.col(c)).alias(c) if c == "clip_id" else c for c in df.columns))
    if method == "auto" and analyze_only:
        return analyze_loop(df)
    rgba = fade_color
    if isinstance(fade_color, str):
        of = parse_color_rgba(F.lit(fade_color))
        rgba = tuple(of[k] for k in range(4))
    ways = {
        "pingpong": lambda d: pingpong(d, fps, until), "reverse": reverse_loop, "hold": lambda d: hold_loop(d, hold), "fade": lambda d: fade_loop(d, rgba, fade_frames, fade_type), "blend": lambda d: blend_loop(d, blend_mode),
        "morph": lambda d: morph_loop(d, morph_steps), "speedramp": lambda d: speedramp(d, ramp_factor), "periodic": lambda d: periodic_loop(d, frame_diff_signal(d, 120), cycle),
    }
    if method != "auto":
        return ways.get(method, pingpong)(df)
    picks = analyze_loop(df).select("clip_id", F.col("recommended").alias("_way"))
    d = df.join(picks, "clip_id")
    out = pingpong(d.where("_way = 'cut'").drop("_way"))  # no loop of that name
    for name in ("periodic", "fade", "pingpong", "hold"):
        out = out.unionByName(ways[name](d.where(F.col("_way") == name).drop("_way")))
    return out
