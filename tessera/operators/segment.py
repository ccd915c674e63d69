"""Segmentation by colour and motion, neighbourhood operators, and effects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .color import border_color, color_ranges
from .pixels import CHANNELS, KEY, clips_of, densify, densify_mask, gray_column, hsv_columns, mask_or, over_columns

#: Rows of a strip whose regions one task finds; strips of a group whose borders one task joins.
STRIP, STRIPS = 64, 64


def _ranges_by(ranges: DataFrame, by: list[str]) -> DataFrame:
    """A row for each clip (or frame) with its boxes in one array, so pixels join it once and never multiply."""
    return ranges.groupBy(*by).agg(F.collect_list(F.struct(*CHANNELS, "tolerance")).alias("_boxes"))


def _in_box(box: Column) -> Column:
    ok = F.lit(True)
    for c in CHANNELS:
        low, high = F.greatest(F.lit(0), box[c] - box["tolerance"]), F.least(F.lit(255), box[c] + box["tolerance"])
        ok = ok & (F.col(c) >= low) & (F.col(c) <= high)
    return ok


def boxed(pixels: DataFrame, ranges: DataFrame, inside: int) -> DataFrame:
    """Mask with ``inside`` in any of the ranges (clip_id[, frame], b, g, r, tolerance), 255 - ``inside`` elsewhere."""
    by = ["clip_id", "frame"] if "frame" in ranges.columns else ["clip_id"]
    d = pixels.join(_ranges_by(ranges, by), by, "left")
    hit = F.coalesce(F.exists("_boxes", _in_box), F.lit(False))
    return d.select(*KEY, F.when(hit, inside).otherwise(255 - inside).alias("m"))


def key_mask(pixels: DataFrame, ranges: DataFrame | None = None, adaptive: bool = False, cleanup: int = 0, soft: int = 0) -> DataFrame:
    """255 for the foreground: pixels in none of the background's ranges.

    ``adaptive`` takes each frame's border colour with tolerance 30 in place of ``ranges``.
    """
    if adaptive:
        ranges = border_color(pixels, by=("clip_id", "frame")).withColumn("tolerance", F.lit(30))
    m = boxed(pixels, ranges, 0)
    m = edge_cleanup(m, cleanup) if cleanup > 0 else m
    return soft_edges(m, soft) if soft > 0 else m


def bgr_mask(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """255 where a pixel matches any target (clip_id, b, g, r, tolerance)."""
    return boxed(pixels, targets, 255)


def hsv_mask(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """255 where the hue is within a target's tolerance, clamped to 0..180, and saturation and value are at least 50."""
    h, s, v = hsv_columns()
    t = targets.select("clip_id", *CHANNELS, "tolerance").withColumn("th", h).groupBy("clip_id").agg(F.collect_list(F.struct("th", "tolerance")).alias("_t"))
    d = pixels.join(t, "clip_id", "left").withColumn("_h", h).withColumn("_s", s).withColumn("_v", v)
    near = lambda x: (F.col("_h") >= F.greatest(F.lit(0), x["th"] - x["tolerance"])) & (F.col("_h") <= F.least(F.lit(180), x["th"] + x["tolerance"]))
    ok = F.coalesce(F.exists("_t", near), F.lit(False)) & (F.col("_s") >= 50) & (F.col("_v") >= 50)
    return d.select(*KEY, F.when(ok, 255).otherwise(0).alias("m"))


def mask_to_alpha(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels with the mask as alpha, whatever alpha they had."""
    return pixels.drop("a").join(mask.select(*KEY, F.col("m").alias("a")), KEY)


def _morph(mask: DataFrame, size: int, iters: int, of) -> DataFrame:
    """A square neighbourhood's extreme, by two one-dimensional windows; a clip-level mask has no frame."""
    frame = [c for c in ("clip_id", "frame") if c in mask.columns]
    k = (size + 1 if size % 2 == 0 else size) // 2 * iters
    across = Window.partitionBy(*frame, "y").orderBy("x").rangeBetween(-k, k)
    down = Window.partitionBy(*frame, "x").orderBy("y").rangeBetween(-k, k)
    return mask.withColumn("m", of("m").over(across)).withColumn("m", of("m").over(down)).select(*frame, "y", "x", "m")


def dilate(mask: DataFrame, size: int, iters: int = 1) -> DataFrame:
    """The largest value within ``size`` (even sizes take one more), ``iters`` times; needs a full grid."""
    return _morph(mask, size, iters, F.max)


def erode(mask: DataFrame, size: int, iters: int = 1) -> DataFrame:
    return _morph(mask, size, iters, F.min)


def edge_cleanup(mask: DataFrame, k: int) -> DataFrame:
    return mask if k <= 0 else erode(mask, 2 * k + 1)


def soft_edges(mask: DataFrame, s: int) -> DataFrame:
    """Half of what dilation by ``s`` adds, truncated."""
    if s <= 0:
        return mask
    d = dilate(mask, 2 * s + 1).withColumnRenamed("m", "d")
    m, w = F.col("m") / F.lit(255.0), F.col("d") / F.lit(255.0)
    return mask.join(d, KEY).select(*KEY, F.floor(255 * (m + (w - m) * 0.5)).cast("int").alias("m"))


def gaussian_blur(df: DataFrame, ksize: int, sigma: float = 0, columns: tuple[str, ...] = ("b", "g", "r", "a")) -> DataFrame:
    """Separable Gaussian with mirrored borders, rounded once; needs a full grid.

    Rows, then columns, become arrays, so a kernel is a fold over indices and not a join.
    """
    import math

    k = ksize + 1 if ksize % 2 == 0 else ksize
    s = sigma if sigma > 0 else 0.3 * ((k - 1) / 2 - 1) + 0.8
    w = [math.exp(-((i - k // 2) ** 2) / (2 * s * s)) for i in range(k)]
    w = [x / sum(w) for x in w]

    def one(d: DataFrame, line: str, along: str) -> DataFrame:
        rows = d.groupBy("clip_id", "frame", line).agg(F.array_sort(F.collect_list(F.struct(along, *columns))).alias("v"))
        rows = rows.withColumn("n", F.size("v"))
        at = lambda i, o: F.when(F.col("n") == 1, 0).otherwise((F.col("n") - 1) - F.abs((F.col("n") - 1) - F.pmod(F.abs(i + o), 2 * (F.col("n") - 1))))
        fold = lambda c: F.transform("v", lambda x, i: sum((w[j] * F.get(F.col("v")[c], at(i, j - k // 2).cast("int")) for j in range(k)), F.lit(0.0)))
        for c in columns:
            rows = rows.withColumn(f"_{c}", fold(c))
        z = F.arrays_zip(F.col("v")[along].alias(along), *(F.col(f"_{c}").alias(c) for c in columns))
        return rows.select("clip_id", "frame", line, F.explode(z).alias("z")).select("clip_id", "frame", line, F.col(f"z.{along}").alias(along), *(F.col(f"z.{c}").alias(c) for c in columns))

    out = one(one(df.select(*KEY, *columns), "y", "x"), "x", "y")
    return out.select(*KEY, *(F.floor(F.col(c) + 0.5).cast("int").alias(c) for c in columns))


def motion_region(pixels: DataFrame, n: int = 30, thr: int = 15, k: int = 11) -> DataFrame:
    """(clip_id, y, x, m): where grey changed by more than ``thr`` in any of the first ``n`` steps, grown by 3k."""
    dense = densify(pixels)
    w = Window.partitionBy("clip_id", "y", "x").orderBy("frame")
    d = dense.select("clip_id", "frame", "y", "x", gray_column().alias("g")).where(F.col("frame") <= n).withColumn("p", F.lag("g").over(w))
    moved = d.groupBy("clip_id", "y", "x").agg(F.when(F.coalesce(F.max(F.abs(F.col("g") - F.col("p")) > thr), F.lit(False)), 255).otherwise(0).alias("m"))
    return dilate(moved, k, 3)


def motion_color_mask(pixels: DataFrame, motion: DataFrame, bg: DataFrame, thr: float = 20) -> DataFrame:
    """255 where a moving pixel's colour is further than ``thr`` from the background's (clip_id, b, g, r), grown by 5."""
    back = bg.select("clip_id", *(F.col(c).alias(f"{c}0") for c in CHANNELS))
    d = pixels.join(back, "clip_id").join(motion.select("clip_id", "y", "x", "m"), ["clip_id", "y", "x"], "left")
    far = F.sqrt(sum((F.pow(F.col(c) - F.col(f"{c}0"), F.lit(2)) for c in CHANNELS), F.lit(0.0))) > thr
    return dilate(d.select(*KEY, F.when(far & (F.coalesce("m", F.lit(0)) > 0), 255).otherwise(0).alias("m")), 5)


def combined_mask(color: DataFrame, motion_color: DataFrame | None) -> DataFrame:
    return color if motion_color is None else mask_or(color, motion_color)


def missed_pixels(pixels: DataFrame, alpha: DataFrame, ranges: DataFrame, tol: int | None = None) -> DataFrame:
    """Opaque pixels (clip_id, frame, y, x) in a background range; ``tol`` replaces the ranges' own."""
    r = ranges.withColumn("tolerance", F.lit(tol)) if tol else ranges
    hit = boxed(pixels, r, 255).where("m = 255").select(*KEY)
    return alpha.where("m > 0").select(*KEY).join(hit, KEY, "left_semi")


def missed_blocks(pixels: DataFrame, alpha: DataFrame, ranges: DataFrame, tol: int | None = None, block: int = 32) -> DataFrame:
    """(clip_id, frame, by, bx, fg, bg): blocks where over half of the opaque pixels are background."""
    r = ranges.withColumn("tolerance", F.lit(tol)) if tol else ranges
    d = alpha.select(*KEY, F.col("m").alias("al")).join(boxed(pixels, r, 255), KEY)
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    g = d.groupBy("clip_id", "frame", at("y").alias("by"), at("x").alias("bx")).agg(F.count_if(F.col("al") > 0).alias("fg"), F.count_if((F.col("al") > 0) & (F.col("m") > 0)).alias("bg"))
    return g.where("fg > 0 and bg > 0.5 * fg")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node linked with it by the links (a, b): roots hook to smaller ones, then paths halve."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            return up
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (far := up[up] != up).any():
            up[far] = up[up[far]]


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y2: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of runs (y, x0, x1) and sorted, disjoint runs (y2, a0, a1) of the same row that touch, corners too."""
    wide = int(max(x1.max(initial=0), a1.max(initial=0))) + 4
    first = np.searchsorted(y2 * wide + a1, y * wide + x0 - 1, side="left")
    last = np.searchsorted(y2 * wide + a0, y * wide + x1 + 1, side="right")
    # The row before ends, and the row after begins, beyond what a run of this row can reach.
    n = np.maximum(0, last - first)
    i = np.repeat(np.arange(len(y)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _strip_runs(table: pa.Table) -> pa.Table:
    """The runs (y, x0, x1) of a strip's pixels with the label of their region in the strip."""
    y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    low, left = y.min(), x.min()
    wide = int(x.max() - left) + 4
    place = np.unique((y - low) * wide + (x - left) + 1)
    starts = np.flatnonzero(np.diff(place, prepend=-9) != 1)
    ends = np.append(starts[1:], len(place)) - 1
    row, x0, x1 = place[starts] // wide, place[starts] % wide - 1, place[ends] % wide - 1
    label = least_labels(len(row), *touching(row - 1, x0, x1, row, x0, x1))
    n = len(row)
    return pa.table({
        **{c: table.column(c).take(pa.array(np.zeros(n, np.int64))) for c in ("clip_id", "frame", "strip")},
        "y": pa.array((row + low).astype(np.int32)), "x0": pa.array((x0 + left).astype(np.int32)), "x1": pa.array((x1 + left).astype(np.int32)),
        "label": pa.array((row + low)[label] * (1 << 31) + (x0 + left)[label]),
    })


def _border_links(table: pa.Table) -> pa.Table:
    """(label, least): regions of neighbouring strips that touch at the borders of one group of strips."""
    y, x0, x1, label = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "label"))
    lower = table.column("lower").to_numpy(zero_copy_only=False)
    order = np.lexsort((x0, y))
    y, x0, x1, label, lower = y[order], x0[order], x1[order], label[order], lower[order]
    up, down = ~lower, lower
    i, j = touching(y[up] + 1, x0[up], x1[up], y[down], x0[down], x1[down])
    names, at = np.unique(label, return_inverse=True)
    least = least_labels(len(names), at[up][i], at[down][j])
    moved = least != np.arange(len(names))
    k = int(moved.sum())
    return pa.table({**{c: table.column(c).take(pa.array(np.zeros(k, np.int64))) for c in ("clip_id", "frame")}, "label": pa.array(names[moved]), "least": pa.array(names[least[moved]])})


def connected_regions(mask: DataFrame, strip: int = STRIP, group: int = STRIPS) -> DataFrame:
    """(clip_id, frame, y, x, label): 8-connected regions of m > 0, labelled by their least pixel number.

    A strip of rows becomes runs, whose regions one task finds; then the borders between the
    strips of a group are joined, then those between groups, and so on. So a frame of one strip
    takes one shuffle of pixels, however its regions wind, and larger ones one more for each
    level of the strips' tree, of the runs at borders alone. A region's area is its pixel count.
    """
    if strip < 2:
        raise ValueError("a strip has at least two rows")
    kinds = dict(mask.dtypes)
    on = mask.where("m > 0").select(*KEY, F.floor(F.col("y") / strip).cast("int").alias("strip"))
    runs = on.groupBy("clip_id", "frame", "strip").applyInArrow(_strip_runs, f"clip_id {kinds['clip_id']}, frame {kinds['frame']}, strip int, y int, x0 int, x1 int, label bigint").transform(cut)
    ends = runs.agg(F.min("strip"), F.max("strip")).collect()[0]
    size, maps = 1, []
    while ends[0] is not None and ends[0] // size != ends[1] // size:
        # Borders between the last level's groups that are inside one of this level's.
        d = runs.where((F.pmod("y", F.lit(strip * size)) == 0) | (F.pmod("y", F.lit(strip * size)) == strip * size - 1))
        for m in maps:
            d = _relabelled(d, m)
        lower = F.pmod("y", F.lit(strip * size)) == 0
        line = F.floor(F.col("y") / (strip * size)) + F.when(lower, 0).otherwise(1)
        d = d.select("clip_id", "frame", "y", "x0", "x1", "label", lower.alias("lower"), line.alias("line")).where(F.pmod("line", F.lit(group)) != 0)
        links = d.groupBy("clip_id", "frame", F.floor(F.col("line") / group).alias("_group")).applyInArrow(_border_links, f"clip_id {kinds['clip_id']}, frame {kinds['frame']}, label bigint, least bigint")
        maps.append(links.transform(cut))
        size *= group
    for m in maps:
        runs = _relabelled(runs, m)
    return runs.select("clip_id", "frame", F.col("y").cast(kinds["y"]).alias("y"), F.explode(F.sequence(F.col("x0").cast(kinds["x"]), F.col("x1").cast(kinds["x"]))).alias("x"), "label")


def _relabelled(runs: DataFrame, links: DataFrame) -> DataFrame:
    return runs.join(links, ["clip_id", "frame", "label"], "left").withColumn("label", F.coalesce("least", "label")).drop("least")


def missed_regions(pixels: DataFrame, alpha: DataFrame, ranges: DataFrame, tol: int | None = None, area: int = 50) -> DataFrame:
    """Pixels of the opaque regions of at least ``area`` pixels with over 0.4 of background."""
    r = ranges.withColumn("tolerance", F.lit(tol)) if tol else ranges
    labels = connected_regions(dilate(densify_mask(alpha), 5))
    d = labels.join(boxed(pixels, r, 255), KEY, "left")
    bad = d.groupBy("clip_id", "frame", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") > 0).alias("bg")).where(f"n >= {area} and bg > 0.4 * n")
    return labels.join(bad, ["clip_id", "frame", "label"], "left_semi").select(*KEY)


def refine(pixels: DataFrame, alpha: DataFrame, bg: DataFrame, tol: int = 45, cleanup: int = 0, soft: int = 0) -> DataFrame:
    """The alpha mask without missed background pixels and regions, then cleaned and softened."""
    ranges = color_ranges(bg, 3)
    gone = missed_pixels(pixels, alpha, ranges, tol).unionByName(missed_regions(pixels, alpha, ranges, tol)).distinct().withColumn("_gone", F.lit(1))
    out = alpha.join(gone, KEY, "left").select(*KEY, F.when(F.col("_gone") == 1, 0).otherwise(F.col("m")).alias("m"))
    return soft_edges(edge_cleanup(out, cleanup), soft)


def remove_background(pixels: DataFrame, bg: DataFrame, method: str = "color", tol: int = 25, num_ranges: int = 5, cleanup: int = 0, soft: int = 0, refined: bool = False) -> DataFrame:
    """The pixels with the background (clip_id, b, g, r) transparent, by colour, motion or both."""
    late = (0, 0) if refined else (cleanup, soft)
    color = key_mask(pixels, color_ranges(bg, num_ranges, tol), cleanup=late[0], soft=late[1])
    if method in ("motion", "combined"):
        moving = motion_color_mask(pixels, motion_region(pixels), bg, tol)
        color = moving if method == "motion" else combined_mask(color, moving)
    if refined:
        color = refine(pixels, color, bg, cleanup=cleanup, soft=soft)
    return mask_to_alpha(pixels, color)


def character_alpha(still: DataFrame, tol: int = 25, num_ranges: int = 5) -> DataFrame:
    """The mask of one still per clip, keyed against its own border colour."""
    return key_mask(still, color_ranges(border_color(still), num_ranges, tol))


def ellipse(t: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of the filled ellipse of size 2t + 1."""
    out = []
    for dy in range(-t, t + 1):
        dx = round(t * (max(0.0, 1 - dy * dy / (t * t)) ** 0.5)) if t else 0
        out += [(dy, k) for k in range(-dx, dx + 1)]
    return out


def outline(pixels: DataFrame, color: tuple[int, int, int], thickness: int = 5) -> DataFrame:
    """A line of ``color`` (b, g, r) around what is opaque, under it; needs alpha.

    The ellipse is a running maximum along the row for each of its half widths, and then,
    down the column, the row of the right width at each distance: two sorts, whatever the thickness.
    """
    dense = densify(pixels)
    reach: dict[int, int] = {}
    for dy, dx in ellipse(thickness):
        reach[dy] = max(reach.get(dy, 0), dx)
    along = Window.partitionBy("clip_id", "frame", "y").orderBy("x")
    rows = dense.select("*", *(F.max("a").over(along.rowsBetween(-w, w)).alias(f"_w{w}") for w in sorted(set(reach.values()))))
    down = Window.partitionBy("clip_id", "frame", "x").orderBy("y")
    at = lambda dy, w: F.col(f"_w{w}") if dy == 0 else F.lag(f"_w{w}", dy).over(down) if dy > 0 else F.lead(f"_w{w}", -dy).over(down)
    d = rows.withColumn("d", F.greatest(F.lit(0), *(at(dy, w) for dy, w in reach.items())))
    fa, ba = F.col("a") / F.lit(255.0), F.col("d") / F.lit(255.0)
    oa = fa + ba * (1 - fa)
    mix = lambda c, v: F.floor(F.least(F.lit(255.0), (F.col(c) * fa + v * ba * (1 - fa)) / (oa + 1e-6))).cast("int").alias(c)
    return d.select(*KEY, *(mix(c, v) for c, v in zip(CHANNELS, color, strict=True)), F.floor(F.least(F.lit(255.0), oa * 255)).cast("int").alias("a"))


def glow(pixels: DataFrame, color: tuple[int, int, int], radius: int = 15, intensity: float = 1.0) -> DataFrame:
    """A blurred alpha of ``color`` under the pixels."""
    dense = densify(pixels)
    halo = gaussian_blur(dense, 2 * radius + 1, columns=("a",)).select(*KEY, *(F.lit(v).alias(f"{c}2") for c, v in zip(CHANNELS, color, strict=True)), F.floor(F.least(F.lit(255.0), F.col("a") * intensity)).cast("int").alias("a2"))
    return dense.join(halo, KEY).select(*KEY, *over_columns())


def foreground_counts(pixels: DataFrame, tol: int = 25) -> DataFrame:
    """(clip_id, frame, fg): pixels off the clip's border colours."""
    m = key_mask(pixels, color_ranges(border_color(pixels), 5, tol))
    return m.groupBy("clip_id", "frame").agg(F.count_if(F.col("m") > 0).alias("fg"))


def clip_sizes(pixels: DataFrame) -> DataFrame:
    return clips_of(pixels)
