"""Layers, distance ramps, fills, brush strokes and corrections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import shared
from ..sources.shared import by_size, cut, frame_numbers, frames_at_once, packed, ranked, unpack, unpacked
from .geometry import resize, resize_grids, upto
from .pixels import CHANNELS, KEY, densify, trunc
from .rigs import footprint_union
from .segment import character_alpha

FAR = 1e9
DEFAULT_RADIUS, MIN_BAND = 12, 3
#: Digits that a fill's means are rounded to, so that the order of their sums doesn't show.
DIGITS = 9
#: Rows of a leaf of a fingerprint, and digests of one above.
CHUNK = 4096


def layer_settings(rigs: DataFrame) -> DataFrame:
    """``rigs`` (rig_id, split, character, background, fade, ...) with defaults and presence flags.

    ``character`` and ``background`` are text: "false" and "null" remove the layer, absence keeps it.
    """
    here = lambda c: F.col("split") & (F.col(c).isNull() | ~F.col(c).isin("false", "null"))
    of = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    split = rigs.withColumn("split", F.coalesce("split", F.lit(False)))
    return split.select("rig_id", "split", here("character").alias("has_character"), here("background").alias("has_background"), (F.col("split") & F.col("fade").isNotNull()).alias("has_patch"), "fade", of("tolerance", 30), of("auto_ranges", True), of("num_ranges", 5), of("adaptive_bg", False), of("edge_cleanup", 0), of("soft_edges", 0))


def patch_blocker(rigs: DataFrame) -> DataFrame:
    """(rig_id, blocker): why a rig (split, n_bones, has_*, frames, fade) can't have a patch, or null."""
    why = F.when(~F.col("split"), "no_split").when(F.col("n_bones") == 0, "no_skeleton").when(~F.col("has_character"), "no_character").when(~F.col("has_background"), "no_background").when(F.coalesce("frames", F.lit(0)) <= 0, "no_timeline").when(F.col("fade").isNull(), "no_fade")
    return rigs.select("rig_id", why.alias("blocker"))


def patch_state(rigs: DataFrame, patch_meta: DataFrame) -> DataFrame:
    """(rig_id, state) of each rig's patch by the recorded ``patch_meta`` (rig_id, built_fade)."""
    d = rigs.join(patch_meta.select("rig_id", "built_fade", F.lit(True).alias("_built")), "rig_id", "left")
    state = (
        F.when(~F.col("split"), "unsplit").when(F.col("n_bones") == 0, "no_skeleton").when(F.col("fade").isNull(), "off").when(~F.col("has_background"), "no_plate").when(~F.col("has_character"), "no_character")
        .when(F.col("_built").isNull(), "pending").when(~F.coalesce(F.col("built_fade") == F.col("fade"), F.lit(False)), "stale").otherwise("ready")
    )
    return d.select("rig_id", state.alias("state"))


def distance_transform(mask: DataFrame) -> DataFrame:
    """(..., d): each pixel's exact distance to the nearest pixel with m = 0 of its frame; needs a full grid.

    Down the columns by windows, then along the rows, many at a time as arrays. A frame
    without zeros has a very large distance.
    """
    frame = [c for c in ("clip_id", "frame") if c in mask.columns]
    at = F.when(F.col("m") == 0, F.col("y"))
    w = Window.partitionBy(*frame, "x").orderBy("y")
    above = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    far = F.lit(FAR)
    g = F.least(F.coalesce((F.col("y") - above).cast("double"), far), F.coalesce((below - F.col("y")).cast("double"), far))
    rows = mask.select(*frame, "y", "x", "m", (g * g).alias("g")).groupBy(*frame, "y").agg(F.array_sort(F.collect_list(F.struct("x", "m", "g"))).alias("v"))
    rows = rows.select(*frame, "y", F.col("v.x").alias("x"), F.col("v.m").alias("m"), F.col("v.g").alias("d"))
    out = rows.mapInArrow(_row_distances, rows.schema).select(*frame, "y", F.explode(F.arrays_zip("x", "m", "d")).alias("p"))
    return out.select(*frame, "y", "p.x", "p.m", "p.d")


def _row_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's squared column distances to distances, a row of pixels a list."""
    for batch in batches:
        k = batch.num_columns - 1
        lists = batch.column(k)
        at = lists.offsets.to_numpy()
        flat, size = lists.values.to_numpy(zero_copy_only=False), np.diff(at)
        out = np.empty(at[-1] - at[0])
        for n in np.unique(size[size > 0]).tolist():
            place = (at[:-1][size == n, None] + np.arange(n)) - at[0]
            out[place] = np.sqrt(nearest_squares(flat[place + at[0]]))
        made = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(out))
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], made], batch.schema.names)


def nearest_squares(g: np.ndarray) -> np.ndarray:
    """min over q of g[:, q] + (p - q)^2 for each row and place p, by growing distance until none can gain."""
    out = g.copy()
    for s in range(1, g.shape[1]):
        if s * s >= out.max():
            break
        out[:, s:] = np.minimum(out[:, s:], g[:, :-s] + s * s)
        out[:, :-s] = np.minimum(out[:, :-s], g[:, s:] + s * s)
    return out


def grid_distances(mask: np.ndarray) -> np.ndarray:
    """``distance_transform`` of whole frames (n, height, width)."""
    g = np.where(mask, FAR, 0.0)
    for k in range(1, g.shape[1]):
        g[:, k] = np.minimum(g[:, k], g[:, k - 1] + 1)
    for k in reversed(range(g.shape[1] - 1)):
        g[:, k] = np.minimum(g[:, k], g[:, k + 1] + 1)
    return np.sqrt(nearest_squares((g * g).reshape(-1, g.shape[2]))).reshape(g.shape)


def feather_ramp(mask: DataFrame, fade: int) -> DataFrame:
    """(..., m): opaque inside the region, falling to 0 at its edge over ``fade`` pixels."""
    keep = [c for c in KEY if c in mask.columns]
    if fade <= 0:
        return mask.select(*keep, F.when(F.col("m") > 0, 255).otherwise(0).alias("m"))
    d = distance_transform(mask)
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("d") - 1) / fade))
    return d.select(*keep, F.when(F.col("m") > 0, F.floor(255 * ramp)).otherwise(0).cast("int").alias("m"))


def region_radius(mask: DataFrame) -> DataFrame:
    """(clip_id, frame, radius): the largest distance from a covered pixel to the edge."""
    frame = [c for c in ("clip_id", "frame") if c in mask.columns]
    return distance_transform(mask).groupBy(*frame).agg(F.coalesce(F.max(F.when(F.col("m") > 0, F.col("d"))), F.lit(0.0)).alias("radius"))


def neighbours(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(8, n) places in the list of each place's eight neighbours, -1 where the list lacks one."""
    wide = int(x.max()) + 3
    number = (y + 1) * wide + x + 1
    order = np.argsort(number, kind="stable")
    sorted_ = number[order]
    out = np.empty((8, len(number)), np.int32)
    for k, step in enumerate(dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx):
        at = np.minimum(np.searchsorted(sorted_, number + step), len(order) - 1)
        out[k] = np.where(sorted_[at] == number + step, order[at], -1)
    return out


def filled(y: np.ndarray, x: np.ndarray, todo: np.ndarray, color: np.ndarray, iters: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the ``todo`` places were filled, the colours (n, 3)): rings of means, then ``iters`` averagings of all filled places."""
    edge = np.flatnonzero(todo)
    near_all = neighbours(y, x)
    part = np.unique(np.concatenate([edge, near_all[:, edge][near_all[:, edge] >= 0]]))  # the region and its rim
    back = np.full(len(y) + 1, -1, np.int32)
    back[part] = np.arange(len(part))
    near = back[near_all[:, part]]
    value, inside = color[part].astype(float), todo[part]
    layer = np.where(inside, -1, 0)

    def means(rows: np.ndarray, use: np.ndarray) -> np.ndarray:
        """The means of ``value`` over those of the rows' neighbours that ``use`` marks; each has one."""
        total, n = np.zeros((len(rows), value.shape[1])), np.zeros(len(rows))
        for k in range(8):
            other = near[k, rows]
            some = (other >= 0) & use[other]
            total[some] += value[other[some]]
            n += some
        return total / n[:, None]

    ring, depth = np.flatnonzero(layer == 0), 0
    while len(ring):
        around = np.unique(near[:, ring])
        around = around[around >= 0]
        new = around[layer[around] < 0]
        if not len(new):
            break
        value[new] = means(new, layer == depth)
        depth += 1
        layer[new] = depth
        ring = new
    got = np.flatnonzero(layer > 0)
    for _ in range(iters if len(got) else 0):
        value[got] = means(got, layer >= 0)
    which, out = np.zeros(len(y), bool), color.astype(float)
    which[part[got]] = True
    out[part[got]] = value[got]
    return which, out


def _with_fill(table: pa.Table, turn: np.ndarray, todo: np.ndarray, iters: int) -> tuple[pa.Table, list[np.ndarray]]:
    """Whole frames of pixels, those of ``todo`` filled and opaque, and their colours b, g, r; ``turn`` numbers the frames."""
    y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    colors = [table.column(c).to_numpy() for c in CHANNELS]
    if not todo.any():
        return table, colors
    # Frames lie below each other with an empty row between, so they have no neighbours in common.
    low = y.min()
    which, value = filled(y - low + turn * (y.max() - low + 2), x, todo, np.column_stack(colors), iters)
    for k, c in enumerate(CHANNELS):
        colors[k] = np.where(which, np.floor(np.minimum(255.0, np.round(value[:, k], DIGITS) + 0.5)), colors[k]).astype(colors[k].dtype)
        table = table.set_column(table.schema.get_field_index(c), c, pa.array(colors[k]))
    alpha = table.column("a").to_numpy()
    return table.set_column(table.schema.get_field_index("a"), "a", pa.array(np.where(which, 255, alpha).astype(alpha.dtype))), colors


def fill_region(plate: DataFrame, region: DataFrame, iters: int = 40) -> DataFrame:
    """The plate (clip_id, frame, y, x, ...) with ``region`` (same key) filled from around it, opaque.

    Pixels next to known ones take their mean, layer by layer; a few rounds of averaging
    smooth them. Only the region changes; a frame without known pixels stays as it is. A frame
    is filled whole in one task, some frames at once, in one pass whatever the region's depth;
    frames too large for that are filled by joins, a ring a round.
    """
    cols = [*KEY, *CHANNELS, "a"]
    kinds = dict(plate.dtypes)
    marked = plate.select(*cols).join(region.select(*KEY).distinct().withColumn("_todo", F.lit(True)).hint("merge"), KEY, "left").withColumn("_todo", F.coalesce("_todo", F.lit(False))).transform(cut)
    whole, large = by_size(marked, ["clip_id", "frame"])

    def run(table: pa.Table) -> pa.Table:
        todo = table.column("_todo").to_numpy(zero_copy_only=False)
        turn, table = frame_numbers(table), table.drop_columns(["_todo"])
        return _with_fill(table, turn, todo, iters)[0]

    out = frames_at_once(whole, run, ", ".join(f"{c} {kinds[c]}" for c in cols))
    if large is not None:
        out = out.unionByName(_fill_by_joins(large.drop("_todo"), large.where("_todo").select(*KEY), iters))
    return out


def _fill_by_joins(plate: DataFrame, region: DataFrame, iters: int) -> DataFrame:
    todo = region.select(*KEY).distinct().join(plate.select(*KEY), KEY, "left_semi").transform(cut)
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))

    def around(src: DataFrame) -> DataFrame:
        """Each row at its eight neighbours' places."""
        rest = [c for c in src.columns if c not in KEY]
        d = src.select("*", F.explode(steps).alias("s"))
        return d.select("clip_id", "frame", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), *rest)

    def means(src: DataFrame) -> DataFrame:
        return around(src).groupBy(*KEY).agg(*(F.avg(c).alias(c) for c in CHANNELS))

    # Only known pixels next to the region matter; of them and then of each ring the next ring takes its means.
    rim = plate.join(around(todo).distinct(), KEY, "left_semi").join(todo, KEY, "left_anti").select(*KEY, *(F.col(c).cast("double").alias(c) for c in CHANNELS)).transform(cut)
    filled, ring, left = None, rim, todo
    while True:
        ring = means(ring).join(left, KEY, "left_semi").transform(cut)
        if ring.limit(1).count() == 0:
            break
        filled = ring if filled is None else filled.unionByName(ring)
        left = left.join(ring, KEY, "left_anti").transform(cut)
    if filled is None:
        return plate
    places = filled.select(*KEY).transform(cut)
    for k in range(iters):
        filled = means(rim.unionByName(filled)).join(places, KEY, "left_semi")
        filled = filled.transform(cut) if k % 5 == 4 else filled
    new = filled.select(*KEY, *(F.floor(F.least(F.lit(255.0), F.round(c, DIGITS) + 0.5)).cast("int").alias(f"_{c}") for c in CHANNELS))
    d = plate.join(new, KEY, "left")
    return d.select(*KEY, *(F.coalesce(f"_{c}", c).alias(c) for c in CHANNELS), F.when(F.col("_b").isNull(), F.col("a")).otherwise(255).alias("a"))


def disc(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def _painted_words(strokes: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    """(*by, y, word, bits): the places of the discs of all points of ``by``, clipped to the canvas, as bits of runs of 64 columns.

    A disc is dealt as rows of the canvas, each as the bits of 64 columns that it paints there, so
    a group's state is one number. Offsets are generated per point, so any radius works.
    """
    r = F.when(F.coalesce("radius", F.lit(0)) > 0, F.greatest(F.lit(1), F.rint("radius").cast("int"))).otherwise(DEFAULT_RADIUS)
    d = strokes.select(*by, F.col("x").alias("cx"), F.col("y").alias("cy"), r.alias("r")).select("*", F.explode(F.expr("sequence(-r, r)")).alias("dy"))
    half = F.floor(F.sqrt(F.expr("r * r - dy * dy"))).cast("int")
    ends = [F.rint(F.col("cx") + k).cast("int").alias(c) for c, k in (("x0", -half), ("x1", half))]
    # Places are rounded half to even, so around a point between two columns only the even ones are painted.
    kept = F.when(F.abs(F.col("cx") % 1) == 0.5, F.lit(0x5555555555555555)).otherwise(F.lit(-1).cast("bigint"))
    d = d.select(*by, F.rint(F.col("cy") + F.col("dy")).cast("int").alias("y"), *ends, kept.alias("kept")).where(f"y >= 0 and y < {height} and x1 >= 0 and x0 < {width}")
    d = d.withColumns({"x0": F.greatest(F.lit(0), "x0"), "x1": F.least(F.lit(width - 1), "x1")}).select("*", F.explode(F.expr("sequence(x0 div 64, x1 div 64)")).alias("word"))
    low, high = F.expr("cast(greatest(0, x0 - word * 64) as int)"), F.expr("cast(least(63, x1 - word * 64) as int)")
    d = d.withColumns({"low": low, "high": high}).withColumn("bits", F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (high - low)), low) & kept"))
    return d.groupBy(*by, "y", "word").agg(F.bit_or("bits").alias("bits"))


def _word_places(words: DataFrame, by: list[str]) -> DataFrame:
    """(*by, y, x): a row for each place of ``_painted_words``."""
    xs = F.expr("transform(filter(sequence(0, 63), k -> (shiftrightunsigned(bits, k) & 1) = 1), k -> cast(word * 64 + k as int))")
    return words.select(*by, "y", F.explode(xs).alias("x"))


def _painted(strokes: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    """(*by, y, x): the distinct places of the discs of all points of ``by``, clipped to the canvas."""
    return _word_places(_painted_words(strokes, width, height, by), by)


def stroke_pixels(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """(plate_id, stroke, y, x): the discs of each stroke's points, clipped to the canvas; a radius of at most 0 is 12."""
    return _painted(strokes, width, height, ["plate_id", "stroke"])


def stroke_mask(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """(plate_id, y, x): what any stroke of a plate paints."""
    return _painted(strokes, width, height, ["plate_id"])


def correction_band(strokes: DataFrame, fade: int, width: int, height: int) -> DataFrame:
    """(plate_id, band): the feather, narrowed to what the narrowest stroke can carry, at least 1.

    Each stroke is measured on the box around what it painted: the canvas beyond counts as painted not.
    Strokes of the same points have the same radius, so each list of points is measured once.
    """
    drawn = strokes.groupBy("plate_id", "stroke").agg(F.array_sort(F.collect_set(F.struct("x", "y", "radius"))).alias("_shape"))
    shapes = drawn.select("_shape").distinct().withColumn("_id", F.monotonically_increasing_id()).transform(cut)
    p = stroke_pixels(shapes.select(F.lit(0).alias("plate_id"), F.col("_id").alias("stroke"), F.inline("_shape")), width, height)
    box = p.groupBy("plate_id", "stroke").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    grid = box.select("plate_id", "stroke", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).select("plate_id", "stroke", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    # The box and what is painted meet in one aggregation: neither is a side of a join, which the planner would take for a row a stroke.
    both = grid.withColumn("m", F.lit(0)).unionByName(p.withColumn("m", F.lit(255)))
    m = both.groupBy(F.col("plate_id").alias("clip_id"), F.col("stroke").alias("frame"), "y", "x").agg(F.max("m").alias("m"))
    radii = shapes.join(region_radius(m).select(F.col("frame").alias("_id"), F.col("radius").alias("_r")), "_id").drop("_id")
    r = drawn.join(radii, "_shape").groupBy("plate_id").agg(F.min("_r").alias("radius"))
    limit = F.greatest(F.lit(1), F.floor(F.least(F.col("radius"), F.lit(1e6))).cast("int") - 1)
    return r.select("plate_id", F.greatest(F.lit(1), F.least(F.lit(fade if fade > 0 else MIN_BAND), limit)).alias("band"))


#: What a correction needs; bounds and the canvas are never guessed.
NEEDED = ("id", "rig_id", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "canvas_width", "canvas_height")


def _fault() -> Column:
    """Why a correction can't be read, or null."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDED)))
    size = F.when((F.col("canvas_width") <= 0) | (F.col("canvas_height") <= 0), "the canvas has no size").when((F.col("bbox_width") < 0) | (F.col("bbox_height") < 0), "the box has a negative size")
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise(size)


def correction_errors(corrections: DataFrame) -> DataFrame:
    """(id, rig_id, reason) of the corrections that can't be read, whatever their canvas."""
    return corrections.select("id", "rig_id", _fault().alias("reason")).where("reason is not null")


def load_corrections(corrections: DataFrame, width: int, height: int, strict: bool = True) -> DataFrame:
    """(id, rig_id, x0, y0, x1, y1, band): the corrections of this canvas, clipped to it; empty ones go.

    One that can't be read fails the job, or, if not ``strict``, is left to ``correction_errors``.
    """
    fault = _fault()
    if strict:
        bad = F.raise_error(F.concat(F.lit("correction "), F.coalesce(F.col("id").cast("string"), F.lit("without id")), F.lit(": "), fault)).cast("boolean")
        d = corrections.where(F.when(fault.isNotNull(), bad).otherwise((F.col("canvas_width") == width) & (F.col("canvas_height") == height)))
    else:
        d = corrections.where(fault.isNull() & (F.col("canvas_width") == width) & (F.col("canvas_height") == height))
    d = d.select("id", "rig_id", F.greatest(F.lit(0), "bbox_x").alias("x0"), F.greatest(F.lit(0), "bbox_y").alias("y0"), F.least(F.lit(width), F.col("bbox_x") + F.col("bbox_width")).alias("x1"), F.least(F.lit(height), F.col("bbox_y") + F.col("bbox_height")).alias("y1"), F.greatest(F.lit(1), F.coalesce("fade", F.lit(0))).alias("band"))
    return d.where("x1 > x0 and y1 > y0")


def correction_pixels(loaded: DataFrame) -> DataFrame:
    """(rig_id, id, y, x, al): the ramps of corrections that paint their whole box, by the distance to its edge."""
    d = loaded.select("*", F.explode(F.expr("sequence(y0, y1 - 1)")).alias("y")).select("*", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))
    edge = F.least(F.col("x") - F.col("x0") + 1, F.col("x1") - F.col("x"), F.col("y") - F.col("y0") + 1, F.col("y1") - F.col("y"))
    ramp = F.floor(255 * F.least(F.lit(1.0), (edge - 1) / F.col("band"))).cast("int")
    return d.select("rig_id", "id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), ramp.alias("al"))


def apply_corrections(ground: DataFrame, painted: DataFrame) -> DataFrame:
    """The ground (rig_id, y, x, b, g, r) under its corrections' pixels (rig_id, id, y, x, al, b, g, r), in order of id.

    Each lerp is truncated; pixels without a correction join nothing.
    """
    stack = painted.groupBy("rig_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("id", "al", *CHANNELS))).alias("_s"))
    d = ground.join(stack.hint("merge"), ["rig_id", "y", "x"], "left")
    fold = lambda c: F.coalesce(F.aggregate("_s", F.col(c).cast("int"), lambda acc, s: F.floor(acc * (1 - s["al"] / F.lit(255.0)) + s[c] * (s["al"] / F.lit(255.0))).cast("int")), F.col(c))
    return d.select("rig_id", "y", "x", *(fold(c).alias(c) for c in CHANNELS))


def background_plate(still: DataFrame, mask: DataFrame, iters: int = 40) -> DataFrame:
    """The still without its character: masked pixels filled from around them."""
    return fill_region(still, mask.where("m > 0"), iters)


def _fitted(mask: DataFrame, width: int, height: int) -> DataFrame:
    """A mask (clip_id, frame, y, x, m) scaled to another size."""
    shown = mask.select(*KEY, *(F.col("m").alias(c) for c in (*CHANNELS, "a")))
    return resize(shown, width, height).select(*KEY, F.col("b").alias("m"))


def heal(plate: DataFrame, strokes: DataFrame, fade: int, width: int, height: int, iters: int = 20, plate_size: tuple[int, int] | None = None) -> DataFrame:
    """The opaque plate (clip_id = plate_id, frame, ...) with painted areas filled and blended over their bands.

    Strokes are in pixels of the canvas (``width``, ``height``); ``plate_size``: the plates' own
    width and height, if other. A plate without a painted point fails the job.
    """
    return heal_parts(plate, strokes, fade, width, height, iters, plate_size)["plate"]


def heal_parts(plate: DataFrame, strokes: DataFrame, fade: int, width: int, height: int, iters: int = 20, plate_size: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """What ``heal`` makes of each plate: the healed ``plate``, and, in canvas pixels, the painted ``mask``,
    the filled ``content``, the ``replaced`` pixels, and (``bbox``) the painted box with its ``band``."""
    own = plate_size or (width, height)
    packs, schema = packed(plate).transform(cut), plate.schema
    plate = unpacked(packs, schema)
    words = _painted_words(strokes, width, height, ["plate_id"]).withColumnRenamed("plate_id", "clip_id").where("bits <> 0").transform(cut)
    painted = _word_places(words, ["clip_id"])
    counts = packs.groupBy("clip_id", "frame").agg(F.sum("n").alias("_n"))
    frames = counts.join(words.select("clip_id", F.lit(True).alias("_some")).distinct(), "clip_id", "left")
    bad = F.raise_error(F.concat(F.lit("no painted point on plate "), F.col("clip_id").cast("string"))).cast("boolean")
    frames = frames.where(F.coalesce("_some", bad)).drop("_some").transform(cut)
    grid = frames.select("clip_id", "frame", upto(F.lit(height)).alias("y")).select("*", upto(F.lit(width)).alias("x"))
    mask = grid.join(painted.withColumn("m", F.lit(255)).hint("merge"), ["clip_id", "y", "x"], "left").na.fill(0, ["m"]).select(*KEY, "m")
    band = correction_band(strokes, fade, width, height).withColumnRenamed("plate_id", "clip_id")
    shown = lambda p: p if own == (width, height) else resize(p, width, height)
    lit = painted.groupBy("clip_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    parts = {"mask": mask, "replaced": shown(plate), "bbox": lit.join(band, "clip_id")}
    sizes = packs.groupBy("clip_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), (F.max("frame") + 1).alias("_frames"))
    large = frames.where(F.col("_n") > shared.WHOLE).limit(1).count() > 0 or max(width * height, own[0] * own[1]) > shared.WHOLE
    if not large and own != (width, height):
        large = sizes.where(F.col("width").cast("bigint") * F.col("height") > shared.WHOLE).limit(1).count() > 0
    if not large:
        at = frames.select("clip_id", "frame").hint("merge")
        given = [(packs, 0), (words.join(at, "clip_id"), 1)]
        # A resized clip has a frame for each number up to its last.
        shown_at = sizes.where("width > 0 and height > 0").select("clip_id", "width", "height", upto(F.col("_frames")).alias("frame"))
        content = given if own == (width, height) else [*given, (shown_at, 3)]
        return parts | {"plate": _healed([*given, (band.join(at, "clip_id"), 2)], schema, width, height, own, iters, False), "content": _healed(content, schema, width, height, own, iters, True)}
    d = distance_transform(mask).join(band, "clip_id", "left")
    ramp = d.select(*KEY, F.when(F.col("m") > 0, F.floor(255 * F.least(F.lit(1.0), (F.col("d") - 1) / F.coalesce("band", F.lit(1))))).otherwise(0).cast("int").alias("m"))
    fit = lambda m: m if own == (width, height) else _fitted(m, *own)
    filled = fill_region(plate, fit(mask).where("m > 127").select(*KEY), iters).transform(cut)
    both = plate.join(fit(ramp).hint("merge"), KEY).join(filled.select(*KEY, *(F.col(c).alias(f"{c}2") for c in CHANNELS)).hint("merge"), KEY).withColumn("w", F.col("m") / 255.0)
    healed = both.select(*KEY, *(trunc(F.col(c) * (1 - F.col("w")) + F.col(f"{c}2") * F.col("w")).alias(c) for c in CHANNELS), F.lit(255).alias("a"))
    return parts | {"plate": healed, "content": shown(filled.select(*KEY, *CHANNELS, F.lit(255).alias("a")))}


def _healed(given: list[tuple[DataFrame, int]], plate: StructType, width: int, height: int, own: tuple[int, int], iters: int, content: bool) -> DataFrame:
    """(*KEY, b, g, r, a): the healed pixels of the plates that ``own`` has, or, as ``content``, the filled ones at the canvas's size.

    ``given``, tables of (clip_id, frame) by their kind: 0 the plates' packed pixels, of the schema ``plate``; 1 painted
    words; 2 the band, for healed pixels; 3 the height and width that a frame is resized from, for content of another size.
    A frame's rows meet in one task, where the mask is made and fitted, its distances are taken, and the region
    is filled and blended: no grid is a table, and pixels travel packed.
    """
    kinds, most = dict((f.name, f.dataType.simpleString()) for f in plate), shared.AT_ONCE
    pixels, same = [*KEY, *CHANNELS, "a"], own == (width, height)
    fields = {"y": "int", "word": "bigint", "bits": "bigint", "band": "int", "n": "int", "height": "int", "width": "int", "size": "int", "data": "binary"}

    def one(df: DataFrame, kind: int) -> DataFrame:
        has = {**{c: kinds[c] for c in ("clip_id", "frame")}, **fields}
        return df.select(F.lit(kind).alias("kind"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in has.items()))

    rows = reduce(DataFrame.unionByName, (one(df, kind) for df, kind in given))
    fit = lambda v: v if same else resize_grids(v, *own)

    def some(table: pa.Table, turn: np.ndarray) -> pa.Table:
        kind, n = table.column("kind").to_numpy(), turn[-1] + 1
        of = lambda k, *names: (turn[kind == k], *(table.column(c).filter(pa.array(kind == k)).to_numpy() for c in names))
        mask = np.zeros((n, height, width), bool)
        t, y, word, bits = of(1, "y", "word", "bits")
        row, bit = np.nonzero(bits[:, None] >> np.arange(64) & 1)
        mask[t[row], y[row], word[row] * 64 + bit] = True
        t, each = of(0, "n")
        shown, turn_ = unpack(table.filter(pa.array(kind == 0)), plate).select(pixels), np.repeat(t, each)
        y, x = (shown.column(c).to_numpy() for c in ("y", "x"))
        inside = (y >= 0) & (y < own[1]) & (x >= 0) & (x < own[0])
        place = turn_[inside], y[inside], x[inside]
        todo = np.zeros(len(y), bool)
        todo[inside] = (mask if same else fit(np.where(mask, 255.0, 0.0)) > 127)[place]
        new = _with_fill(shown, turn_, todo, iters)[1]
        if content and not same:
            return resized(table, turn, turn_, y, x, new, *of(3, "height", "width"))
        if content:
            return pa.table([*shown.select(KEY).columns, *map(pa.array, new), pa.array(np.full(len(y), 255, np.int32))], names=pixels)
        bands = np.ones(n)
        t, b = of(2, "band")
        bands[t] = b
        ramp = np.where(mask, np.floor(255 * np.minimum(1.0, (grid_distances(mask) - 1) / bands[:, None, None])), 0.0)
        w = fit(ramp)[place] / 255.0
        made = [np.floor(np.clip(shown.column(c).to_numpy()[inside] * (1 - w) + v[inside] * w, 0, 255)) for c, v in zip(CHANNELS, new, strict=True)]
        return pa.table([*shown.select(KEY).filter(pa.array(inside)).columns, *(pa.array(v.astype(np.int32)) for v in (*made, np.full(len(w), 255)))], names=pixels)

    def resized(table: pa.Table, turn: np.ndarray, at: np.ndarray, y: np.ndarray, x: np.ndarray, new: list[np.ndarray], of: np.ndarray, tall: np.ndarray, wide: np.ndarray) -> pa.Table:
        """The frames ``of``, each from its own height and width, at the canvas's size; pixels that a frame lacks are 0."""
        ids, out = table.select(["clip_id", "frame"]).take(np.searchsorted(turn, np.arange(turn[-1] + 1))), []
        for h, w in np.unique(np.stack([tall, wide], 1), axis=0).tolist():
            these = of[(tall == h) & (wide == w)]
            number = np.full(turn[-1] + 1, -1)
            number[these] = np.arange(len(these))
            some = (number[at] >= 0) & (y >= 0) & (x >= 0)
            values = []
            for v in (*new, np.full(len(y), 255)):
                grid = np.zeros((len(these), h, w))
                grid[number[at[some]], y[some], x[some]] = v[some]
                values.append(pa.array(resize_grids(grid, width, height).astype(np.int32).ravel()))
            py, px = (np.tile(v.ravel().astype(np.int32), len(these)) for v in np.mgrid[:height, :width])
            own_ids = ids.take(np.repeat(these, height * width))
            out.append(pa.table([*own_ids.columns, pa.array(py), pa.array(px), *values], names=pixels))
        return pa.concat_tables(out) if out else pa.table([*ids.slice(0, 0).columns, *[pa.array([], pa.int32())] * 6], names=pixels)

    def run(table: pa.Table) -> pa.Table:
        turn, out = frame_numbers(table), []
        of = lambda c: pc.fill_null(table.column(c), 0).to_numpy().astype(np.int64)
        kind = table.column("kind").to_numpy()
        # What a frame costs: its pixels, the canvas, the plate, or the grid that is resized.
        cost = np.maximum(np.bincount(turn, of("n")), max(width * height, own[0] * own[1]))
        np.maximum.at(cost, turn[kind == 3], (of("height") * of("width"))[kind == 3])
        step = ((np.cumsum(cost) - 1) // most)[turn]
        starts = np.unique(step, return_index=True)[1].tolist()
        for a, b in zip(starts, [*starts[1:], len(turn)], strict=True):
            out.append(some(table.slice(a, b - a), turn[a:b] - turn[a]))
        return pa.concat_tables(out)

    whole = content and same
    schema = ", ".join([*(f"{c} {kinds[c] if whole or c not in CHANNELS else 'int'}" for c in (*KEY, *CHANNELS)), "a int"])
    return frames_at_once(rows, run, schema, "n")


def build_patch(still: DataFrame, rigs: DataFrame, bones: DataFrame, keyframes: DataFrame, frames: DataFrame, plate: DataFrame, fade: int, iters: int = 20, corrections: DataFrame | None = None) -> DataFrame:
    """The patch (clip_id, frame 0, ...): the ground under what the character vacates, corrected, then feathered.

    ``corrections``: painted pixels (rig_id = clip_id, id, y, x, al, b, g, r), applied over the ground in order of id.
    """
    plate = plate.transform(cut)
    swept = footprint_union(still, rigs, bones, keyframes, frames).withColumn("frame", F.lit(0)).transform(cut)
    ground = fill_region(plate, swept.select(*KEY), iters)
    if corrections is not None:
        ground = apply_corrections(ground.select(F.col("clip_id").alias("rig_id"), "y", "x", *CHANNELS), corrections).select(F.col("rig_id").alias("clip_id"), F.lit(0).alias("frame"), "y", "x", *CHANNELS)
    grid = plate.select(*KEY).join(swept.select(*KEY, F.lit(255).alias("m")).hint("merge"), KEY, "left").na.fill(0, ["m"])
    return ground.select(*KEY, *CHANNELS).join(feather_ramp(grid, fade).withColumnRenamed("m", "a").hint("merge"), KEY)


def content_fingerprint(rows: DataFrame, by: list[str], order: list[str], fields: list[str], chunk: int = CHUNK) -> DataFrame:
    """(*by, fingerprint): SHA-1 over the ordered rows' fields; no rows, no fingerprint.

    A leaf is the digest of ``chunk`` consecutive rows; a group of more is the digest of its
    leaves' digests in order, and so on up to one. Rows are numbered across partitions, so no
    task or row holds a whole group, and the result depends on the rows and ``chunk`` alone.
    """
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in fields))
    nodes = ranked(rows.select(*by, *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), line.alias("_l")), by, [*(f"_o{k}" for k in range(len(order))), "_l"])
    out = None
    while True:
        own = F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_p"), "_l"))), lambda s: s["_l"])
        nodes = nodes.groupBy(*by, F.floor(F.col("pos") / chunk).alias("pos")).agg(F.sha1(F.concat_ws(";", own)).alias("_l")).transform(cut)
        more = nodes.where("pos > 0").select(*by).distinct()
        done = nodes.join(more, by, "left_anti").select(*by, F.col("_l").alias("fingerprint"))
        out = done if out is None else out.unionByName(done)
        nodes = nodes.join(more, by, "left_semi")
        if more.limit(1).count() == 0:
            return out


def stale_artifacts(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """Rigs whose ``wanted`` fingerprint (rig_id, fingerprint) is not the ``built`` one."""
    return wanted.join(built.select("rig_id", "fingerprint"), ["rig_id", "fingerprint"], "left_anti")


def _wanted(df: DataFrame, settings: DataFrame | None, flag: str) -> DataFrame:
    """The clips that ``settings`` (rig_id, split, ``flag``, ...) split and don't remove the layer of; all without settings."""
    if settings is None:
        return df
    return df.join(settings.where(F.col("split") & F.col(flag)).select(F.col("rig_id").alias("clip_id")), "clip_id", "left_semi")


def resolve_layers(stored: DataFrame, still: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Stored character masks (clip_id, frame, y, x, m) as they are, and computed ones for the other clips.

    With ``settings`` (as ``layer_settings`` gives them), clips that aren't split, or whose
    character is removed, have none.
    """
    rest = still.join(stored.select("clip_id").distinct(), "clip_id", "left_anti")
    return _wanted(stored.select(*KEY, "m"), settings, "has_character").unionByName(character_alpha(_wanted(rest, settings, "has_character")).select(*KEY, "m"))


def resolve_plates(stored: DataFrame, still: DataFrame, masks: DataFrame, settings: DataFrame | None = None, iters: int = 40) -> DataFrame:
    """Stored background plates (clip_id, frame, y, x, b, g, r, a) as they are; for other clips the still, filled where its mask is.

    A clip without either has none, nor one that isn't split or whose background is removed.
    """
    rest = still.join(stored.select("clip_id").distinct(), "clip_id", "left_anti").join(masks.select("clip_id").distinct(), "clip_id", "left_semi")
    made = background_plate(_wanted(rest, settings, "has_background").withColumn("a", F.lit(255)), masks, iters)
    cols = [*KEY, *CHANNELS, "a"]
    return _wanted(stored.select(*cols), settings, "has_background").unionByName(made.select(*cols))


def dense_mask(pixels: DataFrame) -> DataFrame:
    return densify(pixels).select(*KEY, F.when(F.col("a") > 127, 255).otherwise(0).alias("m"))
