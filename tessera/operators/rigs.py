"""Rigs: validation, hierarchy, poses, skinning. Many rigs at once, keyed by rig_id.

``bones`` is (rig_id, bone_id, ord, parent_id, hx, hy, tx, ty, radius, falloff), ``keyframes``
(rig_id, frame, bone_id, rot, tx, ty). Matrices are six columns a b c / d e f of a 2x3 matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import by_size, cut
from .geometry import remap, upto
from .pixels import CHANNELS, KEY, composite_over, over_columns

M = ["a", "b", "c", "d", "e", "f"]
FALLOFFS = ("smooth", "linear", "hard")
POSE = ["rot", "tx", "ty"]
#: Sides in pixels of the cells that bones are narrowed to, the last one of those that points meet them in.
CELLS = (2048, 256, 32, 4)
#: Digits that an estimated place is rounded to.
DIGITS = 6
#: Frames that a task takes of a rig.
TOGETHER = 16
#: Weights by frames that a task holds at once.
AT_ONCE = 1 << 18


def bone_closure(bones: DataFrame) -> DataFrame:
    """(rig_id, bone_id, ancestor_id, depth): each bone with each of its ancestors, parents at 1.

    Each round joins the farthest ancestors so far with all of theirs, so depths double, and
    is cut by a checkpoint; rounds end when one finds no new pair. A cycle shows as a bone
    that is its own ancestor.
    """
    known = bones.select("rig_id", F.col("bone_id").alias("ancestor_id")).distinct()
    step = bones.where("parent_id is not null").select("rig_id", "bone_id", F.col("parent_id").alias("ancestor_id"))
    out = step.join(known, ["rig_id", "ancestor_id"], "left_semi").select("rig_id", "bone_id", "ancestor_id", F.lit(1).alias("depth")).distinct().transform(cut)
    reach = 1
    while True:
        up = out.select("rig_id", F.col("bone_id").alias("ancestor_id"), F.col("ancestor_id").alias("_up"), F.col("depth").alias("_more"))
        far = out.where(F.col("depth") == reach).join(up, ["rig_id", "ancestor_id"])
        new = far.groupBy("rig_id", "bone_id", F.col("_up").alias("ancestor_id")).agg((F.min("_more") + reach).alias("depth"))
        new = new.join(out, ["rig_id", "bone_id", "ancestor_id"], "left_anti").transform(cut)
        if new.limit(1).count() == 0:
            return out
        out, reach = out.unionByName(new).transform(cut), 2 * reach


def cyclic_bones(bones: DataFrame) -> DataFrame:
    return bone_closure(bones).where("bone_id = ancestor_id").select("rig_id", "bone_id").distinct()


def audit_rigs(rigs: DataFrame, bones: DataFrame, keyframes: DataFrame, schema: str | None = None) -> DataFrame:
    """(rig_id, ordinal, rule, n): the first rule that each faulty rig breaks, and how often it breaks that rule.

    First is as a reader of the document meets it: the document, its canvas, bone by bone,
    parents, cycles, keyframe by keyframe, then binding, duration and layers. ``rigs`` is
    (rig_id, schema_version, width, height, ...); ``schema`` (compared with the argument),
    power, radius_scale, frames, fps, character, background, fade and color count where
    the table has them, and there a null is an absent field, which is no fault.
    """
    found: list[DataFrame] = []
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))

    def rule(phase: int, ordinal: int, name: str, faults: DataFrame, at: Column | None = None) -> None:
        place = F.lit(0) if at is None else at.cast("int")
        found.append(faults.groupBy("rig_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).select("rig_id", F.lit(phase).alias("phase"), "at", F.lit(ordinal).alias("ordinal"), F.lit(name).alias("rule"), "n"))

    def field(phase: int, ordinal: int, name: str, wrong: Column) -> None:
        if name in rigs.columns:
            rule(phase, ordinal, name, rigs.where(F.col(name).isNotNull() & wrong))

    if schema is not None and "schema" in rigs.columns:
        rule(1, 1, "schema", rigs.where(~F.col("schema").eqNullSafe(schema)))
    rule(2, 2, "version", rigs.where("schema_version is null or schema_version <> 1"))
    rule(3, 3, "canvas", rigs.where("width is null or height is null or width <= 0 or height <= 0"))
    rule(4, 4, "no_bones", rigs.join(bones, "rig_id", "left_anti"))
    ord_ = F.col("ord")
    rule(5, 5, "bone_id", bones.where("bone_id is null or bone_id = ''"), ord_)
    twice = bones.groupBy("rig_id", "bone_id").agg(F.slice(F.array_sort(F.collect_list("ord")), 2, 2**30).alias("o")).select("rig_id", F.explode("o").alias("ord"))
    rule(5, 6, "duplicate_bone", twice, ord_)
    rule(5, 7, "rest", bones.where(~(number("hx") & number("hy") & number("tx") & number("ty"))), ord_)
    rule(5, 8, "radius", bones.where(F.col("radius").isNotNull() & (~number("radius") | (F.col("radius") <= 0))), ord_)
    rule(5, 9, "falloff", bones.where(~F.col("falloff").isin(*FALLOFFS)), ord_)
    known = bones.select("rig_id", F.col("bone_id").alias("parent_id")).distinct()
    rule(6, 10, "unknown_parent", bones.where("parent_id is not null").join(known, ["rig_id", "parent_id"], "left_anti"), ord_)
    rule(7, 11, "cycle", cyclic_bones(bones))
    frame = F.coalesce("frame", F.lit(-1))
    rule(8, 12, "keyframe_frame", keyframes.where("frame is null or frame < 0"), frame)
    rule(8, 13, "keyframe_bone", keyframes.join(bones.select("rig_id", "bone_id"), ["rig_id", "bone_id"], "left_anti"), frame)
    rule(8, 14, "pose", keyframes.where(F.isnan("rot") | F.isnan("tx") | F.isnan("ty")), frame)
    field(9, 15, "power", ~number("power") | (F.col("power") < 0))
    field(10, 16, "radius_scale", ~number("radius_scale") | (F.col("radius_scale") <= 0))
    field(11, 17, "frames", F.col("frames") <= 0)
    field(12, 18, "fps", ~number("fps") | (F.col("fps") <= 0))
    field(13, 19, "character", F.col("character") == "")
    field(14, 20, "background", F.col("background") == "")
    field(15, 21, "fade", F.col("fade") < 0)
    field(16, 22, "color", (F.size("color") != 3) | F.exists("color", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out.groupBy("rig_id").agg(F.min(F.struct("phase", "at", "ordinal", "rule", "n")).alias("m")).select("rig_id", "m.ordinal", "m.rule", "m.n")


def delete_bone(bones: DataFrame, keyframes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bones and keyframes without ``gone`` (rig_id, bone_id); children go to the removed bone's parent."""
    dead = bones.join(gone, ["rig_id", "bone_id"], "left_semi").select("rig_id", F.col("bone_id").alias("parent_id"), F.col("parent_id").alias("_up"), F.lit(True).alias("_dead"))
    left = bones.join(gone, ["rig_id", "bone_id"], "left_anti").join(dead, ["rig_id", "parent_id"], "left")
    left = left.withColumn("parent_id", F.when(F.col("_dead"), F.col("_up")).otherwise(F.col("parent_id"))).select(*bones.columns)
    return left, keyframes.join(gone, ["rig_id", "bone_id"], "left_anti")


def record_keyframes(keyframes: DataFrame, updates: DataFrame, bones: DataFrame) -> DataFrame:
    """Poses with ``updates`` (rig_id, frame, bone_id, rot, tx, ty) in place of old ones; unknown bones are dropped."""
    cols = ["rig_id", "frame", "bone_id", *POSE]
    both = keyframes.select(*cols, F.lit(0).alias("_k")).unionByName(updates.select(*cols, F.lit(1).alias("_k")).join(bones.select("rig_id", "bone_id"), ["rig_id", "bone_id"], "left_semi"))
    last = both.groupBy("rig_id", "frame", "bone_id").agg(F.max_by(F.struct(*POSE), "_k").alias("p"))
    return last.select("rig_id", "frame", "bone_id", *(F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(c) for c in POSE))


def delete_keyframes(keyframes: DataFrame, gone: DataFrame) -> DataFrame:
    """Keyframes without those of ``gone``: (rig_id, frame) whole ones, (rig_id, frame, bone_id) single poses."""
    return keyframes.join(gone, [c for c in ("rig_id", "frame", "bone_id") if c in gone.columns], "left_anti")


def auto_radius(rigs: DataFrame) -> DataFrame:
    return rigs.select("rig_id", F.round(F.greatest(F.lit(16.0), F.greatest("width", "height") / 5.0), 3).alias("radius"))


def interpolate_poses(keyframes: DataFrame, bones: DataFrame, frames: DataFrame) -> DataFrame:
    """(rig_id, frame, bone_id, rot, tx, ty) for every bone at ``frames`` (rig_id, frame).

    Before the first and after the last keyframe its poses hold. A bone that a surrounding
    keyframe lacks is at rest there; rigs without keyframes are at rest.
    """
    keys = keyframes.select("rig_id", "frame").distinct()
    w = Window.partitionBy("rig_id").orderBy("frame")
    spans = keys.select("rig_id", F.col("frame").alias("lo"), F.coalesce(F.lead("frame").over(w), "frame").alias("hi"), F.row_number().over(w).alias("_k"))
    ends = keys.groupBy("rig_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    at = frames.join(ends.hint("merge"), "rig_id", "left").withColumn("_at", F.greatest("first", F.least("last", "frame")))
    # One row a frame within a span, so the match is by equality.
    spread = spans.select("rig_id", "lo", "hi", F.explode(F.sequence("lo", F.greatest(F.col("lo"), F.col("hi") - 1))).alias("_at"))
    at = at.join(spread.hint("merge"), ["rig_id", "_at"], "left").withColumn("u", F.when(F.col("hi") > F.col("lo"), (F.col("_at") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    d = at.join(bones.select("rig_id", "bone_id").hint("merge"), "rig_id")
    for side in ("lo", "hi"):
        k = keyframes.select("rig_id", F.col("frame").alias(side), "bone_id", *(F.col(c).alias(f"{c}_{side}") for c in POSE))
        d = d.join(k.hint("merge"), ["rig_id", side, "bone_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.select("rig_id", "frame", "bone_id", *((zero(f"{c}_lo") + (zero(f"{c}_hi") - zero(f"{c}_lo")) * F.coalesce("u", F.lit(0.0))).alias(c) for c in POSE))


def bone_local(bones: DataFrame, poses: DataFrame) -> DataFrame:
    """(rig_id, frame, bone_id, a..f): rotation about the bone's head, then translation."""
    d = poses.withColumnsRenamed({"tx": "ptx", "ty": "pty"}).join(bones.select("rig_id", "bone_id", "hx", "hy").hint("merge"), ["rig_id", "bone_id"])
    c, s = F.cos("rot"), F.sin("rot")
    return d.select("rig_id", "frame", "bone_id", c.alias("a"), (-s).alias("b"), (F.col("hx") - c * F.col("hx") + s * F.col("hy") + F.col("ptx")).alias("c"), s.alias("d"), c.alias("e"), (F.col("hy") - s * F.col("hx") - c * F.col("hy") + F.col("pty")).alias("f"))


def _product(p: str, q: str) -> list[Column]:
    """The matrix product of columns with the suffixes ``p`` and ``q``."""
    x, y = (lambda k: F.col(f"{k}{p}")), (lambda k: F.col(f"{k}{q}"))
    return [
        (x("a") * y("a") + x("b") * y("d")).alias("a"), (x("a") * y("b") + x("b") * y("e")).alias("b"), (x("a") * y("c") + x("b") * y("f") + x("c")).alias("c"),
        (x("d") * y("a") + x("e") * y("d")).alias("d"), (x("d") * y("b") + x("e") * y("e")).alias("e"), (x("d") * y("c") + x("e") * y("f") + x("f")).alias("f"),
    ]


def bone_world(bones: DataFrame, poses: DataFrame) -> DataFrame:
    """(rig_id, frame, bone_id, a..f): the product of each bone's transform and its ancestors'.

    A bone holds the product from below its pointer, first its parent, down to itself; a round
    puts the pointer's own product before it and takes the pointer's pointer, so a chain of n
    bones takes log2(n) joins. Bones on a cycle, and below one, have no root and no transform.
    """
    known = bones.select("rig_id", F.col("bone_id").alias("up"), F.lit(True).alias("_known"))
    tree = bones.select("rig_id", "bone_id", F.col("parent_id").alias("up")).join(known.hint("merge"), ["rig_id", "up"], "left")
    tree = tree.select("rig_id", "bone_id", F.when(F.col("_known"), F.col("up")).alias("up")).transform(cut)
    out = bone_local(bones, poses).join(tree.hint("merge"), ["rig_id", "bone_id"]).transform(cut)
    left = tree.where("up is not null").count()
    while left:
        above = out.select("rig_id", "frame", F.col("bone_id").alias("up"), F.col("up").alias("_up"), *(F.col(k).alias(f"{k}1") for k in M))
        mine = out.withColumnsRenamed({k: f"{k}2" for k in M}).join(above.hint("merge"), ["rig_id", "frame", "up"], "left")
        out = mine.select("rig_id", "frame", "bone_id", F.col("_up").alias("up"), *(F.when(F.col("up").isNull(), F.col(f"{k}2")).otherwise(c).alias(k) for k, c in zip(M, _product("1", "2"), strict=True))).transform(cut)
        over = tree.select("rig_id", F.col("bone_id").alias("up"), F.col("up").alias("_up"))
        tree = tree.join(over.hint("merge"), ["rig_id", "up"], "left").select("rig_id", "bone_id", F.col("_up").alias("up")).transform(cut)
        # As long as a bone without a cycle above it is left, some of them end in each round.
        before, left = left, tree.where("up is not null").count()
        if left == before:
            break
    return out.where("up is null").select("rig_id", "frame", "bone_id", *M)


def skin_matrices(world: DataFrame, bind: DataFrame | None = None) -> DataFrame:
    """World times the inverse of ``bind`` (rig_id, bone_id, a..f); the rest pose binds as identity."""
    if bind is None:
        return world
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    inv = bind.select("rig_id", "bone_id", (F.col("e") / det).alias("a2"), (-F.col("b") / det).alias("b2"), ((F.col("b") * F.col("f") - F.col("c") * F.col("e")) / det).alias("c2"), (-F.col("d") / det).alias("d2"), (F.col("a") / det).alias("e2"), ((F.col("c") * F.col("d") - F.col("a") * F.col("f")) / det).alias("f2"))
    w = world.select("rig_id", "frame", "bone_id", *(F.col(k).alias(f"{k}1") for k in M))
    return w.join(inv, ["rig_id", "bone_id"]).select("rig_id", "frame", "bone_id", *_product("1", "2"))


def segment_distance(x: Column, y: Column, o: Column | None = None) -> Column:
    """Distance of a point from the segment (hx, hy)-(tx, ty) of the bone ``o``, or of the row's own."""
    of = F.col if o is None else (lambda k: o[k])
    vx, vy, wx, wy = of("tx") - of("hx"), of("ty") - of("hy"), x - of("hx"), y - of("hy")
    n = vx * vx + vy * vy
    t = F.when(n <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (wx * vx + wy * vy) / n)))
    return F.sqrt((wx - t * vx) * (wx - t * vx) + (wy - t * vy) * (wy - t * vy))


def _narrowed(cells: DataFrame, size: int) -> DataFrame:
    """Rows (rig_id, cy, cx, bone...) of cells of that size, those whose bone matters to a point in its cell.

    These are the bones whose reach touches the cell, and those that may be a point's nearest:
    no farther from the cell's centre than the nearest one and the cell's diagonal.
    """
    half = size * 0.5**0.5 + 1e-6
    d = cells.withColumn("_d", segment_distance((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size))
    least = F.min("_d").over(Window.partitionBy("rig_id", "cy", "cx"))
    d = d.withColumn("_least", least).where((F.col("_d") <= F.col("_least") + 2 * half) | (F.col("_d") <= F.col("reach") + half))
    return d.drop("_d", "_least")


def near_bones(points: DataFrame, bones: DataFrame, reach: Column) -> DataFrame:
    """A row for each distinct point (rig_id, y, x) and bone of its rig that may be its nearest or within ``reach`` of it.

    A rig's bones are narrowed to ever smaller cells of those that have points, and points join
    their cell. So the pairs follow what the bones reach, not points times bones. Points are
    dealt once, by their cell (cy, cx); a point's pairs stay in one partition.
    """
    fields = ["ord", "bone_id", "hx", "hy", "tx", "ty", "radius", "falloff"]
    at = lambda c, size: F.floor(F.col(c) / size)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = points.select("rig_id", "y", "x", at("y", CELLS[-1]).alias("cy"), at("x", CELLS[-1]).alias("cx")).repartition(parts, "rig_id", "cy", "cx").distinct()
    cells = placed.select("rig_id", "cy", "cx").distinct().transform(cut)
    found, above = bones.select("rig_id", *fields, reach.alias("reach")), []
    for larger, size in zip((0, *CELLS), CELLS, strict=False):
        own = cells.select("rig_id", at("cy", size // CELLS[-1]).alias("cy"), at("cx", size // CELLS[-1]).alias("cx")).distinct()
        if larger:
            own = own.withColumns({"_cy": at("cy", larger // size), "_cx": at("cx", larger // size)})
            above = ["_cy", "_cx"]
        found = own.join(found.withColumnsRenamed({"cy": "_cy", "cx": "_cx"}).hint("merge"), ["rig_id", *above]).drop("_cy", "_cx").transform(_narrowed, size)
    d = placed.join(found.drop("reach").hint("merge"), ["rig_id", "cy", "cx"])
    return d.withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")})


def bone_weights(points: DataFrame, bones: DataFrame, power: float = 2.0, scale: float = 1.0) -> DataFrame:
    """(rig_id, y, x, bone_id, w) with w > 0, summing to 1 for each distinct point (rig_id, y, x).

    A point outside every radius goes to its nearest bone, the first in order on ties.
    """
    reach = F.greatest(F.col("radius") * scale, F.lit(1e-6))
    d = near_bones(points, bones, reach).withColumn("dist", segment_distance(F.col("_x"), F.col("_y")))
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("dist") / reach))
    d = d.withColumn("_near", near).withColumn("w", F.when(F.col("falloff") == "hard", (F.col("_near") > 0).cast("double")).when(F.col("falloff") == "linear", F.col("_near")).otherwise(F.pow("_near", F.lit(power))))
    point = Window.partitionBy("rig_id", "cy", "cx", "y", "x")
    d = d.withColumns({"_total": F.sum("w").over(point), "_first": F.min(F.struct("dist", "ord")).over(point)})
    orphan = (F.col("_total") <= 0) & (F.col("dist") == F.col("_first.dist")) & (F.col("ord") == F.col("_first.ord"))
    return d.where((F.col("w") > 0) | orphan).select("rig_id", "y", "x", "bone_id", F.when(F.col("_total") > 0, F.col("w") / F.col("_total")).otherwise(1.0).alias("w"))


def grid_points(rigs: DataFrame) -> DataFrame:
    """(rig_id, y, x) of each rig's canvas; its rows are dealt over the session's shuffle partitions."""
    d = rigs.select("rig_id", "width", upto(F.col("height")).alias("y"))
    d = d.repartition(int(rigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rig_id", "y")
    return d.select("rig_id", "y", upto(F.col("width")).alias("x"))


def _mesh(rigs: DataFrame, cell: float | None) -> DataFrame:
    size = F.lit(float(cell)) if cell else F.greatest(F.lit(8.0), F.least("width", "height") / 8.0)
    n = lambda c: F.greatest(F.lit(2), F.ceil(F.col(c) / size).cast("int") + 1)
    return rigs.select("rig_id", "width", "height", n("width").alias("cols"), n("height").alias("rows"))


def grid_mesh(rigs: DataFrame, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices (rig_id, v, x, y), triangles (rig_id, t, v0, v1, v2)) of a regular grid on the canvas."""
    m = _mesh(rigs, cell)
    v = m.select("*", upto(F.col("rows")).alias("i")).select("*", upto(F.col("cols")).alias("j"))
    v = v.select("rig_id", (F.col("i") * F.col("cols") + F.col("j")).alias("v"), (F.col("j") * (F.col("width") - 1) / (F.col("cols") - 1)).alias("x"), (F.col("i") * (F.col("height") - 1) / (F.col("rows") - 1)).alias("y"))
    t = m.select("*", upto(F.col("rows") - 1).alias("i")).select("*", upto(F.col("cols") - 1).alias("j"))
    p = F.col("i") * F.col("cols") + F.col("j")
    k = (F.col("i") * (F.col("cols") - 1) + F.col("j")) * 2
    two = F.array(F.struct(k.alias("t"), p.alias("v0"), (p + 1).alias("v1"), (p + F.col("cols") + 1).alias("v2")), F.struct((k + 1).alias("t"), p.alias("v0"), (p + F.col("cols") + 1).alias("v1"), (p + F.col("cols")).alias("v2")))
    return v, t.select("rig_id", F.explode(two).alias("s")).select("rig_id", "s.*")


def skinning_fields(weights: DataFrame, skins: DataFrame) -> DataFrame:
    """(rig_id, frame, y, x, a..f): the weighted sum of each pixel's bones' matrices."""
    return weights.join(skins, ["rig_id", "bone_id"]).groupBy("rig_id", "frame", "y", "x").agg(*(F.sum(F.col("w") * F.col(k)).alias(k) for k in M))


def _step(x: np.ndarray, y: np.ndarray, m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sources (sx, sy) of the places by the matrices ``m``, a to f."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    det = np.where(np.abs(det) < 1e-8, 1e-8, det)
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def _sources(frame: np.ndarray, y: np.ndarray, x: np.ndarray, m: list[np.ndarray], iters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which places have a source, sy, sx) of whole fields: places (y, x) of frames, numbered from 0, and their matrices a to f."""
    # Places are found by their numbers in rows of one width; estimates are clamped to their own frame's field.
    width, height = x.max() + 1, y.max() + 1
    top_y, top_x = (np.zeros(frame.max() + 1) for _ in range(2))
    np.maximum.at(top_y, frame, y)
    np.maximum.at(top_x, frame, x)
    number = (frame * height + y) * width + x
    order = np.argsort(number, kind="stable")
    sx, sy, live = x, y, np.arange(len(x))
    for _ in range(max(1, iters)):
        near = lambda v, top: np.minimum(top, np.maximum(0, np.rint(np.round(v, DIGITS))))
        own = frame[live]
        want = (own * height + near(sy, top_y[own])) * width + near(sx, top_x[own])
        at = np.minimum(np.searchsorted(number, want, sorter=order), len(order) - 1)
        hit = order[at]
        some = number[hit] == want
        live, hit = live[some], hit[some]
        sx, sy = _step(x[live], y[live], [k[hit] for k in m])
    return live, sy, sx


def _iterated(table: pa.Table, iters: int) -> pa.Table:
    """The map of one frame's whole field (rig_id, frame, y, x, a..f)."""
    y, x, *m = (table.column(c).to_numpy().astype(float) for c in ("y", "x", *M))
    live, sy, sx = _sources(np.zeros(len(y), int), y, x, m, iters)
    rows = table.select(["rig_id", "frame", "y", "x"]).take(pa.array(live))
    return rows.append_column("sy", pa.array(sy)).append_column("sx", pa.array(sx))


def backward_map(fields: DataFrame, iters: int = 5) -> DataFrame:
    """(rig_id, frame, y, x, sy, sx): for each output pixel its source, by a fixed-point iteration.

    A step reads the field at the nearest place to the estimate, clamped to the frame; an
    estimate is rounded to 6 digits first, so that the noise of sums doesn't choose between two
    places. A frame's field is kept together and iterated in one task, without a shuffle a step;
    of frames too large for that, each step is a join. A place that the field lacks has no source.
    """
    fields = cut(fields)
    whole, large = by_size(fields, ["rig_id", "frame"])
    kinds = dict(fields.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("rig_id", "frame", "y", "x")) + ", sy double, sx double"
    out = whole.select("rig_id", "frame", "y", "x", *M).groupBy("rig_id", "frame").applyInArrow(lambda t: _iterated(t, iters), schema)
    return out if large is None else out.unionByName(_joined_map(large, iters))


def _joined_map(fields: DataFrame, iters: int) -> DataFrame:
    edge = fields.groupBy("rig_id", "frame").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    est = fields.select("rig_id", "frame", "y", "x", F.col("y").cast("double").alias("sy"), F.col("x").cast("double").alias("sx")).join(edge, ["rig_id", "frame"])
    at = fields.withColumnsRenamed({"y": "py", "x": "px"})
    for _ in range(max(1, iters)):
        clamp = lambda c, m: F.least(F.col(m), F.greatest(F.lit(0), F.rint(F.round(c, DIGITS)).cast("int")))
        d = est.withColumn("py", clamp("sy", "my")).withColumn("px", clamp("sx", "mx")).join(at, ["rig_id", "frame", "py", "px"])
        det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
        det = F.when(F.abs(det) < 1e-8, 1e-8).otherwise(det)
        rx, ry = F.col("x") - F.col("c"), F.col("y") - F.col("f")
        est = d.select("rig_id", "frame", "y", "x", ((F.col("a") * ry - F.col("d") * rx) / det).alias("sy"), ((F.col("e") * rx - F.col("b") * ry) / det).alias("sx"), "mx", "my")
    return est.select("rig_id", "frame", "y", "x", "sy", "sx")


def _maps(weights: pa.Table, skins: pa.Table, iters: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(frame, y, x, sy, sx) of the frames of ``skins``, by the weights of the rig's whole canvas; some frames at once, up to AT_ONCE weights."""
    y, x, w = (weights.column(c).to_numpy().astype(float) for c in ("y", "x", "w"))
    names = skins.column("bone").combine_chunks().unique()
    bone = pc.fill_null(pc.index_in(weights.column("bone_id"), value_set=names), -1).to_numpy()
    of, at_frame = pc.index_in(skins.column("bone"), value_set=names).to_numpy(), skins.column("frame").to_numpy()
    matrix = np.column_stack([skins.column(c).to_numpy() for c in M])
    width = x.max() + 1
    number, at = np.unique(y * width + x, return_inverse=True)
    py, px = np.divmod(number, width)
    frames = np.unique(at_frame)
    step = max(1, AT_ONCE // len(w))
    for k in range(0, len(frames), step):
        now = frames[k : k + step]
        rows = np.flatnonzero((at_frame >= now[0]) & (at_frame <= now[-1]))
        turn = np.searchsorted(now, at_frame[rows])
        here, own = np.zeros((len(now), len(names) + 1), bool), np.zeros((len(now), len(names) + 1, len(M)))
        here[turn, of[rows]], own[turn, of[rows]] = True, matrix[rows]  # a bone without a place in the list is -1, the last one
        some = here[:, bone].ravel()
        place = (np.arange(len(now))[:, None] * len(number) + at).ravel()[some]
        field = [np.bincount(place, (w * own[:, bone, j]).ravel()[some], len(now) * len(number)) for j in range(len(M))]
        got = np.flatnonzero(np.bincount(place, minlength=len(now) * len(number)))
        if len(got):
            f, p = np.divmod(got, len(number))
            live, sy, sx = _sources(f, py[p], px[p], [c[got] for c in field], iters)
            yield now[f[live]], py[p[live]], px[p[live]], sy, sx


def _pixels_at(y: np.ndarray, x: np.ndarray, table: pa.Table) -> np.ndarray:
    """(n, 4) colours b, g, r, a of the places by ``table``'s pixels, 0 where it has none."""
    out = np.zeros((len(y), 4))
    if not table.num_rows or not len(y):
        return out
    own = [table.column(c).to_numpy().astype(float) for c in ("y", "x")]
    low, wide = own[1].min(), own[1].max() - own[1].min() + 1
    number, place = np.unique(own[0] * wide + own[1] - low, return_inverse=True)
    value = np.column_stack([np.bincount(place, table.column(c).to_numpy().astype(float)) for c in (*CHANNELS, "a")])
    inside = (x >= low) & (x < low + wide)
    want = y * wide + x - low
    at = np.minimum(np.searchsorted(number, want), len(number) - 1)
    hit = inside & (number[at] == want)
    out[hit] = value[at[hit]]
    return out


def _moved(y: np.ndarray, x: np.ndarray, still: pa.Table) -> np.ndarray:
    """(n, 4) colours of the places (y, x) in ``still`` from their four neighbours, as ``remap`` reads them."""
    ly, lx = np.floor(y), np.floor(x)
    fy, fx = y - ly, x - lx
    total = sum(_pixels_at(ly + j, lx + i, still) * ((fy if j else 1 - fy) * (fx if i else 1 - fx))[:, None] for j in (0, 1) for i in (0, 1))
    return np.rint(np.round(total, DIGITS))


#: Columns of what a task is given of a rig, and of what it gives: a pixel, and the plate's under it.
GIVEN = "kind int, y int, x int, bone_id string, w double, b double, g double, r double, a double"
SHOWN = "frame int, y int, x int, b int, g int, r int, a int, b2 int, g2 int, r2 int, a2 int"


def _shown(rig: pa.Table, skins: pa.Table, iters: int, schema: pa.Schema) -> pa.Table:
    """The moved pixels of the frames of ``skins``, and the plate's, of one rig's weights (kind 0), still (1) and plate (2)."""
    weights, still, plate = (rig.filter(pc.equal(rig.column("kind"), k)) for k in (0, 1, 2))
    if not weights.num_rows or not skins.num_rows:
        return schema.empty_table()
    clip = rig.column("rig_id")[0]
    py, px = (plate.column(c).to_numpy().astype(float) for c in ("y", "x"))
    out = []
    for f, y, x, sy, sx in _maps(weights, skins, iters):
        over = _moved(sy, sx, still)
        if len(py):
            if (y.max(), x.max()) != (py.max(), px.max()):
                raise ValueError(f"layers differ in size: clip {clip} is {int(x.max()) + 1}x{int(y.max()) + 1} and {int(px.max()) + 1}x{int(py.max()) + 1}")
            shown = np.unique(f)
            qf, qy, qx = np.repeat(shown, len(py)), np.tile(py, len(shown)), np.tile(px, len(shown))
            number = lambda f, y, x: (f * (py.max() + 1) + y) * (px.max() + 1) + x
            rest = ~np.isin(number(qf, qy, qx), number(f, y, x))
            f, y, x, over = np.concatenate([f, qf[rest]]), np.concatenate([y, qy[rest]]), np.concatenate([x, qx[rest]]), np.concatenate([over, np.zeros((rest.sum(), 4))])
        out.append((f, y, x, *over.T, *_pixels_at(y, x, plate).T))
    if not out:
        return schema.empty_table()
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    ids = pa.array([clip.as_py()] * len(columns[0]), schema.field(0).type)
    return pa.table([ids, *(pa.array(c.astype(np.int32)) for c in columns)], schema=schema)


def _turns(rows: DataFrame, skins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rigs' rows once for each turn of TOGETHER frames, and the skins (rig_id, _turn, frame, bone, a..f) with their turn."""
    kind = rows.schema["rig_id"].dataType
    rig, turn = F.col("rig_id").cast(kind).alias("rig_id"), F.floor(F.col("frame") / TOGETHER).cast("int").alias("_turn")
    return rows.join(skins.select(rig, turn).distinct().hint("merge"), "rig_id"), skins.select(rig, turn, "frame", F.col("bone_id").alias("bone"), *M)


def _deformed(weights: DataFrame, skins: DataFrame, still: DataFrame, plate: DataFrame | None, iters: int) -> DataFrame:
    """(clip_id, SHOWN...): a rig's weights, still and plate go to a task once for each TOGETHER frames, so no field and no map is a table."""
    kind = still.schema["clip_id"].dataType.simpleString()
    given = [f.split() for f in GIVEN.split(", ")]
    pixels = [*CHANNELS, "a"]

    def one(df: DataFrame, rig: str, number: int, has: list[str]) -> DataFrame:
        return df.select(F.col(rig).cast(kind).alias("rig_id"), *((F.lit(number) if c == "kind" else F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in given))

    rows = one(weights, "rig_id", 0, ["y", "x", "bone_id", "w"]).unionByName(one(still, "clip_id", 1, ["y", "x", *pixels]))
    if plate is not None:
        rows = rows.unionByName(one(plate, "clip_id", 2, ["y", "x", *pixels]))
    rows, turns = _turns(rows, skins)
    schema = f"clip_id {kind}, {SHOWN}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.groupBy("rig_id", "_turn").cogroup(turns.groupBy("rig_id", "_turn")).applyInArrow(lambda a, b: _shown(a, b, iters, arrow), schema)


def skinned_map(weights: DataFrame, skins: DataFrame, iters: int = 5) -> DataFrame:
    """``backward_map`` of ``skinning_fields``, whose fields are made and iterated in one task for each rig and TOGETHER frames.

    So fields, a row a pixel and frame, are neither stored nor dealt. Rigs with too many weights for one task go by fields.
    """
    kinds = dict(weights.dtypes)
    schema = f"rig_id {kinds['rig_id']}, frame int, y int, x int, sy double, sx double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    whole, large = by_size(cut(weights), ["rig_id"])
    def run(w: pa.Table, s: pa.Table) -> pa.Table:
        maps = list(_maps(w, s, iters)) if w.num_rows and s.num_rows else []
        if not maps:
            return arrow.empty_table()
        frame, y, x, sy, sx = (np.concatenate(c) for c in zip(*maps, strict=True))
        ids = pa.array([w.column("rig_id")[0].as_py()] * len(y), arrow.field(0).type)
        return pa.table([ids, *(pa.array(c.astype(np.int32)) for c in (frame, y, x)), pa.array(sy), pa.array(sx)], schema=arrow)

    rows, turns = _turns(whole, skins)
    out = rows.groupBy("rig_id", "_turn").cogroup(turns.groupBy("rig_id", "_turn")).applyInArrow(run, schema)
    return out if large is None else out.unionByName(backward_map(skinning_fields(large, skins), iters))


def deform(still: DataFrame, rigs: DataFrame, bones: DataFrame, keyframes: DataFrame, frames: DataFrame, plate: DataFrame | None = None, iters: int = 5) -> DataFrame:
    """The frames (clip_id, frame, y, x, b, g, r, a) of each rig's still (clip_id = rig_id, y, x, ...), over ``plate``.

    A rig of at most WHOLE weights is moved and laid over its plate in one task for each TOGETHER frames; others go by joins.
    """
    whole, large = by_size(cut(bone_weights(grid_points(rigs), bones)), ["rig_id"])
    skins = cut(skin_matrices(bone_world(bones, interpolate_poses(keyframes, bones, frames))))
    pixels = [*KEY, *CHANNELS, "a"]
    out = _deformed(whole, skins, still, plate, iters).select(*(pixels if plate is None else [*KEY, *over_columns()]))
    if large is None:
        return out
    to = backward_map(skinning_fields(large, skins), iters).withColumnRenamed("rig_id", "clip_id")
    rest = cut(remap(still, to))
    if plate is not None:
        rest = composite_over(rest, plate.join(rest.select("clip_id", "frame").distinct(), "clip_id").select(*pixels))
    return out.unionByName(rest.select(*pixels))


def footprint_union(still: DataFrame, rigs: DataFrame, bones: DataFrame, keyframes: DataFrame, frames: DataFrame) -> DataFrame:
    """(clip_id, y, x): pixels that the moved still covers in any frame and the resting one does not."""
    moved = deform(still, rigs, bones, keyframes, frames).where("a > 127").select("clip_id", "y", "x").distinct()
    return moved.join(still.where("a > 127").select("clip_id", "y", "x").hint("merge"), ["clip_id", "y", "x"], "left_anti")


def skin_points(points: DataFrame, weights: DataFrame, world: DataFrame) -> DataFrame:
    """(rig_id, frame, y, x, nx, ny): each point moved by its bones' weighted transforms."""
    d = points.join(weights, ["rig_id", "y", "x"]).join(world, ["rig_id", "bone_id"])
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    return d.groupBy("rig_id", "frame", "y", "x").agg(F.sum(w * (F.col("a") * x + F.col("b") * y + F.col("c"))).alias("nx"), F.sum(w * (F.col("d") * x + F.col("e") * y + F.col("f"))).alias("ny"))


def pose_curves(rigs: DataFrame, bones: DataFrame, keyframes: DataFrame, channel: str = "rot") -> DataFrame:
    """(rig_id, bone_id, frame, value, velocity, normalised, x) of ``rigs`` (rig_id, frames, fps)."""
    frames = rigs.select("rig_id", upto(F.col("frames")).alias("frame"))
    d = interpolate_poses(keyframes, bones, frames).select("rig_id", "bone_id", "frame", F.col(channel).alias("value")).join(rigs.select("rig_id", "frames", "fps"), "rig_id")
    w = Window.partitionBy("rig_id", "bone_id")
    low, high = F.min("value").over(w), F.max("value").over(w)
    norm = F.when(high - low < 1e-9, 50.0).otherwise(100 - (F.col("value") - low) / (high - low) * 100)
    velocity = (F.lead("value").over(w.orderBy("frame")) - F.col("value")) * F.col("fps")
    return d.select("rig_id", "bone_id", "frame", "value", velocity.alias("velocity"), norm.alias("normalised"), (F.col("frame") / F.greatest(F.lit(1), F.col("frames") - 1) * 1000).alias("x"))


def bone_tree(bones: DataFrame) -> DataFrame:
    """(rig_id, bone_id, depth, position): depth-first order, siblings by ord."""
    up = bone_closure(bones).join(bones.select("rig_id", F.col("bone_id").alias("ancestor_id"), F.col("ord").alias("_o")), ["rig_id", "ancestor_id"])
    path = up.groupBy("rig_id", "bone_id").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("depth", "_o"))), lambda s: s["_o"])).alias("_p"))
    d = bones.select("rig_id", "bone_id", "ord").join(path, ["rig_id", "bone_id"], "left").withColumn("_p", F.concat(F.coalesce("_p", F.array().cast("array<int>")), F.array("ord")))
    w = Window.partitionBy("rig_id").orderBy("_p")
    return d.select("rig_id", "bone_id", (F.size("_p") - 1).alias("depth"), F.row_number().over(w).alias("position"))


def nearest_bone(points: DataFrame, bones: DataFrame, radius: float) -> DataFrame:
    """(rig_id, y, x, bone_id, part, dist): the closest head, tail or body within ``radius``, in that order on ties.

    Head and tail are ends of the body, so the bones that may be a point's nearest by their body are enough.
    """
    d = near_bones(points, bones, F.lit(0.0))
    x, y = F.col("_x"), F.col("_y")
    to = lambda px, py: F.sqrt((x - F.col(px)) * (x - F.col(px)) + (y - F.col(py)) * (y - F.col(py)))
    of = (("head", to("hx", "hy")), ("tail", to("tx", "ty")), ("body", segment_distance(x, y)))
    part = F.least(*(F.struct(dist.alias("dist"), F.col("ord"), F.lit(k).alias("k"), F.lit(name).alias("part"), F.col("bone_id")) for k, (name, dist) in enumerate(of)))
    near = d.groupBy("rig_id", "cy", "cx", "y", "x").agg(F.min(part).alias("p"))
    return near.where(F.col("p.dist") <= radius).select("rig_id", "y", "x", "p.bone_id", "p.part", "p.dist")


def scale_rigs(bones: DataFrame, factor: float) -> DataFrame:
    times = lambda c: (F.col(c) * factor).alias(c)
    return bones.select("rig_id", "bone_id", "ord", "parent_id", *(times(c) for c in ("hx", "hy", "tx", "ty")), (F.coalesce("radius", F.lit(10.0)) * factor).alias("radius"), "falloff")
