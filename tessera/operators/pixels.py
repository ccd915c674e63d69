"""Pointwise operators on pixel tables (clip_id, frame, y, x, b, g, r, a) and masks (..., m).

A missing pixel counts as transparent black, a missing mask pixel as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["clip_id", "frame", "y", "x"]
CHANNELS = ["b", "g", "r"]


def trunc(c: Column) -> Column:
    """A value clamped to 0..255 and truncated, as storing it in a byte does."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c))).cast("int")


def rounded(c: Column) -> Column:
    """A value rounded half to even and clamped to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(c).cast("int")))


def clips_of(pixels: DataFrame) -> DataFrame:
    """(clip_id, width, height, total_frames) from the largest coordinates."""
    one = lambda c, n: (F.max(c) + 1).cast("int").alias(n)
    return pixels.groupBy("clip_id").agg(one("x", "width"), one("y", "height"), one("frame", "total_frames"))


def frame_sizes(pixels: DataFrame) -> DataFrame:
    return clips_of(pixels).select("clip_id", "width", "height")


def densify(pixels: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """A row for each pixel of each frame; missing ones are 0, 0, 0, 0. Neither side is broadcast: a planner may see both by a row a clip."""
    clips = clips_of(pixels) if clips is None else clips
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    grid = clips.where("total_frames > 0 and height > 0 and width > 0").select("clip_id", "width", "height", upto("total_frames").alias("frame"))
    grid = grid.select("clip_id", "width", "frame", upto("height").alias("y")).select("clip_id", "frame", "y", upto("width").alias("x"))
    return grid.join(pixels.hint("merge"), KEY, "left").na.fill(0, [c for c in pixels.columns if c not in KEY])


def densify_mask(mask: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    return densify(mask.select(*KEY, "m"), clips)


def parse_color(c: Column) -> Column:
    """[b, g, r] of "#RGB", "#RRGGBB" or "B,G,R"; "transparent" is [0, 0, 0, 0]; others null."""
    s = F.trim(c)
    h = F.regexp_replace(s, "^#", "")
    two = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    one = lambda k: F.conv(F.repeat(F.substring(h, k, 1), 2), 16, 10).cast("int")
    parts = F.transform(F.split(h, ","), lambda x: F.trim(x))
    ints = F.transform(F.slice(parts, 1, 3), lambda x: x.try_cast("int"))
    whole = F.forall(parts, lambda x: x.rlike(r"^[+-]?\d+$"))
    hexed = s.startswith("#")
    return (
        F.when(c.isNull(), None).when(F.lower(c) == "transparent", F.array(*[F.lit(0)] * 4))
        .when(hexed & h.rlike("^[0-9a-fA-F]{3}$"), F.array(one(3), one(2), one(1)))
        .when(hexed & h.rlike("^[0-9a-fA-F]{6}$"), F.array(two(5), two(3), two(1)))
        .when((F.size(parts) >= 3) & whole, ints)
    )


def parse_color_rgba(c: Column) -> Column:
    """[r, g, b, a]; empty, null and "transparent" are [0, 0, 0, 0]; an invalid colour fails the job."""
    p = parse_color(c)
    none = c.isNull() | (c == "") | (F.lower(c) == "transparent")
    bad = F.raise_error(F.concat(F.lit("Invalid color format: "), c)).cast("array<int>")
    return F.when(none, F.array(*[F.lit(0)] * 4)).when(p.isNull(), bad).otherwise(F.array(p[2], p[1], p[0], F.lit(255)))


def in_range(df: DataFrame, lower: tuple[int, int, int], upper: tuple[int, int, int]) -> DataFrame:
    """Mask of the pixels within both bounds, inclusive."""
    ok = F.lit(True)
    for c, lo, hi in zip(CHANNELS, lower, upper, strict=True):
        ok = ok & F.col(c).between(lo, hi)
    return df.select(*KEY, F.when(ok, 255).otherwise(0).alias("m"))


def distance(target: tuple[int, int, int]) -> Column:
    """Euclidean distance of a pixel's colour from ``target`` (b, g, r)."""
    return F.sqrt(sum((F.pow(F.col(c) - t, F.lit(2)) for c, t in zip(CHANNELS, target, strict=True)), F.lit(0.0)))


def color_distance(df: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    return df.select(*KEY, distance(target).alias("d"))


def threshold(mask: DataFrame, t: float, maxv: int = 255) -> DataFrame:
    """``maxv`` where m is strictly above ``t``, else 0."""
    return mask.select(*KEY, F.when(F.col("m") > t, maxv).otherwise(0).alias("m"))


def _two(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select(*KEY, F.col("m").alias("m1")).join(b.select(*KEY, F.col("m").alias("m2")), KEY, how)


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return _two(a, b, "inner").select(*KEY, F.col("m1").bitwiseAND(F.col("m2")).alias("m"))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return _two(a, b, "full").select(*KEY, F.coalesce("m1", F.lit(0)).bitwiseOR(F.coalesce("m2", F.lit(0))).alias("m"))


def mask_not(a: DataFrame) -> DataFrame:
    return a.select(*KEY, (255 - F.col("m")).alias("m"))


def split_channels(df: DataFrame) -> DataFrame:
    """A row for each channel: (..., channel, value), channels in the order b, g, r, a."""
    return df.selectExpr(*KEY, "stack(4, 'b', b, 'g', g, 'r', r, 'a', a) as (channel, value)")


def merge_channels(df: DataFrame) -> DataFrame:
    one = lambda c, d: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("value"))), F.lit(d)).alias(c)
    return df.groupBy(*KEY).agg(*(one(c, 0) for c in CHANNELS), one("a", 255))


def hsv_columns() -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255 of b, g, r; grey has hue 0."""
    b, g, r = (F.col(c).cast("double") for c in CHANNELS)
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    h = F.when(d == 0, 0.0).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    h = F.when(h < 0, h + 360).otherwise(h)
    s = F.when(v == 0, 0.0).otherwise(d * 255 / v)
    return F.rint(h / 2).cast("int"), F.rint(s).cast("int"), v.cast("int")


def bgr_to_hsv(df: DataFrame) -> DataFrame:
    h, s, v = hsv_columns()
    return df.select(*KEY, h.alias("h"), s.alias("s"), v.alias("v"))


def gray_column() -> Column:
    return F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int")


def bgr_to_gray(df: DataFrame) -> DataFrame:
    return df.select(*KEY, gray_column().alias("gray"))


def recolor(df: DataFrame, target: tuple[int, int, int], new: tuple[int, int, int], tol: int = 30) -> DataFrame:
    """Pixels within ``tol`` of ``target`` in each channel get the colour ``new``; alpha stays."""
    hit = F.lit(True)
    for c, t in zip(CHANNELS, target, strict=True):
        hit = hit & F.col(c).between(max(0, t - tol), min(255, t + tol))
    return df.select(*KEY, *(F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in zip(CHANNELS, new, strict=True)), "a")


def blend_column(f1: Column, f2: Column, mode: str) -> Column:
    x, y = f1.cast("double"), f2.cast("double")
    if mode == "add":
        return trunc(x + y)
    if mode == "multiply":
        return trunc(x * y / 255)
    if mode == "screen":
        return trunc(255 - (255 - x) * (255 - y) / 255)
    if mode == "overlay":
        return trunc(F.when(x < 128, 2 * x * y / 255).otherwise(255 - 2 * (255 - x) * (255 - y) / 255))
    return rounded((x + y) / 2)


def blend(df1: DataFrame, df2: DataFrame, mode: str) -> DataFrame:
    """Both frames' colours by ``mode`` (add, multiply, screen, overlay; any other: half of each)."""
    other = df2.select(*KEY, *(F.col(c).alias(f"{c}2") for c in [*CHANNELS, "a"]))
    return df1.join(other, KEY).select(*KEY, *(blend_column(F.col(c), F.col(f"{c}2"), mode).alias(c) for c in [*CHANNELS, "a"]))


def composite_opaque(fg: DataFrame, bg: DataFrame, alpha: DataFrame | None = None) -> DataFrame:
    """The foreground over an opaque background, by its own alpha or the mask ``alpha`` (missing: 255)."""
    under = bg.select(*KEY, *(F.col(c).alias(f"{c}2") for c in CHANNELS))
    df = fg.join(under, KEY)
    if alpha is not None:
        df = df.join(alpha.select(*KEY, "m"), KEY, "left").withColumn("a", F.coalesce("m", F.lit(255)))
    w = F.col("a") / F.lit(255.0)
    return df.select(*KEY, *(trunc(F.col(c) * w + F.col(f"{c}2") * (1 - w)).alias(c) for c in CHANNELS), F.lit(255).alias("a"))


def over_columns(fg: str = "", bg: str = "2") -> list[Column]:
    """Source-over of two sets of columns b, g, r, a with the given suffixes."""
    fa, ba = (F.coalesce(F.col(f"a{s}"), F.lit(0)) / F.lit(255.0) for s in (fg, bg))
    oa = fa + ba * (1 - fa)
    safe = F.when(oa == 0, 1.0).otherwise(oa)
    mix = lambda c: (F.coalesce(F.col(f"{c}{fg}"), F.lit(0)) * fa + F.coalesce(F.col(f"{c}{bg}"), F.lit(0)) * ba * (1 - fa)) / safe
    return [*(trunc(mix(c)).alias(c) for c in CHANNELS), trunc(oa * 255).alias("a")]


def same_size(a: DataFrame, b: DataFrame, what: str) -> DataFrame:
    """``a``; a clip whose size differs between both, by their largest coordinates, fails the job.

    Both sizes come from one aggregation, whose few rows for differing clips are all that ``a`` is joined with.
    """
    of = lambda d, side: d.select("clip_id", "y", "x", F.lit(side).alias("_side"))
    most = lambda c, side: (F.max(F.when(F.col("_side") == side, F.col(c))) + 1).cast("int")
    sizes = of(a, 0).unionByName(of(b, 1)).groupBy("clip_id").agg(most("x", 0).alias("width"), most("y", 0).alias("height"), most("x", 1).alias("_w"), most("y", 1).alias("_h"))
    odd = sizes.where("width <> _w or height <> _h")
    odd = odd.select("clip_id", F.format_string("%s differ in size: clip %s is %sx%s and %sx%s", F.lit(what), F.col("clip_id").cast("string"), "width", "height", "_w", "_h").alias("_why"))
    d = a.join(odd, "clip_id", "left")
    kinds = dict(a.dtypes)
    return d.select(*(F.when(F.col("_why").isNull(), F.col(c)).otherwise(F.raise_error(F.col("_why")).cast(kinds[c])).alias(c) if c == "clip_id" else c for c in a.columns))


def composite_over(fg: DataFrame, bg: DataFrame, strict: bool = True) -> DataFrame:
    """The foreground over the background, both with alpha; a pixel of either alone counts.

    Clips of two sizes fail the job, unless not ``strict``.
    """
    fg = same_size(fg, bg, "layers") if strict else fg
    under = bg.select(*KEY, *(F.col(c).alias(f"{c}2") for c in [*CHANNELS, "a"]))
    return fg.select(*KEY, *CHANNELS, "a").join(under, KEY, "full").select(*KEY, *over_columns())


def composite_stack(character: DataFrame, patch: DataFrame | None = None, plate: DataFrame | None = None) -> DataFrame:
    """Character over patch over plate; a patch or plate without ``frame`` is under every frame."""
    out = character
    frames = character.select("clip_id", "frame").distinct()
    for layer in (patch, plate):
        if layer is not None:
            out = composite_over(out, layer if "frame" in layer.columns else layer.join(frames, "clip_id").select(*KEY, *CHANNELS, "a"))
    return out


def orient(df: DataFrame, orientation: int) -> DataFrame:
    """The frame as its EXIF ``orientation`` (1 to 8) shows it; 5 to 8 swap width and height."""
    d = df.join(frame_sizes(df), "clip_id")
    x, y, mx, my = F.col("x"), F.col("y"), F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")
    nx, ny = {2: (mx, y), 3: (mx, my), 4: (x, my), 5: (y, x), 6: (my, x), 7: (my, mx), 8: (y, mx)}.get(orientation, (x, y))
    return d.select("clip_id", "frame", ny.cast("int").alias("y"), nx.cast("int").alias("x"), *CHANNELS, "a")


def split_layers(df: DataFrame, mask: DataFrame, strict: bool = True) -> DataFrame:
    """The character layer: the pixels with the mask as alpha.

    A mask of another size than its clip fails the job, unless not ``strict``.
    """
    df = same_size(df, mask, "still and mask") if strict else df
    return df.join(mask.select(*KEY, "m"), KEY, "left").select(*KEY, *CHANNELS, F.coalesce("m", F.lit(0)).alias("a"))
