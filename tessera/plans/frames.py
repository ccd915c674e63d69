"""Queries of the pixel, colour, segmentation and effect operators, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import color as C
from ..operators import pixels as P
from ..operators import segment as S
from ..sources import fixtures as X
from ..sources.fixtures import oracle

TARGET, NEW = (120, 130, 110), (1, 2, 3)
#: In SQL: clips, a full grid, and the border colour of a clip or a frame.
CLIPS = ", clips as (select clip_id, max(x) + 1 w, max(y) + 1 h, max(frame) + 1 n from pixels group by 1)"
MCLIPS = ", pixels as (select * from mosaic)" + CLIPS
DENSE = MCLIPS + """, grid as (select clip_id, f.frame, gy.y, gx.x from clips, lateral (select unnest(range(0, n)) frame) f, lateral (select unnest(range(0, h)) y) gy, lateral (select unnest(range(0, w)) x) gx),
dense as (select g.clip_id, g.frame::int frame, g.y::int y, g.x::int x, coalesce(b, 0) b, coalesce(p.g, 0) g, coalesce(r, 0) r, coalesce(a, 0) a, case when coalesce(a, 0) > 127 then 255 else 0 end m from grid g left join mosaic p on (p.clip_id, p.frame, p.y, p.x) = (g.clip_id, g.frame, g.y, g.x))"""


def border_sql(by: str, bw: int = 10) -> str:
    return f"""bd as (select {by}, cast(floor(sum(b * k)::double / sum(k)) as int) b, cast(floor(sum(g * k)::double / sum(k)) as int) g, cast(floor(sum(r * k)::double / sum(k)) as int) r from (
  select *, (y < bw)::int + (bw = 0 or y >= h - bw)::int + (x < bw)::int + (bw = 0 or x >= w - bw)::int k from (select p.*, h, w, least({bw}, h // 4, w // 4) bw from pixels p join clips using (clip_id))) where k > 0 group by {by})"""


RANGES = """, {bd}, ranges as (select clip_id{f}, 0 ord, b, g, r, {tol} t from bd union all
  select clip_id{f}, ord, least(255, greatest(0, b + s)), least(255, greatest(0, g + s)), least(255, greatest(0, r + s)), {tol} + 5 from bd, (values (1, 15), (2, -15), (3, 20), (4, -20), (5, 25), (6, -25), (7, 10)) v(ord, s) where ord < {n})"""


def ranges_sql(tol: int = 25, n: int = 5) -> str:
    return RANGES.format(bd=border_sql("clip_id"), f="", tol=tol, n=n)


def hit(table: str = "ranges", tol: str = "q.t") -> str:
    return f"exists (select 1 from {table} q where q.clip_id = p.clip_id and " + " and ".join(f"p.{c} between greatest(0, q.{c} - {tol}) and least(255, q.{c} + {tol})" for c in "bgr") + ")"


def box_sql(source: str, k: int, of: str) -> str:
    return f"select p.clip_id, p.frame, p.y, p.x, {of}(q.m)::int m from {source} p join {source} q on q.clip_id = p.clip_id and q.frame = p.frame and q.y between p.y - {k} and p.y + {k} and q.x between p.x - {k} and p.x + {k} group by all"


CORNERS = """, picks as (select clip_id, w, h, k, f from clips, lateral (select * from (values (0, 0), (1, 1), (2, n - 1)) v(k, f) where f < n)), cs as (select p.clip_id, k * 4 + c ord, cast(floor(avg(b)) as int) b, cast(floor(avg(g)) as int) g, cast(floor(avg(r)) as int) r from pixels p join picks q on q.clip_id = p.clip_id and q.f = p.frame, (values (0), (1), (2), (3)) cc(c)
  where case when c < 2 then y < 3 else y >= h - 3 end and case when c % 2 = 0 then x < 3 else x >= w - 3 end group by 1, 2)"""
CENTRE = ", ".join(f"cast(floor(c.s{c} / c.n) as int) {c}" for c in "bgr")


def clusters_sql(tol: float) -> str:
    """Greedy clusters of the corners, sample by sample: ``final`` has each clip's list."""
    one = "{'b': s.b::bigint, 'g': s.g::bigint, 'r': s.r::bigint, 'sb': s.b::bigint, 'sg': s.g::bigint, 'sr': s.r::bigint, 'n': 1::bigint}"
    near = f"list_position(list_transform(t.acc, lambda c: sqrt((c.b - s.b) ** 2 + (c.g - s.g) ** 2 + (c.r - s.r) ** 2) <= {float(tol)}), true)"
    grown = "list_transform(range(1, len(acc) + 1), lambda i: case when i = hit then {'b': acc[i].b, 'g': acc[i].g, 'r': acc[i].r, 'sb': acc[i].sb + b, 'sg': acc[i].sg + g, 'sr': acc[i].sr + r, 'n': acc[i].n + 1} else acc[i] end)"
    return f""", sq as (select *, row_number() over (partition by clip_id order by ord) k, count(*) over (partition by clip_id) m from cs),
rec as (select clip_id, k, m, [{one}] acc from sq s where k = 1 union all select clip_id, k, m, case when hit > 0 then {grown} else list_append(acc, one) end from (select s.clip_id, s.k, s.m, s.b, s.g, s.r, t.acc, {one} one, coalesce({near}, 0) hit from rec t join sq s on s.clip_id = t.clip_id and s.k = t.k + 1)),
final as (select clip_id, acc from rec where k = m)"""


def regions_sql(on: str) -> str:
    """``labels``: 8-connected pixels of ``on``, by all pairs of a pixel and one that it reaches."""
    return f""", spots as (select clip_id, frame, y, x from ({on})), pairs as (select *, y::bigint * 2147483648 + x root from spots union select o.clip_id, o.frame, o.y, o.x, r.root from pairs r join spots o on o.clip_id = r.clip_id and o.frame = r.frame and abs(o.y - r.y) <= 1 and abs(o.x - r.x) <= 1),
labels as (select clip_id, frame, y, x, min(root) as label from pairs group by 1, 2, 3, 4)"""


def blur_sql(columns: str) -> str:
    """A Gaussian of five taps with mirrored borders over ``dense``: the table ``blur``."""
    raw = [math.exp(-((i - 2) ** 2) / (2 * 1.1 * 1.1)) for i in range(5)]
    taps = ", ".join(f"({i - 2}, {w / sum(raw)!r}::double)" for i, w in enumerate(raw))
    at = lambda c, n: f"(({n} - 1) - abs(({n} - 1) - abs({c} + o) % (2 * ({n} - 1))))"
    sums = ", ".join(f"sum(q.{c} * k) {c}" for c in columns)
    return f""", taps as (select * from (values {taps}) v(o, k)), hb as (select p.clip_id, p.frame, p.y, p.x, {sums} from dense p join clips using (clip_id), taps join dense q on q.clip_id = p.clip_id and q.frame = p.frame and q.y = p.y and q.x = {at('p.x', 'w')} group by 1, 2, 3, 4),
blur as (select p.clip_id, p.frame, p.y, p.x, {", ".join(f"cast(floor(sum(q.{c} * k) + 0.5) as int) {c}" for c in columns)} from hb p join clips using (clip_id), taps join hb q on q.clip_id = p.clip_id and q.frame = p.frame and q.x = p.x and q.y = {at('p.y', 'h')} group by 1, 2, 3, 4)"""


def stats(df):
    """Per frame: rows, and sums weighted by place, so that a moved or changed pixel shows."""
    cols = [c for c in df.columns if c not in P.KEY]
    w = F.col("y") * 67 + F.col("x") + 1
    return df.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("bigint") * w).cast("bigint").alias(f"s_{c}") for c in cols))


def stats_sql(inner: str, *cols: str) -> str:
    return f"select clip_id, frame, count(*) n, {', '.join(f'cast(sum({c}::bigint * (y * 67 + x + 1)) as bigint) s_{c}' for c in cols)} from ({inner}) group by 1, 2"


def mmask(spark, d):
    """The mosaic's alpha as a mask on the full grid."""
    return P.densify(X.mosaic(spark, d)).select(*P.KEY, F.when(F.col("a") > 127, 255).otherwise(0).alias("m"))


def pmask(spark, d, cut=127):
    return X.pixels(spark, d).select(*P.KEY, F.when(F.col("b") > cut, 255).otherwise(0).alias("m"))


def px(fn):
    return lambda spark, d: fn(X.pixels(spark, d))


def mo(fn):
    return lambda spark, d: fn(X.mosaic(spark, d))


PM = ", pm as (select clip_id, frame, y, x, case when b > 127 then 255 else 0 end m from pixels), pm2 as (select clip_id, frame, y, x, case when g > 127 then 255 else 0 end m from pixels where g > 100)"
SHIFT = lambda df: df.withColumn("frame", F.col("frame") - 1).where("frame >= 0")  # noqa: E731  each frame against the next
NEXT = ", nx as (select clip_id, frame - 1 frame, y, x, b b2, g g2, r r2, a a2 from pixels where frame > 0)"
COLORS = "#ff8000|#0f8|1,2,3|transparent|bad|300,-4,5,6|1,2| 7 , 8, 9|#12345"


def _parse(spark, d):
    """Colours in several notations, one for each supplier."""
    names = F.array(*map(F.lit, COLORS.split("|")))
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.get(names, (F.col("s_suppkey") % len(COLORS.split("|"))).cast("int")).alias("text"))
    p = P.parse_color(F.col("text"))
    return s.select("s_suppkey", "text", *(F.get(p, k).alias(f"c{k}") for k in range(4)))


def _rgba(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "transparent").otherwise(F.format_string("#%06x", F.col("s_suppkey") * 4099 % 16777216)).alias("text"))
    p = P.parse_color_rgba(F.col("text"))
    return s.select("s_suppkey", *(p[k].alias(c) for k, c in enumerate("rgba")))


BLEND_SQL = {"add": "least(255, x + y)", "multiply": "x * y / 255", "screen": "255 - (255 - x) * (255 - y) / 255", "overlay": "case when x < 128 then 2 * x * y / 255 else 255 - 2 * (255 - x) * (255 - y) / 255 end"}


def _blend_sql(mode: str) -> str:
    e = BLEND_SQL.get(mode)
    cols = []
    for c in "bgra":
        f = (f"cast(floor(least(255.0, greatest(0.0, {e}))) as int)" if e else "cast(round_even((x + y) / 2, 0) as int)").replace("(x", "(@1").replace("x *", "@1 *").replace("x +", "@1 +").replace("x <", "@1 <").replace("- x", "- @1").replace("* y", "* @2").replace("+ y", "+ @2").replace("- y", "- @2")
        cols.append(f.replace("@1", f"p.{c}::double").replace("@2", f"n.{c}2::double") + f" {c}")
    return oracle(NEXT + stats_sql(f"select p.clip_id, p.frame, p.y, p.x, {', '.join(cols)} from pixels p join nx n using (clip_id, frame, y, x)", *"bgra"), "pixels")


OVER_SQL = """select clip_id, frame, y, x, {cols}, cast(floor(oa * 255) as int) a from (select *, fa + ba * (1 - fa) oa from (select coalesce(p.clip_id, n.clip_id) clip_id, coalesce(p.frame, n.frame) frame, coalesce(p.y, n.y) y, coalesce(p.x, n.x) x,
  coalesce(p.a, 0) / 255.0::double fa, coalesce(n.a2, 0) / 255.0::double ba, coalesce(p.b, 0) b, coalesce(p.g, 0) g, coalesce(p.r, 0) r, coalesce(b2, 0) b2, coalesce(g2, 0) g2, coalesce(r2, 0) r2
  from {fg} p full join {bg} n on (p.clip_id, p.frame, p.y, p.x) = (n.clip_id, n.frame, n.y, n.x)))"""
OVER_COLS = ", ".join(f"cast(floor(({c} * fa + {c}2 * ba * (1 - fa)) / case when oa = 0 then 1.0 else oa end) as int) {c}" for c in "bgr")
ORIENT = {2: ("y", "w - 1 - x"), 3: ("h - 1 - y", "w - 1 - x"), 4: ("h - 1 - y", "x"), 5: ("x", "y"), 6: ("x", "h - 1 - y"), 7: ("w - 1 - x", "h - 1 - y"), 8: ("w - 1 - x", "y")}


HSV = """hsv as (select clip_id, frame, y, x, cast(round_even(case when h < 0 then h + 360 else h end / 2, 0) as int) h, cast(round_even(case when v = 0 then 0 else d * 255 / v end, 0) as int) s, cast(v as int) v from (
  select *, case when d = 0 then 0 when v = r then 60 * (g - b) / d when v = g then 120 + 60 * (b - r) / d else 240 + 60 * (r - g) / d end h from (
  select clip_id, frame, y, x, b::double b, g::double g, r::double r, greatest(b, g, r)::double v, (greatest(b, g, r) - least(b, g, r))::double d from pixels)))"""

QUERIES = {
    "flagship_foreground": (px(S.foreground_counts), oracle(CLIPS + ranges_sql() + f" select clip_id, frame, count(*) filter (not {hit()}) fg from pixels p group by 1, 2", "pixels")),
    "a1_read_pixels": (lambda s, d: stats(X.wall(s, d)), oracle(stats_sql("select * from wall", *"bgra"), "wall")),
    "b1_parse_color": (_parse, f"""select s_suppkey, text, x[1]::int c0, x[2]::int c1, x[3]::int c2, x[4]::int c3 from (select s_suppkey, text, case text when '#ff8000' then [0, 128, 255] when '#0f8' then [136, 255, 0] when '1,2,3' then [1, 2, 3]
  when 'transparent' then [0, 0, 0, 0] when '300,-4,5,6' then [300, -4, 5] when ' 7 , 8, 9' then [7, 8, 9] end x from (select s_suppkey, string_split('{COLORS}', '|')[s_suppkey % 9 + 1] text from supplier))"""),
    "b2_parse_color_rgba": (_rgba, "select s_suppkey, case when k then 0 else v // 65536 end::int r, case when k then 0 else v // 256 % 256 end::int g, case when k then 0 else v % 256 end::int b, case when k then 0 else 255 end a from (select s_suppkey, s_suppkey % 3 = 0 k, s_suppkey * 4099 % 16777216 v from supplier)"),
    "b3_in_range": (px(lambda p: stats(P.in_range(p, (100, 90, 80), (150, 160, 170)))), oracle(stats_sql("select *, case when b between 100 and 150 and g between 90 and 160 and r between 80 and 170 then 255 else 0 end m from pixels", "m"), "pixels")),
    "b4_color_distance": (px(lambda p: P.color_distance(p, TARGET).groupBy("clip_id", "frame").agg(F.round(F.sum("d"), 4).alias("total"))), oracle("select clip_id, frame, round(sum(sqrt((b - 120) ** 2 + (g - 130) ** 2 + (r - 110) ** 2)), 4) total from pixels group by 1, 2", "pixels")),
    "b5_threshold": (px(lambda p: stats(P.threshold(p.withColumn("m", F.col("b")), 127))), oracle(stats_sql("select *, case when b > 127 then 255 else 0 end m from pixels", "m"), "pixels")),
    "b6_mask_and": (lambda s, d: stats(P.mask_and(pmask(s, d), _pm2(s, d))), oracle(PM + stats_sql("select clip_id, frame, y, x, pm.m & pm2.m m from pm join pm2 using (clip_id, frame, y, x)", "m"), "pixels")),
    "b6_mask_or": (lambda s, d: stats(P.mask_or(pmask(s, d), _pm2(s, d))), oracle(PM + stats_sql("select clip_id, frame, y, x, coalesce(pm.m, 0) | coalesce(pm2.m, 0) m from pm full join pm2 using (clip_id, frame, y, x)", "m"), "pixels")),
    "b6_mask_not": (lambda s, d: stats(P.mask_not(pmask(s, d))), oracle(PM + stats_sql("select clip_id, frame, y, x, 255 - m m from pm", "m"), "pixels")),
    "b7_split_channels": (px(lambda p: P.split_channels(p).groupBy("clip_id", "channel").agg(F.sum("value").alias("total"))), oracle("select clip_id, channel, sum(value)::bigint total from (unpivot pixels on b, g, r, a into name channel value value) group by 1, 2", "pixels")),
    "b7_merge_channels": (px(lambda p: stats(P.merge_channels(P.split_channels(p).where("channel <> 'a'")))), oracle(stats_sql("select clip_id, frame, y, x, b, g, r, 255 a from pixels", *"bgra"), "pixels")),
    "b8_bgr_to_hsv": (px(lambda p: stats(P.bgr_to_hsv(p))), oracle(", " + HSV + stats_sql("select * from hsv", *"hsv"), "pixels")),
    "b9_bgr_to_gray": (px(lambda p: stats(P.bgr_to_gray(p))), oracle(stats_sql("select *, cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) as int) gray from pixels", "gray"), "pixels")),
    "b10_recolor": (px(lambda p: stats(P.recolor(p, TARGET, NEW))), oracle(stats_sql("select clip_id, frame, y, x, case when k then 1 else b end b, case when k then 2 else g end g, case when k then 3 else r end r, a from (select *, b between 90 and 150 and g between 100 and 160 and r between 80 and 140 k from pixels)", *"bgra"), "pixels")),
    **{f"b11_blend_{m}": (px(lambda p, m=m: stats(P.blend(p, SHIFT(p), m))), _blend_sql(m)) for m in ("add", "multiply", "screen", "overlay", "half")},
    "b12_composite_opaque": (mo(lambda p: stats(P.composite_opaque(p, SHIFT(p)))), oracle(", pixels as (select * from mosaic)" + NEXT + stats_sql("select p.clip_id, p.frame, p.y, p.x, " + ", ".join(f"cast(floor({c} * (a / 255.0::double) + {c}2 * (1 - a / 255.0::double)) as int) {c}" for c in "bgr") + ", 255 a from mosaic p join nx using (clip_id, frame, y, x)", *"bgra"), "mosaic")),
    "b13_composite_over": (mo(lambda p: stats(P.composite_over(p, SHIFT(p)))), oracle(", pixels as (select * from mosaic)" + NEXT + stats_sql(OVER_SQL.format(cols=OVER_COLS, fg="mosaic", bg="nx"), *"bgra"), "mosaic")),
    "b14_composite_stack": (mo(lambda p: stats(P.composite_stack(p, SHIFT(p), p.where("frame = 0").drop("frame")))), oracle(
        ", pixels as (select * from mosaic)" + NEXT + ", one as (" + OVER_SQL.format(cols=OVER_COLS, fg="mosaic", bg="nx") + "), pl as (select clip_id, f.frame, y, x, b b2, g g2, r r2, a a2 from mosaic, (select distinct frame from mosaic) f where mosaic.frame = 0)" + stats_sql(OVER_SQL.format(cols=OVER_COLS, fg="one", bg="pl"), *"bgra"), "mosaic")),
    **{f"b15_orient_{k}": (mo(lambda p, k=k: stats(P.orient(p, k))), oracle(MCLIPS + stats_sql(f"select clip_id, frame, ({ny})::int y, ({nx})::int x, b, g, r, a from mosaic join clips using (clip_id)", *"bgra"), "mosaic")) for k, (ny, nx) in ORIENT.items()},
    "b16_split_layers": (lambda s, d: stats(P.split_layers(X.pixels(s, d), _pm2(s, d))), oracle(PM + stats_sql("select clip_id, frame, y, x, b, g, r, coalesce(pm2.m, 0) a from pixels left join pm2 using (clip_id, frame, y, x)", *"bgra"), "pixels")),
    "f13_densify": (mo(lambda p: stats(P.densify(p))), oracle(DENSE + stats_sql("select * from dense", *"bgra"), "mosaic")),
    "c1_color_ranges": (px(lambda p: C.color_ranges(C.border_color(p), 8, 25)), oracle(CLIPS + ranges_sql(25, 8) + " select clip_id, ord, b, g, r, t tolerance from ranges", "pixels")),
    "c2_corner_samples": (px(lambda p: C.corner_samples(p, 3)), oracle(CLIPS + """, picks as (select clip_id, w, h, k, f from clips, lateral (select * from (values (0, 0), (1, 1), (2, n - 1)) v(k, f) where f < n)), cs as (select p.clip_id, k * 4 + c ord, b, g, r from pixels p join picks q on q.clip_id = p.clip_id and q.f = p.frame, (values (0), (1), (2), (3)) cc(c)
  where case when c < 2 then y < 3 else y >= h - 3 end and case when c % 2 = 0 then x < 3 else x >= w - 3 end) select clip_id, ord, cast(floor(avg(b)) as int) b, cast(floor(avg(g)) as int) g, cast(floor(avg(r)) as int) r from cs group by 1, 2""", "pixels")),
    "c3_cluster_colors": (px(lambda p: C.cluster_colors(C.corner_samples(p, 3), 12)), oracle(CLIPS + CORNERS + clusters_sql(12) + " select clip_id, (i - 1)::int ord, " + CENTRE + " from (select clip_id, unnest(acc) c, unnest(range(1, len(acc) + 1)) i from final)", "pixels")),
    "c4_background_color": (px(lambda p: C.background_color(p, 3)), oracle(CLIPS + CORNERS + clusters_sql(30) + " select clip_id, " + CENTRE + " from (select clip_id, acc[1] c from final)", "pixels")),
    "c5_border_color": (px(lambda p: C.border_color(p)), oracle(CLIPS + ", " + border_sql("clip_id") + " select * from bd", "pixels")),
    "c6_dominant_color": (mo(C.dominant_color), oracle(", p as (select * from mosaic where frame = 0 and a > 0) select clip_id, printf('#%02x%02x%02x', floor(median(r))::int, floor(median(g))::int, floor(median(b))::int) hex from p group by 1", "mosaic")),
    "c7_frame_stats": (mo(lambda p: C.frame_stats(p).select("clip_id", "frame", *(F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "bgr"), "min_v", "max_v", "fg", "bbox_x", "bbox_y", "bbox_width", "bbox_height")), oracle("""select clip_id, frame, round(avg(b), 6) mean_b, round(avg(g), 6) mean_g, round(avg(r), 6) mean_r, min(least(b, g, r)) min_v, max(greatest(b, g, r)) max_v, count(*) filter (a > 0) fg,
  coalesce(min(x) filter (a > 0), 0) bbox_x, coalesce(min(y) filter (a > 0), 0) bbox_y, coalesce(max(x) filter (a > 0) - min(x) filter (a > 0) + 1, 0) bbox_width, coalesce(max(y) filter (a > 0) - min(y) filter (a > 0) + 1, 0) bbox_height from mosaic group by 1, 2""", "mosaic")),
    "c8_crop": (px(lambda p: stats(C.crop(p, C.frame_stats(p, F.col("b") > 170)))), oracle(", bb as (select clip_id, frame, min(x) x0, min(y) y0, max(x) x1, max(y) y1 from pixels where b > 170 group by 1, 2)" + stats_sql("select clip_id, frame, y - y0 y, x - x0 x, b, g, r, a from pixels join bb using (clip_id, frame) where x between x0 and x1 and y between y0 and y1", *"bgra"), "pixels")),
    "d1_key_mask": (px(lambda p: stats(S.key_mask(p, C.color_ranges(C.border_color(p))))), oracle(CLIPS + ranges_sql() + " " + stats_sql(f"select clip_id, frame, y, x, case when {hit()} then 0 else 255 end m from pixels p", "m"), "pixels")),
    "d2_key_mask_adaptive": (px(lambda p: stats(S.key_mask(p, adaptive=True))), oracle(CLIPS + ", " + border_sql("clip_id, frame") + stats_sql("select clip_id, frame, p.y, p.x, case when " + " and ".join(f"p.{c} between greatest(0, q.{c} - 30) and least(255, q.{c} + 30)" for c in "bgr") + " then 0 else 255 end m from pixels p join bd q using (clip_id, frame)", "m"), "pixels")),
    "d3_hsv_mask": (px(lambda p: stats(S.hsv_mask(p, p.select("clip_id").distinct().withColumns({"b": F.lit(0), "g": F.lit(200), "r": F.lit(40), "tolerance": F.lit(25)})))), oracle(", " + HSV + stats_sql("select *, case when h between 29 and 79 and s >= 50 and v >= 50 then 255 else 0 end m from hsv", "m"), "pixels")),
    "d4_bgr_mask": (px(lambda p: stats(S.bgr_mask(p, C.color_ranges(C.border_color(p))))), oracle(CLIPS + ranges_sql() + " " + stats_sql(f"select clip_id, frame, y, x, case when {hit()} then 255 else 0 end m from pixels p", "m"), "pixels")),
    "d5_mask_to_alpha": (lambda s, d: stats(S.mask_to_alpha(X.pixels(s, d), pmask(s, d))), oracle(PM + stats_sql("select clip_id, frame, y, x, b, g, r, m a from pixels join pm using (clip_id, frame, y, x)", *"bgra"), "pixels")),
    "d6_motion_region": (px(lambda p: S.motion_region(p, 30, 40, 3)), oracle(""", gr as (select clip_id, frame, y, x, cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) as int) v from pixels where frame <= 30), df as (select clip_id, y, x, abs(v - lag(v) over (partition by clip_id, y, x order by frame)) d from gr),
  mv as (select clip_id, y, x, case when coalesce(max(d), 0) > 40 then 255 else 0 end m from df group by 1, 2, 3) select p.clip_id, p.y, p.x, max(q.m)::int m from mv p join mv q on q.clip_id = p.clip_id and abs(q.y - p.y) <= 3 and abs(q.x - p.x) <= 3 group by 1, 2, 3""", "pixels")),
    "d7_edge_cleanup": (lambda s, d: stats(S.edge_cleanup(mmask(s, d), 1)), oracle(DENSE + stats_sql(box_sql("dense", 1, "min"), "m"), "mosaic")),
    "d8_soft_edges": (lambda s, d: stats(S.soft_edges(mmask(s, d), 1)), oracle(DENSE + ", dl as (" + box_sql("dense", 1, "max") + ")" + stats_sql("select clip_id, frame, y, x, cast(floor(255 * (dense.m / 255.0::double + (dl.m / 255.0::double - dense.m / 255.0::double) * 0.5::double)) as int) m from dense join dl using (clip_id, frame, y, x)", "m"), "mosaic")),
    "d9_dilate": (lambda s, d: stats(S.dilate(mmask(s, d), 4)), oracle(DENSE + stats_sql(box_sql("dense", 2, "max"), "m"), "mosaic")),
    "d10_erode": (lambda s, d: stats(S.erode(mmask(s, d), 3, 2)), oracle(DENSE + stats_sql(box_sql("dense", 2, "min"), "m"), "mosaic")),
    "d11_gaussian_blur": (mo(lambda p: stats(S.gaussian_blur(P.densify(p), 5))), oracle(DENSE + blur_sql("bgra") + stats_sql("select * from blur", *"bgra"), "mosaic")),
    "d14_missed_pixels": (lambda s, d: S.missed_pixels(X.pixels(s, d), pmask(s, d), C.color_ranges(C.border_color(X.pixels(s, d)), 3), 15).groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n")), oracle(CLIPS + ranges_sql(25, 3) + PM + f" select clip_id, frame, count(*) n from pixels p join pm using (clip_id, frame, y, x) where m > 0 and {hit(tol='15')} group by 1, 2", "pixels")),
    "d15_missed_blocks": (lambda s, d: S.missed_blocks(X.pixels(s, d), pmask(s, d), C.color_ranges(C.border_color(X.pixels(s, d)), 3), None, 4), oracle(CLIPS + ranges_sql(25, 3) + PM + f""" select clip_id, frame, "by", bx, fg, bg from (select clip_id, frame, y // 4 "by", x // 4 bx, count(*) filter (m > 0) fg, count(*) filter (m > 0 and {hit()}) bg from pixels p join pm using (clip_id, frame, y, x) group by 1, 2, 3, 4) where fg > 0 and bg > 0.5 * fg""", "pixels")),
    "d16_connected_regions": (lambda s, d: S.connected_regions(pmask(s, d, 150)).groupBy("clip_id", "frame", "label").agg(F.count(F.lit(1)).alias("area")), oracle(regions_sql("select * from pixels where b > 150") + " select clip_id, frame, label, count(*) area from labels group by 1, 2, 3", "pixels")),
    "d17_missed_regions": (lambda s, d: S.missed_regions(X.pixels(s, d), pmask(s, d), C.color_ranges(C.border_color(X.pixels(s, d)), 3), None, 20).groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n")), oracle(
        CLIPS + ranges_sql(25, 3) + PM + ", dl as (" + box_sql("pm", 2, "max") + ")" + regions_sql("select * from dl where m > 0") + f""", ar as (select clip_id, frame, label, count(*) n, count(*) filter ({hit()}) bg from labels join pixels p using (clip_id, frame, y, x) group by 1, 2, 3)
        select clip_id, frame, sum(n)::bigint n from ar where n >= 20 and bg > 0.4 * n group by 1, 2""", "pixels")),
    "d18_refine": (lambda s, d: stats(S.refine(X.pixels(s, d), pmask(s, d), C.border_color(X.pixels(s, d)))), oracle(
        CLIPS + ranges_sql(25, 3) + PM + ", dl as (" + box_sql("pm", 2, "max") + ")" + regions_sql("select * from dl where m > 0") + f""", ar as (select clip_id, frame, label, count(*) n, count(*) filter ({hit(tol='45')}) bg from labels join pixels p using (clip_id, frame, y, x) group by 1, 2, 3),
        gone as (select clip_id, frame, y, x from pixels p join pm using (clip_id, frame, y, x) where m > 0 and {hit(tol='45')} union select clip_id, frame, y, x from labels join ar using (clip_id, frame, label) where n >= 50 and bg > 0.4 * n)"""
        + stats_sql("select clip_id, frame, y, x, case when g.clip_id is null then m else 0 end m from pm left join (select *, 1 k from gone) g using (clip_id, frame, y, x)".replace("case when g.clip_id is null then m", "case when k is null then m"), "m"), "pixels")),
    "d20_character_alpha": (px(lambda p: stats(S.character_alpha(p.where("frame = 0")))), oracle(", p0 as (select * from pixels where frame = 0)" + CLIPS.replace("from pixels", "from p0") + ranges_sql().replace("from pixels p", "from p0 p") + " " + stats_sql(f"select clip_id, frame, y, x, case when {hit()} then 0 else 255 end m from p0 p", "m"), "pixels")),
    "e2_glow": (mo(lambda p: stats(S.glow(p, (10, 200, 250), 2, 1.5))), oracle(DENSE + blur_sql("a") + ", halo as (select clip_id, frame, y, x, 10 b2, 200 g2, 250 r2, cast(floor(least(255.0, a * 1.5::double)) as int) a2 from blur)" + stats_sql(OVER_SQL.format(cols=OVER_COLS, fg="dense", bg="halo"), *"bgra"), "mosaic")),
}


def _pm2(spark, d):
    p = X.pixels(spark, d)
    return p.where("g > 100").select(*P.KEY, F.when(F.col("g") > 127, 255).otherwise(0).alias("m"))


_offsets = ", ".join(f"({dy}, {dx})" for dy, dx in S.ellipse(2))
_far = "sqrt(" + " + ".join(f"(p.{c} - q.{c}) ** 2" for c in "bgr") + ") > {t}"
_motion = ", gr as (select clip_id, frame, y, x, cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) as int) v from pixels where frame <= 30), df as (select clip_id, y, x, abs(v - lag(v) over (partition by clip_id, y, x order by frame)) d from gr), mv as (select clip_id, y, x, case when coalesce(max(d), 0) > 15 then 255 else 0 end m from df group by 1, 2, 3), mot as (select p.clip_id, p.y, p.x, max(q.m)::int m from mv p join mv q on q.clip_id = p.clip_id and abs(q.y - p.y) <= 15 and abs(q.x - p.x) <= 15 group by 1, 2, 3)"
_moving = ", mc0 as (select p.clip_id, p.frame, p.y, p.x, case when " + _far.format(t=25) + " and mot.m > 0 then 255 else 0 end m from pixels p join bd q using (clip_id) join mot on (mot.clip_id, mot.y, mot.x) = (p.clip_id, p.y, p.x)), mc as (" + box_sql("mc0", 2, "max") + ")"
_keyed = f", ck as (select clip_id, frame, y, x, case when {hit()} then 0 else 255 end m from pixels p)"


def _bg(p):
    return C.border_color(p)


QUERIES |= {
    "d12_motion_color_mask": (px(lambda p: stats(S.motion_color_mask(p, S.motion_region(p), _bg(p), 25))), oracle(CLIPS + ", " + border_sql("clip_id") + _motion + _moving + stats_sql("select * from mc", "m"), "pixels")),
    "d13_combined_mask": (px(lambda p: stats(S.combined_mask(S.key_mask(p, C.color_ranges(_bg(p))), S.motion_color_mask(p, S.motion_region(p), _bg(p), 25)))), oracle(CLIPS + ranges_sql() + _motion + _moving + _keyed + stats_sql("select clip_id, frame, y, x, ck.m | mc.m m from ck join mc using (clip_id, frame, y, x)", "m"), "pixels")),
    "d19_remove_background": (px(lambda p: stats(S.remove_background(p, _bg(p), "combined"))), oracle(CLIPS + ranges_sql() + _motion + _moving + _keyed + stats_sql("select clip_id, frame, y, x, b, g, r, ck.m | mc.m a from ck join mc using (clip_id, frame, y, x) join pixels using (clip_id, frame, y, x)", *"bgra"), "pixels")),
    "e1_outline": (mo(lambda p: stats(S.outline(p, (10, 200, 250), 2))), oracle(DENSE + f", gw as (select clip_id, frame, y + dy y, x + dx x, max(a) d from dense, (values {_offsets}) k(dy, dx) where a > 0 group by 1, 2, 3, 4)" + stats_sql(
        "select clip_id, frame, y, x, " + ", ".join(f"cast(floor(least(255.0, ({c} * fa + {v} * ba * (1 - fa)) / (fa + ba * (1 - fa) + 1e-6::double))) as int) {c}" for c, v in zip("bgr", (10, 200, 250), strict=True)) + ", cast(floor(least(255.0, (fa + ba * (1 - fa)) * 255)) as int) a from (select dense.*, a / 255.0::double fa, coalesce(d, 0) / 255.0::double ba from dense left join gw using (clip_id, frame, y, x))", *"bgra"), "mosaic")),
}
