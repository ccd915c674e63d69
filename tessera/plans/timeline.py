"""Queries of the geometry, timing and loop operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import loops as L
from ..operators.pixels import KEY
from ..sources import fixtures as X
from ..sources.fixtures import oracle
from .frames import BLEND_SQL, px, stats, stats_sql

COUNTS = ", c as (select clip_id, max(frame) + 1 n from signal group by 1)"
PCOUNTS = ", c as (select clip_id, max(frame) + 1 n from pixels group by 1)"


def sig(fn):
    return lambda spark, d: fn(X.signal(spark, d)).select("clip_id", "frame", "value")


def index_sql(m: str, src: str, table: str = "signal", counts: str = COUNTS) -> str:
    """Frames by an index of m rows a clip whose sources are ``src`` of i and n."""
    return oracle(counts + f", ix as (select clip_id, i::int frame, ({src})::int s from c, lateral (select unnest(range(0, ({m})::bigint)) i)) select ix.clip_id, ix.frame, t.value from ix join {table} t on t.clip_id = ix.clip_id and t.frame = ix.s", "signal")


def axis_sql(name: str, size: str, to: str) -> str:
    return f"ax_{name} as (select clip_id, t, unnest([lo, least(lo + 1, {size} - 1)]) p, unnest([1 - f, f]) k from (select clip_id, {size}, t, cast(floor(s) as int) lo, s - floor(s) f from (select clip_id, {size}, t, least(greatest((t + 0.5::double) * {size} / {to} - 0.5::double, 0.0), {size} - 1.0) s from cl, lateral (select unnest(range(0, {to})) t))))"


def resize_sql(w: str, h: str) -> str:
    val = ", ".join(f"cast(round_even(round(sum({c} * ax_x.k * ax_y.k), 6), 0) as int) {c}" for c in "bgra")
    return f", cl as (select clip_id, max(x) + 1 w, max(y) + 1 h, max(frame) + 1 n from pixels group by 1), {axis_sql('x', 'w', w)}, {axis_sql('y', 'h', h)}, rs as (select p.clip_id, p.frame, ax_y.t::int y, ax_x.t::int x, {val} from pixels p join ax_x on ax_x.clip_id = p.clip_id and ax_x.p = p.x join ax_y on ax_y.clip_id = p.clip_id and ax_y.p = p.y where ax_x.k > 0 and ax_y.k > 0 group by 1, 2, 3, 4)"


GRAY = "cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) as int)"
FLOW = f", a as (select clip_id, y, x, {GRAY} v from pixels where frame = 0), b as (select clip_id, y, x, {GRAY} v from pixels where frame = 1), mv as (select dy, dx from (select unnest(range(-2, 3)) dy), (select unnest(range(-2, 3)) dx))" + """,
sad as (select a.clip_id, a.y // 4 "by", a.x // 4 bx, dy, dx, sum(abs(a.v - coalesce(b.v, 0))) s from a cross join mv left join b on b.clip_id = a.clip_id and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3, 4, 5),
flow as (select * from (select *, row_number() over (partition by clip_id, "by", bx order by s, abs(dy) + abs(dx), dy, dx) rn from sad) where rn = 1)"""
DIFF = ", df as (select clip_id, frame, avg(abs(b - pb) + abs(g - pg) + abs(r - pr)) / 3 v from (select *, lag(b) over w pb, lag(g) over w pg, lag(r) over w pr from pixels where frame < 120 window w as (partition by clip_id, y, x order by frame)) where frame > 0 group by 1, 2)"


def cycle_sql(diffs: str) -> str:
    return f""", ac as (select a.clip_id, b.frame - a.frame k, sum(a.v * b.v) s from {diffs} a join {diffs} b on a.clip_id = b.clip_id and b.frame >= a.frame group by 1, 2),
an as (select *, lag(s) over w p, lead(s) over w q, avg(s) over (partition by clip_id) m, count(*) over (partition by clip_id) len from ac window w as (partition by clip_id order by k)),
cy as (select clip_id, case when max(len) >= 9 then min(k) filter (k >= 2 and k <= len - 2 and s > p and s > q and s > m * 1.2::double) end::int cycle from an group by 1)"""


SIGDIFF = ", sd as (select clip_id, frame, value::double v from signal where frame between 1 and 119)"
MSE = "greatest(0.0, 100 - sum((p.b - q.b) ** 2 + (p.g - q.g) ** 2 + (p.r - q.r) ** 2) / (3.0 * count(*)) / 10)"
PAIR = PCOUNTS + ", d as (select pixels.*, n, case when n < 20 then n // 4 else 10 end k from pixels join c using (clip_id)), sc as (select p.clip_id, p.frame s, q.frame e, " + MSE + " score from d p join d q on p.clip_id = q.clip_id and p.y = q.y and p.x = q.x where p.frame < least(p.k, p.n - p.k) and q.frame >= greatest(q.k, q.n - q.k) group by 1, 2, 3)"
BEST = " select clip_id, case when score >= {t} then s end start_frame, case when score >= {t} then e end end_frame, round(score, 6) score from (select *, row_number() over (partition by clip_id order by score desc, s, e) rn from sc) where rn = 1"
FADE = """, d as (select p.*, n, least(5, n // 4) f from pixels p join c using (clip_id)), o as (select *, case when n >= 10 and frame >= n - 2 * f then least(1.0, (frame - (n - 2 * f)) / f::double) end ao, case when n >= 10 and frame < 2 * f then greatest(0.0, 1 - frame / f::double) end ai from d)"""


#: ``ls``: each clip's methods, the best first.
ANALYSIS = """,
        gp as (select p.clip_id, avg(abs(p.b - q.b) + abs(p.g - q.g) + abs(p.r - q.r)) / 3 fl from pixels p join c using (clip_id) join pixels q on q.clip_id = p.clip_id and q.y = p.y and q.x = p.x and q.frame = 0 where p.frame = n - 1 group by 1), am as (select clip_id, avg(v) am from df where frame < 30 group by 1),
        ms as (select c.clip_id, unnest([[case when cycle < n * 0.8 then '90' end, 'periodic'], [case when am < 20 then '80' end, 'fade'], [case when am >= 20 and fl < 30 then '85' end, 'cut'], ['70', 'pingpong'], [case when am > 50 then '65' end, 'morph']]) m from c join gp using (clip_id) join am using (clip_id) join cy using (clip_id)),
        ls as (select clip_id, list(m[2] order by m[1]::int desc) l from ms where m[1] is not null group by 1)"""


def _lerp_sql(name: str, source: str, shift: str) -> str:
    """``name``: ``source`` (clip_id, y, x, ...) read at the places of ``gr`` less ``shift`` times its flow, by bilinear weights; beyond the edge is 0."""
    at = f"select gr.*, gr.y - gr.dy * ({shift}) sy, gr.x - gr.dx * ({shift}) sx from gr"
    cols = ", ".join(f"cast(round_even(round(coalesce(sum({c} * k), 0), 6), 0) as int) {c}" for c in "bgra")
    return f""", {name} as (select q.clip_id, q.i, q.y, q.x, {cols} from (select *, floor(sy)::int + j py, floor(sx)::int + h px, (case j when 0 then 1 - (sy - floor(sy)) else sy - floor(sy) end) * (case h when 0 then 1 - (sx - floor(sx)) else sx - floor(sx) end) k
from ({at}), (select unnest([0, 1]) j), (select unnest([0, 1]) h)) q left join {source} s on s.clip_id = q.clip_id and s.y = q.py and s.x = q.px group by 1, 2, 3, 4)"""


MORPH = oracle(
    PCOUNTS + FLOW.replace("from pixels where frame = 0", "from pixels join c using (clip_id) where frame = n - 1 and n >= 10").replace("from pixels where frame = 1", "from pixels join c using (clip_id) where frame = 0 and n >= 10")
    + """, f0 as (select p.* from pixels p join c using (clip_id) where frame = 0 and n >= 10), f1 as (select p.*, n from pixels p join c using (clip_id) where frame = n - 1 and n >= 10), gr as (select p.clip_id, n, p.y, p.x, fl.dy, fl.dx, i, (i + 1) / 5.0::double t from f1 p join flow fl on fl.clip_id = p.clip_id and fl."by" = p.y // 4 and fl.bx = p.x // 4, (select unnest(range(0, 4)) i))"""
    + _lerp_sql("m1", "f1", "t") + _lerp_sql("m0", "f0", "t - 1")
    + stats_sql("select clip_id, frame, y, x, b, g, r, a from pixels union all select clip_id, (n + i)::int, y, x, " + ", ".join(f"cast(round_even(m1.{c} * (1 - t) + m0.{c} * t, 0) as int)" for c in "bgra") + " from gr join m1 using (clip_id, i, y, x) join m0 using (clip_id, i, y, x)", *"bgra"),
    "pixels",
)


def _fade(c: str, v: int) -> str:
    one = lambda e, a: f"case when {a} is null then {e} else cast(round_even(round({e} * (1 - {a}) + {v} * {a}, 6), 0) as int) end"
    return one(f"({one(c, 'ao')})", "ai") + f" {c}"


def _sim(p):
    return L.frame_similarity(p, p.withColumn("frame", F.col("frame") - 1)).select("clip_id", "frame", F.round("score", 6).alias("score"))


def _concat(s, d):
    """Chunks of ten frames, numbered from the last to the first, put back in order."""
    p = X.signal(s, d).withColumn("chunk", F.floor(F.col("frame") / 10).cast("int"))
    chunks = p.groupBy("clip_id", "chunk").agg((F.max("chunk") * 10).alias("start_frame"), F.count(F.lit(1)).alias("total"))
    return G.concat_clips(p.withColumn("frame", F.col("frame") % 10), chunks).select("clip_id", "frame", "value")


def _plan(s, d):
    e = s.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    rows = e.select(k.alias("clip_id"), F.when(k % 3 == 0, "video").when(k % 3 == 1, "rig").otherwise("image").alias("kind"), F.when(k % 2 == 0, k).cast("int").alias("probed"), F.when(k % 4 == 1, (k % 50)).cast("int").alias("opt_frames"), F.when(k % 5 < 3, k / F.lit(8.0)).alias("duration_s"), F.when(k % 7 == 0, 8.0).alias("fps"))
    return G.frame_plan(rows)


def _ramp(f: float) -> str:
    m = f"(case when n < 4 then n else floor(n * {f}::double) end)"
    return index_sql(m, f"case when n < 4 then i when i = {m} - 1 then n - 1 else floor(i * ((n - 1)::double / ({m} - 1))) end")


def _flow(p):
    v = p.withColumn("v", L.gray_column())
    return G.block_match_flow(v.where("frame = 0"), v.where("frame = 1"))


QUERIES = {
    "a2_scan_range": (lambda s, d: G.scan_range(X.signal(s, d), G.frame_counts(X.signal(s, d)).select("clip_id", F.col("n").alias("total_frames"), (F.col("clip_id") % 90).cast("int").alias("start"), F.when(F.col("clip_id") % 3 == 0, F.col("clip_id") % 70 - 5).cast("int").alias("end"))).select("clip_id", "frame", "value"), oracle(
        COUNTS + ", b as (select clip_id, n, clip_id % 90 s, case when clip_id % 3 = 0 then clip_id % 70 - 5 end e from c), bb as (select clip_id, s, least(case when e is null or e < 0 then n - 1 else e end, n - 1) e from b) select clip_id, frame, value from signal join bb using (clip_id) where frame between greatest(0, least(s, greatest(e, 0))) and e", "signal")),
    "f1_resize": (px(lambda p: stats(G.resize(p, 5, 12))), oracle(resize_sql("5", "12") + " " + stats_sql("select * from rs", *"bgra"), "pixels")),
    "f1_resize_keep_aspect": (px(lambda p: stats(G.resize(p, 4, -1))), oracle(resize_sql("4", "4") + " " + stats_sql("select * from rs", *"bgra"), "pixels")),
    "f2_pad": (px(lambda p: stats(G.pad(p, 12, 6))), oracle(resize_sql("6", "6") + " " + stats_sql("select cl.clip_id, f::int frame, yy::int y, xx::int x, coalesce(b, 0) b, coalesce(g, 0) g, coalesce(r, 0) r, coalesce(a, 0) a from cl, lateral (select unnest(range(0, n)) f), lateral (select unnest(range(0, 6)) yy), lateral (select unnest(range(0, 12)) xx) left join (select clip_id ci, frame fr, y ry, x + 3 rx, b, g, r, a from rs) on ci = cl.clip_id and fr = f and ry = yy and rx = xx", *"bgra"), "pixels")),
    "f3_trim": (sig(lambda p: G.trim(p, 24, 0.5, None, 1.0)), oracle("select clip_id, frame - 12 frame, value from signal where frame / 24.0::double >= 0.5 and frame / 24.0::double < 1.5", "signal")),
    "f4_retime_drop": (sig(lambda p: G.retime_drop(p, 30, 12)), index_sql("round_even(n * (12::double / 30), 0)", "least(n - 1, round_even(i * (30::double / 12), 0))")),
    "f5_retime_repeat": (sig(lambda p: G.retime_repeat(p, 12, 30)), index_sql("round_even(n * (30::double / 12), 0)", "least(n - 1, round_even(i * (12::double / 30), 0))")),
    "f6_retime_interpolate": (lambda s, d: G.retime_interpolate(X.signal(s, d).withColumn("value", F.col("value").cast("double")), 12, 30, ("value",)).select("clip_id", "frame", F.round("value", 6).alias("value")), oracle(
        COUNTS + ", ix as (select clip_id, n, i::int frame, least(n - 1.0, i * (12::double / 30)) s from c, lateral (select unnest(range(0, round_even(n * (30::double / 12), 0)::bigint)) i)) select ix.clip_id, ix.frame, round(lo.value::double * (1 - (s - floor(s))) + hi.value::double * (s - floor(s)), 6) as value from ix join signal lo on lo.clip_id = ix.clip_id and lo.frame = floor(s) join signal hi on hi.clip_id = ix.clip_id and hi.frame = least(n - 1, floor(s) + 1)", "signal")),
    "f7_block_match_flow": (px(_flow), oracle(FLOW + ' select clip_id, "by", bx, dy::int dy, dx::int dx from flow', "pixels")),
    "f8_concat_clips": (_concat, oracle("select clip_id, frame, value from signal", "signal")),
    "f9_frame_chunks": (lambda s, d: G.frame_chunks(G.frame_counts(X.signal(s, d)).withColumnRenamed("n", "total_frames"), None, 1), oracle(COUNTS + ", z as (select clip_id, n, greatest(10, n // 4) s from c) select clip_id, k::int chunk, (k * s)::int start_frame, (least(k * s + s, n) - 1)::int end_frame from z, lateral (select unnest(range(0, (n + s - 1) // s)) k)", "signal")),
    "f10_pipeline": (sig(lambda p: G.pipeline(p, [(G.trim, {"fps": 10.0, "start": 1.0, "end": 3.0}), (L.reverse_loop, {})])), oracle(", t as (select clip_id, frame - 10 frame, value from signal where frame between 10 and 29), c as (select clip_id, max(frame) + 1 n from t group by 1), ix as (select clip_id, i::int frame, (case when i < n then i else 2 * n - 1 - i end)::int s from c, lateral (select unnest(range(0, 2 * n)) i)) select ix.clip_id, ix.frame, t.value from ix join t on t.clip_id = ix.clip_id and t.frame = ix.s", "signal")),
    "f11_per_frame": (px(lambda p: stats(G.per_frame(p, _invert))), oracle(stats_sql("select clip_id, frame, y, x, 255 - b b, g, r, a from pixels", *"bgra"), "pixels")),
    "f12_frame_plan": (_plan, """select s_suppkey clip_id, n::int total_frames, fps, case when n <= 0 then 'no frames' end error from (select s_suppkey, fps, case s_suppkey % 3 when 2 then 1 when 0 then coalesce(case when s_suppkey % 2 = 0 then s_suppkey end, 0) else coalesce(case when s_suppkey % 4 = 1 then s_suppkey % 50 end, case when s_suppkey % 5 < 3 then round_even(s_suppkey / 8.0::double * fps, 0) end, 0) end n from (select s_suppkey, case when s_suppkey % 7 = 0 then 8.0 else 24.0 end::double fps from supplier))"""),
    "g1_pingpong": (sig(L.pingpong), index_sql("case when n < 2 then n else 2 * n - 1 end", "case when i < n then i else 2 * n - 2 - i end")),
    "g1_pingpong_until": (sig(lambda p: L.pingpong(p, 10, -2.5)), index_sql("case when n - greatest(0, n - 25) < 2 then n else 2 * n - 1 - greatest(0, n - 25) end", "case when i < n then i else 2 * n - 2 - i end")),
    "g2_reverse_loop": (sig(L.reverse_loop), index_sql("2 * n", "case when i < n then i else 2 * n - 1 - i end")),
    "g3_hold_loop": (sig(lambda p: L.hold_loop(p, 3)), index_sql("case when n < 4 then n else n + 3 end", "least(i, n - 1)")),
    "g4_fade_loop": (px(lambda p: stats(L.fade_loop(p, (10, 200, 30, 0), 5))), oracle(PCOUNTS + FADE + stats_sql("select clip_id, frame, y, x, " + ", ".join(_fade(c, v) for c, v in zip("bgra", (10, 200, 30, 0), strict=True)) + " from o", *"bgra"), "pixels")),
    **{f"g5_blend_loop_{m}": (px(lambda p, m=m: stats(L.blend_loop(p, m))), oracle(PCOUNTS + ", o as (select p.clip_id, p.frame, p.y, p.x, p.b, p.g, p.r, p.a from pixels p join c using (clip_id) where frame < n - 5 union all select p.clip_id, (p.frame - 5 + n)::int, p.y, p.x, p.b, p.g, p.r, p.a from pixels p join c using (clip_id) where frame >= 5 union all select p.clip_id, (n - 5 + q.frame)::int, p.y, p.x, " + ", ".join("cast(floor(least(255.0, greatest(0.0, " + BLEND_SQL[m].replace("case", "CASE").replace("x", f"p.{c}::double").replace("y", f"q.{c}::double") + "))) as int)" for c in "bgra") + " from pixels p join c using (clip_id) join pixels q on q.clip_id = p.clip_id and q.y = p.y and q.x = p.x and q.frame < 5 and p.frame = n - 1 - q.frame) " + stats_sql("select * from o", *"bgra"), "pixels")) for m in ("add", "screen")},
    "g6_speedramp_fast": (sig(lambda p: L.speedramp(p, 0.6)), _ramp(0.6)),
    "g6_speedramp_slow": (sig(lambda p: L.speedramp(p, 1.7)), _ramp(1.7)),
    "g7_morph_loop": (px(lambda p: stats(L.morph_loop(p, 4))), MORPH),
    "g8_periodic_loop": (lambda s, d: L.periodic_loop(X.signal(s, d), X.signal(s, d).where("frame > 0").withColumn("value", F.col("value").cast("double"))).select("clip_id", "frame", "value"), oracle(COUNTS + SIGDIFF + cycle_sql("sd") + " select clip_id, frame, value from signal join c using (clip_id) left join cy using (clip_id) where frame < case when n < 10 then n else greatest(1, least(case when cycle is null or cycle >= n then n // 2 else cycle end, n - 1)) end", "signal")),
    "g9_frame_diff_signal": (px(lambda p: L.frame_diff_signal(p, 120).select("clip_id", "frame", F.round("value", 6).alias("value"))), oracle(DIFF + " select clip_id, frame, round(v, 6) as value from df", "pixels")),
    "g10_detect_cycle": (lambda s, d: L.detect_cycle(X.signal(s, d).where("frame > 0").withColumn("value", F.col("value").cast("double"))), oracle(SIGDIFF + cycle_sql("sd") + " select clip_id, cycle from cy", "signal")),
    "g11_analyze_loop": (px(lambda p: L.analyze_loop(p).select("clip_id", "recommended", "alternatives", "frame_count", F.round("first_last_diff", 6).alias("first_last_diff"), F.round("avg_motion", 6).alias("avg_motion"), "detected_cycle")), oracle(PCOUNTS + DIFF + cycle_sql("df") + ANALYSIS + """
        select clip_id, l[1] recommended, array_to_string(l[2:4], ',') alternatives, n::int frame_count, round(fl, 6) first_last_diff, round(am, 6) avg_motion, cycle detected_cycle from ls join c using (clip_id) join gp using (clip_id) join am using (clip_id) join cy using (clip_id)""", "pixels")),
    "h13_remap": (px(lambda p: stats(G.remap(p, p.select(*KEY, (7 - F.col("y") + 0.25).alias("sy"), (F.col("x") - 0.5).alias("sx"))))), oracle(", nb as (select clip_id, frame, 7 - (y + j) y, x - i + 1 x, b, g, r, a, (case j when 0 then 0.75 else 0.25 end * 0.5)::double w from pixels, (select unnest([0, -1]) j), (select unnest([0, 1]) i)) select clip_id, frame, count(*) n, "
        + ", ".join(f"sum({c} * (y * 67 + x + 1))::bigint s_{c}" for c in "bgra") + " from (select p.clip_id, p.frame, p.y, p.x, " + ", ".join(f"round_even(round(coalesce(sum(nb.{c} * nb.w), 0), 6), 0)::int {c}" for c in "bgra") + " from pixels p left join nb using (clip_id, frame, y, x) group by 1, 2, 3, 4) group by 1, 2", "pixels")),
    "g12_frame_similarity": (px(_sim), oracle(f"select p.clip_id, p.frame, round({MSE}, 6) score from pixels p join pixels q on q.clip_id = p.clip_id and q.frame = p.frame + 1 and q.y = p.y and q.x = p.x group by 1, 2", "pixels")),
    "g13_flow_similarity": (px(lambda p: L.frame_similarity(p.where("frame = 0"), p.where("frame = 1"), ("clip_id",), "flow").select("clip_id", F.round("score", 6).alias("score"))), oracle(FLOW + " select clip_id, round(greatest(0.0, 100 - 5 * avg(sqrt((dy * dy + dx * dx)::double))), 6) score from flow group by 1", "pixels")),
    "g14_best_loop_points": (px(lambda p: L.best_loop_points(p, 10, 40).withColumn("score", F.round("score", 6))), oracle(PAIR + BEST.format(t=40), "pixels")),
    "g15_best_match_point": (px(lambda p: L.best_match_point(p, p.withColumn("clip_id", (F.col("clip_id") + 1) % 10), 30).withColumn("score", F.round("score", 6))), oracle(f", sc as (select p.clip_id, p.frame s, q.frame e, {MSE} score from pixels p join pixels q on p.clip_id = (q.clip_id + 1) % 10 and p.y = q.y and p.x = q.x group by 1, 2, 3)" + BEST.format(t=30), "pixels")),
    "g16_make_loop": (px(lambda p: stats(L.make_loop(p, "reverse"))), oracle(PCOUNTS + ", ix as (select clip_id, i::int frame, (case when i < n then i else 2 * n - 1 - i end)::int s from c, lateral (select unnest(range(0, 2 * n)) i)) " + stats_sql("select ix.clip_id, ix.frame, y, x, b, g, r, a from ix join pixels t on t.clip_id = ix.clip_id and t.frame = ix.s", *"bgra"), "pixels")),
    "g16_make_loop_speedramp": (px(lambda p: stats(L.make_loop(p, "speedramp", ramp_factor=1.5))), oracle(PCOUNTS + ", ix as (select clip_id, i::int frame, (case when i = m - 1 then n - 1 else floor(i * ((n - 1)::double / (m - 1))) end)::int s from (select clip_id, n, floor(n * 1.5::double)::bigint m from c), lateral (select unnest(range(0, m)) i)) " + stats_sql("select ix.clip_id, ix.frame, y, x, b, g, r, a from ix join pixels t on t.clip_id = ix.clip_id and t.frame = ix.s", *"bgra"), "pixels")),
    "g16_make_loop_hold": (px(lambda p: stats(L.make_loop(p, "hold", hold=7))), oracle(PCOUNTS + ", ix as (select clip_id, i::int frame, least(i, n - 1)::int s from c, lateral (select unnest(range(0, n + 7)) i)) " + stats_sql("select ix.clip_id, ix.frame, y, x, b, g, r, a from ix join pixels t on t.clip_id = ix.clip_id and t.frame = ix.s", *"bgra"), "pixels")),
    "g16_make_loop_fade": (px(lambda p: stats(L.make_loop(p, "fade", fade_color="#1ec80a", fade_frames=5))), oracle(PCOUNTS + FADE + stats_sql("select clip_id, frame, y, x, " + ", ".join(_fade(c, v) for c, v in zip("bgra", (30, 200, 10, 255), strict=True)) + " from o", *"bgra"), "pixels")),
    "g16_make_loop_auto": (px(lambda p: stats(L.make_loop(p))), oracle(PCOUNTS + DIFF + cycle_sql("df") + ANALYSIS + FADE.replace("least(5, n // 4)", "least(10, n // 4)").replace("n >= 10", "n >= 20") + """, way as (select c.clip_id, n, coalesce(l[1], 'hold') way, cycle from c left join ls using (clip_id) left join cy using (clip_id)),
        ix as (select clip_id, i::int frame, case when i < n then i else 2 * n - 2 - i end s from way, lateral (select unnest(range(0, case when way in ('pingpong', 'cut') then 2 * n - 1 when way = 'periodic' then greatest(1, least(case when cycle is null or cycle >= n then n // 2 else cycle end, n - 1)) else 0 end)) i)
        union all select clip_id, i::int, least(i, n - 1) from way, lateral (select unnest(range(0, case when way = 'hold' then n + 2 else 0 end)) i))"""
        + stats_sql("select ix.clip_id, ix.frame, y, x, b, g, r, a from ix join pixels p on p.clip_id = ix.clip_id and p.frame = ix.s union all select clip_id, frame, y, x, " + ", ".join(_fade(c, 0) for c in "bgra") + " from o join way using (clip_id) where way = 'fade'", *"bgra"), "pixels")),
}


def _invert(table):
    """A user's frame function: blue inverted."""
    import pyarrow.compute as pc

    at = table.schema.get_field_index("b")
    return table.set_column(at, table.schema.field(at), pc.subtract(255, table.column("b")).cast("int32"))
