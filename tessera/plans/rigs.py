"""Queries of the rig, layer and ledger operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as Y
from ..operators import ledger as J
from ..operators import rigs as R
from ..operators.geometry import upto
from ..operators.pixels import KEY
from ..sources import fixtures as X
from ..sources.fixtures import oracle
from .frames import CLIPS, DENSE, OVER_COLS, OVER_SQL, hit, mmask, mo, px, ranges_sql, stats, stats_sql

SIZE, FRAMES, FPS = 64, 48, 24.0
#: Frames of the suppliers' rigs.
CREW_FRAMES = 13


def rigs_of(spark, d):
    """A rig per region: 64x64, 48 frames at 24 a second."""
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("rig_id"), F.lit(1).alias("schema_version"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"), F.lit(FRAMES).alias("frames"), F.lit(FPS).alias("fps"))


def frames_of(spark, d):
    return rigs_of(spark, d).select("rig_id", upto(F.col("frames")).alias("frame"))


def rb(fn):
    return lambda s, d: fn(X.bones(s, d), X.keyframes(s, d))


def posed(s, d):
    return R.interpolate_poses(X.keyframes(s, d), X.bones(s, d), frames_of(s, d))


def rest(s, d):
    """Each rig's pose at the frame that its skin is bound at."""
    return R.interpolate_poses(X.keyframes(s, d), X.bones(s, d), rigs_of(s, d).select("rig_id", F.lit(0).alias("frame")))


def rounded(df, *cols, digits=6):
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if c in cols else c for c in df.columns))


def points(s, d):
    return R.grid_points(rigs_of(s, d))


def faulty(s, d):
    """Bones with planted faults: a radius 0, an unknown parent, a wrong falloff, a cycle."""
    b = X.bones(s, d)
    b = b.withColumn("radius", F.when((F.col("rig_id") == 0) & (F.col("ord") == 1), 0.0).otherwise(F.col("radius")))
    b = b.withColumn("parent_id", F.when((F.col("rig_id") == 1) & (F.col("ord") == 2), "nowhere").when(F.col("bone_id") == "R2", "N2").otherwise(F.col("parent_id")))
    return b.withColumn("falloff", F.when((F.col("rig_id") == 3), "steep").otherwise(F.col("falloff")))


RIGS = ", rigs as (select cast(r_regionkey as bigint) rig_id, 64 width, 64 height, 48 frames, 24.0::double fps from region)"
FAULTY = """, fb as (select rig_id, bone_id, ord, case when rig_id = 1 and ord = 2 then 'nowhere' when bone_id = 'R2' then 'N2' else parent_id end parent_id, case when rig_id = 0 and ord = 1 then 0.0 else radius end radius, case when rig_id = 3 then 'steep' else falloff end falloff from bones),
fc as (select rig_id, bone_id, parent_id ancestor_id from fb where parent_id is not null union select c.rig_id, c.bone_id, b.parent_id from fc c join fb b on b.rig_id = c.rig_id and b.bone_id = c.ancestor_id where b.parent_id is not null)"""
CLOSURE = ", cl as (select rig_id, bone_id, parent_id ancestor_id, 1 depth from bones where parent_id is not null union all select c.rig_id, c.bone_id, b.parent_id, depth + 1 from cl c join bones b on b.rig_id = c.rig_id and b.bone_id = c.ancestor_id where b.parent_id is not null)"


def posed_sql(frames: int = FRAMES, last: int = 36) -> str:
    """Poses at every frame; keyframes are at 0, 12 and so on up to ``last``."""
    get = lambda t, c: f"coalesce({t}.{c}, 0)"
    return f""", fr as (select rig_id, f::int frame, (least(f, {last}) // 12 * 12)::int lo, least({last}, f // 12 * 12 + 12) hi from rigs, (select unnest(range(0, {frames})) f)),
po as (select fr.rig_id, fr.frame, b.bone_id, {", ".join(f"{get('p', c)} + ({get('q', c)} - {get('p', c)}) * case when hi > lo then (least(fr.frame, {last}) - lo) / (hi - lo)::double else 0 end {c}" for c in ("rot", "tx", "ty"))}
from fr join bones b using (rig_id) left join keyframes p on p.rig_id = fr.rig_id and p.frame = fr.lo and p.bone_id = b.bone_id left join keyframes q on q.rig_id = fr.rig_id and q.frame = fr.hi and q.bone_id = b.bone_id)"""


LOCAL = ", lo as (select po.rig_id, po.frame, po.bone_id, b.parent_id, cos(rot) a, -sin(rot) b, hx - cos(rot) * hx + sin(rot) * hy + po.tx c, sin(rot) d, cos(rot) e, hy - sin(rot) * hx - cos(rot) * hy + po.ty f from po join bones b using (rig_id, bone_id))"
PRODUCT = "p.a * q.a + p.b * q.d a, p.a * q.b + p.b * q.e b, p.a * q.c + p.b * q.f + p.c c, p.d * q.a + p.e * q.d d, p.d * q.b + p.e * q.e e, p.d * q.c + p.e * q.f + p.f f"
WORLD = LOCAL + f", wo as (select rig_id, frame, bone_id, a, b, c, d, e, f from lo where parent_id is null union all select q.rig_id, q.frame, q.bone_id, {PRODUCT} from wo p join lo q on q.rig_id = p.rig_id and q.frame = p.frame and q.parent_id = p.bone_id)"
ABC = ", ".join(f"round({k}, 6) + 0 {k}" for k in "abcdef")
SEG = "case when n <= 1e-12 then sqrt(wx * wx + wy * wy) else sqrt((wx - t * vx) ** 2 + (wy - t * vy) ** 2) end"
DIST = f""", pt as (select rig_id, y::int y, x::int x from rigs, (select unnest(range(0, 64)) y), (select unnest(range(0, 64)) x)),
ds as (select *, {SEG} dist from (select *, least(1.0, greatest(0.0, (wx * vx + wy * vy) / case when n <= 1e-12 then 1 else n end)) t from (select p.rig_id, p.y, p.x, b.bone_id, b.ord, b.hx, b.hy, b.tx, b.ty, b.radius, b.falloff, b.tx - b.hx vx, b.ty - b.hy vy, p.x - b.hx wx, p.y - b.hy wy, (b.tx - b.hx) ** 2 + (b.ty - b.hy) ** 2 n from pt p join bones b using (rig_id))))"""
WEIGHTS = DIST + """, ws as (select *, sum(w) over (partition by rig_id, y, x) total, row_number() over (partition by rig_id, y, x order by dist, ord) rn from (select *, case falloff when 'hard' then (near > 0)::int::double when 'linear' then near else near ** 2 end w from (select *, least(1.0, greatest(0.0, 1 - dist / greatest(radius, 1e-6))) near from ds))),
wt as (select rig_id, y, x, bone_id, case when total > 0 then w / total else 1.0 end w from ws where (total > 0 and w > 0) or (total <= 0 and rn = 1))"""
INSIDE = ", q0 as (select clip_id, frame, y, x from dense where m = 0), dt as (select p.clip_id, p.frame, p.y, p.x, p.m, min(sqrt(((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))::double)) d from dense p join q0 q on q.clip_id = p.clip_id and q.frame = p.frame group by all)"
DISCS = ", sp as (select distinct plate_id, stroke, (y + dy)::int y, (x + dx)::int x from (select *, case when radius > 0 then radius else 12 end rr from strokes), (select unnest(range(-12, 13)) dy), (select unnest(range(-12, 13)) dx) where dy * dy + dx * dx <= rr * rr and y + dy between 0 and 63 and x + dx between 0 and 63)"
LOADED = ", ld as (select id, rig_id, greatest(0, bbox_x) x0, greatest(0, bbox_y) y0, least(64, bbox_x + bbox_width) x1, least(64, bbox_y + bbox_height) y1, greatest(1, fade) band from corrections where canvas_width = 64 and canvas_height = 64), lc as (select * from ld where x1 > x0 and y1 > y0)"
COUNTED = """, e1 as (select *, coalesce(sum((result = 'ok')::int) over w, 0) okb, coalesce(sum((result = 'failed')::int) over w, 0) fb from chunk_events window w as (partition by job_id, chunk_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
e2 as (select *, case when result = 'failed' then fb + 1 end att from e1 where okb = 0 and fb < 3), e3 as (select *, count(att) over (partition by job_id order by ts, event_id rows unbounded preceding) errors from e2),
e4 as (select *, coalesce(att < 3 and errors >= 20, false) fin from e3), e5 as (select *, coalesce(max(fin::int) over (partition by job_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) over_ from e4), ev as (select * from e5 where over_ = 0),
cs as (select job_id, chunk_id, case when bool_or(result = 'ok') then 'completed' when count(*) filter (result = 'failed') >= 3 then 'failed' else 'pending' end status from ev group by 1, 2),
jp as (select job_id, count(*) total, count(*) filter (status = 'completed') completed, count(*) filter (status = 'failed') failed from cs group by 1)"""


def fill_sql(iters: int) -> str:
    """The box of the fill's query: two rings of means, then ``iters`` averagings; f<k> is the fill after k."""
    cols = ", ".join(f"avg(q.{c}::double) {c}" for c in "bgr")
    near = lambda source, todo: f"select t.clip_id, t.frame, t.y, t.x, {cols} from {todo} t join {source} q on q.clip_id = t.clip_id and q.frame = t.frame and abs(q.y - t.y) <= 1 and abs(q.x - t.x) <= 1 and (q.y, q.x) <> (t.y, t.x) group by 1, 2, 3, 4"
    inside = "y between 2 and 5 and x between 3 and 5"
    out = f", todo as (select clip_id, frame, y, x from pixels where {inside}), rest as (select clip_id, frame, y, x, b::double b, g::double g, r::double r from pixels where not ({inside})), r1 as ({near('rest', 'todo')}), left1 as (select * from todo anti join r1 using (clip_id, frame, y, x)), f0 as (select * from r1 union all {near('r1', 'left1')})"
    for k in range(1, iters + 1):
        out += f", a{k} as (select * from rest union all select * from f{k - 1}), f{k} as ({near(f'a{k}', 'todo')})"
    return out + " "


def filled_sql(plate: str, todo: str, iters: int, rings: int) -> str:
    """``filled``: the places of ``todo`` that rings of means reach from the rest of ``plate``, after ``iters`` averagings."""
    key = "clip_id, frame, y, x"
    means = ", ".join(f"avg(q.{c}::double) {c}" for c in "bgr")
    near = lambda source, want: f"select t.clip_id, t.frame, t.y, t.x, {means} from {want} t join {source} q on q.clip_id = t.clip_id and q.frame = t.frame and abs(q.y - t.y) <= 1 and abs(q.x - t.x) <= 1 and (q.y, q.x) <> (t.y, t.x) group by 1, 2, 3, 4"
    out = f", left0 as materialized (select {key} from {plate} semi join {todo} using ({key})), rest as materialized (select {key}, b::double b, g::double g, r::double r from {plate} anti join left0 using ({key})), ring0 as (select * from rest)"
    for k in range(1, rings + 1):
        out += f", ring{k} as materialized ({near(f'ring{k - 1}', f'left{k - 1}')}), left{k} as materialized (select * from left{k - 1} anti join ring{k} using ({key}))"
    out += ", fl0 as materialized (" + " union all ".join(f"select * from ring{k}" for k in range(1, rings + 1)) + ")"
    for k in range(1, iters + 1):
        out += f", al{k} as (select * from rest union all select * from fl{k - 1}), fl{k} as materialized ({near(f'al{k}', 'fl0')})"
    return out + f", filled as (select {key}, " + ", ".join(f"cast(floor(least(255.0, round({c}, 9) + 0.5)) as int) {c}" for c in "bgr") + f" from fl{iters})"


def resized_sql(name: str, source: str, n: int, to: int, columns: str) -> str:
    """``name``: the n x n frames of ``source`` (clip_id, y, x, ...) bilinearly scaled to ``to`` x ``to``."""
    cols = ", ".join(f"cast(round_even(round(sum(s.{c} * ay.k * ax.k), 6), 0) as int) {c}" for c in columns)
    return f""", {name}_ax as (select t, unnest([lo, least(lo + 1, {n - 1})]) p, unnest([1 - f, f]) k from (select t, floor(s)::int lo, s - floor(s) f from (select t, least(greatest((t + 0.5::double) * {n} / {to} - 0.5::double, 0.0), {n - 1}.0) s from (select unnest(range(0, {to})) t)))),
{name} as materialized (select s.clip_id, 0 frame, ay.t::int y, ax.t::int x, {cols} from {source} s join {name}_ax ax on ax.p = s.x join {name}_ax ay on ay.p = s.y group by 1, 2, 3, 4)"""


def little_sql(iters: int, rigs: str = RIGS, frames: int = FRAMES, last: int = 36) -> str:
    """``mp``: the backward map of the 16x16 canvases, and ``shown``, the still at its places."""
    out = rigs + posed_sql(frames, last) + WORLD + WEIGHTS.replace("range(0, 64)", "range(0, 16)")
    out += ", fi as materialized (select rig_id, frame, y, x, " + ", ".join(f"sum(w * {k}) {k}" for k in "abcdef") + " from wt join wo using (rig_id, bone_id) group by 1, 2, 3, 4), e0 as (select rig_id, frame, y, x, y::double sy, x::double sx from fi)"
    near = lambda c: f"least(15, greatest(0, round_even(round(e.{c}, 6), 0)))::int"
    for k in range(iters):
        out += f""", e{k + 1} as materialized (select rig_id, frame, y, x, (a * (y - f) - d * (x - c)) / k sy, (e * (x - c) - b * (y - f)) / k sx from (select e.rig_id, e.frame, e.y, e.x, a, b, c, d, f.e e, f.f f, case when abs(a * f.e - b * d) < 1e-8 then 1e-8 else a * f.e - b * d end k
from e{k} e join fi f on f.rig_id = e.rig_id and f.frame = e.frame and f.y = {near('sy')} and f.x = {near('sx')}))"""
    cols = ", ".join(f"cast(round_even(round(coalesce(sum({c} * k), 0), 6), 0) as int) {c}" for c in "bgra")
    return out + f""", mp as (select * from e{iters}), st as (select rig_id clip_id, y::int y, x::int x, y * 10 b, x * 10 g, y + x r, case when y between 5 and 10 and x between 5 and 10 then 255 else 0 end a from rigs, (select unnest(range(0, 16)) y), (select unnest(range(0, 16)) x)),
shown as materialized (select q.rig_id clip_id, q.frame, q.y, q.x, {cols} from (select *, floor(sy)::int + j py, floor(sx)::int + h px, (case j when 0 then 1 - (sy - floor(sy)) else sy - floor(sy) end) * (case h when 0 then 1 - (sx - floor(sx)) else sx - floor(sx) end) k from mp, (select unnest([0, 1]) j), (select unnest([0, 1]) h)) q
left join st s on s.clip_id = q.rig_id and s.y = q.py and s.x = q.px group by 1, 2, 3, 4)"""


def tree_sql(by: str, chunk: int, levels: int) -> str:
    """Each group's fingerprint: digests of ``chunk`` lines of ``ln`` (``by``, p, l), then of as many digests, ``levels`` times at most."""
    out = f", l0 as (select {by}, p // {chunk} p, sha1(string_agg(l, ';' order by p)) l from ln group by {by}, p // {chunk})"
    for k in range(levels):
        out += f", l{k + 1} as (select {by}, p // {chunk} p, case when max(n) = 1 then min(l) else sha1(string_agg(l, ';' order by p)) end l from (select *, count(*) over (partition by {by}) n from l{k}) group by {by}, p // {chunk})"
    return out + f" select {by}, l fingerprint from l{levels}"


def small_oracle(body: str) -> str:
    """``body`` over the rigs whose bones are scaled to the small canvas."""
    scaled = ", ".join(f"{c} / 4 {c}" for c in ("hx", "hy", "tx", "ty", "radius"))
    return f"with recursive whole as ({X.SQL['bones']}), bones as (select rig_id, bone_id, ord, parent_id, {scaled}, falloff from whole), keyframes as ({X.SQL['keyframes']})" + body


def crew_oracle(iters: int, body: str) -> str:
    """``body`` over the backward map of the rigs of ``crew``."""
    tables = """with recursive bones as (select s_suppkey::bigint rig_id, 'body' bone_id, 0 ord, cast(null as varchar) parent_id, 8.0::double hx, 14.0::double hy, 8.0::double tx, 9.0::double ty, 5.5::double + s_suppkey % 4 radius, 'smooth' falloff from supplier
union all select s_suppkey, 'arm', 1, 'body', 8.0, 9.0, 3.0::double + s_suppkey % 10, 2.0::double + s_suppkey % 5, 3.3::double + s_suppkey % 3, case s_suppkey % 3 when 0 then 'smooth' when 1 then 'linear' else 'hard' end from supplier),
keyframes as (select s_suppkey::bigint rig_id, f frame, bone_id, ((s_suppkey * 13 + f * 5) % 21 - 10) / 20.0::double rot, ((s_suppkey + f) % 3 - 1)::double tx, ((s_suppkey + 2 * f + 1) % 3 - 1)::double ty from supplier, (select unnest([0, 12]) f), (select unnest(['arm', 'body']) bone_id) where bone_id = 'arm' or s_suppkey % 2 = 0)"""
    return tables + little_sql(iters, ", rigs as (select s_suppkey::bigint rig_id from supplier)", CREW_FRAMES, 12) + body


#: ``swept``: where the moved still is and the resting one isn't.
SWEPT = ", swept as materialized (select distinct clip_id, y, x from shown where a > 127 except select clip_id, y, x from st where a > 127)"
SHEETS_SQL = """with m as (select s_suppkey::bigint rig_id, greatest(2, ceil((40 + s_suppkey * 37 % 160) / 10.0)::int + 1) c, greatest(2, ceil((30 + s_suppkey * 53 % 90) / 10.0)::int + 1) r from supplier),
q as (select rig_id, c, i * c + j p, (i * (c - 1) + j) * 2 t from m, lateral (select unnest(range(0, r - 1)) i), lateral (select unnest(range(0, c - 1)) j)),
tr as (select rig_id, t, p v0, p + 1 v1, p + c + 1 v2 from q union all select rig_id, t + 1, p, p + c + 1, p + c from q)
select rig_id, count(*) n, sum(t * (v0 + v1 * 3 + v2 * 7))::bigint places from tr group by 1"""
MAP_SQL = " select rig_id, frame, y, x, round(sy, 4) + 0 sy, round(sx, 4) + 0 sx from mp"
DEFORM_SQL = ", pl as (select clip_id, frame, y, x, 90 b2, x * 5 g2, 30 r2, 255 a2 from shown)" + stats_sql(OVER_SQL.format(cols=OVER_COLS, fg="shown", bg="pl"), *"bgra")
FOOTPRINT_SQL = SWEPT + " select clip_id, count(*) n from swept group by 1"
PATCH_SQL = SWEPT + ", pl as materialized (select clip_id, 0 frame, y, x, 90 b, x * 5 g, 30 r, 255 a from st), todo as materialized (select clip_id, 0 frame, y, x from swept)" + filled_sql("pl", "todo", 5, 12) + """, bare as (select clip_id, y, x from pl anti join todo using (clip_id, y, x)), far as (select p.clip_id, p.y, p.x, min(sqrt(((p.y - q.y) ** 2 + (p.x - q.x) ** 2)::double)) d from todo p left join bare q using (clip_id) group by 1, 2, 3),
gd as (select pl.clip_id, pl.y, pl.x, """ + ", ".join(f"coalesce(f.{c}, pl.{c}) {c}" for c in "bgr") + ", case when pl.y between 4 and 11 and pl.x between 4 and 11 then pl.x * 16 / 255.0::double else 0 end w from pl left join filled f using (clip_id, frame, y, x)) " + stats_sql("select gd.clip_id, 0 frame, gd.y, gd.x, " + ", ".join(f"cast(floor({c} * (1 - w) + {v} * w) as int) {c}" for c, v in zip("bgr", (1, 2, 3), strict=True)) + ", case when d is null then 0 else floor(255 * least(1.0::double, greatest(0.0::double, (d - 1) / 2.0::double))) end::int a from gd left join (select clip_id, y, x, coalesce(d, 1e9) d from far) using (clip_id, y, x)", *"bgra")
#: Of small plates: what is painted, each plate's band, and the ramp of the painted places.
HEALED = """, sk as (select plate_id, stroke, x % 16 x, y % 16 y from strokes), sp as (select distinct plate_id, stroke, (y + dy)::int y, (x + dx)::int x from sk, (select unnest(range(-2, 3)) dy), (select unnest(range(-2, 3)) dx) where dy * dy + dx * dx <= 4 and y + dy between 0 and 15 and x + dx between 0 and 15),
bx as (select plate_id, stroke, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from sp group by 1, 2), gr as (select plate_id, stroke, gy.y, gx.x from bx, lateral (select unnest(range(y0, y1 + 1)) y) gy, lateral (select unnest(range(x0, x1 + 1)) x) gx),
ho as (select g.* from gr g anti join sp using (plate_id, stroke, y, x)), dd as (select sp.plate_id, sp.stroke, sp.y, sp.x, min(sqrt(((sp.y - ho.y) ** 2 + (sp.x - ho.x) ** 2)::double)) d from sp left join ho using (plate_id, stroke) group by 1, 2, 3, 4),
bn as (select plate_id clip_id, greatest(1, least(2, greatest(1, floor(min(r))::int - 1)))::int band from (select plate_id, stroke, max(coalesce(d, 1e6)) r from dd group by 1, 2) group by 1),
pt as materialized (select distinct plate_id clip_id, 0 frame, y, x from sp), pl as materialized (select clip_id, 0 frame, y::int y, x::int x, (y * 15)::int b, (x * 15)::int g, (clip_id % 256)::int r, 255 a from (select distinct plate_id clip_id from strokes), (select unnest(range(0, 16)) y), (select unnest(range(0, 16)) x)),
bare as materialized (select clip_id, y, x from pl anti join pt using (clip_id, y, x)), ds as (select p.clip_id, p.y, p.x, min(sqrt(((p.y - q.y) ** 2 + (p.x - q.x) ** 2)::double)) d from pt p left join bare q using (clip_id) group by 1, 2, 3),
rm as (select ds.clip_id, y, x, floor(255 * least(1.0::double, (coalesce(d, 1e9) - 1) / band))::int / 255.0::double w from ds join bn using (clip_id))"""


def _settings(s, d):
    """A rig's recorded layer settings, one for each supplier."""
    k = F.col("s_suppkey")
    pick = lambda m, *v: F.get(F.array(*(F.lit(x).cast("string") for x in v)), (k % m).cast("int"))
    return s.read.parquet(f"{d}/supplier.parquet").select(
        k.alias("rig_id"), F.when(k % 4 != 3, k % 4 != 0).alias("split"), pick(5, None, "a.png", "false", "null", "b.png").alias("character"), pick(3, "bg.png", None, "false").alias("background"), F.when(k % 6 < 4, (k % 6)).cast("int").alias("fade"), (k % 3).cast("int").alias("n_bones"), (k % 7 * 8).cast("int").alias("frames"),
        F.when(k % 2 == 0, (k % 40)).cast("int").alias("tolerance"), F.when(k % 3 == 0, False).alias("auto_ranges"), F.when(k % 5 == 0, 8).alias("num_ranges"), F.when(k % 7 == 0, True).alias("adaptive_bg"), F.when(k % 9 == 0, 2).alias("edge_cleanup"), F.when(k % 8 == 0, 3).alias("soft_edges"),
    )


SETTINGS = """with s as (select s_suppkey k, case when s_suppkey % 4 <> 3 then s_suppkey % 4 <> 0 end sp, [null, 'a.png', 'false', 'null', 'b.png'][s_suppkey % 5 + 1] ch, ['bg.png', null, 'false'][s_suppkey % 3 + 1] bg, case when s_suppkey % 6 < 4 then (s_suppkey % 6)::int end fade from supplier),
f as (select k rig_id, coalesce(sp, false) split, coalesce(sp, false) and coalesce(ch not in ('false', 'null'), true) has_character, coalesce(sp, false) and coalesce(bg not in ('false', 'null'), true) has_background, coalesce(sp, false) and fade is not null has_patch, fade, (k % 3)::int n_bones, (k % 7 * 8)::int frames, k from s)"""


def _flags(s, d):
    raw = _settings(s, d)
    return Y.layer_settings(raw).join(raw.select("rig_id", "n_bones", "frames"), "rig_id")


def _meta(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 4 < 3").select(F.col("s_suppkey").alias("rig_id"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey") % 6).cast("int").alias("built_fade"))


def _painted(s, d):
    p = Y.correction_pixels(Y.load_corrections(X.corrections(s, d), SIZE, SIZE))
    return p.select("*", *(((F.col("id") * k) % 256).cast("int").alias(c) for c, k in zip("bgr", (3, 5, 7), strict=True)))


def _corrected(s, d):
    painted = _painted(s, d)
    ground = painted.select("rig_id", "y", "x").distinct().select("*", *(F.lit(v).alias(c) for c, v in zip("bgr", (200, 100, 50), strict=True)))
    return Y.apply_corrections(ground, painted).groupBy("rig_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("bigint") * (F.col("y") * 67 + F.col("x") + 1)).alias(f"s_{c}") for c in "bgr"))


def _chunks(s, d):
    """Ranges of ten frames a chunk; some are long, some late."""
    e = X.chunk_events(s, d).select("job_id", "chunk_id").distinct()
    k = F.col("chunk_id")
    return e.select("job_id", "chunk_id", (k * 10 + F.when(k % 5 == 3, 2).otherwise(0)).alias("start_frame"), (k * 10 + 9 + F.when(k % 7 == 2, 4).otherwise(0)).alias("end_frame"))


def figure(rigs):
    """A resting figure a rig: 16x16, opaque in the middle."""
    inner = "y between 5 and 10 and x between 5 and 10"
    return R.grid_points(rigs).select(F.col("rig_id").alias("clip_id"), "y", "x", (F.col("y") * 10).alias("b"), (F.col("x") * 10).alias("g"), (F.col("y") + F.col("x")).alias("r"), F.expr(f"case when {inner} then 255 else 0 end").alias("a"))


def still(s, d):
    return figure(_small(s, d))


def _small(s, d):
    return rigs_of(s, d).withColumn("width", F.lit(16)).withColumn("height", F.lit(16))


def _little(s, d):
    """The bones on the small canvas."""
    b = X.bones(s, d)
    return b.withColumns({c: F.col(c) / 4 for c in ("hx", "hy", "tx", "ty", "radius")})


def _ground(still):
    return still.select("clip_id", F.lit(0).alias("frame"), "y", "x", F.lit(90).alias("b"), (F.col("x") * 5).alias("g"), F.lit(30).alias("r"), F.lit(255).alias("a"))


def _plate(s, d):
    return _ground(still(s, d))


def _strokes(s, d):
    """Strokes on small plates."""
    return X.strokes(s, d).select("plate_id", "stroke", (F.col("x") % 16).alias("x"), (F.col("y") % 16).alias("y"), F.lit(2).alias("radius"))


def _plates(s, d, size=16):
    """A coloured plate for each plate that was painted on."""
    # Ids are few bytes, of which the adaptive engine would make few tasks, but a plate's pixels are many rows.
    ids = X.strokes(s, d).select(F.col("plate_id").alias("clip_id")).distinct().repartition(int(s.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("clip_id"))
    g = ids.select("clip_id", F.lit(0).alias("frame"), upto(F.lit(size)).alias("y")).select("*", upto(F.lit(size)).alias("x"))
    return g.select(*KEY, (F.col("y") * 240 / size).cast("int").alias("b"), (F.col("x") * 240 / size).cast("int").alias("g"), (F.col("clip_id") % 256).cast("int").alias("r"), F.lit(255).alias("a"))


def _heal(s, d):
    return stats(Y.heal(_plates(s, d), _strokes(s, d), 2, 16, 16, 5))


def _heal_larger(s, d):
    """Plates of twice the canvas, and what was painted, shown at the canvas's size."""
    return stats(Y.heal_parts(_plates(s, d, 32), _strokes(s, d), 2, 16, 16, 3, (32, 32))["content"])


def _heal_box(s, d):
    return Y.heal_parts(_plates(s, d), _strokes(s, d), 2, 16, 16, 1)["bbox"].select("clip_id", "x", "y", "width", "height")


def _middle(rigs):
    """Corrections of each rig's middle."""
    return R.grid_points(rigs).where("y between 4 and 11 and x between 4 and 11").select("rig_id", F.lit(1).alias("id"), "y", "x", (F.col("x") * 16).alias("al"), F.lit(1).alias("b"), F.lit(2).alias("g"), F.lit(3).alias("r"))


def _patch(s, d):
    """The patch under corrections of each rig's middle."""
    return stats(Y.build_patch(still(s, d), _small(s, d), _little(s, d), X.keyframes(s, d), frames_of(s, d), _plate(s, d), 2, 5, _middle(_small(s, d))))


def crew(s, d):
    """(rigs, bones, keyframes, frames) of a rig a supplier: an arm on a body, 16x16, thirteen frames."""
    t = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("rig_id"))
    rigs = t.select("rig_id", F.lit(1).alias("schema_version"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(CREW_FRAMES).alias("frames"), F.lit(FPS).alias("fps"))
    body = "struct('body' bone_id, 0 ord, cast(null as string) parent_id, 8.0D hx, 14.0D hy, 8.0D tx, 9.0D ty, 5.5D + rig_id % 4 radius, 'smooth' falloff)"
    arm = "struct('arm' bone_id, 1 ord, 'body' parent_id, 8.0D hx, 9.0D hy, 3.0D + rig_id % 10 tx, 2.0D + rig_id % 5 ty, 3.3D + rig_id % 3 radius, case rig_id % 3 when 0 then 'smooth' when 1 then 'linear' else 'hard' end falloff)"
    k = t.select("rig_id", F.explode(F.array(*map(F.lit, (0, 12)))).alias("frame")).select("*", F.explode(F.array(F.lit("arm"), F.lit("body"))).alias("bone_id")).where("bone_id = 'arm' or rig_id % 2 = 0")
    keyframes = k.select("rig_id", "frame", "bone_id", F.expr("((rig_id * 13 + frame * 5) % 21 - 10) / 20.0D").alias("rot"), F.expr("cast((rig_id + frame) % 3 - 1 as double)").alias("tx"), F.expr("cast((rig_id + 2 * frame + 1) % 3 - 1 as double)").alias("ty"))
    return rigs, t.selectExpr("rig_id", f"inline(array({body}, {arm}))"), keyframes, rigs.select("rig_id", upto(F.col("frames")).alias("frame"))


def _crew_map(s, d):
    rigs, bones, keyframes, frames = crew(s, d)
    world = R.bone_world(bones, R.interpolate_poses(keyframes, bones, frames))
    return rounded(R.skinned_map(R.bone_weights(R.grid_points(rigs), bones), world, 3), "sy", "sx", digits=4)


def _crew_deform(s, d):
    rigs, bones, keyframes, frames = crew(s, d)
    resting = figure(rigs)
    return stats(R.deform(resting, rigs, bones, keyframes, frames, _ground(resting).drop("frame"), 3))


def _crew_footprints(s, d):
    rigs, bones, keyframes, frames = crew(s, d)
    return R.footprint_union(figure(rigs), rigs, bones, keyframes, frames).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))


def _crew_patch(s, d):
    rigs, bones, keyframes, frames = crew(s, d)
    resting = figure(rigs)
    return stats(Y.build_patch(resting, rigs, bones, keyframes, frames, _ground(resting), 2, 5, _middle(rigs)))


def _sheets(s, d):
    """A canvas a supplier, each of its own size."""
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select(k.cast("bigint").alias("rig_id"), (40 + k * 37 % 160).cast("int").alias("width"), (30 + k * 53 % 90).cast("int").alias("height"))


def _stored(p):
    """Masks that are at hand, of every other clip."""
    return p.where("clip_id % 2 = 0").select(*KEY, F.lit(7).alias("m"))


def _layered(p):
    """Clips whose character, background or split is given up."""
    k = F.col("clip_id")
    return p.select("clip_id").distinct().select(k.alias("rig_id"), (k % 5 < 4).alias("split"), (k % 7 < 6).alias("has_character"), (k % 3 < 2).alias("has_background"))


def _resolved_plates(p):
    kept = p.where("clip_id % 4 = 1")
    masks = p.select(*KEY, F.when(F.expr("y between 2 and 5 and x between 3 and 5"), 255).otherwise(0).alias("m"))
    return stats(Y.resolve_plates(kept, p, masks, _layered(p), 5))


def _deform(s, d):
    return stats(R.deform(still(s, d), _small(s, d), _little(s, d), X.keyframes(s, d), frames_of(s, d), _plate(s, d).drop("frame"), 3))


M6 = ("a", "b", "c", "d", "e", "f")

QUERIES = {
    "h1_audit_rigs": (lambda s, d: R.audit_rigs(rigs_of(s, d), faulty(s, d), X.keyframes(s, d)), oracle(FAULTY + """, f as (
        select rig_id, 5 phase, ord place, 8 ordinal, 'radius' rule from fb where radius <= 0 union all select rig_id, 5, ord, 9, 'falloff' from fb where falloff not in ('smooth', 'linear', 'hard') union all select rig_id, 5, ord, 5, 'bone_id' from fb where bone_id is null or bone_id = ''
        union all select b.rig_id, 6, b.ord, 10, 'unknown_parent' from fb b where parent_id is not null and not exists (select 1 from fb p where p.rig_id = b.rig_id and p.bone_id = b.parent_id) union all select distinct rig_id, 7, 0, 11, 'cycle' from (select distinct rig_id, bone_id from fc where bone_id = ancestor_id)
        union all select k.rig_id, 8, k.frame, 13, 'keyframe_bone' from keyframes k where not exists (select 1 from fb p where p.rig_id = k.rig_id and p.bone_id = k.bone_id)),
        g as (select rig_id, phase, ordinal, rule, min(place) place, count(*) n from f group by 1, 2, 3, 4) select rig_id, ordinal, rule, case when rule = 'cycle' then (select count(distinct bone_id) from fc where fc.rig_id = z.rig_id and bone_id = ancestor_id) else n end n
        from (select *, row_number() over (partition by rig_id order by phase, place, ordinal) rn from g) z where rn = 1""", "bones", "keyframes")),
    "h2_bone_closure": (rb(lambda b, k: R.bone_closure(b)), oracle(CLOSURE + " select rig_id, bone_id, ancestor_id, depth from cl", "bones")),
    "h2_cyclic_bones": (lambda s, d: R.cyclic_bones(faulty(s, d)), oracle(FAULTY + " select distinct rig_id, bone_id from fc where bone_id = ancestor_id", "bones")),
    "h3_delete_bone": (lambda s, d: R.delete_bone(X.bones(s, d), X.keyframes(s, d), X.bones(s, d).where("ord between 1 and 9").select("rig_id", "bone_id"))[0].select("rig_id", "bone_id", "parent_id"), oracle("select b.rig_id, b.bone_id, case when p.ord between 1 and 9 then p.parent_id else b.parent_id end parent_id from bones b left join bones p on p.rig_id = b.rig_id and p.bone_id = b.parent_id where b.ord not between 1 and 9", "bones")),
    "h3_delete_bone_keyframes": (lambda s, d: R.delete_bone(X.bones(s, d), X.keyframes(s, d), X.bones(s, d).where("ord between 1 and 9").select("rig_id", "bone_id"))[1], oracle("select * from keyframes where (rig_id, bone_id) not in (select (rig_id, bone_id) from bones where ord between 1 and 9)", "bones", "keyframes")),
    "h4_record_keyframes": (lambda s, d: R.record_keyframes(X.keyframes(s, d), X.keyframes(s, d).where("frame = 12").select("rig_id", "frame", F.when(F.col("tx") < 0, "ghost").otherwise(F.col("bone_id")).alias("bone_id"), F.lit(9.0).alias("rot"), F.lit(None).cast("double").alias("tx"), "ty"), X.bones(s, d)), oracle("select rig_id, frame, bone_id, case when frame = 12 and tx >= 0 then 9.0 else rot end::double rot, case when frame = 12 and tx >= 0 then 0.0 else tx end::double tx, ty from keyframes", "keyframes")),
    "h4_delete_keyframes": (lambda s, d: R.delete_keyframes(R.delete_keyframes(X.keyframes(s, d), X.keyframes(s, d).where("frame = 24 and rig_id > 1").select("rig_id", "frame").distinct()), X.keyframes(s, d).where("frame = 36").select("rig_id", "frame", F.lit("N3").alias("bone_id"))), oracle("select * from keyframes where not (frame = 24 and rig_id > 1) and not (frame = 36 and bone_id = 'N3')", "keyframes")),
    "h5_auto_radius": (lambda s, d: R.auto_radius(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("rig_id"), (F.col("s_suppkey") * 37 % 900).alias("width"), (F.col("s_suppkey") * 53 % 700).alias("height"))), "select s_suppkey rig_id, round(greatest(16.0::double, greatest(s_suppkey * 37 % 900, s_suppkey * 53 % 700) / 5.0::double), 3) radius from supplier"),
    "h6_interpolate_poses": (lambda s, d: rounded(posed(s, d), "rot", "tx", "ty"), oracle(RIGS + posed_sql() + " select rig_id, frame, bone_id, round(rot, 6) + 0 rot, round(tx, 6) + 0 tx, round(ty, 6) + 0 ty from po", "bones", "keyframes")),
    "h7_bone_local": (lambda s, d: rounded(R.bone_local(X.bones(s, d), posed(s, d)), *M6), oracle(RIGS + posed_sql() + LOCAL + f" select rig_id, frame, bone_id, {ABC} from lo", "bones", "keyframes")),
    "h8_bone_world": (lambda s, d: rounded(R.bone_world(X.bones(s, d), posed(s, d)), *M6), oracle(RIGS + posed_sql() + WORLD + f" select rig_id, frame, bone_id, {ABC} from wo", "bones", "keyframes")),
    "h9_skin_matrices": (lambda s, d: rounded(R.skin_matrices(R.bone_world(X.bones(s, d), posed(s, d)), R.bone_world(X.bones(s, d), rest(s, d)).drop("frame")), *M6), oracle(RIGS + posed_sql() + WORLD + ", bi as (select rig_id, bone_id, e / k a, -b / k b, (b * f - c * e) / k c, -d / k d, a / k e, (c * d - a * f) / k f from (select *, a * e - b * d k from wo where frame = 0)), sk as (select p.rig_id, p.frame, p.bone_id, " + PRODUCT + f" from wo p join bi q using (rig_id, bone_id)) select rig_id, frame, bone_id, {ABC} from sk", "bones", "keyframes")),
    "h10_bone_weights": (lambda s, d: rounded(R.bone_weights(points(s, d), X.bones(s, d)), "w"), oracle(RIGS + WEIGHTS + " select rig_id, y, x, bone_id, round(w, 6) w from wt", "bones")),
    "h11_grid_mesh_vertices": (lambda s, d: rounded(R.grid_mesh(rigs_of(s, d), 10)[0], "x", "y"), oracle(RIGS + " select rig_id, (i * 8 + j)::int v, round(j * 63 / 7.0::double, 6) x, round(i * 63 / 7.0::double, 6) y from rigs, (select unnest(range(0, 8)) i), (select unnest(range(0, 8)) j)", "bones")),
    "h11_grid_mesh_triangles": (lambda s, d: R.grid_mesh(rigs_of(s, d), 10)[1], oracle(RIGS + ", q as (select rig_id, i, j, i * 8 + j p from rigs, (select unnest(range(0, 7)) i), (select unnest(range(0, 7)) j)) select rig_id, ((i * 7 + j) * 2)::int t, p::int v0, (p + 1)::int v1, (p + 9)::int v2 from q union all select rig_id, ((i * 7 + j) * 2 + 1)::int, p::int, (p + 9)::int, (p + 8)::int from q", "bones")),
    "h12_backward_map": (lambda s, d: rounded(R.backward_map(R.skinning_fields(R.bone_weights(R.grid_points(_small(s, d)), _little(s, d)), R.bone_world(_little(s, d), R.interpolate_poses(X.keyframes(s, d), _little(s, d), frames_of(s, d)))), 3), "sy", "sx", digits=4), small_oracle(little_sql(3) + MAP_SQL)),
    "h14_deform": (_deform, small_oracle(little_sql(3) + DEFORM_SQL)),
    "h15_footprint_union": (lambda s, d: R.footprint_union(still(s, d), _small(s, d), _little(s, d), X.keyframes(s, d), frames_of(s, d)).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")), small_oracle(little_sql(5) + FOOTPRINT_SQL)),
    "h11_supplier_mesh": (lambda s, d: R.grid_mesh(_sheets(s, d), 10)[1].groupBy("rig_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t").cast("bigint") * (F.col("v0") + F.col("v1") * 3 + F.col("v2") * 7)).alias("places")), SHEETS_SQL),
    "h12_supplier_map": (_crew_map, crew_oracle(3, MAP_SQL)),
    "h14_supplier_deform": (_crew_deform, crew_oracle(3, DEFORM_SQL)),
    "h15_supplier_footprints": (_crew_footprints, crew_oracle(5, FOOTPRINT_SQL)),
    "i10_supplier_patch": (_crew_patch, crew_oracle(5, PATCH_SQL)),
    "h16_skin_points": (lambda s, d: rounded(R.skin_points(points(s, d), R.bone_weights(points(s, d), X.bones(s, d)), R.bone_world(X.bones(s, d), posed(s, d))), "nx", "ny", digits=5), oracle(RIGS + posed_sql() + WORLD + WEIGHTS + " select rig_id, frame, y, x, round(sum(w * (a * x + b * y + c)), 5) nx, round(sum(w * (d * x + e * y + f)), 5) ny from wt join wo using (rig_id, bone_id) group by 1, 2, 3, 4", "bones", "keyframes")),
    "h17_pose_curves": (lambda s, d: rounded(R.pose_curves(rigs_of(s, d), X.bones(s, d), X.keyframes(s, d)), "value", "velocity", "normalised", "x", digits=5), oracle(RIGS + posed_sql() + ", cu as (select rig_id, bone_id, frame, rot v, lead(rot) over (partition by rig_id, bone_id order by frame) nx, min(rot) over (partition by rig_id, bone_id) lo, max(rot) over (partition by rig_id, bone_id) hi from po) select rig_id, bone_id, frame, round(v, 5) + 0 as value, round((nx - v) * 24, 5) + 0 velocity, round(case when hi - lo < 1e-9 then 50 else 100 - (v - lo) / (hi - lo) * 100 end, 5) normalised, round(frame / 47.0::double * 1000, 5) x from cu", "bones", "keyframes")),
    "h18_bone_tree": (rb(lambda b, k: R.bone_tree(b)), oracle(", tr as (select rig_id, bone_id, 0 depth, [ord] path from bones where parent_id is null union all select b.rig_id, b.bone_id, depth + 1, list_append(path, b.ord) from tr join bones b on b.rig_id = tr.rig_id and b.parent_id = tr.bone_id) select rig_id, bone_id, depth, row_number() over (partition by rig_id order by path)::int position from tr", "bones")),
    "h19_nearest_bone": (lambda s, d: rounded(R.nearest_bone(points(s, d), X.bones(s, d), 6.0), "dist"), oracle(RIGS + DIST + ", pa as (select rig_id, y, x, bone_id, ord, unnest([0, 1, 2]) k, unnest(['head', 'tail', 'body']) part, unnest([sqrt((x - hx) ** 2 + (y - hy) ** 2), sqrt((x - tx) ** 2 + (y - ty) ** 2), dist]) dist from ds) select rig_id, y, x, bone_id, part, round(dist, 6) dist from (select *, row_number() over (partition by rig_id, y, x order by dist, ord, k) rn from pa where dist <= 6.0) where rn = 1", "bones")),
    "h20_scale_rigs": (rb(lambda b, k: R.scale_rigs(b, 1.5)), oracle("select rig_id, bone_id, ord, parent_id, hx * 1.5 hx, hy * 1.5 hy, tx * 1.5 tx, ty * 1.5 ty, radius * 1.5 radius, falloff from bones", "bones")),
    "i1_layer_settings": (lambda s, d: Y.layer_settings(_settings(s, d)), SETTINGS + " select rig_id, split, has_character, has_background, has_patch, fade, case when k % 2 = 0 then k % 40 else 30 end::int tolerance, k % 3 <> 0 auto_ranges, case when k % 5 = 0 then 8 else 5 end num_ranges, k % 7 = 0 adaptive_bg, case when k % 9 = 0 then 2 else 0 end edge_cleanup, case when k % 8 = 0 then 3 else 0 end soft_edges from f"),
    "i2_patch_blocker": (lambda s, d: Y.patch_blocker(_flags(s, d)), SETTINGS + " select rig_id, case when not split then 'no_split' when n_bones = 0 then 'no_skeleton' when not has_character then 'no_character' when not has_background then 'no_background' when frames <= 0 then 'no_timeline' when fade is null then 'no_fade' end blocker from f"),
    "i3_distance_transform": (lambda s, d: Y.distance_transform(mmask(s, d)).groupBy("clip_id", "frame").agg(F.round(F.sum(F.col("d") * (F.col("y") * 67 + F.col("x") + 1)), 3).alias("total")), oracle(DENSE + INSIDE + " select clip_id, frame, round(sum(d * (y * 67 + x + 1)), 3) total from dt group by 1, 2", "mosaic")),
    "i4_feather_ramp": (lambda s, d: stats(Y.feather_ramp(mmask(s, d), 3)), oracle(DENSE + INSIDE + stats_sql("select clip_id, frame, y, x, case when m > 0 then cast(floor(255 * least(1.0::double, greatest(0.0::double, (d - 1) / 3))) as int) else 0 end w from dt", "w").replace("s_w", "s_m"), "mosaic")),
    "i4_region_radius": (lambda s, d: rounded(Y.region_radius(mmask(s, d)), "radius"), oracle(DENSE + INSIDE + " select clip_id, frame, round(coalesce(max(d) filter (m > 0), 0), 6) radius from dt group by 1, 2", "mosaic")),
    "i5_fill_region": (px(lambda p: stats(Y.fill_region(p, p.where("y between 2 and 5 and x between 3 and 5"), 5))), oracle(fill_sql(5) + stats_sql("select p.clip_id, p.frame, p.y, p.x, " + ", ".join(f"case when f5.b is null then p.{c} else cast(floor(least(255.0, f5.{c} + 0.5)) as int) end {c}" for c in "bgr") + ", case when f5.b is null then p.a else 255 end a from pixels p left join f5 using (clip_id, frame, y, x)", *"bgra"), "pixels")),
    "i6_stroke_mask": (lambda s, d: Y.stroke_mask(X.strokes(s, d), SIZE, SIZE).groupBy("plate_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint") * 64 + F.col("x")).alias("places")), oracle(DISCS + " select plate_id, count(*) n, sum(y * 64 + x)::bigint places from (select distinct plate_id, y, x from sp) group by 1", "strokes")),
    "i7_correction_band": (lambda s, d: Y.correction_band(X.strokes(s, d), 4, SIZE, SIZE), oracle(DISCS + """, bx as (select plate_id, stroke, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from sp group by 1, 2), gr as (select plate_id, stroke, gy.y, gx.x from bx, lateral (select unnest(range(y0, y1 + 1)) y) gy, lateral (select unnest(range(x0, x1 + 1)) x) gx),
        ho as (select g.* from gr g anti join sp using (plate_id, stroke, y, x)), dd as (select sp.plate_id, sp.stroke, sp.y, sp.x, min(sqrt(((sp.y - ho.y) ** 2 + (sp.x - ho.x) ** 2)::double)) d from sp left join ho using (plate_id, stroke) group by 1, 2, 3, 4), rr as (select plate_id, min(r) r from (select plate_id, stroke, max(coalesce(d, 1e6)) r from dd group by 1, 2) group by 1)
        select plate_id, greatest(1, least(4, greatest(1, floor(r)::int - 1)))::int band from rr""", "strokes")),
    "a7_load_corrections": (lambda s, d: Y.load_corrections(X.corrections(s, d), SIZE, SIZE), oracle(LOADED + " select * from lc", "corrections")),
    "i8_heal": (_heal, oracle(HEALED + filled_sql("pl", "pt", 5, 12) + " " + stats_sql("select pl.clip_id, pl.frame, pl.y, pl.x, " + ", ".join(f"cast(floor(pl.{c} * (1 - coalesce(w, 0)) + coalesce(f.{c}, pl.{c}) * coalesce(w, 0)) as int) {c}" for c in "bgr") + ", 255 a from pl left join filled f using (clip_id, frame, y, x) left join rm on rm.clip_id = pl.clip_id and rm.y = pl.y and rm.x = pl.x", *"bgra"), "strokes")),
    "i8_heal_other_size": (_heal_larger, oracle(""", sk as (select plate_id, x % 16 x, y % 16 y from strokes), pt as (select distinct plate_id clip_id, (y + dy)::int y, (x + dx)::int x from sk, (select unnest(range(-2, 3)) dy), (select unnest(range(-2, 3)) dx) where dy * dy + dx * dx <= 4 and y + dy between 0 and 15 and x + dx between 0 and 15),
        mk as (select clip_id, y::int y, x::int x, case when k is null then 0 else 255 end m from (select clip_id, y, x from (select distinct plate_id clip_id from strokes), (select unnest(range(0, 16)) y), (select unnest(range(0, 16)) x)) left join (select *, 1 k from pt) using (clip_id, y, x))""" + resized_sql("fit", "mk", 16, 32, "m") + """, todo as materialized (select clip_id, 0 frame, y, x from fit where m > 127),
        pl as materialized (select clip_id, 0 frame, y::int y, x::int x, floor(y * 7.5)::int b, floor(x * 7.5)::int g, (clip_id % 256)::int r from (select distinct plate_id clip_id from strokes), (select unnest(range(0, 32)) y), (select unnest(range(0, 32)) x))""" + filled_sql("pl", "todo", 3, 20) + ", whole as (select pl.clip_id, pl.y, pl.x, " + ", ".join(f"coalesce(f.{c}, pl.{c}) {c}" for c in "bgr") + ", 255 a from pl left join filled f using (clip_id, frame, y, x))" + resized_sql("shown", "whole", 32, 16, "bgra") + " " + stats_sql("select * from shown", *"bgra"), "strokes")),
    "i8_heal_box": (_heal_box, oracle(", sp as (select distinct plate_id, (y % 16 + dy)::int y, (x % 16 + dx)::int x from strokes, (select unnest(range(-2, 3)) dy), (select unnest(range(-2, 3)) dx) where dy * dy + dx * dx <= 4) select plate_id clip_id, min(x) x, min(y) y, max(x) - min(x) + 1 width, max(y) - min(y) + 1 height from sp where y between 0 and 15 and x between 0 and 15 group by 1", "strokes")),
    "i9_apply_corrections": (_corrected, oracle(LOADED + """, pc as (select rig_id, id, y, x, floor(255 * least(1.0::double, (least(x - x0 + 1, x1 - x, y - y0 + 1, y1 - y) - 1) / band::double))::int al from (select lc.*, gy.y, gx.x from lc, lateral (select unnest(range(y0, y1)) y) gy, lateral (select unnest(range(x0, x1)) x) gx)),
        nm as (select *, row_number() over (partition by rig_id, y, x order by id) k, count(*) over (partition by rig_id, y, x) n from pc), st as (select rig_id, y, x, 0 k, 200 b, 100 g, 50 r from nm where k = 1 union all select st.rig_id, st.y, st.x, st.k + 1, """ + ", ".join(f"floor(st.{c} * (1 - al / 255.0::double) + (nm.id * {v} % 256) * (al / 255.0::double))::int" for c, v in zip("bgr", (3, 5, 7), strict=True)) + " from st join nm on nm.rig_id = st.rig_id and nm.y = st.y and nm.x = st.x and nm.k = st.k + 1) select rig_id, count(*) n, " + ", ".join(f"sum({c} * (y * 67 + x + 1))::bigint s_{c}" for c in "bgr") + " from (select st.* from st join (select rig_id, y, x, max(n) n from nm group by 1, 2, 3) m on m.rig_id = st.rig_id and m.y = st.y and m.x = st.x and m.n = st.k) group by 1", "corrections")),
    "i10_build_patch": (_patch, small_oracle(little_sql(5) + PATCH_SQL)),
    "i11_content_fingerprint": (rb(lambda b, k: Y.content_fingerprint(b, ["rig_id"], ["ord"], ["bone_id", "parent_id", "falloff"])), oracle(", ln as (select rig_id, row_number() over (partition by rig_id order by ord, l) - 1 p, l from (select rig_id, ord, bone_id || ',' || coalesce(parent_id, '~') || ',' || falloff l from bones))" + tree_sql("rig_id", Y.CHUNK, 3), "bones")),
    "i11_layer_fingerprint": (px(lambda p: Y.content_fingerprint(p, ["clip_id"], ["frame", "y", "x"], ["b", "g", "r", "a"], 256)), oracle(", ln as (select clip_id, row_number() over (partition by clip_id order by frame, y, x) - 1 p, concat_ws(',', b, g, r, a) l from pixels), l0 as (select clip_id, p // 256 p, sha1(string_agg(l, ';' order by p)) l from ln group by 1, p // 256)" + "".join(f", l{k + 1} as (select clip_id, p // 256 p, case when max(n) = 1 then min(l) else sha1(string_agg(l, ';' order by p)) end l from (select *, count(*) over (partition by clip_id) n from l{k}) group by clip_id, p // 256)" for k in range(3)) + " select clip_id, l fingerprint from l3", "pixels")),
    "i12_stale_artifacts": (lambda s, d: Y.stale_artifacts(_prints(s, d, 0), _prints(s, d, 3)), "select s_suppkey rig_id, (s_suppkey % 4)::varchar fingerprint from supplier where s_suppkey % 3 = 0 or s_suppkey % 4 <> s_suppkey % 2"),
    "i13_resolve_layers": (px(lambda p: stats(Y.resolve_layers(_stored(p), p, _layered(p)))), oracle(", whole as (select * from pixels), rest as (select * from pixels where clip_id % 2 = 1 and clip_id % 5 < 4 and clip_id % 7 < 6)" + CLIPS.replace("from pixels", "from rest") + ranges_sql().replace("from pixels p", "from rest p") + " " + stats_sql(f"select clip_id, frame, y, x, case when {hit()} then 0 else 255 end m from rest p union all select clip_id, frame, y, x, 7 from whole where clip_id % 2 = 0 and clip_id % 5 < 4 and clip_id % 7 < 6", "m"), "pixels")),
    "i13_resolve_plates": (px(_resolved_plates), oracle(fill_sql(5) + stats_sql("select p.clip_id, p.frame, p.y, p.x, " + ", ".join(f"case when p.clip_id % 4 = 1 or f5.b is null then p.{c} else cast(floor(least(255.0, f5.{c} + 0.5)) as int) end {c}" for c in "bgr") + ", case when p.clip_id % 4 = 1 then p.a else 255 end a from pixels p left join f5 using (clip_id, frame, y, x) where p.clip_id % 5 < 4 and p.clip_id % 3 < 2", *"bgra"), "pixels")),
    "i14_patch_state": (lambda s, d: Y.patch_state(_flags(s, d), _meta(s, d)), SETTINGS + " select rig_id, case when not split then 'unsplit' when n_bones = 0 then 'no_skeleton' when fade is null then 'off' when not has_background then 'no_plate' when not has_character then 'no_character' when k % 4 = 3 then 'pending' when k % 5 > 0 and k % 6 = fade then 'ready' else 'stale' end state from f"),
    "j1_frame_diff_report": (mo(lambda p: rounded(J.frame_diff_report(p, p.withColumn("b", F.least(F.lit(255), F.col("b") + F.col("x") % 3 * 9))), "mean_abs", "outliers")), oracle("select clip_id, frame, round(avg(dv) / 4, 6) mean_abs, round(avg((dv > 16)::int), 6) outliers, avg(dv) / 4 <= 2.0 and avg((dv > 16)::int) <= 0.02 passed from (select *, least(255, b + x % 3 * 9) - b dv from mosaic) group by 1, 2", "mosaic")),
    "j2_job_progress": (lambda s, d: J.job_progress(J.chunk_status(X.chunk_events(s, d))), oracle(COUNTED + " select job_id, total, completed, failed, round((completed + failed) / total::double * 100, 1) progress from jp", "chunk_events")),
    "j3_attempt_outcomes": (lambda s, d: J.attempt_outcomes(X.chunk_events(s, d)), oracle(COUNTED + " select job_id, count(*) filter (result = 'ok') completed, count(*) filter (att = 3) failed_for_good, max(errors) errors, bool_or(fin) job_failed, min(event_id) filter (fin) failed_at, coalesce(array_to_string(list_sort(list_distinct(list(player_id) filter (att is not null))), ','), '') players from ev group by 1", "chunk_events")),
    "j4_job_status": (lambda s, d: J.job_status(J.chunk_status(X.chunk_events(s, d))), oracle(COUNTED + " select job_id, case when completed + failed < total then 'processing' when failed = 0 then 'completed' else 'failed' end status, case when completed + failed >= total and failed > 0 then failed || ' of ' || total || ' chunks could not be rendered' end message from jp", "chunk_events")),
    "j5_merge_plan": (lambda s, d: J.merge_plan(_chunks(s, d)), oracle(", ch as (select distinct job_id, chunk_id, (chunk_id * 10 + case when chunk_id % 5 = 3 then 2 else 0 end)::int start_frame, (chunk_id * 10 + 9 + case when chunk_id % 7 = 2 then 4 else 0 end)::int end_frame from chunk_events), ld as (select *, row_number() over w position, lead(start_frame) over w nx from ch window w as (partition by job_id order by start_frame, chunk_id)) select job_id, chunk_id, start_frame, end_frame, position::int position, case when nx > end_frame + 1 then 'gap' when nx <= end_frame then 'overlap' end fault from ld", "chunk_events")),
}


def _prints(s, d, drop):
    """Fingerprints by supplier; the built ones are older, and some are missing."""
    k = F.col("s_suppkey")
    t = s.read.parquet(f"{d}/supplier.parquet")
    return t.select(k.alias("rig_id"), (k % 4).cast("string").alias("fingerprint")) if not drop else t.where(k % 3 != 0).select(k.alias("rig_id"), (k % 2).cast("string").alias("fingerprint"))

