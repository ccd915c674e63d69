"""Queries of the sources, the registry and the streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import registry
from ..operators import color as C
from ..operators import layers as Y
from ..operators import pixels as P
from ..sources import fixtures as X
from ..sources import io as O
from ..sources.fixtures import oracle
from ..sources.shared import shared_dir
from ..streaming import streams as K
from .frames import CLIPS, hit, mo, px, ranges_sql, stats, stats_sql
from .rigs import COUNTED, LOADED, SIZE


def _meta(s, d):
    """Rates and counts as a prober gives them, one row a clip; some are missing or 0/0."""
    c = X.pixels(s, d).select("clip_id").distinct()
    k = F.col("clip_id")
    return c.select("clip_id", F.when(k % 3 == 0, "30000/1001").when(k % 3 == 1, "0/0").alias("avg_rate"), F.when(k % 4 < 3, "25").alias("r_rate"), F.when(k % 2 == 0, k * 7).cast("bigint").alias("nb_frames"), F.when(k % 5 < 3, 2.5).alias("duration"))


def _written(s, d):
    """Frames written by clip and chunk, and one clip's range read back."""
    path = f"{shared_dir(s)}/frames-{uuid.uuid4().hex}"
    O.write_pixels(X.pixels(s, d), path, 20)
    return stats(O.read_pixels(s, path, [2, 3]).where("frame between 10 and 30"))


def _range(s, d):
    """Each clip's frames 25 to 34, from a table in chunks of 20."""
    path = f"{shared_dir(s)}/frames-{uuid.uuid4().hex}"
    O.write_pixels(X.pixels(s, d), path, 20)
    return stats(O.read_pixels(s, path, frames=(25, 34), chunk_frames=20))


def _formats(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey")
    k = F.col("p_partkey")
    ends = F.array(*map(F.lit, ("a.WEBM", "b.gif", "c.mp4", "d.mov", "e", "f.mp4.txt")))
    flags = F.array(F.lit(None), F.lit(""), F.lit("GIF"), F.lit(None), F.lit(None))
    return p.select("p_partkey", O.output_format(F.get(ends, (k % 6).cast("int")), F.get(flags, (k % 5).cast("int"))).alias("format"))


def _summary(s, d):
    b = X.bones(s, d).groupBy("rig_id").agg(F.count(F.lit(1)).alias("n_bones"))
    k = X.keyframes(s, d).groupBy("rig_id").agg(F.countDistinct("frame").alias("n_keyframes"))
    rigs = b.join(k, "rig_id", "left").select(F.col("rig_id").cast("string").alias("rig_id"), F.when(F.col("rig_id") % 2 == 0, F.concat(F.lit("rig "), "rig_id")).alias("name"), "n_bones", "n_keyframes", (F.col("rig_id") * 3 % 5).alias("modified"))
    files = X.bones(s, d).select(F.col("rig_id").cast("string").alias("rig_id"), F.when(F.col("ord") % 2 == 0, "source").when(F.col("ord") > 20, "result").otherwise("other").alias("kind"))
    return O.project_summary(rigs, files)


def _headers(s, d):
    """First bytes of pictures, one for each supplier, in four formats and none."""
    k = F.col("s_suppkey")
    w, h = k * 7 % 5000 + 1, k * 11 % 3000 + 1
    big = lambda v: F.lpad(F.hex(v), 8, "0")
    flip = lambda v, n: F.concat(*(F.substring(F.lpad(F.hex(v), 2 * n, "0"), 2 * i + 1, 2) for i in reversed(range(n))))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(h), F.lit("0806"))).when(k % 5 == 1, F.concat(F.lit("474946383961"), flip(w, 2), flip(h, 2)))
        .when(k % 5 == 2, F.concat(F.lit("424D" + "00" * 16), flip(w, 4), flip(h, 4))).when(k % 5 == 3, F.concat(F.lit("524946460000000057454250565038" + "58" + "00" * 8), flip(w - 1, 3), flip(h - 1, 3)))
        .otherwise(F.lit("68656C6C6F"))
    )
    files = s.read.parquet(f"{d}/supplier.parquet").select(k.cast("string").alias("path"), F.unhex(text).alias("content"))
    return O.image_headers(files)


def _documents(s, d):
    """Rigs written as a JSON document each and read again: their bones."""
    path = f"{shared_dir(s)}/rigs-{uuid.uuid4().hex}"
    bone = F.struct("ord", F.col("bone_id").alias("id"), F.col("parent_id").alias("parent"), F.struct(F.array("hx", "hy").alias("head"), F.array("tx", "ty").alias("tail")).alias("rest"), "radius", "falloff")
    keys = X.keyframes(s, d).groupBy("rig_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("bone_id", F.struct("rot", "tx", "ty")))).alias("pose"))
    keys = keys.groupBy("rig_id").agg(F.collect_list(F.struct("frame", "pose")).alias("keyframes"))
    rigs = X.bones(s, d).groupBy("rig_id").agg(F.array_sort(F.collect_list(bone)).alias("bones")).join(keys, "rig_id", "left")
    doc = F.to_json(F.struct(F.col("rig_id").cast("string").alias("id"), F.lit(1).alias("schema_version"), F.struct(F.lit(64).alias("width"), F.lit(64).alias("height")).alias("canvas"), "bones", "keyframes"))
    rigs.select("rig_id", doc.alias("value")).repartition("rig_id").write.partitionBy("rig_id").text(path)
    return O.read_rigs(s, f"{path}/*")


def _damaged(s, d):
    """A document for each supplier, a line each: some cut short, some with a radius or frame that is text, some without id."""
    path = f"{shared_dir(s)}/damaged-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    rest = F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("head"), F.array(F.lit(3.0), F.lit(4.0)).alias("tail"))
    bones = F.array(*(F.struct(F.concat(F.lit(n), k.cast("string")).alias("id"), rest.alias("rest"), F.lit(r).alias("radius")) for n, r in (("a", 4.0), ("b", 5.0))))
    doc = lambda id_: F.to_json(F.struct(id_.alias("id"), F.lit(1).alias("schema_version"), bones.alias("bones"), F.array(F.struct((k % 40).alias("frame"))).alias("keyframes")))
    whole = doc(k.cast("string"))
    text = F.when(k % 6 == 0, F.substring(whole, 1, 30)).when(k % 6 == 1, F.regexp_replace(whole, '"radius":5.0', '"radius":"wide"')).when(k % 6 == 2, doc(F.lit(None).cast("string"))).when(k % 6 == 3, F.regexp_replace(whole, '"frame":', '"frame":"late ')).otherwise(whole)
    text = F.when(k % 6 == 3, F.regexp_replace(text, "late ([0-9]+)", 'late $1"')).otherwise(text)
    s.read.parquet(f"{d}/supplier.parquet").select(text.alias("value")).write.text(path)
    return O.read_rigs(s, path, lines=True)


def _damaged_kept(s, d):
    rigs, bones, _, _ = _damaged(s, d)
    return rigs.join(bones, "rig_id").groupBy("rig_id", "frames").agg(F.count(F.lit(1)).alias("n_bones"), F.sum("radius").alias("radius"))


def _damaged_rows(s, d):
    return _damaged(s, d)[3].groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"))


def _faulty_corrections(s, d):
    """Corrections of which some lack a bound or their canvas, or have one without size."""
    e = F.col("id")
    c = X.corrections(s, d)
    return c.withColumn("bbox_x", F.when(e % 7 != 0, F.col("bbox_x"))).withColumn("bbox_height", F.when(e % 21 != 0, F.col("bbox_height"))).withColumn("canvas_width", F.when(e % 11 != 0, F.col("canvas_width"))).withColumn("canvas_height", F.when(e % 13 == 0, 0).otherwise(F.col("canvas_height")))


def _strokes_read(s, d):
    """Strokes written as a JSON file a plate and read again."""
    path = f"{shared_dir(s)}/strokes-{uuid.uuid4().hex}"
    one = F.struct("stroke", F.array(F.array(F.col("x").cast("double"), F.col("y").cast("double"))).alias("points"), F.col("radius").cast("double").alias("radius"))
    docs = X.strokes(s, d).groupBy("plate_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("strokes"))).alias("value"))
    # A file costs a task the same however small it is, so plates are dealt by their number, not by their bytes, and tasks commit their own.
    dealt = docs.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("plate_id"))
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("plate_id").text(path)
    strokes, errors = O.read_strokes(s, f"{path}/*")
    return strokes.select(F.regexp_extract("file", "plate_id=(\\d+)", 1).cast("bigint").alias("plate_id"), "stroke", "pt", "x", "y", "radius")


def _event_stream(s, d):
    """The ledger as a stream of files in no order of time, and a last row that carries time beyond them all."""
    path = f"{shared_dir(s)}/ledger-{uuid.uuid4().hex}"
    events = X.chunk_events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, F.xxhash64("event_id")).write.parquet(path)
    kinds = dict(events.dtypes)
    end = events.agg(F.max("ts").alias("ts")).select(*((F.col("ts") + F.expr("interval 800 days") if c == "ts" else F.lit("tick") if c == "result" else F.lit(-1) if c in ("job_id", "chunk_id", "event_id") else F.lit(None)).cast(kinds[c]).alias(c) for c in events.columns))
    end.coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _pixel_stream(s, df):
    path = f"{shared_dir(s)}/pixels-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return s.readStream.schema(df.schema).parquet(path)


def _with_rocks(fn):
    def run(s, d):
        s.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKS)
        return fn(s, d)

    return run


def _frames_stream(s, d):
    p = X.pixels(s, d)
    ranges = C.color_ranges(C.border_color(p))
    return stats(K.run_available(K.stream_frames(_pixel_stream(s, p), ranges)).drop("batch"))


def _progress_stream(s, d):
    out = K.run_available(K.stream_progress(_event_stream(s, d)), "update")
    return out.groupBy("job_id").agg(F.max("completed").alias("completed"))


def _corpus_stream(s, d):
    """Corrections appended as they come, then counted by fade."""
    c = X.corrections(s, d).withColumns({k: F.col("id").cast("string").cast("binary") for k in ("content", "mask", "replaced")}).withColumn("fade", F.when(F.col("fade") > 0, F.col("fade")))
    root = f"{shared_dir(s)}/corpus-{uuid.uuid4().hex}"
    K.stream_corpus(_pixel_stream(s, c), f"{root}/table", f"{root}/state").awaitTermination()
    return s.read.parquet(f"{root}/table").groupBy("fade", "brush_radius", "content_type").agg(F.count(F.lit(1)).alias("n"))


def _motion_stream(s, d):
    g = P.bgr_to_gray(X.pixels(s, d)).withColumnRenamed("gray", "v").withColumn("clip_id", F.col("clip_id").cast("int"))
    return K.run_available(K.stream_motion(_pixel_stream(s, g), 40)).drop("batch")


MOVED = ", gr as (select clip_id, frame, y, x, cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) as int) v from pixels), df as (select *, abs(v - lag(v) over (partition by clip_id, y, x order by frame)) d from gr) select clip_id::int clip_id, y, x, min(frame) frame from df where d > 40 group by 1, 2, 3"

QUERIES = {
    "a4_image_headers": (_headers, "select s_suppkey::varchar as path, case s_suppkey % 5 when 0 then 'png' when 1 then 'gif' when 2 then 'bmp' when 3 then 'webp' end format, case when s_suppkey % 5 < 4 then s_suppkey * 7 % 5000 + 1 end::bigint width, case when s_suppkey % 5 < 4 then s_suppkey * 11 % 3000 + 1 end::bigint height from supplier"),
    "a5_read_rigs_bones": (lambda s, d: _documents(s, d)[1].select("rig_id", "bone_id", "parent_id", "hx", "hy", "tx", "ty", "radius", "falloff", F.col("ord").alias("place")), oracle("select rig_id::varchar rig_id, bone_id, parent_id, hx, hy, tx, ty, radius, falloff, (row_number() over (partition by rig_id order by ord) - 1)::int place from bones", "bones")),
    "a5_read_rigs_errors": (_damaged_rows, """select case when s_suppkey % 6 in (1, 3) then s_suppkey::varchar end id, ['not JSON', 'a field has a wrong type', 'no id', 'a field has a wrong type'][s_suppkey % 6 + 1] reason, count(*) n from supplier where s_suppkey % 6 < 4 group by 1, 2"""),
    "a5_read_rigs_kept": (_damaged_kept, "select s_suppkey::varchar rig_id, 0 frames, 2 n_bones, 9.0::double radius from supplier where s_suppkey % 6 > 3"),
    "a7_correction_errors": (lambda s, d: Y.correction_errors(_faulty_corrections(s, d)), oracle("""select id, rig_id, case when len(m) > 0 then 'missing: ' || array_to_string(m, ', ') else 'the canvas has no size' end reason from (select id, rig_id, list_filter([case when id % 7 = 0 then 'bbox_x' end, case when id % 21 = 0 then 'bbox_height' end, case when id % 11 = 0 then 'canvas_width' end], lambda x: x is not null) m from corrections) where len(m) > 0 or id % 13 = 0""", "corrections")),
    "a7_corrections_kept": (lambda s, d: Y.load_corrections(_faulty_corrections(s, d), SIZE, SIZE, strict=False), oracle(LOADED + " select * from lc where id % 7 > 0 and id % 11 > 0 and id % 13 > 0", "corrections")),
    "a5_read_rigs_keyframes": (lambda s, d: _documents(s, d)[2], oracle("select rig_id::varchar rig_id, frame, bone_id, rot, tx, ty from keyframes", "keyframes")),
    "a6_read_strokes": (_strokes_read, oracle("select plate_id, (row_number() over (partition by plate_id order by stroke) - 1)::int stroke, 0 pt, x::double x, y::double y, radius from strokes", "strokes")),
    "a1_read_range": (_range, oracle(stats_sql("select * from pixels where frame between 25 and 34", *"bgra"), "pixels")),
    "a3_write_read_pixels": (_written, oracle(stats_sql("select * from pixels where clip_id in (2, 3) and frame between 10 and 30", *"bgra"), "pixels")),
    "a9_probe": (lambda s, d: O.probe(X.pixels(s, d), _meta(s, d)).select("clip_id", "width", "height", F.round("fps", 6).alias("fps"), "total_frames", F.round("duration_s", 6).alias("duration_s"), "has_alpha"), oracle(""", p as (select clip_id, max(x) + 1 width, max(y) + 1 height, count(distinct frame) n, bool_or(a < 255) has_alpha from pixels group by 1),
        q as (select *, case when clip_id % 3 = 0 then 30000 / 1001.0::double when clip_id % 4 < 3 then 25.0 else 0.0 end::double fps from p), t as (select *, case when clip_id % 2 = 0 and clip_id > 0 then clip_id * 7 when clip_id % 5 < 3 and fps > 0 then round_even(2.5 * fps, 0) else n end::int total_frames from q)
        select clip_id, width, height, round(fps, 6) fps, total_frames, case when fps > 0 then round(total_frames / fps, 6) end duration_s, has_alpha from t""", "pixels")),
    "a10_has_alpha": (mo(O.has_alpha), oracle("select clip_id, bool_or(a < 255) has_alpha from mosaic group by 1", "mosaic")),
    "a11_project_summary": (_summary, oracle("select b.rig_id::varchar rig_id, case when b.rig_id % 2 = 0 then 'rig ' || b.rig_id else b.rig_id::varchar end \"name\", b.n n_bones, k.n n_keyframes, has_source, has_result, b.rig_id * 3 % 5 modified from (select rig_id, count(*) n, bool_or(ord % 2 = 0) has_source, bool_or(ord % 2 = 1 and ord > 20) has_result from bones group by 1) b left join (select rig_id, count(distinct frame) n from keyframes group by 1) k using (rig_id)", "bones", "keyframes")),
    "a12_output_format": (_formats, "select p_partkey, case when p_partkey % 5 = 2 then 'gif' else case p_partkey % 6 when 0 then 'webm' when 1 then 'gif' when 2 then 'mp4' else 'mov' end end format from part"),
    "a13_export_variants": (mo(lambda p: O.export_variants(p, "all", 24, 12, 0)[1]), oracle("select clip_id, f format, case when bool_or(a < 255) and f = 'mp4' then 'mp4 has no alpha' end error from mosaic, (select unnest(['mov', 'webm', 'gif', 'mp4']) f) group by 1, 2", "mosaic")),
    "l2_registry_run": (px(lambda p: stats(registry.run(p, [("recolor", {"target": (120, 130, 110), "new": (1, 2, 3)}), ("reverse_loop", {})]))), oracle(", rc as (select clip_id, frame, y, x, case when k then 1 else b end b, case when k then 2 else g end g, case when k then 3 else r end r, a, max(frame) over (partition by clip_id) + 1 n from (select *, b between 90 and 150 and g between 100 and 160 and r between 80 and 140 k from pixels)) " + stats_sql("select clip_id, frame, y, x, b, g, r, a from rc union all select clip_id, (2 * n - 1 - frame)::int, y, x, b, g, r, a from rc", *"bgra"), "pixels")),
    "k1_stream_frames": (_frames_stream, oracle(CLIPS + ranges_sql() + " " + stats_sql(f"select clip_id, frame, y, x, case when {hit()} then 0 else 255 end m from pixels p", "m"), "pixels")),
    "k2_stream_progress": (_progress_stream, oracle("select job_id, count(distinct chunk_id) completed from chunk_events where result = 'ok' group by 1", "chunk_events")),
    "k3_stream_attempts": (_with_rocks(lambda s, d: K.run_available(K.stream_attempts(_event_stream(s, d), "400 days")).drop("batch")), oracle(COUNTED + " select job_id, chunk_id, event_id, case when result = 'ok' then 'completed' when att = 3 then 'failed' else 'job_failed' end outcome from ev where result = 'ok' or att = 3 or fin", "chunk_events")),
    "k4_stream_motion": (_with_rocks(_motion_stream), oracle(MOVED, "pixels")),
    "k5_stream_stall": (_with_rocks(lambda s, d: K.run_available(K.stream_stall(_event_stream(s, d), "1 day", "400 days")).select("job_id", F.unix_micros("silent_from").alias("silent_us"), "n")), oracle(""", p as (select job_id, ts, event_id, coalesce(ts - lag(ts) over w >= interval 1 day, true) as opens, coalesce(lead(ts) over w - ts >= interval 1 day, true) as silent from chunk_events window w as (partition by job_id order by ts, event_id)),
        q as (select *, sum(opens::int) over (partition by job_id order by ts, event_id) k from p) select job_id, epoch_us(max(ts)) silent_us, count(*) n from q group by job_id, k""", "chunk_events")),
    "k6_stream_corpus": (_corpus_stream, oracle("select case when fade > 0 then fade else 12 end::bigint fade, 12 brush_radius, 'image/png' content_type, count(*) n from corrections group by 1", "corrections")),
}
