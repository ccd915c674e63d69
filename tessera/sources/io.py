"""Sources and sinks: frames, rig documents, strokes, image headers, corrections, exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import resize, retime_drop, retime_repeat
from ..operators.pixels import CHANNELS, clips_of
from .shared import cut

PIXELS = "clip_id bigint, frame int, y int, x int, b int, g int, r int, a int"
RIG = (
    "id string, name string, schema_version int, canvas struct<width:int,height:int>, "
    "bones array<struct<id:string,parent:string,rest:struct<head:array<double>,tail:array<double>>,radius:double,falloff:string>>, "
    "keyframes array<struct<frame:int,pose:map<string,struct<rot:double,tx:double,ty:double>>>>, bind struct<power:double,radius_scale:double>, "
    "duration struct<fps:double,frames:int>, layers struct<split:boolean,fade:int,character:string,background:string>, _corrupt string"
)


def read_pixels(spark: SparkSession, path: str, clip_ids: list[int] | None = None, frames: tuple[int, int] | None = None, chunk_frames: int | None = None) -> DataFrame:
    """The pixel table at ``path``; one channel (``v``) is copied to b, g, r, a missing alpha is 255.

    Of ``clip_ids`` only, and of the frames from ``frames``' first to its last. With the
    ``chunk_frames`` that ``write_pixels`` wrote the table with, folders of other chunks aren't read.
    """
    df = spark.read.parquet(path)
    if "v" in df.columns and "b" not in df.columns:
        df = df.withColumns({c: F.col("v") for c in CHANNELS})
    if not {"b", "g", "r"} <= set(df.columns):
        raise ValueError("frames need one, three or four channels")
    if "a" not in df.columns:
        df = df.withColumn("a", F.lit(255))
    if frames is not None:
        if chunk_frames:
            df = df.where(F.col("chunk").between(*(f // chunk_frames for f in frames)))
        df = df.where(F.col("frame").between(*frames))
    df = df.select("clip_id", "frame", "y", "x", *CHANNELS, "a")
    return df if clip_ids is None else df.where(F.col("clip_id").isin(clip_ids))


def write_pixels(df: DataFrame, path: str, chunk_frames: int = 100) -> None:
    """Writes the frames by clip and chunk of frames, sorted, so that a range of frames prunes; shapes must agree."""
    sizes = df.groupBy("clip_id", "frame").agg(F.max("x").alias("w"), F.max("y").alias("h"), F.count(F.lit(1)).alias("n"))
    odd = sizes.groupBy("clip_id").agg(F.countDistinct("w", "h").alias("k"), F.count_if(F.col("n") != (F.col("w") + 1) * (F.col("h") + 1)).alias("holes")).where("k > 1 or holes > 0")
    if odd.limit(1).count():
        raise ValueError("every frame must have its clip's shape")
    out = df.withColumn("chunk", F.floor(F.col("frame") / chunk_frames).cast("int")).repartition("clip_id", "chunk").sortWithinPartitions("clip_id", "chunk", "frame", "y", "x")
    out.write.partitionBy("clip_id", "chunk").parquet(path)


def read_rigs(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rigs, bones, keyframes, errors) of the JSON documents under ``path``: a file each, or a line each if ``lines``.

    Documents are parsed once, with every field, and the tables are taken from that: one with a
    field of a wrong type, text that isn't JSON, or no id is in ``errors`` (file, id, reason,
    document) and in no other table.
    """
    d = spark.read.schema(RIG).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name()).transform(cut)
    why = F.when(F.col("_corrupt").isNotNull(), F.when(F.try_parse_json("_corrupt").isNull(), "not JSON").otherwise("a field has a wrong type")).when(F.col("id").isNull(), "no id")
    d = d.withColumn("reason", why)
    good = d.where("reason is null")
    rigs = good.select(F.col("id").alias("rig_id"), F.coalesce("name", "id").alias("name"), "schema_version", "canvas.width", "canvas.height", F.coalesce("bind.power", F.lit(2.0)).alias("power"), F.coalesce("bind.radius_scale", F.lit(1.0)).alias("radius_scale"), F.coalesce("duration.fps", F.lit(24.0)).alias("fps"), F.coalesce("duration.frames", F.lit(0)).alias("frames"), "layers")
    b = good.select(F.col("id").alias("rig_id"), F.posexplode("bones").alias("ord", "v"))
    bones = b.select("rig_id", F.col("v.id").alias("bone_id"), "ord", F.col("v.parent").alias("parent_id"), *(F.col(f"v.rest.{e}")[k].alias(n) for e, k, n in (("head", 0, "hx"), ("head", 1, "hy"), ("tail", 0, "tx"), ("tail", 1, "ty"))), F.coalesce("v.radius", F.lit(10.0)).alias("radius"), F.coalesce("v.falloff", F.lit("smooth")).alias("falloff"))
    k = good.select(F.col("id").alias("rig_id"), F.explode("keyframes").alias("k")).select("rig_id", F.col("k.frame").alias("frame"), F.explode("k.pose").alias("bone_id", "p"))
    keyframes = k.select("rig_id", "frame", "bone_id", *(F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(c) for c in ("rot", "tx", "ty")))
    return rigs, bones, keyframes, d.where("reason is not null").select("file", "id", "reason", F.col("_corrupt").alias("document"))


def read_strokes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(strokes (file, stroke, pt, x, y, radius), errors (file)) of JSON files: {"strokes": [...]} or a list."""
    one = "array<struct<points:array<array<double>>,radius:double>>"
    d = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    d = d.withColumn("s", F.coalesce(F.from_json("value", f"strokes {one}")["strokes"], F.when(F.ltrim("value").startswith("["), F.from_json("value", one))))
    s = d.where("s is not null").select("file", F.posexplode("s").alias("stroke", "v")).select("file", "stroke", F.col("v.radius").alias("radius"), F.posexplode("v.points").alias("pt", "p"))
    s = s.where("size(p) >= 2 and p[0] is not null and p[1] is not null").select("file", "stroke", "pt", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.rint("radius").cast("int").alias("radius"))
    return s, d.where("s is null").select("file")


def _uint(data: Column, at: int, n: int, little: bool = False) -> Column:
    h = F.hex(F.substring(data, at + 1, n))
    if little:
        h = F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))))
    return F.conv(h, 16, 10).cast("bigint")


def _jpeg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Width, height and orientation of JPEG files, by their markers."""
    for batch in batches:
        out = [jpeg_header(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
        w, h, o = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(o, pa.int32())], ["path", "w", "h", "o"])


def jpeg_header(data: bytes) -> tuple[int | None, int | None, int]:
    """(width, height, orientation) of a JPEG's first frame marker."""
    at, turn = 2, 1
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, turn
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turn = _orientation(data[at + 10 : at + 2 + size]) or turn
        at += 2 + size
    return None, None, turn


def _orientation(tiff: bytes) -> int | None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return None
    at = struct.unpack(order + "I", tiff[4:8])[0]
    if at + 2 > len(tiff):
        return None
    for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        e = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) == 12 and struct.unpack(order + "HH", e[:4]) == (0x0112, 3):
            return struct.unpack(order + "H", e[8:10])[0]
    return None


def scan_image_headers(spark: SparkSession, path: str) -> DataFrame:
    """``image_headers`` of the files under ``path``."""
    return image_headers(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def image_headers(files: DataFrame) -> DataFrame:
    """(path, format, width, height) of images (path, content) by their first bytes; unknown ones have nulls."""
    d = files.select("path", "content")
    sign = lambda at, h: F.hex(F.substring("content", at + 1, len(h) // 2)) == h
    c = F.col("content")
    riff = sign(0, "52494646") & sign(8, "57454250")
    kind = F.when(sign(0, "89504E470D0A1A0A"), "png").when(sign(0, "47494638"), "gif").when(sign(0, "424D"), "bmp").when(riff & sign(12, "56503858"), "webp_x").when(riff & sign(12, "56503820"), "webp_v").when(riff & sign(12, "5650384C"), "webp_l").when(sign(0, "FFD8FF"), "jpeg")
    d = d.withColumn("kind", kind)
    high = _uint(c, 22, 4, True)
    bits = _uint(c, 21, 4, True)
    w = F.when(F.col("kind") == "png", _uint(c, 16, 4)).when(F.col("kind") == "gif", _uint(c, 6, 2, True)).when(F.col("kind") == "bmp", _uint(c, 18, 4, True)).when(F.col("kind") == "webp_x", _uint(c, 24, 3, True) + 1).when(F.col("kind") == "webp_v", _uint(c, 26, 2, True).bitwiseAND(F.lit(0x3FFF))).when(F.col("kind") == "webp_l", bits.bitwiseAND(F.lit(0x3FFF)) + 1)
    h = F.when(F.col("kind") == "png", _uint(c, 20, 4)).when(F.col("kind") == "gif", _uint(c, 8, 2, True)).when(F.col("kind") == "bmp", F.when(high >= 1 << 31, (1 << 32) - high).otherwise(high)).when(F.col("kind") == "webp_x", _uint(c, 27, 3, True) + 1).when(F.col("kind") == "webp_v", _uint(c, 28, 2, True).bitwiseAND(F.lit(0x3FFF))).when(F.col("kind") == "webp_l", F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1)
    turned = d.where("kind = 'jpeg'").select("path", "content").mapInArrow(_jpeg, "path string, w bigint, h bigint, o int")
    swap = F.col("o") >= 5
    jpeg = turned.select("path", F.when(F.col("w").isNotNull(), "jpeg").alias("format"), F.when(swap, F.col("h")).otherwise(F.col("w")).alias("width"), F.when(swap, F.col("w")).otherwise(F.col("h")).alias("height"))
    rest = d.where("kind is null or kind <> 'jpeg'").select("path", F.split("kind", "_")[0].alias("format"), w.alias("width"), h.alias("height"))
    return rest.unionByName(jpeg)


def append_corrections(df: DataFrame, path: str) -> None:
    """Appends corrections; rig_id, content, mask and replaced are required, other fields have defaults."""
    need = ["rig_id", "content", "mask", "replaced"]
    if df.where(" or ".join(f"{c} is null" for c in need)).limit(1).count():
        raise ValueError("a correction needs rig_id, content, mask and replaced")
    defaults = {"fade": F.lit(12), "brush_radius": F.lit(12), "content_type": F.lit("image/png")}
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), v) if c in df.columns else v)
    df.write.mode("append").parquet(path)


def count_corrections(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def probe(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """(clip_id, width, height, fps, total_frames, duration_s, has_alpha) with ``meta`` (clip_id, avg_rate, r_rate, nb_frames, duration)."""

    def rate(c: str) -> Column:
        n, d = F.split(c, "/")[0].try_cast("double"), F.coalesce(F.get(F.split(c, "/"), 1).try_cast("double"), F.lit(1.0))
        return F.when(F.col(c).isNotNull(), F.when(d == 0, 0.0).otherwise(n / d))

    fps = F.coalesce(F.when(rate("avg_rate") > 0, rate("avg_rate")), rate("r_rate"), F.lit(0.0))
    found = pixels.groupBy("clip_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.countDistinct("frame").alias("_counted"), F.coalesce(F.bool_or(F.col("a") < 255), F.lit(False)).alias("has_alpha"))
    d = found.join(meta, "clip_id", "left").withColumn("fps", fps)
    n = F.coalesce(F.when(F.col("nb_frames") > 0, F.col("nb_frames")), F.when((F.col("duration") > 0) & (F.col("fps") > 0), F.rint(F.col("duration") * F.col("fps")).cast("bigint")), F.col("_counted"))
    return d.select("clip_id", "width", "height", "fps", n.cast("int").alias("total_frames"), F.when(F.col("fps") > 0, n / F.col("fps")).alias("duration_s"), "has_alpha")


def has_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("clip_id").agg(F.coalesce(F.bool_or(F.col("a") < 255), F.lit(False)).alias("has_alpha"))


def project_summary(rigs: DataFrame, files: DataFrame) -> DataFrame:
    """(rig_id, name, n_bones, n_keyframes, has_source, has_result) of valid documents, newest first.

    ``rigs`` is (rig_id, name, n_bones, n_keyframes, modified), ``files`` (rig_id, kind, ...) of sources and results.
    """
    kinds = files.groupBy("rig_id").agg(F.bool_or(F.col("kind") == "source").alias("s"), F.bool_or(F.col("kind") == "result").alias("r"))
    d = rigs.where("rig_id is not null").join(kinds, "rig_id", "left")
    return d.select("rig_id", F.coalesce("name", "rig_id").alias("name"), "n_bones", "n_keyframes", F.coalesce("s", F.lit(False)).alias("has_source"), F.coalesce("r", F.lit(False)).alias("has_result"), "modified").orderBy(F.desc("modified"), "rig_id")


def output_format(path: Column, flag: Column) -> Column:
    """The flag, in lower case, else webm, gif or mp4 by the path's ending, else mov."""
    end = F.regexp_extract(F.lower(path), r"\.(webm|gif|mp4)$", 1)
    return F.coalesce(F.lower(F.when(flag != "", flag)), F.when(end != "", end), F.lit("mov"))


def export_variants(df: DataFrame, formats: str = "all", fps_in: float = 24, fps: float = 0, scale: int = 0) -> tuple[DataFrame, DataFrame]:
    """(frames, targets (clip_id, format, error)): retimed and resized frames, and what can be written of each clip.

    A rate or width of at most 0 leaves the frames; transparent clips can't be mp4.
    """
    out = df if fps <= 0 or fps == fps_in else (retime_drop if fps < fps_in else retime_repeat)(df, fps_in, fps)
    out = resize(out, scale, -1) if scale > 0 else out
    names = ["mov", "webm", "gif", "mp4"] if formats == "all" else [x.strip() for x in formats.split(",")]
    t = has_alpha(df).select("clip_id", "has_alpha", F.explode(F.array(*map(F.lit, names))).alias("format"))
    return out, t.select("clip_id", "format", F.when(F.col("has_alpha") & (F.col("format") == "mp4"), "mp4 has no alpha").alias("error"))


def write_export(frames: DataFrame, path: str, kind: str) -> None:
    """The exported frames as parquet, json or csv."""
    getattr(frames.write, kind)(path)


def clip_table(pixels: DataFrame, fps: float) -> DataFrame:
    return clips_of(pixels).withColumn("fps", F.lit(float(fps))).withColumn("duration_s", F.col("total_frames") / fps)
