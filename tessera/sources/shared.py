"""The folder that driver and executors share, and tables and lineage cut in it."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a group, such as a frame's pixels, that one task takes whole: a frame of 1920 x 1080 is one.
WHOLE = 1 << 21
#: Rows of whole frames that a task takes in one call, when frames are small.
AT_ONCE = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-tessera-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def by_size(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most WHOLE rows, and those of larger ones, or None if there are none; counts ``df`` once."""
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE).select(*by).transform(cut)
    if large.limit(1).count() == 0:
        return df, None
    return df.join(large, by, "left_anti"), df.join(large, by, "left_semi")


def _frame_codes(table: pa.Table) -> np.ndarray:
    """A number for each row, the same for rows of the same frame (clip_id, frame) only."""
    codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("clip_id", "frame")]
    clip, frame = ((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy().astype(np.int64) for c in codes)
    return clip * (frame.max(initial=0) + 1) + frame


def frame_numbers(table: pa.Table) -> np.ndarray:
    """Each row's frame, numbered from 0, of rows in which those of a frame (clip_id, frame) lie together."""
    return np.cumsum(np.diff(codes, prepend=codes[:1]) != 0) if len(codes := _frame_codes(table)) else codes


def frames_at_once(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, weight: str | None = None) -> DataFrame:
    """``run`` over the whole frames (clip_id, frame) of ``df``, as many at once as have about AT_ONCE rows.

    Small frames would cost a call each if each were a group. ``weight``: a column of what a row counts for besides
    itself; such rows are few bytes, of which the adaptive engine would make few tasks, so they are dealt over all shuffle partitions.
    """
    most = AT_ONCE
    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if weight else []

    def size(table: pa.Table | pa.RecordBatch) -> int:
        return len(table) + (int(pc.sum(table.column(weight)).as_py() or 0) if weight else 0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += size(batch)
            if n < most:
                continue
            table = pa.Table.from_batches(held)
            number = frame_numbers(table)
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield from run(table.slice(0, last)).to_batches()
            table = table.slice(last)
            held, n = table.to_batches(), size(table)
        if n:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*parts, "clip_id", "frame").sortWithinPartitions("clip_id", "frame").mapInArrow(whole, schema)


def packed(pixels: DataFrame) -> DataFrame:
    """(clip_id, frame, n, height, width, size, data): rows of pixels (clip_id, frame, y, x, ...) of a frame that come together, as one.

    ``data`` has the ``n`` rows' columns besides the frame as a compressed Arrow batch, of ``size`` bytes when it
    isn't; ``height`` and ``width`` reach their largest y and x. A frame may be many such rows, of up to AT_ONCE pixels each.
    """
    kinds, most = dict(pixels.dtypes), AT_ONCE
    arrow = to_arrow_schema(StructType([f for f in pixels.schema if f.name not in ("clip_id", "frame")]))

    def pack(table: pa.Table) -> pa.RecordBatch:
        codes = _frame_codes(table)
        if (np.diff(codes) < 0).any():
            table = table.take(np.argsort(codes, kind="stable"))
        at = np.unique(frame_numbers(table), return_index=True)[1]
        ends = [*at[1:].tolist(), len(table)]
        rows = table.select(arrow.names).cast(arrow).combine_chunks().to_batches()[0]
        plain = [rows.slice(a, b - a).serialize() for a, b in zip(at.tolist(), ends, strict=True)]
        reach = [np.maximum.reduceat(table.column(c).to_numpy(), at) + 1 for c in ("y", "x")]
        ids = [table.column(c).take(at).combine_chunks() for c in ("clip_id", "frame")]
        data = pa.array([pa.compress(p, "zstd", asbytes=True) for p in plain], pa.binary())
        rest = [np.diff(at, append=len(table)), *reach, [p.size for p in plain]]
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(c).cast(pa.int32()) for c in rest), data], ["clip_id", "frame", "n", "height", "width", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    return pixels.mapInArrow(run, f"clip_id {kinds['clip_id']}, frame {kinds['frame']}, n int, height int, width int, size int, data binary")


def unpack(table: pa.Table, schema: StructType) -> pa.Table:
    """The pixels of rows of ``packed`` (clip_id, frame, n, size, data), one row's after the other's; ``schema`` is theirs."""
    arrow = to_arrow_schema(StructType([f for f in schema if f.name not in ("clip_id", "frame")]))
    plain = (pa.decompress(d.as_buffer(), n, "zstd") for d, n in zip(table.column("data"), table.column("size").to_pylist(), strict=True))
    rows = pa.Table.from_batches([pa.ipc.read_record_batch(p, arrow) for p in plain], arrow).combine_chunks()
    each = np.repeat(np.arange(len(table)), table.column("n").to_numpy())
    columns = {c: table.column(c).combine_chunks().take(each) for c in ("clip_id", "frame")} | {c: rows.column(c) for c in arrow.names}
    return pa.table({c: columns[c] for c in schema.names})


def unpacked(df: DataFrame, schema: StructType) -> DataFrame:
    """The pixels that ``packed`` made ``df`` of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from unpack(pa.Table.from_batches([batch.slice(k, 1)]), schema).to_batches()

    return df.mapInArrow(run, schema)


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, each row's place from 0 within its group ``by`` in that order.

    Partitions are ranges, so a large group is spread; a row's place is its partition's offset and its place there.
    """
    d = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()).transform(cut)
    d = d.withColumn("_part", F.shiftright("_at", 33))
    parts = d.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*by, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return d.join(parts, [*by, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"))
