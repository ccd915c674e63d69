"""What the text operators share: Arrow slices, word hashes, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes of text that one numpy pass handles; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing that is still to run reads them; others stay."""
    for table in tables:
        where = table.__dict__.get("_written_to")
        if where:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def renamed(table: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of a table that ``written`` made, to be discarded as it is."""
    out = table.select(*columns)
    out._written_to = table._written_to
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python in batches of so many rows, not ten thousand: an executor holds several at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most SLICE_BYTES of text each, or of one row."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    ends = np.asarray(offsets(col), dtype=np.int64)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(ends, ends[i] + SLICE_BYTES, side="right")) - 1
        j = min(len(col), max(j, i + 1))
        yield i, j
        i = j


def offsets(col: pa.Array) -> np.ndarray:
    """The n+1 byte offsets of a string or binary column."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets from 0) of a string column; null rows are empty."""
    at = offsets(col).astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[at[0] : at[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


_RNG = np.random.RandomState(20240229)
#: One random 64-bit number a byte value, for polynomial word hashes.
_BYTE = _RNG.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("b", ())) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in (("b", _BASE), ("i", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["b"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), as of a splittable generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    ``start``, ``end``: byte positions in ``data``; ``first``: n+1 positions of each
    document's words; ``hash``: 64-bit hashes, with A-Z as a-z if ``lower``.
    """

    def __init__(self, col: pa.Array, lower: bool):
        data, at = column_bytes(col)
        self.data, self.at = _LOWER[data] if lower else data, at
        inside = ~_SPACE[self.data]
        # A document's first byte begins a word, whatever precedes it in the buffer.
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        start = inside & (~before | edge[:-1])
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        end = inside & (~after | edge[1:])
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, at)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            n = len(self.data)
            power, inverse = _power(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[:n], out=sums[1:])
            self._hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        return self._hash


def shingles(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct ``size``-word shingle hashes; fewer words make one."""
    h, first = words.hash, words.first
    m = np.uint64(0xD6E8FEB86659FD93)
    roll = h.copy()
    for k in range(1, size):
        roll[:-k] = roll[:-k] * m + h[k:] if k < len(h) else roll[:-k]
    roll = mix(roll)
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            s = np.sort(roll[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = np.uint64((int(one) * int(m) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def range_hash(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) of ``w.data``, equal for equal bytes."""
    if not hasattr(w, "_sums"):
        power, _ = _power(len(w.data))
        w._sums = np.zeros(len(w.data) + 1, np.uint64)
        np.cumsum(_BYTE[w.data] * power[: len(w.data)], out=w._sums[1:])
    _, inverse = _power(len(w.data))
    return mix((w._sums[end] - w._sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def fold_of(fold: int) -> Column:
    """True where crc32(doc_id as text) mod ``fold`` is 2, and where there is no doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % fold == 2, F.lit(True))


def first_of_each(rows: DataFrame, label: str, n: int) -> DataFrame:
    """The distinct (doc_id, label), at most ``n`` of each label, that come first by a hash of doc_id.

    Each label's ids are counted (by a sketch, within some per cent) and thinned to about twice
    ``n`` before they are ranked, so no task gathers a label's rows.
    """
    total = rows.groupBy(label).agg(F.greatest(F.lit(1), F.approx_count_distinct("doc_id")).alias("_total"))
    # A hash is below this share of its range for some 2n + 50 rows of each label.
    low = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < F.lit(float(1 << 63)) * ((2 * n + 50) / F.col("_total"))
    few = rows.join(F.broadcast(total), label).where(low).select("doc_id", label).distinct()
    first = Window.partitionBy(label).orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id")
    return few.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n).select("doc_id", label)
