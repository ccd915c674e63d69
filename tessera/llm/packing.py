"""Best-fit packing with several permitted sequence lengths, chosen jointly.

Documents, cut into pieces of at most the largest length, are dealt to shards by hash;
each shard is packed in decreasing size. A sequence costs its padded length, a fixed overhead
and the square of its length, as attention does: so long ones are dear, and short ones hold
no long piece and more overhead. A piece goes to the open bin that it fills best; if none
holds it, a bin of the length opens that costs least for each token that it will hold, which
is what the shard's remaining pieces, as a histogram of sizes, would still fill. In the end
each bin shrinks to the shortest length that holds its contents.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, small_batches, text_slices, written

#: Permitted lengths in tokens; a bin's fixed cost, and the length at which its square costs as much as itself; pieces a shard on average.
LENGTHS, OVERHEAD, ATTENTION, SHARD = (512, 1024, 2048, 4096, 8192), 64, 32_768, 20_000
#: Partitions that shards are dealt over at most.
MOST = 10_000


def _words(text: str | None) -> list[bytes]:
    """A text's words, and an empty one for its end; bytes are split at the six ASCII spaces alone."""
    return [*(text or "").encode().split(), b""]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): ``key`` tells rows of one doc_id with different texts apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_tokens): words and one end token; a null or empty text has its end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(Words(rows.column(2), lower=False).first) + 1)], ["doc_id", "key", "n_tokens"])

    return _keyed(docs).mapInArrow(run, "doc_id bigint, key bigint, n_tokens bigint")


def bin_cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What a sequence of that padded length costs, in tokens."""
    return length + length * length / attention + overhead


def expected_fill(room: int, sizes: list[int], left: list[int]) -> int:
    """How much of ``room`` the remaining pieces fill, the largest that fit first: ``left[k]`` of each of the rising ``sizes``."""
    free, k = room, len(sizes)
    while free and (k := bisect_right(sizes, free, 0, k)):
        k -= 1
        if left[k]:
            free -= sizes[k] * min(left[k], free // sizes[k])
    return room - free


def pack_sizes(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, its offset there, final length of each bin) for ``sizes`` in decreasing order."""
    kinds = sorted(set(sizes))
    place = {s: k for k, s in enumerate(kinds)}
    left = [0] * len(kinds)
    for s in sizes:
        left[place[s]] += 1
    cost = {c: bin_cost(c, overhead, attention) for c in lengths}
    by_rate = sorted(lengths, key=lambda c: cost[c] / c)  # the least that a length can cost for each token, if filled
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    content: list[int] = []
    where, offset = [], []
    for s in sizes:
        left[place[s]] -= 1
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            best = (math.inf, 0)
            for c in by_rate:
                if c >= s:
                    if cost[c] / c > best[0]:
                        break
                    best = min(best, (cost[c] / (s + expected_fill(c - s, kinds, left)), c))
            free, b = best[1], len(content)
            content.append(0)
        where.append(b)
        offset.append(content[b])
        content[b] += s
        if free > s:
            insort(room, (free - s, b))
    return where, offset, [lengths[bisect_left(lengths, n)] for n in content]


def pack(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(doc_id, piece, shard, bin, length, start, n_tokens, key) for ``sizes`` (doc_id, n_tokens[, key]).

    ``start``: where the piece begins in its bin; ``length``: the bin's. Documents of more
    than the largest length are cut into pieces, all kept. Rows that repeat are packed each,
    null ids too, and are dealt to shards like others; rows with a null or no positive size
    are left out. Equal inputs give equal bins however the rows are partitioned.
    """
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    key = F.col("key") if "key" in sizes.columns else F.lit(0)
    rows = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.cast("bigint").alias("key"), F.col("n_tokens").cast("bigint").alias("n")).where("n > 0")
    # Equal rows are counted, then numbered, so that they don't hash to one shard.
    rows = rows.groupBy("doc_id", "key", "n").agg(F.count(F.lit(1)).alias("m")).select("doc_id", "key", "n", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"))
    pieces = rows.select("doc_id", "key", "n", "copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int"))).alias("piece"))
    size = F.least(F.lit(top), F.col("n") - F.col("piece").cast("bigint") * top)
    pieces = written(pieces.select("doc_id", "key", "piece", size.alias("n"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "key", "n", "piece", "copy").alias("h")), "pieces")
    shards = max(1, pieces.count() // SHARD)
    shard = F.pmod("h", F.lit(shards)).alias("shard")

    def run(table: pa.Table) -> pa.Table:
        doc, key, piece, n = (table.column(c) for c in ("doc_id", "key", "piece", "n"))
        order = np.lexsort((key.fill_null(0).to_numpy(), piece.to_numpy(), doc.fill_null(-(1 << 63)).to_numpy(), -n.to_numpy()))
        where, start, size = pack_sizes(n.to_numpy()[order].tolist(), lengths)
        take = pa.array(order)
        return pa.table({
            "doc_id": doc.take(take), "piece": piece.take(take), "shard": table.column("shard").take(take), "bin": pa.array(where, pa.int64()),
            "length": pa.array([size[b] for b in where], pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": n.take(take), "key": key.take(take),
        })

    # So many partitions as shards: they are small in bytes, not in work, and would be joined to a few.
    dealt = pieces.select("doc_id", "key", "piece", "n", shard).repartition(min(shards, MOST), "shard")
    return dealt.groupBy("shard").applyInArrow(run, "doc_id bigint, piece int, shard bigint, bin bigint, length bigint, start bigint, n_tokens bigint, key bigint")


def _parts(docs: DataFrame, top: int) -> DataFrame:
    """(*SAME, part): the words of each piece of a document, joined by spaces and compressed; of equal rows one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor().compress
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                at, piece, part = [], [], []
                for k, text in enumerate(rows.column(2).to_pylist()):
                    words = _words(text)
                    for p in range(0, len(words), top):
                        at.append(k)
                        piece.append(p // top)
                        part.append(squeeze(b" ".join(words[p : p + top])))
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(piece, pa.int32()), pa.array(part, pa.binary())], ["doc_id", "key", "piece", "part"])

    return _same(_keyed(docs).mapInArrow(run, "doc_id bigint, key bigint, piece int, part binary")).groupBy(*SAME).agg(F.first("part").alias("part"))


#: Of equal rows: doc_id, whether it is null, key, and the piece, none of them null, so that texts are dealt once for both their distinct rows and their join.
SAME = ["_d", "_null", "_k", "piece"]


def _same(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_d": F.coalesce("doc_id", F.lit(-1)), "_null": F.col("doc_id").isNull(), "_k": F.coalesce("key", F.lit(0))})


def _laid_out(docs: DataFrame, packed: DataFrame, lengths: tuple[int, ...], made: Callable[[bytes], object], kind: str) -> DataFrame:
    """(shard, bin, length, n_tokens, made) of each bin: ``made`` of its pieces' words in order of ``start``.

    Pieces meet their places and then their bins, whose rows follow each other in a sorted
    partition, so a task holds one bin at a time.
    """
    laid = _same(packed).join(_parts(docs, max(lengths)), SAME).select("shard", "bin", "length", "n_tokens", "start", "part")
    laid = laid.repartition("shard", "bin").sortWithinPartitions("shard", "bin", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        own, tokens, parts = None, 0, []
        for batch in itertools.chain(batches, [None]):
            out = []
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True) if batch is not None else [(None, None, None, 0, None)]
            for shard, bin_, length, n, part in rows:
                if (shard, bin_, length) != own:
                    if parts:
                        out.append((*own, tokens, made(b" ".join(parts))))
                    own, tokens, parts = (shard, bin_, length), 0, []
                tokens += n
                if part is not None:
                    parts.append(whole(part))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["shard", "bin", "length", "n_tokens", kind])

    return laid.mapInArrow(run, f"shard bigint, bin bigint, length bigint, n_tokens bigint, {kind} string")


def sequence_texts(docs: DataFrame, packed: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(shard, bin, length, n_tokens, text): the training sequences that ``packed`` plans for ``docs`` (doc_id, text).

    A sequence is its pieces' words in order of ``start``, joined by single spaces, where each
    document is ended by an empty word. Every row of ``docs`` is in a sequence, those with null
    or repeated ids and repeated rows too. A piece is at most the largest length and a sequence
    too, so no row is large, and texts are shuffled twice: to their places and to their bins.
    """
    return _laid_out(docs, packed, lengths, lambda text: text, "text")


def sequences(docs: DataFrame, packed: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(shard, bin, length, n_tokens, words) of ``sequence_texts``, the words as arrays of at most the length."""
    return sequence_texts(docs, packed, lengths).select("shard", "bin", "length", "n_tokens", F.split("text", " ").alias("words"))


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, shard, bin, length, start, n_tokens, sequence_sha256) of each document's pieces.

    The last is the digest of the whole sequence that the piece is in, as ``sequence_texts`` lays it out.
    """
    packed = written(pack(token_counts(docs)), "packed")
    with small_batches(docs.sparkSession):
        made = written(_laid_out(docs, packed, LENGTHS, lambda text: hashlib.sha256(text).hexdigest(), "sequence_sha256").select("shard", "bin", "sequence_sha256"), "sequences")
    return packed.drop("key").join(made, ["shard", "bin"]).select("doc_id", "piece", "shard", "bin", "length", "start", "n_tokens", "sequence_sha256")
