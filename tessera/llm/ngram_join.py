"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles. Each shingle flips one bit of one
word of a sketch, so two sketches differ in at most as many words, and in at most as many
bits, as the sets differ in members. The words are wide and nearly empty; each is held as
the exclusive-or of the codes of its set bits. For sets with a Jaccard similarity of at
least ``t`` the symmetric difference is at most ``d = (a + b)(1 - t)/(1 + t)``.

* Size bands: sketches grow by fours with the set, and a set just above a band's edge
  also takes the sketch of the band below, so linked sets share a band.
* Pigeonhole: of any d + 1 non-zero words of one sketch, one is unchanged in the other.
  All sketches order their non-zero words by one corpus-wide order and offer the first
  d + 1 as keys; the first common word is in both prefixes. The order puts words that
  the whole corpus repeats often last: a fixed table of counters, filled from every
  document, ranks them. So a common passage makes no common keys.
* Sketch test: the nodes of a key go to the key's smallest node, its lead, and all nodes
  of a lead are held against each other by a second sketch of two to four bits a
  shingle (a Hamming distance above d proves a pair apart).
* Verification: what the sketches leave joined is a family. Each family's shingle sets
  meet once, and all its pairs of fitting size that are not yet joined are tested.

Equal sets are one node throughout. Blocks bound what meets in a task: a lead's nodes or a
family beyond a block's size are dealt into parts, and each part meets each. No pair leaves
a task: a task returns, for each row, one row that it is joined with, at most. So a family
of m nodes gives m links, but where nearly all its pairs stay apart by a little, m * m / 2
tests. Keys that the counters show to be frequent never meet in one task: they are summed.

A sketch has too few non-zero words for its prefix with a chance below 1e-18 a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, mix, shingles, small_batches, text_slices, written
from .components import components

#: Similarity, as a fraction of integers.
NUM, DEN = 75, 100
#: Smallest set of the first band with words of several shingles; smaller sets use a word each.
FIRST_BAND = 128
#: Shingles a word at most, on average.
FILL = 1.6
#: Counters that rank the words; the broadcast ranks take a byte each.
SLOTS = 1 << 20
CHUNK = 4096
#: Keys in a group that one task matches, on average, and keys that a task gathers before it sends them.
GROUP_KEYS, FLUSH_KEYS = 250_000, 600_000
#: Nodes in a part of a lead, shingles in a part of a family.
LEAD_PART, FAMILY_PART = 2048, 1_000_000
#: Nodes, and shingles, that a task compares at a time, on average.
TASK_NODES, TASK_SHINGLES = 20_000, 1_000_000
#: Shingles of pairs that are counted at once.
PAIR_MEMBERS = 4_000_000
#: Equal sets of at least this count, and this share of all documents, find their node by a broadcast.
MANY_COPIES, COPY_SHARE = 1000, 1000
#: Ids of dropped documents that are broadcast, at most: some 32 bytes each in an executor.
BROADCAST_IDS = 2_000_000
#: Bits of the filter that tells which texts a join needs.
FILTER_BITS = 1 << 25

_U = np.uint64


def band_words(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(keys of the non-zero words, size of the prefix) for each band of the sorted set ``s``."""
    n = len(s)
    small, large = n * (DEN - NUM) // NUM, 2 * n * (DEN - NUM) // (DEN + NUM)
    level, low = 0, FIRST_BAND
    while n >= low:
        level, low = level + 1, low * 4
    yield _words(s, level), small + 1
    edge = low // 4
    if level and NUM * n < DEN * edge:
        yield _words(s, level - 1), large + 1


def _words(s: np.ndarray, level: int) -> np.ndarray:
    if level == 0:
        return mix(s)
    bands = int(FIRST_BAND * 4**level * DEN / NUM / FILL)
    band = ((s >> _U(32)) * _U(bands)) >> _U(32)
    starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    words = np.bitwise_xor.reduceat(mix(s ^ _U(0x5DEECE66D)), starts)
    keys = mix(words ^ mix(band[starts] * _U(64) + _U(level)))
    return keys[words != 0]


def sketch(s: np.ndarray, per: int = 1) -> bytes:
    """The parity sketch of two to four bits a shingle, times ``per``; a power of two in length."""
    bits = max(64, 1 << (2 * per * len(s) - 1).bit_length())
    at = (mix(s ^ _U(0xA5A5A5A5A5A5A5A5)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sk: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to n words; distances only shrink."""
    while sk.shape[1] > n:
        half = sk.shape[1] // 2
        sk = sk[:, :half] ^ sk[:, half:]
    return sk


def may_link(a, b, distance):
    """Whether a symmetric difference of at least ``distance`` allows the similarity."""
    return distance * (DEN + NUM) <= (a + b) * (DEN - NUM)


def linked(a, b, both):
    """Whether sets of sizes a and b with ``both`` common members link."""
    return (both > 0) & (DEN * both >= NUM * (a + b - both))


_DOC = "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, sketch binary, chunk int, counts binary"


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document (size, two fingerprints of its set, sketch), then the task's counters."""
    counts = np.zeros(SLOTS, np.int64)
    names = ["doc_id", "n", "fp1", "fp2", "sketch", "chunk", "counts"]
    for batch in batches:
        for i, j in text_slices(batch):
            rows = batch.slice(i, j - i)
            sets = shingles(Words(rows.column(1), lower=True))
            fp = [(int(mix(s).sum()), int(np.bitwise_xor.reduce(mix(s ^ _U(77))))) if len(s) else (0, 0) for s in sets]
            keys = [k for s in sets if len(s) for k, _ in band_words(s)]
            if keys:
                counts += np.bincount((np.concatenate(keys) & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), signed([x for x, _ in fp]), signed([y for _, y in fp]), pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names
            )
    if counts.any():
        parts = counts.reshape(-1, CHUNK)
        n = len(parts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array(range(n), pa.int32()), pa.array([p.astype(np.uint32).tobytes() for p in parts], pa.binary())], names)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(c, np.uint32).astype(np.int64)
            sums[k] = sums[k] + got if k in sums else got
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """0 for words of ordinary count, then 1 to 15 by the logarithm of what the count has beyond chance."""
    mean = counts.mean()
    excess, level = counts - mean, 32.0 + 6.0 * np.sqrt(mean)
    return np.where(excess < level, 0, np.clip(1 + np.log2(np.maximum(excess, 1) / level), 1, 15)).astype(np.uint8)


def _packed(x: np.ndarray) -> bytes:
    """Byte planes: equal high bytes lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def ordered(keys: np.ndarray, rank: np.ndarray, first: int) -> np.ndarray:
    """The first keys in the corpus-wide order: rare before frequent, then by hash."""
    order = np.argsort((rank[(keys & _U(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << _U(60)) | (keys >> _U(4)))
    return keys[order[:first]]


_KEYS = "r bigint, keys binary, ids binary, key bigint, id bigint"


def _offer(ranks, groups: int, left_out=None):
    """The prefix keys of the rows (doc_id, text): packed by group, and singly where a key is frequent.

    Rows whose doc_id may be in the filter ``left_out`` offer none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, held, total = ranks.value, [], 0
        names = [x.split()[0] for x in _KEYS.split(", ")]

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            hot = rank[(keys & _U(SLOTS - 1)).astype(np.int64)] > 0
            if hot.any():
                n = int(hot.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 2, pa.array(keys[hot].view(np.int64)), pa.array(ids[hot])], names)
                keys, ids = keys[~hot], ids[~hot]
            r = (((keys >> _U(32)) * _U(groups)) >> _U(32)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            r, keys, ids = r[order], (keys[order] & _U(0xFFFFFFFF)).astype(np.uint32), ids[order]
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(r))
            for lo in range(0, len(cuts), 512):
                c, e = cuts[lo : lo + 512], ends[lo : lo + 512]
                pack = lambda x, c=c, e=e: pa.array([_packed(x[i:j]) for i, j in zip(c, e, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r[c]), pack(keys), pack(ids), *[pa.nulls(len(c), pa.int64())] * 2], names)

        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                if left_out is not None:
                    rows = rows.filter(pa.array(~_maybe(left_out.value, rows.column(0))))
                for doc, s in zip(rows.column(0).to_pylist(), shingles(Words(rows.column(1), lower=True)), strict=True):
                    for keys, first in band_words(s) if len(s) else ():
                        keys = ordered(keys, rank, first)
                        held.append((keys, np.full(len(keys), doc, np.int64)))
                        total += len(keys)
                if total >= FLUSH_KEYS:
                    yield from flush()
                    held, total = [], 0
        yield from flush()

    return run


_STAR, _LINK = "lead bigint, id bigint", "a bigint, b bigint"


def _match(table: pa.Table) -> pa.Table:
    """For each key of several nodes, each of them with the smallest."""
    cat = lambda c, kind: np.concatenate([_unpacked(x, kind) for x in table.column(c).to_pylist()])
    keys, ids = cat("keys", np.uint32), cat("ids", np.int64)
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lead = np.repeat(np.minimum.reduceat(ids, cuts), np.diff(np.append(cuts, len(keys))))
    return _star(lead, ids)


def _star(lead: np.ndarray, ids: np.ndarray) -> pa.Table:
    some = lead != ids
    lead, ids = lead[some], ids[some]
    order = np.lexsort((ids, lead))
    lead, ids = lead[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (ids[1:] != ids[:-1])
    return pa.table({"lead": pa.array(lead[new]), "id": pa.array(ids[new])})


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each row the first row known to be joined with it) with the rows a and b joined."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (up != up[up]).any():
            up = up[up]
        label = up[label]


def _sketch_test(sketches: list[bytes], n: np.ndarray):
    """Which of the pairs of rows (a, b) the sketches leave open."""
    width = np.array([len(x) // 8 for x in sketches], np.int64)
    place, rows = np.zeros(len(n), np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        rows[w] = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), w)

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        wa, wb = width[a], width[b]
        for w in np.unique(np.minimum(wa, wb)).tolist():
            for v, u in ((w, w), (w, 2 * w), (2 * w, w)):  # sets that may link differ less in size
                at = np.flatnonzero((wa == v) & (wb == u))
                for lo in range(0, len(at), step := max(1, (1 << 18) // w)):
                    k = at[lo : lo + step]
                    d = np.bitwise_count(fold(rows[v][place[a[k]]], w) ^ fold(rows[u][place[b[k]]], w)).sum(1, dtype=np.int64)
                    out[k] = may_link(n[a[k]], n[b[k]], d)
        return out

    return run


def _set_test(sets: list[np.ndarray], n: np.ndarray):
    """Which of the pairs of rows (a, b) link."""
    near = _sketch_test([sketch(s, 4) for s in sets], n)
    first = np.concatenate(([0], np.cumsum(n)))
    # Small numbers for the members, in their order.
    member = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    kinds = np.int64(member.max() + 1)

    def laid(rows: np.ndarray) -> np.ndarray:
        size = n[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(pair)) + np.repeat(first[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return pair * kinds + member[at]

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = near(a, b)
        at = np.flatnonzero(out)
        work = np.cumsum(n[a[at]] + n[b[at]])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + PAIR_MEMBERS, side="right")))
            k = at[lo:hi]
            x = np.sort(np.concatenate([laid(a[k]), laid(b[k])]))
            both = np.bincount(x[1:][x[1:] == x[:-1]] // kinds, minlength=len(k))
            out[k] = linked(n[a[k]], n[b[k]], both)
            lo = hi
        return out

    return run


def joined(block: np.ndarray, part: np.ndarray, n: np.ndarray, two: np.ndarray, test) -> np.ndarray:
    """The first row that each row is joined with, directly or by others, through pairs that pass ``test``.

    Pairs are of one ``block``, of sizes that may link, and where a block holds ``two``
    parts, of both. Rows known to be joined aren't tested again. Rows are sorted by block.
    """
    label = np.arange(len(block))
    size = np.unique(block, return_counts=True)[1]
    end = np.repeat(np.cumsum(size), size)
    act, k = label, 1
    while len(act := act[act + k < end[act]]):
        a = act[label[act] != label[act + k]]
        b = a + k
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = (DEN * small >= NUM * large) & (~two[a] | (part[a] != part[b]))
        a, b = a[ok], b[ok]
        if len(a):
            hit = test(a, b)
            label = merged(label, a[hit], b[hit])
        k += 1
    return label


def _near_blocks(table: pa.Table) -> pa.Table:
    """Of blocks of sketches: rows and the first row that sketches can't keep apart from them."""
    order = np.argsort(table.column("g").to_numpy(), kind="stable")
    block, part, n, ids = (table.column(c).to_numpy()[order] for c in ("g", "part", "n", "id"))
    sketches = table.column("sketch").take(pa.array(order)).to_pylist()
    return _edges(ids, joined(block, part, n, table.column("two").to_numpy()[order], _sketch_test(sketches, n)))


def _linked_blocks(table: pa.Table) -> pa.Table:
    """Of blocks of sets: rows and the first row that links join them with."""
    order = np.argsort(table.column("g").to_numpy(), kind="stable")
    block, part, n, ids = (table.column(c).to_numpy()[order] for c in ("g", "part", "n", "id"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("members").take(pa.array(order)).to_pylist()]
    return _edges(ids, joined(block, part, n, table.column("two").to_numpy()[order], _set_test(sets, n)))


def _edges(ids: np.ndarray, label: np.ndarray) -> pa.Table:
    """Links (a, b) of ids; ids in several blocks are joined through each of them."""
    some = np.flatnonzero(label != np.arange(len(label)))
    a, b = ids[label[some]], ids[some]
    out = _star(np.minimum(a, b), np.maximum(a, b))
    return out.rename_columns(["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in text_slices(batch):
            rows = batch.slice(i, j - i)
            sets = shingles(Words(rows.column(0), lower=True))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "g", "part", "two", "n", "members"])


def _dealt(groups: DataFrame, weight: Column, most: int) -> DataFrame:
    """The rows (unit, id, ...) of ``groups`` with their block ``g``: a unit, or two parts of a unit of more than ``most`` in all.

    A large unit's members are dealt into parts, and each part meets each; ``two``: the
    block has two parts.
    """
    total = groups.groupBy("unit").agg(F.sum(weight).alias("total")).where(F.col("total") > most)
    out = groups.join(total, "unit", "left").withColumn("parts", F.coalesce(F.ceil(F.col("total") / most), F.lit(1)).cast("int"))
    out = out.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # xxhash64 names blocks; two of one name are compared together, which costs time alone.
    return out.withColumn("g", F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other"))).withColumn("two", F.col("part") != F.col("other")).drop("unit", "total", "parts", "other")


def _bits(ids: pa.Array) -> np.ndarray:
    h = mix(ids.to_numpy().view(np.uint64))
    return np.concatenate([h & _U(FILTER_BITS - 1), (h >> _U(32)) & _U(FILTER_BITS - 1)]).astype(np.int64)


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = _bits(batch.column(0))
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    parts = bits.reshape(-1, CHUNK)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["chunk", "bits"])


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            made[k] = made.get(k, np.zeros(CHUNK, np.uint8)) | np.frombuffer(c, np.uint8)
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["chunk", "bits"])


def id_filter(ids: DataFrame):
    """The filter of ``ids`` (id), broadcast: FILTER_BITS bits, whatever their number, or None without ids."""
    parts = ids.select(F.col("id").cast("bigint")).mapInArrow(_filter_parts, "chunk int, bits binary").repartition("chunk").mapInArrow(_merge_parts, "chunk int, bits binary").collect()
    bits = np.zeros((FILTER_BITS // 8 // CHUNK, CHUNK), np.uint8)
    for p in parts:
        bits[p["chunk"]] = np.frombuffer(p["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.ravel() if len(parts) else None)


def _maybe(bits: np.ndarray | None, ids: pa.Array) -> np.ndarray:
    """False only where an id is surely not in the filter."""
    if bits is None or not len(ids):
        return np.zeros(len(ids), bool)
    at = _bits(ids.fill_null(0))
    hit = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return hit[: len(ids)] & hit[len(ids) :]


def maybe_among(docs: DataFrame, shared) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that may be in the filter, as a written table.

    The filter spares most other texts a shuffle, and at worst spares none. Written, so that
    one task holds one Python worker.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_maybe(shared.value, batch.column(0))))

    return written(docs.mapInArrow(look, "doc_id bigint, text string"), "maybe")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document of ``docs`` (doc_id, text).

    Null and empty texts, and texts without words, have no set: they are their own
    components. Rows of one doc_id are one document with the largest of their texts. A
    row with a null doc_id keeps its size and has no component. Of other columns none is
    read, whatever its name. No documents give no rows.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    census = written(docs.mapInArrow(_census, _DOC), "census")
    meta = census.where("chunk is null").select("doc_id", "n", "fp1", "fp2", "sketch")
    if meta.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        discard(census)
        nulls = docs.where("doc_id is null")
        docs = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")).union(nulls), "single")
        out = _near_duplicates(docs)
        discard(docs)
        return out
    parts = census.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_sum_counts, "chunk int, counts binary").collect()
    counts = np.zeros(SLOTS, np.int64)
    for p in parts:  # SLOTS counters, however many documents
        counts[p["chunk"] * CHUNK : (p["chunk"] + 1) * CHUNK] = np.frombuffer(p["counts"], np.int64)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(int(counts.sum() * 0.6 / GROUP_KEYS), least)
    ranks = spark.sparkContext.broadcast(ranks_of(counts))
    texts = docs.where("doc_id is not null and text is not null")

    copies = _copies(meta)
    left_out = id_filter(copies.select(F.col("doc_id").alias("id")))
    some = maybe_among(texts, left_out)
    rest = some.join(copies, "doc_id", "left_anti")
    offered = written(texts.mapInArrow(_offer(ranks, groups, left_out), _KEYS).union(rest.mapInArrow(_offer(ranks, groups), _KEYS)), "keys")
    discard(some)
    stars = offered.where("r is not null").select("r", "keys", "ids").groupBy("r").applyInArrow(_match, _STAR)
    often = offered.where("r is null").select("key", "id")
    often = often.join(often.groupBy("key").agg(F.min("id").alias("lead")), "key").where("lead < id").select("lead", "id")
    stars = written(stars.union(often).distinct(), "stars")
    discard(offered)

    units = written(stars.select(F.col("lead").alias("unit"), "id").union(stars.select("lead", "lead").distinct()), "units")
    discard(stars)
    blocks = _dealt(units, F.lit(1), LEAD_PART).join(meta.select(F.col("doc_id").alias("id"), "n", "sketch"), "id")
    tasks = max(least, units.count() // TASK_NODES)
    near = written(blocks.groupBy(F.pmod("g", F.lit(tasks))).applyInArrow(_near_blocks, _LINK).distinct(), "near")
    discard(units)

    joined_ = components(near)
    family = written(joined_.join(meta.select(F.col("doc_id").alias("id"), "n"), "id").select(F.col("comp").alias("unit"), "id", "n"), "families")
    discard(near, joined_)
    blocks = _dealt(family, F.col("n"), FAMILY_PART)
    some = maybe_among(texts, id_filter(family.select("id")))
    near_texts = some.select(F.col("doc_id").alias("id"), "text").join(blocks.select("id", "g", "part", "two"), "id")
    sets = near_texts.select("text", "id", "g", "part", "two").mapInArrow(_sets, "id bigint, g bigint, part int, two boolean, n bigint, members binary")
    tasks = max(least, int(family.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES)
    links = written(sets.groupBy(F.pmod("g", F.lit(tasks))).applyInArrow(_linked_blocks, _LINK).distinct(), "linked")
    discard(family, some)

    comps = components(links)
    out = meta.select("doc_id", "n").join(copies, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
    out = out.join(comps.select(F.col("id").alias("node"), "comp"), "node", "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id")), "components")
    discard(census, copies, links, comps)
    return out


def _copies(meta: DataFrame) -> DataFrame:
    """(doc_id, node) of the documents whose set an earlier document, the node, has too."""
    same = ["n", "fp1", "fp2"]
    some = meta.where("doc_id is not null and n > 0").select("doc_id", *same)
    many = written(some.groupBy(same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("m")).where("m > 1"), "many")
    most = max(MANY_COPIES, some.count() // COPY_SHARE)  # so at most COPY_SHARE sets are broadcast
    tagged = some.join(F.broadcast(many.where(F.col("m") >= most).drop("m")), same, "left")
    rest = tagged.where("node is null").drop("node").join(many.where(F.col("m") < most).drop("m"), same)
    out = written(tagged.where("node is not null").select("doc_id", "node").union(rest.select("doc_id", "node")).where("doc_id <> node"), "copies")
    discard(many)
    return out


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id names it.

    Rows with a null doc_id stay; of rows that repeat a doc_id all stay. The ids that go
    are broadcast up to BROADCAST_IDS of them, else the documents are joined by id.
    """
    comp = near_duplicates(docs).select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_comp"))
    gone = written(comp.where("_id <> _comp").select("_id"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0d]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
u as (select doc_id, len(s) n, unnest(s) x from s),
p as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) both_ from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * both_ >= 75 * (na + nb - both_) union select b, a from p where 100 * both_ >= 75 * (na + nb - both_)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) m from r group by 1)
select doc_id, len(s)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id from s left join c on c.a = doc_id
"""
