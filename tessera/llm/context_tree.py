"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions. For every context (the last 0 to DEPTH bytes) and
every decision, zeros and ones are counted over all training texts, a
Krichevsky-Trofimov estimate is made of them, and each context's estimate is mixed with
its longer contexts' by context-tree weighting. A text's score is its log10 probability,
an end byte included, so its code length per byte follows.

The tree holds every context that was seen. Counts are summed in Spark, and the subtrees
below three bytes are weighted in groups of them; the driver weights the two levels above,
which at most 256 + 256^2 contexts have. Texts are scored in chunks: a chunk's distinct
codes go to the groups that hold their counts, and their log probabilities come back.

The unigram base score needs each word's exact count. Words with at least 1/HOT_SHARE of the
tokens are broadcast; the others go to the tasks that hold their counts, packed, and
come back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, SLICE_BYTES, Words, column_bytes, fold_of, mix, small_batches, text_slices, written
from .ngram_join import _packed, _unpacked

DEPTH = 5
#: If set, contexts with less than 1/SHARE of the symbols are pooled into one further child of their parent.
SHARE: int | None = None
#: The bytes of the contexts whose subtrees are weighted together; symbols of a chunk; counts and symbols of a group.
TOP, CHUNK_SYMBOLS, GROUP_GRAMS, GROUP_SYMBOLS = 3, 4_000_000, 500_000, 20_000_000
#: Log weights are summed as integers, so equal runs give equal sums.
FIXED = float(1 << 26)
#: Words of at least this share of the tokens are broadcast, so at most as many words, in 16 bytes each.
HOT_SHARE = 1 << 20
END = 255  # no byte of UTF-8
#: Grams or words that a task holds before it sends their sums; tail tokens in a packed chunk and in a group.
HELD, CHUNK_TOKENS, GROUP_TOKENS = 2_000_000, 1_000_000, 250_000
CHUNK_DOCS = 20_000
END_TOKEN = np.uint64(0xE7D)

_U = np.uint64


def framed(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with DEPTH end bytes before and one after each text, positions of symbols, symbols' n+1 offsets)."""
    return _framed(*column_bytes(col))


def _framed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(at) - 1
    size = np.diff(at)
    out = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    where = np.arange(len(data)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, size)
    out[where] = _LOWER[data]
    first = np.concatenate(([0], np.cumsum(size + 1)))
    symbols = np.arange(first[-1]) + np.repeat((np.arange(n) + 1) * DEPTH, size + 1)
    return out, symbols, first


def grams(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Codes of the symbols at ``at``: the last byte before it highest, then earlier ones, the symbol lowest."""
    code = buf[at].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        code |= buf[at - d].astype(np.uint64) << _U(8 * (DEPTH + 1 - d))
    return code


def _parts(text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, next text, codes, symbols' offsets) of texts in ranges of some SLICE_BYTES: codes take 8 bytes a symbol."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1))
        buf, symbols, first = _framed(text[at[i] : at[j]], at[i : j + 1] - at[i])
        yield i, j, grams(buf, symbols), first
        i = j


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``x`` in order, and where each begins when ``x`` is sorted."""
    x = np.sort(x)
    first = np.flatnonzero(_starts(x))
    return x[first], first


def distinct_codes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sorted codes that occur in a chunk of texts."""
    return _runs(np.concatenate([_runs(codes)[0] for _, _, codes, _ in _parts(text, at)]))[0]


class _Sums:
    """Counts by code, merged as they come."""

    def __init__(self, kind: int):
        self.kind, self.codes, self.counts, self.size = kind, [], [], 0

    def add(self, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, first = _runs(codes)
        self.codes.append(x)
        self.counts.append(np.diff(np.append(first, len(codes))))
        self.size += len(x)
        if self.size > HELD:
            self.merge()
            if self.size > HELD // 2:
                yield from self.send()

    def merge(self) -> None:
        if len(self.codes) > 1:
            x, n = np.concatenate(self.codes), np.concatenate(self.counts)
            order = np.argsort(x)
            x, n = x[order], n[order]
            cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            self.codes, self.counts = [x[cut]], [np.add.reduceat(n, cut)]
            self.size = len(cut)

    def send(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for x, n in zip(self.codes, self.counts, strict=True):
            for i in range(0, len(x), 100_000):
                part = x[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.kind, np.int32)), pa.array(part), pa.array(n[i : i + 100_000])], ["kind", "code", "count"])
        self.codes, self.counts, self.size = [], [], 0


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's words and then its end token, n+1 offsets)."""
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(first[-1], END_TOKEN, np.uint64)
    out[np.arange(len(w.start)) + np.repeat(np.arange(n), np.diff(w.first))] = w.hash
    return out, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_gram, by_word = _Sums(0), _Sums(1)
    for batch in batches:
        for i, j in text_slices(batch):
            col = batch.column(0).slice(i, j - i)
            buf, at, _ = framed(col)
            yield from by_gram.add(grams(buf, at))
            yield from by_word.add(tokens(Words(col, lower=True))[0])
    yield from by_gram.send()
    yield from by_word.send()


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x > 0, by Stirling's series after a shift of 8."""
    z = x + 8
    low = np.log(x * (x + 1)) + np.log((x + 2) * (x + 3)) + np.log((x + 4) * (x + 5)) + np.log((x + 6) * (x + 7))
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


_COUNTS = np.arange(1 << 16, dtype=float)
_HALF, _WHOLE = lgamma(_COUNTS + 0.5), lgamma(_COUNTS + 1)


def _at(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    big = n >= len(table)
    out[big] = lgamma(n[big] + shift)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that Krichevsky-Trofimov estimates give the counts."""
    return _at(_HALF, zeros, 0.5) + _at(_HALF, ones, 0.5) - _at(_WHOLE, zeros + ones, 1.0) - np.log(np.pi)


def _starts(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _mix(n0, n1, k0, k1, logs, inner):
    """(log weighted probability, the weight of the node's own estimate, its estimate, the rest's estimate).

    ``k0``, ``k1``, ``logs``: the kept children's counts and summed log weighted probabilities.
    """
    own, below = kt(n0, n1), kt(n0 - k0, n1 - k1) + logs
    both = np.where(inner, np.logaddexp(own, below) - np.log(2), own)
    weight = np.where(inner, np.exp(own - np.log(2) - both), 1.0)
    return both, weight, (n1 + 0.5) / (n0 + n1 + 1), (n1 - k1 + 0.5) / (n0 - k0 + n1 - k1 + 1)


class _Level:
    """A group's contexts of one depth: sorted codes (context, symbol), counts, and each code's place a level up."""

    def __init__(self, code: np.ndarray, n: np.ndarray, least: float, child: _Level | None):
        self.code, self.n, self.up = code, n, None
        first = _starts(code >> _U(8))
        run = np.cumsum(first) - 1
        self.kept = (np.add.reduceat(n, np.flatnonzero(first)) >= least)[run]
        self.inner = np.zeros(len(code), bool)
        if child is not None:
            self.inner = (np.bincount(run, np.bincount(child.up[child.kept], minlength=len(code))) > 0)[run]


def levels(code: np.ndarray, n: np.ndarray, least: float) -> list[_Level]:
    """From the longest contexts to those of TOP bytes."""
    out = [_Level(code, n, least, None)]
    for _ in range(DEPTH - TOP):
        here = out[-1]
        up, here.up = np.unique(here.code >> _U(16) << _U(8) | here.code & _U(255), return_inverse=True)
        out.append(_Level(up, np.bincount(here.up, here.n, len(up)), least, here))
    return out


def climb(rows: list[_Level], j: int) -> list[tuple]:
    """Of the decisions on bit ``j``, a level each: places of codes, first codes, counts and what ``_mix`` gives."""
    out = []
    for i, level in enumerate(rows):
        first = _starts(level.code >> _U(8 - j))
        node, s = np.cumsum(first) - 1, np.flatnonzero(first)
        n1 = np.add.reduceat(level.n * (level.code >> _U(7 - j) & _U(1)), s)
        n0 = np.add.reduceat(level.n, s) - n1
        k0 = k1 = logs = np.zeros(len(s))
        if i:
            _, c, c0, c1, (both, *_) = out[-1]
            keep = rows[i - 1].kept[c]
            to = node[rows[i - 1].up[c[keep]]]
            k0, k1, logs = (np.bincount(to, x[keep], len(s)) for x in (c0, c1, both))
        out.append((node, s, n0, n1, _mix(n0, n1, k0, k1, logs, level.inner[s])))
    return out


def _parents(level: _Level, s: np.ndarray, j: int) -> np.ndarray:
    """(two bytes, decision) of the nodes above the first codes ``s`` of a level of TOP bytes."""
    code = level.code[s]
    return (code >> _U(16) << _U(8) | _U(1 << j) | (code & _U(255)) >> _U(8 - j)).astype(np.int64)


def _tops(least: float):
    """A group's sums for the decisions of the contexts of two bytes."""

    def run(table: pa.Table) -> pa.Table:
        code, n = _sorted_counts(table)
        rows = levels(code, n, least)
        keys, sums = [], []
        for j in range(8):
            _, s, n0, n1, (both, *_) = climb(rows, j)[-1]
            kept = rows[-1].kept[s]
            x, at = np.unique(_parents(rows[-1], s, j), return_inverse=True)
            keys.append(x)
            sums.append([np.bincount(at, v, len(x)) for v in (n0, n1, n0 * kept, n1 * kept, np.rint(both * FIXED) * kept)])
        cols = [np.concatenate(v).astype(np.int64) for v in zip(*sums, strict=True)]
        return pa.table([np.concatenate(keys), *cols], ["key", "n0", "n1", "k0", "k1", "logs"])

    return run


def _sorted_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code, n = table.column("code").to_numpy().view(np.uint64), table.column("count").to_numpy().astype(float)
    order = np.argsort(code)
    return code[order], n[order]


class Upper:
    """The levels of no, one and two bytes, from the sums by (two bytes, decision) ``key``, sorted."""

    def __init__(self, key: np.ndarray, n0, n1, k0, k1, logs, least: float):
        def level(n0, n1, k0, k1, logs, total, below, s, q, o):
            both, w, p, rest = _mix(n0, n1, k0, k1, logs, below)
            sure, left = s + q * w * p, q * (1 - w)
            return both, sure, left, np.where(total, np.where(below, sure + left * rest, s + q * p), o)

        ctx = key >> 8
        sums = np.zeros((2, 65536))
        top = key & 255 == 1  # a context's first decision has all its symbols
        sums[:, ctx[top]] = (n0 + n1)[top], (k0 + k1)[top]
        self.kept, self.inner = sums[0] >= least, sums[1] > 0
        kept = self.kept[ctx]
        both = _mix(n0, n1, k0, k1, logs, self.inner[ctx])[0]
        to = (ctx >> 8 << 8) | key & 255
        one = [np.bincount(to, v, 65536).reshape(256, 256) for v in (n0, n1, n0 * kept, n1 * kept, both * kept)]
        total = (one[0] + one[1])[:, 1:2] >= least
        below = (one[2] + one[3])[:, 1:2] > 0
        both = _mix(*one, below)[0]
        root = [v.sum(0) for v in (one[0], one[1], one[0] * total, one[1] * total, both * total)]
        _, sure, left, out = level(*root, True, bool(total.any()), 0.0, 1.0, 0.5)
        _, self.sure1, self.left1, self.out1 = (v.ravel() for v in level(*one, total, below, sure, left, out))
        self.key = key
        self.found = level(n0, n1, k0, k1, logs, kept, self.inner[ctx], self.sure1[to], self.left1[to], self.out1[to])[1:]

    def at(self, key: np.ndarray) -> list[np.ndarray]:
        """(what is added, the weight left, the probability of a one if the text leaves the tree) by (two bytes, decision)."""
        to = (key >> 16 << 8) | key & 255
        s, q, o, kept, inner = self.sure1[to], self.left1[to], self.out1[to], self.kept[key >> 8], self.inner[key >> 8]
        w = np.where(inner, 0.5, 1.0)  # of decisions never met
        out = [s + q * w * 0.5, q * (1 - w), np.where(kept, s + q * 0.5, o)]
        if len(self.key):
            k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[k] == key
            out = [np.where(hit, f[k], x) for f, x in zip(self.found, out, strict=True)]
        return out


def code_logs(code: np.ndarray, n: np.ndarray, upper: Upper, least: float) -> np.ndarray:
    """log10 probabilities of sorted codes; those with count 0 were not trained on."""
    rows = levels(code, n, least)
    out = np.zeros(len(code))
    for j in range(8):
        got = climb(rows, j)
        s, q, o = upper.at(_parents(rows[-1], got[-1][1], j))
        for i in range(len(rows) - 1, -1, -1):
            node, first, _, _, (_, w, p, rest) = got[i]
            if i < len(rows) - 1:
                up = got[i + 1][0][rows[i].up[first]]
                s, q, o = s[up], q[up], o[up]
            sure, left = s + q * w * p, q * (1 - w)
            o = np.where(rows[i].kept[first], np.where(rows[i].inner[first], sure + left * rest, s + q * p), o)
            s, q = sure, left
        one = o[got[0][0]]
        out += np.log10(np.where(code >> _U(7 - j) & _U(1), one, 1 - one))
    return out


def group_of(code: np.ndarray, groups: int) -> np.ndarray:
    """The group of a code's last TOP bytes."""
    return ((mix(code >> _U(8 * (DEPTH + 1 - TOP))) >> _U(32)) * _U(groups)) >> _U(32)


class Model:
    """What scoring needs: the upper levels, the frequent words and the corpus's totals."""

    def __init__(self, upper: Upper, least: float, groups: int, hot: np.ndarray, hot_counts: np.ndarray, total: int, distinct: int):
        self.upper, self.least, self.groups, self.hot, self.hot_counts, self.total, self.distinct = upper, least, groups, hot, hot_counts, total, distinct


def learn(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training ``texts`` (text), the counts of all words (code, count) and of all codes by group (r, code, count)."""
    spark = texts.sparkSession
    counts = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count, "kind int, code bigint, count bigint")
    counts = written(counts.groupBy("kind", "code").agg(F.sum("count").alias("count")), "counts")
    gram, words = counts.where("kind = 0").select("code", "count"), counts.where("kind = 1").select("code", "count")
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    (symbols, distinct_grams), (total, distinct) = sums.get(0, (0, 0)), sums.get(1, (0, 0))
    least = max(1.0, symbols / SHARE) if SHARE else 1.0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct_grams // GROUP_GRAMS, symbols // GROUP_SYMBOLS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = group_of(b.column(0).to_numpy().view(np.uint64), groups)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), b.column(0), b.column(1)], ["r", "code", "count"])

    gram = gram.mapInArrow(dealt, "r bigint, code bigint, count bigint")
    tops = gram.groupBy("r").applyInArrow(_tops(least), "key bigint, n0 bigint, n1 bigint, k0 bigint, k1 bigint, logs bigint")
    # At most 255 decisions of 256^2 contexts, however large the corpus.
    got = tops.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "k0", "k1", "logs"))).toArrow()
    key, *cols = (got.column(i).to_numpy() for i in range(6))
    order = np.argsort(key)
    upper = Upper(key[order], *(c[order].astype(float) for c in cols[:4]), cols[4][order] / FIXED, least)
    often = words.where(F.col("count") >= max(1.0, total / HOT_SHARE)).toArrow()  # at most HOT_SHARE rows
    hot, n = often.column("code").to_numpy().view(np.uint64), often.column("count").to_numpy()
    order = np.argsort(hot)
    return Model(upper, least, groups, hot[order], n[order], total, distinct), words, gram


def _weigh(shared):
    """The log probabilities of each chunk's codes of one group, in the order they came."""

    def run(asked: pa.Table, gram: pa.Table) -> pa.Table:
        m = shared.value
        lists = [_codes(x) for x in asked.column("codes").to_pylist()]
        if not lists:
            return pa.table({"t": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "logs": pa.array([], pa.binary())})
        have, n = _sorted_counts(gram)
        code = _runs(np.concatenate([have, *lists]))[0]
        count = np.zeros(len(code))
        count[np.searchsorted(code, have)] = n
        logs = code_logs(code, count, m.upper, m.least).astype(np.float32)
        return pa.table({"t": asked.column("t"), "r": asked.column("r"), "logs": pa.array([_packed(logs[np.searchsorted(code, x)]) for x in lists], pa.binary())})

    return run


def _code_bytes(x: np.ndarray) -> bytes:
    """Byte planes of sorted codes; their two highest bytes are 0."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].T).tobytes()


def _codes(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(DEPTH + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : DEPTH + 1] = planes.T
    return out.view(np.uint64)[:, 0]


_PARTS = "kind int, r bigint, t bigint, codes binary, docs binary, facts binary"
_ANSWERS = "t bigint, r bigint, docs binary, counts binary, logs binary, facts binary, text binary"


def _score(shared, groups: int):
    """Documents in chunks t: a row (kind 0) with what is known of each and their text, and rows of rare words (1) and codes (2) by group r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, seq = shared.value, TaskContext.get().partitionId(), 0
        facts, codes, docs, texts, n_docs, n_codes, n_symbols = [], [], [], [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = part << 24 | seq
            if n_docs:
                known, text = np.concatenate(facts, 1), np.concatenate(texts)
                packed = pa.compress(text.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.array([t], pa.int64()), pa.array([packed], pa.binary()), pa.nulls(1, pa.binary()), pa.array([known.tobytes()], pa.binary())], _names(_PARTS))
                x, r = dealt_codes(distinct_codes(text, np.concatenate(([0], np.cumsum(known[5].astype(np.int64))))), m.groups)[:2]
                cut = np.flatnonzero(_starts(r))
                end = np.append(cut[1:], len(r))
                for lo in range(0, len(cut), 256):
                    pairs = list(zip(cut[lo : lo + 256], end[lo : lo + 256], strict=True))
                    n = len(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.array(r[cut[lo : lo + 256]].astype(np.int64)), pa.array([t] * n, pa.int64()), pa.array([_code_bytes(x[i:j]) for i, j in pairs], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _names(_PARTS))
            if n_codes:
                x, d = np.concatenate(codes), np.concatenate(docs)
                order = np.argsort(x)
                x, d = x[order], d[order]
                r = ((x >> _U(32)) * _U(groups)) >> _U(32)
                cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                end = np.append(cut[1:], len(r))
                for lo in range(0, len(cut), 256):
                    pairs = list(zip(cut[lo : lo + 256], end[lo : lo + 256], strict=True))
                    pack = lambda y, pairs=pairs: pa.array([_packed(y[i:j]) for i, j in pairs], pa.binary())
                    n = len(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 1, np.int32)), pa.array(r[cut[lo : lo + 256]].astype(np.int64)), pa.array([t] * n, pa.int64()), pack(x), pack(d), pa.nulls(n, pa.binary())], _names(_PARTS))

        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                text, ends = column_bytes(rows.column(1))
                texts.append(_LOWER[text])
                h, start = tokens(Words(rows.column(1), lower=True))
                k = np.searchsorted(m.hot, h)
                hit = (k < len(m.hot)) & (m.hot[np.minimum(k, len(m.hot) - 1)] == h) if len(m.hot) else np.zeros(len(h), bool)
                lift = np.zeros(len(h))
                lift[hit] = np.log10(m.hot_counts[k[hit]] + 1.0)
                doc = np.repeat(np.arange(j - i), np.diff(start)) + n_docs
                codes.append(h[~hit])
                docs.append(doc[~hit].astype(np.uint32))
                ids = rows.column(0)
                facts.append(np.stack([ids.fill_null(0).to_numpy().view(np.float64), ids.is_valid().to_numpy(zero_copy_only=False).astype(float), np.diff(start).astype(float), np.add.reduceat(hit.astype(float), start[:-1]), np.add.reduceat(lift, start[:-1]), np.diff(ends).astype(float)]))
                n_docs += j - i
                n_codes += len(codes[-1])
                n_symbols += len(text) + j - i
                if n_codes >= CHUNK_TOKENS or n_docs >= CHUNK_DOCS or n_symbols >= CHUNK_SYMBOLS:
                    yield from flush()
                    facts, codes, docs, texts, n_docs, n_codes, n_symbols, seq = [], [], [], [], 0, 0, 0, seq + 1
        yield from flush()

    return run


def dealt_codes(code: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, groups, places before) of sorted codes, by group and then code."""
    r = group_of(code, groups)
    order = np.argsort(r.astype(np.uint16) if groups < 1 << 16 else r, kind="stable")
    return code[order], r[order], order


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _look_up(rare: pa.Table, words: pa.Table) -> pa.Table:
    """The counts of each chunk's rare words of one group; words never trained on have none."""
    code, count = words.column("code").to_numpy().view(np.uint64), words.column("count").to_numpy()
    order = np.argsort(code)
    code, count = code[order], count[order]
    t, docs, counts = [], [], []
    for r in range(len(rare)):
        x, d = _unpacked(rare.column("codes")[r].as_py(), np.uint64), _unpacked(rare.column("docs")[r].as_py(), np.uint32)
        k = np.searchsorted(code, x)
        ok = (k < len(code)) & (code[np.minimum(k, len(code) - 1)] == x) if len(code) else np.zeros(len(x), bool)
        if ok.any():
            t.append(rare.column("t")[r].as_py())
            docs.append(_packed(d[ok]))
            counts.append(_packed(count[k[ok]]))
    return pa.table({"t": pa.array(t, pa.int64()), "docs": pa.array(docs, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _text_scores(packed: bytes, sizes: np.ndarray, logs: list[tuple[int, bytes]], groups: int) -> np.ndarray:
    """Each text's log10 probability, from its codes' by group."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(pa.decompress(packed, int(at[-1]), "zstd", asbytes=True), np.uint8)
    code = distinct_codes(text, at)
    found = np.zeros(len(code))
    found[dealt_codes(code, groups)[2]] = np.concatenate([_unpacked(x, np.float32) for _, x in sorted(logs)])
    out = np.zeros(len(sizes))
    for i, j, here, first in _parts(text, at):
        logs = np.empty(len(here))
        # 48 bits of code and 16 of place: one sort puts equal codes together.
        for k in range(0, len(here), 1 << 16):
            x = here[k : k + (1 << 16)] << _U(16) | np.arange(min(1 << 16, len(here) - k), dtype=np.uint64)
            x.sort()
            kind, place = x >> _U(16), (x & _U(0xFFFF)).astype(np.int64)
            new = np.flatnonzero(_starts(kind))
            logs[k + place] = np.repeat(found[np.searchsorted(code, kind[new])], np.diff(np.append(new, len(x))))
        out[i:j] = np.add.reduceat(logs, first[:-1])
    return out


def _gather(total: int, distinct: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        f, text = next(x for x in zip(table.column("facts").to_pylist(), table.column("text").to_pylist(), strict=True) if x[0] is not None)
        facts = np.frombuffer(f).reshape(6, -1)
        logs = [x for x in zip(table.column("r").to_pylist(), table.column("logs").to_pylist(), strict=True) if x[1] is not None]
        scores = _text_scores(text, facts[5].astype(np.int64), logs, groups)
        known, lift = facts[3].copy(), facts[4].copy()
        # In one order, so equal runs give equal sums.
        parts = [(_unpacked(d, np.uint32), _unpacked(c, np.int64)) for d, c in zip(table.column("docs").to_pylist(), table.column("counts").to_pylist(), strict=True) if d is not None]
        if parts:
            d, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((c, d))
            known += np.bincount(d, minlength=len(known))
            lift += np.bincount(d[order], np.log10(c[order] + 1.0), len(lift))
        valid = facts[1] > 0
        n = facts[2].astype(np.int64)
        return pa.table({
            "doc_id": pa.array(np.ascontiguousarray(facts[0]).view(np.int64), mask=~valid), "n_tokens": n, "n_known": known.astype(np.int64),
            "base_score": lift - n * np.log10(float(total + distinct + 1)), "score": scores,
        })

    return run


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train`` (text): what the model learns from. A null text is empty: it has its end
    alone. Repeated rows are scored each; rows with a null doc_id too. Without training
    texts every symbol has probability 1/256.
    """
    with small_batches(docs.sparkSession):
        return _score_all(docs, train)


def _score_all(docs: DataFrame, train: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    m, words, gram = learn(train)
    shared = spark.sparkContext.broadcast(m)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), m.total // (4 * GROUP_TOKENS))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = written(texts.mapInArrow(_score(shared, groups), _PARTS), "scored")
    cold = words.where(F.col("count") < max(1.0, m.total / HOT_SHARE)).withColumn("r", F.expr(f"shiftright(shiftrightunsigned(code, 32) * {groups}, 32)"))
    counts = parts.where("kind = 1").select("r", "t", "codes", "docs").groupBy("r").cogroup(cold.select("r", "code", "count").groupBy("r")).applyInArrow(_look_up, "t bigint, docs binary, counts binary")
    logs = parts.where("kind = 2").select("r", "t", "codes").groupBy("r").cogroup(gram.groupBy("r")).applyInArrow(_weigh(shared), "t bigint, r bigint, logs binary")
    facts = parts.where("kind = 0").select("t", "facts", F.col("codes").alias("text"))
    known = facts.unionByName(counts, allowMissingColumns=True).unionByName(logs, allowMissingColumns=True).select(*_names(_ANSWERS))
    out = known.groupBy("t").applyInArrow(_gather(m.total, m.distinct, m.groups), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(m.total).cast("bigint"))


def query(docs: DataFrame) -> DataFrame:
    """Texts whose crc32(doc_id) mod 7 is 2, and those without doc_id, are not learned from."""
    out = score(docs, docs.where(~fold_of(7)).select("text"))
    return out.select("doc_id", fold_of(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
