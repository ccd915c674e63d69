"""Edit-aware token counts: a segment tree of pre-tokens per document.

The tokenizer splits a text into pre-tokens and encodes each apart. A document's tree has
leaves of LEAF pre-tokens with their characters and tokens, and sums above them. An edit
re-splits the text from the leaf before the one it begins in, until a pre-token again
ends where an old leaf ended; only those leaves are encoded again, and their sums'
ancestors are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

LEAF = 64
#: Pre-tokens whose counts a worker keeps, and their longest length.
KEPT, KEPT_CHARS = 500_000, 48
EDITS = "array<struct<pos:bigint,cut:bigint,text:string>>"


class Counter:
    """Counts the tokens of pre-tokens by a file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.kept: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.kept.get(word)
        if n is None:
            n = len(self.encoding.encode_ordinary(word))
            if len(word) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[word] = n
        return n

    def total(self, words: list[str]) -> int:
        kept, count = self.kept, self.count
        return sum(kept.get(w) or count(w) for w in words)


class TokenTree:
    """A text with sums of characters and tokens over its leaves, in arrays with the root at 1."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.counter, self.encoded = text, counter, 0
        if leaves is None:
            words = counter.split.findall(text)
            groups = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
            leaves = np.array([sum(map(len, g)) for g in groups], np.int64), np.array([counter.total(g) for g in groups], np.int64)
            self.encoded = len(words)
        self.build(*leaves)

    def build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = len(chars)
        self.base = 1 << max(0, (self.n - 1).bit_length()) if self.n else 1
        self.chars, self.tokens = (np.zeros(2 * self.base, np.int64) for _ in range(2))
        for tree, leaf in ((self.chars, chars), (self.tokens, tokens)):
            tree[self.base : self.base + self.n] = leaf
            at = self.base
            while at > 1:
                tree[at // 2 : at] = tree[at : 2 * at].reshape(-1, 2).sum(1)
                at //= 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return self.chars[self.base : self.base + self.n], self.tokens[self.base : self.base + self.n]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf that holds the character ``pos``, where that leaf begins), down the tree."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if pos - start >= self.chars[k]:
                start += int(self.chars[k])
                k += 1
        return k - self.base, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.base
        dc, dt = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def edit(self, pos: int, cut: int, text: str) -> None:
        """Replaces ``cut`` characters from ``pos`` on by ``text``; both are clipped to the text."""
        pos = min(max(0, pos), len(self.text))
        cut = min(max(0, cut), len(self.text) - pos)
        if not cut and not text:
            return
        if not self.n:
            self.__init__(text, self.counter)
            return
        last = len(self.text) - 1
        first, start = self.find(min(pos, last))
        if first:  # a pre-token may depend on the character after it
            first -= 1
            start -= int(self.chars[first + self.base])
        leaf, leaf_start = self.find(min(pos + cut, last))
        end = leaf_start + int(self.chars[leaf + self.base])
        shift = len(text) - cut
        self.text = self.text[:pos] + text + self.text[pos + cut :]
        words = []
        at = start
        for m in self.counter.split.finditer(self.text, start):
            at = m.end()
            words.append(m.group())
            while at > end + shift and leaf + 1 < self.n:
                leaf += 1
                end += int(self.chars[leaf + self.base])
            if at == end + shift and at >= pos + len(text):
                break
        else:
            leaf = self.n - 1
        self.encoded += len(words)
        k = leaf - first + 1
        if len(words) > 4 * LEAF * k:
            groups = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
            c, t = self.leaves()
            new = [np.array([sum(map(len, g)) for g in groups]), np.array([self.counter.total(g) for g in groups])]
            self.build(*(np.concatenate((old[:first], mid, old[leaf + 1 :])) for old, mid in zip((c, t), new, strict=True)))
            return
        for i in range(k):
            part = words[len(words) * i // k : len(words) * (i + 1) // k]
            self.set(first + i, sum(map(len, part)), self.counter.total(part))


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """The worker's copy of the counter of that file."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def build_trees(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, edits) with ``leaf_chars``, ``leaf_tokens``, ``n_tokens`` and ``n_pretokens``.

    A null text is empty: no leaves. ``edits`` is passed on. Repeated rows get equal trees.
    """
    where, pat = (path or defaults()[0]), (pattern or defaults()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(where, pat)
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                trees = [TokenTree(t, c) for t in rows.column(1).to_pylist()]
                leaves = [t.leaves() for t in trees]
                ints = lambda k, leaves=leaves: pa.array([x[k].astype(np.int32) for x in leaves], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, ints(0), ints(1), pa.array([t.total for t in trees], pa.int64()), pa.array([t.encoded for t in trees], pa.int64())], ["doc_id", "text", "edits", "leaf_chars", "leaf_tokens", "n_tokens", "n_pretokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"doc_id bigint, text string, edits {EDITS}, leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint, n_pretokens bigint")


def apply_edits(trees: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of ``build_trees`` after their edits, in order, with ``n_reencoded`` pre-tokens.

    An edit (pos, cut, text) counts characters of the text as the edits before it left it;
    null fields are 0 or empty, and places outside the text are clipped.
    """
    where, pat = (path or defaults()[0]), (pattern or defaults()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(where, pat)
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                out = []
                for text, edits, chars, tokens in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                    t = TokenTree(text, c, (np.array(chars, np.int64), np.array(tokens, np.int64)))
                    for e in edits or ():
                        if e is not None:
                            t.edit(e["pos"] or 0, e["cut"] or 0, e["text"] or "")
                    out.append((t.text, t.total, t.encoded))
                text, total, encoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(text), rows.column(5), rows.column(6), pa.array(total, pa.int64()), pa.array(encoded, pa.int64())], ["doc_id", "text", "n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded"])

    return trees.mapInArrow(run, "doc_id bigint, text string, n_tokens bigint, n_pretokens bigint, n_tokens_edited bigint, n_reencoded bigint")


def derived_edits(text: Column, seed: Column, n: int = 3) -> Column:
    """``n`` edits of a text by hashes of ``seed``: cuts of up to 40 characters, and copies of up to 40 from elsewhere in it."""
    size = F.length(text)
    at = lambda k: F.pmod(F.xxhash64(seed, F.lit(k)), size + 1).cast("bigint")
    upto = lambda k: F.pmod(F.xxhash64(F.lit(k), seed), F.lit(41)).cast("int")
    one = lambda k: F.struct(at(k).alias("pos"), upto(k).cast("bigint").alias("cut"), F.substr(text, (at(k + 100) + 1).cast("int"), upto(k + 100)).alias("text"))
    return F.array(*(one(k) for k in range(n)))


def query(docs: DataFrame) -> DataFrame:
    """Counts of each document before and after three edits that its text and id give."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), derived_edits(text, F.col("doc_id")).alias("edits"))
    out = apply_edits(build_trees(rows))
    return out.select("doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded", F.md5("text").alias("edited_md5"))
