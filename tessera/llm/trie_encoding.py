"""Byte-level BPE encoding and decoding over a trie of distinct words.

A text is cut into words (and special tokens) as the library cuts it. The distinct words of
some texts are inserted into a trie; one depth-first pass hands each node the states of its
path: for each prefix the last token of its encoding, and that encoding. A prefix's last
token is the one that ends there and that merging leaves standing beside the last token of
the prefix before it, so a node needs its ancestors' states alone, and prefixes that words
share are encoded once. Words met before are kept in a bounded table.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The word pattern of byte-level pre-tokenizers: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of characters that both expressions class alike; it runs three times as fast.
PLAIN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Words that a worker keeps; words of a trie; bytes of the longest word that goes into one.
KEPT, TRIE_WORDS, TRIE_BYTES = 1_000_000, 50_000, 256

#: (ids as ",1,2", their number, decoded bytes) of a word.
Part = tuple[bytes, int, bytes]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, to the byte: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieModel:
    """A byte-level BPE model, read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, special = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normalisation is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special tokens that take white space or need word ends aren't supported")
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.special = {t["content"]: t["id"] for t in special}
        self.token = {i: raw(t) for t, i in model["vocab"].items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.shown, self.length = {i: b",%d" % i for i in self.token}, {i: len(t) for i, t in self.token.items()}
        self.one = [bytes([b]) for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        ids = {t: i for i, t in self.token.items() if i not in self.special.values()}
        #: By id: the rank of the merge that makes the token (-1 for a byte), and its two parts.
        self.made, self.left, self.right = ({i: v for i in ids.values()} for v in (-1, -1, -1))
        self.id = {}
        for t, i in ids.items():
            two = self.merged(t, 2)
            if len(t) == 1 or tuple(two) in self.rank:
                self.id[t] = i
                if len(t) > 1:
                    self.made[i], self.left[i], self.right[i] = self.rank[tuple(two)], ids[two[0]], ids[two[1]]
        # Tokens that merging never leaves as they are stand in no encoding.
        self.rank_of = {ids[a] << 32 | ids[b]: k for (a, b), k in self.rank.items() if a in ids and b in ids}
        self.longest = max(map(len, self.id))
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, Part] = {}
        self.older: dict[str, Part] = {}
        self.words, self.plain_words = regex.compile(PATTERN).findall, re.compile(PLAIN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if special else lambda t: [t]
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.plain: set[str] = set()
        self.other: set[str] = set()
        self.stands: dict[int, str] = {}

    def merged(self, word: bytes, until: int = 1) -> list[bytes]:
        """The tokens by merging the pair of least rank first, leftmost on ties, until so few are left; for short words."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > until:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of the tokens ``a`` and ``b`` gives these two.

        Their merges are undone, the last first. A pair that meets at the border must not have
        been due before the merges that are undone: before those of the right one even on ties.
        """
        key = a << 32 | b
        got = self.fits.get(key)
        if got is None:
            made, rank_of, due = self.made, self.rank_of, 1 << 62
            while got is None:
                if rank_of.get(a << 32 | b, due) < due:
                    got = False
                elif made[a] > made[b]:
                    due, a = made[a], self.right[a]
                elif made[b] >= 0:
                    due, b = made[b] + 1, self.left[b]
                else:
                    got = True
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = got
        return got

    def last_token(self, word: bytes, depth: int, last: list[int], sizes: list[int]) -> int:
        """The last token of the encoding of ``word[:depth]``; ``last`` has those of its shorter prefixes, ``sizes`` their lengths.

        Exactly one token fits, so the likeliest lengths come first: one more byte than the
        last token had, and fewer.
        """
        ids, fits = self.id, self.fits
        most = depth if depth < self.longest else self.longest
        likely = sizes[-1] + 1 if sizes[-1] < most else most
        for some in (range(likely, 0, -1), range(likely + 1, most + 1)):
            for k in some:
                t = ids.get(word[depth - k : depth])
                if t is not None:
                    if k == depth:
                        return t
                    a = last[depth - k]
                    fit = fits.get(a << 32 | t)
                    if fit or fit is None and self.compatible(a, t):
                        return t
        raise ValueError(f"the vocabulary lacks the byte {word[depth - 1]}")

    def spread(self, words: Iterable[str]) -> dict[str, Part]:
        """The parts of distinct words, by one depth-first pass over their trie.

        A node has what follows it by byte, and at -1 the word that ends there. The decoded
        bytes of a prefix are its tokens' own, one after the other: the path itself.
        """
        collecting = gc.isenabled()
        gc.disable()  # a trie is many small objects, none of them in a cycle
        try:
            return self._spread(words)
        finally:
            if collecting:
                gc.enable()

    def _spread(self, words: Iterable[str]) -> dict[str, Part]:
        root: dict = {}
        for w in words:
            node = root
            for b in w.encode():
                if b in node:
                    node = node[b]
                else:
                    node[b] = node = {}
            node[-1] = w
        out: dict[str, Part] = {}
        last, sizes, ids, counts = [-1], [0], [b""], [0]
        length, shown, last_token, one = self.length, self.shown, self.last_token, self.one
        todo = [(one[b], node) for b, node in root.items()]
        while todo:
            path, node = todo.pop()
            depth = len(path)
            if len(last) > depth:
                del last[depth:], sizes[depth:], ids[depth:], counts[depth:]
            t = last_token(path, depth, last, sizes)
            k = length[t]
            text, n = ids[depth - k] + shown[t], counts[depth - k] + 1
            if -1 in node:
                out[node.pop(-1)] = (text, n, path)
            if node:
                last.append(t)
                sizes.append(k)
                ids.append(text)
                counts.append(n)
                todo += [(path + one[b], below) for b, below in node.items()]
        return out

    def long_word(self, word: bytes) -> Part:
        """The part of a word of any length: the same states along one path, its tokens found backwards."""
        last, sizes = [-1], [0]
        for depth in range(1, len(word) + 1):
            t = self.last_token(word, depth, last, sizes)
            last.append(t)
            sizes.append(self.length[t])
        tokens, p = [], len(word)
        while p:
            tokens.append(last[p])
            p -= sizes[p]
        tokens.reverse()
        return b"".join(self.shown[t] for t in tokens), len(tokens), b"".join(self.token[t] for t in tokens)

    def _learn(self, chars: set[str]) -> None:
        """Which characters both expressions class as the library does; for others the one that stands for each."""
        for c in chars:
            probe = lambda cut: next((k for k in "a1!" if len(cut(k + c)) == 1), "\t")  # noqa: B023, E731
            theirs = probe(self.library)
            if theirs == probe(self.plain_words):
                self.plain.add(c)
            else:
                self.other.add(c)
                if theirs != probe(self.words):
                    self.stands[ord(c)] = theirs

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        chars = set(text)
        if new := chars - self.plain - self.other:
            self._learn(new)
        if chars <= self.plain:
            return self.plain_words(text)
        if self.stands and (shown := text.translate(self.stands)) != text:
            out, p = [], 0
            for w in self.words(shown):
                out.append(text[p : p + len(w)])
                p += len(w)
            return out
        return self.words(text)

    def parts(self, texts: list[str]) -> list[list[Part]]:
        """Each text's parts in order; words not met before go through one trie.

        The words met of late are kept in two tables: when the newer is full, it takes the older's place.
        """
        cut = [[(s in self.special, s if s in self.special else self.split(s)) for s in self.at_special(t) if s] for t in texts]
        words = set()
        for pieces in cut:
            for is_special, ws in pieces:
                if not is_special:
                    words.update(ws)
        if len(self.kept) > KEPT // 2:
            self.older, self.kept = self.kept, {}
        known, older = self.kept, self.older
        new = words - known.keys()
        for w in new & older.keys():
            known[w] = older[w]
        new -= known.keys()
        once = {t: (self.shown[i], 1, self.token[i]) for t, i in self.special.items()}
        short = []
        for w in new:
            if len(w) * 4 > TRIE_BYTES and len(w.encode()) > TRIE_BYTES:
                once[w] = self.long_word(w.encode())
            else:
                short.append(w)
        rest = iter(short)
        while some := list(islice(rest, TRIE_WORDS)):
            known.update(self.spread(some))
        out = []
        for pieces in cut:
            own: list[Part] = []
            for is_special, ws in pieces:
                own += [once[ws]] if is_special else [known.get(w) or once[w] for w in ws]
            out.append(own)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _, _ in self.parts([text])[0] for x in ids.split(b",")[1:]]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, special tokens as their strings; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.token.get(i, b"") for i in ids).decode("utf-8", "replace")


_models: dict[str, TrieModel] = {}


def model(path: str) -> TrieModel:
    """The worker's copy of the model in that file."""
    if path not in _models:
        _models[path] = TrieModel(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): each row's ids and what they decode to.

    A null text is empty and has no ids. Repeated rows are encoded each; other columns of
    ``docs`` are not read.
    """
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where)
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                found = m.parts([t or "" for t in rows.column(1).to_pylist()])
                ids = [[int(x) for p, _, _ in parts for x in p.split(b",")[1:]] for parts in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives, without its arrays."""
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where)
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                n, a, b = [], [], []
                for parts in m.parts([t or "" for t in rows.column(1).to_pylist()]):
                    ids, counts, back = zip(*parts, strict=True) if parts else ((), (), ())
                    n.append(sum(counts))
                    a.append(hashlib.sha256(b"".join(ids)[1:]).hexdigest())
                    b.append(hashlib.sha256(b"".join(back).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    return digests(docs)
