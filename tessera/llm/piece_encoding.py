"""SentencePiece encoding and decoding with a merge-type prefix table.

A sequence of pieces is a text's merge encoding exactly if each piece next to another is
what merging gives for the two. So the last piece of each prefix is unique: of the pieces
that an automaton finds to end there, the one that is compatible with the last piece of
the prefix before it. One pass fills the table; the ids are recovered backwards.

Pieces that are runs of the space mark share one score, so merging takes them leftmost
first; they come after all other merges and are settled on the runs that remain. Segments
between characters that no piece crosses are encoded once and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
#: Segments that a worker keeps, and their longest length in characters.
KEPT, KEPT_CHARS = 400_000, 48


class PieceModel:
    """A merge-type model with byte fallback, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only merge-type models with byte fallback, without normalisation, are supported")
        self.pieces = [p.piece for p in m.pieces]
        normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == 1}
        self.bytes = [next(i for i, p in enumerate(m.pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.eos = next(i for i, p in enumerate(m.pieces) if p.piece == "</s>")
        self.chars = {p for p in normal if len(p) == 1}
        known = {p: v for p, v in normal.items() if all(c in self.chars for c in p)}
        self.runs = {len(p): v for p, v in known.items() if set(p) == {MARK}}
        self.score = {p: s for p, (_, s) in known.items() if set(p) != {MARK} or len(p) == 1}
        self.id = {p: i for p, (i, _) in known.items()}
        if any(MARK in p[1:] for p in self.score):
            raise ValueError("pieces that cross words aren't supported")
        scores = [s for p, s in self.score.items() if len(p) > 1]
        if len(set(scores)) < len(scores) or any(s >= min(scores) for n, (_, s) in self.runs.items() if n > 1):
            raise ValueError("pieces of equal scores aren't supported")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if self.merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, tuple[bytes, int, bytes]] = {}
        self.run_ids: dict[int, list[int]] = {}
        hard = [c for c in "\n\r\t" if c not in self.chars]
        cut = re.escape("".join(hard))
        self.segment = re.compile(f"[{cut}]|{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" if hard else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def merged(self, text: str) -> list[str]:
        """The pieces by merging the best pair first, without runs of the mark; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives these two pieces."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def last_pieces(self, text: str) -> list[str]:
        """For each prefix of ``text`` its encoding's last piece; unknown characters stand alone."""
        n = len(text)
        last: list[str] = [""] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, piece in self.automaton.iter(text):
            p = end + 1
            if last[p]:
                continue
            start = p - len(piece)
            before = last[start]
            if start and not before:
                before = last[start] = text[start - 1]  # no piece ends there: an unknown character
            if not start or len(before) == 1 and before not in self.chars:
                last[p] = piece
            else:
                got = fits.get((before, piece))
                if got or got is None and compatible(before, piece):
                    last[p] = piece
        for p in range(1, n + 1):
            if not last[p]:
                last[p] = text[p - 1]
        return last

    def segment_ids(self, text: str) -> list[int]:
        """The ids of a segment, recovered backwards from the table."""
        last, out, p = self.last_pieces(text), [], len(text)
        run = 0

        def close() -> None:
            out.extend(reversed(self.run(run)))

        while p:
            piece = last[p]
            if piece == MARK:
                run += 1
            else:
                if run:
                    close()
                    run = 0
                i = self.id.get(piece)
                if i is None or piece not in self.score:
                    out.extend(self.bytes[b] for b in reversed(piece.encode()))
                else:
                    out.append(i)
            p -= len(piece)
        if run:
            close()
        return out[::-1]

    def run(self, n: int) -> list[int]:
        """The ids of a run of n marks: equal scores, so the leftmost pair merges first."""
        got = self.run_ids.get(n)
        if got is not None:
            return got
        size, right, left = [1] * n, list(range(1, n)) + [-1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and size[i] + size[j] in self.runs:
                heapq.heappush(heap, (-self.runs[size[i] + size[j]][1], i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if size[i] == a else -1
            if j < 0 or size[j] != b:
                continue
            size[i], size[j], right[i] = a + b, 0, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        got, i = [], 0
        while i >= 0 and n:
            got.append(self.runs[size[i]][0])
            i = right[i]
        if len(self.run_ids) < 10_000:
            self.run_ids[n] = got
        return got

    def part(self, segment: str) -> tuple[bytes, int, bytes]:
        """(ids as " 1 2", their number, decoded bytes) of a segment."""
        ids = self.segment_ids(segment)
        made = (b"".join(b" %d" % i for i in ids), len(ids), self.decode_part(ids))
        if len(segment) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[segment] = made
        return made

    def decode_part(self, ids: list[int]) -> bytes:
        if not hasattr(self, "_back"):
            self._back = [p.replace(MARK, " ").encode() for p in self.pieces]
            for b, i in enumerate(self.bytes):
                self._back[i] = bytes([b])
        return b"".join(self._back[i] for i in ids)

    def parts(self, text: str) -> list[tuple[bytes, int, bytes]]:
        kept, part = self.kept, self.part
        return [kept.get(s) or part(s) for s in self.segment((MARK + text).replace(" ", MARK))] if text else []

    def encode(self, text: str) -> list[int]:
        """All ids of ``text``, with the end id."""
        return [int(x) for p, _, _ in self.parts(text) for x in p.split()] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: one leading space is the encoder's; bytes that aren't UTF-8 become U+FFFD."""
        out = self.decode_part([i for i in ids if i != self.eos])
        return out[1 if out[:1] == b" " else 0 :].decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's copy of the model in that file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): each row's ids, the end id last, and what they decode to.

    A null text is empty: it has the end id alone. Repeated rows are encoded each.
    """
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where)
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                ids = [m.encode(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives, without its arrays."""
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where)
        end = b" %d" % m.eos
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                n, a, b = [], [], []
                for t in rows.column(1).to_pylist():
                    parts = m.parts(t or "")
                    ids, counts, back = zip(*parts, strict=True) if parts else ((), (), ())
                    n.append(sum(counts) + 1)
                    a.append(hashlib.sha256((b"".join(ids) + end)[1:]).hexdigest())
                    out = b"".join(back)
                    b.append(hashlib.sha256(out[1 if out[:1] == b" " else 0 :]).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    return digests(docs)
