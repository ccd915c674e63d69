"""Toxicity by maximum-scoring segments.

Words, and their first four and five bytes, get log-odds of toxic against clean rows with
an informative Dirichlet prior, shrunk by their standard error. Along a text, words carry
the score of their best unit, other words a small negative one; a linear scan finds all
maximal-scoring segments. Their scores are calibrated as extreme values: the best segment
of n clean words exceeds s with a probability of about 1 - exp(-K n exp(-lambda s)), where
lambda follows from the scores of clean texts' words and K from their best segments. So a
document's evidence is how far its segments exceed what its length explains; a logistic
curve makes that a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, discard, docs_table, first_of_each, fold_of, range_hash, renamed, small_batches, text_slices, written

#: Labelled rows a class that the classifier is fitted on; a third calibrates.
SAMPLE = 4000
#: Units kept at most, by the lower bound of their log-odds; mass of the prior; score of other words.
UNITS, PRIOR, DRIFT = 1 << 16, 10.0, -0.4
#: Width of the steps in which clean words' scores are counted for lambda, and their number; a score above 19.75
#: counts as that there, and there alone: segments and texts have their whole scores.
STEP, STEPS = 0.25, 80
THRESHOLD = 0.3
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}|*#"]] = True


def units(w: Words) -> np.ndarray:
    """Hashes (3, words): the word without outer punctuation, its first 4 and 5 bytes (0 if no longer)."""
    s, e = w.start.copy(), w.end.copy()
    for _ in range(3):
        e = np.where((e > s + 1) & _PUNCT[w.data[e - 1]], e - 1, e)
        s = np.where((e > s + 1) & _PUNCT[w.data[np.minimum(s, len(w.data) - 1)]], s + 1, s)
    out = [range_hash(w, s, e)]
    for n in (4, 5):
        h = range_hash(w, s, np.minimum(s + n, e)) ^ np.uint64(n)
        out.append(np.where(e - s > n, h, np.uint64(0)))
    return np.stack(out) if len(s) else np.zeros((3, 0), np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic, n): in how many of the rows (text, toxic) each unit is."""
    for batch in batches:
        for i, j in text_slices(batch):
            rows = batch.slice(i, j - i)
            w = Words(rows.column(0), lower=True)
            u = units(w)
            for k, label in enumerate(rows.column(1).to_pylist()):
                x = np.unique(u[:, w.first[k] : w.first[k + 1]])
                x = x[x != 0]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.full(len(x), label, np.int32))], ["unit", "toxic"])


def segments(at: np.ndarray, scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last word), in one pass of linear time.

    ``at``: the words with positive ``scores``, in order; words between score DRIFT each.
    Each open segment knows the nearest one before it whose left sum is lower, so a search
    passes over a segment once; where there is none, all before are final and leave the list.
    """
    final: list[tuple[float, float, int, int, int]] = []  # (sum before, sum after, first, last, the nearest lower one)
    found: list[tuple[float, float, int, int, int]] = []
    total, before = 0.0, -1
    for i, s in zip(at.tolist(), scores.tolist(), strict=True):
        total += DRIFT * (i - before - 1)
        left, right, first = total, total + s, i
        total, before = right, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0:
                final += found
                found = []
                break
            if found[j][1] >= right:
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, first, i, j))
    return [(r - a, f, b) for a, r, f, b, _ in final + found]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-odds of units with a Dirichlet prior by pooled frequency, less their standard error."""
    a = PRIOR * (toxic + clean) / max(1.0, n_toxic + n_clean) + 0.01
    delta = np.log((toxic + a) / (n_toxic + PRIOR - toxic - a).clip(1e-9)) - np.log((clean + a) / (n_clean + PRIOR - clean - a).clip(1e-9))
    return delta - np.sqrt(1 / (toxic + a) + 1 / (clean + a))


class Model:
    """Sorted unit hashes with scores, lambda and K, and the logistic curve's weights."""

    def __init__(self, unit: np.ndarray, score: np.ndarray):
        self.unit, self.score = unit, score
        self.rate, self.k, self.curve = 1.0, 0.1, np.array([-3.0, 1.0, 0.5])

    def scores(self, w: Words) -> np.ndarray:
        """Each word's score: its best unit's, or DRIFT."""
        if not len(self.unit):
            return np.full(len(w.start), DRIFT)
        u = units(w)
        i = np.minimum(np.searchsorted(self.unit, u), len(self.unit) - 1)
        return np.where(self.unit[i] == u, self.score[i], DRIFT).max(0) if u.shape[1] else np.zeros(0)

    def found(self, w: Words) -> list[list[tuple[float, int, int]]]:
        s = self.scores(w)
        hot = np.flatnonzero(s > 0)
        cut = np.searchsorted(hot, w.first)
        return [segments(hot[cut[k] : cut[k + 1]] - w.first[k], s[hot[cut[k] : cut[k + 1]]]) for k in range(len(w.first) - 1)]

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> tuple[float, float]:
        """How far the best segment and all segments together exceed what ``n`` clean words give."""
        over = [max(0.0, self.rate * s - math.log(max(self.k * n, 1e-9))) for s, _, _ in found]
        return (max(over, default=0.0), math.log1p(sum(over)))

    def probability(self, top: float, all_: float) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve @ np.array([1.0, top, all_]))))))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j in text_slices(batch):
                rows = batch.slice(i, j - i)
                w = Words(rows.column(0), lower=True)
                found, scores = m.found(w), m.scores(w)
                kinds = [np.bincount(steps(scores[x:y]), minlength=STEPS)[:STEPS].tolist() for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(w.first)), pa.array([[s for s, _, _ in x] for x in found], pa.list_(pa.float64())), pa.array(kinds, long), rows.column(1)], ["n", "found", "kinds", "toxic"])

    return run


def steps(scores: np.ndarray) -> np.ndarray:
    """The step of each positive score, rounded to the nearest one."""
    return np.clip(np.rint(scores[scores > 0] / STEP).astype(np.int64), 1, STEPS - 1)


def law(clean: list[tuple[int, list[float], list[int]]]) -> tuple[float, float]:
    """(lambda, K): the segment score law of clean texts (words, segment scores, words by step of their score).

    lambda solves E exp(lambda s) = 1 over the scores of all clean words; K is the most
    likely one for each text's best segment, 0 where there is none. One word of the
    smallest step is added to the counts, so lambda is finite.
    """
    words = sum(n for n, _, _ in clean) + 1
    count = np.sum([k for _, _, k in clean], axis=0).astype(float) if clean else np.zeros(STEPS)
    count[1] += 1
    size, rest = np.arange(STEPS) * STEP, max(0.0, words - count.sum())
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (count * np.exp(np.minimum(700, mid * size))).sum() + rest * math.exp(mid * DRIFT) < words else (lo, mid)
    best = sum(n * math.exp(-lo * max(s, default=0.0)) for n, s, _ in clean)
    return lo, max(1e-9, len(clean) / max(1.0, best))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve by Newton's method, with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); null labels teach nothing."""
    with small_batches(docs.sparkSession):
        return _learn(docs, labels)


def _learn(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = written(first_of_each(marks, "toxic", SAMPLE).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3))), "sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most 2 * SAMPLE ids; rows that repeat an id are one, that of the largest text.
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.max("text").alias("text"))
    rows = written(rows.select("text", "toxic", "part"), "labelled")
    seen = {r["toxic"]: r["n"] for r in rows.where("part <> 0").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    counts = rows.where("part <> 0").select("text", "toxic").mapInArrow(_count, "unit bigint, toxic int").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # A unit of no more toxic than clean rows, by their sizes, has no positive score.
    some = counts.where(F.col("t") * max(1, n0) > F.col("c") * max(1, n1)).where("t >= 2").orderBy(F.desc(F.col("t") / (F.col("c") + 1)), F.desc("t"), "unit").limit(UNITS).collect()
    unit = np.array([r["unit"] for r in some], np.int64).view(np.uint64)
    odds = log_odds(np.array([r["t"] for r in some], float), np.array([r["c"] for r in some], float), n1, n0) if some else np.zeros(0)
    order = np.argsort(unit)
    unit, odds = unit[order], odds[order]
    model = Model(unit[odds > 1.0], odds[odds > 1.0])
    scanned = rows.where("part = 0").select("text", "toxic").mapInArrow(_scan(spark.sparkContext.broadcast(model)), "n bigint, found array<double>, kinds array<bigint>, toxic int").collect()  # at most 2 * SAMPLE rows
    discard(ids, rows)
    clean = [(r["n"], list(r["found"]), list(r["kinds"])) for r in scanned if r["toxic"] == 0]
    if len(model.unit) and clean and any(r["toxic"] for r in scanned):
        model.rate, model.k = law(clean)
        x = np.array([[1.0, *model.evidence([(s, 0, 0) for s in r["found"]], r["n"])] for r in scanned])
        model.curve = logistic(x, np.array([r["toxic"] for r in scanned], float))
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score``, ``predicted`` and ``passages`` for every row of ``docs``.

    ``passages``: (score, first, last) of each significant segment, in words from 0. Null
    and empty texts have no segment and the score of no evidence. The column ``text`` goes to Python once, kept or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for i, j in text_slices(batch, batch.schema.names[at]):
                rows = batch.slice(i, j - i)
                w = Words(rows.column(at), lower=True)
                found, n = m.found(w), np.diff(w.first)
                p = [m.probability(*m.evidence(x, int(n[k]))) for k, x in enumerate(found)]
                some = [[{"score": s, "first": a, "last": b} for s, a, b in x if m.rate * s > math.log(max(m.k * int(n[k]), 1e-9))] for k, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array(some, kind)], [*keep, "score", "predicted", "passages"])

    made = StructType.fromDDL("score double, predicted int, passages array<struct<score:double,first:bigint,last:bigint>>")
    extra = [] if text in keep else [F.col(text).cast("string").alias("_words")]
    return docs.select(*(F.col(c) for c in keep), *extra).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *made]))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~fold_of(4)))
    return predict(docs, model).select(F.col("doc_id").cast("bigint").alias("doc_id"), fold_of(4).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those predicted toxic, as a written table; learned from the labelled rows of ``docs``."""
    names = docs.columns
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold_of(4)))
    held = docs.select(*((F.col(c).cast("string") if c == "text" else F.col(c)).alias(f"_c{k}") for k, c in enumerate(names)))
    out = predict(held, model, tuple(held.columns), f"_c{names.index('text')}").where("predicted = 0")
    with small_batches(spark):
        out = written(out.select(*held.columns), "toxicity")
    return renamed(out, *(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)))
