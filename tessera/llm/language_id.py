"""Language ID by sparse multinomial logistic regression on TF-IDF character n-grams.

Hashed n-grams of one to three characters; term frequencies are shares of the text's
n-grams, document frequencies count all training documents. The weights are trained with
follow-the-regularised-leader (per-coordinate rates, elastic net) on a bounded sample of
labelled rows; a temperature, fitted on rows kept apart, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, first_of_each, fold_of, renamed, small_batches, text_slices, written

DIMS = 1 << 16
ORDERS = 3
#: Labelled rows a language that the weights are fitted on; one in five is kept apart for the temperature.
SAMPLE = 600
#: The learning rate, its offset, the elastic net and the passes; this L1 leaves four fifths of the weights of n-grams met in training at zero.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.03, 1e-6, 4
SCALE = 20.0
UNKNOWN = "und"
#: The pipeline rejects documents without a letter and predictions below this.
REJECT = 0.3


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of all characters of the lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h, out = np.zeros(len(c), np.uint64), []
    for n in range(ORDERS):
        m = len(c) - n
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n:] + np.uint64(1)
        x = h * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(48)).astype(np.int64) & (DIMS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    seen = np.zeros(DIMS, bool)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            seen[:] = False
            seen[ngrams(t)] = True
            df += seen
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(df, n))], ["dim", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in text_slices(batch):
            rows = batch.slice(i, j - i)
            idx, tf = [], []
            for t in rows.column(1).to_pylist():
                x, n = np.unique(ngrams(t), return_counts=True)
                idx.append(x.astype(np.int32).tobytes())
                tf.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(idx, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "lang", "idx", "tf"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (DIMS, classes) by follow-the-regularised-leader over the rows (indices, values, class)."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    order = np.random.RandomState(3)

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(slice(None))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least loss on rows kept apart, between 1/2 and 20."""
    if not len(y):
        return 1.0
    tries = np.exp(np.linspace(np.log(0.5), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, t: float):
        self.langs, self.table, self.t = langs, table, t


def learn(labelled: DataFrame) -> Model:
    """A model of the rows (doc_id, text, lang); rows without doc_id, text or lang teach nothing.

    Of one learned language alone, every text with a letter is of it, with score 1. The
    sample is the first rows by a hash of doc_id, ties by doc_id, so equal tables give equal models.
    """
    with small_batches(labelled.sparkSession):
        return _learn(labelled)


def _learn(labelled: DataFrame) -> Model:
    rows = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.select("text").mapInArrow(_frequencies, "dim bigint, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).collect()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for r in counts:
        df[r["dim"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    ids = written(first_of_each(rows.select("doc_id", "lang").where("doc_id is not null"), "lang", SAMPLE), "sample")
    # At most SAMPLE ids a language; rows that repeat an id are one, that of the largest text.
    picked = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.max("text").alias("text")).select("doc_id", "text", "lang")

    def fit(table: pa.Table) -> pa.Table:
        langs = sorted(set(table.column("lang").to_pylist()))
        got = sorted(zip(table.column("doc_id").to_pylist(), table.column("idx").to_pylist(), table.column("tf").to_pylist(), table.column("lang").to_pylist(), strict=True))
        data = []
        for doc, i, v, lang in got:
            at = np.frombuffer(i, np.int32)
            data.append((doc, (at, np.frombuffer(v, np.float32) * idf[at] * SCALE, langs.index(lang))))
        apart = lambda k: k % 5 == 4 and len(data) >= 50
        w = train([x for k, (_, x) in enumerate(data) if not apart(k)], len(langs))
        held = [x for k, (_, x) in enumerate(data) if apart(k)]
        t = temperature(np.array([x @ w[at] for at, x, _ in held]), np.array([y for _, _, y in held]))
        full = (w * idf[:, None] * SCALE).astype(np.float32)
        return pa.table({"lang": langs, "w": [np.ascontiguousarray(full[:, k]).tobytes() for k in range(len(langs))], "t": [t] * len(langs)})

    features = picked.mapInArrow(_features, "doc_id bigint, lang string, idx binary, tf binary")
    out = sorted(features.groupBy(F.lit(1).alias("all")).applyInArrow(fit, "lang string, w binary, t double").collect(), key=lambda r: r["lang"])
    discard(ids)
    table = np.stack([np.frombuffer(r["w"], np.float32) for r in out], 1) if out else np.zeros((DIMS, 0), np.float32)
    return Model([r["lang"] for r in out], np.ascontiguousarray(table), out[0]["t"] if out else 1.0)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if
    nothing was learned. Only ``text`` is looked at, and goes to Python once, kept or not.
    Equal texts get equal results; of languages that score alike the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = zip(*(label(m, x.as_py()) for x in batch.column(at)), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    made = StructType.fromDDL("lang_pred string, score double")
    extra = [] if text in keep else [F.col(text).cast("string").alias("_words")]
    return docs.select(*(F.col(c) for c in keep), *extra).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *made]))


def label(m: Model, t: str | None) -> tuple[str, float]:
    """The likeliest language of a text, and its probability."""
    if not m.langs or not t or not any(map(str.isalpha, t)):
        return UNKNOWN, 0.0
    h = ngrams(t)
    s = sum(m.table[h[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(h), 65536)) / len(h)
    p = softmax(s / m.t)
    k = int(np.argmax(p))
    return m.langs[k], float(p[k])


def query(docs: DataFrame) -> DataFrame:
    model = learn(docs.where(~fold_of(4)))
    return predict(docs, model).select(F.col("doc_id").cast("bigint").alias("doc_id"), fold_of(4).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that have no language: no letter, or a score below REJECT; a written table."""
    names = docs.columns
    model = learn(docs.where(~fold_of(4)))
    held = docs.select(*((F.col(c).cast("string") if c == "text" else F.col(c)).alias(f"_c{k}") for k, c in enumerate(names)))
    out = predict(held, model, tuple(held.columns), f"_c{names.index('text')}").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= REJECT))
    with small_batches(spark):
        out = written(out.select(*held.columns), "language_id")
    return renamed(out, *(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)))
