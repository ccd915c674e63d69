import itertools
import random

import numpy as np

from tessera.llm import toxicity as T


def brute_segments(scores):
    """Maximal-scoring segments by their definition: recurse on both sides of the best."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((sums[j] - sums[i], -(j - i), i, j) for i, j in itertools.combinations(range(len(sums)), 2)), key=lambda x: (round(x[0], 9), x[1]))
    _, _, i, j = best
    return [*brute_segments(scores[:i]), (round(float(sums[j] - sums[i]), 6), i, j - 1), *((s, a + j, b + j) for s, a, b in brute_segments(scores[j:]))]


def test_linear_scan_equals_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([T.DRIFT] * 3 + [0.3, 0.7, 1.1, 2.3]) + rng.random() * 1e-3 * 0 for _ in range(rng.randint(0, 25))]
        scores = [s + (rng.random() * 0.01 if s > 0 else 0) for s in scores]
        at = np.array([i for i, s in enumerate(scores) if s > 0], np.int64)
        got = [(round(s, 6), a, b) for s, a, b in T.segments(at, np.array(scores)[at] if len(at) else np.zeros(0))]
        assert got == brute_segments(scores)


def test_many_hits_in_one_text_take_linear_time():
    import time

    n = 100_000
    rng = np.random.RandomState(2)
    for gap, scores in ((10, np.full(n, 1.0)), (2, np.full(n, 0.5)), (1, rng.uniform(0.1, 3, n)), (4, np.linspace(3, 0.1, n)), (4, np.linspace(0.1, 3, n))):
        began = time.process_time()
        found = T.segments(np.arange(n) * gap, scores)
        assert time.process_time() - began < 3 and found and all(a <= b for _, a, b in found)


def test_nested_columns_of_any_name_stay(spark):
    schema = "doc_id bigint, text string, extra struct<`a b`: int, c: array<struct<`d.e`: string>>>"
    df = spark.createDataFrame([(k, "you are a vile toad" if k % 2 else "a kind friend", (k, [("x",)])) for k in range(30)], schema)
    m = T.learn(df, spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, toxic int"))
    out = T.predict(df, m, ("doc_id", "text", "extra")).collect()
    assert len(out) == 30 and all(r["extra"]["a b"] == r["doc_id"] and r["extra"]["c"][0]["d.e"] == "x" for r in out)


def test_held_out_labels(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = T.query(spark, d).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= T.THRESHOLD) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.8
    assert np.mean([s >= T.THRESHOLD for s in neg]) < 0.08


def test_held_out_labels_of_a_larger_table(spark):
    d = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "toxic").where("toxic is not null")
    held = [(r["score"], r["toxic"], r["predicted"]) for r in T.query(spark, d).where("held_out").join(marks, "doc_id").collect()]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.95
    assert np.mean([p for _, y, p in held if y]) > 0.85 and np.mean([p for _, y, p in held if not y]) < 0.02


def test_edge_rows(spark):
    docs = [(i, "you are a vile toad friend" if i % 2 else "you are a kind good friend") for i in range(60)]
    df = spark.createDataFrame([*docs, (100, None), (101, ""), (None, "vile toad"), (102, "kind " * 50000 + "vile toad"), (102, "kind " * 50000 + "vile toad")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (3, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    m = T.learn(df, labels)
    out = T.predict(df.selectExpr("*", "1 as score", "2 as _words"), m).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 65
    assert by[1]["predicted"] == 1 and by[0]["predicted"] == 0 and by[None]["predicted"] == 1
    assert by[100]["score"] == by[101]["score"] == by[0]["score"] and by[100]["passages"] == []
    assert [(p["first"], p["last"]) for p in by[1]["passages"]] == [(3, 4)]
    empty = T.learn(df, labels.limit(0))
    assert {r["predicted"] for r in T.predict(df, empty).collect()} == {0}
    assert T.predict(df.limit(0), m).collect() == []


def test_score_equals_a_plain_reading_of_its_model(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = T.learn(docs, spark.read.parquet(f"{d}/labels.parquet").where(~T.fold_of(4)))
    texts = {r["doc_id"]: r["text"] for r in docs.where("length(text) < 3000").collect()}
    of = dict(zip(m.unit.tolist(), m.score.tolist(), strict=True))
    one = lambda b: T.Words(T.pa.array([b.decode("utf-8", "replace")]), lower=True)
    got = {r["doc_id"]: r for r in T.query(spark, d).collect()}
    for i, t in list(texts.items())[:200]:
        w = one(t.encode())
        scores = []
        for k in range(len(w.start)):  # a word alone has the units that it has in its text
            u = [x for x in T.units(one(bytes(w.data[w.start[k] : w.end[k]])))[:, 0].tolist() if x in of]
            scores.append(max((of[x] for x in u), default=T.DRIFT))
        over = [max(0.0, m.rate * s - np.log(max(m.k * len(scores), 1e-9))) for s, _, _ in brute_segments(scores)] if scores else []
        x = m.curve @ np.array([1.0, max(over, default=0.0), np.log1p(sum(over))])
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        assert abs(got[i]["score"] - p) < 1e-4 and got[i]["predicted"] == int(got[i]["score"] >= T.THRESHOLD)


def test_law_of_clean_texts():
    rng = np.random.RandomState(2)
    clean = []
    for _ in range(400):
        s = np.where(rng.rand(300) < 0.02, 1.5, T.DRIFT)
        at = np.flatnonzero(s > 0)
        clean.append((300, [x for x, _, _ in T.segments(at, s[at])], np.bincount(T.steps(s), minlength=T.STEPS).tolist()))
    rate, k = T.law(clean)
    assert abs(0.02 * np.exp(rate * 1.5) + 0.98 * np.exp(rate * T.DRIFT) - 1) < 0.02
    best = np.array([max(x, default=0.0) for _, x, _ in clean])
    for s in (2.0, 2.6):  # the share of texts whose best segment exceeds s
        assert abs((best > s).mean() - (1 - np.exp(-k * 300 * np.exp(-rate * s)))) < 0.15
    assert T.law([]) == T.law([])
