import numpy as np

from tessera.llm import language_id as L
from tessera.llm.common import fold_of


def test_held_out_accuracy(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in df.collect()}
    rows = L.query(df).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and len(held) > 150
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 12)]
    df = spark.createDataFrame([*rows, (90, None, "en", 1), (91, "", None, 1), (92, "12 + 3 ...", "en", 1), (None, "the dog", None, 1), (93, "chien " * 20000, None, 1), (93, "chien " * 20000, None, 1)], "doc_id bigint, text string, lang string, score int")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.query(df).collect()}
    assert out[90] == out[91] == out[92] == ("und", 0.0)
    assert out[None][0] == "en" and out[93][0] == "fr"
    kept = L.stage(spark, df, "")
    assert kept.columns == df.columns and kept.count() == len(rows) + 3
    assert L.query(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in L.query(df.withColumn("lang", L.F.lit(None).cast("string"))).collect()} == {"und"}
    assert fold_of(4) is not None


def test_training_is_sparse_and_separates():
    rng = np.random.RandomState(1)
    rows = [(np.array([y * 10 + rng.randint(5), 500 + rng.randint(400)]), np.ones(2), y) for y in rng.randint(0, 3, 600)]
    w = L.train(rows, 3)
    assert np.mean([np.argmax(x @ w[at]) == y for at, x, y in rows]) > 0.99
    assert (w == 0).mean() > 0.9
    assert L.temperature(np.array([[4.0, 0.0]] * 50 + [[4.0, 0.0]] * 50), np.array([0] * 50 + [1] * 50)) > 5


def plain_label(m, t):
    """The same sums, an n-gram at a time."""
    if not t or not any(c.isalpha() for c in t):
        return "und", 0.0
    c = [ord(x) for x in t.lower()]
    total, n, mask = [0.0] * len(m.langs), 0, (1 << 64) - 1
    for size in range(1, L.ORDERS + 1):
        for i in range(len(c) - size + 1):
            h = 0
            for x in c[i : i + size]:
                h = (h * 0x9E3779B97F4A7C15 + x + 1) & mask
            dim = ((h * 0xBF58476D1CE4E5B9 & mask) >> 48) & (L.DIMS - 1)
            total = [a + float(b) for a, b in zip(total, m.table[dim], strict=True)]
            n += 1
    e = [np.exp(x / n / m.t) for x in total]
    k = max(range(len(e)), key=lambda i: e[i])
    return m.langs[k], e[k] / sum(e)


def test_query_equals_a_plain_reading_of_its_model(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500")
    m = L.learn(df.where(~fold_of(4)))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in L.query(df).collect():
        lang, score = plain_label(m, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6


def test_weights_of_seen_ngrams_are_sparse(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = L.learn(df.where(~fold_of(4)))
    seen = np.unique(np.concatenate([L.ngrams(r["text"]) for r in df.where(~fold_of(4)).limit(400).collect()]))
    assert (m.table[seen] == 0).mean() > 0.6


def test_ties_and_one_language(spark):
    same = spark.createDataFrame([(i, "abc abc", "ba"[i % 2]) for i in range(60)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in L.predict(same, L.Model(["a", "b"], np.zeros((L.DIMS, 2), np.float32), 1.0)).collect()} == {"a"}
    one = L.query(same.withColumn("lang", L.F.lit("a"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("a", 1.0)}


def test_sample_is_bounded_in_rows(spark):
    from tessera.llm.common import first_of_each

    rows = spark.range(5000).selectExpr("case when id < 2000 then 7 else id end doc_id", "if(id % 10 = 0, 'x', 'y') lang")
    out = first_of_each(rows, "lang", 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in out} == {"x": 100, "y": 100}
    assert first_of_each(rows.where("doc_id = 7"), "lang", 100).count() == 2
