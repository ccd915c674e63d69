from collections import Counter

from tessera.llm import line_dedup as L


def brute(rows):
    total = Counter(h for _, h, _ in rows if h is not None)
    pages = Counter((h, x.strip(" ")) for _, h, t in rows if h is not None and t is not None for x in {y.strip(" ") for y in t.split("\n")} if x)
    bad = {k for k, n in pages.items() if n >= L.MIN_PAGES and n / total[k[0]] > L.MAX_RATIO}
    return sorted((str(i), None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, h, t in rows)


def run(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in L.drop_boilerplate(df).collect())


def test_whole_table_equals_brute_force(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
    monkeypatch.setattr(L, "MIN_PAGES", 2)
    want = brute(rows)
    out = L.drop_boilerplate(df, min_pages=2).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_join_by_host_gives_the_same(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r["doc_id"], r["text"]) for r in L.drop_boilerplate(df, min_pages=2).collect())
    monkeypatch.setattr(L, "BROADCAST_KEYS", -1)
    assert sorted((r["doc_id"], r["text"]) for r in L.drop_boilerplate(df, min_pages=2).collect()) == want


def test_edge_rows(spark):
    rows = [(i, "h", "menu \nbody %d\n\nmenu" % i) for i in range(6)] + [(7, "h", None), (8, "h", ""), (9, None, "menu"), (10, "g", "menu"), (None, "h", "menu"), (11, "h", "menu"), (11, "h", "menu")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    clash = df.selectExpr("*", "1 as n_lines", "'x' as n_dropped")
    assert run(df) == brute(rows) == run(clash)
    assert L.drop_boilerplate(df.limit(0)).collect() == []


def test_columns_of_any_name_stay(spark):
    rows = [(i, "h", f"menu\nbody {i}") for i in range(6)]
    names = ["_bad", "_kept", "_host", "_salt", "_part", "bad", "kept", "host", "key", "c0", "salt", "n_lines", "n_dropped", "a.b", "a`b"]
    df = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], ["doc_id", "source", "text", *names])
    out = L.drop_boilerplate(df, counts=False)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["text"] == f"body {r['doc_id']}" and all(r[n] == f"{n}{r['doc_id']}" for n in names)
    counted = L.drop_boilerplate(df)
    assert counted.columns == [c for c in df.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {(r["n_lines"], r["n_dropped"]) for r in counted.collect()} == {(2, 1)}


def test_very_long_text_and_the_join_by_host(spark, monkeypatch):
    rows = [(i, "h", "menu\n" + f"line {i}\n" * 60_000) for i in range(5)] + [(9, "h", None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    want = brute(rows)
    assert run(df) == want
    monkeypatch.setattr(L, "BROADCAST_KEYS", -1)
    assert run(df) == want


def test_plan_has_no_python(spark, sf_dir):
    plan = L.query(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
