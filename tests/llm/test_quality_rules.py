import re

import numpy as np

from tessera.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in tri:
        seen[x] = seen.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(tri) if seen[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = Q.query(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b a b a b a b", 0), (3, "a b a b a b a b", 0), (None, "é# 中\nx\nx\n \n ", 0), (5, "ab " * 40000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in Q.query(df).collect()}
    assert out == {i: brute(t) for i, t, _ in rows}
    assert Q.query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def votes_of(t):
    """The votes of the plain rules, in the operator's order."""
    w = WORD.findall(t or "")
    n, lines = len(w), [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n") if WORD.search(x)]
    _, chars, symbols, dup, repeat, _ = brute(t)
    letters = sum("a" <= c <= "z" or "A" <= c <= "Z" or c.encode()[0] >= 192 for c in t or "")
    marked, ended = sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), sum(x[-1] in Q._ENDS for x in lines)
    rules = [
        (n >= 80, n < 50), (3 * n <= chars <= 7 * n, chars < 2 * n or chars > 12 * n), (symbols * 50 <= n, symbols * 8 > n), (marked * 50 <= n, marked * 8 > n), (len(lines) > 1 and dup == 0, dup * 3 > len(lines)),
        (repeat * 10 <= n, repeat * 10 > n * 4), (letters * 100 >= chars * 95, letters * 10 < chars * 9), (len(set(w)) * 2 >= n, len(set(w)) * 20 < n), (ended == len(lines), ended * 10 < len(lines) * 9),
    ]
    return tuple(0 if bad else 1 if good else -1 for good, bad in rules)


def plain_em(votes):
    """The posterior of each document, a document at a time."""
    k, n = len(votes[0]), Q.PRIOR_VOTES
    hit, false, bad = [Q.PRIOR_HIT] * k, [Q.PRIOR_FALSE] * k, Q.PRIOR_BAD

    def post(v):
        good, ill = 1 - bad, bad
        for r, x in enumerate(v):
            if x >= 0:
                good *= false[r] if x == 0 else 1 - false[r]
                ill *= hit[r] if x == 0 else 1 - hit[r]
        return good / (good + ill)

    for _ in range(Q.ROUNDS):
        p = [post(v) for v in votes]
        before = hit, false
        rate = lambda r, w, prior: (sum(x for x, v in zip(w, votes, strict=True) if v[r] == 0) + n * prior) / (sum(x for x, v in zip(w, votes, strict=True) if v[r] >= 0) + n)
        ill = [1 - x for x in p]
        hit = [rate(r, ill, Q.PRIOR_HIT) for r in range(k)]
        false = [min(rate(r, p, Q.PRIOR_FALSE), hit[r]) for r in range(k)]
        bad = (sum(ill) + n * Q.PRIOR_BAD) / (len(votes) + n)
        if max(abs(x - y) for a, b in zip((hit, false), before, strict=True) for x, y in zip(a, b, strict=True)) < 1e-9:
            break
    return [post(v) for v in votes]


def test_verdict_equals_plain_expectation_maximisation(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    want = dict(zip(rows, plain_em([votes_of(t) for t in rows.values()]), strict=True))
    for r in Q.query(df).collect():
        assert abs(r["quality"] - want[r["doc_id"]]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= Q.KEEP)


def test_verdict_is_better_than_the_base_alone(spark):
    """Labels of quality teach the rules nothing, so all of them are held out."""
    where = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{where}/labels.parquet").selectExpr("doc_id", "quality as label").where("label is not null")
    got = Q.query(spark.read.parquet(f"{where}/documents.parquet")).join(marks, "doc_id").collect()
    base = np.mean([(not r["base_failed"]) == (r["label"] == 1) for r in got])
    whole = np.mean([r["kept"] == (r["label"] == 1) for r in got])
    assert any(not r["kept"] and not r["base_failed"] for r in got) and whole > base + 0.04
    fine = [r["kept"] for r in got if r["label"] == 1 and not r["base_failed"]]
    assert np.mean(fine) > 0.98


def test_fit_finds_the_rates():
    rng = np.random.RandomState(1)
    ill = rng.rand(40000) < 0.2
    hit, false = np.array([0.7, 0.6, 0.5, 0.8]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = 1 - (rng.rand(40000, 4) < np.where(ill[:, None], hit, false)).astype(int)
    votes[rng.rand(40000, 4) < 0.2] = -1
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    a, b, bad = Q.fit([(tuple(k), int(n)) for k, n in zip(kinds, counts, strict=True)])
    assert np.abs(a - hit).max() < 0.06 and np.abs(b - false).max() < 0.02 and abs(bad - 0.2) < 0.03
