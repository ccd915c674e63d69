import re

import numpy as np
import pytest

from tessera.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for g in by.values() for k, a in enumerate(g) for b in g[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df).collect()}


def test_whole_table_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_edits_near_the_threshold_and_common_passages(spark):
    rng = np.random.RandomState(5)
    words = [f"w{i}" for i in range(5000)]
    common = list(rng.choice(words, 60))
    rows, n = [], 0
    for size in (5, 8, 30, 127, 128, 170, 400, 700):
        base = list(rng.choice(words, size))
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            t = list(base)
            for _ in range(edits):
                t[rng.randint(len(t))] = f"x{rng.randint(1 << 30)}"
            rows.append((n, " ".join(t) + (" " + " ".join(t[: rng.randint(40)]) if edits % 2 else "")))
            n += 1
    for _ in range(60):  # unrelated texts that share a passage
        rows.append((n, " ".join([*rng.choice(words, rng.randint(5, 30)), *common, *rng.choice(words, rng.randint(5, 30))])))
        n += 1
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_large_group_of_chained_copies_and_frequent_keys(spark, monkeypatch):
    rng = np.random.RandomState(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # each near its neighbours, the ends far apart
        t = list(base)
        for k in range(i // 8):
            t[k * 4] = f"y{k}"
        t[119 - i % 3] = f"z{i}"
        rows.append((i, " ".join(t)))
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == want
    monkeypatch.setattr(J, "LEAD_PART", 20)  # blocks of two parts
    monkeypatch.setattr(J, "FAMILY_PART", 2000)
    monkeypatch.setattr(J, "PAIR_MEMBERS", 1000)
    monkeypatch.setattr(J, "MANY_COPIES", 1)
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, "A b", "d"), (5, "a  B", "e"), (6, "one two three four five six", None), (6, "one two three four five six", None), (None, "one two three four five six", "x")]
    out = sorted(map(tuple, J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, node string")).collect()), key=str)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (None, 2, None)], key=str)
    assert J.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.RandomState(7)
    for n in (3, 40, 500):
        a = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.randint(0, 1 << 62, n // 3).astype(np.uint64)]))
        x, y = (np.frombuffer(J.sketch(s), np.uint64)[None, :] for s in (a, b))
        w = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(J.fold(x, w) ^ J.fold(y, w)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n", [1, 2, 3, 100, 127, 128, 170, 171, 511, 512, 600, 5000])
def test_prefixes_are_full(n):
    s = np.unique(np.random.RandomState(n).randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(3))
    for keys, first in J.band_words(s):
        assert len(keys) >= min(first, len(s))


def test_rows_joined_through_others_and_across_parts():
    near = lambda a, b: np.abs(a - b) <= 2
    block = np.array([0, 0, 0, 0, 1, 1, 2, 2, 2])
    n = np.array([10, 10, 9, 5, 8, 8, 7, 7, 7])
    one = np.zeros(9, bool)
    assert J.joined(block, one.astype(int), n, one, near).tolist() == [0, 0, 0, 3, 4, 4, 6, 6, 6]
    part = np.array([0, 1, 1, 1, 0, 0, 0, 0, 1])
    assert J.joined(block, part, n, ~one, near).tolist() == [0, 0, 0, 3, 4, 5, 6, 6, 6]


def test_session_option_comes_back_and_tables_go(spark, tmp_path):
    from tessera.llm.common import shared_dir

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    import glob

    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tessera-*"))
    old = tables()
    J.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id bigint, text string")).collect()
    assert spark.conf.get(key) == before
    assert [t.split("tessera-")[-1].split("-")[0] for t in tables() - old] == ["components"]


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    near = [w if k % 50 else f"x{k}" for k, w in enumerate(words)]
    far = [w if k % 9 else f"y{k}" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "w " * 50_000), (5, "w " * 70_000)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_one_of_each_by_join_and_by_broadcast(spark, monkeypatch):
    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (None, "a b c d e f", 7), (3, "z", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id int")
    want = sorted(map(str, [rows[0], rows[2], rows[3]]))
    assert sorted(str(tuple(r)) for r in J.one_of_each(df).collect()) == want
    monkeypatch.setattr(J, "BROADCAST_IDS", -1)
    assert sorted(str(tuple(r)) for r in J.one_of_each(df).collect()) == want
