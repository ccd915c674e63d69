import math
import random

import numpy as np

from tessera.llm import whitening as W


def test_minres_solves():
    rng = np.random.RandomState(0)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 3))
    assert np.allclose(a @ W.minres(lambda x: a @ x, b, 200), b, atol=1e-8)


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.RandomState(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


def test_components_of_hard_spectra():
    rng = np.random.RandomState(3)
    cases = [np.sort(rng.uniform(60, 75, 64))[::-1], np.array([150.0] * 3 + [70.0] * 61), 1 / np.arange(1.0, 301) ** 2, np.sort(rng.uniform(1, 2, 250))[::-1], np.array([5.0, 1.0] + [0.0] * 30), np.array([3.0]), np.ones(40)]
    for values in cases:
        a = spectrum(values)
        calls = []
        got, u = W.jacobi_davidson(lambda q: calls.append(1) or a @ q, len(a), 16)  # noqa: B023
        k = min(16, len(a))
        floor = 4 * len(a) * np.finfo(float).eps * values[0]
        assert np.abs(got - np.sort(values)[::-1][:k]).max() <= floor, len(a)
        assert np.abs(u.T @ u - np.eye(k)).max() < 1e-13
        assert np.linalg.norm(a @ u - u * got, axis=0).max() <= floor and len(calls) < 400


def plain(rows):
    """n, sums, variances, components and trace of the distinct x of (vec_id, embedding)."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    c = ((n * fit - sums).astype(float)) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    return ok, n, sums, values[::-1], u[:, ::-1]


def check(df, rows, k=16):
    ok, n, sums, values, u = plain(rows)
    got = df.collect()
    assert len(got) == k * len(ok)
    by: dict = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for j in range(1, k + 1):
        sign = None
        for i, x in ok:
            d = n * np.array(x, dtype=object) - sums
            want = float(np.dot(d.astype(float) / n, u[:, j - 1])) / math.sqrt(values[j - 1])
            r = by[j][i][0]
            if sign is None and abs(want) > 1e-3:
                sign = math.copysign(1, want * r["whitened"])
            assert abs(r["whitened"] * (sign or 1) - want) < 1e-7 and r["deviation"] == int((d * d).sum()) and r["n"] == n
            assert abs(r["explained"] / (values[j - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whole_table_equals_dense(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(W.query(spark, sf_dir), rows)


def test_two_stage_sums_give_the_same(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(W, "WIDE", 2)
    table = W.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).repartition(9)
    blocks = W.packed(table).repartition(9)
    fit = W.Fit(blocks)
    assert fit.wide
    q = np.eye(64)[:, :3]
    x = np.array(sorted({tuple(r["x"]) for r in table.collect()}), float)
    x -= x.mean(0)
    assert np.allclose(fit.product(q), x.T @ x[:, :3] / len(x), rtol=1e-12, atol=1e-10)


def test_edge_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(5)]) for k in range(40)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [math.nan] * 5), (104, [math.inf] * 5), (None, rows[1][1])]
    odd = [(105, []), (106, [1.0, 2.0])]
    schema = "vec_id bigint, embedding array<double>, x int, component string, n int"

    def table(name, some):
        path = str(tmp_path / name)
        spark.createDataFrame([(*r, 1, "c", 2) for r in some], schema).write.parquet(f"{path}/embeddings.parquet")
        return W.query(spark, path)

    check(table("many", rows + odd), rows, 5)
    assert table("none", []).collect() == [] and table("one", rows[:1] * 3).collect() == [] and table("odd", odd[:1]).collect() == []
    flat = [(k, [float(k % 3), 1.0, -2.0 * (k % 3)]) for k in range(9)]  # variance along one line only
    got = table("flat", flat).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and all(abs(r["explained"] - 1) < 1e-9 for r in got)


def test_deviation_is_exact():
    x = np.array([[10**6 + 7, -(10**6)], [3, 10**6]], np.int64)
    for n in (1, 999, 10**6, 10**9):
        sums = [n * 10**6 - 5, n * 3 + 1]
        assert W._deviation(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
