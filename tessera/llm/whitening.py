"""Embedding whitening by a distributed block Jacobi-Davidson method.

The covariance is never formed: a product with it is a pass over the distinct vectors, whose
tasks add up X'(XQ) of their centred vectors. A subspace holds approximate components;
Rayleigh-Ritz takes the best of it, and each that has not converged gives a correction
equation, projected against what is locked and against the current approximations, which
inner MINRES steps solve, all columns in one product a step. The corrections extend the
subspace. Components whose residual is at rounding are locked and deflated; the last ones
locked are held against what the subspace still has, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

#: Components, and approximations beyond them that the subspace keeps.
COMPONENTS, GUARD = 16, 4
#: MINRES steps of a correction; the subspace is cut back beyond so many times its block.
INNER, WIDEST = 6, 3
#: Vectors of one packed row; a sum of more tasks than this goes through one more stage.
PACKED, WIDE = 1024, 256


def _unit(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``x``'s columns, orthogonal to ``against``; columns that vanish are left out."""
    scale = np.linalg.norm(x, axis=0)
    x = x[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        for q in against:
            x = x - q @ (q.T @ x)
    kept = np.zeros((len(x), 0))
    for col in x.T:
        size = np.linalg.norm(col)
        for _ in range(2):
            for q in (*against, kept):
                col = col - q @ (q.T @ col)
        left = np.linalg.norm(col)
        if left > 1e-10 * max(size, 1e-300) and left > 1e-12:
            kept = np.column_stack([kept, col / left])
    return kept


def minres(operator: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``operator(x) = b``, a column each, by so many steps of MINRES at once."""
    safe = lambda x: np.where(x > 0, x, 1.0)
    beta = np.linalg.norm(b, axis=0)
    x, v, before, w, w_before = np.zeros_like(b), b / safe(beta), np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, link = beta.copy(), np.zeros_like(beta)
    c, c_before, s, s_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = operator(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - link * before
        beta = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * link
        r = np.hypot(delta, beta)
        w, w_before = (v - s_before * link * w_before - (s * alpha + c_before * c * link) * w) / safe(r), w
        c_before, c, s_before, s = c, delta / safe(r), s, beta / safe(r)
        x = x + c * eta * w * (r > 0)
        eta = -s * eta
        before, v, link = v, p / safe(beta), beta
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, want: int, inner: int = INNER, most_rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns): the ``want`` largest eigenpairs of a symmetric ``product``.

    All residuals are at most size * 2^-52 times the largest value, or at the rounding of
    one fresh product where the subspace is the whole space.
    """
    want = min(want, size)
    block = min(size, want + GUARD)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = _unit(np.random.RandomState(1).standard_normal((size, block)))
    image, fresh = product(basis), True
    for _ in range(most_rounds):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        rest = image - basis * theta
        rest = rest - locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        floor = size * np.finfo(float).eps * max([1e-300, *np.abs(theta), *np.abs(values)])
        whole = locked.shape[1] + basis.shape[1] >= size
        done = (norms <= floor) | (whole & fresh)
        n = len(theta) if done.all() else int(np.argmin(done))
        if n:
            locked, values = np.column_stack([locked, basis[:, :n]]), np.append(values, theta[:n])
            basis, image, theta, rest, norms = basis[:, n:], image[:, n:], theta[n:], rest[:, n:], norms[n:]
        if len(values) >= want:
            least = np.sort(values)[-want]
            if not len(theta) or theta[0] + norms[0] <= least + floor:
                order = np.argsort(-values, kind="stable")[:want]
                return values[order], locked[:, order]
        if whole:
            basis = _unit(basis, locked)
            image, fresh = product(basis), True
            continue
        p = min(len(theta), max(1, want - len(values)) + GUARD)
        u, shift = basis[:, :p], theta[:p]
        against = lambda x: (lambda z: z - u @ (u.T @ z))(x - locked @ (locked.T @ x))  # noqa: B023, E731
        step = minres(lambda x: against(product(against(x)) - against(x) * shift), -against(rest[:, :p]), inner)  # noqa: B023
        if basis.shape[1] + p > WIDEST * block and basis.shape[1] + locked.shape[1] + p < size:
            basis, image = basis[:, :p], image[:, :p]
        new = _unit(step, locked, basis)
        if not new.shape[1]:
            new = _unit(np.random.RandomState(2).standard_normal((size, 1)), locked, basis)
        basis, image, fresh = np.column_stack([basis, new]), np.column_stack([image, product(new)]), False
    raise ArithmeticError("the components did not converge")


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose embedding has only finite entries: x = floor(64 * entry) + 1000000.

    All vectors have one length, that of the most rows (the larger on ties): rows of another
    length, and empty vectors, have no place among them and are left out.
    """
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select("vec_id", e.alias("e")).where(e.isNotNull() & (F.size(e) > 0) & ~bad)
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("e") == (common[0]["d"] if common else 0)).select("vec_id", F.transform("e", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("bigint")).alias("x"))


def _matrix(col: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def packed(rows: DataFrame) -> DataFrame:
    """(m, x): the distinct vectors, so many to a row, as one table of binary blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PACKED):
                x = _matrix(batch.column(0).slice(k, PACKED))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["m", "x"])

    return written(rows.select("x").distinct().mapInArrow(run, "m int, x binary"), "vectors")


class Fit:
    """Sums over the distinct vectors; ``blocks`` is their packed table."""

    def __init__(self, blocks: DataFrame):
        self.blocks, self.spark = blocks, blocks.sparkSession
        self.wide = blocks.rdd.getNumPartitions() > WIDE
        self.n = self.blocks.agg(F.sum("m")).collect()[0][0] or 0
        self.sums: list[int] = []
        if self.n:
            one = blocks.select(F.length("x") / F.col("m") / 8).limit(1).collect()[0][0]
            self.size = int(one)
            self.sums = self._column_sums()
            # The mean as an integer and a fraction: what centring subtracts first is exact.
            self.whole = np.array([s // self.n for s in self.sums], np.int64)
            self.part = np.array([(s % self.n) / self.n for s in self.sums])

    def _column_sums(self) -> list[int]:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * size
            for batch in batches:
                for raw in batch.column("x").to_pylist():
                    x = np.frombuffer(raw, "<i8").reshape(-1, size)
                    # Two halves of 32 bits each can't overflow a block's sum.
                    high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                    total = [t + (h << 32) + k for t, h, k in zip(total, high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total])], ["k", "s"])

        with small_batches(self.spark, 16):
            rows = self.blocks.mapInArrow(run, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        return [int(r["s"]) for r in sorted(rows, key=lambda r: r["k"])]

    def total(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``of`` over the centred vectors' blocks, in the order of their partitions."""
        size, whole, part = self.size, self.whole, self.part

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for batch in batches:
                for raw in batch.column("x").to_pylist():
                    x = (np.frombuffer(raw, "<i8").reshape(-1, size) - whole).astype(float) - part
                    got = of(x) if got is None else got + of(x)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([list(got.shape)], pa.list_(pa.int32())), pa.array([got.astype(float).tobytes()], pa.binary())], ["part", "shape", "sum"])

        def add(rows: list[dict]) -> np.ndarray:
            return sum(np.frombuffer(r["sum"]).reshape(r["shape"]) for r in sorted(rows, key=lambda r: r["part"]))

        def few(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            return pa.table({"part": pa.array([min(r["part"] for r in rows)], pa.int32()), "shape": pa.array([rows[0]["shape"]], pa.list_(pa.int32())), "sum": pa.array([add(rows).tobytes()], pa.binary())})

        with small_batches(self.spark, 16):
            sums = self.blocks.mapInArrow(run, "part int, shape array<int>, sum binary")
            if self.wide:
                sums = sums.groupBy(F.floor(F.col("part") / WIDE).alias("_to")).applyInArrow(few, "part int, shape array<int>, sum binary")
            return add([r.asDict() for r in sums.collect()])

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance's product with the columns of ``q``."""
        return self.total(lambda x: x.T @ (x @ q)) / self.n


@dataclass
class Whitening:
    """Of ``n`` distinct vectors with ``sums``: unit components as columns, their variances, the trace, and the identity's error."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows`` (x): each distinct vector counts once.

    Components without variance (as of fewer vectors than components, or equal ones) have no
    whitened value and are left out. No rows give no component.
    """
    fit = Fit(packed(rows))
    if not fit.n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    trace = float(fit.total(lambda x: (x * x).sum(0)).sum() / fit.n)
    if trace == 0.0:
        return Whitening(fit.n, fit.sums, np.zeros((fit.size, 0)), np.zeros(0), trace, 0.0)
    values, vectors_ = jacobi_davidson(fit.product, fit.size, components)
    some = values > fit.size * np.finfo(float).eps * values[0]
    values, vectors_ = values[some], vectors_[:, some]
    scaled = vectors_ / np.sqrt(values)
    own = fit.total(lambda x: (lambda w: np.column_stack([w.T @ w, w.sum(0)]))(x @ scaled)) / fit.n
    error = np.abs(own[:, :-1] - np.outer(own[:, -1], own[:, -1]) - np.eye(len(values))).max()
    return Whitening(fit.n, fit.sums, vectors_, values, trace, float(error))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum of (n * x - S)^2 of each row, exact."""
    s = np.array(sums, dtype=object)
    if (np.abs(x).max(initial=1).astype(float) * n + max(map(abs, sums))) ** 2 * max(1, x.shape[1]) < 2.0**62:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    near = x - np.array([t // n for t in sums], np.int64)  # the same, with the mean's integer part taken off first
    rest = np.array([t % n for t in sums], dtype=object)
    if (np.abs(near).max(initial=0).astype(float) * n + n) ** 2 * max(1, x.shape[1]) < 2.0**62:
        y = n * near - rest.astype(np.int64)
        return (y * y).sum(1).tolist()
    y = n * x.astype(object) - s
    return (y * y).sum(1).tolist()


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each of ``rows`` (vec_id, x) and component.

    A deviation beyond 64 bits is an error, never a wrong number.
    """
    n, sums, k = w.n, w.sums, len(w.variances)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    whole, part = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    scaled, explained = w.components / np.sqrt(w.variances), w.variances / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PACKED):
                own = batch.slice(i, PACKED)
                x = _matrix(own.column(1))
                m = len(x)
                take = pa.array(np.repeat(np.arange(m), k))
                white = ((x - whole).astype(float) - part) @ scaled
                yield pa.RecordBatch.from_arrays([
                    own.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(_deviation(x, n, sums), pa.int64()).take(take),
                    pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of ``embeddings``; a table without such rows has none.

    Rows that repeat are whitened each and fitted once. Columns beside vec_id and embedding are not read.
    """
    rows = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whiten(rows, whitening(rows))
