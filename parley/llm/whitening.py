"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V = XcᵀXc / n of integer vectors x are found without
forming V: a pass over the data multiplies it with a block Q of `components` + `guard` columns, each
task giving Xcᵀ(XcQ) of its rows. A filter of degree m applies the Chebyshev polynomial that is at
most 1 on [0, cut] by its three-term recurrence, one pass a degree; beyond the cut it grows fast, so
what Q holds of the unwanted spectrum is damped. After it come QR and a Rayleigh-Ritz step (one more
pass); the last Ritz value is the next cut. It ends when every wanted pair is certified: its residual
|Vu - eu| is at most `tolerance` times the largest eigenvalue, or stopped falling at the level
of rounding (`floor`). Not certified within `rounds` filters raises an error.

Centring is exact: with the whole number b nearest to the mean, x - S/n = (x - b) - (S - nb)/n, whose
first term is a difference of integers. Passes read a written table of the vectors that take part
(`vectors.whole`, of the commonest length; others are dropped); partial products are added up on the
executors, and d x (k + guard) numbers reach the driver, whatever the number of rows or tasks.

Components without variance (eigenvalue under `floor` times the largest) are left out: one cannot
divide by their root. So equal vectors, a single one, or none at all give no rows. Equal or
missing vec_ids stay rows of their own. `deviation` beyond a long raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ship_package, written
from parley.llm.vectors import arrays, matrix, of_one_length, whole


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 32
    guard: int = 16          # further columns of the block
    scale: int = 64
    shift: int = 1_000_000
    degree: int = 8          # passes of one filter
    rounds: int = 60
    tolerance: float = 1e-13
    floor: float = 1e-11     # of the largest eigenvalue: rounding of the products
    seed: int = 7


@dataclass(frozen=True)
class Moments:
    """n vectors of length d with sums S, and the whole numbers nearest to the means."""
    n: int
    sums: np.ndarray  # Python integers

    @property
    def near(self) -> np.ndarray:
        return np.array([(2 * int(s) + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """S - n * near, exact."""
        return np.array([int(s) - self.n * int(b) for s, b in zip(self.sums, self.near)], dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - (self.rest.astype(np.float64) / self.n)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2 of every row, in integers."""
        z = x - self.near
        bound = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if bound * bound * x.shape[1] < 1 << 63:
            t = self.n * z - self.rest.astype(np.int64)
            return (t * t).sum(axis=1)
        t = self.n * z.astype(object) - self.rest
        out = [int(v) for v in (t * t).sum(axis=1)]
        if any(v >= 1 << 63 for v in out):
            raise OverflowError("the deviation of a vector does not fit a long")
        return np.array(out, dtype=np.int64)


def moments(rows: DataFrame, d: int) -> Moments:
    """Count and sums, exact, of arrays `x` of d longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, dtype=np.int64)
        for b in batches:
            x = matrix(b.column(0), d)
            n, sums = n + len(x), sums + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([n, *sums.tolist()], pa.int64())], names=["i", "v"])

    got = dict(rows.select("x").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect())  # d + 1 numbers
    return Moments(got[0], np.array([got[i + 1] for i in range(d)], dtype=object))


def _added(rows: DataFrame, of_task, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of the matrix that `of_task(matrices of rows)` returns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += of_task(b)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), arrays(total)], names=["i", "v"])

    cells = rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros(shape)
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v")).collect():  # one number a cell of the matrix
        out[i, j] = v
    return out


def covariance_times(rows: DataFrame, m: Moments, q: np.ndarray) -> np.ndarray:
    """V q in one pass over the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((m, q))

    def of_task(b: pa.RecordBatch) -> np.ndarray:
        mo, block = shared.value
        c = mo.centred(matrix(b.column(0), len(mo.sums)))
        return c.T @ (c @ block)

    try:
        return _added(rows.select("x"), of_task, q.shape) / m.n
    finally:
        shared.destroy()


def total_variance(rows: DataFrame, m: Moments) -> float:
    shared = rows.sparkSession.sparkContext.broadcast(m)
    try:
        return float(_added(rows.select("x"), lambda b: np.array([[(shared.value.centred(matrix(b.column(0), len(m.sums))) ** 2).sum()]]),
                            (1, 1))[0, 0]) / m.n
    finally:
        shared.destroy()


def chebyshev(times, q: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The polynomial of `degree` in V times q: at most 1 in size on [0, cut], scaled to 1 at `top`."""
    half = cut / 2
    sigma1 = sigma = half / (top - half)
    y = (times(q) - half * q) * (sigma1 / half)
    for _ in range(2, degree + 1):
        after = 1.0 / (2.0 / sigma1 - sigma)
        q, y = y, (times(y) - half * y) * (2.0 * after / half) - (sigma * after) * q
        sigma = after
    return y


def eigenpairs(times, d: int, p: WhiteningParams) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the leading components, certified; `times(q)` gives V q."""
    k = min(p.components, d)
    width = min(d, k + max(1, p.guard))  # a cut at a wanted value would not bring that one out
    q, _ = np.linalg.qr(np.random.default_rng(p.seed).normal(size=(d, width)))
    before = np.inf
    for _ in range(p.rounds):
        vq = times(q)
        small = q.T @ vq
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(value[0]), 0.0)
        if top == 0.0:
            return np.zeros(0), np.zeros((d, 0))
        wanted = value[:k] > p.floor * top
        off = np.linalg.norm(vq[:, :k] - q[:, :k] * value[:k], axis=0)[wanted].max(initial=0.0) / top
        if off <= p.tolerance or (off <= p.floor and off > before / 4):
            value, vector = value[:k][wanted], q[:, :k][:, wanted]
            return value, vector / np.linalg.norm(vector, axis=0)
        before = off
        cut = max(float(value[-1]), p.floor * top)
        q, _ = np.linalg.qr(chebyshev(times, q, p.degree, cut, top) if width < d else q)
    raise RuntimeError(f"eigenvectors not certified in {p.rounds} filters: residual {off:.1e}")


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray   # d x components
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, d: int, p: WhiteningParams) -> Whitening:
    ship_package(rows.sparkSession)
    m = moments(rows, d)
    value, vector = eigenpairs(lambda q: covariance_times(rows, m, q), d, p)
    return Whitening(m, value, vector, total_variance(rows, m))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, from a pass of its own."""
    k = len(w.values)
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def of_task(b: pa.RecordBatch) -> np.ndarray:
        y = shared.value.apply(matrix(b.column(0), len(shared.value.moments.sums)))
        return np.vstack([y.T @ y, y.sum(axis=0)[None, :]])

    sums = _added(rows.select("x"), of_task, (k + 1, k)) / w.moments.n
    shared.destroy()
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, p: WhiteningParams = WhiteningParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every vector that takes part."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole(vector_col, p.scale, p.shift).alias("x")).where("x IS NOT NULL")
    rows, d = of_one_length(written(rows, "whitening"))
    if d == 0:
        return spark.createDataFrame([], schema)
    w = fit(rows, d, p)
    k, error = len(w.values), identity_error(rows, w)
    shared = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            x = matrix(b.column(1), d)
            y, dev, n = at.apply(x), at.moments.deviations(x), len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, at.moments.n)), pa.array(np.repeat(dev, k)), pa.array(y.reshape(-1)),
                 pa.array(np.tile(at.values / at.trace, n)), pa.array(np.full(n * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
