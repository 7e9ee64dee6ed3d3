"""Whitening of embeddings: distributed covariance, own eigen-solver for its leading part, broadcast projection.

Three sums are made on the cluster, by partial sums a task that are added up by entry: the sums of each
dimension (exact integers), the covariance of the centred vectors, and, as a check on what is returned, the
covariance of the whitened ones.  The driver gets one row for each entry of a d x d matrix, whatever the
number of vectors, brings it to tridiagonal form by Householder reflections, finds the leading eigenvalues
by bisection on Sturm counts, and their vectors by inverse iteration, orthogonalised anew within clusters.
Means and components (d x k numbers) go to the tasks with the projection.

Entries count on a grid: ``x = floor(1024 c) + 100000``.

Defined cases: rows whose vector is null, empty or holds null, nan or infinite entries take no part; when
vectors differ in length, the most frequent length (of equal ones the longer) is the dimension and other
rows take no part; there are at most as many components as dimensions; a component without variance
(constant data, a single row, fewer independent rows than dimensions) has null in ``whitened`` and takes no
part in ``identity_error``; a deviation beyond 64 bits is null; null and repeated ids stay rows of their own;
no usable rows give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields

SCALE, SHIFT = 1024.0, 100_000
BATCH = 1 << 22  # entries that are worked on at a time
EPS = np.finfo(float).eps


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, vector)`` of rows whose vector has only finite entries, in double precision."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(id_column).alias("id"), v.alias("vector")).where((F.size(v) > 0) & finite)


def grid(column: pa.Array, d: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows of a list column as ``(first, end, x)`` with x a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, BATCH // d)
    for first in range(0, len(values), step):
        part = values[first:first + step]
        yield first, first + len(part), np.floor(SCALE * part).astype(np.int64) + SHIFT


def entries(rows: DataFrame, d: int, width: int, make, kind: str) -> DataFrame:
    """Sums over all rows of the ``width`` numbers that ``make`` sums up for a run of rows: (entry, total)."""
    schema = f"entry int, total {kind}"
    as_type = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, x in grid(batch.column(0), d):
                part = make(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total, as_type)],
                                             names=["entry", "total"])

    return rows.select("vector").mapInArrow(run, schema).groupBy("entry").agg(F.sum("total").alias("total"))


def gathered(sums: DataFrame, width: int, dtype) -> np.ndarray:
    out = np.zeros(width, dtype)
    for r in sums.collect():  # one row for each entry
        out[r.entry] = r.total
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of ``Q' matrix Q``; ``Q`` is the product of reflections."""
    a = np.array(matrix, float)
    n, mirrors = len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size > 0:
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
            a[k, k + 1:] = a[k + 1:, k]
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, square: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are smaller than each ``at``."""
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for k, alpha in enumerate(diagonal):
        q = alpha - at - (square[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bit that the counts can tell."""
    n = len(diagonal)
    reach = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    tiny = max(np.finfo(float).tiny, EPS * EPS * max(abs(low), abs(high)))
    square = off * off
    want = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    a, b = np.full(k, low - tiny), np.full(k, high + tiny + EPS * abs(high))
    for _ in range(200):
        middle = 0.5 * (a + b)
        if np.all((middle <= a) | (middle >= b)):
            break
        less = below(diagonal, square, middle, tiny) <= want
        a, b = np.where(less, middle, a), np.where(less, b, middle)
    return 0.5 * (a + b)


def factored(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> list[tuple]:
    """Gaussian elimination with row exchanges of ``T - shift``; pivots below ``tiny`` are raised to it."""
    n = len(diagonal)
    steps, d, e, f = [], diagonal[0] - shift, (off[0] if n > 1 else 0.0), 0.0
    for k in range(n - 1):
        low, mid, right = off[k], diagonal[k + 1] - shift, (off[k + 1] if k + 2 < n else 0.0)
        swap = abs(low) > abs(d)
        if swap:
            (d, e, f), (low, mid, right) = (low, mid, right), (d, e, f)
        if abs(d) < tiny:
            d = tiny
        m = low / d
        steps.append((swap, m, d, e, f))
        d, e, f = mid - m * e, right - m * f, 0.0
    steps.append((False, 0.0, d if abs(d) >= tiny else tiny, 0.0, 0.0))
    return steps


def solved(steps: list[tuple], right: np.ndarray) -> np.ndarray:
    x = right.copy()
    n = len(x)
    for k, (swap, m, *_) in enumerate(steps[:-1]):
        if swap:
            x[k], x[k + 1] = x[k + 1], x[k]
        x[k + 1] -= m * x[k]
    for k in range(n - 1, -1, -1):
        _, _, d, e, f = steps[k]
        x[k] = (x[k] - (e * x[k + 1] if k + 1 < n else 0.0) - (f * x[k + 2] if k + 2 < n else 0.0)) / d
    return x


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix by inverse iteration.

    Values closer to each other than a thousandth of the matrix's size make a cluster; each new vector is
    orthogonalised against the cluster's earlier ones in every step.
    """
    n = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0.0)
    start = np.random.default_rng(11)
    found: list[np.ndarray] = []
    cluster = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            cluster = k
        # equal values are told apart a little, so that each solve is one of its own
        steps = factored(diagonal, off, value - 2 * EPS * size * (k - cluster), max(EPS * size, np.finfo(float).tiny))
        x = start.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                for other in found[cluster:]:
                    x = x - (x @ other) * other
            x = solved(steps, x / np.linalg.norm(x))
            x = x / np.abs(x).max()
        for _ in range(2):
            for other in found[cluster:]:
                x = x - (x @ other) * other
            x = x / np.linalg.norm(x)
        found.append(x)
    return np.array(found).reshape(len(values), n)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix and their unit vectors (rows), largest entry positive."""
    n = len(matrix)
    k = min(k, n)
    if not np.abs(matrix).max() > 0:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values).T
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        vectors[j + 1:] -= 2 * np.outer(v, v @ vectors[j + 1:])
    vectors = vectors.T
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    peak = np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1)
    return values, vectors * np.sign(peak)


@dataclass(frozen=True)
class Whitener:
    """What a task needs: count, sums, mean, scaled components and the eigenvalues' shares."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Components that have variance, beyond rounding."""
        return self.values > len(self.sums) * 8 * EPS * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        return ((x - SHIFT) - (self.sums - self.n * SHIFT) / self.n) @ self.vectors.T * scale

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of ``(n x - S) ** 2``, null where 64 bits do not hold it."""
        wide = ((x - self.sums / self.n) ** 2).sum(axis=1) * float(self.n) ** 2
        fits = wide < 2.0 ** 62.99
        gap = self.n * np.where(fits[:, None], x, 0) - np.where(fits[:, None], self.sums, 0)
        return pa.array((gap * gap).sum(axis=1), pa.int64(), mask=~fits)


def fitted(vectors: DataFrame, k: int) -> Whitener | None:
    """Fit on all ``vectors`` (see :func:`usable`) of one dimension; None when there are none."""
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = int(most.d), int(most.n)
    rows = vectors.where(F.size("vector") == d)
    sums = gathered(entries(rows, d, d, lambda x: x.sum(axis=0), "long"), d, np.int64)
    mean = (sums - n * SHIFT) / n
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        gap = (x - SHIFT) - mean
        return (gap.T @ gap)[upper]

    half = gathered(entries(rows, d, len(upper[0]), products, "double"), len(upper[0]), float)
    covariance = np.zeros((d, d))
    covariance[upper] = half / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, components = leading_components(covariance, k)
    return Whitener(n, sums, values, components, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all vectors."""
    d, live = len(model.sums), model.live
    k = int(live.sum())
    if not k:
        return 0.0

    def products(x: np.ndarray) -> np.ndarray:
        y = model.whitened(x)[:, live]
        return np.r_[y.sum(axis=0), (y.T @ y).ravel()]

    rows = vectors.where(F.size("vector") == d)
    got = gathered(entries(rows, d, k + k * k, products, "double"), k + k * k, float) / model.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    vectors = usable(rows, id_column, vector)
    kind = dict(vectors.dtypes)["id"]
    ddl = (f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
    model = fitted(vectors, k)
    if model is None:
        return rows.sparkSession.createDataFrame([], ddl)
    error, d, width = identity_error(vectors, model), len(model.sums), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(width)
    explained = np.where(model.live, explained, 0.0)
    names = [f.name for f in fields(ddl)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in grid(batch.column(1), d):
                m = end - first
                each = pa.array(np.repeat(np.arange(m), width))
                made = model.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, m).take(each), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * width, model.n)), model.deviation(x).take(each),
                    pa.array(made, mask=np.isnan(made)), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error))],
                    names=names)

    return vectors.where(F.size("vector") == d).mapInArrow(run, ddl)
