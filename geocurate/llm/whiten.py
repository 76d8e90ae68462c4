"""Whitening of embeddings by a bidiagonal qd solver.

Centred rows are reduced to one triangular matrix by QR, block by block in every task and
then over the tasks' results.  Only that matrix, as wide as a vector, reaches the driver.  It is
brought to bidiagonal form by Householder reflections, the dqds algorithm finds its singular
values, and twisted factorisations the directions that belong to the largest.  The covariance
matrix, which would square the condition number, is never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocurate.runtime import stage

#: Values of a block that QR takes at once.
BLOCK_VALUES = 1_000_000
#: Tasks of the second level of the reduction; the third is one task.
FAN = 64
#: Whole numbers from here on have no exact double.
EXACT = 2.0**53
_EPS = float(np.finfo(np.float64).eps)
_TINY = float(np.finfo(np.float64).tiny) / _EPS


# -- whole rows -----------------------------------------------------------------


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows (id, x) of the usable vectors, ``x`` the array of ``floor(scale * c)`` as long.

    An entry beyond 2^53 in absolute value after scaling fails the query.  All other columns are left out, so they may
    have any name; rows with a null id and repeated rows stay.
    """
    rows = df.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_v")).filter(usable(F.col("_v")))
    too_large = F.raise_error(F.lit("an entry is too large for a whole number")).cast("long")
    return rows.select(
        id_col, F.transform("_v", lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale)).otherwise(too_large)).alias("x")
    )


def _rows_of(column: pa.Array, dtype=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), dtype)


def moments(vectors: DataFrame, column: str = "x") -> tuple[int, list[int]]:
    """The number of rows, and the exact sum of each dimension.  Vectors of unlike length are an error.

    Each task sums the high and the low bits of its rows apart, so that nothing overflows;
    Spark adds the tasks' sums, and one row per dimension reaches the driver.
    """
    spread = vectors.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if spread["low"] != spread["high"]:
        raise ValueError(f"vectors of {spread['low']} to {spread['high']} entries")
    if not spread["high"]:
        return (0 if spread["high"] is None else vectors.count()), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = _rows_of(batch.column(0))
            if len(x):
                n, high, low = n + len(x), high + (x >> 20).sum(0), low + (x & 0xFFFFF).sum(0)
        if n:
            at = np.arange(len(high), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = (
        vectors.select(column).mapInArrow(run, "at int, n long, high long, low long")
        .groupBy("at").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()
    )
    sums.sort(key=lambda r: r["at"])
    return sums[0]["n"], [(int(r["high"]) << 20) + int(r["low"]) for r in sums]


def triangle(vectors: DataFrame, mean: np.ndarray, column: str = "x") -> np.ndarray:
    """The R of a QR decomposition of the rows less *mean*: d x d, or as many rows as there are if fewer."""
    d = len(mean)
    block = max(d, BLOCK_VALUES // d)

    def reduce(centre: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, d))
            for batch in batches:
                for start in range(0, batch.num_rows, block):
                    rows = _rows_of(batch.column(0).slice(start, block), np.float64) - centre
                    r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
            offsets = np.arange(0, r.size + 1, d, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, r.ravel())], ["r"])

        return run

    level = vectors.select(F.col(column).alias("r")).mapInArrow(reduce(mean), "r array<double>")
    for tasks in (FAN, 1):
        level = level.repartition(tasks).mapInArrow(reduce(np.zeros(d)), "r array<double>")
    return _rows_of(level.toArrow().column("r").combine_chunks(), np.float64).reshape(-1, d)


# -- the solver, on one matrix as wide as a vector --------------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right vectors of ``r = U B V^T`` by Householder reflections."""
    d = r.shape[1]
    a = np.zeros((max(d, len(r)), d))
    a[: len(r)] = r
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        """Unit normal of the reflection that takes *x* to its first axis."""
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        h = x / size
        h[0] += math.copysign(1.0, h[0])
        return h / np.linalg.norm(h)

    for k in range(d):
        if (h := mirror(a[k:, k].copy())) is not None:
            a[k:, k:] -= np.outer(2 * h, h @ a[k:, k:])
        if k < d - 2 and (h := mirror(a[k, k + 1:].copy())) is not None:
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ h, 2 * h)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ h, 2 * h)
    return np.diag(a)[:d].copy(), np.diag(a, 1)[: d - 1].copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform of a block; None where the shift is above the smallest value left."""
    new_q, new_e, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        new_q.append(d + e[i])
        t = q[i + 1] / new_q[i]
        new_e.append(e[i] * t)
        d = d * t - shift
    if d < 0 or d != d:
        return None
    return [*new_q, d], new_e


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, each to high relative accuracy.

    Every sweep is free of subtractions but for the shift, which stays below the smallest
    value; values are split off at the lower end as they settle.
    """
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = [float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale]
    found, shifted = [], 0.0
    blocks = [(q, e, shifted)]
    while blocks:
        q, e, shifted = blocks.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS * _EPS * (shifted + min(q[i], q[i + 1])) or e[i] < _TINY), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if len(q) == 1:
                found.append(shifted + q[0])
                break
            # the lower end's own smallest value is the shift to try first
            half, last = (q[-2] + e[-1] + q[-1]) / 2, q[-1]
            root = math.sqrt(max(0.0, half * half - q[-2] * last))
            shift = q[-2] * last / (half + root) if half + root > 0 else 0.0
            for attempt in (shift * (1 - 4 * _EPS), shift / 2, shift / 16, 0.0):
                if (done := _sweep(q, e, attempt)) is not None:
                    (q, e), shifted = done, shifted + attempt
                    break
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, beside: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of ``B^T B`` for *value*, orthogonal to the vectors *beside* it.

    A factorisation from the top and one from the bottom meet at the row where they leave
    least over; the vector follows from there by multiplications alone.  Where values
    coincide, other rows give the other vectors of their space.
    """
    n = len(diagonal)
    floor = _TINY * max(1.0, value)
    safe = lambda x: x if abs(x) > floor else math.copysign(floor, x)
    d = [max(float(x) ** 2, floor) for x in diagonal]
    ell = [float(b) * math.copysign(1.0, float(a)) / math.sqrt(dd) for a, b, dd in zip(diagonal, above, d)]
    s, lower = [-value], []
    for i in range(n - 1):
        plus = safe(s[i] + d[i])
        lower.append(d[i] * ell[i] / plus)
        s.append(lower[i] * ell[i] * s[i] - value)
    p, upper = [0.0] * n, [0.0] * (n - 1)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * ell[i] ** 2 + p[i + 1])
        upper[i] = ell[i] * t
        p[i] = p[i + 1] * t - value
    left = np.abs(np.array(s) + np.array(p) + value)
    best, best_size = None, 0.0
    for k in np.argsort(np.nan_to_num(left, nan=np.inf), kind="stable")[: len(beside) + 4 if beside else 1]:
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -upper[i] * z[i]
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in beside:
                z -= (z @ other) * other
        size = np.linalg.norm(z)
        if size > best_size:
            best, best_size = z / size, size
        if size > 0.5:
            break
    return best


@dataclass(frozen=True)
class Whitening:
    """Rows, exact sums, and by falling eigenvalue the directions (d x k), eigenvalues and the trace."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of *x*."""
        return (x - self.mean) @ self.directions / np.sqrt(self.values)


def solve(r: np.ndarray, n: int, sums: list[int], components: int | None = None) -> Whitening:
    """The whitening that belongs to the triangle of *n* centred rows."""
    d = r.shape[1]
    diagonal, above, v = bidiagonalise(r)
    squares = dqds(diagonal, above)
    # below this a singular value is rounding
    real = squares > squares.max(initial=0.0) * (max(n, d) * _EPS) ** 2
    wanted = [float(x) for x in squares[real][: components or d]]
    found: list[np.ndarray] = []
    for value in wanted:
        beside = [z for z, other in zip(found, wanted) if abs(other - value) <= 1e-6 * other]
        found.append(twisted(diagonal, above, value, beside))
    z = np.array(found).reshape(len(wanted), d).T
    for k in range(z.shape[1]):  # what rounding left of one in the other
        z[:, k] -= z[:, :k] @ (z[:, :k].T @ z[:, k])
        z[:, k] /= np.linalg.norm(z[:, k])
    directions = v @ z
    if wanted:
        directions *= np.sign(directions[np.abs(directions).argmax(0), np.arange(len(wanted))])
    trace = float((diagonal**2).sum() + (above**2).sum()) / n if n else 0.0
    return Whitening(n, tuple(sums), directions, np.array(wanted) / max(n, 1), trace)


# -- the operator -----------------------------------------------------------------


def fit(vectors: DataFrame, column: str = "x", components: int | None = None) -> Whitening:
    """Learn from all rows of *vectors*, whole numbers as arrays of long; at most *components* directions.

    Repeated rows count as often as they come.  Directions without variance (singular values within
    rounding of zero) are left out, so equal rows, or one row, or none give no direction at all.
    *vectors* should be a stored table: it is read three times.
    """
    n, sums = moments(vectors, column)
    if not sums:
        return Whitening(n, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    mean = np.array([s // n + (s % n) / n for s in sums])
    return solve(triangle(vectors, mean, column), n, sums, components)


def identity_error(vectors: DataFrame, whitening: Whitening, column: str = "x") -> float:
    """Largest absolute entry of the covariance of the whitened rows, divisor n, minus the identity.

    Tasks add up products of their own rows; one row per pair of components reaches the driver.
    """
    k = len(whitening.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = whitening.rows(_rows_of(batch.column(0)))
                products, total = products + w.T @ w, total + w.sum(0)
        values = np.concatenate([products.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    sums = vectors.select(column).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(k * k + k)
    for r in sums:
        values[r["at"]] = r["value"]
    mean = values[k * k:] / whitening.n
    covariance = values[: k * k].reshape(k, k) / whitening.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def apply(df: DataFrame, whitening: Whitening, id_col: str, column: str = "x") -> DataFrame:
    """Rows (id, deviation, whitened) of all rows: ``whitened`` an array, one entry a direction.

    ``deviation`` is the sum over dimensions of ``(n * x - sum)^2``, exact; beyond 64 bits it fails.
    """
    sums = np.array(whitening.sums, np.float64)
    fits = all(abs(s) < 2**62 for s in whitening.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch.column(1))
            if len(x):
                if not fits or (((whitening.n * x.astype(np.float64) - sums) ** 2).sum(1) >= 2.0**62).any() or np.abs(x).max(initial=0) * float(whitening.n) >= 2.0**62:
                    raise OverflowError("a deviation exceeds 64 bits")
                deviation = ((whitening.n * x - np.array(whitening.sums, np.int64)) ** 2).sum(1)
            else:
                deviation = np.zeros(0, np.int64)
            w = whitening.rows(x) if len(x) else np.zeros((0, len(whitening.values)))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(whitening.values)
            arrays = [batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets.astype(np.int32), w.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "deviation", "whitened"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, column).mapInArrow(run, f"`{id_col}` {kind}, deviation long, whitened array<double>")


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, components: int | None = None
) -> tuple[DataFrame, Whitening, float]:
    """Quantise, fit on the distinct vectors, and whiten every usable row.

    Returns the rows of `apply`, the whitening and its `identity_error`.  An empty table, or one without
    usable vectors, gives no rows.  A vector that any share of the rows holds counts once in the fit: tasks
    drop their own repeats before the shuffle.
    """
    whole = stage(quantise(df, id_col, vector_col, scale), "quantised").df
    distinct = stage(whole.select("x").distinct(), "distinct_vectors").df
    whitening = fit(distinct, components=components)
    return apply(whole, whitening, id_col), whitening, identity_error(distinct, whitening)
