"""Whitening of vectors by the leading components of their covariance (operator 13).

Components c become integers x = floor(scale * c) + offset. Each distinct vector counts once in the fit:
n vectors with sums S per dimension. Tasks add up second moments of x less the integer part of S / n, in
exact integers; the rest of the mean, below one, is taken out of the exact totals. The covariance
therefore depends neither on the order nor on the partitioning of the rows and is rounded once.

The driver meets only the matrix (dimensions x dimensions). Householder reflections make it
tridiagonal; bisection by Sturm counts finds the leading eigenvalues; inverse iteration finds
their vectors, made orthogonal to the earlier ones of a cluster of close eigenvalues; the reflections carry them
back. The projection (dimensions x components) is broadcast and every row is centred and projected.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, as are rows of
another length than the commonest (of equals the smaller). Repeated rows and ids give rows each and
count once in the fit if their vectors are equal. Components whose eigenvalue is not above ``RANK`` of the
largest cannot be told from zero and are left out: fewer than ``components`` come back for short vectors or
few distinct ones, none (no rows) if all vectors are equal. Between equal eigenvalues the components
are an orthogonal basis of their space. An empty table gives no rows. Other columns never enter. Integers of
2^40 or more raise an error. A deviation beyond 64 bits comes back null.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, only
from gaugeline.llm.vector_codes import common_length, usable

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Eigenvalues up to this share of the largest are rounding.
RANK = 1e-12
#: Eigenvalues closer than this share of the norm are a cluster.
CLUSTER = 1e-3
ROWS = 4096
LIMIT = 1 << 40


# ---- eigenvectors of a symmetric matrix ---------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors: reflections H_k turn the matrix into T."""
    a = matrix.copy()
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        v = x.copy()
        if length > 0:
            v[0] += length if x[0] >= 0 else -length
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -length if x[0] >= 0 else length
            a[k + 2 :, k] = a[k, k + 2 :] = 0
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of the tridiagonal matrix below each value of ``at``: negative pivots of T - at."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), dtype=np.int64)
    pivot = np.ones(len(at))
    for k, entry in enumerate(diagonal):
        pivot = entry - at - (off[k - 1] ** 2 / pivot if k else 0.0)
        # A pivot of zero counts as a negative one.
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection until its interval has no double inside."""
    n = len(diagonal)
    reach = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    pad = 2 * np.finfo(float).eps * max(np.abs(low[0]), np.abs(high[0])) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    rank = n - 1 - np.arange(k)  # so many eigenvalues lie below the wanted one
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = sturm_counts(diagonal, off, middle) > rank
        high = np.where(open_ & above, middle, high)
        low = np.where(open_ & ~above, middle, low)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) y = right by elimination with row exchanges; pivots below ``least`` become it."""
    n = len(diagonal)
    main, upper, second, y = diagonal - shift, np.r_[off, 0.0], np.zeros(n), right.copy()
    for k in range(n - 1):
        below, next_main, next_upper = off[k], main[k + 1], upper[k + 1]
        if abs(below) > abs(main[k]):
            # The next row becomes the pivot row.
            factor = main[k] / below
            main[k], main[k + 1] = below, upper[k] - factor * next_main
            upper[k], second[k], upper[k + 1] = next_main, next_upper, -factor * next_upper
            y[k], y[k + 1] = y[k + 1], y[k] - factor * y[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            factor = below / main[k]
            main[k + 1] = next_main - factor * upper[k]
            y[k + 1] -= factor * y[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(n - 1, -1, -1):
        if k + 1 < n:
            y[k] -= upper[k] * y[k + 1]
        if k + 2 < n:
            y[k] -= second[k] * y[k + 2]
        y[k] /= main[k]
    return y


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 4) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, by inverse iteration.

    Vectors of a cluster are made orthogonal to the earlier ones of it after every step; equal
    eigenvalues are told apart by shifts of a few roundings.
    """
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    eps = np.finfo(float).eps * norm
    rng = np.random.default_rng(13)
    found = np.zeros((n, len(values)))
    start, last = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        shift = value if last is None or k == start else min(value, last - 4 * eps)
        last = shift
        y = rng.uniform(-1, 1, n)
        for _ in range(steps):
            earlier = found[:, start:k]
            # Twice is enough: the second pass takes out what rounding left.
            y -= earlier @ (earlier.T @ y)
            y -= earlier @ (earlier.T @ y)
            y /= np.linalg.norm(y)
            y = solve_shifted(diagonal, off, shift, y, eps)
            y /= np.abs(y).max()
        earlier = found[:, start:k]
        for _ in range(2):
            y -= earlier @ (earlier.T @ y)
            y /= np.linalg.norm(y)
        found[:, k] = y
    return found


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    size = np.abs(matrix).max() if matrix.size else 0.0
    if not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading_eigenvalues(diagonal, off, min(k, len(matrix)))
    vectors = eigenvectors(diagonal, off, values)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


# ---- the fit ------------------------------------------------------------------------------


def exact_moments(rows: np.ndarray) -> np.ndarray:
    """Sum of the outer products of integer rows, as Python integers.

    Float products are exact while their sums stay below 2^53; rows too large for that are multiplied
    as integers of any size.
    """
    most = int(np.abs(rows).max()) if rows.size else 0
    slab = (1 << 53) // max(1, most * most)
    if slab < 16:
        large = rows.astype(object)
        return large.T @ large
    total = np.zeros((rows.shape[1],) * 2, dtype=object)
    for at in range(0, len(rows), slab):
        part = rows[at : at + slab].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def matrix_of(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, dims)


@dataclass
class Whitening:
    """A fit: number of distinct vectors, their sums, covariance, eigenvalues and unit components (columns)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    identity_error: float | None = None

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S / n, from exact integers."""
        return (rows * self.n - np.array(self.sums, dtype=np.int64)[None, :]).astype(np.float64) / self.n

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        """The projections; summed one dimension after another, as a library's product rounds a row by the rows beside it."""
        total = np.zeros((len(rows), len(self.values)))
        for away, component in zip(self.centred(rows).T, self.components / np.sqrt(self.values)[None, :], strict=True):
            total += away[:, None] * component[None, :]
        return total

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        away = rows * self.n - np.array(self.sums, dtype=np.int64)[None, :]
        most = int(np.abs(away).max()) if away.size else 0
        if most * most * max(1, away.shape[1]) < 1 << 63:
            return (away * away).sum(axis=1).tolist()
        exact = (away.astype(object) ** 2).sum(axis=1).tolist()
        return [x if x < 1 << 63 else None for x in exact]


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and sums per dimension."""

    def run(batches):
        n, sums = 0, np.zeros(dims, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += matrix_of(batch, 0, dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([n] * dims), pa.array(sums)], ["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow().sort_by("i")
    return rows.column("n")[0].as_py(), rows.column("s").to_pylist()


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list with divisor n, from exact integers, each entry rounded once."""
    dims = len(sums)
    base = [s // n for s in sums]
    i, j = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims), dtype=object)
        centre = np.array(base, dtype=np.int64)[None, :]
        for batch in batches:
            rows = matrix_of(batch, 0, dims)
            for at in range(0, len(rows), ROWS):
                total += exact_moments(rows[at : at + ROWS] - centre)
        cells = [str(x) for x in total[i, j].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(cells)], ["i", "j", "m"])

    cells = fit.mapInArrow(run, "i int, j int, m string").groupBy("i", "j").agg(F.sum(F.col("m").cast("decimal(38,0)")).cast("string").alias("m"))
    rest = [s - b * n for s, b in zip(sums, base, strict=True)]
    matrix = np.zeros((dims, dims))
    # One row per entry of the matrix, whatever the number of vectors.
    for a, b, m in zip(*[c.to_pylist() for c in cells.toArrow().columns], strict=True):
        matrix[a, b] = matrix[b, a] = float(Fraction(int(m) * n - rest[a] * rest[b], n * n))
    return matrix


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    dims, k = len(model.sums), len(model.values)
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            rows = matrix_of(batch, 0, dims)
            for at in range(0, len(rows), ROWS):
                white = shared.value.whiten(rows[at : at + ROWS])
                white = np.concatenate([white, np.ones((len(white), 1))], axis=1)
                total += white.T @ white
        a, b = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], ["a", "b", "v"])

    found = fit.mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((k + 1, k + 1))
    total[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("v").to_numpy()
    # The vectors are centred before they are multiplied; their own mean, a rounding, goes out here.
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def integers(vectors: DataFrame, id_column: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x) of the usable rows."""
    rows = only(vectors, id_column, vector).toDF("vec_id", "v").withColumn("v", F.col("v").cast("array<double>")).where(usable(F.col("v")))
    outside = F.raise_error(F.lit(f"an entry of {LIMIT} or more after scaling"))
    whole = F.transform("v", lambda c: F.when(F.abs(c * scale) < LIMIT, F.floor(c * scale) + offset).otherwise(outside))
    return rows.select("vec_id", whole.alias("x"))


def fit(rows: DataFrame, dims: int, components: int, scratch: Scratch) -> Whitening:
    """The whitening of the distinct vectors ``x`` of ``rows``, all of length ``dims``."""
    distinct = scratch.settle(rows.select("x").distinct(), "fit")
    n, sums = totals(distinct, dims)
    matrix = covariance(distinct, n, sums)
    values, vectors = leading_components(matrix, components)
    whole = np.flatnonzero(values > RANK * values[:1]) if len(values) else np.zeros(0, dtype=np.int64)
    model = Whitening(n, sums, matrix, values[whole], vectors[:, whole])
    if len(whole):
        model.identity_error = identity_error(distinct, model)
    scratch.drop("fit")
    return model


WHITE_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per row and component: its whitened value and the figures of the fit."""
    dims, k = len(model.sums), len(model.values)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    explained = model.values / np.trace(model.covariance)
    # The broadcast holds the projection: dimensions x components, not rows.
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, n = matrix_of(part, 1, dims), part.num_rows
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, shared.value.n)),
                        pa.array(shared.value.deviations(x), pa.int64()).take(each), pa.array(shared.value.whiten(x).ravel()),
                        pa.array(np.tile(explained, n)), pa.array(np.full(n * k, shared.value.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {id_type}, {WHITE_SCHEMA}")


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = integers(vectors, id_column, vector, scale, offset)
    dims = common_length(rows, "x")
    if dims is not None:
        rows = rows.where(F.size("x") == dims)
        model = fit(rows, dims, components, scratch)
        if len(model.values):
            return project(rows, model)
    return vectors.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {WHITE_SCHEMA}")
