"""Whitening of embeddings by the leading eigenvectors of their covariance, found with FEAST contour integration.

Spark does what grows with the rows: distinct vectors (the fit list), exact sums, centred products added up per task and then by
entry, and the projection of every row. The driver holds a matrix of the vectors' dimension squared and nothing that grows with the rows.

``eigenpairs`` works on that matrix V:

* ``Inertia`` counts the eigenvalues above a shift (Sylvester's law on the shifted tridiagonal form). Bisection with these counts
  places the ends of the intervals inside gaps of the spectrum; a cluster that straddles the last wanted place is taken whole.
* ``feast`` projects a block of vectors onto the eigenspace of an interval: Gauss-Legendre quadrature, over a circle through its ends, of
  solves with the complex shifted matrix. Rayleigh-Ritz in the projected space gives pairs, and the projection is repeated on them until the
  residuals are at rounding level.
* An interval is done only when it holds as many pairs as its inertia count, so none is missed.

Defined cases: rows whose vector is null or has a null or non-finite component are left out, rows without an id stay; shorter vectors count as if
filled up with zeros; repeated vectors count once in the fit and have a result each; directions without variance (fewer distinct vectors than
components, constant dimensions) are no components, so one distinct vector or an empty table gives no rows; a deviation beyond
64 bits is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import quoted, staged
from pageloom.llm.vectors import dimension, is_sound, matrix, padded, scaled

FACTOR, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues sought per interval, quadrature nodes on the half circle, rounds of projection before a cut and at most.
PER_INTERVAL, NODES, FEW_ROUNDS, ROUNDS = 8, 8, 10, 80
FIELDS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


# -- eigenpairs of a symmetric matrix -----------------------------------------------------------------------------------------

class Inertia:
    """Counts of eigenvalues of a symmetric matrix above a shift."""

    def __init__(self, v: np.ndarray):
        a, n = v.astype(float).copy(), len(v)
        for k in range(n - 2):  # reflections to tridiagonal form, which keep the eigenvalues
            w = a[k + 1:, k].copy()
            w[0] += np.copysign(np.linalg.norm(w), w[0])
            if not (size := np.linalg.norm(w)):
                continue
            w /= size
            p = a[k:, k + 1:] @ w
            a[k:, k + 1:] -= 2 * np.outer(p, w)
            p = w @ a[k + 1:, k:]
            a[k + 1:, k:] -= 2 * np.outer(w, p)
        self.diagonal, self.squares = np.diag(a).copy(), np.concatenate([[0.0], np.diag(a, 1) ** 2])
        reach = np.sqrt(self.squares) + np.sqrt(np.append(self.squares[1:], 0.0))
        self.low, self.high = float((self.diagonal - reach).min()), float((self.diagonal + reach).max())
        self.scale = max(abs(self.low), abs(self.high))

    def above(self, shift: float) -> int:
        """Positive pivots of the shifted matrix."""
        count, pivot, least = 0, 1.0, np.finfo(float).tiny + np.finfo(float).eps ** 2 * self.scale
        for d, s in zip(self.diagonal.tolist(), self.squares.tolist(), strict=True):
            pivot = d - shift - s / pivot
            if abs(pivot) < least:
                pivot = -least
            count += pivot > 0
        return count

    def cut(self, k: int) -> tuple[float, int]:
        """A shift amid the gap below the k-th largest eigenvalue and how many lie above it: k, or more if that gap is closed."""
        low, high, finest = self.low - 1e-3 * self.scale, self.high + 1e-3 * self.scale, 64 * np.finfo(float).eps * self.scale
        if k == len(self.diagonal):
            return low, k
        while high - low > finest:
            middle = (low + high) / 2
            found = self.above(middle)
            if found == k:
                if (below := self.above(middle - finest)) > k > self.above(middle + finest):
                    return self.cut(below)  # what lies on both sides differs by rounding only
                # the gap reaches down to the next eigenvalue and up to the k-th
                down, up = low, middle
                for _ in range(8):
                    down, up = ((down + up) / 2, up) if self.above((down + up) / 2) > k else (down, (down + up) / 2)
                bottom, down, up = up, middle, high
                for _ in range(8):
                    down, up = ((down + up) / 2, up) if self.above((down + up) / 2) == k else (down, (down + up) / 2)
                return (bottom + down) / 2, k
            low, high = (middle, high) if found > k else (low, middle)
        return self.cut(self.above(low))


def feast(v: np.ndarray, low: float, high: float, count: int, rounds: int) -> np.ndarray | None:
    """Eigenvectors of the ``count`` eigenvalues between low and high; none if they are not at rounding level after so many rounds."""
    n = len(v)
    size = min(n, count + max(4, count))
    block = np.linalg.qr(np.random.default_rng(13).standard_normal((n, size)))[0]
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(-0.5j * np.pi * (nodes - 1))
    exact = 40 * np.finfo(float).eps * np.linalg.norm(v) * np.sqrt(n)
    best = None
    for _ in range(rounds):
        projected = np.zeros((n, size))
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - v, block.astype(complex))
            projected += 0.5 * weight * (radius * turn * solved).real
        basis = np.linalg.qr(projected)[0]
        values, inner = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ inner
        inside = (values > low) & (values < high)
        if inside.sum() == count:
            residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0).max() if count else 0.0
            # at rounding level, or no longer getting better there
            if residual <= exact or (best is not None and residual <= 1e3 * exact and residual >= best[0]):
                return block[:, inside] if best is None or residual <= best[0] else best[1]
            best = (residual, block[:, inside]) if best is None or residual < best[0] else best
    return None


def in_slices(v: np.ndarray, inertia: Inertia, low: float, high: float, first: int, last: int) -> np.ndarray:
    """Eigenvectors first+1 to last, counted from the largest, that lie between low and high. An interval much wider than its distance to
    the next eigenvalue outside converges slowly; it is cut in two at a gap."""
    middle, found = inertia.cut((first + last) // 2) if last - first > 1 else (low, last)
    whole = not first < found < last
    columns = feast(v, low, high, last - first, ROUNDS if whole else FEW_ROUNDS)
    if columns is not None:
        return columns
    if whole:
        raise ArithmeticError(f"{last - first} eigenvalues between {low} and {high} by inertia, not found to rounding in {ROUNDS} rounds")
    return np.hstack([in_slices(v, inertia, low, middle, found, last), in_slices(v, inertia, middle, high, first, found)])


def eigenpairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are above rounding, falling, and their unit eigenvectors as columns (largest entry positive)."""
    n = len(v)
    size = float(np.abs(v).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((n, 0))
    v = (v + v.T) / (2 * size)
    inertia = Inertia(v)
    wanted = min(wanted, inertia.above(16 * n * np.finfo(float).eps * inertia.scale))
    vectors, done = [], 0
    top = inertia.high
    if wanted:  # just above the largest: narrow circles separate better
        low, top = inertia.low, inertia.high + 1e-3 * inertia.scale
        for _ in range(12):
            low, top = ((low + top) / 2, top) if inertia.above((low + top) / 2) else (low, (low + top) / 2)
        top += 1e-3 * inertia.scale
    while done < wanted:
        bottom, upto = inertia.cut(min(wanted, done + PER_INTERVAL))
        vectors.append(in_slices(v, inertia, bottom, top, done, upto))
        done, top = upto, bottom
    if not wanted:
        return np.zeros(0), np.zeros((n, 0))
    # once more over all intervals together, which makes their vectors orthogonal to rounding
    basis = np.linalg.qr(np.hstack(vectors))[0]
    values, inner = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:wanted] * size, (basis @ inner)[:, ::-1][:, :wanted]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(wanted)] < 0, -1.0, 1.0)
    return values, vectors


# -- sums over the fit list ---------------------------------------------------------------------------------------------------

def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they hold it, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total = [0] * dims
    for batch in batches:
        x = matrix(batch.column("x"), dims)
        wide = x if int(np.abs(x).max(initial=0)) * len(x) < 2**62 else x.astype(object)
        total = [a + int(b) for a, b in zip(total, wide.sum(0), strict=True)]
    yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "total": pa.array([str(t) for t in total])})


def _products(batches: Iterator[pa.RecordBatch], dims: int, n: int, sums: list[int], axes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums of products of the centred rows, along the dimensions or along ``axes``; upper half."""
    size = dims if axes is None else axes.shape[1]
    total = np.zeros((size, size))
    for batch in batches:
        rows = offsets(matrix(batch.column("x"), dims), n, sums).astype(float) / n
        rows = rows if axes is None else rows @ axes
        total += rows.T @ rows
    i, j = np.triu_indices(size)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array(total[i, j])})


def covariance(fit: DataFrame, dims: int, n: int, sums: list[int], axes: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list, divisor n, centred before multiplying; with ``axes``, of its projection on them."""
    parts = fit.mapInArrow(lambda batches: _products(batches, dims, n, sums, axes), "i int, j int, total double")
    found = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()  # a row per entry of the matrix
    i, j, total = (found[c].to_numpy() for c in ("i", "j", "total"))
    out = np.zeros((dims, dims) if axes is None else (axes.shape[1],) * 2)
    out[i, j] = out[j, i] = total / n
    return out


def _whitened(batches: Iterator[pa.RecordBatch], dims: int, n: int, sums: list[int], axes: np.ndarray, told: list[float], error: float) -> Iterator[pa.RecordBatch]:
    k = axes.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            away = offsets(matrix(some.column("x"), dims), n, sums)
            if away.dtype == object or float(np.abs(away).max(initial=0)) ** 2 * dims >= 2**62:
                squares = [d if (d := sum(int(a) ** 2 for a in row)) < 2**63 else None for row in away]
            else:
                squares = (away * away).sum(1)
            projected = (away.astype(float) / n) @ axes
            rows, ids = some.num_rows, some.column("vec_id")
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(pa.array(np.repeat(np.arange(rows), k))), "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                "n": pa.array(np.full(rows * k, n)), "deviation": pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                "whitened": pa.array(projected.ravel()), "explained": pa.array(np.tile(np.array(told), rows)),
                "identity_error": pa.array(np.full(rows * k, error))})


def whitened(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR,
             shift: int = SHIFT) -> DataFrame:
    """A row per sound vector and component: vec_id, component (from 1 by falling variance), n (vectors of the fit list), deviation
    (exact sum of (n*x-S)^2), whitened, explained, identity_error (largest entry of the whitened fit's covariance minus the identity)."""
    spark = rows.sparkSession
    sound = rows.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(vector).alias("v")).filter(is_sound(F.col("v")))
    dims = dimension(sound, "v")
    ready = sound.select("vec_id", padded(scaled(F.col("v"), factor, shift), dims, shift).alias("x"))
    fit = staged(ready.select("x").distinct())
    n = fit.count()
    empty = spark.createDataFrame([], FIELDS)
    if not n or not dims:
        return empty
    added = fit.mapInArrow(lambda batches: _sums(batches, dims), "i int, total string")
    found = added.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row per dimension
    sums = [int(r.total) for r in sorted(found, key=lambda r: r.i)]
    v = covariance(fit, dims, n, sums)
    values, vectors = eigenpairs(v, components)
    if not len(values):
        return empty
    axes = vectors / np.sqrt(values)
    error = float(np.abs(covariance(fit, dims, n, sums, axes) - np.eye(len(values))).max())
    told = [float(e) for e in values / np.trace(v)]
    return ready.mapInArrow(lambda batches: _whitened(batches, dims, n, sums, axes, told, error), FIELDS)
