"""Whitening of embeddings on the leading components of their covariance, found by FEAST contour integration.

The covariance is summed by Spark from whole numbers (entries as multiples of 1/1024, centred by the rounded mean),
so it is the same in any order of the rows. The driver holds that one matrix (dimensions squared, whatever the
number of rows) and finds its leading eigenpairs:

* inertia: the signs of the pivots of a symmetric factorisation of V - s I count the eigenvalues above s; bisection
  on such counts cuts the wanted part of the spectrum into intervals of at most ``PER_INTERVAL`` eigenvalues;
* contour: for each interval, a Gauss-Legendre quadrature of (z I - V)^-1 Y over a circle around it, which are
  complex shifted solves, projects a block Y onto the eigenvectors inside;
* Rayleigh-Ritz on the projected block gives the pairs, repeated until the residuals are at rounding level;
* the number found must equal the inertia count of the interval, else the block is widened and the circle repeated.

Defined results: rows whose vector is null, holds a null or non-finite entry, or an entry beyond ``LARGEST`` are
left out, and so are vectors of another length than the most frequent one (ties: the longer). Directions without
variance (at most ``FLAT`` of the trace) are no components; so without two different vectors there are no rows.
Repeated rows count and are returned again. A deviation beyond 64 bits is null. Null ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SCALE, SHIFT = 1024, 100_000
#: Entries of a larger size have no exact whole number.
LARGEST = float(2**42)
COMPONENTS = 8
PER_INTERVAL = 16
#: The upper end of an interval is at most so many times the lower one, but for one that holds a cluster.
SPREAD = 8
POINTS = 16
FLAT = 1e-12
_EXACT = float(2**53)


# ---- eigenpairs of one symmetric matrix ------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``: positive pivots of a symmetric factorisation (Sylvester's inertia).

    Pivots are the largest diagonal entry, or a two-by-two block where off-diagonal entries outweigh it (Bunch-Parlett).
    """
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    limit = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(off.argmax(), off.shape)
        if len(a) == 1 or diagonal[p] >= limit * off[i, j]:
            rest = np.delete(np.arange(len(a)), p)
            above += bool(a[p, p] > 0)
            if a[p, p] == 0:
                return above
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:
            # such a block has one positive and one negative eigenvalue
            above += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            block, side = a[np.ix_([i, j], [i, j])], a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
            a = (a + a.T) / 2
    return above


def project(matrix: np.ndarray, low: float, high: float, block: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The part of ``block`` in the eigenvectors whose eigenvalues lie in (low, high), by quadrature over a circle.

    The matrix is real, so the lower half of the circle repeats the upper one conjugated.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    out = np.zeros_like(block)
    for x, w in zip(nodes, weights):
        turn = radius * np.exp(0.5j * np.pi * (x + 1))
        out += w / 2 * np.real(turn * np.linalg.solve((centre + turn) * np.eye(len(matrix)) - matrix, block))
    return out


def in_interval(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between ``low`` and ``high``, by falling eigenvalue."""
    rng = np.random.default_rng(seed)
    width = min(len(matrix), 2 * count + 8)
    size = max(float(np.abs(matrix).sum(axis=1).max()), np.finfo(float).tiny)
    block = rng.standard_normal((len(matrix), width))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(60):
        basis, _ = np.linalg.qr(project(matrix, low, high, block))
        values, turns = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turns
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        # values that the circle only grazes have large residuals
        inside &= residual <= 1e-3 * size
        if inside.sum() == count:
            worst = float(residual[inside].max(initial=0.0))
            if best is None or worst < best[0] / 2:
                best = (worst, values[inside], vectors[:, inside])
            elif best[0] <= 1e-10 * size:
                order = np.argsort(-best[1])
                return best[1][order], best[2][:, order]
        block = vectors
        if block.shape[1] < width or inside.sum() > count:
            width = min(len(matrix), width + 4)
        if block.shape[1] < width:
            block = np.hstack([block, rng.standard_normal((len(matrix), width - block.shape[1]))])
    if best is not None and best[0] <= 1e-8 * size:
        order = np.argsort(-best[1])
        return best[1][order], best[2][:, order]
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}; the contour did not give all of them")


def _gap(matrix: np.ndarray, x: float, n: int, floor: float, top: float, steps: int = 24) -> tuple[float, float]:
    """The ends of the gap of the spectrum around ``x``, which has ``n`` eigenvalues above it: no eigenvalue lies between."""
    ends = []
    for limit, open_end in ((floor, False), (top, n == 0)):
        near, far = x, limit
        for _ in range(0 if open_end else steps):
            middle = float(np.sqrt(near * far))
            near, far = (middle, far) if count_above(matrix, middle) == n else (near, middle)
        ends.append(limit if open_end else near)
    return ends[0], ends[1]


def leading(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (fewer where the rest is flat) in falling order and their unit eigenvectors.

    Interval edges are put where the counts on both sides differ, away from eigenvalues; a cluster of equal
    eigenvalues that no edge can cut is one interval.
    """
    trace = float(np.trace(matrix))
    if not len(matrix) or trace <= 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    top = float((np.diag(matrix) + radius).max()) * (1 + 1e-9) + FLAT * trace
    floor = FLAT * trace
    wanted = min(k, count_above(matrix, floor))
    if not wanted:
        return np.zeros(0), np.zeros((len(matrix), 0))
    # the lowest edge: at least ``wanted`` eigenvalues above it, as few more as bisection can tell apart
    low, low_n, high = floor, count_above(matrix, floor), top
    while low_n > wanted and high - low > 1e-9 * top:
        middle = (low + high) / 2
        n = count_above(matrix, middle)
        if n >= wanted:
            low, low_n = middle, n
        else:
            high = middle
    # halve by magnitude, so that no circle is wide against the gaps at its lower end
    edges, todo = {low: low_n, top: 0}, [(low, top)]
    while todo:
        a, b = todo.pop()
        count = edges[a] - edges[b]
        if count and (b > SPREAD * a or count > PER_INTERVAL) and b - a > 1e-9 * b:
            middle = float(np.sqrt(a * b))
            edges[middle] = count_above(matrix, middle)
            todo += [(a, middle), (middle, b)]
    # a circle reaches into the gaps at both ends of its eigenvalues, but no farther than is in scale with it
    gaps = {n: _gap(matrix, x, n, floor, top) for n, x in {n: x for x, n in edges.items()}.items()}
    counts = sorted(gaps)
    pieces = []
    for n, m in zip(counts, counts[1:]):
        (below, least), (most, above) = gaps[m], gaps[n]
        width = max(most - least, 1e-9 * most)
        pieces.append((least - min(least - below, width + above - most) / 2, most + min(above - most, width + least - below) / 2, m - n))
    found = [in_interval(matrix, a, b, n) for a, b, n in pieces]
    values, vectors = np.concatenate([x for x, _ in found]), np.hstack([x for _, x in found])
    order = np.argsort(-values, kind="stable")[:wanted]
    # one more orthogonalisation in order, for pairs that came from different intervals
    basis, _ = np.linalg.qr(vectors[:, order])
    small, turns = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-small, kind="stable")
    return small[order], (basis @ turns)[:, order]


# ---- Spark ---------------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(__id, __v): the rows with a vector of finite entries, as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").alias("__id"), v.alias("__v"))
    fine = F.forall("__v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST)))
    return rows.where(F.col("__v").isNotNull() & (F.size("__v") > 0) & fine)


def _whole(column: pa.Array, d: int) -> np.ndarray:
    """The entries as whole numbers, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, d)


@dataclass(frozen=True)
class Moments:
    """Exact count, sums, and sums of products of entries less ``centre``."""

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray
    products: np.ndarray

    @property
    def off(self) -> np.ndarray:
        """The mean less ``centre``."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n - np.outer(self.off, self.off)


def _sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Row count and exact sum per dimension; a task sends one row a dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(0), d)
                safe = float(np.abs(x).max()) * len(x) < 2.0**62
                total = [t + int(v) for t, v in zip(total, x.sum(axis=0) if safe else (sum(map(int, c)) for c in x.T))]
                n += len(x)
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, total))], ["i", "n", "s"])

    parts = rows.select("__v").mapInArrow(sums, "i int, n long, s string")
    merged = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return merged[0].n, tuple(int(r.s) for r in merged)


def _summed_products(rows: DataFrame, width: int, values: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum of products of all pairs of columns of ``values``; the driver gets that one matrix."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = values(batch.column(0))
                # chunks of whole numbers whose products are exact in a double
                step = max(1, min(len(y), int(_EXACT / max(1.0, float(np.abs(y).max()) ** 2))))
                total += sum(y[i : i + step].T @ y[i : i + step] for i in range(0, len(y), step))
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "s"])

    cells = rows.select("__v").mapInArrow(products, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "x"))
    out = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r.i, r.j] = r.x
    return out


def moments(rows: DataFrame, d: int) -> Moments:
    n, sums = _sums(rows, d)
    # the rounded mean: differences to it are small whole numbers
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    return Moments(n, sums, centre, _summed_products(rows, d, lambda v: (_whole(v, d) - centre).astype(float)))


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """The exact sum of (n x - S)^2 per row."""
    d = x.shape[1]
    biggest = max(float(np.abs(x).max()) * n, max(map(abs, sums)))
    if biggest < 2.0**61:
        y = x * n - np.array(sums, np.int64)
        if float(np.abs(y).max()) ** 2 * d < 2.0**62:
            return pa.array((y * y).sum(axis=1), pa.int64())
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component its whitened coordinate, with the exact deviation and the figures of the fit."""
    rows = usable(vectors, key, vector)
    kind = dict(rows.dtypes)["__id"]
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = sizes.d
    rows = rows.where(F.size("__v") == d)
    fit = moments(rows, d)
    covariance = fit.covariance
    values, components = leading(covariance, k)
    k = len(values)
    # x - S / n = (x - centre) - off: a small whole number less a fraction
    turn, off, centre = components / np.sqrt(values), fit.off, fit.centre
    shares = values / float(np.trace(covariance)) if k else values

    def coordinates(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = _whole(column, d)
        return x, ((x - centre).astype(float) - off) @ turn

    with_one = lambda v: np.hstack([np.ones((len(v), 1)), coordinates(v)[1]])
    check = _summed_products(rows, k + 1, with_one)
    mean = check[0, 1:] / fit.n
    error = float(np.abs(check[1:, 1:] / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x, z = coordinates(batch.column(1))
            ids = pc.take(batch.column(0), pa.array(np.repeat(np.arange(m), k)))
            deviation = pc.take(_deviations(x, fit.n, fit.sums), pa.array(np.repeat(np.arange(m), k)))
            cells = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), deviation, z.ravel(), np.tile(shares, m), np.full(m * k, error)]
            yield pa.record_batch([ids, *[c if isinstance(c, pa.Array) else pa.array(c) for c in cells]], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
