"""Boosted quantile trees: five pinball regressors grown level by level from histograms that Spark sums.

Features are binned once, by exact quantiles or by level. A level of all five current trees is one pass: tasks count,
per (quantile, node, feature, bin), the rows and those whose return lies under the current prediction, and send those
counts, whose size does not depend on the rows. The pinball gradient of a row is its quantile level less one if it
lies under the prediction, so all sums of gradients are exact and the same in any order. The driver picks the splits
from the summed counts; a leaf's value is the quantile of the residuals in it, from one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.pricing import lit
from flowlens.operators.features import CATEGORICAL, NUMERIC
from flowlens.operators.scale import exact_quantiles, materialize
from flowlens.schemas import QUANTILES

#: Bins per feature, the one of unknown values included; levels of a category beyond them share the last.
BINS = 32
#: Residual quantiles of leaves are exact to one part in so many rows of a leaf.
ACCURACY = 10_000
#: Trees up to so many nodes are read node by node, larger ones level by level.
SMALL_TREE = 63


@dataclass
class Tree:
    """Nodes in heap order. A row goes to 2i + 2 where its bin exceeds ``cut``; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        if len(self.feature) <= SMALL_TREE:
            return np.broadcast_to(self._under(0, bins), len(bins)).astype(np.int64)
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def _under(self, node: int, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row below ``node``: every node compares one column, in bytes."""
        f = self.feature[node]
        if f < 0:
            return np.uint8(node)
        return np.where(bins[:, f] > self.cut[node], self._under(2 * node + 2, bins), self._under(2 * node + 1, bins))


def stump(size: int) -> Tree:
    """A tree whose root is its only node."""
    return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))


@dataclass
class Boosted:
    """The fitted model: bin rules, start values and, per round, one tree for each quantile."""

    numeric: dict[str, list[float]]
    levels: dict[str, list[str]]
    probs: tuple[float, ...]
    start: np.ndarray
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.levels]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            for q, tree in enumerate(trees):
                out[:, q] += self.rate * tree.value[tree.leaves(bins)]
        return out


def bins_of(edges: np.ndarray, column: pa.Array) -> np.ndarray:
    """Number of edges under each value, plus one; 0 where it is unknown."""
    v = column.fill_null(np.nan).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(v), 0, np.searchsorted(edges, v) + 1)


def level_column(levels: Sequence[str], name: str) -> Column:
    """Position of the level; 0 where it is unknown, the last bin for levels that have none of their own."""
    v = F.col(name).cast("string")
    at = F.array_position(F.array(*[F.lit(x) for x in levels]).cast("array<string>"), v).cast("int")
    return F.when(v.isNull(), 0).when(at == 0, BINS - 1).otherwise(at).cast("int")


def binned(df: DataFrame, model: Boosted) -> DataFrame:
    """All columns and ``bins``. The edges are searched in numpy: as one expression of all comparisons they are too long to be compiled."""
    edges = [np.array(e, float) for e in model.numeric.values()]

    @F.arrow_udf("array<int>")
    def placed(*columns: pa.Array) -> pa.Array:
        out = np.empty((len(columns[0]), len(columns)), np.int32)
        for f, column in enumerate(columns):
            out[:, f] = bins_of(edges[f], column) if f < len(edges) else column.to_numpy(zero_copy_only=False)
        return _lists(out)

    numbers = [F.col(c).cast("double") for c in model.numeric]
    return df.withColumn("bins", placed(*numbers, *[level_column(v, c) for c, v in model.levels.items()]))


def _rules(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[dict[str, list[float]], dict[str, list[str]]]:
    edges: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        long = train.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], list(numeric), "feature", "v")
        probs = [i / (BINS - 1) for i in range(1, BINS - 1)]
        # one row a feature
        for r in exact_quantiles(long, ["feature"], "v", probs).collect():
            # nine decimals: noise of the interpolation must not part equal values
            edges[r.feature] = sorted({round(e, 9) for e in r.q})
    levels: dict[str, list[str]] = {}
    for c in categorical:
        # the most frequent levels, at most BINS - 2
        top = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(BINS - 2).collect()
        levels[c] = [r.v for r in top]
    return edges, levels


def _matrix(column: pa.Array) -> np.ndarray:
    """Bins of a batch as bytes, column by column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.uint8, order="F")


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def histogram_cells(rows: DataFrame, model: Boosted, growing: list[Tree], width: int) -> DataFrame:
    """(cell, n): counts by the position in [quantile, node of the level, feature, bin, (rows, rows under the prediction)]."""
    first, nq, nf = width - 1, len(model.probs), len(model.names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((nq, width, nf, BINS, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            at = model.predict(bins)
            places = 2 * bins.astype(np.int64)
            for q, tree in enumerate(growing):
                node = tree.leaves(bins) - first
                live = node >= 0  # rows in leaves of earlier levels are done
                own = places if live.all() else places[live]
                base = 2 * BINS * node[live] + (y < at[:, q])[live]
                for f in range(nf):
                    n = np.bincount(base + own[:, f], minlength=2 * BINS * width).reshape(width, BINS, 2)
                    total[q, :, f, :, 0] += n.sum(axis=2)
                    total[q, :, f, :, 1] += n[:, :, 1]
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(flat[used], pa.int64())], ["cell", "n"])

    return rows.select("bins", "y").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def histograms(rows: DataFrame, model: Boosted, growing: list[Tree], width: int) -> np.ndarray:
    """The same counts as one array; quantiles x nodes x features x bins numbers, whatever the rows."""
    out = np.zeros((len(model.probs), width, len(model.names), BINS, 2), np.int64)
    for r in histogram_cells(rows, model, growing, width).collect():
        out.flat[r.cell] = r.n
    return out


def root_histogram(rows: DataFrame, model: Boosted) -> DataFrame:
    """(quantile, feature, bin, n, under) before the first split."""
    cells = histogram_cells(rows, model, [stump(1) for _ in model.probs], 1)
    nf = len(model.names)
    feature = F.element_at(F.array(*[F.lit(n) for n in model.names]), (F.floor(F.col("cell") / (2 * BINS)) % nf + 1).cast("int"))
    prob = F.element_at(F.array(*[lit(p) for p in model.probs]), (F.floor(F.col("cell") / (2 * BINS * nf)) + 1).cast("int"))
    x = cells.select(prob.alias("quantile"), feature.alias("feature"), (F.floor(F.col("cell") / 2) % BINS).cast("int").alias("bin"), (F.col("cell") % 2).alias("w"), "n")
    both = [F.sum(F.when(F.col("w") == w, F.col("n")).otherwise(0)).alias(name) for w, name in ((0, "n"), (1, "under"))]
    return x.groupBy("quantile", "feature", "bin").agg(*both)


def best_split(counts: np.ndarray, prob: float, min_rows: int) -> tuple[int, int, float]:
    """(feature, cut, gain) of one node's counts [feature, bin, 2]; feature -1 where no split gains or is allowed."""
    n, under = np.cumsum(counts[..., 0], axis=1), np.cumsum(counts[..., 1], axis=1)
    all_n, all_g = n[:, -1:], prob * n[:, -1:] - under[:, -1:]
    g = prob * n - under
    right_n, right_g = all_n - n, all_g - g
    allowed = (n >= min_rows) & (right_n >= min_rows)
    gain = np.where(allowed, g * g / np.maximum(n, 1) + right_g * right_g / np.maximum(right_n, 1) - all_g * all_g / np.maximum(all_n, 1), -1.0)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, cut] <= 1e-12:
        return -1, 0, 0.0
    return int(f), int(cut), float(gain[f, cut])


def _leaf_values(rows: DataFrame, model: Boosted, trees: list[Tree]) -> None:
    """Sets each leaf's value to the quantile of the residuals of the rows in it."""
    nq = len(model.probs)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            at = model.predict(bins)
            for q, tree in enumerate(trees):
                yield pa.record_batch([pa.array(np.full(len(y), q, np.int32)), pa.array(tree.leaves(bins).astype(np.int32)), pa.array(y - at[:, q])], ["q", "leaf", "r"])

    cut = F.percentile_approx("r", list(model.probs), ACCURACY)
    found = rows.select("bins", "y").mapInArrow(residuals, "q int, leaf int, r double").groupBy("q", "leaf").agg(cut.alias("v"))
    for r in found.collect():  # one row a leaf
        trees[r.q].value[r.leaf] = r.v[r.q]


def start_boosted(
    train: DataFrame, target: str = "observed_return", numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, rate: float = 0.3,
    probs: Sequence[float] = QUANTILES,
) -> tuple[Boosted, DataFrame]:
    """The model without a tree, and the binned training rows (bins, y), written once."""
    y = F.col(target).cast("double")
    # written once: bin rules, start values and bins each read it
    used = dict.fromkeys([*numeric, *categorical, target])
    train = materialize(train.where(y.isNotNull() & ~F.isnan(y)).select(*used))
    edges, levels = _rules(train, numeric, categorical)
    start = exact_quantiles(train, [], target, list(probs)).first()
    known = start is not None and start.q is not None and None not in start.q
    model = Boosted(edges, levels, tuple(probs), np.array(start.q if known else [0.0] * len(probs), float), rate)
    return model, materialize(binned(train, model).select("bins", y.alias("y")))


def fit_boosted(
    train: DataFrame, target: str = "observed_return", numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, rounds: int = 8, depth: int = 3,
    rate: float = 0.3, min_rows: int = 30, probs: Sequence[float] = QUANTILES,
) -> Boosted:
    """Fit all quantiles at once; ``rounds`` x (``depth`` + 1) passes over the binned rows. Unknown targets are left out."""
    model, rows = start_boosted(train, target, numeric, categorical, rate, probs)
    for _ in range(rounds):
        size = 2 ** (depth + 1) - 1
        trees = [stump(size) for _ in probs]
        for level in range(depth):
            width = 2**level
            counts = histograms(rows, model, trees, width)
            split = False
            for q, tree in enumerate(trees):
                for node in range(width):
                    f, cut, gain = best_split(counts[q, node], probs[q], min_rows)
                    if f >= 0:
                        tree.feature[width - 1 + node], tree.cut[width - 1 + node], split = f, cut, True
                        model.gains[model.names[f]] = model.gains.get(model.names[f], 0.0) + gain
            if not split:
                break
        _leaf_values(rows, model, trees)
        model.rounds.append(trees)
    return model


def score_boosted(df: DataFrame, model: Boosted) -> DataFrame:
    """Add ``q``, the predicted quantiles in rising order."""

    @F.arrow_udf("array<double>")
    def predicted(bins: pa.Array) -> pa.Array:
        if not len(bins):
            return pa.array([], pa.list_(pa.float64()))
        return _lists(np.sort(model.predict(_matrix(bins)), axis=1))

    return binned(df, model).withColumn("q", predicted("bins")).drop("bins")


def with_leaf(df: DataFrame, model: Boosted, quantile: int = 2, name: str = "leaf") -> DataFrame:
    """Add the leaf of the first tree of a quantile as a text, a cell that the cell models take as a key."""
    tree = model.rounds[0][quantile]

    @F.arrow_udf("string")
    def leaf(bins: pa.Array) -> pa.Array:
        if not len(bins):
            return pa.array([], pa.string())
        return pa.array(tree.leaves(_matrix(bins)).astype(str))

    return binned(df, model).withColumn(name, leaf("bins")).drop("bins")


def boosted_importance(model: Boosted) -> list[tuple[str, float]]:
    """Shares of the summed split gains, largest first."""
    total = sum(model.gains.values()) or 1.0
    return sorted(((f, g / total) for f, g in model.gains.items()), key=lambda x: (-x[1], x[0]))
