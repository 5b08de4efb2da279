"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its quantile bins, each chosen pair of features one over a
grid of coarser bins. The tables are learned by cyclic boosting: round after round every feature
in turn gets a shallow tree on the gradients of the log loss, shrunk and added to its table; then
the pairs with the largest gain get trees of one cut on either axis. A score is a sum of table
entries, looked up for whole batches.

The model is trained in numpy on a bounded sample: the ``SAMPLE`` labelled rows with the smallest
hash of their id. Scoring reads every whole text.

Defined results: null or empty text has all features 0 and gets a score like any other; several
labels of one id: their mean, 0.5 and more counts as 1; null labels and null ids are not learned
from; without labels every score is 0.5. Rows are scored each for itself; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import SPACED, chunks, split_words, text_bytes, with_results

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
LEAVES = 3
PRIOR = 2.0  # added to a leaf's hessian sum

FEATURES = ("log_words", "mean_word", "symbol_rate", "bang_rate", "upper_share", "digit_share", "stop_rate", "words_per_line", "distinct_share", "adjacent_share", "pair_repeat_share", "other_share")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


CLASSES = {
    "symbol": _table("#*$%&|<>@^~=+{}[]\\_"),
    "bang": _table("!"),
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _table("0123456789"),
    "stop": _table(".,;:?"),
    "line": _table("\n"),
    "letter": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128),
}


def features(texts: pa.Array) -> np.ndarray:
    """(texts, features) of an Arrow column."""
    raw, offsets = text_bytes(texts)
    parts = [np.zeros((0, len(FEATURES)))]
    for i, j in chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        own = raw[offsets[i] : offsets[j]]

        def count(inside: np.ndarray, at: np.ndarray = at, own: np.ndarray = own) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(inside[own])])
            return total[at[1:]] - total[at[:-1]]

        n = {k: count(v) for k, v in CLASSES.items()}
        words = split_words(own, at, SPACED)
        h, ptr, w = words.hashes(), words.ptr, words.counts
        doc = np.repeat(np.arange(j - i), w)
        same_doc = doc[1:] == doc[:-1]
        total = np.concatenate([[0], np.cumsum(same_doc & (h[1:] == h[:-1])), [0]])[: len(h) + 1]
        adjacent = np.zeros(j - i, np.int64)
        for d in np.flatnonzero(w > 1).tolist():
            adjacent[d] = total[ptr[d + 1] - 1] - total[ptr[d]]
        distinct = _distinct(doc, h, j - i)
        double = (h[1:] ^ np.roll(h, 1)[1:] * np.uint64(0x9E3779B97F4A7C15))[same_doc]
        pairs = np.maximum(w - 1, 1)
        bytes_ = np.maximum(np.diff(at), 1)
        w1 = np.maximum(w, 1)
        letters = np.maximum(n["letter"], 1)
        size = np.diff(words.offsets[ptr])
        parts.append(
            np.stack(
                [
                    np.log1p(w), size / w1, n["symbol"] / w1, n["bang"] / w1, n["upper"] / letters, n["digit"] / bytes_, n["stop"] / w1, w / (n["line"] + 1), distinct / w1,
                    adjacent / pairs, np.where(w > 1, 1 - _distinct(doc[1:][same_doc], double, j - i) / pairs, 0), 1 - n["letter"] / np.maximum(size, 1),
                ],
                axis=1,
            )
        )
    return np.concatenate(parts)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PRIOR)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most ``LEAVES`` leaves on gradient and hessian sums by bin."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = _gain(left_g, left_h) + _gain(g[a:b].sum() - left_g, h[a:b].sum() - left_h) - _gain(g[a:b].sum(), h[a:b].sum())
                m = int(gain.argmax())
                if gain[m] > best[0]:
                    best = (gain[m], k, a + m + 1)
        if best[1] is None:
            break
        a, b = leaves[best[1]]
        leaves[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + PRIOR)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values by cell) of the best cut on either axis of a grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    q = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gq, hq = q(cg), q(ch)
    gain = sum(_gain(a, b) for a, b in zip(gq, hq, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [-a[i, j] / (b[i, j] + PRIOR) for a, b in zip(gq, hq, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n, width = x.shape
    model = Model(base=float(np.log((y.sum() + 1) / (n - y.sum() + 1))))
    model.edges = [_cuts(x[:, k], BINS) for k in range(width)]
    model.pair_edges = [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * _shallow_tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            total += step[bins[k]]

    def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda ab: -_grid_tree(*grid(*ab, g, h)[:2])[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            gs, hs, cell = grid(a, b, *slopes())
            step = RATE * _grid_tree(gs, hs)[1]
            table += step
            total += step.ravel()[cell]
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE) -> Model | None:
    """A model of ``label`` from at most ``rows`` labelled ids of ``labels`` that ``docs`` has; None without any."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    ids = docs.select(F.col(key).cast("long").alias("id")).distinct()
    chosen = known.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "id").select("id", "y", "t")
    # a repeated id gives one row, so at most ``rows`` rows come to the driver
    one = own.mapInArrow(measured, "id long, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x"))
    table = one.orderBy("id").toArrow()
    if not table.num_rows:
        return None
    return train(np.array(table.column("x").to_pylist()), table.column("y").to_numpy())


def _scorer(broadcast) -> Callable[[Column], Column]:  # noqa: ANN001
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(broadcast.value.score(features(texts)))

    return score.asNondeterministic()


def score(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and score, predicted (1 if the score is ``least`` or more)."""
    if model is None:
        return with_results(docs, {"score": F.lit(0.5), "predicted": F.lit(int(least <= 0.5))})
    run = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    df = docs.withColumn("__gam", run(F.col(text).cast("string")))
    return with_results(df, {"score": F.col("__gam"), "predicted": (F.col("__gam") >= least).cast("int")}).drop("__gam")


def good_documents(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more; all rows without a model."""
    if model is None:
        return docs
    names = [F.col(f"`{c}`") for c in docs.columns]
    judged = score(docs.select(F.struct(*names).alias("__row"), F.col(text).alias("__text")), model, "__text", least)
    return judged.where("predicted = 1").select("__row.*")
