"""Boosted quantile trees: one split by brute force, the fit against cells, the walk-forward on leaves."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.operators import boosting as bo, model as md
from flowlens.plans import queries as reg
from flowlens.schemas import QUANTILES


@pytest.fixture(scope="module")
def halves(spark, sf):
    return reg.halves(spark, sf)


def test_first_split_by_brute_force(spark, halves):
    model, rows = bo.start_boosted(halves[0], numeric=reg.BOOSTED)
    data = rows.collect()
    bins, y = np.array([r.bins for r in data]), np.array([r.y for r in data])
    counts = bo.histograms(rows, model, [bo.stump(1) for _ in QUANTILES], 1)
    assert np.allclose(model.start, np.quantile(y, QUANTILES))
    for q, p in enumerate(QUANTILES):
        g = np.where(y < model.start[q], p - 1, p)
        best = (-1, 0, 0.0)
        for f in range(bins.shape[1]):
            for cut in range(bo.BINS):
                left = bins[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= 30:
                    gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                    best = (f, cut, gain) if gain > best[2] + 1e-9 else best
        got = bo.best_split(counts[q, 0], p, 30)
        assert got[2] == pytest.approx(best[2]) and counts[q, 0, 0].sum(axis=0).tolist() == [len(y), int((y < model.start[q]).sum())]


def test_beats_cells_on_rows_that_depend_on_a_number(spark):
    """The return depends on a feature that no cell holds; the spread on another one."""
    x = spark.range(6000).select(
        F.col("id"), (F.col("id") * 7919 % 1000).cast("double").alias("a"), (F.col("id") * 104_729 % 997).cast("double").alias("b"),
        F.element_at(F.array(*[F.lit(v) for v in ("Call", "Put")]), (F.col("id") % 2 + 1).cast("int")).alias("option_type"), F.lit("BUY").alias("side"), F.lit("NEUTRAL").alias("trend_alignment"),
        F.lit("short").alias("dte_bucket"),
    )
    noise = (F.col("id") * 15_485_863 % 2001) / F.lit(1000.0) - 1
    x = x.withColumn("observed_return", F.round(F.col("a") / 1000 - 0.5 + noise * (0.1 + F.col("b") / 2000), 4))
    train, test = x.where("id % 5 < 4"), x.where("id % 5 = 4")
    model = bo.fit_boosted(train, numeric=("a", "b"))
    scored = bo.score_boosted(test, model)
    assert scored.where(F.array_sort("q") != F.col("q")).isEmpty()
    mine = {r.quantile: r.pinball_loss for r in md.pinball_loss(scored).collect()}
    cells = {r.quantile: r.pinball_loss for r in md.pinball_loss(md.score(test, md.fit_cells(train))).collect()}
    assert all(mine[p] < 0.85 * cells[p] for p in QUANTILES)
    assert bo.boosted_importance(model)[0][0] == "a" and sum(g for _, g in bo.boosted_importance(model)) == pytest.approx(1)


def test_held_out_half_is_no_worse_than_cells(halves):
    train, test = halves
    mine = md.pinball_loss(bo.score_boosted(test, bo.fit_boosted(train, numeric=reg.BOOSTED))).agg(F.sum("pinball_loss")).first()[0]
    cells = md.pinball_loss(md.score(test, md.fit_cells(train))).agg(F.sum("pinball_loss")).first()[0]
    assert mine < cells


def test_walkforward_on_leaves_equals_a_refit_per_fold(spark, sf):
    got = reg.walkforward_tree(spark, sf).collect()
    rows = reg.walk_rows(spark, sf)
    model = bo.fit_boosted(rows.where("fold = -1"), numeric=reg.BOOSTED, rounds=1)
    data = [(r.id, r.fold, r.leaf, r.observed_return) for r in bo.with_leaf(rows, model).collect()]
    assert len({leaf for _, _, leaf, _ in data}) > 1
    by = {r.id: r for r in got}
    assert set(by) == {i for i, f, _, _ in data if f >= 0}
    for i, fold, leaf, _ in data:
        if fold >= 0:
            past = [y for _, f, _, y in data if f < fold]
            own = [y for _, f, v, y in data if f < fold and v == leaf]
            want = np.sort(np.quantile(own if len(own) >= 30 else past, QUANTILES))
            assert np.allclose([by[i].p10, by[i].p25, by[i].p50, by[i].p75, by[i].p90], want, atol=2e-6)


def test_odd_rows(spark):
    schema = "a double, b double, c string, observed_return double"
    odd = spark.createDataFrame([(None, 1.0, None, 0.1), (float("nan"), 2.0, "x", 0.2), (1.0, None, "y", None), (2.0, 3.0, "x", float("nan"))] * 20, schema)
    model = bo.fit_boosted(odd, numeric=("a", "b"), categorical=("c",), rounds=2, min_rows=5)
    assert bo.score_boosted(odd, model).where("size(q) = 5 and q[0] <= q[4]").count() == 80
    empty = odd.where("false")
    assert bo.score_boosted(empty, bo.fit_boosted(empty, numeric=("a", "b"), categorical=("c",), rounds=1)).count() == 0


def test_small_trees_read_node_by_node_equal_level_by_level(monkeypatch):
    rng = np.random.default_rng(6)
    for size in (1, 7, 15, 63):
        feature = rng.integers(0, 4, size)
        feature[size // 2 :] = -1
        feature[rng.random(size) < 0.2] = -1
        tree = bo.Tree(feature, rng.integers(0, 32, size), np.zeros(size))
        bins = rng.integers(0, 32, (500, 4)).astype(np.uint8)
        got = tree.leaves(bins)
        with monkeypatch.context() as m:
            m.setattr(bo, "SMALL_TREE", 0)
            assert got.dtype == np.int64 and (got == tree.leaves(bins)).all()
    assert bo._matrix(pa.array([[1, 31], [2, 0]], pa.list_(pa.int32()))).flags.f_contiguous


def test_bins_count_the_edges_under_a_value_in_a_short_plan(spark):
    """Binning goes by the rows alone: its expression does not grow with the edges."""
    edges = [round(-1 + i / 14, 9) for i in range(30)]
    model = bo.Boosted({"a": edges, "b": []}, {"c": ["x", "y"]}, QUANTILES, np.zeros(5), 0.3)
    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 0.5, *edges]
    df = spark.createDataFrame([(v, v, c) for v in values for c in ("x", "y", "z", None)], "a double, b double, c string")
    got = bo.binned(df, model)
    for r in got.collect():
        known = r.a is not None and r.a == r.a
        assert r.bins == [1 + sum(r.a > e for e in edges) if known else 0, int(known), {"x": 1, "y": 2, "z": bo.BINS - 1, None: 0}[r.c]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count(" > ") < len(edges)
