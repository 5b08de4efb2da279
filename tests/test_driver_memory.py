"""Sides that repeat values per fold are merged: a broadcast of them is a hash table in the driver that grows with the folds."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import walkforward as wf


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(c, a, (7 * a + 3 * i) % 50 / 100, 1 + i) for c in ("all", "x", "y") for a in range(40) for i in range(3)]
    return spark.createDataFrame(rows, "cell string, avail int, y double, c long")


def broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("method", ["exact", "sketch"])
def test_no_fold_side_is_broadcast(counts, method):
    found = wf.expanding_quantiles(counts, F.lit(40)) if method == "exact" else wf.expanding_sketches(counts, counts.drop("c"), F.lit(40))
    assert found.count() == 3 * 40
    assert broadcasts(found) == 0


def test_predictions_merge_the_models(spark, monkeypatch):
    columns = "fold int, leaf string, id long"
    rows = spark.createDataFrame([(f, c, 2 * f) for f in range(30) for c in ("x", "y")], columns)
    models = spark.createDataFrame([(f, c, f, [0.0, 0.1, 0.2, 0.3, 0.4]) for f in range(30) for c in ("x", "y")], "fold int, cell string, train_rows long, q array<double>")
    monkeypatch.setattr(wf, "walkforward_models", lambda *_: models)
    found = wf.walkforward_predict(rows, keys=["leaf"])
    assert found.where("q is not null").count() == 60
    assert broadcasts(found) == 0
