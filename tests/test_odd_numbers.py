"""NULL, NaN and infinite numbers, absent prices, many parameter sets, and the growth of the walk-forward."""

import datetime

import pytest
from pyspark.sql import functions as F

from flowlens.operators import audit, backtest as bt, features as ft, labels as lb, model as md, validate as va, walkforward as wf
from flowlens.plans import queries as reg


def test_null_and_infinite_returns_are_no_observations(spark):
    rows = [(i, "Call", "BUY", "NEUTRAL", "short", float(i)) for i in range(10)] + [(20 + i, "Call", "BUY", "NEUTRAL", "short", x) for i, x in enumerate([None, float("nan"), float("inf")])]
    df = spark.createDataFrame(rows, "id long, option_type string, side string, trend_alignment string, dte_bucket string, observed_return double")
    (whole,) = md.fit_cells(df).where(F.col("cell") == md.EVERY).collect()
    assert whole.n == 10 and list(whole.q) == pytest.approx([0.9, 2.25, 4.5, 6.75, 8.1])


def test_two_samples_ignore_values_that_are_not_finite(spark, sf):
    t = reg.labeled(spark, sf)
    odd = t.withColumn("premium", F.when(F.col("id") % 50 == 0, F.lit(float("inf"))).when(F.col("id") % 50 == 1, F.lit(float("nan"))).otherwise(F.col("premium")))
    without = t.where(~(F.col("id") % 50).isin(0, 1))
    pick = lambda df: {r.feature: tuple(r) for r in df.collect() if r.feature == "premium"}
    assert pick(va.ks(odd)) == pick(va.ks(without))
    assert sorted(map(str, audit.feature_distribution(odd).where("feature = 'premium'").collect())) == sorted(map(str, audit.feature_distribution(without).where("feature = 'premium'").collect()))


def test_encoding_keeps_every_row(spark, sf):
    t = ft.features(reg.labeled(spark, sf), mode="static").withColumn("open_interest", F.lit(None).cast("long"))
    t = t.withColumn("volume", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("volume"))).withColumn("premium", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("premium")))
    fitted = ft.impute_encode(t)
    assert fitted[0]["open_interest"] is None
    assert ft.encode(t, fitted).where("features is not null").count() == t.count()


def test_medians_are_not_rounded(spark, sf):
    t = ft.features(reg.labeled(spark, sf), mode="static").limit(2).withColumn("volume", F.when(F.col("id") % 2 == 0, 2254).otherwise(2255).cast("long"))
    ids = [r.id for r in t.collect()]
    t = t.withColumn("volume", F.when(F.col("id") == ids[0], 2254).otherwise(2255).cast("long"))
    fitted = ft.impute_encode(t)
    assert fitted[0]["volume"] == 2254.5
    assert ft.encode(t.withColumn("volume", F.lit(None).cast("long")), fitted).select("volume").first()[0] == 2254.5


def test_trade_without_price_is_kept_and_not_labelled(spark):
    trades = lb.unlabeled(spark.createDataFrame([(1, "A", datetime.date(2000, 1, 1), datetime.datetime(2000, 1, 1), "Call", "BUY", None)], "id long, ticker string, trade_date date, ts timestamp, option_type string, side string, underlier_price double"))
    bars = spark.createDataFrame([("A", datetime.date(2000, 1, 3), 5.0)], "ticker string, bar_date date, close double")
    (row,) = lb.label_trades(trades, bars, datetime.datetime(2001, 1, 1)).collect()
    assert row.labeled is False and row.observed_return is None


def test_more_than_a_thousand_parameter_sets(spark):
    sets = bt.params_frame(spark, [{"strategy_type": "whale_quality", "prob_threshold": i / 2000} for i in range(1300)])
    pairs = bt.params_cross(spark.range(3), sets)
    assert pairs.count() == 3900 and pairs.select("p.run_id").distinct().count() == 1300


def test_walk_forward_work_is_linear_in_folds(spark):
    """Rows that meet in the exact counts, for ten times as many folds of the same size."""

    def met(n_folds):
        rows = spark.range(n_folds * 40).select(F.lit("c").alias("cell"), (F.col("id") / 40).cast("long").alias("avail"), ((F.col("id") * 7919) % 100 / 10000).alias("y"))
        h = rows.groupBy("cell", "avail", "y").agg(F.count("*").alias("c")).withColumn("b", F.lit(0).cast("long"))
        wanted = spark.range(n_folds).select(F.lit("c").alias("cell"), F.col("id").alias("fold"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("below"), F.lit(0).alias("n"), F.floor(F.col("id") / wf.BLOCK).alias("_block"))
        out = wf.counts_at(h, wanted, F.lit(n_folds))
        # Every fold sees all rows up to it.
        assert {r.fold: r.s for r in out.groupBy("fold").agg(F.sum("c").alias("s")).collect()} == {f: 40 * (f + 1) for f in range(n_folds)}
        return out.count()

    assert met(300) <= 11 * met(30)
