"""Labels, exits, metrics, sweep and validation on small hand-written tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from flowlens.operators import backtest as bt, labels as lb, sweep as sw, validate as va, walkforward as wf
from flowlens.plans import queries as reg


def trade(spark, **given):
    base = {
        "id": 1, "ticker": "A", "option_type": "Call", "side": "BUY", "underlier_price": 100.0, "strike": 100.0, "premium": 1000.0,
        "dte": 30, "open_interest": 500, "vol_oi_ratio": 6.0, "implied_vol": 40.0, "trend_alignment": "NEUTRAL", "is_synthetic": 1,
        "commission_per_contract": 1.1, "observed_return": 0.0, "max_adverse_return": 0.0, "p_success": 0.6, "q": [-0.2, -0.1, 0.05, 0.1, 0.2],
    }
    row = {**base, **given}
    d = datetime.date(2024, 1, 1)
    row.update(trade_date=d, expiration=d + datetime.timedelta(days=30), evaluation_date=d + datetime.timedelta(days=10))
    schema = (
        "id long, ticker string, option_type string, side string, underlier_price double, strike double, premium double, dte int,"
        "open_interest long, vol_oi_ratio double, implied_vol double, trend_alignment string, is_synthetic int, commission_per_contract double,"
        "observed_return double, max_adverse_return double, p_success double, q array<double>, trade_date date, expiration date, evaluation_date date"
    )
    names = [f.split()[0] for f in schema.replace(",", ", ").split(", ") if f]
    return spark.createDataFrame([tuple(row[n] for n in names)], schema)


def result(spark, sets=None, **given):
    p = bt.params_frame(spark, [sets or {**reg.WIDE, "strategy_type": "whale_quality"}])
    return bt.run(trade(spark, **given), p).collect()


@pytest.mark.parametrize(
    "ret,mae,reason,gain",
    [(0.5, -0.15, "stop_hit", -0.15), (0.3, -0.1, "profit_hit", 0.25), (-0.2, -0.1, "stop_hit", -0.15), (0.05, 0.0, "hold_to_horizon", 0.05 - 2.2 / 100000)],
)
def test_exits(spark, ret, mae, reason, gain):
    (r,) = result(spark, observed_return=ret, max_adverse_return=mae)
    assert r.exit_reason == reason and r.trade_return == pytest.approx(gain - 0.01)
    assert r.planned_pnl == pytest.approx(r.position_usd * r.trade_return)


def test_hold_is_floored(spark):
    sets = {**reg.WIDE, "strategy_type": "_legacy_quantile_confidence", "hard_stop_loss": 0.9, "max_risk_pct_per_trade": 1.0}
    (r,) = result(spark, sets, observed_return=-0.8, p_success=0.95)
    assert r.trade_return == pytest.approx(-0.51)


@pytest.mark.parametrize("dte,days,fired", [(1, 1, True), (2, 1, True), (5, 3, True), (12, 10, False), (30, 10, False)])
def test_time_stop(spark, dte, days, fired):
    sets = {**reg.WIDE, "strategy_type": "_legacy_quantile_confidence", "min_dte": 0}
    (r,) = result(spark, sets, dte=dte, max_adverse_return=-0.1, observed_return=0.2)
    assert r.time_stopped is fired and (r.left_date - r.trade_date).days == days
    if fired:
        assert r.realised_pnl == pytest.approx(r.position_usd * (-0.15 * 0.25 - 0.01))
    assert r.planned_pnl == pytest.approx(r.position_usd * (0.2 - 2.2 / 100000 - 0.01))


def test_rules(spark):
    assert result(spark, open_interest=None) == []
    assert result(spark, is_synthetic=0) != []
    tier = trade(spark).select(F.lit("B").alias("ticker"))
    p = bt.params_frame(spark, [{**reg.WIDE, "strategy_type": "whale_quality"}])
    assert bt.run(trade(spark, is_synthetic=0), p, tier).count() == 0 and bt.run(trade(spark), p, tier).count() == 1
    contrarian = {**reg.WIDE, "strategy_type": "contrarian_trend"}
    assert result(spark, contrarian, trend_alignment="BULL_ALIGNED") == []
    assert result(spark, contrarian, trend_alignment="BULL_ALIGNED", option_type="Put") != []
    regime = {**reg.WIDE, "strategy_type": "vol_regime", "max_quantile_spread": 0.1}
    assert result(spark, regime, implied_vol=None) == [] and result(spark, regime, implied_vol=20.0) != []


def equity(spark, values, capital=100.0):
    rows = [(0, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), capital, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id long, date date, initial_capital double, equity double")


def test_risk_metrics_edges(spark):
    one = bt.risk_metrics(equity(spark, [100])).first()
    assert (one.sharpe, one.sortino, one.active_days) == (0.0, 0.0, 0)
    flat = bt.risk_metrics(equity(spark, [100] * 5)).first()
    assert (flat.sharpe, flat.max_drawdown_pct) == (0.0, 0.0)
    up = bt.risk_metrics(equity(spark, [100, 101, 101, 103])).first()
    assert up.sharpe > 0 and up.sortino == pytest.approx(2 * up.sharpe) and up.active_days == 2
    assert bt.risk_metrics(equity(spark, [90, 95, 80])).first().max_drawdown_pct == pytest.approx(20.0)


def test_labels(spark):
    bars = spark.createDataFrame([("A", "2024-01-02", 110.0), ("A", "2024-01-09", 90.0), ("A", "2024-01-11", 104.0)], "ticker string, d string, close double")
    bars = bars.select("ticker", F.to_date("d").alias("bar_date"), "close")
    rows = [(1, "A", "Call", "BUY", "2024-01-01"), (2, "A", "Call", "MID", "2024-01-01"), (3, "B", "Put", "SELL", "2024-01-01"), (4, "A", "Put", "SELL", "2024-06-01")]
    t = spark.createDataFrame(rows, "id long, ticker string, option_type string, side string, d string").select(
        "id", "ticker", "option_type", "side", F.col("d").cast("timestamp").alias("ts"), F.to_date("d").alias("trade_date"),
        F.lit(100.0).alias("underlier_price"), F.lit(0).alias("is_synthetic"))
    got = {r.id: r for r in lb.label_trades(lb.unlabeled(t), bars, datetime.datetime(2024, 6, 5)).collect()}
    assert (got[1].observed_return, got[1].max_adverse_return, got[1].label_success) == (0.04, -0.1, 1)
    assert (got[2].observed_return, got[2].max_adverse_return, got[2].label_success) == (-0.04, -0.1, 0)
    assert not got[3].labeled and not got[4].labeled
    again = lb.relabel(lb.label_trades(lb.unlabeled(t), bars, datetime.datetime(2024, 6, 5)), 0.05)
    assert again.where("label_success = 1").count() == 0
    assert lb.reset_labels(again).where("labeled").count() == 0


def test_sweep_of_one_set_equals_single_run_and_equity_adds_up(spark, sf):
    pred = reg.predictions(spark, sf)
    many = {r.run_id: r for r in sw.sweep(pred, bt.params_frame(spark, reg.SETS)).collect()}
    alone = sw.sweep(pred, bt.params_frame(spark, [{**reg.SETS[4], "run_id": 4}])).first()
    assert alone.trades == many[4].trades > 0
    assert alone.pnl_pct == pytest.approx(many[4].pnl_pct) and alone.sharpe == pytest.approx(many[4].sharpe)
    p = bt.params_frame(spark, [reg.SETS[4]])
    book = bt.run(pred, p)
    end = bt.equity_curve(book, pred, p).orderBy(F.desc("date")).first()
    total = book.select(F.sum("realised_pnl").alias("s")).first().s
    assert end.equity == pytest.approx(100000.0 + total, abs=0.01)


def test_no_fold_trains_on_a_later_row(spark, sf):
    rows = reg.walk_rows(spark, sf)
    x = wf.with_available(rows, purge=True)
    assert x.where(F.col("avail") <= F.col("fold")).count() == 0
    starts = {r.fold: r.d for r in rows.where("fold >= 0").groupBy("fold").agg(F.min("trade_date").alias("d")).collect()}
    for r in x.select("avail", "evaluation_date").distinct().collect():
        assert all(r.evaluation_date < starts[k] for k in starts if k >= r.avail)
    with pytest.raises(Exception, match="too few rows"):
        wf.folds(rows.drop("idx", "fold").limit(10), 8, 8).count()


def test_param_grid_limits(spark):
    assert sw.param_grid(spark, (0.1, 0.5, 0.2), (0.5, 1.0, 0.5)).count() == 6
    with pytest.raises(ValueError):
        sw.param_grid(spark, (0.1, 1.0, 0.1), (0.5, 2.5, 0.5))


def test_score_and_winner(spark):
    rows = [(0, "s", 10, 5.0, 1.0, 10.0, 60.0), (1, "s", 50, -3.0, 1.0, 10.0, 40.0), (2, "s", 100, 20.0, 1.0, 25.0, 55.0)]
    df = spark.createDataFrame(rows, "run_id long, strategy_type string, trades long, pnl_pct double, sharpe double, max_drawdown_pct double, win_rate_pct double")
    s = {r.run_id: r.score for r in sw.sweep_score(df).collect()}
    assert s[0] == -90 and s[1] == pytest.approx(-50.3)
    assert s[2] == pytest.approx(0.5 * 40 + 0.25 * 40 + 0.15 * 50 + 0.1 * 55 - 15)
    assert sw.sweep_winner(sw.sweep_score(df)).first().run_id == 2


def counts(spark, rows):
    return spark.createDataFrame([("f", *r) for r in rows], "feature string, level string, s long, r long")


def test_chi2(spark):
    same = va.chi2_of_counts(counts(spark, [("a", 10, 20), ("b", 10, 20)])).first()
    assert same.chi2 == 0 and same.p_value == 1
    two = va.chi2_of_counts(counts(spark, [("a", 30, 10), ("b", 10, 30)])).first()
    assert two.chi2 == pytest.approx(18.05) and two.p_value == pytest.approx(2.152e-5, rel=0.02)
    three = va.chi2_of_counts(counts(spark, [("a", 30, 10), ("b", 10, 30), ("c", 20, 20)])).first()
    assert three.chi2 == pytest.approx(20.0) and three.p_value == pytest.approx(4.54e-5, rel=1e-3)
    four = va.chi2_of_counts(counts(spark, [("a", 30, 20), ("b", 20, 30), ("c", 25, 25), ("d", 25, 25)])).first()
    assert four.p_value == pytest.approx(0.261464, abs=1e-5)
    assert va.chi2_of_counts(counts(spark, [("a", 3, 4)])).first().chi2 is None
    assert va.chi2_of_counts(counts(spark, [("a", 3, 0), ("b", 4, 0)])).first().chi2 is None


def test_ks(spark):
    def d(syn, real):
        rows = [(1, float(v)) for v in syn] + [(0, float(v)) for v in real]
        df = spark.createDataFrame(rows, "is_synthetic int, v double").withColumn("labeled", F.lit(True))
        return va.ks(df, ["v"], []).first()

    assert d(range(50), range(50)).d == 0 and d(range(50), range(100, 150)).d == 1
    assert d([1, 2, 3, 4], [2.5, 10, 11, 12]).d == pytest.approx(0.75)
    assert d([1, 2], []).d is None


def test_sizes_are_computed_once(spark):
    p = bt.params_frame(spark, [{**reg.WIDE, "strategy_type": "whale_quality"}, {**reg.WIDE, "strategy_type": "whale_quality", "min_kelly_fraction": 0.9}])
    pairs = bt.params_cross(trade(spark), p)
    sized = bt.size(pairs)
    assert [r.p.run_id for r in sized.collect()] == [0]
    assert sized.columns == [*pairs.columns, "stop", "kelly_fraction", "position_usd"]
    plan = sized._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".kelly_multiplier)") == 1
