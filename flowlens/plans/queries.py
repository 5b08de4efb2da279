"""The registered queries: every operator applied to the whole test tables.

Dates and times leave as text and computed doubles rounded to six decimals, so that any
engine can be compared with them.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions import pricing as px, quotes as q, signals as sg
from flowlens.operators import audit, backtest as bt, boosting as bo, features as ft, fine, intervals as iv, joins, labels as lb, model as md
from flowlens.operators import paths, scan as sc, sweep as sw, validate as va, vol, walkforward as wf
from flowlens.operators.scale import materialize
from flowlens.session import ROCKSDB, scratch_path
from flowlens.sources import adapters as ad, store, tables as tb
from flowlens.streaming import flow as st, settle

AS_OF = datetime.datetime(2001, 6, 30)
EARLY = datetime.datetime(1996, 1, 1)
TIES = ["ticker", "snapshot_date", "expiration", "strike", "option_type", "k1", "k2", "k3"]
QUOTE_ORDER = ["k1", "k2", "k3"]
KEYS = ["k1", "k2", "k3"]
TICKERS = [f"T0{i}" for i in range(10)]
FOLD_ROWS = 500
LEAST_RATIO = 8.0

WIDE = {
    "prob_threshold": 0.40, "profit_threshold": 0.25, "hard_stop_loss": 0.15, "max_quantile_spread": 1.0,
    "min_median_return": -0.05, "vol_oi_floor": 1.0, "kelly_multiplier": 0.8, "kelly_cap": 0.2,
}
GRID_KELLY, GRID_STOP = (0.4, 0.8, 0.4), (0.5, 1.0, 0.5)
# wide stops, held to the horizon: the runs that end with a profit on the test data
PATIENT = {**WIDE, "slippage_pct": 0.0, "profit_threshold": 2.0, "hard_stop_loss": 0.6, "min_dte": 20}
PATIENT_RUNS = (("whale_quality", 0.5), ("contrarian_trend", 0.42), ("_legacy_quantile_confidence", 0.5))
SETS = [
    {**WIDE, "strategy_type": "whale_quality"},
    {**WIDE, "strategy_type": "contrarian_trend"},
    {**WIDE, "strategy_type": "vol_regime", "prob_threshold": 0.42},
    {**WIDE, "strategy_type": "_legacy_quantile_confidence", "min_open_interest": 0},
    {**WIDE, "strategy_type": "_legacy_trend_breakout"},
    {**WIDE, "strategy_type": "_legacy_iv_regime_adaptive", "hard_stop_loss": 15.0, "prob_threshold": 0.45},
    *[
        {**WIDE, "strategy_type": "whale_quality", "hard_stop_loss": 0.0, "kelly_multiplier": k, "stop_lambda": s}
        for k in (0.4, 0.8) for s in (0.5, 1.0)
    ],
    *[{**PATIENT, "strategy_type": t, "prob_threshold": p} for t, p in PATIENT_RUNS],
]
GRID_RUNS = (6, 9)


# ---- shared inputs -------------------------------------------------------------------


def day(name: str | Column, alias: str | None = None) -> Column:
    return q.c(name).cast("date").cast("string").alias(alias or name)


def moment(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def r6(e: Column | str, alias: str | None = None) -> Column:
    return F.round(q.c(e), 6).alias(alias or e)


def r4(e: Column | str, alias: str | None = None) -> Column:
    return F.round(q.c(e), 4).alias(alias or e)


def flag(e: Column | str, alias: str | None = None) -> Column:
    return q.tri_state(e).alias(alias or e)


def quantile_cols(name: str = "q") -> list[Column]:
    return [r6(F.col(name)[i], f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))]


def bars(s: SparkSession, d: str) -> DataFrame:
    return ad.bars(s, d)


def chain(s: SparkSession, d: str) -> DataFrame:
    return ad.chain(s, d)


def trades(s: SparkSession, d: str) -> DataFrame:
    return lb.unlabeled(ad.trades(s, d))


def labeled(s: SparkSession, d: str) -> DataFrame:
    return lb.label_trades(trades(s, d), bars(s, d), AS_OF)


def featured(s: SparkSession, d: str) -> DataFrame:
    return ft.training_filter(ft.row_features(labeled(s, d)))


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = md.split(featured(s, d))
    return x.where(~F.col("is_test")), x.where("is_test")


def scored(s: SparkSession, d: str) -> DataFrame:
    """Test rows scored with the model of the training rows."""
    train, test = halves(s, d)
    return md.score(test, md.fit_cells(train)).withColumn("q", sg.monotonic("q"))


def with_hv(s: SparkSession, d: str) -> DataFrame:
    return joins.join_ticker_vol(scored(s, d), vol.hist_vol(bars(s, d)))


def ratioed(s: SparkSession, d: str) -> DataFrame:
    return sc.with_ratio(sc.offhours_volume(sc.coerce_numeric(chain(s, d))))


def flow(s: SparkSession, d: str, floor: float = 8.0) -> DataFrame:
    b = bars(s, d)
    return sc.scan(chain(s, d), b, vol.sma_flags(b), floor, QUOTE_ORDER)


def walk_rows(s: SparkSession, d: str) -> DataFrame:
    rows = ft.row_features(labeled(s, d)).where("labeled")
    return wf.folds(rows, FOLD_ROWS, FOLD_ROWS)


def predictions(s: SparkSession, d: str) -> DataFrame:
    return materialize(wf.walkforward_predict(walk_rows(s, d)))


def params(s: SparkSession) -> DataFrame:
    return bt.params_frame(s, SETS)


def book(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and the ledger of all parameter sets."""
    p = predictions(s, d)
    return p, bt.run(p, params(s), lb.tier_a(labeled(s, d)))


def sized(s: SparkSession, d: str) -> DataFrame:
    x = bt.candidates(bt.with_tier(predictions(s, d), lb.tier_a(labeled(s, d))), params(s))
    return bt.size(bt.liquidity(bt.eligible(bt.params_cross(x, params(s)))))


def swept(s: SparkSession, d: str) -> DataFrame:
    return sw.sweep(predictions(s, d), params(s), lb.tier_a(labeled(s, d)))


def contracts(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    return paths.entry_cost(paths.contract_grid(paths.priced_bars(b, ad.vix(b)), (7, 30)))


# ---- sources -------------------------------------------------------------------------

QUOTE_COLS = ["ticker", "strike", "option_type", "volume", "open_interest", *KEYS]


def load_chain(s, d):
    c = chain(s, d)
    calls, puts = (c.where(F.col("option_type") == t).drop("option_type") for t in ("Call", "Put"))
    x = tb.union_sides(calls, puts.drop("last_trade_ts"))
    return x.select(
        *QUOTE_COLS, day("snapshot_date"), day("expiration"), "last_price", "bid", "ask", r6("implied_vol"),
        F.coalesce(F.date_format("last_trade_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("last_trade_ts"),
    )


def load_bars(s, d):
    return tb.complete_bars(bars(s, d)).select("ticker", day("bar_date"), "open", "high", "low", "close", "volume")


def select_expirations(s, d):
    x = tb.select_expirations(chain(s, d))
    return x.groupBy(day("snapshot_date"), "ticker", day("expiration")).agg(F.count(F.lit(1)).alias("n"))


TRADE_COLS = ["id", "ticker", "strike", "option_type", "side", "vol_oi_ratio", "underlier_price"]


def scan_trades(s, d):
    return tb.scan_trades(trades(s, d), synthetic=True, option_type="Call").select(*TRADE_COLS, moment("ts"))


def page_trades(s, d):
    return tb.page_trades(labeled(s, d), ticker="t03", labeled=True, limit=50, offset=25).select(*TRADE_COLS, moment("ts"))


def append_trades(s, d):
    path = scratch_path(s, "trades")
    tb.append_trades(trades(s, d), path, "trade_month")
    t = s.read.parquet(path)
    return t.select("id", "ticker", moment("ts"), day("trade_month"), "ensemble_id", flag("labeled"), "is_synthetic")


def append_new_trades(s, d):
    t = trades(s, d)
    return tb.append_new(t, t.where(F.col("is_synthetic") == 1)).select(*TRADE_COLS, moment("ts"))


def sanitize_floats(s, d):
    t = trades(s, d)
    odd = F.when(F.col("open_interest") == 0, F.lit(float("nan"))).when(F.col("volume") < 50, F.lit(float("inf")))
    x = t.select("id", odd.otherwise(F.col("vol_oi_ratio")).alias("vol_oi_ratio"), "premium")
    return tb.sanitize(x).select("id", F.coalesce("vol_oi_ratio", F.lit(-1.0)).alias("vol_oi_ratio"), "premium")


def model_runs_latest(s, d):
    """One run per calendar year of training rows, logged and read back."""
    t = featured(s, d)
    runs = t.groupBy(F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("samples_count"), F.max("ts").alias("run_ts"), F.avg("observed_return").alias("mean_return")
    ).withColumn("model_version", F.concat(F.lit("cells-"), F.col("year").cast("string")))
    path = scratch_path(s, "model-runs")
    tb.log_runs(runs, path)
    return tb.latest_runs(s.read.parquet(path), 5).select("model_version", "samples_count", moment("run_ts"), r6("mean_return"))


# ---- scan ----------------------------------------------------------------------------


def coerce_numeric(s, d):
    text = chain(s, d).withColumn("volume", F.when(F.col("volume") == 13, "n/a").otherwise(F.col("volume").cast("string")))
    text = text.withColumn("open_interest", F.when(F.col("open_interest") > 0, F.col("open_interest")))
    return sc.coerce_numeric(text).select(*QUOTE_COLS, day("snapshot_date"), r6("implied_vol"))


def offhours_volume(s, d):
    """One ticker's volume is set to zero first, so that the fallback takes effect."""
    c = chain(s, d).withColumn("volume", F.when(F.col("ticker") == "T04", 0).otherwise(F.col("volume")))
    return sc.offhours_volume(c).select(*QUOTE_COLS, day("snapshot_date"))


def vol_oi_ratio(s, d):
    return ratioed(s, d).select(*QUOTE_COLS, day("snapshot_date"), "vol_oi_ratio")


def min_ratio_filter(s, d):
    return sc.unusual(ratioed(s, d), 2.0).select(*QUOTE_COLS, day("snapshot_date"), "vol_oi_ratio")


def infer_side(s, d):
    return chain(s, d).select(*KEYS, "last_price", "bid", "ask", q.infer_side().alias("side"))


def dte(s, d):
    c = chain(s, d).withColumn("expiration", F.when(F.col("open_interest") == 0, "unknown").otherwise(F.col("expiration").cast("string")))
    return c.select(*KEYS, day("snapshot_date"), q.days_to_expiry().alias("dte"))


def is_weekly(s, d):
    shifted = F.date_add("expiration", (F.col("strike") % 7).cast("int"))
    return chain(s, d).select(*KEYS, day(shifted, "expiration"), q.is_weekly(shifted).cast("int").alias("is_weekly"))


def notional_premium(s, d):
    last = F.when(F.col("open_interest") > 0, F.col("last_price"))
    return chain(s, d).select(*KEYS, "volume", q.notional("volume", last).alias("premium"))


def trade_time_ny(s, d):
    return chain(s, d).select(*KEYS, q.new_york_time().alias("trade_time_ny"))


def trend_simple(s, d):
    return vol.sma_flags(bars(s, d)).select("ticker", flag("above50"), flag("above200"), q.trend_simple().alias("trend"))


def trend_contextual(s, d):
    f = flow(s, d, 2.0)
    return f.select(*KEYS, "ticker", "option_type", flag("above50"), flag("above200"), "trend_alignment")


def whale_flag(s, d):
    return ratioed(s, d).select(
        *KEYS, "vol_oi_ratio", q.is_whale().cast("int").alias("is_whale"), q.log_ratio().alias("log_ratio"),
        q.log_ratio(F.col("vol_oi_ratio") * 2000, True).alias("log_ratio_tamed"),
    )


def expected_move_bounds(s, d):
    x = flow(s, d, 2.0)
    return x.select(*KEYS, "underlier_price", "expected_move", "expected_move_upper", "expected_move_lower")


def table_filters(s, d):
    x = sc.quote_columns(ratioed(s, d)).withColumn("open_interest", F.when(F.col("open_interest") > 2, F.col("open_interest")))
    x = sc.table_filters(x, True, 14, 500.0, 5, True, ("T00", "T07"))
    return x.select(*KEYS, "ticker", "dte", "premium", F.coalesce("open_interest", F.lit(-1.0)).alias("open_interest"))


def ledger_filters(s, d):
    _, x = book(s, d)
    return sc.ledger_filters(x, " t0", "hold_to_horizon").select("run_id", "id", "ticker", "exit_reason")


# ---- joins ---------------------------------------------------------------------------


def join_ticker_vol(s, d):
    hv = vol.hist_vol(bars(s, d)).where(F.col("ticker") != "T05")
    return joins.join_ticker_vol(trades(s, d), hv).select("id", "ticker", r6("hv"), r6("iv_hv_ratio"))


def label_range_join(s, d):
    x = joins.label_range_join(trades(s, d), bars(s, d))
    return x.select("id", day("bar_date"), "close")


def join_vix_on_date(s, d):
    return joins.join_vix(trades(s, d), ad.vix(bars(s, d))).select("id", day("trade_date"), r6("vix"))


def next_event_join(s, d):
    cal = ad.calendar(bars(s, d))
    t = joins.days_to_event(trades(s, d), cal, "EARNINGS", 3, "earnings")
    t = joins.days_to_event(t, cal, "FOMC", 1, "fomc", per_ticker=False)
    return t.select("id", "days_to_earnings", "near_earnings", "days_to_fomc", "near_fomc")


def asof_price(s, d):
    x = joins.asof_price(chain(s, d), bars(s, d), "snapshot_date")
    return x.select(*KEYS, "ticker", day("snapshot_date"), F.coalesce("spot", F.lit(0.0)).alias("spot"))


def atm_pair_join(s, d):
    x = sc.atm_pairs(chain(s, d), QUOTE_ORDER)
    return x.select("ticker", day("snapshot_date"), day("expiration"), "strike", "call_bid", "call_ask", "put_bid", "put_ask")


def _ticks(s, d, *kinds: str) -> DataFrame:
    """Events as intraday prints of ten tickers."""
    e = ad._read(s, d, "events").where(F.col("event_type").isin(*kinds))
    return e.select("event_id", F.concat(F.lit("T0"), (F.col("user_id") % 10).cast("string")).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value")


def asof_tick(s, d):
    quotes = _ticks(s, d, "view", "click", "error").select("ticker", "ts", F.col("value").alias("quote"), F.col("event_id").alias("quote_id"))
    x = iv.asof_tick(_ticks(s, d, "purchase", "signup"), quotes, ["ticker"], "ts", ["quote", "quote_id"])
    return x.select("event_id", "ticker", F.coalesce("quote", F.lit(-1.0)).alias("quote"), F.coalesce("quote_id", F.lit(-1)).alias("quote_id"))


#: Interval lengths from a second to a year.
SPANS = (1, 600, 21_600, 259_200, 2_592_000, 31_536_000)


def interval_join(s, d):
    """Prints inside intervals of very different lengths, summed up per interval."""
    span = F.element_at(F.array(*[F.lit(x) for x in SPANS]), (F.col("event_id") % len(SPANS) + 1).cast("int"))
    held = _ticks(s, d, "signup").select(F.col("event_id").alias("interval_id"), "ticker", F.col("ts").alias("from_ts"), F.timestamp_add("SECOND", span, F.col("ts")).alias("to_ts"))
    totals = {"n": ("count", "*"), "total": ("sum", "value"), "least": ("min", "event_id")}
    x = iv.interval_join(_ticks(s, d, "purchase", "view"), held, ["ticker"], "ts", "from_ts", "to_ts", totals=totals)
    return x.groupBy("interval_id", "ticker").agg(F.sum("n").alias("n"), r6(F.sum("total"), "total"), F.min("least").alias("least"))


def universe_semi(s, d):
    t = labeled(s, d)
    return joins.in_universe(t, lb.tier_a(t, 0.10, 10, 0.27)).select("id", "ticker")


def params_cross(s, d):
    """Rows and volume every run of the grid would look at."""
    grid = sw.param_grid(s, GRID_KELLY, GRID_STOP, ["whale_quality", "vol_regime"])
    x = bt.params_cross(trades(s, d), grid)
    return x.groupBy("p.run_id", "p.strategy_type", "p.kelly_multiplier", "p.stop_lambda").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")
    )


# ---- aggregations --------------------------------------------------------------------

SUMMARY_COLS = ["avg_vol_oi", "max_vol_oi", "call_volume", "put_volume", "put_call_ratio", "whale_count"]


def scan_summary(s, d):
    x = sc.unusual(ratioed(s, d), 2.0)
    return sc.scan_summary(x, ["snapshot_date"]).select(day("snapshot_date"), *SUMMARY_COLS)


def pcr_by_expiration(s, d):
    return sc.pcr_by_expiration(chain(s, d)).select("ticker", day("snapshot_date"), day("expiration"), "put_call_ratio")


def pcr_pivot(s, d):
    x = sc.pcr_pivot(sc.pcr_by_expiration(chain(s, d)), TICKERS)
    return x.select(day("snapshot_date"), day("expiration"), *[F.coalesce(t, F.lit(-1.0)).alias(t.lower()) for t in TICKERS])


def volume_concentration(s, d):
    x = sc.volume_concentration(chain(s, d))
    return x.select("ticker", day("snapshot_date"), day("expiration"), "call_volume", "put_volume", "total_volume")


def trade_stats(s, d):
    return lb.trade_stats(labeled(s, d))


def dataset_span(s, d):
    return lb.dataset_span(trades(s, d)).select(day("data_start"), day("data_end"), "data_count", "data_span_days")


def tier_a_universe(s, d):
    return lb.tier_a(labeled(s, d), 0.10, 10, 0.27).select("ticker", r6("win_rate"), "n")


def ensemble_counts(s, d):
    return lb.ensemble_counts(trades(s, d))


def live_summary(s, d):
    x = md.derived_signals(with_hv(s, d))
    return sc.live_summary(x.withColumn("p_success", F.round("p_success", 6))).select("n", r6("avg_p"), "top_id", "top_ticker", "top_p")


# ---- windows and volatility ----------------------------------------------------------


def sma_flags(s, d):
    return vol.sma_flags(bars(s, d)).select("ticker", flag("above50"), flag("above200"))


def technicals(s, d):
    x = vol.technicals(bars(s, d))
    return x.select("ticker", "price", "sma50", F.coalesce("sma200", F.lit(-1.0)).alias("sma200"), flag("above50"), flag("above200"), "trend")


def iv_rank(s, d):
    return vol.iv_rank(bars(s, d))


def hist_vol(s, d):
    b = bars(s, d)
    pop = vol.hist_vol(b, mode="pop").select("ticker", r6("hv", "hv_pop"))
    return vol.hist_vol(b).select("ticker", r6("hv")).join(pop, "ticker")


def latest_vix(s, d):
    return vol.latest_vix(ad.vix(bars(s, d))).select(r6("vix"))


def _hourly(s, d) -> DataFrame:
    """Hourly bars of the intraday prints."""
    x = _ticks(s, d, "view", "click", "error", "purchase", "signup").withColumn("hour", F.date_trunc("hour", "ts"))
    first = [F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max_by("value", F.struct("ts", "event_id")).alias("close")]
    return x.groupBy("ticker", "hour").agg(*first, F.max("value").alias("high"), F.min("value").alias("low"))


def garman_klass_fine(s, d):
    return fine.garman_klass(_hourly(s, d), "hour", block=5000).select("ticker", moment("hour"), r6("gk_vol"))


def sma_flags_fine(s, d):
    return fine.sma_flags(_hourly(s, d), "hour", "20 days", block=5000).select("ticker", flag("above50"), flag("above200"))


def garman_klass(s, d):
    return vol.garman_klass(bars(s, d)).select("ticker", day("bar_date"), r6("gk_vol"))


def trend_sma20_50(s, d):
    return vol.trend_sma(bars(s, d)).select("ticker", day("bar_date"), "trend")


def vix_regime(s, d):
    return ad.vix(bars(s, d)).select(day("vix_date"), r6("vix"), vol.vix_regime().alias("vix_regime"))


def market_regime(s, d):
    x = vol.market_regime(vol.garman_klass(bars(s, d)))
    return x.select("ticker", day("bar_date"), F.coalesce("market_regime", F.lit("none")).alias("market_regime"))


def first_per_ticker(s, d):
    x = sc.first_per_ticker(ratioed(s, d), 8, TIES[1:])
    return x.select("ticker", "vol_oi_ratio", "volume", "open_interest", *KEYS)


def row_slice(s, d):
    return tb.row_slice(trades(s, d), 500, 1200).select("id", "ticker", moment("ts"), "idx")


def lookback_filter(s, d):
    return tb.lookback(trades(s, d), 365).select("id", "ticker", moment("ts"))


# ---- option analytics ----------------------------------------------------------------


def iv_smile(s, d):
    return vol.iv_smile(chain(s, d)).select("ticker", day("snapshot_date"), day("expiration"), "strike", "option_type", "iv")


def smile_curve(s, d):
    return vol.smile_curve(vol.iv_smile(chain(s, d))).select("ticker", day("snapshot_date"), day("expiration"), "strike", "iv")


def expected_move(s, d):
    x = sc.expected_move(chain(s, d), bars(s, d), QUOTE_ORDER)
    return x.select(
        "ticker", day("snapshot_date"), F.coalesce("spot", F.lit(0.0)).alias("spot"),
        F.coalesce("atm_strike", F.lit(-1.0)).alias("atm_strike"), "expected_move",
    )


def priced(t: DataFrame) -> DataFrame:
    return t.withColumns({"years": F.col("dte") / px.lit(365), "sigma": F.col("implied_vol") / 100})


def bs_price(s, d):
    p = px.bs_price("option_type", "underlier_price", "strike", "years", "sigma")
    return priced(trades(s, d)).select("id", "option_type", "strike", r6(p, "price"))


def greeks(s, d):
    g = priced(trades(s, d)).select("id", px.greeks("option_type", "underlier_price", "strike", "years", "sigma").alias("g"))
    return g.select("id", *[r6(f"g.{n}", n) for n in ("delta", "gamma", "vega", "theta", "rho")])


def atm_iv_skew(s, d):
    b = bars(s, d)
    x = paths.contract_grid(paths.priced_bars(b, ad.vix(b)), (7, 30))
    x = x.withColumn("skew", px.skew_adjustment(F.log(F.try_divide("strike", "close")), "dte"))
    return x.select("ticker", day("bar_date"), "option_type", "mult", "dte", r6("skew"), r6(px.model_iv("gk_vol", "vix", "skew"), "iv"))


def contract_grid(s, d):
    return paths.contract_grid(bars(s, d), (7, 30)).select("ticker", day("bar_date"), "option_type", "mult", "dte", "strike")


CONTRACT = ["ticker", "option_type", "mult", "dte"]


def entry_cost(s, d):
    x = contracts(s, d)
    return x.select(
        *CONTRACT, day("bar_date"), "strike", "side", r6("premium"), r6("spread_pct"), r6("entry_price"), "commission", "early_exercise_risk"
    )


def mark_path(s, d):
    """All marked paths, summed up per bar, type and day ahead."""
    x = paths.mark_path(contracts(s, d)).groupBy("ticker", "bar_date", "option_type", "day")
    x = x.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"), *[getattr(F, f)("pnl").alias(f"{f}_pnl") for f in ("min", "max", "avg")])
    return x.select("ticker", day("bar_date"), "option_type", "day", "n", *[r6(c) for c in ("avg_value", "min_pnl", "max_pnl", "avg_pnl")])


def path_outcome(s, d):
    x = paths.path_outcome(paths.mark_path(contracts(s, d)))
    return x.select(
        *CONTRACT, day("bar_date"), r6("observed_return"), r6("max_adverse_return"), "label_success", r4("delta_hedged_return"),
        *[r6(f"{g}_exit") for g in ("delta", "gamma", "vega", "theta", "rho")],
    )


# ---- features and labels -------------------------------------------------------------


def features(s, d):
    b = bars(s, d)
    x = ft.features(trades(s, d), b, ad.vix(b))
    return x.select("id", "dte_bucket", *[r6(n) for n in ("moneyness", "iv_hv_ratio", "vix_level", "log_premium")])


def training_filter(s, d):
    return ft.training_filter(labeled(s, d), True).select("id", "observed_return")


def impute_encode(s, d):
    train, test = halves(s, d)
    b = bars(s, d)
    train, test = (ft.features(x, b, ad.vix(b)) for x in (train, test))
    x = ft.encode(test, ft.impute_encode(train))
    return x.select("id", F.col("features").cast("string").alias("features"))


def impute_fills(s, d):
    """The fitted medians and modes of the training rows."""
    b = bars(s, d)
    fills, _ = ft.impute_encode(ft.features(halves(s, d)[0], b, ad.vix(b)))
    rows = [(c, None if fills[c] is None else float(fills[c]), "") for c in ft.NUMERIC] + [(c, None, fills[c]) for c in ft.CATEGORICAL]
    x = s.createDataFrame(rows, "feature string, median double, mode string")
    return x.select("feature", F.coalesce(r6("median"), F.lit(-1.0)).alias("median"), F.coalesce("mode", F.lit("")).alias("mode"))


LABEL_COLS = ["label_success", "observed_return", "max_adverse_return"]


def label_cols() -> list[Column]:
    return [F.coalesce(F.col(n).cast("double"), F.lit(-9.0)).alias(n) for n in LABEL_COLS]


def label_trades(s, d):
    x = labeled(s, d)
    return x.select("id", flag("labeled"), *label_cols(), F.coalesce(F.col("evaluation_date").cast("string"), F.lit("")).alias("evaluation_date"))


def label_merge(s, d):
    """A store of unlabelled trades, labelled in place twice: up to an early date, then up to the last one."""
    path, b = scratch_path(s, "label-store"), materialize(bars(s, d))
    store.create(trades(s, d), path)
    store.merge_labels(s, path, b, EARLY)
    store.merge_labels(s, path, b, AS_OF)
    return store.stored(s, path).select("id", flag("labeled"), *label_cols(), F.coalesce(F.col("evaluation_date").cast("string"), F.lit("")).alias("evaluation_date"))


def append_indexed(s, d):
    """Two thirds of the trades, then all of them, loaded into one store through its key index."""
    path, x = scratch_path(s, "indexed-store"), materialize(trades(s, d))
    store.append_batch(s, path, x.where(F.col("id") % 3 != 0))
    store.append_batch(s, path, x)
    return store.stored(s, path).select("id", "ticker", moment("ts"), "strike", "option_type", "ensemble_id")


def relabel_on_read(s, d):
    return lb.relabel(labeled(s, d), 0.10).select("id", flag("labeled"), *label_cols())


def pending_labels(s, d):
    return lb.pending(labeled(s, d), AS_OF, force=True).select("id", moment("ts"), "is_synthetic")


def dedup_12h(s, d):
    e = ad._read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = lb.dedup_12h(e, ["user_id", "event_type"], id="event_id")
    return x.select("event_id", "user_id", "event_type", moment("ts"))


# ---- quantile model ------------------------------------------------------------------


def split_80_20(s, d):
    return md.split(featured(s, d)).select("id", F.col("is_test").cast("int").alias("is_test"))


def fit_cell_quantiles(s, d):
    return md.fit_cells(halves(s, d)[0]).select("cell", "n", *quantile_cols())


def fit_forest_quantiles(s, d):
    return _forest(s, d)[0].leaves.select("tree", "leaf", "n", *quantile_cols())


def _forest(s, d):
    b = bars(s, d)
    train, test = (ft.features(x, b, ad.vix(b)) for x in halves(s, d))
    return md.fit_forest(materialize(train), trees=5), test


def score_forest(s, d):
    forest, test = _forest(s, d)
    return md.score_forest(test, forest).select("id", *quantile_cols())


BOOSTED = ("strike", "volume", "open_interest", "vol_oi_ratio", "implied_vol", "underlier_price", "premium", "dte", "moneyness")


def boosted_histogram(s, d):
    """Gradient counts of all five quantiles by feature and bin, before the first split."""
    model, rows = bo.start_boosted(halves(s, d)[0], numeric=BOOSTED)
    return bo.root_histogram(rows, model)


def score_boosted(s, d):
    train, test = halves(s, d)
    return bo.score_boosted(test, bo.fit_boosted(train, numeric=BOOSTED)).select("id", *quantile_cols())


def feature_importance(s, d):
    forest, test = _forest(s, d)
    return md.importance(forest, test)


def score(s, d):
    return scored(s, d).select("id", "cell", *quantile_cols())


def monotonic_quantiles(s, d):
    raw = F.transform("q", lambda x, i: F.when(i == 1, x + F.col("observed_return")).otherwise(x))
    return scored(s, d).select("id", sg.monotonic(raw).alias("q")).select("id", *quantile_cols())


def monotonic_violations(s, d):
    raw = F.transform("q", lambda x, i: F.when(i == 1, x + F.col("observed_return")).otherwise(x))
    return md.violations(scored(s, d).withColumn("q", raw)).select("n", "violations", r6("share"))


def pinball_loss(s, d):
    return md.pinball_loss(scored(s, d)).select("quantile", r6("pinball_loss"))


def coverage(s, d):
    return md.coverage(scored(s, d)).select(r6("coverage_p10"), r6("coverage_p50"), r6("coverage_p90"))


METRIC_COLS = ["accuracy", "precision", "recall", "f1"]


def binary_metrics(s, d):
    """Train and test rows under the model of the training rows."""
    train, test = halves(s, d)
    x = md.score(train.unionByName(test), md.fit_cells(train))
    return md.binary_metrics(x, 0.0, ["is_test"]).select(F.col("is_test").cast("int").alias("is_test"), "n", *[r6(m) for m in METRIC_COLS])


def roc_auc(s, d):
    return md.roc_auc(scored(s, d)).select(r6("roc_auc"))


def stratified_cv(s, d):
    return md.cv_auc(featured(s, d)).select("fold", r6("roc_auc"))


def p_success(s, d):
    x = scored(s, d)
    return x.select("id", *[r6(sg.p_success("q", t), n) for t, n in ((0.025, "p_025"), (0.10, "p_100"), (-0.5, "p_low"), (0.6, "p_high"))],
                    r6(sg.p_success("q", F.col("q")[4]), "p_at_p90"))


def classify_regime(s, d):
    regime, confidence = sg.classify_regime("q", F.col("hv") / 3)
    return with_hv(s, d).select("id", regime.alias("regime"), confidence.alias("confidence"))


def kelly_quantile(s, d):
    capped, raw = sg.kelly_quantile("q", sg.p_success("q", 0.025))
    return scored(s, d).select("id", r6(capped, "kelly"), r6(raw, "kelly_raw"))


def heuristic_score(s, d):
    flat = sg.flat_quantiles()
    x = trades(s, d).withColumn("q", flat)
    return x.select("id", r6(sg.heuristic_score(), "score"), r6(sg.open_trade_score(), "score_open"), *quantile_cols(), r6(sg.p_success("q", 0.03), "p_success"))


def gaussian_signal(s, d):
    x = scored(s, d).withColumn("g", sg.gaussian_signal(profit=0.05, spread_cap=0.26, p_floor=0.4))
    return x.select("id", r6("g.p_success", "p_success"), r6("g.kelly", "kelly"), F.col("g.strategy").alias("strategy"))


def open_signals(s, d):
    """Unlabelled trades are the open flow, scored with the model of the labelled ones."""
    cells = md.fit_cells(featured(s, d))
    live = joins.join_ticker_vol(ft.row_features(labeled(s, d).where(~F.col("labeled"))), vol.hist_vol(bars(s, d)))
    x = md.open_signals(live, cells, 0.40, 0.01)
    return x.select("id", "ticker", *quantile_cols(), r6("p_success"), r6("kelly_fraction"), "regime")


# ---- walk-forward and backtest -------------------------------------------------------


def walkforward_folds(s, d):
    return wf.fold_bounds(walk_rows(s, d)).select("fold", "train_rows", "test_rows", moment("first_ts"), moment("last_ts"))


def walkforward_predict(s, d):
    x = wf.walkforward_predict(walk_rows(s, d))
    return x.select("id", "fold", *quantile_cols(), r6("p_success"))


def walkforward_purged(s, d):
    x = wf.walkforward_predict(walk_rows(s, d), purge=True)
    return x.select("id", "fold", *quantile_cols(), r6("p_success"))


def walkforward_sketch(s, d):
    x = wf.walkforward_predict(walk_rows(s, d), method="sketch")
    return x.select("id", "fold", *quantile_cols(), r6("p_success"))


def walkforward_tree(s, d):
    """Walk-forward whose cells are the leaves of a tree grown on the rows before the first fold."""
    rows = walk_rows(s, d)
    model = bo.fit_boosted(rows.where("fold = -1"), numeric=BOOSTED, rounds=1)
    x = wf.walkforward_predict(bo.with_leaf(rows, model), keys=["leaf"])
    return x.select("id", "fold", "leaf", *quantile_cols(), r6("p_success"))


def in_sample_predict(s, d):
    x = featured(s, d)
    x = wf.in_sample_predict(x, md.fit_cells(x), confirm=True)
    return x.select("id", *quantile_cols(), r6("p_success"), F.col("in_sample").cast("int").alias("in_sample"))


def _eligible(*names):
    def query(s, d):
        sets = bt.params_frame(s, [x for x in SETS if x["strategy_type"] in names])
        x = bt.candidates(bt.with_tier(predictions(s, d), lb.tier_a(labeled(s, d), 0.10, 10, 0.27)), sets)
        x = bt.eligible(bt.params_cross(x, sets))
        return x.select("p.run_id", "p.strategy_type", "id")

    return query


def liquidity_filter(s, d):
    x = bt.liquidity(bt.params_cross(predictions(s, d), params(s)))
    return x.groupBy("p.run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


def position_size(s, d):
    return sized(s, d).select("p.run_id", "id", r6("stop"), r6("kelly_fraction"), r4("position_usd"))


def exit_rules(s, d):
    return bt.exits(sized(s, d)).select("p.run_id", "id", "exit_reason", r6("trade_return"))


def time_stop(s, d):
    x = bt.time_stop(bt.exits(sized(s, d)))
    return x.select("p.run_id", "id", day("exit_date"), day("left_date"), F.col("time_stopped").cast("int").alias("time_stopped"), r6("booked_return"))


def ledger(s, d):
    _, x = book(s, d)
    return x.select(
        "run_id", "strategy_type", "id", day("trade_date"), day("exit_date"), "contract", r6("p_success"), r4("position_usd"),
        "exit_reason", r4("planned_pnl"), r4("realised_pnl"),
    )


def equity(s, d) -> DataFrame:
    p, x = book(s, d)
    return bt.equity_curve(x, p, params(s))


def equity_curve(s, d):
    return equity(s, d).select("run_id", day("date"), "equity")


def drawdown(s, d):
    return bt.drawdown(equity(s, d)).select("run_id", day("date"), "peak", r6("drawdown_pct"))


def risk_metrics(s, d):
    x = bt.risk_metrics(equity(s, d))
    return x.select("run_id", r6("sharpe"), r6("sortino"), r6("max_drawdown_pct"), "active_days")


def trade_metrics(s, d):
    _, x = book(s, d)
    x = bt.trade_metrics(x, params(s))
    return x.select("run_id", "strategy_type", "trades", r6("win_rate_pct"), r6("win_loss_ratio"), r6("profit_factor"))


def open_positions(s, d):
    _, x = book(s, d)
    return bt.open_positions(x).select("run_id", day("date"), "open_positions")


def live_eligibility(s, d):
    x = md.derived_signals(with_hv(s, d))
    return bt.live_eligible(x, params(s)).select("run_id", "strategy_type", "id", r6("p_success"))


SWEEP_COLS = [
    "sharpe", "sortino", "max_drawdown_pct", "win_rate_pct", "win_loss_ratio", "profit_factor", "pnl_pct", "cagr_pct",
]


def sweep(s, d):
    return swept(s, d).select("run_id", "strategy_type", "trades", *[r6(c) for c in SWEEP_COLS])


def sweep_score(s, d):
    return sw.sweep_score(swept(s, d)).select("run_id", "strategy_type", r6("score"))


def sweep_winner(s, d):
    return sw.sweep_winner(sw.sweep_score(swept(s, d))).select("strategy_type", "run_id", "tier", r6("score"))


def sweep_heatmap(s, d):
    grid = materialize(swept(s, d)).where(F.col("run_id").between(*GRID_RUNS)).withColumn("sharpe", F.round("sharpe", 6))
    return sw.sweep_heatmap(grid, params(s), "sharpe", [0.5, 1.0])


def profitability_report(s, d):
    x = sw.profitable(swept(s, d))
    return x.select("run_id", "strategy_type", "trades", r6("pnl_pct"), F.col("legacy").cast("int").alias("legacy"))


# ---- audit and validation ------------------------------------------------------------


def audit_overview(s, d):
    return audit.audit_overview(labeled(s, d)).select("is_synthetic", "n", moment("first_ts"), moment("last_ts"), "tickers")


def audit_by_ticker(s, d):
    x = audit.audit_by_ticker(labeled(s, d))
    six = ("ratio_p50", "ratio_p99", "ratio_max", "iv_p50", "iv_p99", "success_pct", "buy_pct", "sell_pct")
    return x.select("ticker", "n", moment("first_ts"), moment("last_ts"), *[r6(c) for c in six])


def feature_distribution(s, d):
    x = audit.feature_distribution(labeled(s, d))
    names = ("min", "p10", "p25", "p50", "p75", "p90", "p99", "max", "mean", "stdev")
    return x.select("feature", "is_synthetic", "count", *[r6(c) for c in names])


def categorical_distribution(s, d):
    x = audit.categorical_distribution(labeled(s, d))
    return x.select("feature", "level", "synthetic_n", r6("synthetic_pct"), "real_n", r6("real_pct"))


def label_summary(s, d):
    return audit.label_summary(labeled(s, d)).select("is_synthetic", "labeled", "unlabeled", "success", r6("success_pct"))


def balance(s, d):
    x = audit.balance(trades(s, d))
    return x.select("is_synthetic", "buys", "sells", "calls", "puts", r6("buy_pct"), r6("sell_pct"), r6("call_pct"))


def whale_crossing(s, d):
    x = audit.whale_crossing(trades(s, d))
    return x.select("threshold", "synthetic_n", r6("synthetic_pct"), "real_n", r6("real_pct"), F.col("warn").cast("int").alias("warn"))


def dte_histogram(s, d):
    known = F.when(F.col("open_interest") > 0, F.col("dte") * 2 - 10)
    return audit.dte_histogram(trades(s, d).withColumn("dte", known))


def contingency(s, d):
    x = audit.contingency(trades(s, d))
    return x.select(F.col("is_weekly").cast("int").alias("is_weekly"), "trend_alignment", "synthetic_n", "real_n")


def ks_two_sample(s, d):
    x = va.ks(labeled(s, d))
    return x.select("feature", "n_synthetic", "n_real", r6("d"), r6("p_value"), "divergence", F.col("passed").cast("int").alias("passed"))


def chi2_two_sample(s, d):
    x = va.chi2(labeled(s, d))
    return x.select("feature", "levels", "dof", r6("chi2"), r6("p_value"), F.col("passed").cast("int").alias("passed"))


def decile_compare(s, d):
    x = va.decile_compare(labeled(s, d), ("vol_oi_ratio", "premium"), ("observed_return",))
    return x.select("feature", "quantile", r6("synthetic"), r6("real"))


def label_rate_delta(s, d):
    x = va.label_rate_delta(labeled(s, d))
    return x.select(*[r6(c) for c in ("synthetic_rate", "real_rate", "delta", "chi2", "p_value")])


def validation_gate(s, d):
    t = labeled(s, d)
    return va.validation_gate(va.ks(t), va.chi2(t))


# ---- sorts and streams ---------------------------------------------------------------


def _unusual(s, d) -> DataFrame:
    near = sc.with_ratio(sc.offhours_volume(sc.coerce_numeric(tb.select_expirations(chain(s, d)))))
    return sc.quote_columns(sc.unusual(near, LEAST_RATIO))


def _top_columns(x: DataFrame) -> DataFrame:
    return x.select("ticker", day("snapshot_date"), day("expiration"), "strike", "option_type", "vol_oi_ratio", "premium", "side", *KEYS)


def topk_unusual(s, d):
    return _top_columns(sc.topk_unusual(_unusual(s, d), 100, TIES))


def sort_nulls_last(s, d):
    x = labeled(s, d).withColumn("observed_return", F.when(F.col("labeled"), F.col("observed_return")))
    x = sc.sort_any(x, "observed_return", True, ["id"])
    return x.select("id", F.coalesce("observed_return", F.lit(-9.0)).alias("observed_return"))


def _stream(s: SparkSession, d: str, table: str) -> DataFrame:
    schema = ad._read(s, d, table).schema
    return s.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d)


def stream_whale_log(s, d):
    """Orders read as a stream; ticker, type and side repeat often enough for the 12-hour rule."""
    path, checkpoint = scratch_path(s, "whale-log"), scratch_path(s, "whale-state")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # for sessions made elsewhere
    run = st.stream_whale_log(ad.raw_trades(_stream(s, d, "orders")), path, checkpoint, ("ticker", "option_type", "side"))
    run.awaitTermination()
    return s.read.parquet(path).select("id", "ticker", "option_type", "side", "vol_oi_ratio", moment("ts"))


def stream_scan_summary(s, d):
    """Summary per 30 days of the order stream, open windows included."""
    out, checkpoint = scratch_path(s, "summary"), scratch_path(s, "summary-state")
    x = st.stream_summary(ad.raw_trades(_stream(s, d, "orders")), "30 days", "1 day")
    st.write_summary(x, out, checkpoint).awaitTermination()
    return st.latest_summary(s, out).select(moment("window_start"), *SUMMARY_COLS)


def stream_topk(s, d):
    """The flow as a stream; the list is kept up to date batch by batch."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    table = materialize(_unusual(s, d).select("ticker", "snapshot_date", "expiration", "strike", "option_type", "vol_oi_ratio", "premium", "side", *KEYS))
    flow = s.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    path = scratch_path(s, "topk")
    st.stream_topk(flow, 100, TIES, path, scratch_path(s, "topk-state")).awaitTermination()
    return _top_columns(st.latest_topk(s, path, table.schema))


def stream_settle(s, d):
    """Trades and bars as streams; labels leave when the horizon of a trade has passed."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    tables = materialize(trades(s, d)), materialize(bars(s, d))
    streams = [s.readStream.schema(t.schema).parquet(t.inputFiles()[0].rsplit("/", 1)[0]) for t in tables]
    out, checkpoint = scratch_path(s, "settled"), scratch_path(s, "settle-state")
    x = settle.settle_stream(*streams)
    run = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(x.schema).parquet(out).select("id", flag("labeled"), *label_cols())


QUERIES = {
    f.__name__: f
    for f in (
        load_chain, load_bars, select_expirations, scan_trades, page_trades, append_trades, append_new_trades, sanitize_floats,
        model_runs_latest, coerce_numeric, offhours_volume, vol_oi_ratio, min_ratio_filter, infer_side, dte, is_weekly,
        notional_premium, trade_time_ny, trend_simple, trend_contextual, whale_flag, expected_move_bounds, table_filters,
        ledger_filters, join_ticker_vol, label_range_join, join_vix_on_date, next_event_join, asof_price, atm_pair_join,
        universe_semi, params_cross, scan_summary, pcr_by_expiration, pcr_pivot, volume_concentration, trade_stats, dataset_span,
        tier_a_universe, ensemble_counts, live_summary, sma_flags, technicals, iv_rank, hist_vol, latest_vix, garman_klass,
        trend_sma20_50, vix_regime, market_regime, first_per_ticker, row_slice, lookback_filter, iv_smile, smile_curve,
        expected_move, bs_price, greeks, atm_iv_skew, contract_grid, entry_cost, mark_path, path_outcome, features,
        training_filter, impute_encode, label_trades, relabel_on_read, pending_labels, dedup_12h, split_80_20, fit_cell_quantiles,
        fit_forest_quantiles, score, score_forest, monotonic_quantiles, monotonic_violations, pinball_loss, coverage, binary_metrics,
        roc_auc, stratified_cv, feature_importance, p_success, classify_regime, kelly_quantile, heuristic_score, gaussian_signal,
        open_signals, walkforward_folds, walkforward_predict, walkforward_purged, walkforward_sketch, in_sample_predict,
        liquidity_filter, position_size, exit_rules, time_stop, ledger, equity_curve, drawdown, risk_metrics, trade_metrics,
        open_positions, live_eligibility, sweep, sweep_score, sweep_winner, sweep_heatmap, profitability_report, audit_overview,
        audit_by_ticker, feature_distribution, categorical_distribution, label_summary, balance, whale_crossing, dte_histogram,
        contingency, ks_two_sample, chi2_two_sample, decile_compare, label_rate_delta, validation_gate, topk_unusual,
        sort_nulls_last, stream_whale_log, stream_scan_summary, label_merge, append_indexed, asof_tick, interval_join, boosted_histogram,
        score_boosted, walkforward_tree, stream_settle, stream_topk, garman_klass_fine, sma_flags_fine,
        impute_fills,
    )
} | {
    "elig_whale_quality": _eligible("whale_quality"),
    "elig_contrarian": _eligible("contrarian_trend"),
    "elig_vol_regime": _eligible("vol_regime"),
    "elig_legacy": _eligible("_legacy_quantile_confidence", "_legacy_trend_breakout", "_legacy_iv_regime_adaptive"),
}
