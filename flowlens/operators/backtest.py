"""Strategy evaluation: eligibility, size, exit, ledger, equity curve and metrics.

Every step is keyed by ``run_id``, so one parameter set and a sweep are the same plan.
Sizes are fractions of the *initial* capital and every eligible trade is taken. A
portfolio that compounds day by day and limits its open slots is a recursion over days
and no relational step; ``open_positions`` shows where a slot limit would bind. Totals
therefore differ from such a simulator by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from flowlens import schemas
from flowlens.functions import signals as sg
from flowlens.functions.pricing import lit

SETS_PER_BLOCK = 256
HOLD_FLOOR = -0.50

# The envelopes of the three rule sets
DTE_BAND, IV_BAND, LOW_IV = (14, 60), (15, 150), 30.0

# Shipped parameters of the strategies
COMMON = {
    "initial_capital": 100000.0, "min_kelly_fraction": 0.01, "slippage_pct": 0.01, "min_open_interest": 100,
    "max_risk_pct_per_trade": 0.02, "use_costs": True, "min_dte": 7, "max_dte": 60,
}
SHIPPED = {
    "whale_quality": {
        "prob_threshold": 0.364, "kelly_multiplier": 0.781, "kelly_cap": 0.12, "hard_stop_loss": 0.197, "stop_lambda": 1.5,
        "max_quantile_spread": 0.132, "vol_oi_floor": 2.0, "min_median_return": 0.025, "profit_threshold": 0.404,
    },
    "contrarian_trend": {
        "prob_threshold": 0.496, "kelly_multiplier": 0.92, "kelly_cap": 0.187, "hard_stop_loss": 0.265, "stop_lambda": 1.5,
        "max_quantile_spread": 0.0, "vol_oi_floor": 1.0, "min_median_return": 0.0, "profit_threshold": 0.486,
    },
    "vol_regime": {
        "prob_threshold": 0.363, "kelly_multiplier": 0.644, "kelly_cap": 0.173, "hard_stop_loss": 0.395, "stop_lambda": 1.5,
        "max_quantile_spread": 0.143, "vol_oi_floor": 1.0, "min_median_return": 0.0, "profit_threshold": 0.386,
    },
}


def params_frame(spark: SparkSession, sets: list[dict]) -> DataFrame:
    """Parameter rows from dictionaries; missing values come from the shipped defaults."""
    rows = []
    for i, given in enumerate(sets):
        merged = {"run_id": i, **COMMON, **SHIPPED.get(given["strategy_type"], SHIPPED["vol_regime"]), **given}
        rows.append(tuple(merged[f] for f in schemas.PARAMS.names))
    return spark.createDataFrame(rows, schemas.PARAMS)


def params_cross(candidates: DataFrame, params: DataFrame) -> DataFrame:
    """Every candidate under every parameter set, as columns of struct ``p``.

    The sets travel as one value, an array of blocks of sets, that is unfolded per row, so the
    filters that follow run in the same stage and rejected pairs are never written anywhere.
    """
    block = F.floor((F.row_number().over(W.orderBy("run_id")) - 1) / F.lit(SETS_PER_BLOCK))  # one row per set
    blocks = params.select(F.struct(*schemas.PARAMS.names).alias("s"), block.alias("b")).groupBy("b").agg(F.array_sort(F.collect_list("s")).alias("sets"))
    every = blocks.agg(F.array_sort(F.collect_list("sets")).alias("a"))
    return candidates.withColumn("_block", F.explode(every.scalar())).withColumn("p", F.explode("_block")).drop("_block")


def with_tier(predictions: DataFrame, tier_a: DataFrame) -> DataFrame:
    """Flag ``listed``: the ticker is in ``tier_a`` (tickers, once each), or the row is synthetic."""
    j = predictions.join(tier_a.select("ticker", F.lit(True).alias("_tier")), ["ticker"], "left")
    return j.withColumn("listed", (F.col("is_synthetic") == 1) | F.coalesce("_tier", F.lit(False))).drop("_tier")


def candidates(predictions: DataFrame, params: DataFrame) -> DataFrame:
    """Predictions that any set could take: no rule accepts a probability more than 0.05 under its threshold."""
    least = params.agg((F.min("prob_threshold") - lit(0.06)).alias("t"))
    return predictions.where(F.col("p_success") >= least.scalar())


def _p(name: str) -> Column:
    return F.col(f"p.{name}")


def _strategy(*names: str) -> Column:
    return _p("strategy_type").isin(*names)


def eligible(pairs: DataFrame) -> DataFrame:
    """Pairs that pass the rules of their strategy.

    Where ``with_tier`` has flagged the rows, they must be ``listed``. An unknown number
    counts as 0, an unknown volatility as 30 in the regime rules.
    """
    listed = F.col("listed") if "listed" in pairs.columns else F.lit(True)
    p, spread, median = F.col("p_success"), F.col("q")[4] - F.col("q")[0], F.col("q")[2]
    threshold, cap = _p("prob_threshold"), _p("max_quantile_spread")
    iv = F.coalesce("implied_vol", lit(0))
    iv_or_30 = F.when(iv == 0, lit(LOW_IV)).otherwise(iv)
    base = (
        listed
        & (F.coalesce("vol_oi_ratio", lit(0)) >= F.coalesce(_p("vol_oi_floor"), lit(2.0)))
        & F.coalesce("dte", F.lit(0)).between(*DTE_BAND)
    )
    banded = base & iv.between(*IV_BAND)
    sure = p >= threshold
    aligned = ((F.col("option_type") == "Call") & (F.col("trend_alignment") == "BULL_ALIGNED")) | (
        (F.col("option_type") == "Put") & (F.col("trend_alignment") == "BEAR_ALIGNED")
    )
    relaxed = (spread <= cap) & (p >= F.greatest(threshold - lit(0.05), lit(0.30)))
    rules = (
        F.when(_strategy("whale_quality"), banded & sure & (spread <= cap) & (median >= _p("min_median_return")))
        .when(_strategy("contrarian_trend"), banded & sg.contrarian() & sure)
        .when(_strategy("vol_regime"), base & F.when(iv_or_30 < LOW_IV, sure).otherwise(relaxed))
        .when(_strategy("_legacy_quantile_confidence"), sure & (spread <= cap))
        .when(_strategy("_legacy_trend_breakout"), sure & (median >= _p("min_median_return")) & aligned)
        .when(
            _strategy("_legacy_iv_regime_adaptive"),
            F.when(F.col("implied_vol") < LOW_IV, sure).otherwise(p >= F.greatest(threshold, lit(0.50))),
        )
    )
    return pairs.where(rules)


def liquidity(pairs: DataFrame) -> DataFrame:
    """Term inside the wanted band if known; open interest at the minimum, unknown fails."""
    term = F.col("dte").isNull() | F.col("dte").between(_p("min_dte"), _p("max_dte"))
    deep = (_p("min_open_interest") <= 0) | F.coalesce(F.col("open_interest") >= _p("min_open_interest"), F.lit(False))
    return pairs.where(term & deep)


def size(pairs: DataFrame) -> DataFrame:
    """Stop distance and position size; positions under the minimum drop out."""
    wide_iv = _strategy("_legacy_iv_regime_adaptive") & (F.col("implied_vol") >= LOW_IV)
    hard = F.when(_p("hard_stop_loss") > 1, _p("hard_stop_loss") / 100).otherwise(_p("hard_stop_loss"))
    hard = hard * F.when(wide_iv, lit(1.15)).otherwise(lit(1.0))
    cap = F.when(wide_iv, F.least(_p("kelly_cap"), lit(0.12))).otherwise(_p("kelly_cap"))
    by_quantile = F.least(F.abs(F.col("q")[0] * _p("stop_lambda")), lit(1))
    stop = F.greatest(F.when(hard > 0, hard).otherwise(by_quantile), lit(0.01))
    x = pairs.withColumns({"stop": stop, "_cap": cap, "upside": F.greatest(_p("profit_threshold"), lit(0.01))})
    raw = sg.kelly_from_odds(F.col("p_success"), F.try_divide("upside", "stop"))
    kelly = F.least(F.greatest(F.least(raw, F.col("_cap")), lit(0)) * _p("kelly_multiplier"), F.col("_cap"))
    x = x.withColumn("_k", kelly)
    risk = _p("max_risk_pct_per_trade")
    kelly = F.when(F.col("_k") * F.col("stop") > risk, F.try_divide(risk, F.col("stop"))).otherwise(F.col("_k"))
    x = x.withColumn("kelly_fraction", kelly)
    sized = F.struct("kelly_fraction", (_p("initial_capital") * F.col("kelly_fraction")).alias("position_usd"))
    # a filter on the computed size would be moved under these steps, with all of their expressions written out in it
    taken = F.filter(F.array(sized), lambda s: (s["kelly_fraction"] >= _p("min_kelly_fraction")) & (s["position_usd"] >= 0.01))
    return x.select(*pairs.columns, "stop", F.inline(taken))


def exits(sized: DataFrame) -> DataFrame:
    """Exit reason and return after costs and slippage."""
    ret, worst = F.coalesce("observed_return", lit(0)), F.coalesce("max_adverse_return", lit(0))
    priced = _p("use_costs") & F.col("commission_per_contract").isNotNull() & (F.col("premium") > 0)
    cost = F.try_divide(lit(2) * F.col("commission_per_contract"), F.col("premium") * 100)
    x = sized.withColumns({"_net": ret - F.when(priced, cost).otherwise(lit(0)), "mae": worst})
    stop, take = F.col("stop"), _p("profit_threshold")
    reason = (
        F.when(F.col("mae") <= -stop, "stop_hit").when(F.col("_net") >= take, "profit_hit")
        .when(F.col("_net") <= -stop, "stop_hit").otherwise("hold_to_horizon")
    )
    x = x.withColumn("exit_reason", reason)
    gross = (
        F.when(F.col("exit_reason") == "stop_hit", -stop).when(F.col("exit_reason") == "profit_hit", take)
        .otherwise(F.greatest(F.col("_net"), lit(HOLD_FLOOR)))
    )
    return x.withColumn("trade_return", gross - _p("slippage_pct")).drop("_net")


def time_stop(exited: DataFrame, horizon: int = 10) -> DataFrame:
    """Positions with two days to expiry or less leave early, at a small bounded loss.

    The first check is the day after entry. Adds the planned exit date, the date the
    position really leaves and the return booked then.
    """
    planned = F.coalesce("evaluation_date", F.date_add("trade_date", horizon))
    early = F.date_add("trade_date", F.greatest(F.lit(1), F.coalesce("dte", F.lit(0)) - 2))
    x = exited.withColumns({"exit_date": planned, "_early": early})
    fires = F.col("_early") < F.col("exit_date")
    forced = F.greatest(F.col("mae"), -F.col("stop") * lit(0.25)) - _p("slippage_pct")
    return x.withColumns(
        {
            "time_stopped": fires,
            "left_date": F.when(fires, F.col("_early")).otherwise(F.col("exit_date")),
            "booked_return": F.when(fires, forced).otherwise(F.col("trade_return")),
        }
    ).drop("_early")


def ledger(stopped: DataFrame) -> DataFrame:
    """One row per trade and run. ``planned_pnl`` ignores the time stop, ``realised_pnl`` has it."""
    initial = F.upper(F.substring("option_type", 1, 1))
    contract = F.concat(F.concat_ws(" ", F.col("ticker"), F.col("expiration").cast("string"), initial), F.col("strike").cast("string"))
    return stopped.select(
        _p("run_id").alias("run_id"), _p("strategy_type").alias("strategy_type"), _p("initial_capital").alias("initial_capital"),
        "id", "ticker", "trade_date", "exit_date", "left_date", contract.alias("contract"), "p_success", "kelly_fraction",
        "position_usd", F.col("mae").alias("max_adverse_return"), "exit_reason", "time_stopped", "trade_return",
        F.coalesce("observed_return", lit(0)).alias("actual_return"),
        (F.col("position_usd") * F.col("trade_return")).alias("planned_pnl"),
        (F.col("position_usd") * F.col("booked_return")).alias("realised_pnl"),
    )


def run(predictions: DataFrame, params: DataFrame, tier_a: DataFrame | None = None, horizon: int = 10) -> DataFrame:
    """Predictions to ledger for all parameter sets."""
    x = predictions if tier_a is None else with_tier(predictions, tier_a)
    pairs = params_cross(candidates(x, params), params)
    return ledger(time_stop(exits(size(liquidity(eligible(pairs)))), horizon))


def equity_curve(ledger_df: DataFrame, predictions: DataFrame, params: DataFrame, horizon: int = 10) -> DataFrame:
    """Equity on every calendar day from the first entry to the last planned exit.

    The span covers all predictions, taken or not. Profit is booked when the position
    leaves, at the earliest the day after entry.
    """
    last = F.coalesce("evaluation_date", F.date_add("trade_date", horizon))
    span = predictions.select(F.struct(F.min("trade_date").alias("lo"), F.max(last).alias("hi")).alias("s"))
    days = params.select("run_id", "initial_capital").withColumn("s", span.scalar())
    days = days.select("run_id", "initial_capital", F.explode(F.sequence("s.lo", "s.hi")).alias("date"))
    booked = ledger_df.groupBy("run_id", F.greatest(F.col("left_date"), F.date_add("trade_date", 1)).alias("date")).agg(
        F.sum("realised_pnl").alias("pnl")
    )
    curve = days.join(booked, ["run_id", "date"], "left")
    by_run = W.partitionBy("run_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # days of one run
    total = F.sum(F.coalesce("pnl", lit(0))).over(by_run)
    return curve.select("run_id", "date", "initial_capital", F.round(F.col("initial_capital") + total, 2).alias("equity"))


def drawdown(equity: DataFrame) -> DataFrame:
    """Percent below the running peak, which starts at the initial capital."""
    by_run = W.partitionBy("run_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(by_run), F.col("initial_capital"))
    x = equity.withColumn("peak", peak)
    return x.withColumn("drawdown_pct", F.when(F.col("peak") > 0, F.try_divide(F.col("peak") - F.col("equity"), "peak") * 100).otherwise(lit(0)))


def risk_metrics(equity: DataFrame) -> DataFrame:
    """Sharpe, Sortino, drawdown and active days from calendar-day returns."""
    before = F.lag("equity").over(W.partitionBy("run_id").orderBy("date"))
    r = drawdown(equity).withColumn("_b", before)
    r = r.withColumn("r", F.when(F.col("_b") > 0, F.try_divide(F.col("equity") - F.col("_b"), "_b")))
    down = F.when(F.col("r") < 0, F.col("r") * F.col("r"))
    s = r.groupBy("run_id").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.avg(down).alias("down"),
        F.count_if(F.col("r") != 0).alias("active_days"), F.greatest(F.max("drawdown_pct"), lit(0)).alias("max_drawdown_pct"),
        F.count(F.lit(1)).alias("days"), F.max_by("equity", "date").alias("final_equity"), F.max("initial_capital").alias("initial_capital"),
    )
    year = F.sqrt(lit(252))
    sharpe = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.try_divide("mean", "sd") * year).otherwise(lit(0))
    s = s.withColumn("sharpe", sharpe)
    sortino = F.when(F.col("n") <= 1, lit(0)).when(F.col("down").isNull(), F.col("sharpe") * 2).otherwise(
        F.coalesce(F.try_divide(F.col("mean"), F.sqrt("down")) * year, lit(0))
    )
    return s.select("run_id", "sharpe", sortino.alias("sortino"), "max_drawdown_pct", "active_days", "days", "final_equity", "initial_capital")


def trade_metrics(ledger_df: DataFrame, params: DataFrame) -> DataFrame:
    """Counts, win rate, win/loss ratio and profit factor; runs without trades get zeros."""
    pnl = F.col("planned_pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, -pnl)
    t = ledger_df.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(won).alias("wins"), F.sum(won).alias("won"), F.sum(lost).alias("lost"),
        F.avg(won).alias("aw"), F.avg(lost).alias("al"),
    )
    t = params.select("run_id", "strategy_type").join(t, "run_id", "left")

    def z(e: Column) -> Column:
        return F.coalesce(e, lit(0))

    n = F.coalesce("n", F.lit(0))
    return t.select(
        "run_id", "strategy_type", n.alias("trades"),
        z(F.try_divide(F.col("wins").cast("double"), F.col("n")) * 100).alias("win_rate_pct"),
        z(F.try_divide(z(F.col("aw")), F.col("al"))).alias("win_loss_ratio"),
        z(F.try_divide(z(F.col("won")), F.col("lost"))).alias("profit_factor"),
    )


def summary(ledger_df: DataFrame, predictions: DataFrame, params: DataFrame, horizon: int = 10) -> DataFrame:
    """All figures of every run, one row each."""
    s = trade_metrics(ledger_df, params).join(risk_metrics(equity_curve(ledger_df, predictions, params, horizon)), "run_id")
    cap, last = F.col("initial_capital"), F.col("final_equity")
    years = F.lit(365.0) / F.greatest(F.col("days") - 1, F.lit(1))
    cagr = F.when((last > 0) & (cap > 0), (F.pow(F.try_divide(last, cap), years) - 1) * 100).otherwise(lit(0))
    return s.withColumns({"pnl_usd": last - cap, "pnl_pct": F.try_divide(last - cap, cap) * 100, "cagr_pct": cagr}).drop(
        "days", "final_equity", "initial_capital"
    )


def open_positions(ledger_df: DataFrame) -> DataFrame:
    """Positions open at the end of each day with an entry or exit, per run."""
    moves = F.explode(
        F.array(
            F.struct(F.col("trade_date").alias("date"), F.lit(1).alias("d")),
            F.struct(F.greatest(F.col("left_date"), F.date_add("trade_date", 1)).alias("date"), F.lit(-1).alias("d")),
        )
    )
    net = ledger_df.select("run_id", moves.alias("m")).groupBy("run_id", F.col("m.date").alias("date")).agg(F.sum("m.d").alias("d"))
    by_run = W.partitionBy("run_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return net.select("run_id", "date", F.sum("d").over(by_run).alias("open_positions"))


def live_eligible(signals: DataFrame, params: DataFrame) -> DataFrame:
    """The dashboard's shorter rules on open signals, for every parameter set."""
    x = params_cross(signals, params)
    p, spread = F.coalesce("p_success", lit(0)), F.coalesce(F.col("q")[4] - F.col("q")[0], lit(0))
    iv, threshold, cap = F.coalesce("implied_vol", lit(0)), _p("prob_threshold"), _p("max_quantile_spread")
    rules = (
        F.when(_strategy("whale_quality"), (p >= threshold) & ((cap <= 0) | (spread <= cap)))
        .when(_strategy("contrarian_trend"), (p >= threshold) & sg.contrarian())
        .when(_strategy("vol_regime"), F.when(iv < LOW_IV, p >= F.greatest(threshold, lit(0.40))).otherwise((p >= threshold) & (spread <= 0.35)))
        .otherwise(p >= threshold)
    )
    return x.where(rules).select("id", _p("run_id").alias("run_id"), _p("strategy_type").alias("strategy_type"), "p_success")
