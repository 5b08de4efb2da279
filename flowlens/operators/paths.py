"""Model contracts on price bars, their entry cost, and their marked path to an outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.functions import pricing as px
from flowlens.functions.pricing import lit
from flowlens.operators.joins import join_vix
from flowlens.operators.vol import by_date, garman_klass, trend_sma

MULTIPLES = {"Call": (0.95, 1.0, 1.05), "Put": (0.90, 0.95, 1.0)}


def priced_bars(bars: DataFrame, vix: DataFrame, ahead: int = 10) -> DataFrame:
    """Bars with volatility, index level, trend and the next ``ahead`` bars as an array.

    The array holds at most ``ahead`` entries, so the later marking needs no join.
    """
    x = join_vix(trend_sma(garman_klass(bars)), vix, "bar_date")
    future = F.collect_list(F.struct(F.col("close").alias("spot"), F.col("gk_vol").alias("vol")))
    return x.withColumn("future", future.over(by_date().rowsBetween(1, ahead)))


def contract_grid(bars: DataFrame, dtes: Sequence[int] = (7, 15, 30, 45, 60), multiples=None) -> DataFrame:
    """Contracts per bar: both types, all strike multiples and terms.

    Strikes are rounded to the step of the price level (5 above 200, 2.5 above 50, else 1).
    """
    multiples = multiples or MULTIPLES
    # a bar becomes dozens of contracts, so the bars are dealt out before they are unfolded
    bars = bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker", "bar_date")
    choices = F.array(
        *[F.struct(F.lit(t).alias("option_type"), lit(m).alias("mult")) for t, ms in multiples.items() for m in ms]
    )
    step = px.strike_step("close")
    x = bars.withColumn("_c", F.explode(choices)).select("*", "_c.option_type", "_c.mult").drop("_c")
    # strikes of neighbouring multiples may coincide after rounding; the multiple stays as the key
    x = x.withColumn("strike", F.floor(F.col("close") * F.col("mult") / step + lit(0.5)) * step)
    return x.where(F.col("strike") > 0).withColumn("dte", F.explode(F.array(*[F.lit(int(d)) for d in dtes])))


def entry_cost(contracts: DataFrame, min_premium: float = 15.0) -> DataFrame:
    """Model premium, spread, entry price by side, commission and early-exercise flag.

    The side follows the trend: bought when it is bullish, sold when bearish, else at mid.
    """
    m = F.log(F.try_divide(F.col("strike"), F.col("close")))
    side = F.when(F.col("trend") == "BULL_ALIGNED", "BUY").when(F.col("trend") == "BEAR_ALIGNED", "SELL").otherwise("MID")
    x = contracts.withColumn("moneyness", m).withColumn("skew", px.skew_adjustment("moneyness", "dte"))
    x = x.withColumn("iv", px.model_iv("gk_vol", "vix", "skew")).withColumn("years", F.col("dte") / lit(365))
    x = px.with_price(x, "premium", "option_type", "close", "strike", "years", "iv").withColumn("premium", F.col("premium") * 100)
    x = x.where(F.col("premium") >= min_premium).withColumn("spread_pct", px.spread_pct("moneyness", "dte"))
    half = F.col("premium") * F.col("spread_pct") / 2
    in_money = F.when(F.col("option_type") == "Call", F.col("close") > F.col("strike")).otherwise(F.col("strike") > F.col("close"))
    x = x.withColumns({"half_spread": half, "side": side})
    entry = (
        F.when(F.col("side") == "BUY", F.col("premium") + half)
        .when(F.col("side") == "SELL", F.col("premium") - half)
        .otherwise(F.col("premium"))
    )
    return x.withColumns(
        {
            "entry_price": entry,
            "commission": lit(px.COMMISSION),
            "early_exercise_risk": ((F.col("dte") <= 7) & in_money).cast("int"),
        }
    )


def mark_path(contracts: DataFrame) -> DataFrame:
    """One row per contract and following bar with the profit against the entry price."""
    x = contracts.select("*", F.posexplode("future").alias("_i", "_f")).drop("future")
    x = x.withColumns({"day": F.col("_i") + 1, "spot_now": F.col("_f.spot"), "iv_now": px.model_iv(F.col("_f.vol"), "vix", "skew")})
    x = x.withColumn("years_now", F.greatest(F.lit(1), F.col("dte") - F.col("day")) / lit(365)).drop("_i", "_f")
    x = px.with_price(x, "value", "option_type", "spot_now", "strike", "years_now", "iv_now").withColumn("value", F.col("value") * 100)
    gain = F.when(F.col("side") == "BUY", F.col("value") - F.col("half_spread") - F.col("entry_price")).otherwise(
        F.col("entry_price") - F.col("value") - F.col("half_spread")
    )
    return x.withColumn("pnl", F.try_divide(gain, F.col("entry_price")))


def path_outcome(path: DataFrame, key: Sequence[str] = ("ticker", "bar_date", "option_type", "mult", "dte")) -> DataFrame:
    """Final and worst profit of each marked contract, with the greeks at exit; contracts with one bar or less drop out.

    The bars of a contract lie in one task, so partial aggregation sends one row per contract;
    greeks are computed on those rows only. Every aggregate is a number, so rows are hashed and not sorted.
    """
    at_exit = ("pnl", "spot_now", "iv_now", "years_now")
    o = path.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("pnl").alias("_mae"),
        *[F.min_by(x, "day").alias(f"_in_{x}") for x in ("close", "strike", "years", "iv")],
        *[F.max_by(x, "day").alias(f"_out_{x}") for x in at_exit],
    )
    o = o.where(F.col("n") > 1)
    o = px.with_greeks(o, {"delta": "_delta"}, "option_type", "_in_close", "_in_strike", "_in_years", "_in_iv")
    names = {g: f"{g}_exit" for g in ("delta", "gamma", "vega", "theta", "rho")}
    o = px.with_greeks(o, names, "option_type", "_out_spot_now", "_in_strike", "_out_years_now", "_out_iv_now")
    final = F.least(F.greatest(F.col("_out_pnl"), lit(-1)), lit(3))
    hedged = F.col("observed_return") - F.col("_delta") * (F.try_divide(F.col("_out_spot_now"), F.col("_in_close")) - 1)
    return o.withColumns({"observed_return": final, "max_adverse_return": F.least(F.greatest(F.col("_mae"), lit(-1)), lit(0))}).select(
        *key, "observed_return", "max_adverse_return",
        (F.col("observed_return") >= 0.05).cast("int").alias("label_success"), hedged.alias("delta_hedged_return"), *names.values(),
    )
