"""As-of, range and event joins between trades and daily series.

A daily series has at most one row per ticker and calendar day, however many trades
there are. So the time logic (carry forward, window, next event) runs on the series,
giving one row per ticker and day, and the trades meet the result in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens.functions.pricing import lit


def daily_close(bars: DataFrame, last_day: Column) -> DataFrame:
    """The latest close at or before every calendar day, up to ``last_day``."""
    following = F.lead("bar_date").over(W.partitionBy("ticker").orderBy("bar_date"))
    until = F.coalesce(F.date_sub(following, 1), F.greatest(last_day, F.col("bar_date")))
    return bars.withColumn("_until", until).select(
        "ticker", F.explode(F.sequence("bar_date", "_until")).alias("day"), F.col("close").alias("spot")
    )


def asof_price(df: DataFrame, bars: DataFrame, date_col: str) -> DataFrame:
    """Add ``spot``, the ticker's latest close at or before ``date_col``; NULL before the first."""
    last_day = df.select(F.max(date_col).alias("m"))
    prices = daily_close(bars, last_day.scalar()).withColumnRenamed("day", date_col)
    return df.join(prices, ["ticker", date_col], "left")


def label_window(bars: DataFrame, horizon: int = 10) -> DataFrame:
    """Last, lowest and highest close within ``horizon`` days from each day that has any.

    Each bar is repeated for the days whose window it falls into (horizon + 1 of them).
    """
    spread = bars.select(
        "ticker",
        "bar_date",
        "close",
        F.explode(F.sequence(F.date_sub("bar_date", horizon), F.col("bar_date"))).alias("trade_date"),
    )
    return spread.groupBy("ticker", "trade_date").agg(
        F.max_by("close", "bar_date").alias("settle"), F.min("close").alias("low"), F.max("close").alias("high")
    )


def label_range_join(trades: DataFrame, bars: DataFrame, horizon: int = 10) -> DataFrame:
    """Every trade with every bar of its ticker from the trade date to ``horizon`` days on.

    The bars of one (ticker, day) window are at most horizon + 1, so they travel as one
    array per window and are unfolded after the equi-join.
    """
    days = bars.select(
        "ticker",
        F.struct("bar_date", "close").alias("_bar"),
        F.explode(F.sequence(F.date_sub("bar_date", horizon), F.col("bar_date"))).alias("trade_date"),
    )
    windows = days.groupBy("ticker", "trade_date").agg(F.collect_list("_bar").alias("_bars"))
    joined = trades.join(windows, ["ticker", "trade_date"], "inner")
    return joined.withColumn("_bar", F.explode("_bars")).select(*trades.columns, "_bar.bar_date", "_bar.close")


def join_ticker_vol(trades: DataFrame, hv: DataFrame) -> DataFrame:
    """Add the ticker's volatility (0 when unknown) and the ratio to it (1.0 when 0)."""
    j = trades.join(hv.select("ticker", "hv"), ["ticker"], "left")
    known = F.coalesce("hv", lit(0))
    return j.withColumn("hv", known).withColumn(
        "iv_hv_ratio", F.when(known > 0, F.try_divide("implied_vol", known)).otherwise(lit(1))
    )


def join_vix(df: DataFrame, vix: DataFrame, date_col: str = "trade_date", default: float = 20.0) -> DataFrame:
    """Index level of exactly that date, ``default`` when missing, NaN or not positive."""
    j = df.join(vix.withColumnRenamed("vix_date", date_col), [date_col], "left")
    bad = F.col("vix").isNull() | F.isnan("vix") | (F.col("vix") <= 0)
    return j.withColumn("vix", F.when(bad, lit(default)).otherwise(F.col("vix")))


def days_to_event(
    trades: DataFrame, calendar: DataFrame, kind: str, within: int, name: str, per_ticker: bool = True
) -> DataFrame:
    """Days to the next event (0 or more), else from the last one (negative), else NULL.

    Adds ``days_to_<name>`` and ``near_<name>`` (1 when at most ``within`` days away). The
    search runs on distinct days (per ticker, or market-wide), then the trades look it up.
    """
    group = ["ticker"] if per_ticker else []
    events = calendar.where(F.col("kind") == kind).select(*group, F.col("event_date").alias("d"), F.col("event_date").alias("e"))
    keys = trades.select(*group, F.col("trade_date").alias("d"), F.lit(None).cast("date").alias("e"))
    days = keys.unionByName(events).groupBy(*group, "d").agg(F.max("e").alias("e"))
    order = W.partitionBy(*(group or [F.lit(0)])).orderBy("d")
    ahead = F.min("e").over(order.rowsBetween(0, W.unboundedFollowing))
    behind = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    away = F.coalesce(F.datediff(ahead, F.col("d")), F.datediff(behind, F.col("d")))
    table = days.select(*group, F.col("d").alias("trade_date"), away.alias(f"days_to_{name}"))
    near = F.coalesce((F.abs(F.col(f"days_to_{name}")) <= within).cast("int"), F.lit(0))
    return trades.join(table, [*group, "trade_date"], "left").withColumn(f"near_{name}", near)


def in_universe(trades: DataFrame, universe: DataFrame) -> DataFrame:
    return trades.join(universe.select("ticker"), ["ticker"], "left_semi")
