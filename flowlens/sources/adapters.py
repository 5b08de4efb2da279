"""Option tables derived from the order and line-item tables by integer arithmetic.

The test data has no option quotes, so chain, bars, trades, an index series and an event
calendar are computed from it. Only integer rules are used, so that another SQL engine
derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.pricing import COMMISSION
from flowlens.functions.quotes import is_weekly, vol_oi_ratio
from flowlens.operators.joins import asof_price


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def _ticker(key: Column) -> Column:
    return F.concat(F.lit("T0"), (key % 10).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per ticker. A print's price sits in the low digits of its order key, so
    the first and last price are plain minima and maxima, which aggregate in place."""
    li = _read(spark, sf_dir, "lineitem")
    tick = _cents("l_extendedprice") % 4000
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 4096 + tick

    def price(t: Column) -> Column:
        return F.lit(80.0) + t / F.lit(100.0)

    x = li.select(
        _ticker(F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("bar_date"),
        tick.alias("tick"), key.alias("key"), "l_quantity",
    )
    return x.groupBy("ticker", "bar_date").agg(
        price(F.min("key") % 4096).alias("open"),
        price(F.max("tick")).alias("high"),
        price(F.min("tick")).alias("low"),
        price(F.max("key") % 4096).alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )


def vix(bars_df: DataFrame) -> DataFrame:
    """An index series that runs through all volatility regimes, from one ticker's closes."""
    return bars_df.where(F.col("ticker") == "T00").select(
        F.col("bar_date").alias("vix_date"), ((F.col("close") - 70) * F.lit(0.8)).alias("vix")
    )


def calendar(bars_df: DataFrame) -> DataFrame:
    """Quarterly earnings (last bar of a quarter, per ticker) and monthly market-wide dates."""
    earnings = bars_df.groupBy("ticker", F.date_trunc("quarter", "bar_date").alias("q")).agg(
        F.max("bar_date").alias("event_date")
    )
    fomc = bars_df.groupBy(F.date_trunc("month", "bar_date").alias("m")).agg(F.min("bar_date").alias("event_date"))
    return earnings.select(F.lit("EARNINGS").alias("kind"), "ticker", "event_date").unionByName(
        fomc.select(F.lit("FOMC").alias("kind"), F.lit(None).cast("string").alias("ticker"), "event_date")
    )


def raw_trades(orders: DataFrame) -> DataFrame:
    """Trade columns that need the order row alone; also used on the order stream."""
    k, cents = F.col("o_orderkey"), _cents("o_totalprice")

    def digit(div: int, mod: int) -> Column:
        return F.floor(cents / F.lit(float(div))).cast("bigint") % mod

    ts = F.timestamp_add("SECOND", (k % 86400).cast("int"), F.col("o_orderdate").cast("date").cast("timestamp"))
    trend = F.element_at(
        F.array(*[F.lit(t) for t in ("BULL_ALIGNED", "BEAR_ALIGNED", "BULL_CONTRARIAN", "NEUTRAL")]),
        (digit(13, 4) + 1).cast("int"),
    )
    x = orders.select(
        k.alias("id"),
        ts.alias("ts"),
        _ticker(F.col("o_custkey")).alias("ticker"),
        (F.lit(80.0) + F.lit(2.5) * (cents % 17)).alias("strike"),
        F.when(k % 2 == 0, "Call").otherwise("Put").alias("option_type"),
        (F.lit(1) + cents % 5000).alias("volume"),
        digit(7, 1000).alias("open_interest"),
        (F.lit(10) + cents % 120).cast("double").alias("implied_vol"),
        (F.lit(50) + cents % 20000).cast("double").alias("premium"),
        F.when(k % 3 == 0, "BUY").when(k % 3 == 1, "SELL").otherwise("MID").alias("side"),
        (F.lit(7) + digit(11, 60)).cast("int").alias("dte"),
        trend.alias("trend_alignment"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("is_synthetic"),
        (F.lit(42) + 100 * (k % 5)).cast("int").alias("ensemble_id"),
    )
    return x.select(
        "*",
        F.to_date("ts").alias("trade_date"),
        F.date_add(F.to_date("ts"), F.col("dte")).alias("expiration"),
        vol_oi_ratio().alias("vol_oi_ratio"),
        F.lit(COMMISSION).alias("commission_per_contract"),
    ).withColumn("is_weekly", is_weekly())


def trades(spark: SparkSession, sf_dir: str, bars_df: DataFrame | None = None) -> DataFrame:
    """All orders as trades; one before the first bar of its ticker has no underlier price."""
    bars_df = bars(spark, sf_dir) if bars_df is None else bars_df
    t = asof_price(raw_trades(_read(spark, sf_dir, "orders")), bars_df, "trade_date")
    return t.withColumnRenamed("spot", "underlier_price")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly snapshots; k1, k2, k3 only serve to order quotes of the same contract."""
    li = _read(spark, sf_dir, "lineitem")
    cents, line = _cents("l_extendedprice"), F.col("l_linenumber")
    qty = F.col("l_quantity").cast("bigint")
    half = F.when((line == 4) & (qty % 2 == 1), 0).otherwise(10)
    last, mid = cents % 1000, cents % 1000 + 5 * (line - 4)
    snap = F.to_date(F.date_trunc("month", "l_shipdate"))
    weeks = ((F.col("l_partkey") * 7 + line) % 14).cast("int")
    return li.select(
        _ticker(F.col("l_suppkey")).alias("ticker"),
        snap.alias("snapshot_date"),
        F.date_add(snap, F.lit(7) * weeks).alias("expiration"),
        (F.lit(90) + 5 * (F.col("l_partkey") % 5)).cast("double").alias("strike"),
        F.when(F.col("l_linestatus") == "O", "Call").otherwise("Put").alias("option_type"),
        F.when(line == 7, F.lit(0).cast("bigint")).otherwise(qty).alias("volume"),
        (F.col("l_orderkey") % 20).alias("open_interest"),
        (last / F.lit(100.0)).alias("last_price"),
        ((mid - half) / F.lit(100.0)).alias("bid"),
        ((mid + half) / F.lit(100.0)).alias("ask"),
        (F.lit(0.05) + (F.col("l_partkey") % 150) / F.lit(100.0)).alias("implied_vol"),
        F.timestamp_add("SECOND", (F.col("l_orderkey") % 86400).cast("int"), snap.cast("timestamp")).alias("last_trade_ts"),
        F.col("l_orderkey").alias("k1"),
        line.alias("k2"),
        cents.alias("k3"),
    )
