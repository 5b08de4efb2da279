"""Readers, writers and row selection for chain, bar, trade and model-run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from flowlens import schemas
from flowlens.operators.scale import number_rows

TRADE_KEY = ("ts", "ticker", "strike", "option_type", "ensemble_id")


def load_chain(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Option quotes. A file may lack columns of the schema; those read as NULL."""
    return spark.read.schema(schemas.CHAIN).options(**options).format(fmt).load(path)


def union_sides(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Calls and puts as one table with a type tag; columns only one side has become NULL."""
    tagged = calls.withColumn("option_type", F.lit("Call")).unionByName(
        puts.withColumn("option_type", F.lit("Put")), allowMissingColumns=True
    )
    present = set(tagged.columns)
    cols = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.CHAIN.fields
    ]
    return tagged.select(*cols, *[c for c in tagged.columns if c not in schemas.CHAIN.names])


def load_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return complete_bars(spark.read.schema(schemas.BARS).options(**options).format(fmt).load(path))


def complete_bars(bars: DataFrame) -> DataFrame:
    return bars.dropna(subset=["open", "high", "low", "close", "volume"])


def select_expirations(chain: DataFrame, lo: int = 0, hi: int = 90, n: int = 6, fallback: int = 4) -> DataFrame:
    """The ``n`` nearest expirations ``lo``..``hi`` days out of each ticker and snapshot.

    If none lies in the band, the first ``fallback`` expirations of any distance are taken.
    Ranking runs over the distinct expirations; the quotes only meet the short list.
    """
    key = ["ticker", "snapshot_date"]
    dates = chain.groupBy(*key, "expiration").agg(F.count(F.lit(1)).alias("_rows"))
    inside = F.coalesce(F.datediff("expiration", "snapshot_date").between(lo, hi), F.lit(False))
    by_snapshot = W.partitionBy(*key)
    so_far = by_snapshot.orderBy("expiration").rowsBetween(W.unboundedPreceding, 0)
    # dates are distinct, so a running count of those inside is their rank: one sort serves both ranks
    kept = (
        dates.withColumn("_in", inside)
        .select(
            *key, "expiration", "_in", F.count_if("_in").over(so_far).alias("_r"), F.count(F.lit(1)).over(so_far).alias("_ra"),
            F.max("_in").over(by_snapshot).alias("_any"),
        )
        .where(F.when(F.col("_any"), F.col("_in") & (F.col("_r") <= n)).otherwise(F.col("_ra") <= fallback))
        .select(*key, "expiration")
    )
    return chain.join(kept, [*key, "expiration"], "left_semi")


def scan_trades(trades: DataFrame, synthetic: bool | None = None, **equal) -> DataFrame:
    """Trades matching all equality filters, oldest first."""
    for name, value in equal.items():
        trades = trades.where(F.col(name) == value)
    if synthetic is not None:
        trades = trades.where(F.col("is_synthetic") == int(synthetic))
    return trades.orderBy("ts", "id")


def page_trades(
    trades: DataFrame, ticker: str | None = None, labeled: bool | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """One page of trades, newest first."""
    if ticker is not None:
        trades = trades.where(F.col("ticker") == ticker.upper())
    if labeled is not None:
        trades = trades.where(F.col("labeled") == labeled)
    return trades.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def with_defaults(trades: DataFrame) -> DataFrame:
    """All trade columns in schema order, the absent ones filled with their defaults."""
    defaults = {"labeled": F.lit(False), "is_synthetic": F.lit(0), "ensemble_id": F.lit(0)}
    present = set(trades.columns)
    cols = []
    for f in schemas.TRADES.fields:
        col: Column = F.col(f.name) if f.name in present else F.lit(None)
        if f.name in defaults:
            col = F.coalesce(col, defaults[f.name])
        cols.append(col.cast(f.dataType).alias(f.name))
    return trades.select(*cols)


def append_trades(trades: DataFrame, path: str, partition: str = "trade_date") -> None:
    """Append to the partitioned trade table.

    Rows are rebalanced by date: Spark splits a busy date by its real size and joins quiet ones.
    """
    full = with_defaults(trades)
    unit = F.to_date("ts") if partition == "trade_date" else F.to_date(F.date_trunc("month", "ts"))
    full.withColumn(partition, unit).hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def append_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str] = TRADE_KEY) -> DataFrame:
    """The rows of ``incoming`` whose key is not stored yet."""
    stored = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return incoming.join(stored, list(keys), "left_anti")


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating-point column become NULL."""
    def clean(name: str) -> Column:
        v = F.col(name)
        return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v).alias(name)

    floats = (T.DoubleType, T.FloatType)
    return df.select(*[clean(f.name) if isinstance(f.dataType, floats) else F.col(f.name) for f in df.schema.fields])


def log_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return sanitize(runs).orderBy(F.desc("run_ts"), F.desc("model_version")).limit(n)


def row_slice(trades: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) of the time-ordered table, with their position ``idx``."""
    return number_rows(trades, ["ts", "id"]).where((F.col("idx") >= start) & (F.col("idx") < end))


def lookback(trades: DataFrame, days: int) -> DataFrame:
    """Rows at most ``days`` days older than the newest one."""
    newest = trades.select(F.max("ts").alias("m"))
    return trades.where(F.col("ts") >= newest.scalar() - F.make_dt_interval(days=F.lit(days)))
