"""Streams: log new whale rows without repeats, and refresh the scan summary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowlens.functions import quotes as q


class KeepFirst(StatefulProcessor):
    """State of a key: the instant (microseconds) of the last row that was kept."""

    def __init__(self, gap: int, columns: Sequence[str]):
        self.gap, self.columns = gap, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of one key in one batch; they may come in any order
        batch = pd.concat(list(rows)).sort_values(["instant", "order_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        at = batch["instant"].to_numpy()
        kept, i = [], 0 if last is None else int(np.searchsorted(at, last + self.gap, "right"))
        while i < len(at):  # from one kept row to the next one that is more than the gap later
            kept.append(i)
            last = int(at[i])
            i = int(np.searchsorted(at, last + self.gap, "right"))
        if kept:
            self.last.update((last,))
        yield batch.iloc[kept][self.columns]

    def close(self) -> None:
        pass


def dedup_stream(rows: DataFrame, keys: Sequence[str], ts: str = "ts", id: str = "id", hours: float = 12) -> DataFrame:
    """Streaming form of the 12-hour rule; equals the batch operator when files arrive in time order.

    Same-instant repeats of a key are dropped by the state as well. The state holds one
    number per key; limit the files per trigger to bound the rows a key brings at once.
    The session needs the RocksDB state store (``session.get_session`` sets it).
    """
    x = rows.withColumns({"instant": F.unix_micros(F.col(ts).cast("timestamp")), "order_id": F.col(id)})
    gap = int(hours * 3_600_000_000)
    return x.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=KeepFirst(gap, rows.columns), outputStructType=rows.schema, outputMode="Append", timeMode="None"
    )


def whale_rows(trades: DataFrame, floor: float = q.WHALE_RATIO) -> DataFrame:
    return trades.where(q.is_whale(floor=floor))


TRADE_KEYS = ("ticker", "strike", "expiration", "option_type", "vol_oi_ratio")


def stream_whale_log(trades: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = TRADE_KEYS, hours: float = 12) -> StreamingQuery:
    """Append de-duplicated whale rows to a parquet log; reads what is there, then stops."""
    kept = dedup_stream(whale_rows(trades), keys, hours=hours)
    return (
        kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def write_summary(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every new state of the windows, with the number of its batch; reads what is there, then stops."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    return summary.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest_summary(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every window, also of those still open; a batch that was written twice counts once."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("window_start", "batch")]
    last = rows.groupBy("window_start").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("window_start", "s.*")


def stream_summary(flow: DataFrame, every: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Scan summary per time window of a flow stream with ``ts``."""
    call, volume = F.col("option_type") == "Call", F.col("volume").cast("bigint")
    timed = flow.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    s = timed.groupBy(F.window("ts", every).alias("w")).agg(
        F.avg("vol_oi_ratio").alias("_avg"), F.max("vol_oi_ratio").alias("max_vol_oi"),
        F.coalesce(F.sum(F.when(call, volume)), F.lit(0)).alias("call_volume"),
        F.coalesce(F.sum(F.when(~call, volume)), F.lit(0)).alias("put_volume"),
        F.count_if(q.is_whale()).alias("whale_count"),
    )
    ratio = F.when(F.col("call_volume") > 0, q.round_to(F.try_divide(F.col("put_volume").cast("double"), F.col("call_volume")), 4)).otherwise(F.lit(1.0))
    return s.select(
        F.col("w.start").alias("window_start"), q.round_to(F.col("_avg"), 2).alias("avg_vol_oi"), "max_vol_oi",
        "call_volume", "put_volume", ratio.alias("put_call_ratio"), "whale_count",
    )


class Best(StatefulProcessor):
    """State of a shard: the sort keys of its best ``k`` rows so far."""

    def __init__(self, k: int, keys: T.StructType, columns: Sequence[str]):
        self.k, self.keys, self.columns = k, keys, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", self.keys)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.keys.names
        held = pd.DataFrame([tuple(r) for r in self.best.get()] if self.best.exists() else [], columns=names).assign(__new=False)
        for batch in rows:
            # at most k rows besides the batch stay in memory
            both = pd.concat([held, batch.assign(__new=True)]) if len(held) else batch.assign(__new=True)
            held = both.sort_values(names, ascending=[False] + [True] * (len(names) - 1), kind="stable").head(self.k)
        entered = held[held["__new"]]
        if len(entered):
            self.best.put([tuple(plain(v) for v in r) for r in held[names].itertuples(index=False)])
        yield entered[self.columns]

    def close(self) -> None:
        pass


def plain(v):
    """A value of a pandas cell as the state store takes it."""
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v


def stream_topk(flow: DataFrame, k: int, ties: Sequence[str], path: str, checkpoint: str, column: str = "vol_oi_ratio", shards: int = 16) -> StreamingQuery:
    """Keep the top ``k`` rows of a stream in versioned tables; ``latest_topk`` reads the newest one.

    ``ties`` make the order total and are not NULL; rows without a value of ``column`` take no part.
    Rows are dealt to shards by a hash; a shard's state holds its best ``k`` keys and lets through only rows that
    enter them. Those meet the last version, and a new one is written only where it differs. A batch that is repeated
    after a failure starts from the version before it, and so writes the same rows again.
    """
    names = flow.columns
    order = [F.desc(column), *ties]
    x = flow.where(F.col(column).isNotNull()).withColumn("__shard", F.pmod(F.xxhash64(*ties), F.lit(shards)).cast("int"))
    keys = T.StructType([flow.schema[c] for c in (column, *ties)])
    entered = x.groupBy("__shard").transformWithStateInPandas(
        statefulProcessor=Best(k, keys, names), outputStructType=flow.schema, outputMode="Append", timeMode="None"
    )

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest_topk(spark, path, flow.schema, before=number)
        best = batch.select(*names).unionByName(old).orderBy(*order).limit(k)
        # k rows at most
        rows = best.collect()
        if number == 0 or rows != old.orderBy(*order).collect():
            spark.createDataFrame(rows, flow.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")

    return entered.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_topk(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The newest version (of those before a batch)."""
    rows = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
    try:
        rows = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(newest)).select(*schema.names)
