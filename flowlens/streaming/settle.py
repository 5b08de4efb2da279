"""Labels on a stream: trades wait in keyed state until their horizon has passed, then leave with their outcome.

The key is (ticker, trade date). A bar is sent to the keys of all days whose window it falls into, where three numbers
keep the last close and the range; trades of the key wait beside them. An event-time timer fires once the watermark
has passed the window: the trades are emitted settled and the key's state is dropped. So the state holds the open
horizon only, and a busy ticker is as many keys as it has open days.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.labels import outcome
from flowlens.streaming.flow import plain

DAY_MS = 86_400_000


class Settle(StatefulProcessor):
    """State of a (ticker, day): range and last close of its window so far, and the rows that wait for it."""

    def __init__(self, horizon: int, carried: T.StructType):
        self.horizon, self.carried = horizon, carried

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        window = T.StructType([T.StructField("last_day", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("settle", "low", "high")])
        self.window = handle.getValueState("window", window)
        self.waiting = handle.getListState("waiting", self.carried)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, day = key
        first = not self.window.exists() and not self.waiting.exists()
        for batch in rows:
            bars = batch[batch["bar_day"].notna()]
            if len(bars):
                now = self.window.get() if self.window.exists() else None
                newest = bars.loc[bars["bar_day"].idxmax()]
                last, settle = int(newest["bar_day"]), float(newest["close"])
                low, high = float(bars["close"].min()), float(bars["close"].max())
                if now is not None:
                    last, settle = (int(now[0]), now[1]) if now[0] > last else (last, settle)
                    low, high = min(low, now[2]), max(high, now[3])
                self.window.update((last, settle, low, high))
            trades = batch[batch["bar_day"].isna()]
            if len(trades):
                self.waiting.appendList([tuple(plain(v) for v in r) for r in trades[self.carried.names].itertuples(index=False)])
        if first:
            # the first instant after the last day of the window
            self.handle.registerTimer((int(day) + self.horizon + 1) * DAY_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window = self.window.get() if self.window.exists() else (None, None, None, None)
        rows = [(*r, window[1], window[2], window[3]) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.window.clear()
        yield pd.DataFrame(rows, columns=[*self.carried.names, "settle", "low", "high"])

    def close(self) -> None:
        pass


#: What a waiting trade has to remember to be labelled; other columns stay in the stored row, found by id. The id
#: travels as a text, since numbers beside unknown ones pass pandas as doubles.
CARRIED = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("underlier_price", T.DoubleType()), T.StructField("option_type", T.StringType()), T.StructField("side", T.StringType())]
)


def settle_stream(trades: DataFrame, bars: DataFrame, horizon: int = 10, threshold: float = 0.03, delay: str = "0 seconds") -> DataFrame:
    """Streaming ``label_trades``: one row (id, labels) per trade once the watermark is past its horizon.

    ``trades`` has id, ts, ticker, trade_date, underlier_price, option_type and side; ``bars`` ticker, bar_date and
    close. A bar counts at the start of its day, so that it can never come after its own window. Trades without a
    bar in their window leave unlabelled, as in the batch operator.
    """
    epoch = F.lit(datetime.date(1970, 1, 1))
    t = trades.select(
        F.col("ts").cast("timestamp").alias("event_time"), "ticker", F.datediff("trade_date", epoch).cast("long").alias("day"), F.lit(None).cast("long").alias("bar_day"),
        F.lit(None).cast("double").alias("close"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CARRIED.fields],
    )
    bar_day = F.datediff("bar_date", epoch).cast("long")
    b = bars.select(
        F.col("bar_date").cast("timestamp").alias("event_time"), "ticker", F.explode(F.sequence(bar_day - horizon, bar_day)).alias("day"), bar_day.alias("bar_day"), "close",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CARRIED.fields],
    )
    out = T.StructType([*CARRIED.fields, *[T.StructField(n, T.DoubleType()) for n in ("settle", "low", "high")]])
    both = t.unionByName(b).withWatermark("event_time", delay)
    settled = both.groupBy("ticker", "day").transformWithStateInPandas(
        statefulProcessor=Settle(horizon, CARRIED), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
    return outcome(settled.withColumn("id", F.col("id").cast("long")), threshold)
