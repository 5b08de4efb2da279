"""Labelling of trades against later prices, label state, statistics and de-duplication."""

from __future__ import annotations

import datetime
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from flowlens.functions.pricing import lit
from flowlens.operators.joins import label_window
from flowlens.operators.scale import materialize

LABELS = {
    "labeled": "boolean", "label_success": "int", "observed_return": "double", "max_adverse_return": "double",
    "evaluation_date": "date",
}


def unlabeled(trades: DataFrame) -> DataFrame:
    """Trades with empty label columns."""
    cols = {n: F.lit(None).cast(t) for n, t in LABELS.items() if n != "labeled"}
    return trades.withColumns({"labeled": F.lit(False), **cols})


def reset_labels(trades: DataFrame) -> DataFrame:
    """Clear the labels of the real population."""
    real = F.col("is_synthetic") == 0
    empty = {n: F.lit(False) if n == "labeled" else F.lit(None).cast(t) for n, t in LABELS.items()}
    return trades.withColumns({n: F.when(real, empty[n]).otherwise(F.col(n)) for n in LABELS})


def is_pending(as_of: datetime.datetime, horizon: int = 10) -> Column:
    return ~F.col("labeled") & (F.col("ts") <= F.lit(as_of - datetime.timedelta(days=horizon)))


def pending(trades: DataFrame, as_of: datetime.datetime, horizon: int = 10, force: bool = False) -> DataFrame:
    """Rows to label: unlabelled and at least ``horizon`` days old."""
    return (reset_labels(trades) if force else trades).where(is_pending(as_of, horizon))


def label_trades(
    trades: DataFrame, bars: DataFrame, as_of: datetime.datetime, horizon: int = 10, threshold: float = 0.03
) -> DataFrame:
    """Trades with labels set where pending and priced, at entry and within the horizon.

    The settlement is the last close from the trade date to ``horizon`` days on. A bought
    call or sold put gains when it rises; everything else, mid prints included, when it
    falls. The outcome per (ticker, day) is computed on the bars, so trades are joined once.
    """
    j = _with_gain(trades.join(label_window(bars, horizon), ["ticker", "trade_date"], "left"))
    hit = is_pending(as_of, horizon) & F.col("settle").isNotNull() & F.col("underlier_price").isNotNull()
    j = j.withColumn("_hit", hit)
    new = {
        "labeled": F.lit(True),
        **_success_and_returns(threshold),
        "evaluation_date": F.date_add("trade_date", horizon),
    }
    j = j.withColumns({n: F.when(F.col("_hit"), e).otherwise(F.col(n)) for n, e in new.items()})
    return j.drop("settle", "low", "high", "_gain", "_worst", "_hit")


def _with_gain(j: DataFrame) -> DataFrame:
    """Signed and worst return of rows with the last, lowest and highest close of their window."""
    start = F.col("underlier_price")
    up = ((F.col("option_type") == "Call") & (F.col("side") == "BUY")) | (
        (F.col("option_type") == "Put") & (F.col("side") == "SELL")
    )
    gain = F.try_divide(F.when(up, F.col("settle") - start).otherwise(start - F.col("settle")), start)
    worst = F.try_divide(F.when(up, F.col("low") - start).otherwise(start - F.col("high")), start)
    return j.withColumns({"_gain": gain, "_worst": worst})


def _success_and_returns(threshold: float) -> dict[str, Column]:
    return {
        "label_success": F.coalesce((F.col("_gain") >= threshold).cast("int"), F.lit(0)),
        "observed_return": F.round("_gain", 4),
        "max_adverse_return": F.round("_worst", 4),
    }


def outcome(settled: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Labels (id, labeled, label_success, observed_return, max_adverse_return) of rows with their window's closes."""
    hit = F.col("settle").isNotNull() & F.col("underlier_price").isNotNull()
    values = {n: F.when(hit, e) for n, e in _success_and_returns(threshold).items()}
    return _with_gain(settled).select("id", hit.alias("labeled"), *[e.alias(n) for n, e in values.items()])


def relabel(trades: DataFrame, threshold: float) -> DataFrame:
    """Success at another threshold, from the stored return; other rows stay as they are."""
    known = F.col("labeled") & F.col("observed_return").isNotNull()
    return trades.withColumn(
        "label_success", F.when(known, (F.col("observed_return") >= threshold).cast("int")).otherwise(F.col("label_success"))
    )


def trade_stats(trades: DataFrame, target: float = 0.03) -> DataFrame:
    s = trades.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if("labeled").alias("labeled_trades"),
        F.count_if(F.col("labeled") & (F.col("observed_return") >= target)).alias("successful_trades"),
    )
    ratio = F.col("successful_trades") / F.greatest("labeled_trades", F.lit(1)).cast("double")
    return s.withColumn("success_ratio", F.round(ratio, 4))


def dataset_span(trades: DataFrame, synthetic: bool = True) -> DataFrame:
    s = trades.where(F.col("is_synthetic") == int(synthetic)).agg(
        F.min("ts").cast("date").alias("data_start"), F.max("ts").cast("date").alias("data_end"),
        F.count(F.lit(1)).alias("data_count"),
    )
    return s.withColumn("data_span_days", F.coalesce(F.datediff("data_end", "data_start"), F.lit(0)))


def tier_a(trades: DataFrame, target: float = 0.03, min_rows: int = 10, min_rate: float = 0.30) -> DataFrame:
    """Tickers that did well in the year before the newest labelled trade (real rows)."""
    newest = trades.where("labeled").select(F.max("ts").alias("m"))
    real = trades.where(F.col("labeled") & (F.col("is_synthetic") == 0)).where(
        F.col("ts") >= newest.scalar() - F.make_dt_interval(days=F.lit(365))
    )
    won = F.avg(F.when(F.col("observed_return") >= target, 1.0).otherwise(0.0))
    rates = real.groupBy("ticker").agg(won.alias("win_rate"), F.count(F.lit(1)).alias("n"))
    return rates.where((F.col("n") >= min_rows) & (F.col("win_rate") >= min_rate))


def ensemble_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("ensemble_id").agg(F.count(F.lit(1)).alias("n"))


def dedup_12h(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", id: str = "id", hours: float = 12, max_group: int = 2000
) -> DataFrame:
    """Drop a row when one of the same key was *kept* at most ``hours`` before it.

    Rows of one key and instant are reduced to the lowest id first. A key with at most
    ``max_group`` instants is folded as one sorted array. A larger key is cut into days
    which are solved side by side: each day is summarised as a step function "enter after x,
    leave at y", a prefix scan composes them, and every day is then walked from its true entry.
    The trade log's clock has whole seconds, so a key's day holds at most 86 400 instants.
    """
    gap = int(hours * 3_600_000_000)
    points = df.groupBy(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).agg(F.min(id).alias("_id"))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(sizes.where(F.col("_n") > max_group).select(*keys))
    some = not hot.isEmpty()
    cold = points.join(hot, keys, "left_anti") if some else points
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        keep = acc["last"].isNull() | (x["t"] - acc["last"] > gap)
        taken = F.struct(x["t"].alias("last"), F.concat(acc["kept"], F.array(x["id"])).alias("kept"))
        return F.when(keep, taken).otherwise(acc)

    ordered = F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_id").cast("bigint").alias("id"))))
    folded = cold.groupBy(*keys).agg(ordered.alias("a")).select(F.explode(F.aggregate("a", start, step)["kept"]).alias(id))
    kept = folded.unionByName(_dedup_by_day(points.join(hot, keys, "left_semi"), keys, gap, id)) if some else folded
    return df.join(kept, [id], "left_semi")


def _next_after(t: np.ndarray, gap: int) -> np.ndarray:
    return np.searchsorted(t, t + gap, side="right")


def _dedup_by_day(points: DataFrame, keys: Sequence[str], gap: int, id: str) -> DataFrame:
    keys = list(keys)
    span = max(gap, 86_400_000_000)
    days = points.withColumn("_day", F.floor(F.col("_t") / F.lit(span)).cast("bigint"))
    key_fields = [f for f in days.schema.fields if f.name in keys]

    def out(*extra: str) -> T.StructType:
        return T.StructType([*key_fields, *[T.StructField(n, T.LongType()) for n in extra]])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        """For every possible entry of the day: the last row kept, equal ones merged."""
        t = np.sort(pdf["_t"].to_numpy())
        nxt, last = _next_after(t, gap), np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                last[i] = last[nxt[i]]
        entries = min(len(t), int(np.searchsorted(t, pdf["_day"].iloc[0] * span + gap, side="right")) + 1)
        leave = t[last[:entries]]
        ends = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))
        r = pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys})
        return r.assign(_day=pdf["_day"].iloc[0], _upto=[t[ends].tolist()], _leave=[leave[ends].tolist()])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        t, nxt = pdf["_t"].to_numpy(), _next_after(pdf["_t"].to_numpy(), gap)
        i, kept = int(np.searchsorted(t, pdf["_after"].iloc[0], side="right")), []
        while i < len(t):
            kept.append(i)
            i = int(nxt[i])
        return pd.DataFrame({id: pdf["_id"].to_numpy()[kept]})

    steps = T.StructType([*out("_day").fields, *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("_upto", "_leave")]])
    parts = days.groupBy(*keys, "_day").applyInPandas(summarise, steps)
    started = days.join(_entries(parts, keys, gap), [*keys, "_day"], "inner")
    return started.groupBy(*keys, "_day").applyInPandas(walk, T.StructType([T.StructField(id, T.LongType())]))


def _composed(before: tuple[list[int], list[int]], after: tuple[list[int], list[int]], gap: int) -> tuple[list[int], list[int]]:
    """Two step functions "enter after x below ``upto``, leave at ``leave``" one after the other, equal steps merged."""
    upto, leave = [], []
    for u, v in zip(*before):
        i = bisect_right(after[0], v + gap)
        upto.append(u)
        leave.append(after[1][i] if i < len(after[0]) else v)
    i = bisect_right(after[0], before[0][-1])
    upto, leave = upto + after[0][i:], leave + after[1][i:]
    kept = [j for j in range(len(upto)) if j + 1 == len(upto) or leave[j] != leave[j + 1]]
    return [upto[j] for j in kept], [leave[j] for j in kept]


def _entries(parts: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, _day, _after): the instant after which each day is entered, by a prefix scan over the days of a key.

    Composing step functions is associative: in round r each day's function takes in that of 2^r days before, so
    log2(days) rounds of equi-joins give the functions of all days up to each one. No task holds a key.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_day"))  # one short row a day
    numbers = materialize(parts.select(*keys, "_day").withColumn("_i", place))
    scan = materialize(parts.join(numbers, [*keys, "_day"]))
    most = numbers.agg(F.max("_i")).first()[0] or 0

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [
                (list(u), list(v)) if pu is None else _composed((list(pu), list(pv)), (list(u), list(v)), gap)
                for u, v, pu, pv in zip(pdf["_upto"], pdf["_leave"], pdf["_pu"], pdf["_pv"])
            ]
            yield pdf.drop(columns=["_pu", "_pv"]).assign(_upto=[x[0] for x in both], _leave=[x[1] for x in both])

    reach = 1
    while reach < most:
        earlier = scan.select(*keys, (F.col("_i") + reach).alias("_i"), F.col("_upto").alias("_pu"), F.col("_leave").alias("_pv"))
        scan = materialize(scan.join(earlier, [*keys, "_i"], "left").select(*scan.columns, "_pu", "_pv").mapInPandas(compose, scan.schema))
        reach *= 2
    # a first day is entered after nothing; any other one after what the days before it leave
    left = scan.select(*keys, (F.col("_i") + 1).cast("int").alias("_i"), (F.element_at("_leave", 1) + F.lit(gap)).alias("_after"))
    return numbers.join(left, [*keys, "_i"], "left").select(*keys, "_day", F.coalesce("_after", F.lit(-(2**62)).cast("long")).alias("_after"))
