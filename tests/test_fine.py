"""Sliding windows on fine bars, and the top list of a stream."""

import datetime
import random

from pyspark.sql import functions as F

from flowlens.operators import fine, scan as sc, vol
from flowlens.operators.scale import number_rows
from flowlens.session import scratch_path
from flowlens.streaming import flow as st

DAY = datetime.date(2020, 1, 1)


def bars(spark, tickers, n):
    rng = random.Random(n)
    rows = []
    for t, m in tickers.items():
        for i in range(m):
            lo = rng.uniform(10, 20)
            hi = lo + rng.uniform(0.01, 5)
            rows.append((t, DAY + datetime.timedelta(days=i), rng.uniform(lo, hi), hi, lo, rng.uniform(lo, hi), 1))
    return spark.createDataFrame(rows, "ticker string, bar_date date, open double, high double, low double, close double, volume long")


def same(a, b, name):
    x, y = ({(r.ticker, r.bar_date): r[name] for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)


def test_equals_the_daily_operators_on_one_hot_ticker(spark):
    df = bars(spark, {"A": 900, "B": 3, "C": 60}, 1)
    for block in (20, 37, 10_000):
        same(fine.garman_klass(df, "bar_date", block=block), vol.garman_klass(df), "gk_vol")
    for block in (200, 301):
        assert sorted(fine.sma_flags(df, "bar_date", block=block).collect(), key=str) == sorted(vol.sma_flags(df).collect(), key=str)
    assert fine.garman_klass(df.where("false"), "bar_date").count() == 0


def test_no_task_grows_with_a_ticker(spark):
    df = spark.range(40_000).select(F.lit("A").alias("ticker"), F.timestamp_seconds("id").alias("at"), F.col("id").cast("double").alias("close"))
    x = fine.sliding(df, ["ticker"], ["at"], 50, lambda w: {"m": F.avg("close").over(w.rowsBetween(-49, 0)), "p": F.spark_partition_id()}, block=500)
    rows = x.groupBy("p").count().collect()
    sizes = sorted(r["count"] for r in rows)
    assert sum(sizes) == 40_000 and len(sizes) > 1 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert x.where((F.unix_timestamp("at") >= 49) & (F.abs(F.col("m") - (F.col("close") - 24.5)) > 1e-6)).isEmpty()
    assert number_rows(df, ["ticker", "at"]).count() == 40_000


def test_top_list_over_several_batches(spark):
    rng = random.Random(4)
    rows = [(f"T{rng.randrange(5)}", i, DAY + datetime.timedelta(days=i % 7), rng.choice([None, 1.0, 2.5, 3.0, round(rng.uniform(0, 9), 2)])) for i in range(600)]
    flow = spark.createDataFrame(rows, "ticker string, id long, day date, vol_oi_ratio double")
    src, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for part in range(3):
        flow.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(flow.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = st.stream_topk(stream, 40, ["ticker", "day", "id"], out, state, shards=3)
    run.awaitTermination()
    got = [tuple(r) for r in st.latest_topk(spark, out, flow.schema).orderBy(F.desc("vol_oi_ratio"), "ticker", "day", "id").collect()]
    assert got == [tuple(r) for r in sc.topk_unusual(flow, 40, ["ticker", "day", "id"]).collect()] and len(got) == 40
