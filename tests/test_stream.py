"""Streams fed with several files in time order equal the batch operators on their union."""

import datetime

from pyspark.sql import functions as F

from flowlens.operators import labels as lb
from flowlens.session import scratch_path
from flowlens.sources import adapters as ad
from flowlens.streaming import flow as st


def test_dedup_over_several_batches_equals_batch(spark, sf):
    e = ad._read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type")
    src, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for lo, hi in ((0, 10), (10, 20), (20, 31)):
        e.where((F.dayofmonth("ts") > lo) & (F.dayofmonth("ts") <= hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    kept = st.dedup_stream(stream, ["user_id", "event_type"], id="event_id")
    run = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    run = run.trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.lastProgress["batchId"] == 2
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    want = sorted(r.event_id for r in lb.dedup_12h(e, ["user_id", "event_type"], id="event_id").collect())
    assert got == want and len(want) == 811


def test_labels_over_several_batches_equal_batch(spark, sf):
    """Trades and bars in time order, in any split: what has passed its horizon equals the batch labels, the rest waits in state."""
    from flowlens.operators.scale import materialize
    from flowlens.plans import queries as reg
    from flowlens.streaming import settle

    trades, bars = (materialize(x.where("ticker in ('T01', 'T02')")) for x in (reg.trades(spark, sf), reg.bars(spark, sf)))
    cuts = ["1900-01-01", "1993-05-07", "1996-12-31", "2100-01-01"]
    t_dir, b_dir, out, state = (scratch_path(spark, n) for n in ("trades", "bars", "out", "state"))
    for lo, hi in zip(cuts, cuts[1:]):
        trades.where((F.col("trade_date") >= lo) & (F.col("trade_date") < hi)).coalesce(1).write.mode("append").parquet(t_dir)
        bars.where((F.col("bar_date") >= lo) & (F.col("bar_date") < hi)).coalesce(1).write.mode("append").parquet(b_dir)
    streams = [spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(p) for x, p in ((trades, t_dir), (bars, b_dir))]
    x = settle.settle_stream(*streams)
    run = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(x.schema).parquet(out).collect())
    last = max(trades.agg(F.max("ts")).first()[0], bars.agg(F.max(F.col("bar_date").cast("timestamp"))).first()[0])
    done = F.date_add("trade_date", 11).cast("timestamp") <= F.lit(last)
    want = lb.label_trades(trades, bars, datetime.datetime(2100, 1, 1)).where(done).select(*x.columns)
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 200
    # the state holds the open horizon alone
    open_days = bars.select("ticker", F.explode(F.sequence(F.date_sub("bar_date", 10), F.col("bar_date"))).alias("day")).where(F.date_add("day", 11).cast("timestamp") > F.lit(last))
    open_days = open_days.union(trades.where(~done).select("ticker", "trade_date")).distinct().count()
    windows = spark.read.format("statestore").option("stateVarName", "window").load(state).count()
    assert windows <= open_days
