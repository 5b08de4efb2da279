"""The updatable store: labels written back by partition, interrupted updates, idempotent loads."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from flowlens.operators import labels as lb
from flowlens.operators.scale import materialize
from flowlens.plans import queries as reg
from flowlens.sources import store, tables as tb

LABELS = ["id", *lb.LABELS]


@pytest.fixture(scope="module")
def tables(spark, sf):
    return materialize(reg.trades(spark, sf)), materialize(reg.bars(spark, sf))


def rows(df):
    return sorted(tuple(r) for r in df.select(*LABELS).collect())


def files(df):
    return {f for f in df.inputFiles()}


def test_labels_are_written_back_by_partition(spark, tables, tmp_path):
    trades, bars = tables
    path = f"{tmp_path}/t"
    store.create(trades, path)
    before = files(store.stored(spark, path))
    n = store.merge_labels(spark, path, bars, reg.EARLY)
    assert n > 0 and rows(store.stored(spark, path)) == rows(lb.label_trades(trades, bars, reg.EARLY))
    after = files(store.stored(spark, path))
    touched = {f.split("trade_month=")[1].split("/")[0] for f in before ^ after}
    months = {str(r[0]) for r in lb.label_trades(trades, bars, reg.EARLY).where("labeled").select(store.month_of()).distinct().collect()}
    assert touched == months and n == len(months) and len(before & after) > 0
    # again: nothing is left to do
    assert store.merge_labels(spark, path, bars, reg.EARLY) == 0 and files(store.stored(spark, path)) == after
    store.merge_labels(spark, path, bars, reg.AS_OF)
    assert rows(store.stored(spark, path)) == rows(lb.label_trades(trades, bars, reg.AS_OF))
    # labels of the real population anew, at another threshold
    store.merge_labels(spark, path, bars, reg.AS_OF, threshold=0.10, force=True)
    again = lb.label_trades(lb.reset_labels(lb.label_trades(trades, bars, reg.AS_OF)), bars, reg.AS_OF, threshold=0.10)
    assert rows(store.stored(spark, path)) == rows(again)


@pytest.mark.parametrize("lost", [False, True])
def test_an_interrupted_update_is_finished_by_the_next_call(spark, tables, tmp_path, monkeypatch, lost):
    trades, bars = tables
    path = f"{tmp_path}/t"
    store.create(trades, path)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_apply", stop)
        with pytest.raises(RuntimeError):
            store.merge_labels(spark, path, bars, reg.EARLY)
    assert rows(store.stored(spark, path)) == rows(trades)
    if lost:  # the driver went after a partition had been removed
        month = lb.label_trades(trades, bars, reg.EARLY).where("labeled").select(store.month_of()).first()[0]
        shutil.rmtree(f"{path}/trade_month={month}")
    assert store.merge_labels(spark, path, bars, reg.EARLY) == 0
    assert rows(store.stored(spark, path)) == rows(lb.label_trades(trades, bars, reg.EARLY))
    assert store.recover(spark, path) == 0


def test_a_failure_before_the_copy_is_noted_changes_nothing(spark, tables, tmp_path, monkeypatch):
    trades, bars = tables
    path = f"{tmp_path}/t"
    store.create(trades, path)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_note", stop)
        with pytest.raises(RuntimeError):
            store.merge_labels(spark, path, bars, reg.EARLY)
    assert store.recover(spark, path) == 0 and rows(store.stored(spark, path)) == rows(trades)
    assert store.merge_labels(spark, path, bars, reg.EARLY) > 0


def test_loads_are_idempotent_and_read_few_partitions(spark, tables, tmp_path):
    trades, _ = tables
    path = f"{tmp_path}/t"
    first, all_ids = trades.where("id % 3 <> 0"), sorted(r.id for r in trades.select("id").collect())
    assert store.append_batch(spark, path, first).count() == first.count()
    assert store.append_batch(spark, path, first).count() == 0
    new = store.append_batch(spark, path, trades)
    assert sorted(r.id for r in new.select("id").collect()) == sorted(r.id for r in tb.append_new(trades, first).select("id").collect())
    assert sorted(r.id for r in store.stored(spark, path).select("id").collect()) == all_ids
    one = trades.where(F.col("ts") == trades.select(F.min("ts")).first()[0])
    where = store.candidates(spark, path, one.select(store._digest(tb.TRADE_KEY).alias("__digest")))
    assert len(where) == 1


def test_keys_that_are_null_and_index_entries_without_rows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 5)
    batch = spark.createDataFrame([(1, at, None, 5.0), (2, at, "A", None)], "id long, ts timestamp, ticker string, strike double")
    path, keys = f"{tmp_path}/t", ("ts", "ticker", "strike")
    full = batch.withColumn("trade_month", store.month_of()).withColumn("__digest", store._digest(keys))
    store._write_index(full, path, "trade_month")  # an earlier load got no further than its index
    store._replace(full.drop("__digest").where("id = 2"), path, "trade_month", "append")
    assert [r.id for r in store.append_batch(spark, path, batch, keys).collect()] == [1]
    assert store.append_batch(spark, path, batch, keys).count() == 0
