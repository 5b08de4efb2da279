"""A partitioned trade table whose rows are updated in place: labels written back, batches loaded once.

Updates are copy-on-write by partition. The new rows of the touched partitions are written beside the table and
noted in a journal, then they replace those partitions (dynamic overwrite), and the journal notes that too. A job
that fails before the first note has changed nothing; one that fails later is finished by the next call, from the
copy that is complete. Partitions without a change keep their files. One writer at a time is assumed; a reader that
must not see a half-replaced table reads between calls.

Loads are idempotent by key. Beside each load lies an index of the keys it stored: sorted 64-bit digests with the
partition of the row, in files of ``INDEX_BUCKETS`` digest ranges. A batch reads the index ranges of its own digests
and then only the partitions where a digest was found, where the full key decides.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.operators.labels import LABELS, label_trades, reset_labels
from flowlens.operators.scale import materialize
from flowlens.sources.tables import TRADE_KEY

PARTITION = "trade_month"
INDEX_BUCKETS = 64


def _if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def month_of(ts: str = "ts") -> Column:
    return F.to_date(F.date_trunc("month", F.col(ts)))


def _replace(rows: DataFrame, path: str, partition: str, mode: str) -> None:
    spread = rows.hint("rebalance", partition)
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def create(trades: DataFrame, path: str, partition: str = PARTITION) -> None:
    """Write a new store; the partition is the month of ``ts`` unless the column is there."""
    full = trades if partition in trades.columns else trades.withColumn(partition, month_of())
    _replace(full, path, partition, "error")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _journal(spark: SparkSession, path: str) -> DataFrame | None:
    return _if_present(spark, f"{path}_journal")


def _note(spark: SparkSession, path: str, run: str, state: str, partition: str) -> None:
    row = [(run, state, partition, datetime.datetime.now(datetime.timezone.utc))]
    spark.createDataFrame(row, "run string, state string, partition string, at timestamp").coalesce(1).write.mode("append").parquet(f"{path}_journal")


def _apply(spark: SparkSession, path: str, run: str, partition: str) -> None:
    """Replace the partitions that the run's copy holds; may be repeated."""
    _replace(spark.read.parquet(f"{path}_runs/{run}"), path, partition, "overwrite")
    _note(spark, path, run, "applied", partition)


def recover(spark: SparkSession, path: str) -> int:
    """Finish updates that were copied but not noted as applied; returns their number."""
    journal = _journal(spark, path)
    if journal is None:
        return 0
    state = journal.groupBy("run", "partition").agg(F.max((F.col("state") == "applied").cast("int")).alias("done"), F.min("at").alias("at"))
    # one row per unfinished update; a single writer leaves one at most
    left = state.where("done = 0").orderBy("at").collect()
    for row in left:
        _apply(spark, path, row.run, row.partition)
    return len(left)


def _rewrite(spark: SparkSession, path: str, new: DataFrame, changed: Column, columns: Sequence[str], partition: str) -> int:
    """Replace the partitions of ``new`` that hold a changed row; ``new`` is the whole table with its new values."""
    # partition values are calendar units: a few thousand at most, whatever the number of rows
    touched = [r[0] for r in new.where(changed).select(partition).distinct().collect()]
    if not touched:
        return 0
    run = uuid.uuid4().hex
    # a list of values prunes the scan to the touched partitions
    _replace(new.where(F.col(partition).isin(touched)).select(*columns), f"{path}_runs/{run}", partition, "error")
    _note(spark, path, run, "copied", partition)
    _apply(spark, path, run, partition)
    return len(touched)


def merge_labels(
    spark: SparkSession, path: str, bars: DataFrame, as_of: datetime.datetime, horizon: int = 10, threshold: float = 0.03, force: bool = False,
    partition: str = PARTITION,
) -> int:
    """Write the labels of newly settled trades back to the store; returns the number of rewritten partitions.

    ``force`` labels the real population anew. A second call with the same arguments rewrites nothing.
    """
    recover(spark, path)
    old = stored(spark, path)
    marked = old.withColumns({f"__old_{n}": F.col(n) for n in LABELS})
    new = label_trades(reset_labels(marked) if force else marked, bars, as_of, horizon, threshold)
    changed = F.lit(False)
    for n in LABELS:
        changed = changed | ~F.col(n).eqNullSafe(F.col(f"__old_{n}"))
    return _rewrite(spark, path, new, changed, old.columns, partition)


def _digest(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])


def _write_index(rows: DataFrame, path: str, partition: str) -> None:
    index = rows.select("__digest", F.col(partition).cast("string").alias("held_in"), F.pmod("__digest", F.lit(INDEX_BUCKETS)).cast("int").alias("bucket")).distinct()
    index.repartition("bucket").sortWithinPartitions("bucket", "__digest").write.mode("append").partitionBy("bucket").parquet(f"{path}_keys")


def candidates(spark: SparkSession, path: str, digests: DataFrame) -> list[str]:
    """The partitions (as text) that may hold one of the digests; reads the index ranges of the digests alone."""
    index = _if_present(spark, f"{path}_keys")
    if index is None:
        return []
    # at most INDEX_BUCKETS numbers, and one text per calendar unit
    buckets = [r[0] for r in digests.select(F.pmod("__digest", F.lit(INDEX_BUCKETS)).cast("int")).distinct().collect()]
    held = index.where(F.col("bucket").isin(buckets)).join(digests, "__digest", "left_semi")
    return [r[0] for r in held.select("held_in").distinct().collect()]


def append_batch(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str] = TRADE_KEY, partition: str = PARTITION) -> DataFrame:
    """Load the rows of ``batch`` whose key is not stored yet; returns them.

    Keys that are null compare as equal. The index is written before the rows: if the load fails in between, the
    entries point at rows that are not there, which the comparison of full keys finds out on the next call.
    """
    full = batch if partition in batch.columns else batch.withColumn(partition, month_of())
    full = materialize(full.withColumn("__digest", _digest(keys)))
    digests = full.select("__digest").distinct()
    where = candidates(spark, path, digests)
    new = full
    if where:
        known = stored(spark, path).where(F.col(partition).cast("string").isin(where)).select(*keys).withColumn("__digest", _digest(keys))
        known = known.join(digests, "__digest", "left_semi").distinct()
        same = F.col("n.__digest") == F.col("k.__digest")
        for k in keys:
            same = same & F.col(f"n.`{k}`").eqNullSafe(F.col(f"k.`{k}`"))
        new = full.alias("n").join(known.alias("k"), same, "left_anti")
    new = materialize(new)
    if not new.isEmpty():
        _write_index(new, path, partition)
        _replace(new.drop("__digest"), path, partition, "append")
    return new.drop("__digest", *([] if partition in batch.columns else [partition]))
