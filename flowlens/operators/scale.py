"""Shared building blocks that keep the operators distributed.

Two problems come back in this library: numbering rows in a total order, and order
statistics (running totals by value, quantiles) of groups that may hold a large part of the
table. Each has one solution here, and none of them puts a whole group into one task.
Joins on uneven keys are plain equi-joins: Spark broadcasts what is small at run time and
splits skewed partitions (adaptive execution).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens.session import scratch_path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the table.

    Later steps see fixed rows whatever executors are lost, read only the columns they
    need, and Spark knows the real size when it picks a join.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is sorted and merged, whatever its size in bytes.

    Adaptive execution broadcasts a side whose shuffle files are small. Rows that repeat a
    few values for every fold take next to nothing there, and far more as a hash table, which
    the driver would have to hold.
    """
    return df.hint("merge")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "idx", slices: int | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order``.

    Range partitioning spreads the rows evenly, each slice is sorted on its own, and the
    slice sizes (one row per slice) give the offsets. The numbered slices are written once,
    because offsets and rows must come from the same partitioning. ``order`` has to be
    unique, so that a slice boundary can fall inside any run of equal leading columns.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = materialize(
        df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    )
    slice_no, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = packed.groupBy(slice_no.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_slice", before.alias("_off"))
    return (
        packed.withColumn("_slice", slice_no)
        .join(F.broadcast(offsets), "_slice")  # at most ``slices`` rows
        .withColumn(name, F.col("_off") + within)
        .drop("_slice", "_off", "_m")
    )


def value_bucket(value: Column, per_octave: int = 256) -> Column:
    """A bucket number that grows with ``value``: sign, then steps of 1/per_octave of log2.

    The rule depends on the value alone, so every branch and every retry of a plan puts a
    row into the same bucket. Values must be finite.
    """
    # 1075 octaves below 1.0 is the smallest positive double
    size = (F.floor(F.log2(F.abs(value)) * F.lit(float(per_octave))) + F.lit(1075 * per_octave)).cast("bigint")
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(F.when(value > 0, size).otherwise(-size))


def running_totals(
    hist: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], per_octave: int = 256
) -> DataFrame:
    """Running totals of ``sums`` by ascending ``value`` inside each group.

    ``hist`` holds one row per (group, value). Totals are taken per value bucket, summed up
    over the few buckets of a group, and completed inside each bucket, so the largest
    ordered unit is one bucket of distinct values and not the group. Adds ``cum_<s>``
    (inclusive) and ``tot_<s>``.
    """
    groups = list(groups)
    parts = groups or ["_all"]
    b = hist if groups else hist.withColumn("_all", F.lit(0))
    b = b.withColumn("_b", value_bucket(F.col(value), per_octave))
    per = b.groupBy(*parts, "_b").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    by_bucket = W.partitionBy(*parts).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parts)
    per = per.select(
        *parts,
        "_b",
        *[F.coalesce(F.sum(f"_s_{s}").over(by_bucket), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    inside = W.partitionBy(*parts, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    b = b.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    out = b.join(per, [*parts, "_b"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_off_{s}") + F.col(f"_in_{s}"))
    return out.drop("_b", "_all", *[f"_off_{s}" for s in sums], *[f"_in_{s}" for s in sums])


def quantiles_of_counts(
    hist: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], count: str = "c"
) -> DataFrame:
    """Exact linear-interpolated quantiles per group from distinct values with counts.

    Returns the groups, ``n`` and ``q`` (one double per probability).
    """
    rt = running_totals(hist, groups, value, [count])
    upto, total = F.col(f"cum_{count}"), F.col(f"tot_{count}")
    before = upto - F.col(count)

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when((before <= rank) & (rank < upto), F.col(value))).alias(name)

    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (total - 1)
        picks += [at(F.floor(pos), f"_lo{i}"), at(F.ceil(pos), f"_hi{i}")]
    out = rt.groupBy(*groups).agg(F.max(total).alias("n"), *picks)
    n = F.col("n")
    q = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (n - 1)
        q.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos)))
    return out.select(*groups, "n", F.array(*q).alias("q"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of ``value`` per group; NULL and non-finite values are left out."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    hist = df.where(ok).groupBy(*groups, v.alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    return quantiles_of_counts(hist, groups, "_v", probs)
