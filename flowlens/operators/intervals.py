"""Joins on time at full resolution: the latest quote before each row, and points inside intervals.

Both spread the work by time, so that one hot key is many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens.operators.scale import large, materialize

#: Interval lengths share a bin width in groups of so many powers of two.
OCTAVES = 2


def micros(at: Column) -> Column:
    """Instants as whole microseconds."""
    return F.unix_micros(at.cast("timestamp"))


def asof_tick(
    rows: DataFrame, quotes: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], quote_at: str | None = None, slices: int | None = None
) -> DataFrame:
    """Rows with the ``values`` of the latest quote of their key at or before ``at``; NULL before the first.

    Quotes and rows are range-partitioned by (key, time) into slices of about equal size, a quote before a row of the
    same instant, and written once. Within a slice the last quote is carried forward; what was last at the end of
    each slice is carried over slices (one row per slice and key in it). So a key with all rows is many slices.
    Of several quotes at one instant the largest by ``values`` counts; a row or quote without key or time meets nothing.
    """
    spark = rows.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, quote_at = list(keys), quote_at or at
    value = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    q = quotes.select(*keys, micros(F.col(quote_at)).alias("__t"), F.lit(0).alias("__tag"), value.alias("__v"))
    row = F.struct(*[F.col(c) for c in rows.columns])
    r = rows.select(*keys, micros(F.col(at)).alias("__t"), F.lit(1).alias("__tag"), row.alias("__r"))
    both = q.unionByName(r, allowMissingColumns=True)
    order = [*keys, "__t", "__tag", "__v", "__h"]
    both = both.withColumn("__h", F.xxhash64("__r"))  # rows of one instant may part between slices
    packed = materialize(both.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    packed = packed.withColumn("__slice", F.shiftright("__m", 33))
    known = F.lit(True)
    for k in [*keys, "__t"]:
        known = known & F.col(k).isNotNull()
    quote = F.when((F.col("__tag") == 0) & known, F.col("__v"))
    inside = W.partitionBy("__slice", *keys).orderBy("__m").rowsBetween(W.unboundedPreceding, 0)
    ends = packed.groupBy("__slice", *keys).agg(F.max_by("__v", F.when(quote.isNotNull(), F.col("__m"))).alias("__end"))
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("__slice", *keys, F.last("__end", ignorenulls=True).over(earlier).alias("__carry")).where("__carry is not null")
    found = packed.withColumn("__own", F.last(quote, ignorenulls=True).over(inside)).where("__tag = 1")
    out = found.join(carried, ["__slice", *keys], "left").withColumn("__v", F.when(known, F.coalesce("__own", "__carry")))
    return out.select("__r.*", *[F.col(f"__v.v{i}").alias(v) for i, v in enumerate(values)])


def placed(points: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points and the two ends of every interval in the order of (keys, time), with ``__rank``, the points before each.

    A start comes before the points of its instant and an end after them. The sorted slices are written once; their
    numbers of points (one row per slice) give the offsets.
    """
    spark = points.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    ends = F.explode(F.array(*[F.struct(F.col(t).alias("__t"), F.lit(tag).alias("__tag")) for t, tag in (("__a", 0), ("__b", 2))]))
    edges = intervals.where(known).withColumn("__edge", ends).select(*keys, "__edge.__t", "__edge.__tag", "__id")
    both = points.where(known & F.col("__t").isNotNull()).withColumn("__tag", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    order = [*keys, "__t", "__tag", "__h"]  # the hash cuts runs of one instant and kind; among them any order will do
    both = both.withColumn("__h", F.xxhash64(*both.columns))
    packed = materialize(both.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    packed = packed.withColumn("__slice", F.shiftright("__m", 33))
    point = (F.col("__tag") == 1).cast("bigint")
    sizes = packed.groupBy("__slice").agg(F.sum(point).alias("__n"))
    offset = F.coalesce(F.sum("__n").over(W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(point).over(W.partitionBy("__slice").orderBy("__m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = packed.withColumn("__rank", inside).join(F.broadcast(sizes.select("__slice", offset.alias("__off"))), "__slice")
    return ranked.withColumn("__rank", F.col("__rank") + F.col("__off")).drop("__slice", "__off", "__m", "__h")


def interval_totals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, totals: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Every interval that holds a point of its key, ends included, with ``totals`` over the points in it.

    ``totals`` names results as (count, sum, min or max; column of the points). The points of an interval are a run in
    the order of (keys, time). Runs are put together from blocks of 1, 2, 4, ... points that are totalled once, two of a
    length at most, so the work grows with points plus intervals (times the logarithm of a run) and not with their
    pairs. A sum is of whole blocks, never a difference, so values that are not finite stay where they are.
    """
    keys = list(keys)
    i = materialize(intervals.withColumns({"__a": micros(F.col(start)), "__b": micros(F.col(end))}).where("__a <= __b").withColumn("__id", F.monotonically_increasing_id()))
    own = [F.lit(1).cast("bigint").alias(f"__v{j}") if how == "count" and c == "*" else F.col(c).isNotNull().cast("bigint").alias(f"__v{j}") if how == "count" else F.col(c).alias(f"__v{j}") for j, (how, c) in enumerate(totals.values())]
    values = [f"__v{j}" for j in range(len(own))]
    ranked = materialize(placed(points.select(*keys, micros(F.col(at)).alias("__t"), *own), i.select(*keys, "__a", "__b", "__id"), keys))
    merged = [getattr(F, "sum" if how == "count" else how)(v).alias(v) for v, (how, _) in zip(values, totals.values())]
    found = ranked.where("__tag <> 1").groupBy("__id").agg(F.min("__rank").alias("__l"), F.max("__rank").alias("__r")).where("__l < __r")
    # from both ends inwards: at each length the odd block on the left and the one before an odd end on the right
    found = found.withColumn("__k", F.explode(F.expr("sequence(0, length(bin(__r - __l)))")))
    found = found.withColumns({"__l": F.expr("shiftright(__l + shiftleft(1L, __k) - 1, __k)"), "__r": F.expr("shiftright(__r, __k)")}).where("__l < __r")
    pieces = F.expr("filter(array(if(__l % 2 = 1, __l, null), if(__r % 2 = 1, __r - 1, null)), x -> x is not null)")
    found = found.select("__id", "__k", F.explode(pieces).alias("__block"))
    longest = found.agg(F.coalesce(F.max("__k"), F.lit(-1))).first()[0]  # at most 62
    row = ranked.where("__tag = 1").select("__rank", *values)
    blocks = row.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(longest)) if longest >= 0 else F.array().cast("array<int>")))
    blocks = blocks.groupBy("__k", F.expr("shiftright(__rank, __k)").alias("__block")).agg(*merged)
    sums = found.join(large(blocks), ["__k", "__block"]).groupBy("__id").agg(*merged)
    out = i.join(large(sums), "__id")
    return out.select(*intervals.columns, *[F.col(v).alias(name) for v, name in zip(values, totals)])


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, octaves: int = OCTAVES,
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Every point with every interval of its key that holds it, ends included, as (columns of both).

    Intervals are grouped by the power of two their length reaches; within a group time is cut into bins at least as
    wide as its intervals, so an interval lies in one bin or two next to each other, whatever its length. A point is in
    one bin of each group that occurs (a few, found from the data) and so meets each of its intervals exactly once.
    No row is repeated by the length of an interval. Without a time, or with the end before the start, nothing matches.
    Columns of the same name are taken from the points, but for the keys, which are equal. All pairs can be far more
    than both inputs; where only ``totals`` per interval are wanted they are not listed (``interval_totals``).
    """
    if totals is not None:
        return interval_totals(points, intervals, keys, at, start, end, totals)
    keys = list(keys)
    a, b = micros(F.col(start)), micros(F.col(end))
    i = intervals.withColumns({"__a": a, "__b": b}).where("__a <= __b")
    bits = F.length(F.bin(F.col("__b") - F.col("__a")))
    i = i.withColumn("__level", F.least((F.ceil(bits / F.lit(float(octaves))) * octaves).cast("int"), F.lit(62)))
    first, last = F.expr("shiftright(__a, __level)"), F.expr("shiftright(__b, __level)")
    # at most 64 / octaves numbers: the groups of lengths that occur
    levels = sorted(r[0] for r in i.select("__level").distinct().collect())
    i = i.withColumn("__bin", F.explode(F.sequence(first, last)))
    p = points.withColumn("__t", micros(F.col(at))).where("__t is not null")
    p = p.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", F.expr("shiftright(__t, __level)"))
    taken = {c.lower() for c in points.columns}
    i = i.select(*keys, "__level", "__bin", "__a", "__b", *[c for c in intervals.columns if c.lower() not in taken])
    met = p.join(i, [*keys, "__level", "__bin"]).where("__t between __a and __b")
    return met.select(*points.columns, *[c for c in intervals.columns if c.lower() not in taken])
