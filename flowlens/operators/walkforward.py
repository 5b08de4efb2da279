"""Walk-forward folds and predictions: every fold is fitted on all earlier rows, in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from flowlens.functions import signals as sg
from flowlens.functions.pricing import lit
from flowlens.operators.model import CELL, EVERY, MIN_ROWS, return_counts, score, with_cell, with_every
from flowlens.operators.scale import large, materialize, number_rows
from flowlens.schemas import QUANTILES

BLOCK = 16  # folds
SPAN = 65_536  # rows of a span of folds, at least


def folds(trades: DataFrame, train: int = 500, increment: int = 500) -> DataFrame:
    """Rows in time order with ``idx`` and ``fold``; the first ``train`` rows have fold -1.

    Too few rows for one full fold is an error, as there is nothing to test.
    """
    rows = number_rows(trades, ["ts", "id"])
    if rows.count() < train + increment:  # a count of the table that was just written
        raise ValueError("too few rows for a walk-forward")
    fold = F.when(F.col("idx") < train, F.lit(-1).cast("bigint")).otherwise(F.floor((F.col("idx") - train) / lit(increment)))
    return rows.withColumn("fold", fold.cast("int"))


def fold_bounds(rows: DataFrame) -> DataFrame:
    """First and last position and time of every tested fold, and its number of training rows."""
    return rows.where(F.col("fold") >= 0).groupBy("fold").agg(
        F.min("idx").alias("train_rows"), F.count(F.lit(1)).alias("test_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def with_available(rows: DataFrame, purge: bool = False) -> DataFrame:
    """Add ``avail``, the first fold a row may train: the one after its own.

    With ``purge`` the row must also have been settled (``evaluation_date``) before the
    first trade of that fold.
    """
    if not purge:
        return rows.withColumn("avail", F.col("fold") + 1)
    starts = rows.where(F.col("fold") >= 0).groupBy("fold").agg(F.min("trade_date").alias("evaluation_date"))
    marks = starts.groupBy("evaluation_date").agg(F.count(F.lit(1)).alias("k"))
    days = rows.where(F.col("evaluation_date").isNotNull()).select("evaluation_date", F.lit(0).cast("bigint").alias("k"))
    per_day = days.unionByName(marks).groupBy("evaluation_date").agg(F.sum("k").alias("k"))
    begun = F.sum("k").over(W.orderBy("evaluation_date").rowsBetween(W.unboundedPreceding, 0))  # one row per day
    settled = per_day.select("evaluation_date", begun.cast("int").alias("_settled"))
    j = rows.join(settled, ["evaluation_date"], "left")
    return j.withColumn("avail", F.greatest(F.col("fold") + 1, F.coalesce("_settled", F.lit(0)))).drop("_settled")


def counts_at(h: DataFrame, wanted: DataFrame, n_folds, keys: Sequence[str] = ("cell", "b")) -> DataFrame:
    """The wanted rows (``keys`` and fold) with y and c: counts of each value of rows available at the fold.

    Rows are counted up to the first wanted fold that sees them, and running counts are
    repeated for wanted folds only, so nothing is made that is not returned.
    """
    keys = list(keys)
    times = h.where(F.col("avail") < n_folds).select(*keys, "avail", F.lit(0).alias("_mark"))
    times = times.unionByName(wanted.select(*keys, F.col("fold").alias("avail"), F.lit(1).alias("_mark")))
    times = times.groupBy(*keys, "avail").agg(F.max("_mark").alias("_mark"))
    earlier = F.sum("_mark").over(W.partitionBy(*keys).orderBy("avail").rowsBetween(W.unboundedPreceding, -1))  # one row per fold
    times = times.withColumns({"_i": F.coalesce(earlier, F.lit(0)), "_all": F.sum("_mark").over(W.partitionBy(*keys))})
    seen = h.join(large(times.where("_i < _all").drop("_mark")), [*keys, "avail"])
    parts = seen.groupBy(*keys, "y", "_i").agg(F.sum("c").alias("c"), F.max("_all").alias("_all"))
    by_value = W.partitionBy(*keys, "y").orderBy("_i")
    so_far = F.sum("c").over(by_value.rowsBetween(W.unboundedPreceding, 0))
    until = F.coalesce(F.lead("_i").over(by_value), F.col("_all")) - 1
    held = parts.select(*keys, "y", so_far.alias("c"), "_i", until.alias("_to"))
    held = held.select(*keys, "y", "c", F.explode(F.sequence("_i", "_to")).alias("_i"))
    numbered = times.where("_mark = 1").select(*keys, F.col("avail").alias("fold"), "_i")
    return wanted.join(large(numbered), [*keys, "fold"]).join(large(held), [*keys, "_i"]).drop("_i")


def with_span(counts: DataFrame, n_folds) -> DataFrame:
    """Rows available at some fold, with the first fold of their ``span``, a run of whole blocks of folds of their
    cell, and ``until``, the last fold before the cell's next block.

    A span has about as many rows as its cell has distinct values, ``SPAN`` at least. So the
    counts of all values before each span are together no more than the rows.
    """
    h = counts.where(F.col("avail") < n_folds).withColumn("_block", F.floor(F.col("avail") / BLOCK))
    blocks = h.groupBy("cell", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("avail").alias("_first"))
    values = h.groupBy("cell").agg(F.greatest(F.approx_count_distinct("y"), F.lit(SPAN)).alias("_most"))
    by_cell = W.partitionBy("cell").orderBy("_block")  # one row per block
    before = F.coalesce(F.sum("_rows").over(by_cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    until = (F.coalesce(F.lead("_first").over(by_cell), n_folds) - 1).cast("int")
    spans = blocks.join(large(values), "cell").select("cell", "_block", "_first", F.floor(before / F.col("_most")).alias("_span"), until.alias("until"))
    spans = spans.select("cell", "_block", "until", F.min("_first").over(W.partitionBy("cell", "_span")).alias("span"))
    return h.join(large(spans), ["cell", "_block"]).drop("_block")


def at_ranks(code: np.ndarray, weight: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each end and rank (from 0, by weight) the code of that rank among the rows before the end.

    Codes are found bit by bit, the highest first: rows are dealt into those without and with
    the bit, in order, and the weight without it tells where a rank goes on.
    """
    found, start, end = np.zeros_like(ends), np.zeros_like(ends), ends
    for bit in reversed(range(int(code.max()).bit_length())):
        one = (code >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        held = np.concatenate(([0], np.cumsum(np.where(one, 0, weight))))
        low = held[end] - held[start]
        up = ranks >= low
        ranks = np.where(up, ranks - low, ranks)
        found |= up.astype(np.int64) << bit
        start, end = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (start, end))
        order = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
        code, weight = code[order], weight[order]
    return found


def _span_quantiles(probs: Sequence[float]):
    def of(rows: pa.Table, prior: pa.Table) -> pa.Table:
        """Quantiles at each fold of one span that brings rows; ``last`` is the fold up to which they hold."""
        rows = rows.sort_by("avail")
        avail = rows["avail"].to_numpy().astype(np.int64)
        values, code = np.unique(np.concatenate((prior["y"].to_numpy(), rows["y"].to_numpy())), return_inverse=True)
        weight = np.concatenate((prior["c"].to_numpy(), rows["c"].to_numpy()))
        ends = np.append(np.flatnonzero(np.diff(avail)) + 1, len(avail))
        folds = avail[ends - 1]
        last = np.append(folds[1:] - 1, rows["until"].to_numpy()[-1])
        n = np.cumsum(weight)[len(prior) + ends - 1]
        pos = np.array(probs) * (n[:, None] - 1)
        ranks = np.stack((np.floor(pos), np.ceil(pos)))
        wide = np.broadcast_to((len(prior) + ends)[:, None], ranks.shape)
        low, high = values[at_ranks(code, weight, wide.ravel(), ranks.astype(np.int64).ravel())].reshape(ranks.shape)
        q = low + (high - low) * (pos - ranks[0])
        lists = pa.ListArray.from_arrays(np.arange(0, q.size + 1, len(probs), dtype=np.int32), q.ravel())
        cell = pa.array([rows["cell"][0].as_py()] * len(folds), pa.string())
        return pa.table({"cell": cell, "fold": folds.astype(np.int32), "last": last.astype(np.int32), "n": n, "q": lists})

    return of


def expanding_quantiles(counts: DataFrame, n_folds, probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles of all rows with ``avail`` <= fold, per cell, for every fold.

    ``counts`` has cell, avail, y and c. Repeating every row for all its later folds would
    cost rows x folds / 2, and running counts of all values at all folds as much as values x folds.
    Instead the folds of a cell are cut into spans of many rows. The counts of all values are
    made once per span, and a task that has them and the rows of one span finds the quantiles of each
    of its folds. Rows and counts are moved a fixed number of times, so the work and the files
    grow with the rows.
    """
    rows = materialize(with_span(counts, n_folds))
    h = rows.groupBy("cell", F.col("span").alias("avail"), "y").agg(F.sum("c").alias("c"))
    before = rows.select("cell", (F.col("span") - 1).alias("fold")).distinct()
    prior = counts_at(h, before, n_folds, ["cell"]).select("cell", F.col("fold") + 1, "y", "c")
    prior = prior.toDF("cell", "span", "y", "c")  # columns of its own, as both sides come from one table
    both = rows.groupBy("cell", "span").cogroup(prior.groupBy("cell", "span"))
    found = both.applyInArrow(_span_quantiles(probs), "cell string, fold int, last int, n bigint, q array<double>")
    return found.select("cell", F.explode(F.sequence("fold", "last")).alias("fold"), "n", "q")


def expanding_sketches(counts: DataFrame, rows: DataFrame, n_folds, probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Approximate variant: one KLL sketch per (cell, avail), merged over the earlier ones.

    Sketches are merged into spans of 1, 2, 4, ... folds; the folds up to a given one are the
    spans of the binary digits of their number. A sketch and a fold take part in log2(folds)
    merges. ``rows`` holds cell, avail and y per trade; ``counts`` only names the cells.
    """
    sketches = rows.groupBy("cell", "avail").agg(F.expr("kll_sketch_agg_double(y)").alias("s")).where(F.col("avail") < n_folds)
    levels = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(n_folds + 1)).cast("int"))).alias("level")
    spans = sketches.select("cell", "avail", "s", levels).groupBy("cell", "level", F.expr("shiftright(avail, level)").alias("span"))
    spans = spans.agg(F.expr("kll_merge_agg_double(s)").alias("s"))
    folds_ = counts.select("cell").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), n_folds - 1)))
    digits = folds_.select("cell", "fold", levels).where("shiftright(fold + 1, level) % 2 = 1").withColumn("span", F.expr("shiftright(fold + 1, level) - 1"))
    merged = digits.join(large(spans), ["cell", "level", "span"]).groupBy("cell", "fold").agg(F.expr("kll_merge_agg_double(s)").alias("s"))
    q = ", ".join(f"kll_sketch_get_quantile_double(s, cast({p} as double))" for p in probs)
    return merged.select("cell", "fold", F.expr("kll_sketch_get_n_double(s)").alias("n"), F.expr(f"array({q})").alias("q"))


def walkforward_models(
    rows: DataFrame, purge: bool = False, keys: Sequence[str] = CELL, min_rows: int = MIN_ROWS, method: str = "exact"
) -> DataFrame:
    """One quantile row per fold and cell; small cells carry the fold's overall quantiles.

    ``rows`` comes from ``folds``. The model table is written to the shared folder; it does
    not depend on strategy parameters, so one copy serves a whole sweep.
    """
    x = with_cell(with_available(rows, purge), keys)
    n_folds = x.select((F.max("fold") + 1).alias("k")).scalar()
    counts = with_every(return_counts(x, ["avail"]), ["cell", "avail", "y"])
    counts = materialize(counts)
    if method == "exact":
        fitted = expanding_quantiles(counts, n_folds)
    else:
        both = x.select(F.explode(F.array("cell", F.lit(EVERY))).alias("cell"), "avail", F.col("observed_return").alias("y"))
        fitted = expanding_sketches(counts, both, n_folds)
    fitted = materialize(fitted)
    cells = counts.where(F.col("cell") != EVERY).groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    whole = fitted.where(F.col("cell") == EVERY).select("fold", F.col("n").alias("_n_all"), F.col("q").alias("_q_all"))
    grid = cells.withColumn("fold", F.explode(F.sequence(F.lit(0), n_folds - 1))).select("cell", "fold")
    own = fitted.where((F.col("cell") != EVERY) & (F.col("n") >= min_rows))
    m = grid.join(large(own), ["cell", "fold"], "left").join(large(whole), "fold", "left")
    m = m.select("fold", "cell", F.coalesce("n", "_n_all").alias("train_rows"), F.coalesce("q", "_q_all").alias("q"))
    return materialize(m)


def walkforward_predict(
    rows: DataFrame,
    purge: bool = False,
    keys: Sequence[str] = CELL,
    min_rows: int = MIN_ROWS,
    target: float = 0.025,
    method: str = "exact",
) -> DataFrame:
    """Out-of-sample quantiles and success probability of all tested rows."""
    models = walkforward_models(rows, purge, keys, min_rows, method)
    tested = with_cell(rows.where(F.col("fold") >= 0), keys)
    j = tested.join(large(models), ["fold", "cell"], "left")
    return j.withColumn("q", sg.monotonic("q")).withColumn("p_success", sg.p_success("q", target))


def in_sample_predict(df: DataFrame, cells: DataFrame, confirm: bool = False, target: float = 0.025) -> DataFrame:
    """Predictions by a model that has seen these rows; has to be asked for explicitly."""
    if not confirm:
        raise ValueError("in-sample results are indicative only; pass confirm=True")
    x = score(df, cells).withColumn("q", sg.monotonic("q"))
    return x.withColumns({"p_success": sg.p_success("q", target), "in_sample": F.lit(True)})
