"""Sliding windows on fine bars, where one ticker may hold most of the rows.

Rows are numbered in the total order (key, time) and cut into blocks of equal size. The last ``width`` - 1 rows of a
block are repeated in front of the next one, so that every window of ``width`` rows lies in the block of its last row.
Blocks, and not tickers, are the ordered units, so no task grows with a ticker.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from flowlens.functions.pricing import lit
from flowlens.operators.scale import number_rows
from flowlens.operators.vol import ANNUAL

BLOCK_ROWS = 100_000


def sliding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, values: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK_ROWS
) -> DataFrame:
    """Add columns over the rows of the same key up to ``width`` - 1 rows before.

    ``values`` gets the ordered window of a block and key, and returns columns whose frames reach back at most that
    far. (keys, order) has to be unique.
    """
    block = max(block, width)
    rows = number_rows(df, [*keys, *order], "__i").withColumn("__own", F.expr(f"__i div {block}"))
    late = F.col("__i") % block > block - width
    blocks = F.when(late, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array(F.col("__own")))
    rows = rows.withColumn("__block", F.explode(blocks))
    window = W.partitionBy("__block", *keys).orderBy("__i")
    return rows.withColumns(values(window)).where("__block = __own").drop("__i", "__own", "__block")


def garman_klass(bars: DataFrame, at: str, window: int = 20, block: int = BLOCK_ROWS) -> DataFrame:
    """``vol.garman_klass`` on bars of any fineness, one per ticker and ``at``."""
    range2 = F.pow(F.log(F.try_divide("high", "low")), 2)
    body2 = F.pow(F.log(F.try_divide("close", "open")), 2)
    x = bars.withColumn("_v", lit(0.5) * range2 - lit(2 * math.log(2) - 1) * body2)

    def value(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(1 - window, 0)
        return {"gk_vol": F.when(F.count("_v").over(frame) >= 5, F.sqrt(F.greatest(F.avg("_v").over(frame), lit(1e-6))) * ANNUAL).otherwise(lit(0.25))}

    return sliding(x, ["ticker"], [at], window, value, block).drop("_v")


def sma_flags(bars: DataFrame, at: str, span: str = "365 days", block: int = BLOCK_ROWS) -> DataFrame:
    """``vol.sma_flags`` on bars of any fineness: the newest bar against its 50- and 200-bar averages."""
    newest = bars.groupBy("ticker").agg(F.max(at).alias("_newest"))
    recent = bars.join(newest, "ticker").where(F.col(at) > F.col("_newest") - F.expr(f"interval {span}"))

    def value(w: WindowSpec) -> dict[str, Column]:
        return {f"_s{n}": F.avg("close").over(w.rowsBetween(1 - n, 0)) for n in (50, 200)}

    x = sliding(recent.select("ticker", at, "close"), ["ticker"], [at], 200, value, block)
    last = x.groupBy("ticker").agg(F.count("close").alias("n"), *[F.max_by(c, at).alias(c) for c in ("close", "_s50", "_s200")])
    return last.select("ticker", *[F.when(F.col("n") >= n, F.col("close") > F.col(f"_s{n}")).alias(f"above{n}") for n in (50, 200)])
