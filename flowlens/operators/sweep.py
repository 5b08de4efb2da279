"""Parameter sweeps: the grid, all runs in one job, scores, winners, heat map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flowlens.functions.pricing import lit
from flowlens.operators import backtest as bt
from flowlens.operators.scale import materialize

MAX_GRID = 20


def param_grid(
    spark: SparkSession,
    kelly: tuple[float, float, float] = (0.1, 1.0, 0.2),
    stop: tuple[float, float, float] = (0.5, 2.5, 0.5),
    strategies: Sequence[str] = ("whale_quality",),
    **fixed,
) -> DataFrame:
    """Kelly multiplier x stop distance from (min, max, step), at most 20 combinations.

    A grid searches the stop distance, so the hard stop is off unless given.
    """

    def steps(low: float, high: float, step: float) -> list[float]:
        values, v = [], low
        while v <= high:
            values.append(v)
            v = round(v + step, 4)
        return values

    ks, ss = steps(*kelly), steps(*stop)
    if len(ks) * len(ss) > MAX_GRID:
        raise ValueError(f"{len(ks) * len(ss)} combinations, at most {MAX_GRID} allowed")
    sets = [
        {"strategy_type": name, "hard_stop_loss": 0.0, **fixed, "kelly_multiplier": k, "stop_lambda": s}
        for name in strategies for k in ks for s in ss
    ]
    return bt.params_frame(spark, sets)


def sweep(predictions: DataFrame, params: DataFrame, tier_a: DataFrame | None = None, horizon: int = 10) -> DataFrame:
    """Summary of every parameter set. The ledger is written once and read by both metric branches."""
    book = materialize(bt.run(predictions, params, tier_a, horizon))
    return bt.summary(book, predictions, params, horizon)


def sweep_score(summary: DataFrame) -> DataFrame:
    """Composite score; too few trades or a loss score below any profitable run."""
    n, ret = F.col("trades"), F.col("pnl_pct")

    def clip(e):
        return F.least(F.greatest(e, lit(0)), lit(100))

    fall = F.greatest(F.abs("max_drawdown_pct") - 15, lit(0)) * lit(1.5)
    full = (
        lit(0.50) * clip(F.col("sharpe") * 40) + lit(0.25) * clip(ret * 2) + lit(0.15) * F.least(n / lit(2), lit(100))
        + lit(0.10) * F.least(F.col("win_rate_pct"), lit(100)) - fall
    )
    score = F.when(n < 20, (n - 100).cast("double")).when(ret < 0, lit(-50) + ret * lit(0.1)).otherwise(full)
    return summary.withColumn("score", score)


def sweep_winner(scored: DataFrame) -> DataFrame:
    """Best run per strategy: enough trades and profit first, then fewer trades, then any."""
    tier = F.when((F.col("trades") >= 20) & (F.col("pnl_pct") > 0), 1).when(F.col("trades") >= 10, 2).otherwise(3)
    order = W.partitionBy("strategy_type").orderBy("tier", F.desc("score"), "run_id")  # one row per set
    x = scored.withColumn("tier", tier)
    return x.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def sweep_heatmap(scored: DataFrame, params: DataFrame, metric: str, stops: Sequence[float]) -> DataFrame:
    """Kelly multiplier (descending) x stop distance, with the lowest and highest value."""
    x = scored.join(params.select("run_id", "kelly_multiplier", "stop_lambda"), "run_id")
    ends = x.select(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi")).alias("e"))
    cells = x.groupBy("kelly_multiplier").pivot("stop_lambda", list(stops)).agg(F.max(metric))
    named = cells.select("kelly_multiplier", *[F.col(f"`{s}`").alias(f"stop_{str(s).replace('.', '_')}") for s in stops])
    named = named.withColumn("e", ends.scalar())
    return named.select("*", F.col("e.lo").alias("lowest"), F.col("e.hi").alias("highest")).drop("e").orderBy(F.desc("kelly_multiplier"))


def profitable(summary: DataFrame, min_trades: int = 30) -> DataFrame:
    """Profitable runs; the current rule sets also need ``min_trades`` trades."""
    legacy = F.col("strategy_type").startswith("_legacy_")
    return summary.where((F.col("pnl_pct") > 0) & (legacy | (F.col("trades") >= min_trades))).withColumn("legacy", legacy)
