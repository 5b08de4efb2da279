"""Audit tables that compare the synthetic and the real population of the trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.pricing import lit
from flowlens.operators.scale import exact_quantiles

POPULATION = "is_synthetic"
FEATURES = ("vol_oi_ratio", "implied_vol", "dte", "premium", "commission_per_contract")
LABEL_FEATURES = ("observed_return", "max_adverse_return")
CATEGORICAL = ("option_type", "side", "trend_alignment")
WHALE_THRESHOLDS = (2.0, 5.0, 8.0)
STAT_PROBS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, lit(0))


def numeric_long(trades: DataFrame, cols: Sequence[str] = FEATURES, label_cols: Sequence[str] = LABEL_FEATURES, keep: Sequence[str] = (POPULATION,)) -> DataFrame:
    """(feature, value) rows of all features in one pass; label features of labelled rows only.

    Values that are NULL, NaN or infinite are left out, for every figure alike.
    """
    picked = [F.col(c).cast("double").alias(c) for c in cols]
    picked += [F.when(F.col("labeled"), F.col(c)).cast("double").alias(c) for c in label_cols]
    x = trades.select(*keep, *picked)
    return x.unpivot(list(keep), [*cols, *label_cols], "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))


def audit_overview(trades: DataFrame) -> DataFrame:
    return trades.groupBy(POPULATION).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct("ticker").alias("tickers"),
    )


def audit_by_ticker(trades: DataFrame) -> DataFrame:
    """Rows, dates, ratio and volatility quantiles, success and side shares; most rows first."""
    buys, sells = F.upper("side") == "BUY", F.upper("side") == "SELL"
    won = F.col("labeled") & (F.col("label_success") == 1)
    s = trades.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("vol_oi_ratio").alias("ratio_max"),
        F.count_if("labeled").alias("_lab"), F.count_if(won).alias("_won"), F.count_if(buys).alias("_b"), F.count_if(sells).alias("_s"),
    )
    long = trades.select("ticker", "vol_oi_ratio", "implied_vol").unpivot(["ticker"], ["vol_oi_ratio", "implied_vol"], "feature", "value")
    qs = exact_quantiles(long, ["ticker", "feature"], "value", [0.5, 0.99]).groupBy("ticker").agg(
        *[
            F.max(F.when(F.col("feature") == f, F.col("q")[i])).alias(f"{short}_p{p}")
            for f, short in (("vol_oi_ratio", "ratio"), ("implied_vol", "iv")) for i, p in ((0, 50), (1, 99))
        ]
    )
    sided = F.col("_b") + F.col("_s")
    out = s.join(qs, "ticker", "left").withColumns(
        {
            "success_pct": F.try_divide(F.col("_won").cast("double"), F.col("_lab").cast("double")) * 100,
            "buy_pct": percent(F.col("_b"), sided),
            "sell_pct": percent(F.col("_s"), sided),
        }
    )
    return out.drop("_lab", "_won", "_b", "_s").orderBy(F.desc("n"), "ticker")


def feature_distribution(trades: DataFrame, cols: Sequence[str] = FEATURES, label_cols: Sequence[str] = LABEL_FEATURES) -> DataFrame:
    """Count, extremes, quantiles, mean and population deviation per feature and population."""
    long = numeric_long(trades, cols, label_cols)
    key = ["feature", POPULATION]
    s = long.groupBy(*key).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev")
    )
    qs = exact_quantiles(long, key, "value", STAT_PROBS)
    named = [F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(STAT_PROBS)]
    return s.join(qs.select(*key, F.col("n").alias("count"), *named), key)


def categorical_distribution(trades: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Count and share per level and population; shares are of all rows of the population."""
    x = trades.select(POPULATION, *[F.col(c).cast("string").alias(c) for c in cols])
    long = x.unpivot([POPULATION], list(cols), "feature", "level").where(F.col("level").isNotNull())
    totals = trades.select(F.struct(F.count_if(F.col(POPULATION) == 1).alias("s"), F.count_if(F.col(POPULATION) == 0).alias("r")).alias("t"))
    c = long.groupBy("feature", "level").agg(
        F.count_if(F.col(POPULATION) == 1).alias("synthetic_n"), F.count_if(F.col(POPULATION) == 0).alias("real_n")
    ).withColumn("t", totals.scalar())
    return c.select(
        "feature", "level", "synthetic_n", percent(F.col("synthetic_n"), F.col("t.s")).alias("synthetic_pct"),
        "real_n", percent(F.col("real_n"), F.col("t.r")).alias("real_pct"),
    )


def label_summary(trades: DataFrame) -> DataFrame:
    lab, won = F.col("labeled"), F.col("labeled") & (F.col("label_success") == 1)
    s = trades.groupBy(POPULATION).agg(
        F.count_if(lab).alias("labeled"), F.count_if(~lab).alias("unlabeled"), F.count_if(won).alias("success")
    )
    return s.withColumn("success_pct", F.try_divide(F.col("success").cast("double"), F.col("labeled").cast("double")) * 100)


def balance(trades: DataFrame) -> DataFrame:
    def starts(letter: str) -> Column:
        return F.upper("option_type").startswith(letter)

    s = trades.groupBy(POPULATION).agg(
        F.count_if(F.upper("side") == "BUY").alias("buys"), F.count_if(F.upper("side") == "SELL").alias("sells"),
        F.count_if(starts("C")).alias("calls"), F.count_if(starts("P")).alias("puts"),
    )
    sided, typed = F.col("buys") + F.col("sells"), F.col("calls") + F.col("puts")
    return s.withColumns(
        {
            "buy_pct": percent(F.col("buys"), sided), "sell_pct": percent(F.col("sells"), sided),
            "call_pct": percent(F.col("calls"), typed),
        }
    )


def whale_crossing(trades: DataFrame, thresholds: Sequence[float] = WHALE_THRESHOLDS) -> DataFrame:
    """Rows at or above each ratio threshold; ``warn`` when the synthetic ones have none from 5 up."""
    syn, real = F.col(POPULATION) == 1, F.col(POPULATION) == 0
    counts = [F.count_if(syn).alias("_s"), F.count_if(real).alias("_r")]
    cells = []
    for i, t in enumerate(thresholds):
        over = F.col("vol_oi_ratio") >= t
        counts += [F.count_if(syn & over).alias(f"_s{i}"), F.count_if(real & over).alias(f"_r{i}")]
        cells.append(F.struct(lit(t).alias("threshold"), F.col(f"_s{i}").alias("synthetic_n"), F.col(f"_r{i}").alias("real_n")))
    x = trades.agg(*counts).select("_s", "_r", F.explode(F.array(*cells)).alias("c")).select("_s", "_r", "c.*")
    return x.select(
        "threshold", "synthetic_n", percent(F.col("synthetic_n"), F.col("_s")).alias("synthetic_pct"),
        "real_n", percent(F.col("real_n"), F.col("_r")).alias("real_pct"),
        ((F.col("synthetic_n") == 0) & (F.col("threshold") >= 5)).alias("warn"),
    )


def dte_histogram(trades: DataFrame) -> DataFrame:
    d = F.col("dte")
    bucket = (
        F.when(d.isNull(), "NULL").when(d <= 7, "<=7").when(d <= 21, "8-21").when(d <= 45, "22-45").when(d <= 90, "46-90").otherwise(">90")
    )
    return trades.groupBy(bucket.alias("bucket")).agg(
        F.count_if(F.col(POPULATION) == 1).alias("synthetic_n"), F.count_if(F.col(POPULATION) == 0).alias("real_n")
    )


def contingency(trades: DataFrame) -> DataFrame:
    return trades.groupBy("is_weekly", "trend_alignment").agg(
        F.count_if(F.col(POPULATION) == 1).alias("synthetic_n"), F.count_if(F.col(POPULATION) == 0).alias("real_n")
    )
