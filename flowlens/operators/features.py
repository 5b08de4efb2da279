"""Model features of trades."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from flowlens.functions.pricing import lit
from flowlens.operators.joins import asof_price, daily_close
from flowlens.operators.scale import exact_quantiles
from flowlens.operators.vol import rolling_hv

NUMERIC = (
    "strike", "volume", "open_interest", "vol_oi_ratio", "implied_vol", "underlier_price", "premium", "dte",
    "moneyness", "iv_hv_ratio", "vix_level", "log_premium",
)
CATEGORICAL = ("option_type", "side", "trend_alignment", "dte_bucket")

# Fixed values of the static mode
STATIC_HV, STATIC_VIX = 25.0, 20.0


def dte_bucket(dte="dte"):
    d = F.col(dte)
    return F.when(d <= 7, "weekly").when(d <= 30, "short").when(d <= 60, "medium").otherwise("long")


def row_features(trades: DataFrame) -> DataFrame:
    """Features of the row alone; an unknown trend counts as neutral."""
    spot = F.col("underlier_price")
    return trades.withColumns(
        {
            "trend_alignment": F.coalesce("trend_alignment", F.lit("NEUTRAL")),
            "moneyness": F.try_divide(F.col("strike") - spot, spot),
            "log_premium": F.log1p(F.greatest("premium", lit(0))),
            "dte_bucket": dte_bucket(),
        }
    )


def features(trades: DataFrame, bars: DataFrame | None = None, vix: DataFrame | None = None, mode: str = "asof") -> DataFrame:
    """All features. ``asof`` uses volatility and index level known on the trade date;
    ``static`` the constants 25 and 20."""
    x = row_features(trades)
    if mode == "static":
        x = x.withColumns({"hv": lit(STATIC_HV), "vix_level": lit(STATIC_VIX)})
    else:
        x = asof_price(x, rolling_hv(bars), "trade_date").withColumn("hv", F.coalesce("spot", lit(0))).drop("spot")
        index = vix.select(F.lit("index").alias("ticker"), F.col("vix_date").alias("bar_date"), F.col("vix").alias("close"))
        last_day = x.select(F.max("trade_date").alias("m"))
        level = daily_close(index, last_day.scalar()).select(F.col("day").alias("trade_date"), F.col("spot").alias("_level"))
        x = x.join(level, ["trade_date"], "left").withColumn("vix_level", F.coalesce("_level", lit(STATIC_VIX))).drop("_level")
    ratio = F.when(F.col("hv") > 0, F.try_divide("implied_vol", "hv")).otherwise(lit(1))
    return x.withColumn("iv_hv_ratio", ratio)


def training_filter(trades: DataFrame, synthetic: bool | None = None) -> DataFrame:
    """Labelled rows inside the plausible bands (all limits inclusive, price above 5)."""
    if synthetic is not None:
        trades = trades.where(F.col("is_synthetic") == int(synthetic))
    return trades.where(
        F.col("labeled")
        & F.col("vol_oi_ratio").between(0.05, 10)
        & F.col("implied_vol").between(5, 200)
        & F.col("premium").between(10, 100000)
        & (F.col("underlier_price") > 5)
        & F.col("observed_return").between(-1.0, 5.0)
    )


def _filled(df: DataFrame, fills: dict) -> DataFrame:
    """Numeric columns as doubles without NULL, NaN or infinity, categories without NULL, where a fill is known."""
    numbers = {}
    for c in NUMERIC:
        v = F.col(c).cast("double")
        numbers[c] = F.when(F.isnan(v) | (F.abs(v) == lit(float("inf"))), None).otherwise(v)
    return df.withColumns(numbers).fillna({k: v for k, v in fills.items() if v is not None})


def impute_encode(df: DataFrame):
    """Fit medians, modes and one-hot levels; returns (fills, pipeline model).

    ``fills`` is one row. Unseen levels get an all-zero vector. A column without any value at
    fit time has no median or mode and takes no part in the vector; no row is left out.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in NUMERIC]).unpivot([], list(NUMERIC), "feature", "v")
    medians = exact_quantiles(long, ["feature"], "v", [0.5]).groupBy().pivot("feature", list(NUMERIC)).agg(F.first(F.col("q")[0]))
    modes = df.agg(*[F.mode(c, True).alias(c) for c in CATEGORICAL])
    fills = {**medians.first().asDict(), **modes.first().asDict()}  # one row of fitted constants
    clean = _filled(df, fills)
    numbers, kinds = ([c for c in cols if fills.get(c) is not None] for cols in (NUMERIC, CATEGORICAL))
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep") for c in kinds]
    if kinds:
        stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in kinds], outputCols=[f"{c}_hot" for c in kinds]))
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"{c}_hot" for c in kinds]], outputCol="features", handleInvalid="error"))
    return fills, Pipeline(stages=stages).fit(clean)


def encode(df: DataFrame, fitted) -> DataFrame:
    fills, model = fitted
    return model.transform(_filled(df, fills))
