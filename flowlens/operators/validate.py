"""Two-sample tests between the synthetic and the real population, and the pass/fail gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens.functions.pricing import lit, norm_cdf, norm_pdf
from flowlens.operators.audit import POPULATION, numeric_long
from flowlens.operators.scale import exact_quantiles, running_totals

KS_FEATURES = ("vol_oi_ratio", "implied_vol", "dte", "premium", "strike", "underlier_price")
KS_LABEL = ("observed_return", "max_adverse_return")
CHI2_FEATURES = ("option_type", "side", "is_weekly", "trend_alignment")
# Features whose populations differ on purpose
DOCUMENTED = ("vol_oi_ratio", "dte", "premium", "implied_vol", "observed_return")
DECILES = tuple(i / 10 for i in range(1, 10))


def ks(trades: DataFrame, cols: Sequence[str] = KS_FEATURES, label_cols: Sequence[str] = KS_LABEL) -> DataFrame:
    """Largest distance of the two distribution functions per feature, class and p-value.

    Features that one population lacks come out with NULLs. The p-value is the usual
    asymptotic series.
    """
    long = numeric_long(trades, cols, label_cols)
    syn, real = F.col(POPULATION) == 1, F.col(POPULATION) == 0
    hist = long.groupBy("feature", "value").agg(F.count_if(syn).alias("s"), F.count_if(real).alias("r"))
    rt = running_totals(hist, ["feature"], "value", ["s", "r"])
    gap = F.abs(F.try_divide(F.col("cum_s").cast("double"), F.col("tot_s")) - F.try_divide(F.col("cum_r").cast("double"), F.col("tot_r")))
    d = rt.groupBy("feature").agg(F.max(gap).alias("d"), F.max("tot_s").alias("n_synthetic"), F.max("tot_r").alias("n_real"))
    n1, n2 = F.col("n_synthetic").cast("double"), F.col("n_real").cast("double")
    root = F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    d = d.withColumn("_l", (root + lit(0.12) + F.try_divide(lit(0.11), root)) * F.col("d"))

    def term(j: Column) -> Column:
        return F.when(j % 2 == 1, lit(2)).otherwise(lit(-2)) * F.exp(lit(-2) * j * j * F.col("_l") * F.col("_l"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), lit(0), lambda acc, j: acc + term(j))
    p = F.when(F.col("_l") < 0.2, lit(1)).otherwise(F.least(F.greatest(series, lit(0)), lit(1)))
    kind = F.when(F.col("d") < 0.05, "practically similar").when(F.col("d") < 0.15, "moderate divergence").when(F.col("d").isNotNull(), "large divergence")
    return d.select("feature", "n_synthetic", "n_real", "d", F.when(F.col("d").isNotNull(), p).alias("p_value"), kind.alias("divergence"), (F.col("d") < 0.05).alias("passed"))


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom (finite sums)."""
    half = x / 2
    even_state = F.struct(lit(1).alias("t"), lit(1).alias("s"))
    even = F.when(
        dof > 2,
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.floor(dof / lit(2)).cast("int") - 1, F.lit(1))), even_state,
            lambda a, i: F.struct((a["t"] * half / i).alias("t"), (a["s"] + a["t"] * half / i).alias("s")),
        )["s"],
    ).otherwise(lit(1)) * F.exp(-half)
    root = F.sqrt(x)
    odd_state = F.struct(root.alias("t"), root.alias("s"))
    odd_sum = F.when(dof < 3, lit(0)).when(dof == 3, root).otherwise(
        F.aggregate(
            F.sequence(F.lit(2), F.greatest(F.floor((dof - 1) / lit(2)).cast("int"), F.lit(2))), odd_state,
            lambda a, i: F.struct((a["t"] * x / (i * 2 - 1)).alias("t"), (a["s"] + a["t"] * x / (i * 2 - 1)).alias("s")),
        )["s"]
    )
    odd = lit(2) * (lit(1) - norm_cdf(root)) + lit(2) * norm_pdf(root) * odd_sum
    return F.when(dof % 2 == 0, even).otherwise(odd)


def chi2_of_counts(counts: DataFrame) -> DataFrame:
    """Contingency chi-square per feature from (feature, level, s, r).

    NULL with fewer than two levels or an empty population; continuity-corrected for 2 x 2.
    """
    by_feature = W.partitionBy("feature")  # one row per level
    x = counts.select(
        "*", F.sum("s").over(by_feature).alias("ts"), F.sum("r").over(by_feature).alias("tr"), F.count(F.lit(1)).over(by_feature).alias("levels")
    )
    both = (F.col("ts") + F.col("tr")).cast("double")

    def part(seen: str, total: str) -> Column:
        expected = F.try_divide((F.col("s") + F.col("r")) * F.col(total).cast("double"), both)
        off = F.abs(F.col(seen) - expected)
        off = F.when(F.col("levels") == 2, off - F.least(lit(0.5), off)).otherwise(off)
        return F.try_divide(off * off, expected)

    stat = x.groupBy("feature", "ts", "tr", "levels").agg(F.sum(part("s", "ts") + part("r", "tr")).alias("chi2"))
    valid = (F.col("levels") >= 2) & (F.col("ts") > 0) & (F.col("tr") > 0)
    stat = stat.withColumn("chi2", F.when(valid, F.col("chi2"))).withColumn("dof", F.col("levels") - 1)
    p = F.when(F.col("chi2").isNotNull(), F.when(F.col("chi2") == 0, lit(1)).otherwise(chi2_sf(F.col("chi2"), F.col("dof"))))
    return stat.select("feature", "levels", "dof", "chi2", p.alias("p_value")).withColumn("passed", F.col("p_value") >= 0.05)


def chi2(trades: DataFrame, cols: Sequence[str] = CHI2_FEATURES) -> DataFrame:
    x = trades.select(POPULATION, *[F.col(c).cast("string").alias(c) for c in cols])
    long = x.unpivot([POPULATION], list(cols), "feature", "level").where(F.col("level").isNotNull())
    counts = long.groupBy("feature", "level").agg(
        F.count_if(F.col(POPULATION) == 1).alias("s"), F.count_if(F.col(POPULATION) == 0).alias("r")
    )
    return chi2_of_counts(counts)


def decile_compare(trades: DataFrame, cols: Sequence[str] = ("vol_oi_ratio",), label_cols: Sequence[str] = ()) -> DataFrame:
    """p10 ... p90 of both populations side by side."""
    long = numeric_long(trades, cols, label_cols)
    qs = exact_quantiles(long, ["feature", POPULATION], "value", DECILES)
    names = F.array(*[F.lit(f"p{round(p * 100)}") for p in DECILES])
    x = qs.select("feature", POPULATION, F.posexplode("q").alias("i", "v")).withColumn("quantile", F.element_at(names, F.col("i") + 1))
    return x.groupBy("feature", "quantile").agg(
        F.max(F.when(F.col(POPULATION) == 1, F.col("v"))).alias("synthetic"), F.max(F.when(F.col(POPULATION) == 0, F.col("v"))).alias("real")
    )


def label_rate_delta(trades: DataFrame) -> DataFrame:
    """Success rates of the labelled rows, their difference and its chi-square."""
    lab = trades.where("labeled").select(POPULATION, F.col("label_success").cast("string").alias("level"))
    counts = lab.groupBy(F.lit("label_success").alias("feature"), "level").agg(
        F.count_if(F.col(POPULATION) == 1).alias("s"), F.count_if(F.col(POPULATION) == 0).alias("r")
    )
    won = F.col("level") == "1"

    def rate(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.when(won, F.col(c)).otherwise(0)).cast("double"), F.sum(c).cast("double")), lit(0))

    rates = counts.agg(F.struct(rate("s").alias("synthetic_rate"), rate("r").alias("real_rate")).alias("r"))
    x = chi2_of_counts(counts).withColumn("r", rates.scalar())
    delta = F.col("r.synthetic_rate") - F.col("r.real_rate")
    return x.select("r.synthetic_rate", "r.real_rate", delta.alias("delta"), "chi2", "p_value")


def validation_gate(ks_df: DataFrame, chi2_df: DataFrame, documented: Sequence[str] = DOCUMENTED) -> DataFrame:
    """Passes, documented failures and unexpected failures over all tests.

    Without any real row there is nothing to compare with: status ``no baseline``.
    """
    real = ks_df.select(F.coalesce(F.max("n_real"), F.lit(0)).alias("n"))
    tests = ks_df.select("feature", "passed").unionByName(chi2_df.select("feature", "passed"))
    known = F.col("feature").isin(*documented)
    s = tests.where(F.col("passed").isNotNull()).agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & known).alias("documented"), F.count_if(~F.col("passed") & ~known).alias("unexpected")
    ).withColumn("_n", real.scalar())
    status = F.when(F.col("_n") == 0, "no baseline").when(F.col("unexpected") == 0, "pass").otherwise("fail")
    return s.withColumn("status", status).drop("_n")
