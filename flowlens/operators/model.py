"""Conditional-quantile models of the return: fit, score, evaluate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions import signals as sg
from flowlens.functions.pricing import lit
from flowlens.operators.features import CATEGORICAL, NUMERIC, encode, impute_encode
from flowlens.operators.scale import exact_quantiles, materialize, number_rows, quantiles_of_counts, running_totals
from flowlens.schemas import QUANTILES

CELL = CATEGORICAL
EVERY = "*"
MIN_ROWS = 30


def with_cell(df: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return df.withColumn("cell", F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in keys]))


def split(df: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``, a fixed pseudo-random choice by id, equal on every run and engine."""
    draw = F.pmod((F.col("id") % 1_000_003) * 7919 + F.lit(seed) * 104_729, F.lit(1009))
    return df.withColumn("is_test", draw < F.lit(int(1009 * test_share)))


def return_counts(train: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows per cell and distinct return. Returns are stored with four decimals, so a cell
    has a limited number of them, and everything after this step is independent of the
    number of trades. A return that is NULL or not finite is no observation."""
    y = F.col("observed_return")
    known = train.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) != F.lit(float("inf"))))
    return known.groupBy(*extra, "cell", y.alias("y")).agg(F.count(F.lit(1)).alias("c"))


def with_every(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = counts.withColumn("cell", F.explode(F.array("cell", F.lit(EVERY))))
    return both.groupBy(*keys).agg(F.sum("c").alias("c"))


def fit_cells(train: DataFrame, keys: Sequence[str] = CELL, probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Quantiles of the return per cell, and of all rows (cell ``*``).

    The fitted model is written to the shared folder, so each use reads the same small table.
    """
    counts = with_every(return_counts(with_cell(train, keys)), ["cell", "y"])
    return materialize(quantiles_of_counts(counts, ["cell"], "y", probs))


def score(df: DataFrame, cells: DataFrame, keys: Sequence[str] = CELL, min_rows: int = MIN_ROWS) -> DataFrame:
    """Add ``q``; cells that are unseen or too small use the quantiles of all rows."""
    own = cells.where((F.col("cell") != EVERY) & (F.col("n") >= min_rows)).select("cell", "q")
    whole = cells.where(F.col("cell") == EVERY).select("q")
    j = with_cell(df, keys).join(own, ["cell"], "left")
    return j.withColumn("q", F.coalesce("q", whole.scalar()))


def violations(scored: DataFrame) -> DataFrame:
    bad = (F.col("q") != F.array_sort("q")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).cast("bigint").alias("violations"), F.avg(bad).alias("share"))


def pinball_loss(scored: DataFrame, probs: Sequence[float] = QUANTILES) -> DataFrame:
    x = scored.select("observed_return", F.posexplode("q").alias("i", "pred"))
    level = F.element_at(F.array(*[lit(p) for p in probs]), F.col("i") + 1)
    x = x.withColumns({"quantile": level, "e": F.col("observed_return") - F.col("pred")})
    loss = F.greatest(F.col("quantile") * F.col("e"), (F.col("quantile") - 1) * F.col("e"))
    return x.groupBy("quantile").agg(F.avg(loss).alias("pinball_loss"))


def coverage(scored: DataFrame) -> DataFrame:
    def share(i: int, name: str) -> Column:
        return F.avg((F.col("observed_return") <= F.col("q")[i]).cast("double")).alias(name)

    return scored.agg(share(0, "coverage_p10"), share(2, "coverage_p50"), share(4, "coverage_p90"))


def binary_metrics(scored: DataFrame, threshold: float = 0.03, by: Sequence[str] = ()) -> DataFrame:
    """Median prediction and return, both cut at ``threshold``; 0 on an empty denominator."""
    pred, real = F.col("q")[2] >= threshold, F.col("observed_return") >= threshold
    s = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pred == real).alias("right"), F.count_if(pred & real).alias("tp"),
        F.count_if(pred).alias("pp"), F.count_if(real).alias("rp"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), lit(0))

    tp, pp, rp = F.col("tp"), F.col("pp"), F.col("rp")
    return s.select(
        *by, "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), ratio(tp, pp).alias("precision"),
        ratio(tp, rp).alias("recall"), ratio(2 * tp, pp + rp).alias("f1"),
    )


def roc_auc(scored: DataFrame, threshold: float = 0.03, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC of the median prediction, ties counted half; 0 when a class is empty."""
    hit = (F.col("observed_return") >= threshold).cast("bigint")
    # nine decimals: noise of the interpolation must not break a tie
    hist = scored.groupBy(*by, F.round(F.col("q")[2], 9).alias("s")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    rt = running_totals(hist, by, "s", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / lit(2)))
    u = rt.groupBy(*by).agg(wins.alias("u"), F.max("tot_pos").alias("p"), F.max("tot_neg").alias("m"))
    pairs = F.col("p").cast("double") * F.col("m")
    return u.select(*by, F.coalesce(F.try_divide(F.col("u"), pairs), lit(0)).alias("roc_auc"))


def stratified_folds(df: DataFrame, k: int = 5, threshold: float = 0.03) -> DataFrame:
    """Deal the rows of each class in id order onto ``k`` folds."""
    x = df.withColumn("_hit", (F.col("observed_return") >= threshold).cast("int"))
    x = number_rows(x, ["_hit", "id"], "_i")
    misses = x.where(F.col("_hit") == 0).select(F.count(F.lit(1)).alias("n"))
    rank = F.col("_i") - F.when(F.col("_hit") == 1, misses.scalar()).otherwise(F.lit(0))
    return x.withColumn("fold", (rank % k).cast("int")).drop("_hit", "_i")


def cv_auc(df: DataFrame, k: int = 5, threshold: float = 0.03, keys: Sequence[str] = CELL, min_rows: int = MIN_ROWS) -> DataFrame:
    """AUC of each fold under the model of the other folds; all ``k`` fits run as one job.

    Returns are counted per fold once and only the counts are repeated for the other fits.
    """
    folds = with_cell(stratified_folds(df, k, threshold), keys)
    counts = return_counts(folds, ["fold"])
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    counts = counts.withColumn("held", F.explode(others)).withColumn("fold", F.col("held"))
    model = materialize(quantiles_of_counts(with_every(counts, ["fold", "cell", "y"]), ["fold", "cell"], "y", QUANTILES))
    own = model.where((F.col("cell") != EVERY) & (F.col("n") >= min_rows)).select("fold", "cell", "q")
    whole = model.where(F.col("cell") == EVERY).select("fold", F.col("q").alias("_all"))
    x = folds.join(own, ["fold", "cell"], "left").join(whole, ["fold"], "left")
    return roc_auc(x.withColumn("q", F.coalesce("q", "_all")), threshold, ["fold"])


def cv_mean(aucs: DataFrame) -> DataFrame:
    return aucs.agg(F.count(F.lit(1)).alias("folds"), F.avg("roc_auc").alias("cv_roc_auc_mean"))


class Forest:
    """Regression forest whose leaves keep the quantiles of their training returns."""

    def __init__(self, encoder, model, leaves: DataFrame):
        self.encoder, self.model, self.leaves = encoder, model, leaves


def _leaf_rows(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("_leaves", vector_to_array("leaves"))


def fit_forest(train: DataFrame, trees: int = 10, depth: int = 5, min_rows: int = MIN_ROWS, seed: int = 42) -> Forest:
    encoder = impute_encode(train)
    data = encode(train, encoder)
    rf = RandomForestRegressor(
        featuresCol="features", labelCol="observed_return", leafCol="leaves", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_rows, seed=seed,
    )
    model = rf.fit(data)
    rows = _leaf_rows(model.transform(data)).select("observed_return", F.posexplode("_leaves").alias("tree", "leaf"))
    return Forest(encoder, model, materialize(exact_quantiles(rows, ["tree", "leaf"], "observed_return", QUANTILES)))


def score_forest(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``q``, the mean over trees of the quantiles of the row's leaf.

    A forest has at most trees x 2^depth leaves, so the leaf table is passed as one map.
    """
    entry = F.struct(F.concat_ws("/", F.col("tree"), F.col("leaf").cast("int")).alias("k"), F.col("q").alias("v"))
    table = forest.leaves.agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    x = _leaf_rows(forest.model.transform(encode(df, forest.encoder))).withColumn("_m", table.scalar())
    per_tree = F.transform(
        "_leaves", lambda leaf, i: F.try_element_at("_m", F.concat_ws("/", i.cast("string"), leaf.cast("int").cast("string")))
    )
    x = x.withColumn("_q", F.filter(per_tree, lambda q: q.isNotNull()))
    mean = [F.try_divide(F.aggregate("_q", lit(0), lambda a, q: a + q[i]), F.size("_q")) for i in range(len(QUANTILES))]
    return x.select(*df.columns, F.array(*mean).alias("q"))


def importance(forest: Forest, df: DataFrame, n: int = 10) -> DataFrame:
    """Feature importances as rows, scaled to sum 1, the ``n`` largest."""
    hot = []
    for name, stage in zip(CATEGORICAL, forest.encoder[1].stages):
        hot += [f"{name}_{level}" for level in stage.labels]
    names = [*NUMERIC, *hot]
    values = forest.model.featureImportances.toArray()  # a model attribute, one number per feature
    total = float(values.sum()) or 1.0
    rows = [(f, round(float(v) / total, 4)) for f, v in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(n)


def derived_signals(scored: DataFrame, target: float = 0.03, horizon: int = 10, kelly_cap: float = 0.25) -> DataFrame:
    """Sorted quantiles, success probability, regime and Kelly size of scored rows."""
    x = scored.withColumn("q", sg.monotonic("q")).withColumn("p_success", sg.p_success("q", target))
    regime, confidence = sg.classify_regime("q", "hv", horizon)
    capped, raw = sg.kelly_quantile("q", "p_success", kelly_cap)
    return x.withColumns({"regime": regime, "regime_confidence": confidence, "kelly_fraction": capped, "kelly_raw": raw})


def open_signals(
    flow: DataFrame, cells: DataFrame, prob_threshold: float = 0.35, min_kelly: float = 0.01, target: float = 0.03
) -> DataFrame:
    """Scored flow whose probability and Kelly size reach the limits."""
    x = derived_signals(score(flow, cells), target)
    return x.where((F.col("p_success") >= prob_threshold) & (F.col("kelly_fraction") >= min_kelly))
