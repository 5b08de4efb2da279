"""Trend and volatility of price bars, and the volatility smile of a chain.

Windows are partitioned by ticker. A ticker has one bar per day, so such a window holds
some thousand rows whatever the size of the trade or quote tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, WindowSpec, functions as F

from flowlens.functions.pricing import lit
from flowlens.functions.quotes import round_to

ANNUAL = math.sqrt(252.0)


def by_ticker() -> WindowSpec:
    return W.partitionBy("ticker")


def by_date() -> WindowSpec:
    return by_ticker().orderBy("bar_date")


def trailing(n: int) -> WindowSpec:
    return by_date().rowsBetween(1 - n, 0)


def last_days(bars: DataFrame, days: int = 365) -> DataFrame:
    """Bars at most ``days`` days older than the ticker's newest one."""
    newest = F.max("bar_date").over(by_ticker())
    return bars.withColumn("_max", newest).where(F.col("bar_date") > F.date_sub("_max", days)).drop("_max")


def _averages(bars: DataFrame) -> DataFrame:
    """Newest bar per ticker of the last year with its averages and the bar count."""
    latest = F.row_number().over(by_ticker().orderBy(F.desc("bar_date")))
    x = last_days(bars).select(
        "ticker",
        "bar_date",
        "close",
        F.avg("close").over(trailing(50)).alias("sma50"),
        F.avg("close").over(trailing(200)).alias("sma200"),
        F.count("close").over(by_ticker()).alias("n"),
        latest.alias("_r"),
    )
    return x.where(F.col("_r") == 1).select(
        "ticker", "close", "n", F.when(F.col("n") >= 50, F.col("sma50")).alias("sma50"),
        F.when(F.col("n") >= 200, F.col("sma200")).alias("sma200"),
    )


def sma_flags(bars: DataFrame) -> DataFrame:
    """Is the newest close above its 50- and 200-bar average; NULL with too few bars."""
    return _averages(bars).select(
        "ticker", (F.col("close") > F.col("sma50")).alias("above50"), (F.col("close") > F.col("sma200")).alias("above200")
    )


def technicals(bars: DataFrame) -> DataFrame:
    """Price, averages and a three-way trend of tickers with at least 50 bars.

    The comparisons use the rounded figures, as displayed.
    """
    x = _averages(bars).where(F.col("n") >= 50).select(
        "ticker", round_to(F.col("close"), 2).alias("price"), round_to(F.col("sma50"), 2).alias("sma50"),
        round_to(F.col("sma200"), 2).alias("sma200"),
    )
    x = x.withColumns({"above50": F.col("price") > F.col("sma50"), "above200": F.col("price") > F.col("sma200")})
    up50, up200 = F.col("above50"), F.col("above200")
    trend = (
        F.when(up50 & F.coalesce(up200, F.lit(True)), "BULLISH")
        .when(up50 | F.coalesce(up200, F.lit(False)), "MIXED")
        .otherwise("BEARISH")
    )
    return x.withColumn("trend", trend)


def log_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_date())
    return bars.withColumn("ret", F.log(F.try_divide(F.col("close"), before)))


def iv_rank(bars: DataFrame, window: int = 30) -> DataFrame:
    """Rolling volatility of one year: newest value, its rank and its percentile."""
    r = log_returns(last_days(bars))
    full = F.count("ret").over(trailing(window)) == window
    hv = F.when(full, F.stddev_samp("ret").over(trailing(window)) * ANNUAL * 100)
    x = r.select("ticker", "bar_date", hv.alias("hv"))
    newest = x.groupBy("ticker").agg(F.max_by("hv", "bar_date").alias("cur"), F.count(F.lit(1)).alias("bars"))
    spread = x.join(newest, "ticker").groupBy("ticker", "cur", "bars").agg(
        F.min("hv").alias("lo"), F.max("hv").alias("hi"),
        F.count("hv").alias("n"), F.count_if(F.col("hv") <= F.col("cur")).alias("below"),
    )
    enough = F.col("bars") >= window + 5
    rank = F.when(F.col("hi") != F.col("lo"), F.try_divide(F.col("cur") - F.col("lo"), F.col("hi") - F.col("lo")) * 100)
    share = F.try_divide(F.col("below").cast("double"), F.col("n")) * 100

    def out(e, digits):
        return F.when(enough, F.coalesce(F.round(e, digits), lit(0))).otherwise(lit(0))

    return spread.select(
        "ticker", out(F.col("cur"), 2).alias("current_iv"), out(rank, 1).alias("iv_rank"), out(share, 1).alias("iv_percentile")
    )


def hist_vol(bars: DataFrame, days: int = 92, mode: str = "sample") -> DataFrame:
    """Annualised volatility (percent) of the last three months per ticker.

    ``sample`` gives 0 under 5 bars; ``pop`` uses the population deviation and gives 25
    under 10 bars.
    """
    r = log_returns(last_days(bars, days))
    dev, least, default = ("stddev_samp", 5, 0.0) if mode == "sample" else ("stddev_pop", 10, 25.0)
    agg = r.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), getattr(F, dev)("ret").alias("sd"))
    hv = F.when((F.col("n") >= least) & F.col("sd").isNotNull(), F.col("sd") * ANNUAL * 100).otherwise(lit(default))
    return agg.select("ticker", hv.alias("hv"))


def rolling_hv(bars: DataFrame, window: int = 63) -> DataFrame:
    """The same figure at every bar, from the trailing ``window`` returns (as-of features)."""
    r = log_returns(bars)
    n = F.count("ret").over(trailing(window))
    hv = F.when(n >= 5, F.stddev_samp("ret").over(trailing(window)) * ANNUAL * 100).otherwise(lit(0))
    return r.select("ticker", "bar_date", hv.alias("close"))


def latest_vix(vix: DataFrame, default: float = 20.0) -> DataFrame:
    return vix.agg(F.coalesce(F.max_by("vix", "vix_date"), lit(default)).alias("vix"))


def garman_klass(bars: DataFrame, window: int = 20) -> DataFrame:
    """Open-high-low-close volatility at every bar; 0.25 until five bars exist."""
    range2 = F.pow(F.log(F.try_divide("high", "low")), 2)
    body2 = F.pow(F.log(F.try_divide("close", "open")), 2)
    x = bars.withColumn("_v", lit(0.5) * range2 - lit(2 * math.log(2) - 1) * body2)
    mean, n = F.avg("_v").over(trailing(window)), F.count("_v").over(trailing(window))
    gk = F.when(n >= 5, F.sqrt(F.greatest(mean, lit(1e-6))) * ANNUAL).otherwise(lit(0.25))
    return x.withColumn("gk_vol", gk).drop("_v")


def trend_sma(bars: DataFrame) -> DataFrame:
    close = F.col("close")

    def sma(n):
        full = F.count("close").over(trailing(n)) == n
        return F.when(full, F.avg("close").over(trailing(n))).otherwise(close)

    x = bars.withColumns({"_s20": sma(20), "_s50": sma(50)})
    trend = (
        F.when((close > F.col("_s20")) & (F.col("_s20") > F.col("_s50")), "BULL_ALIGNED")
        .when((close < F.col("_s20")) & (F.col("_s20") < F.col("_s50")), "BEAR_ALIGNED")
        .otherwise("NEUTRAL")
    )
    return x.withColumn("trend", trend).drop("_s20", "_s50")


def vix_regime(vix="vix"):
    v = F.col(vix)
    return F.when(v < 15, "low").when(v < 22, "med").when(v < 30, "high").otherwise("extreme")


def market_regime(bars_gk: DataFrame) -> DataFrame:
    """Direction over 200 bars and whether volatility rose over 20; NULL for the first 200."""
    x = bars_gk.withColumns({"_c": F.lag("close", 200).over(by_date()), "_g": F.lag("gk_vol", 20).over(by_date())})
    direction = F.when(F.col("close") > F.col("_c"), "trend_up").otherwise("trend_down")
    change = F.when(F.col("gk_vol") > F.col("_g"), "_vol_expansion").otherwise("_vol_contraction")
    return x.withColumn("market_regime", F.when(F.col("_c").isNotNull(), F.concat(direction, change))).drop("_c", "_g")


def iv_smile(chain: DataFrame, n: int = 2) -> DataFrame:
    """Strike against volatility (percent) for the ``n`` front expirations of a snapshot."""
    key = ["ticker", "snapshot_date"]
    dates = chain.groupBy(*key, "expiration").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy("expiration"))
    front = dates.withColumn("_r", rank).where(F.col("_r") <= n).select(*key, "expiration")
    quotes = chain.where((F.col("implied_vol") > 0) & (F.col("implied_vol") < 5))
    near = quotes.join(front, [*key, "expiration"], "left_semi")
    return near.select(*key, "expiration", "strike", "option_type", round_to(F.col("implied_vol") * 100, 2).alias("iv"))


def smile_curve(smile: DataFrame) -> DataFrame:
    """Call side only, ordered for drawing."""
    return smile.where(F.col("option_type") == "Call").drop("option_type").orderBy(
        "ticker", "snapshot_date", "expiration", "strike", "iv"
    )
