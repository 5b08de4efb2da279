"""The scan: from option quotes to enriched flow, its summaries, rankings and filters.

Chain-wide facts (is there any volume, which expiration is the front one) are aggregated
per ticker and snapshot with partial sums and looked up again; no window runs over quotes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens.functions import quotes as q
from flowlens.operators.joins import asof_price
from flowlens.sources.tables import select_expirations

SNAPSHOT = ["ticker", "snapshot_date"]
QUOTE = ["expiration", "strike", "option_type"]


def coerce_numeric(chain: DataFrame) -> DataFrame:
    cols = ("volume", "open_interest", "implied_vol")
    return chain.withColumns({c: q.numeric_or_zero(c) for c in cols})


def offhours_volume(chain: DataFrame) -> DataFrame:
    """Open interest stands in for volume where a ticker's whole snapshot has no volume."""
    seen = chain.groupBy(*SNAPSHOT).agg(F.max("volume").alias("_vol"), F.max("open_interest").alias("_oi"))
    closed = seen.where((F.coalesce("_vol", F.lit(0)) <= 0) & (F.col("_oi") > 0)).select(*SNAPSHOT, F.lit(True).alias("_closed"))
    j = chain.join(closed, SNAPSHOT, "left")
    volume = F.when(F.col("_closed"), F.col("open_interest")).otherwise(F.col("volume"))
    return j.withColumn("volume", volume).drop("_closed")


def with_ratio(chain: DataFrame) -> DataFrame:
    return chain.where(F.col("volume") > 0).withColumn("vol_oi_ratio", q.vol_oi_ratio())


def unusual(chain: DataFrame, min_vol_oi: float = 8.0) -> DataFrame:
    return chain.where(F.col("vol_oi_ratio") >= min_vol_oi)


def quote_columns(chain: DataFrame) -> DataFrame:
    """All per-quote columns of the scan in one projection."""
    return chain.withColumns(
        {
            "side": q.infer_side(),
            "dte": q.days_to_expiry(),
            "is_weekly": q.is_weekly(),
            "premium": q.notional(),
            "trade_time_ny": q.new_york_time(),
            "iv_pct": q.round_to(F.col("implied_vol") * 100, 2),
            "is_whale": q.is_whale(),
            "log_ratio": q.log_ratio(),
        }
    )


def expected_move(chain: DataFrame, bars: DataFrame, order: Sequence[str] = ("bid", "ask")) -> DataFrame:
    """At-the-money straddle of the front expiration per ticker and snapshot.

    The strike is the call strike nearest to the latest close (the lower one on a tie); a
    missing leg or quote gives 0. ``order`` decides between several quotes of one contract.
    """
    front = chain.groupBy(*SNAPSHOT).agg(F.min("expiration").alias("expiration"))
    quotes = chain.join(front, [*SNAPSHOT, "expiration"], "left_semi")
    near = quotes.groupBy(*SNAPSHOT, *QUOTE).agg(F.min_by(F.struct("bid", "ask"), F.struct(*order)).alias("quote"))
    near = asof_price(near, bars.select("ticker", "bar_date", "close"), "snapshot_date")
    call = F.col("option_type") == "Call"
    distance = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    legs = near.groupBy(*SNAPSHOT, "expiration", "strike").agg(
        F.max("spot").alias("spot"),
        F.max(F.when(call, (F.col("quote.bid") + F.col("quote.ask")) / 2)).alias("call_mid"),
        F.max(F.when(~call, (F.col("quote.bid") + F.col("quote.ask")) / 2)).alias("put_mid"),
        F.max(call).alias("has_call"),
    )
    atm = legs.groupBy(*SNAPSHOT).agg(
        F.max("spot").alias("spot"),
        F.min_by(
            F.struct("strike", (F.col("call_mid") + F.col("put_mid")).alias("straddle")), F.when(F.col("has_call"), distance)
        ).alias("atm"),
    )
    known = F.col("spot").isNotNull() & (F.col("spot") != 0)
    move = F.when(known, q.finite_or_zero(F.col("atm.straddle"))).otherwise(F.lit(0.0))
    strike = F.when(known, F.col("atm.strike")).alias("atm_strike")
    return atm.select(*SNAPSHOT, "spot", strike, q.round_to(move, 2).alias("expected_move"))


def atm_pairs(chain: DataFrame, order: Sequence[str] = ("bid", "ask")) -> DataFrame:
    """Call and put quote of the same ticker, snapshot, expiration and strike, side by side."""
    call = F.col("option_type") == "Call"
    o = F.struct(*order)
    legs = chain.groupBy(*SNAPSHOT, "expiration", "strike").agg(
        F.min_by(F.struct("bid", "ask"), F.when(call, o)).alias("c"), F.min_by(F.struct("bid", "ask"), F.when(~call, o)).alias("p"),
        F.max(call).alias("has_call"), F.max(~call).alias("has_put"),
    )
    return legs.where("has_call and has_put").select(
        *SNAPSHOT, "expiration", "strike", F.col("c.bid").alias("call_bid"), F.col("c.ask").alias("call_ask"),
        F.col("p.bid").alias("put_bid"), F.col("p.ask").alias("put_ask"),
    )


def scan(
    chain: DataFrame, bars: DataFrame, flags: DataFrame, min_vol_oi: float = 8.0, order: Sequence[str] = ("bid", "ask")
) -> DataFrame:
    """The whole scan, of the nearest expirations only: the off-hours rule, the ratio and the moves see no others.

    ``flags`` holds above50 / above200 per ticker (operator ``sma_flags``).
    """
    chain = select_expirations(chain)
    quotes = offhours_volume(coerce_numeric(chain))
    flow = quote_columns(unusual(with_ratio(quotes), min_vol_oi))
    moves = expected_move(chain, bars, order).select(*SNAPSHOT, F.col("spot").alias("underlier_price"), "expected_move")
    flow = flow.drop("underlier_price").join(moves, SNAPSHOT, "left")
    flow = flow.join(flags.select("ticker", "above50", "above200"), ["ticker"], "left")
    upper, lower = q.move_bounds()
    return flow.withColumns(
        {"trend_alignment": q.trend_contextual(), "expected_move_upper": upper, "expected_move_lower": lower}
    )


def table_filters(
    flow: DataFrame,
    exclude_indices: bool = False,
    min_dte: int = 0,
    min_premium: float = 0.0,
    min_oi: int = 0,
    exclude_weeklies: bool = False,
    index_tickers: Sequence[str] = q.INDEX_TICKERS,
) -> DataFrame:
    """User filters of the scanner table; a row with an unknown number passes."""
    if exclude_indices:
        flow = flow.where(~F.upper("ticker").isin(*index_tickers))
    for name, least in (("dte", min_dte), ("premium", min_premium), ("open_interest", min_oi)):
        flow = flow.where(F.coalesce(F.col(name) >= least, F.lit(True)))
    return flow.where(~F.coalesce("is_weekly", F.lit(True))) if exclude_weeklies else flow


def ledger_filters(
    df: DataFrame, ticker: str | None = None, exit_reason: str | None = None, regime: str | None = None
) -> DataFrame:
    if ticker:
        df = df.where(F.upper("ticker").contains(ticker.strip().upper()))
    if exit_reason and exit_reason != "ALL":
        df = df.where(F.col("exit_reason") == exit_reason)
    if regime and regime != "ALL":
        df = df.where(F.col("regime") == regime)
    return df


def scan_summary(flow: DataFrame, by: Sequence[str] = (), clip: float | None = None) -> DataFrame:
    """Average and highest ratio, volumes, put/call ratio and whale count.

    ``clip`` replaces placeholder ratios above 9990 before averaging (9999 in one client).
    """
    ratio = F.col("vol_oi_ratio")
    if clip is not None:
        ratio = F.when(ratio > q.RATIO_SENTINEL, F.lit(clip)).otherwise(ratio)
    call = F.col("option_type") == "Call"
    volume = F.col("volume").cast("bigint")
    sums = flow.groupBy(*by).agg(
        F.avg(ratio).alias("avg"),
        F.max(ratio).alias("max_vol_oi"),
        F.coalesce(F.sum(F.when(call, volume)), F.lit(0)).alias("call_volume"),
        F.coalesce(F.sum(F.when(~call, volume)), F.lit(0)).alias("put_volume"),
        F.count_if(q.is_whale()).alias("whale_count"),
    )
    return sums.select(
        *by,
        q.round_to(F.coalesce("avg", F.lit(0.0)), 2).alias("avg_vol_oi"),
        F.coalesce("max_vol_oi", F.lit(0.0)).alias("max_vol_oi"),
        "call_volume",
        "put_volume",
        put_call("put_volume", "call_volume").alias("put_call_ratio"),
        "whale_count",
    )


def put_call(put: str, call: str) -> Column:
    return F.when(F.col(call) > 0, q.round_to(F.try_divide(F.col(put).cast("double"), F.col(call)), 4)).otherwise(F.lit(1.0))


def expiry_volume(chain: DataFrame, n: int) -> DataFrame:
    """Call and put volume of the first ``n`` expirations per ticker and snapshot."""
    call = F.col("option_type") == "Call"
    volume = F.coalesce(F.col("volume"), F.lit(0)).cast("bigint")
    sums = chain.groupBy(*SNAPSHOT, "expiration").agg(
        F.coalesce(F.sum(F.when(call, volume)), F.lit(0)).alias("call_volume"),
        F.coalesce(F.sum(F.when(~call, volume)), F.lit(0)).alias("put_volume"),
    )
    rank = F.row_number().over(W.partitionBy(*SNAPSHOT).orderBy("expiration"))
    return sums.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def pcr_by_expiration(chain: DataFrame, n: int = 10) -> DataFrame:
    pcr = put_call("put_volume", "call_volume").alias("put_call_ratio")
    return expiry_volume(chain, n).select(*SNAPSHOT, "expiration", pcr)


def pcr_pivot(pcr: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """One row per snapshot and expiration of any ticker, one column per ticker."""
    wanted = pcr.where(F.col("ticker").isin(*tickers))
    return wanted.groupBy("snapshot_date", "expiration").pivot("ticker", list(tickers)).agg(F.first("put_call_ratio"))


def volume_concentration(chain: DataFrame, n: int = 8) -> DataFrame:
    return expiry_volume(chain, n).withColumn("total_volume", F.col("call_volume") + F.col("put_volume"))


def topk_unusual(flow: DataFrame, k: int = 100, ties: Sequence[str] = ("ticker", *QUOTE)) -> DataFrame:
    """Top ``k`` by ratio; Spark keeps only k rows per task and merges those."""
    return flow.orderBy(F.desc("vol_oi_ratio"), *ties).limit(k)


def sort_any(df: DataFrame, column: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Sort by any column, NULLs last both ways, text without regard to case."""
    key = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *ties)


def first_per_ticker(flow: DataFrame, n: int, ties: Sequence[str] = QUOTE, whales_with_move: bool = False) -> DataFrame:
    """The highest-ratio row of each ticker, ``n`` tickers.

    The rank filter is applied in every task before the shuffle, so a busy ticker sends
    one row per task.
    """
    if whales_with_move:
        flow = flow.where(F.col("is_whale") & (F.col("expected_move") > 0))
    order = [F.desc("vol_oi_ratio"), *ties]
    ranked = flow.withColumn("_r", F.row_number().over(W.partitionBy("ticker").orderBy(*order)))
    return ranked.where(F.col("_r") == 1).drop("_r").orderBy(F.desc("vol_oi_ratio"), "ticker").limit(n)


def live_summary(signals: DataFrame) -> DataFrame:
    """Count, mean probability and the most probable open signal (lowest id on a tie)."""
    best = F.max_by(F.struct("id", "ticker", "p_success"), F.struct("p_success", -F.col("id")))
    return signals.where(F.col("p_success").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_success").alias("avg_p"), best.alias("b")
    ).select("n", "avg_p", F.col("b.id").alias("top_id"), F.col("b.ticker").alias("top_ticker"), F.col("b.p_success").alias("top_p"))
