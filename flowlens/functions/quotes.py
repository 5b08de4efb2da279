"""Column expressions for option quotes: side, expiry, ratio, premium, trend, bounds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the feed contract
CONTRACT_SIZE = 100.0
WHALE_RATIO = 5.0
RATIO_SENTINEL = 9990.0
INDEX_TICKERS = ("SPY", "QQQ", "IWM", "DIA", "ARKK", "VIX")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x: Column, digits: int) -> Column:
    """Half-up rounding by floor; used where a rounded value feeds a later test."""
    k = F.lit(float(10**digits))
    return F.floor(x * k + F.lit(0.5)) / k


def numeric_or_zero(x: Column | str) -> Column:
    v = c(x).try_cast("double")
    return F.coalesce(F.when(F.isnan(v), None).otherwise(v), F.lit(0.0))


def vol_oi_ratio(volume: Column | str = "volume", open_interest: Column | str = "open_interest") -> Column:
    vol, oi = c(volume).cast("double"), c(open_interest).cast("double")
    return F.when(oi > 0, round_to(F.try_divide(vol, oi), 2)).otherwise(F.lit(0.0))


def infer_side(last: Column | str = "last_price", bid: Column | str = "bid", ask: Column | str = "ask") -> Column:
    """Buyer- or seller-initiated, from where the last print sits in the quote."""
    last, bid, ask = c(last), c(bid), c(ask)
    mid = (bid + ask) / 2
    unknown = last.isNull() | bid.isNull() | ask.isNull()
    return (
        F.when(unknown | (bid == ask), "MID")
        .when(last >= ask, "BUY")
        .when(last <= bid, "SELL")
        .when(last > mid, "BUY")
        .when(last < mid, "SELL")
        .otherwise("MID")
    )


def days_to_expiry(expiration: Column | str = "expiration", snapshot: Column | str = "snapshot_date") -> Column:
    """Calendar days; 0 where the expiration is missing or no date."""
    return F.coalesce(F.datediff(c(expiration).try_cast("date"), c(snapshot)), F.lit(0))


def is_weekly(expiration: Column | str = "expiration") -> Column:
    """False only for the standard monthly expiry, the Friday between the 15th and 21st."""
    d = c(expiration).try_cast("date")
    monthly = (F.weekday(d) == 4) & F.dayofmonth(d).between(15, 21)
    return ~F.coalesce(monthly, F.lit(False))


def notional(volume: Column | str = "volume", last: Column | str = "last_price") -> Column:
    return round_to(c(volume) * F.coalesce(c(last), F.lit(0.0)) * F.lit(CONTRACT_SIZE), 2)


def new_york_time(ts: Column | str = "last_trade_ts") -> Column:
    return F.date_format(F.from_utc_timestamp(c(ts), "America/New_York"), "yyyy-MM-dd HH:mm:ss")


def trend_simple(above50: Column | str = "above50", above200: Column | str = "above200") -> Column:
    """Two-way trend of a ticker; an unknown flag counts as not above."""
    a, b = F.coalesce(c(above50), F.lit(False)), F.coalesce(c(above200), F.lit(False))
    return F.when(a & b, "BULL_ALIGNED").when(~a & ~b, "BEAR_ALIGNED").otherwise("NEUTRAL")


def trend_contextual(
    above50: Column | str = "above50", above200: Column | str = "above200", option_type: Column | str = "option_type"
) -> Column:
    """Five-way trend that also looks at the option type; unknown 50-day flag is UNKNOWN."""
    a, b, call = c(above50), c(above200), c(option_type) == "Call"
    bull = a & F.coalesce(b, F.lit(True))
    bear = ~a | ~F.coalesce(b, F.lit(True))
    return (
        F.when(a.isNull(), "UNKNOWN")
        .when(bull & call, "BULL_ALIGNED")
        .when(bear & ~call, "BEAR_ALIGNED")
        .when(bull & ~call, "BULL_CONTRARIAN")
        .otherwise("NEUTRAL")
    )


def tri_state(flag: Column | str) -> Column:
    return F.when(c(flag), 1).when(~c(flag), 0).otherwise(-1)


def is_whale(ratio: Column | str = "vol_oi_ratio", floor: float = WHALE_RATIO) -> Column:
    return c(ratio) >= F.lit(floor)


def log_ratio(ratio: Column | str = "vol_oi_ratio", tame_sentinel: bool = False) -> Column:
    """log1p of the ratio; ``tame_sentinel`` replaces placeholder ratios above 9990 by 50."""
    r = c(ratio)
    if tame_sentinel:
        r = F.when(r > RATIO_SENTINEL, F.lit(50.0)).otherwise(r)
    return F.round(F.log1p(r), 4)


def finite_or_zero(x: Column | str) -> Column:
    v = c(x)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def move_bounds(price: Column | str = "underlier_price", move: Column | str = "expected_move") -> tuple[Column, Column]:
    p, m = finite_or_zero(price), finite_or_zero(move)
    return round_to(p + m, 2), round_to(p - m, 2)
