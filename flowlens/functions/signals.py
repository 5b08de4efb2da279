"""Column expressions that turn predicted quantiles into probabilities, classes and sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.functions.pricing import lit, norm_cdf
from flowlens.functions.quotes import c

# Levels of the five quantiles, clip of the success probability,
# default 10-day volatility, offsets of the no-model quantiles
LEVELS = (0.10, 0.25, 0.50, 0.75, 0.90)
P_LOW, P_HIGH = 0.02, 0.98
DEFAULT_MOVE = 0.04
FLAT_CENTER = 0.03
FLAT_OFFSETS = (-0.05, -0.025, 0.0, 0.025, 0.05)


def monotonic(q: Column | str) -> Column:
    return F.array_sort(c(q))


def p_success(q: Column | str, target: Column | float) -> Column:
    """Chance that the return reaches ``target``, linear between the sorted quantiles."""
    x = monotonic(q)
    x = [x[i] for i in range(5)]
    t = target if isinstance(target, Column) else lit(target)
    cdf = F.when(t >= x[4], lit(LEVELS[4]))
    for j in (3, 2, 1, 0):
        slope = F.try_divide(t - x[j], x[j + 1] - x[j])
        cdf = cdf.when(t >= x[j], lit(LEVELS[j]) + slope * lit(LEVELS[j + 1] - LEVELS[j]))
    inside = F.least(F.greatest(lit(1) - cdf, lit(P_LOW)), lit(P_HIGH))
    return F.when(t < x[0], lit(P_HIGH)).when(t > x[4], lit(P_LOW)).otherwise(inside)


def horizon_vol(hv_pct: Column | str, horizon: int = 10) -> Column:
    v = c(hv_pct) / 100 * F.sqrt(lit(horizon / 252.0))
    return F.when(F.coalesce(v, lit(0)) <= 0, lit(DEFAULT_MOVE)).otherwise(v)


def classify_regime(q: Column | str, hv_pct: Column | str, horizon: int = 10) -> tuple[Column, Column]:
    """Expected market regime and a 0-100 confidence from the distance to the cut-offs."""
    q, v = c(q), horizon_vol(hv_pct, horizon)
    spread, median = q[4] - q[0], q[2]
    wide, turn = lit(1.5) * v, lit(0.25) * v
    regime = (
        F.when(spread >= wide, "VOL_EXPANSION")
        .when(F.abs(median) < turn, "SIDEWAYS")
        .otherwise(F.when(median > 0, "BULLISH_BREAKOUT").otherwise("BEARISH_BREAKDOWN"))
    )
    over = F.abs(spread - wide) / F.greatest(wide, lit(1e-6))
    away = F.abs(F.abs(median) - turn) / F.greatest(turn, lit(1e-6))
    raw = F.when(spread >= wide, over).otherwise(F.least(over, away)) * 100
    return regime, F.round(F.least(F.greatest(raw, lit(0)), lit(100)), 2)


def kelly_from_odds(p: Column, odds: Column) -> Column:
    return F.try_divide(p * odds - (lit(1) - p), odds)


def kelly_quantile(q: Column | str, p: Column | str, cap: float = 0.25) -> tuple[Column, Column]:
    """Capped and raw Kelly fraction with the quantile distances as the payoff odds."""
    q, p = c(q), c(p)
    odds = F.greatest(F.greatest(q[4] - q[2], lit(1e-6)) / F.greatest(q[2] - q[0], lit(1e-6)), lit(0.01))
    raw = kelly_from_odds(p, odds)
    return F.greatest(F.least(raw, lit(cap)), lit(0)), raw


def flat_quantiles() -> Column:
    return F.array(*[lit(FLAT_CENTER + o) for o in FLAT_OFFSETS])


def heuristic_score(
    ratio: Column | str = "vol_oi_ratio", trend: Column | str = "trend_alignment", side: Column | str = "side"
) -> Column:
    """Score of a row while no model is fitted yet."""
    s = (
        lit(0.5)
        + F.when(c(ratio) > 5, 0.1).otherwise(0.0)
        + F.when(c(trend).isin("BULL_ALIGNED", "BEAR_ALIGNED"), 0.15).otherwise(0.0)
        + F.when(c(side) == "BUY", 0.05).otherwise(0.0)
    )
    return F.least(s, lit(0.95))


def open_trade_score(trend: Column | str = "trend_alignment", side: Column | str = "side") -> Column:
    """The shorter rule for open trades: no ratio term, and only a bullish trend counts."""
    s = lit(0.5) + F.when(c(trend) == "BULL_ALIGNED", 0.15).otherwise(0.0) + F.when(c(side) == "BUY", 0.05).otherwise(0.0)
    return F.least(s, lit(0.95))


def contrarian(trend: Column | str = "trend_alignment", option_type: Column | str = "option_type") -> Column:
    t, o = c(trend), c(option_type)
    return ((t == "BULL_ALIGNED") & (o == "Put")) | ((t == "BEAR_ALIGNED") & (o == "Call"))


def gaussian_signal(
    q: Column | str = "q", profit: float = 0.50, shift: float = 0.025, spread_cap: float = 0.20, p_floor: float = 0.55
) -> Column:
    """Normal-shape variant: struct of p_success, kelly (cap 0.05) and strategy class."""
    q = c(q)
    mu, sigma = q[2], F.greatest((q[3] - q[1]) / lit(1.349), lit(1e-6))
    p = F.least(F.greatest(lit(1) - norm_cdf((lit(profit) - mu) / sigma) + lit(shift), lit(P_LOW)), lit(P_HIGH))
    odds = F.when(mu > 0, mu).otherwise(lit(0.08))
    kelly = F.least(F.greatest((p * (1 + odds) - 1) / (odds + lit(1e-6)), lit(0)), lit(0.05))
    iqr, iv = q[3] - q[1], c("implied_vol")
    ratio = c("volume") / (c("open_interest") + lit(1e-6))
    liquid = ratio.between(3.0, 50.0) & c("dte").between(14, 30)
    good = (p >= p_floor) & (iqr <= spread_cap) & (mu >= 0.04)
    banded = liquid & iv.between(15, 150) & good
    # the contrarian class asks for everything the first one does, so it can never be reached
    kind = (
        F.when(banded, "whale_quality")
        .when(banded & contrarian(), "contrarian_trend")
        .when(liquid & (((iv < 25) & (p >= 0.60)) | ((iv > 50) & (iqr <= 0.30))), "vol_regime")
        .otherwise("NONE")
    )
    return F.struct(p.alias("p_success"), kelly.alias("kelly"), kind.alias("strategy"))
