"""Black-Scholes prices, greeks and the implied-volatility model as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.quotes import c

RATE = 0.045
COMMISSION = 1.10

# Coefficients of the standard five-term polynomial of the normal
# distribution function (absolute error about 1e-7)
CDF_SCALE = 0.2316419
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def lit(x: float) -> Column:
    return F.lit(float(x))


def norm_pdf(x: Column) -> Column:
    return F.exp(lit(-0.5) * x * x) / lit(math.sqrt(2 * math.pi))


def norm_cdf(x: Column) -> Column:
    """Written without branches, so that Spark evaluates the repeated parts once per row."""
    t = lit(1) / (lit(1) + lit(CDF_SCALE) * F.abs(x))
    poly = lit(0)
    for a in reversed(CDF_TERMS):
        poly = (poly + lit(a)) * t
    return lit(0.5) + F.signum(x) * (lit(0.5) - norm_pdf(x) * poly)


def _known(*inputs: Column) -> Column:
    known = F.lit(True)
    for x in inputs:
        known = known & x.isNotNull()
    return known


def _deviation(t: Column, vol: Column, ok: Column) -> Column:
    """Deviation of the log price; NULL where the model does not apply."""
    return F.when(ok, vol * F.sqrt(t))


def _d1(s: Column, k: Column, t: Column, vol: Column, dev: Column) -> Column:
    return F.try_divide(F.log(F.try_divide(s, k)) + (lit(RATE) + vol * vol / 2) * t, dev)


def _price(put: Column, s: Column, k: Column, t: Column, vol: Column, n1: Column, n2: Column) -> Column:
    paid = k * F.exp(lit(-RATE) * t)
    model = s * n1 - paid * n2 + F.when(put, paid - s).otherwise(lit(0))
    intrinsic = F.greatest(F.when(put, k - s).otherwise(s - k), lit(0))
    return F.coalesce(model, F.when(_known(put, s, k, t, vol), intrinsic))


def _greeks(call: Column, s: Column, k: Column, t: Column, vol: Column, n1: Column, n2: Column, pdf: Column) -> dict[str, Column]:
    paid = k * F.exp(lit(-RATE) * t)
    shift = F.when(call, lit(0)).otherwise(lit(-1))
    owed = paid * (n2 + shift)
    step = F.when(call & (s > k), 1.0).when(~call & (s < k), -1.0).otherwise(0.0)
    live = {
        "delta": n1 + shift,
        "gamma": F.try_divide(pdf, s * vol * F.sqrt(t)),
        "vega": s * pdf * F.sqrt(t),
        "theta": -s * pdf * F.try_divide(vol, 2 * F.sqrt(t)) - lit(RATE) * owed,
        "rho": t * owed,
    }
    known = _known(call, s, k, t, vol)
    return {name: F.coalesce(e, F.when(known, step if name == "delta" else lit(0))) for name, e in live.items()}


def _price_applies(s: Column, k: Column, t: Column, vol: Column) -> Column:
    return (t > 0) & (vol > 0) & (s > 0) & (k > 0)


def _greeks_apply(s: Column, k: Column, t: Column, vol: Column) -> Column:
    return (t >= 1e-6) & (vol >= 1e-6) & (s > 0) & (k > 0)


def bs_price(option_type: Column | str, s: Column | str, k: Column | str, t: Column | str, vol: Column | str) -> Column:
    """European price; intrinsic value where time, volatility or a price is not positive, NULL where an input is.

    The put comes from the call by parity, so each distribution value is needed once.
    """
    put = c(option_type) != "Call"
    s, k, t, vol = c(s), c(k), c(t), c(vol)
    dev = _deviation(t, vol, _price_applies(s, k, t, vol))
    d1 = _d1(s, k, t, vol, dev)
    return _price(put, s, k, t, vol, norm_cdf(d1), norm_cdf(d1 - dev))


def greeks(option_type: Column | str, s: Column | str, k: Column | str, t: Column | str, vol: Column | str) -> Column:
    """Struct of delta, gamma, vega, theta and rho (per unit of each input); NULL fields where an input is NULL."""
    call = c(option_type) == "Call"
    s, k, t, vol = c(s), c(k), c(t), c(vol)
    dev = _deviation(t, vol, _greeks_apply(s, k, t, vol))
    d1 = _d1(s, k, t, vol, dev)
    return F.struct(*[e.alias(name) for name, e in _greeks(call, s, k, t, vol, norm_cdf(d1), norm_cdf(d1 - dev), norm_pdf(d1)).items()])


def _with_terms(df: DataFrame, s: Column, k: Column, t: Column, vol: Column, ok: Column) -> DataFrame:
    """Adds the terms that price and greeks share, each computed and compiled once.

    As one nested expression they outgrow a compiled method, and a later filter on the price
    would be moved below a projection with all of it unfolded. What ``inline`` generates is not.
    """
    df = df.withColumn("__dev", _deviation(t, vol, ok)).withColumn("__d1", _d1(s, k, t, vol, F.col("__dev")))
    d1, d2 = F.col("__d1"), F.col("__d1") - F.col("__dev")
    df = df.select("*", F.inline(F.array(F.struct(d1.alias("__a"), d2.alias("__b")))))
    return df.select("*", F.inline(F.array(F.struct(norm_cdf(F.col("__a")).alias("__n1"), norm_cdf(F.col("__b")).alias("__n2")))))


_TERMS = ("__dev", "__d1", "__a", "__b", "__n1", "__n2")


def with_price(df: DataFrame, name: str, option_type: Column | str, s: Column | str, k: Column | str, t: Column | str, vol: Column | str) -> DataFrame:
    """Adds ``bs_price`` of the given columns as ``name``; the form to use on many rows."""
    put = c(option_type) != "Call"
    s, k, t, vol = c(s), c(k), c(t), c(vol)
    df = _with_terms(df, s, k, t, vol, _price_applies(s, k, t, vol))
    return df.withColumn(name, _price(put, s, k, t, vol, F.col("__n1"), F.col("__n2"))).drop(*_TERMS)


def with_greeks(df: DataFrame, names: dict[str, str], option_type: Column | str, s: Column | str, k: Column | str, t: Column | str, vol: Column | str) -> DataFrame:
    """Adds the chosen ``greeks`` under the names that ``names`` gives them; the form to use on many rows."""
    call = c(option_type) == "Call"
    s, k, t, vol = c(s), c(k), c(t), c(vol)
    df = _with_terms(df, s, k, t, vol, _greeks_apply(s, k, t, vol))
    values = _greeks(call, s, k, t, vol, F.col("__n1"), F.col("__n2"), norm_pdf(F.col("__a")))
    return df.withColumns({alias: values[g] for g, alias in names.items()}).drop(*_TERMS)


def skew_adjustment(moneyness: Column | str, dte: Column | str) -> Column:
    m = c(moneyness)
    return lit(0.15) * m * m - lit(0.10) * m * F.sqrt(lit(30) / c(dte))


def model_iv(base_vol: Column | str, vix: Column | str, skew: Column | str) -> Column:
    """At-the-money volatility scaled by the index level, plus skew, never under 0.10."""
    return F.greatest(c(base_vol) * (lit(0.7) + lit(0.3) * F.sqrt(c(vix) / 20)) + c(skew), lit(0.10))


def strike_step(price: Column | str) -> Column:
    return F.when(c(price) > 200, 5.0).when(c(price) > 50, 2.5).otherwise(1.0)


def spread_pct(moneyness: Column | str, dte: Column | str) -> Column:
    return lit(0.015) + lit(0.04) * F.abs(c(moneyness)) + lit(0.02) / F.sqrt(c(dte) / 30)
