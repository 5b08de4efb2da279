"""Column expressions on hand-written edge rows."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import pricing as px, quotes as q, signals as sg
from flowlens.operators import scan as sc, vol
from flowlens.sources import tables as tb


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_ratio_and_whale(spark):
    df = spark.createDataFrame([(10, 0), (0, 5), (50, 10), (1, 3)], "volume long, open_interest long")
    assert [r.x for r in df.select(q.vol_oi_ratio().alias("x")).collect()] == [0.0, 0.0, 5.0, 0.33]
    assert one(spark, q.is_whale(F.lit(5.0))) and not one(spark, q.is_whale(F.lit(4.99)))
    assert one(spark, q.log_ratio(F.lit(9999.0), True)) == round(math.log1p(50), 4)


@pytest.mark.parametrize(
    "last,bid,ask,side",
    [(1.0, 1.0, 1.0, "MID"), (2.0, 1.0, 2.0, "BUY"), (1.0, 1.0, 2.0, "SELL"), (1.5, 1.0, 2.0, "MID"), (1.6, 1.0, 2.0, "BUY"),
     (1.4, 1.0, 2.0, "SELL"), (1.0, None, 2.0, "MID"), (None, 1.0, 2.0, "MID")],
)
def test_side(spark, last, bid, ask, side):
    assert one(spark, q.infer_side(*[F.lit(v).cast("double") for v in (last, bid, ask)])) == side


@pytest.mark.parametrize("date,weekly", [("2024-03-15", False), ("2024-06-21", False), ("2024-03-22", True), ("2024-10-17", True), ("bad", True)])
def test_weekly(spark, date, weekly):
    assert one(spark, q.is_weekly(F.lit(date))) is weekly


def test_trends_for_all_flags(spark):
    for a, b, call in itertools.product((True, False, None), (True, False, None), (True, False)):
        flags = [F.lit(v).cast("boolean") for v in (a, b)]
        simple = "BULL_ALIGNED" if a and b else "BEAR_ALIGNED" if not a and not b else "NEUTRAL"
        assert one(spark, q.trend_simple(*flags)) == simple
        bull, bear = a is True and b is not False, a is False or b is False
        want = (
            "UNKNOWN" if a is None else "BULL_ALIGNED" if bull and call else "BEAR_ALIGNED" if bear and not call
            else "BULL_CONTRARIAN" if bull and not call else "NEUTRAL"
        )
        assert one(spark, q.trend_contextual(*flags, F.lit("Call" if call else "Put"))) == want


def test_offhours_and_filters(spark):
    rows = [("A", 0, 5, None), ("A", 0, 0, 10), ("B", 3, 9, 20), ("B", 0, 9, None)]
    df = spark.createDataFrame(rows, "ticker string, volume long, open_interest long, dte int")
    df = df.withColumns({"snapshot_date": F.lit("2024-01-01"), "expiration": F.lit("x"), "strike": F.lit(1.0), "option_type": F.lit("Call"),
                         "premium": F.lit(None).cast("double"), "is_weekly": F.lit(None).cast("boolean")})
    got = sorted((r.ticker, r.volume) for r in sc.offhours_volume(df).collect())
    assert got == [("A", 0), ("A", 5), ("B", 0), ("B", 3)]
    assert sc.table_filters(df, min_dte=15, min_premium=1.0).count() == 3
    assert sc.table_filters(df, exclude_weeklies=True).count() == 0


def test_select_expirations_and_fallback(spark):
    rows = [("A", d) for d in (5, 10, 20, 30, 40, 50, 60, 95)] + [("B", d) for d in (100, 110, 120, 130, 140)]
    df = spark.createDataFrame(rows, "ticker string, d int").select(
        "ticker", F.to_date(F.lit("2024-01-01")).alias("snapshot_date"), F.date_add(F.to_date(F.lit("2024-01-01")), F.col("d")).alias("expiration"),
        "d", F.lit(1.0).alias("strike"), F.lit("Call").alias("option_type"), F.lit(1).alias("volume"))
    kept = tb.select_expirations(df).collect()
    assert sorted(r.d for r in kept if r.ticker == "A") == [5, 10, 20, 30, 40, 50]
    assert sorted(r.d for r in kept if r.ticker == "B") == [100, 110, 120, 130]


def test_sort_keeps_nulls_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("A",)], "s string")
    assert [r.s for r in sc.sort_any(df, "s").collect()] == ["A", "b", None]
    assert [r.s for r in sc.sort_any(df, "s", True).collect()] == ["b", "A", None]


def test_sanitize_and_defaults(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("-inf")), (3, 0.5)], "id long, v double")
    assert [r.v for r in tb.sanitize(df).orderBy("id").collect()] == [None, None, 0.5]
    r = tb.with_defaults(df.select("id")).first()
    assert r.labeled is False and r.is_synthetic == 0 and r.ensemble_id == 0 and r.ts is None


def exact_cdf(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def test_prices(spark):
    for s, k, t, v in ((100.0, 100.0, 0.5, 0.2), (120.0, 90.0, 0.1, 0.6), (80.0, 100.0, 1.0, 0.1)):
        args = [F.lit(x) for x in (s, k, t, v)]
        call, put = one(spark, px.bs_price(F.lit("Call"), *args)), one(spark, px.bs_price(F.lit("Put"), *args))
        d1 = (math.log(s / k) + (px.RATE + v * v / 2) * t) / (v * math.sqrt(t))
        want = s * exact_cdf(d1) - k * math.exp(-px.RATE * t) * exact_cdf(d1 - v * math.sqrt(t))
        assert call == pytest.approx(want, abs=2e-5)
        assert call - put == pytest.approx(s - k * math.exp(-px.RATE * t), abs=1e-9)
        g = one(spark, px.greeks(F.lit("Call"), *args))
        assert g.delta == pytest.approx(exact_cdf(d1), abs=1e-6) and g.gamma > 0 and g.vega > 0 and g.rho > 0
    flat = [F.lit(x) for x in (100.0, 90.0, 0.0, 0.2)]
    assert one(spark, px.bs_price(F.lit("Call"), *flat)) == 10.0 and one(spark, px.bs_price(F.lit("Put"), *flat)) == 0.0
    assert one(spark, px.greeks(F.lit("Call"), *flat)).delta == 1.0 and one(spark, px.greeks(F.lit("Call"), *flat)).vega == 0.0


def test_unknown_inputs_have_no_price_and_no_greeks(spark):
    rows = [(t, *[None if i == hole else v for i, v in enumerate((100.0, 90.0, year, 0.3))]) for t in ("Call", "Put") for hole in range(4) for year in (0.0, 0.5)]
    df = spark.createDataFrame([*rows, (None, 100.0, 90.0, 0.0, 0.3)], "type string, s double, k double, t double, v double")
    args = ("type", "s", "k", "t", "v")
    both = px.with_greeks(px.with_price(df, "p", *args), {"delta": "d", "vega": "g"}, *args).select("*", px.bs_price(*args).alias("p2"), px.greeks(*args).alias("g2"))
    for r in both.collect():
        assert r.p is None and r.p2 is None and r.d is None and r.g is None and set(r.g2) == {None}


def test_staged_columns_equal_the_expressions(spark):
    grid = itertools.product(("Call", "Put"), (80.0, 100.0, 0.0), (90.0, 100.0), (0.0, 1e-7, 0.1, 2.0), (0.0, 0.2, 1.5))
    df = spark.createDataFrame(list(grid), "type string, s double, k double, t double, v double")
    args = ("type", "s", "k", "t", "v")
    names = {g: f"{g}_x" for g in ("delta", "gamma", "vega", "theta", "rho")}
    both = px.with_greeks(px.with_price(df, "p", *args), names, *args).select("*", px.bs_price(*args).alias("p2"), px.greeks(*args).alias("g2"))
    for r in both.collect():
        assert r.p == r.p2 and all(r[x] == r.g2[g] for g, x in names.items())


def test_marked_paths_stay_compiled(spark, sf):
    """A stage that outgrows a compiled method raises here instead of falling back."""
    from flowlens.plans import queries as reg

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert reg.path_outcome(spark, sf).where("delta_hedged_return is not null").count() > 0
        assert reg.mark_path(spark, sf).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_success_probability(spark):
    qs = F.array(*[F.lit(v) for v in (0.10, -0.10, 0.0, 0.05, -0.05)])
    for target, p in ((-0.11, 0.98), (-0.10, 0.90), (0.0, 0.50), (0.025, 0.375), (0.10, 0.10), (0.11, 0.02)):
        assert one(spark, sg.p_success(qs, target)) == pytest.approx(p), target
    tied = F.array(*[F.lit(0.0)] * 4, F.lit(0.2))
    assert one(spark, sg.p_success(tied, 0.0)) == pytest.approx(0.25)
    falling = [one(spark, sg.p_success(qs, t / 100)) for t in range(-12, 13, 2)]
    assert falling == sorted(falling, reverse=True)


def bars_of(spark, closes):
    rows = [("A", i, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, i int, close double").select(
        "ticker", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("i")).alias("bar_date"), "close",
        F.col("close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"))


@pytest.mark.parametrize("n,above50,above200", [(49, None, None), (50, True, None), (199, True, None), (200, True, True)])
def test_sma_needs_enough_bars(spark, n, above50, above200):
    r = vol.sma_flags(bars_of(spark, range(1, n + 1))).first()
    assert (r.above50, r.above200) == (above50, above200)
    assert vol.technicals(bars_of(spark, range(1, n + 1))).count() == (0 if n < 50 else 1)


def test_iv_rank_edges(spark):
    assert tuple(vol.iv_rank(bars_of(spark, [100 + i % 7 for i in range(34)])).first())[1:] == (0.0, 0.0, 0.0)
    assert vol.iv_rank(bars_of(spark, [100 + i % 7 for i in range(35)])).first().current_iv > 0
    flat = vol.iv_rank(bars_of(spark, [100] * 60)).first()
    assert (flat.current_iv, flat.iv_rank, flat.iv_percentile) == (0.0, 0.0, 100.0)
