"""Explicit schemas of the landed tables."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
        "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    }
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


CHAIN = _struct(
    "ticker string, snapshot_date date, expiration date, strike double, option_type string, volume bigint,"
    "open_interest bigint, last_price double, bid double, ask double, implied_vol double,"
    "underlier_price double, last_trade_ts timestamp"
)

BARS = _struct("ticker string, bar_date date, open double, high double, low double, close double, volume bigint")

CALENDAR = _struct("kind string, ticker string, event_date date")

TRADES = _struct(
    "id bigint, ts timestamp, ticker string, expiration date, strike double, option_type string, volume bigint,"
    "open_interest bigint, vol_oi_ratio double, implied_vol double, underlier_price double, premium double,"
    "side string, dte int, is_weekly boolean, trend_alignment string, labeled boolean, label_success int,"
    "observed_return double, max_adverse_return double, evaluation_date date, is_synthetic int,"
    "delta_entry double, gamma_entry double, vega_entry double, theta_entry double, rho_entry double,"
    "delta_exit double, gamma_exit double, vega_exit double, theta_exit double, rho_exit double,"
    "ensemble_id int, commission_per_contract double, bid_ask_spread_pct double, early_exercise_risk int,"
    "delta_hedged_return double, days_to_earnings int, is_earnings_window int, days_to_fomc int,"
    "is_fomc_day int, vix_regime string, market_regime string"
)

PARAMS = _struct(
    "run_id bigint, strategy_type string, prob_threshold double, kelly_multiplier double, kelly_cap double,"
    "hard_stop_loss double, stop_lambda double, max_quantile_spread double, vol_oi_floor double,"
    "min_median_return double, profit_threshold double, min_kelly_fraction double, slippage_pct double,"
    "max_risk_pct_per_trade double, initial_capital double, min_open_interest int, min_dte int, max_dte int,"
    "use_costs boolean"
)

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
