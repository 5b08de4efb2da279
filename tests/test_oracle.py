"""Registered queries against their SQL counterparts. FLOWLENS_ALL=1 runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

CORE = (
    "load_chain select_expirations append_new_trades offhours_volume min_ratio_filter trend_contextual table_filters label_range_join "
    "next_event_join asof_price atm_pair_join params_cross scan_summary pcr_pivot live_summary technicals iv_rank market_regime "
    "first_per_ticker row_slice iv_smile expected_move bs_price greeks entry_cost mark_path path_outcome features label_trades dedup_12h fit_cell_quantiles "
    "monotonic_violations stratified_cv p_success classify_regime gaussian_signal walkforward_predict walkforward_purged elig_legacy "
    "ledger sweep_heatmap audit_by_ticker feature_distribution whale_crossing ks_two_sample chi2_two_sample validation_gate "
    "topk_unusual stream_whale_log stream_scan_summary label_merge append_indexed asof_tick interval_join boosted_histogram stream_settle "
    "stream_topk garman_klass_fine sma_flags_fine"
).split()
ORACLE = entry.oracle_sql()
NAMES = list(ORACLE) if os.environ.get("FLOWLENS_ALL") else CORE


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    status, detail = compare(entry.queries()[name](spark, sf), con.sql(ORACLE[name]))
    assert status in ("same", "close"), detail


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sketch_is_near_the_exact_walk_forward(spark, sf):
    from flowlens.plans import queries as reg

    exact = {r.id: r for r in reg.walkforward_predict(spark, sf).collect()}
    for r in reg.walkforward_sketch(spark, sf).collect():
        assert abs(r.p50 - exact[r.id].p50) < 0.02 and abs(r.p10 - exact[r.id].p10) < 0.02


def test_forest_quantiles_are_ordered(spark, sf):
    from flowlens.plans import queries as reg

    rows = reg.score_forest(spark, sf).collect()
    assert rows and all(r.p10 <= r.p25 <= r.p50 <= r.p75 <= r.p90 for r in rows)
