"""The shared building blocks against brute force, also on very uneven groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import joins, labels as lb, scale, walkforward as wf
from flowlens.operators.model import EVERY


def test_number_rows_with_one_dominant_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("k"))
    rows = scale.number_rows(df, ["k", "id"], slices=7).collect()
    want = {r: i for i, r in enumerate(sorted((r.k, r.id) for r in rows))}
    assert all(want[(r.k, r.id)] == r.idx for r in rows)


def test_value_bucket_grows_with_value(spark):
    values = sorted({0.0, *[s * 10.0**e * m for s in (-1, 1) for e in range(-8, 9) for m in (1, 1.0001, 3.7)]})
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scale.value_bucket(F.col("v")).alias("b"))
    got = [r.b for r in df.orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) == 69  # 1 and 1.0001 share a bucket


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=901), "b": np.round(rng.exponential(100, 400), 1), "c": np.array([3.0]), "d": np.repeat([-2.0, 0.0, 5.0], [50, 9, 1])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, v double")
    df = df.unionByName(spark.createDataFrame([("a", None), ("a", float("nan")), ("b", float("inf"))], "g string, v double"))
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    for r in scale.exact_quantiles(df, ["g"], "v", probs).collect():
        assert r.n == len(data[r.g])
        assert np.allclose(r.q, np.quantile(data[r.g], probs), atol=1e-12)


def test_expanding_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i % 3}" if i % 5 else "c0", int(a), round(float(y), 4)) for i, (a, y) in enumerate(zip(rng.integers(0, 8, 700), rng.normal(0, 0.3, 700)))]
    rows += [(EVERY, a, y) for _, a, y in rows]
    counts = spark.createDataFrame(rows, "cell string, avail int, y double").groupBy("cell", "avail", "y").agg(F.count(F.lit(1)).alias("c"))
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    got = wf.expanding_quantiles(counts, F.lit(8), probs).collect()
    assert len(got) == 4 * 8
    for r in got:
        ys = [y for cell, a, y in rows if cell == r.cell and a <= r.fold]
        assert r.n == len(ys) and np.allclose(r.q, np.quantile(ys, probs), atol=1e-12)


def expanding_counts(spark, folds):
    """Three cells, of which one has no rows in most folds, and few values."""
    rows = [(c, a, (7 * a + 3 * i) % 40 / 50 - 0.3) for c in ("x", "y") for a in range(folds) for i in range(9)]
    rows += [("z", a, a / 400) for a in range(5, folds + 40, 45)]
    df = spark.createDataFrame(rows, "cell string, avail int, y double")
    return rows, df.groupBy("cell", "avail", "y").agg(F.count(F.lit(1)).alias("c")).localCheckpoint()


def test_expanding_quantiles_over_many_spans_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(wf, "SPAN", 150, raising=False)
    rows, counts = expanding_counts(spark, 100)
    probs = (0.1, 0.5, 0.9)
    got = {(r.cell, r.fold): r for r in wf.expanding_quantiles(counts, F.lit(100), probs).collect()}
    assert set(got) == {(c, f) for c, first in (("x", 0), ("y", 0), ("z", 5)) for f in range(first, 100)}
    for (cell, fold), r in got.items():
        ys = [y for c, a, y in rows if c == cell and a <= fold]
        assert r.n == len(ys) and np.allclose(r.q, np.quantile(ys, probs), atol=1e-12)


def shuffled(plan):
    """Rows written by all exchanges of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return shuffled(plan.plan())
    found = plan.metrics().get("shuffleRecordsWritten")
    return (found.get().value() if found.isDefined() else 0) + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_expanding_quantiles_move_rows_not_folds_times_values(spark, monkeypatch):
    monkeypatch.setattr(wf, "SPAN", 600, raising=False)
    monkeypatch.setattr(wf, "materialize", lambda df: df)
    rows, counts = expanding_counts(spark, 300)
    found = wf.expanding_quantiles(counts, F.lit(300))
    assert found.count() == 300 + 300 + 295
    found.collect()
    assert len(rows) < shuffled(found._jdf.queryExecution().executedPlan()) < 10 * len(rows)


def keep_rule(times, gap):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last > gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("max_group", [1, 2000])
def test_dedup_equals_the_sequential_rule(spark, max_group):
    """Key 0 holds a third of all rows; with max_group=1 all keys take the day-by-day way."""
    rng = np.random.default_rng(3)
    hour = 3600
    rows, i = [], 0
    for key, n, span in ((0, 900, 40), (1, 300, 400), (2, 500, 9), (3, 40, 60), (4, 1, 1), (5, 600, 365)):
        for t in rng.integers(0, span * 24 * hour, n):
            rows.append((i, key, int(t)))
            i += 1
    for h in (0, 8, 16, 20, 28, 29):
        rows.append((i, 9, h * hour))
        i += 1
    df = spark.createDataFrame(rows, "id long, k int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {}
    for r in lb.dedup_12h(df, ["k"], max_group=max_group).collect():
        got.setdefault(r.k, []).append(r.t)
    for key in {k for _, k, _ in rows}:
        assert sorted(got[key]) == keep_rule([t for _, k, t in rows if k == key], 12 * hour), key
    assert sorted(got[9]) == [0, 16 * hour, 29 * hour]


def test_joins_are_the_same_without_broadcast(spark, sf, no_broadcast):
    from flowlens.plans import queries as reg

    a = sorted(map(tuple, reg.label_trades(spark, sf).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert a == sorted(map(tuple, reg.label_trades(spark, sf).collect()))


def test_asof_and_range_on_edges(spark):
    bars = spark.createDataFrame([("A", "2020-01-02", 10.0), ("A", "2020-01-10", 12.0)], "ticker string, d string, close double")
    bars = bars.select("ticker", F.to_date("d").alias("bar_date"), "close")
    t = spark.createDataFrame([(1, "A", "2020-01-01"), (2, "A", "2020-01-02"), (3, "A", "2020-01-09"), (4, "A", "2020-02-01"), (5, "B", "2020-01-05")], "id long, ticker string, d string")
    t = t.select("id", "ticker", F.to_date("d").alias("trade_date"))
    assert {r.id: r.spot for r in joins.asof_price(t, bars, "trade_date").collect()} == {1: None, 2: 10.0, 3: 10.0, 4: 12.0, 5: None}
    pairs = sorted((r.id, r.close) for r in joins.label_range_join(t, bars, 8).collect())
    assert pairs == [(1, 10.0), (2, 10.0), (2, 12.0), (3, 12.0)]


def test_next_event(spark):
    cal = spark.createDataFrame([("E", "A", "2020-01-10"), ("E", "A", "2020-03-01"), ("M", None, "2020-02-01")], "kind string, ticker string, d string")
    cal = cal.select("kind", "ticker", F.to_date("d").alias("event_date"))
    t = spark.createDataFrame([(1, "A", "2020-01-10"), (2, "A", "2020-01-11"), (3, "A", "2020-03-03"), (4, "B", "2020-01-30")], "id long, ticker string, d string")
    t = t.select("id", "ticker", F.to_date("d").alias("trade_date"))
    own = {r.id: (r.days_to_e, r.near_e) for r in joins.days_to_event(t, cal, "E", 3, "e").collect()}
    assert own == {1: (0, 1), 2: (50, 0), 3: (-2, 1), 4: (None, 0)}
    market = {r.id: r.days_to_m for r in joins.days_to_event(t, cal, "M", 1, "m", per_ticker=False).collect()}
    assert market == {1: 22, 2: 21, 3: -31, 4: 2}


@pytest.fixture
def eager_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_driver_holds_no_table_of_folds(spark, eager_broadcast):
    counts = spark.range(400).selectExpr("cast(id % 2 as string) as cell", "cast(id % 40 as int) as avail", "id / 100 as y", "1L as c")
    fitted = [wf.expanding_quantiles(counts, F.lit(40)), wf.expanding_sketches(counts, counts, F.lit(40))]
    rows = spark.range(400).selectExpr("id", "id as idx", "cast(id div 40 as int) - 1 as fold", "id / 100 as observed_return", "cast(id % 2 as string) as k")
    predicted = wf.walkforward_predict(rows, keys=["k"])
    for df in [*fitted, predicted]:
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan
