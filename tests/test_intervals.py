"""As-of and interval joins at full time resolution."""

import datetime
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from flowlens.operators import intervals as iv

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_asof_on_one_hot_key(spark, slices):
    rng = random.Random(slices)
    quotes = [("A", at(rng.randrange(5000)), float(i)) for i in range(300)] + [("B", at(10), 7.0), ("A", None, 1.0), (None, at(3), 2.0), ("A", at(2), None)]
    rows = [(i, "A", at(rng.randrange(5200) - 100)) for i in range(500)] + [(1000, "B", at(9)), (1001, "B", at(10)), (1002, "C", at(50)), (1003, None, at(50)), (1004, "A", None)]
    q = spark.createDataFrame(quotes, "ticker string, ts timestamp, quote double")
    r = spark.createDataFrame(rows, "id long, ticker string, ts timestamp")
    got = {x.id: x.quote for x in iv.asof_tick(r, q, ["ticker"], "ts", ["quote"], slices=slices).collect()}
    assert len(got) == len(rows)
    for i, key, t in rows:
        mine = sorted((qt, v is not None, v or 0.0) for k, qt, v in quotes if k == key and k is not None and qt is not None and t is not None)
        j = bisect_right([x[0] for x in mine], t) if t is not None else 0
        want = None if not j else mine[j - 1][2] if mine[j - 1][1] else None
        assert got[i] == want


def test_a_hot_key_is_many_tasks(spark):
    q = spark.range(2000).select(F.lit("A").alias("ticker"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("v"))
    r = spark.range(20_000).select("id", F.lit("A").alias("ticker"), F.timestamp_seconds(F.col("id") / 10).alias("ts"))
    out = iv.asof_tick(r, q, ["ticker"], "ts", ["v"], slices=16)
    assert out.where(F.col("v") == F.floor(F.col("id") / 10)).count() == 20_000
    assert out.agg(F.count("*"), F.sum("v")).first()[0] == 20_000


@pytest.mark.parametrize("octaves", [1, 2, 5])
def test_intervals_of_all_lengths(spark, octaves):
    rng = random.Random(octaves)
    points = [(i, rng.choice("AB"), at(rng.randrange(100_000))) for i in range(400)] + [(900, None, at(5)), (901, "A", None)]
    spans = [0, 1, 2, 3, 59, 600, 7200, 86_400, 31_536_000, 315_360_000]
    held = []
    for i in range(300):
        a = rng.randrange(-1000, 100_000)
        held.append((i, rng.choice("AB"), at(a), at(a + rng.choice(spans))))
    held += [(900, "A", points[0][2], points[0][2]), (901, "A", at(9), at(5)), (902, None, at(0), at(9)), (903, "A", None, at(9)), (904, "B", at(-(10**9)), at(10**9))]
    p = spark.createDataFrame(points, "pid long, ticker string, ts timestamp")
    h = spark.createDataFrame(held, "iid long, ticker string, a timestamp, b timestamp")
    got = sorted((r.pid, r.iid) for r in iv.interval_join(p, h, ["ticker"], "ts", "a", "b", octaves).collect())
    want = sorted((x, y) for x, k, t in points for y, k2, a, b in held if k is not None and k == k2 and t is not None and a is not None and a <= t <= b)
    assert got == want


def test_no_row_is_repeated_by_the_length_of_an_interval(spark):
    h = spark.createDataFrame([(i, "A", at(0), at(10**s)) for i, s in enumerate(range(9))], "iid long, ticker string, a timestamp, b timestamp")
    p = spark.createDataFrame([(1, "A", at(1))], "pid long, ticker string, ts timestamp")
    assert iv.interval_join(p, h, ["ticker"], "ts", "a", "b").count() == 9
    assert iv.interval_join(p, h.where("false"), ["ticker"], "ts", "a", "b").count() == 0


def test_totals_equal_those_of_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.choice("AB"), at(rng.randrange(2000)), rng.choice([None, 0.5, 2.0])) for i in range(600)] + [(900, None, at(5), 1.0), (901, "A", None, 1.0), (902, "C", at(7), float("inf")), (903, "C", at(9), 3.0)]
    held = [(i, rng.choice("AB"), at(a), at(a + rng.choice([0, 1, 30, 900, 10**6]))) for i, a in ((i, rng.randrange(-100, 2100)) for i in range(300))]
    held += [(900, "C", at(8), at(99)), (901, "C", at(0), at(99)), (902, None, at(0), at(99)), (903, "A", at(9), at(5)), (904, "A", None, at(9)), (905, "D", at(0), at(9)), (1, "A", at(0), at(50))]
    p = spark.createDataFrame(points, "pid long, ticker string, ts timestamp, v double")
    h = spark.createDataFrame(held, "iid long, ticker string, a timestamp, b timestamp")
    totals = {"n": ("count", "*"), "known": ("count", "v"), "s": ("sum", "v"), "least": ("min", "pid"), "most": ("max", "pid")}
    got = sorted(((r.iid, r.ticker, r.a, r.b, r.n, r.known, r.s, r.least, r.most) for r in iv.interval_join(p, h, ["ticker"], "ts", "a", "b", totals=totals).collect()), key=repr)
    want = []
    for i, k, a, b in held:
        own = [(j, v) for j, k2, t, v in points if k is not None and k == k2 and t is not None and a is not None and a <= t <= b]
        if own:
            vs = [v for _, v in own if v is not None]
            want.append((i, k, a, b, len(own), len(vs), sum(vs) if vs else None, min(j for j, _ in own), max(j for j, _ in own)))
    assert got == sorted(want, key=repr)
    assert iv.interval_join(p, h.where("false"), ["ticker"], "ts", "a", "b", totals=totals).count() == 0
    assert iv.interval_join(p.where("false"), h, ["ticker"], "ts", "a", "b", totals=totals).count() == 0


def test_totals_do_not_list_pairs(spark):
    p = spark.range(20_000).select(F.lit("A").alias("ticker"), F.timestamp_seconds("id").alias("ts"), "id")
    h = spark.range(20_000).select("id", F.lit("A").alias("ticker"), F.timestamp_seconds(F.lit(0)).alias("a"), F.timestamp_seconds(F.col("id") + 10**6).alias("b"))
    x = iv.interval_join(p, h.withColumnRenamed("id", "iid"), ["ticker"], "ts", "a", "b", totals={"n": ("count", "*"), "last": ("max", "id")})
    assert x.agg(F.count("*"), F.min("n"), F.max("n"), F.min("last")).first()[:] == (20_000, 20_000, 20_000, 19_999)  # 400 million pairs
