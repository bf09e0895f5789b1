import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenmart.operators import profiling, temporal

DAY = datetime(2024, 1, 1)


def made(seed, n, hot=0.4):
    r = random.Random(seed)
    key = lambda: 0 if r.random() < hot else r.choice([1, 2, 3, None])
    when = lambda: None if r.random() < 0.05 else DAY + timedelta(hours=r.randrange(0, 240))
    return [(key(), when(), i) for i in range(n)]


def test_as_of_equals_brute_force(spark):
    left, right = made(1, 300), made(2, 200)
    got = temporal.as_of(
        spark.createDataFrame(left, "k int, t timestamp_ntz, id int").repartition(3), spark.createDataFrame(right, "k int, s timestamp_ntz, v int").repartition(5), ["k"], "t", "s", ["v"], tie=["v"],
    )
    assert got.columns == ["k", "t", "id", "v"]
    found = {r.id: r.v for r in got.collect()}
    assert len(found) == 300
    for k, t, i in left:
        before = [(s, v) for key, s, v in right if key == k and s is not None and t is not None and s <= t]
        assert found[i] == (max(before)[1] if before else None)
    few = temporal.as_of(spark.createDataFrame(left, "k int, t timestamp_ntz, id int"), spark.createDataFrame(right, "k int, s timestamp_ntz, v int").limit(0), ["k"], "t", "s", ["v"])
    assert few.filter("v IS NOT NULL").count() == 0 and few.count() == 300
    with pytest.raises(ValueError):
        temporal.as_of(spark.createDataFrame(left, "k int, t timestamp_ntz, v int"), spark.createDataFrame(right, "k int, s timestamp_ntz, v int"), ["k"], "t", "s", ["v"])


def test_a_hot_key_is_many_windows(spark):
    """No join by key alone, and windows over rows by key and day."""
    rows = spark.createDataFrame(made(1, 50), "k int, t timestamp_ntz, id int")
    plan = temporal.as_of(rows, rows.select("k", F.col("t").alias("s"), F.col("id").alias("v")), ["k"], "t", "s", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("_step" in line for line in joins)
    raw = [line for line in plan.splitlines() if "Window" in line and "_v#" in line]
    assert raw and all("_step" in line.split("], [")[1] for line in raw)


@pytest.mark.parametrize("closed", [True, False])
def test_within_equals_brute_force(spark, closed):
    points, starts, r = made(3, 200), made(4, 80), random.Random(5)
    spans = [(k, s, None if r.random() < 0.2 or s is None else s + timedelta(hours=r.randrange(-5, 100)), v) for k, s, v in starts]
    got = temporal.within(
        spark.createDataFrame(points, "k int, t timestamp_ntz, id int"), spark.createDataFrame(spans, "k int, a timestamp_ntz, b timestamp_ntz, v int"), ["k"], F.col("t"), "a", "b", closed,
    )
    inside = lambda t, b: b is None or t <= b if closed else b is None or t < b
    want = sorted((i, v) for k, t, i in points for key, a, b, v in spans if k is not None and key == k and t is not None and a is not None and a <= t and inside(t, b))
    assert sorted((x.id, x.v) for x in got.collect()) == want


def test_a_large_mean_costs_no_digits(spark):
    rows = spark.createDataFrame([(1e9, "a"), (1e9 + 1, "b"), (None, "a"), (5.0, None)], "y double, g string")
    assert profiling.eta_squared(rows, "g", "y").first()[0] == 1.0
    assert profiling.eta_squared(rows.limit(0), "g", "y").first()[0] is None
    many = spark.range(10_000).select((F.lit(1e12) + F.col("id") % 7).alias("y"), (F.col("id") % 7 > 2).alias("g"))
    assert abs(profiling.eta_squared(many, "g", "y").first()[0] - 0.7501) < 0.001


def test_a_null_series_is_one(spark):
    rows = [(s, k, float(v)) for s in ("a", None) for k, v in enumerate([10, 12, 11, 13, 20])] + [("one", 0, 1.0)]
    got = {r.s: (r["last"], r.median, r.mad, r.flagged) for r in profiling.anomalies(spark.createDataFrame(rows, "s string, k int, v double"), "s", "k", "v").collect()}
    assert got == {"a": (20.0, 11.5, 1.0, True), None: (20.0, 11.5, 1.0, True)}


def test_names_with_dots(spark):
    rows = spark.createDataFrame([(1, (2,)), (None, (3,))], "`a.b` int, s struct<x:int>")
    assert {r.column_name: (r.nulls, r.greatest) for r in profiling.profile(rows).collect()} == {"a.b": (1, "1"), "s.x": (0, "3")}
