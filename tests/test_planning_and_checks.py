import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.functions import columns as c
from lumenmart.operators import profiling, verify
from lumenmart.plans import joins
from lumenmart.sources import files


def edges():
    return [joins.Edge("shipments", "order_id", "orders", "id"), joins.Edge("shipments", "carrier_id", "carriers", "id"), joins.Edge("shipments", "depot_id", "depots", "id"), joins.Edge("invoices", "order_id", "orders", "id")]


def test_base_is_where_the_question_can_be_answered():
    rows = {"orders": 120_000, "shipments": 95_000, "invoices": 110_000, "carriers": 10, "depots": 5}
    assert joins.base_scores(edges(), {"carriers": 1, "orders": 1, "depots": 1}, rows)[0][0] == "shipments"
    assert joins.fan_traps(edges()) == [("orders", "invoices", "shipments")]
    assert joins.path(edges(), "orders", "shipments") is None


def test_star_keeps_rows_and_names(spark):
    fact = spark.createDataFrame([(1, 10), (2, 10), (3, 99), (4, None)], "id int, dim_ref int")
    dim = spark.createDataFrame([(10, "ten")], "id int, name string")
    out = joins.star({"fact": fact, "dim": dim}, [joins.Edge("fact", "dim_ref", "dim", "id")], "fact", ["dim"])
    assert out.columns == ["id", "dim_ref", "dim_id", "name"] and out.count() == 4
    with pytest.raises(joins.NoJoinPath):
        joins.star({"fact": fact, "dim": dim}, [], "fact", ["dim"])


def test_proof_by_data(spark):
    left, right = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int"), spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert joins.resolution(left, "k", right, "k").first().asDict() == {"values": 3, "resolved": 2, "ratio": 0.666667}
    assert joins.prove("l", left, "k", "r", right, "k").confidence == 0.45
    assert joins.prove("l", left, "k", "r", right.distinct(), "k").confidence == 0.7
    assert [r.k for r in joins.orphans(left, "k", right, "k").collect()] == [3]


def test_profile_equals_counting(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b"), (None, 4.0, None), (4, 1.0, "a")], "id int, amount double, name string")
    got = {r.column_name: (r["rows"], r.nulls, r.distinct_values, r.least) for r in profiling.profile(df).collect()}
    assert got == {"id": (4, 1, 3, "1"), "amount": (4, 1, 3, "1.0"), "name": (4, 1, 2, "a")}


def test_leaves_and_downcast(spark):
    kind = T._parse_datatype_string("a struct<b: int, c: array<int>>, d string")
    assert [n for n, _ in profiling.leaves(kind)] == ["a.b", "a.c[]", "d"]
    df = spark.createDataFrame([(127, 128, 40_000), (-128, 0, 3_000_000_000)], "a long, b long, c long")
    assert {r.column_name: r.kind for r in profiling.downcast(df, ["a", "b", "c"]).collect()} == {"a": "tinyint", "b": "smallint", "c": "bigint"}


def test_anomaly_rules(spark):
    points = [("k", i, float(v)) for i, v in enumerate((10, 12, 11, 13, 20))] + [("flat", i, float(v)) for i, v in enumerate((100, 100, 100, 100, 150))] + [("few", 0, 1.0), ("few", 1, 9.0)]
    got = {r.s: (r.median, r.mad, r.flagged) for r in profiling.anomalies(spark.createDataFrame(points, "s string, t int, v double"), "s", "t", "v").collect()}
    assert got == {"k": (11.5, 1.0, True), "flat": (100.0, 0.0, True), "few": (1.0, 0.0, False)}


def test_parity(spark):
    rows = [("Medicare", 10, 1234.56), ("Medicaid", 7, 789.01), (None, 1, None)]
    a = spark.createDataFrame(rows, "payor string, n int, paid double")
    drift = spark.createDataFrame([*rows[:2], (None, 1, 0.01)], "payor string, n int, paid double")
    assert verify.differing_rows(a, a.select("paid", "n", "payor")).count() == 0 and verify.differing_rows(a, drift).count() == 2
    assert verify.signature(a).first() == verify.signature(a.orderBy("n")).first() != verify.signature(drift).first()
    assert verify.reproduces(a.dropna(), a.dropna(), ["payor"], "paid")
    assert verify.heavy_operators(a.crossJoin(a.select(F.col("n").alias("m")))) and not verify.heavy_operators(a.join(a.select("n"), "n"))


def test_dates_read_both_ways(spark):
    row = spark.sql("SELECT date('1970-12-31') AS b, date('2024-01-01') AS d, TIMESTAMP_NTZ '2024-01-01 00:59:00' AS s, TIMESTAMP_NTZ '2024-01-01 01:01:00' AS e").select(
        c.age_calendar(F.col("b"), F.col("d")), c.age_completed(F.col("b"), F.col("d")), c.elapsed("HOUR", F.col("s"), F.col("e")), c.boundaries("HOUR", F.col("s"), F.col("e"))
    ).first()
    assert tuple(row) == (54, 53, 0, 1)


def test_unknown_members(spark):
    df = spark.createDataFrame([(None, None, None)], "n int, s string, b boolean")
    row = df.select(*[c.unknown_member(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(row) == (-1, "Unknown", None)


def test_csv_rescues_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\nbad,y\n")
    got = {(r.id, r._rescued) for r in files.read(spark, str(tmp_path / "a.csv"), schema="id int, v string").cache().collect()}
    assert got == {(1, None), (None, "bad,y")}
    with pytest.raises(ValueError, match="no known format"):
        files.format_of("x.xyz")
