from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenmart.operators import kpi, proof, verify
from lumenmart.plans import trees


def tables(spark):
    a = spark.range(10).select("id", (F.col("id") % 3).alias("g"), F.col("id").alias("x"), F.lit("s").alias("s"))
    b = spark.range(3).select(F.col("id").alias("k"), F.lit("name").alias("name"))
    return a.select("*").alias("a"), b


def parquet(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return spark.read.parquet(str(tmp_path / f"{name}.parquet"))


def test_lineage_follows_ids(spark, tmp_path):
    a, b = tables(spark)
    a, b = parquet(spark, tmp_path, a, "a"), parquet(spark, tmp_path, b, "b")
    made = a.withColumn("y", F.col("x") * 2).withColumn("x", F.col("g")).join(b, F.col("g") == F.col("k")).filter("s = 's'")
    out = made.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("y"))).select(F.col("y").alias("z"), "x", "nth")
    assert set(verify.column_lineage(out)) == {
        ("a.x", "z", "derived"), ("a.g", "x", "derived"), ("b.name", "nth", "derived"), ("a.x", "nth", "derived"), ("a.g", "*", "joined"), ("b.k", "*", "joined"), ("a.s", "*", "filtered"),
    }
    both = a.select("x").union(b.select("k"))
    assert verify.column_lineage(both) == [("a.x", "x", "derived"), ("b.k", "x", "derived")]
    exploded = a.select("id", F.explode(F.array("x", "g")).alias("e"))
    assert set(verify.column_lineage(exploded)) == {("a.id", "id", "derived"), ("a.x", "e", "derived"), ("a.g", "e", "derived")}
    semi = a.join(b, F.col("g") == F.col("k"), "left_semi").cube("s").agg(F.max("id").alias("m"))
    assert {("a.s", "s", "derived"), ("a.id", "m", "derived"), ("b.k", "*", "joined")} <= set(verify.column_lineage(semi))


def test_forms_say_the_same(spark, tmp_path):
    a = parquet(spark, tmp_path, tables(spark)[0], "a")
    form = lambda text: trees.Plan(a.withColumn("y", F.col("x") + 1).filter(text)).tests()
    assert form("x > 5") == form("5 < x") == form("x > 5.0") != form("x >= 5") and form("x > 5") != form("x > 6") and form("g > 5") != form("x > 5")
    assert form("s IN ('b', 'a')") == form("s IN ('a', 'b')") != form("s IN ('a', 'c')") and form("s = 'a' AND x = 1") == form("1 = x AND s = 'a'")
    assert form("y = 3") == form("x + 1 = 3") and form("x BETWEEN 2 AND 4") == form("x <= 4 AND 2 <= x")


def test_ratios_and_joins_are_covered(spark, tmp_path):
    a, b = tables(spark)
    a, b = parquet(spark, tmp_path, a, "a"), parquet(spark, tmp_path, b, "b")
    rows, asked = a.join(b, F.col("g") == F.col("k")), kpi.read("sum(x) / sum(id)", "name")
    good = kpi.answer(rows, asked)
    assert verify.coverage(asked, good, [("k", "g")]) == [] and verify.coverage(asked, good, [("id", "k")]) == ["join: id = k lacks"]
    other = replace(asked, measures=(asked.measures[0], kpi.Measure("count", "id")))
    assert verify.coverage(asked, kpi.answer(rows, other)) == ["ratio: denominator sum_id lacks"]
    listed = kpi.read("count(*)", "name, s in ('s', 't')", "with at most 5 rows")
    assert verify.coverage(listed, kpi.answer(rows, listed)) == []
    assert verify.coverage(listed, kpi.answer(rows, replace(listed, filters=("s in ('s')",), having=("<", 5.0)))) == ["filter: s IN ('s', 't') lacks", "bound: count_rows <= 5 lacks"]


def test_scope_is_what_the_plan_states(spark, tmp_path):
    a, b = tables(spark)
    a = a.withColumn("d", F.expr("date_add(DATE '2020-01-01', CAST(x AS int))")).withColumn("p", F.expr("CAST(x AS decimal(12, 2))"))
    a, b = parquet(spark, tmp_path, a, "a"), parquet(spark, tmp_path, b, "b")
    scope = lambda df: proof.stated_scope(df, ["id", "g", "X", "s", "d", "p", "name"])
    assert scope(a.groupBy("g").count()) == {}
    assert scope(a.filter("x > 2 AND 8 >= x AND s = 's'").filter("x > 4").groupBy("g").count()) == {"X": {"gt": 4, "to": 8}, "s": "s"}
    assert scope(a.filter("g IN (0, 1, 2)").filter("g IN (1, 2, 3) AND g < 2").groupBy("s").count()) == {"g": 1}
    assert scope(a.filter("d >= '2020-01-03' AND p < 5.5").select("g")) == {"d": {"from": "2020-01-03"}, "p": {"lt": 5.5}}
    assert scope(a.filter(F.col("d") == F.to_date(F.lit("2020-01-03")))) is None
    assert scope(a.withColumnRenamed("s", "t").filter("t = 's'").join(b.filter("name = 'name'"), F.col("g") == F.col("k"))) == {"s": "s", "name": "name"}
    assert scope(a.filter("x BETWEEN 2 AND 4").join(b, F.col("g") == F.col("k"), "left").orderBy("x").limit(3)) == {"X": {"from": 2, "to": 4}}
    refused = [
        a.filter("x > 1 OR g = 1"), a.filter("s LIKE 's%'"), a.filter("x + 1 = 2"), a.filter("NOT x = 2"), a.filter("x = g"), a.filter("s IS NULL"), a.filter("CAST(d AS string) = '2020'"),
        a.groupBy("g").agg(F.sum("x").alias("n")).filter("n > 1"), a.filter("x = 1").union(a), a.join(b.filter("k = 1"), F.col("g") == F.col("k"), "left"),
        a.join(b, F.col("g") == F.col("k"), "left_semi"), a.limit(3).groupBy("g").count(), a.sample(0.5).groupBy("g").count(), b.filter("k = 1"),
    ]
    assert [scope(df) for df in refused] == [None] * len(refused)


def test_rows_of_a_result_only_where_they_give_its_numbers(spark, tmp_path):
    a = parquet(spark, tmp_path, tables(spark)[0], "a")
    gold = a.filter("x >= 3").groupBy("g").agg(F.sum("x").alias("n"))
    assert sorted(r.x for r in proof.scoped_rows(gold, "n", "g", a, "x").collect()) == list(range(3, 10))
    assert proof.scoped_rows(gold, "n", "g", a.withColumn("x", F.col("x") + 1), "x") is None
    assert proof.measure_behind(gold, "n", ["g"], a, ["id", "x"]) == ("id", {"x": {"from": 3}})
