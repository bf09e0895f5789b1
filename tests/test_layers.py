import pytest
from pyspark.sql import functions as F

from lumenmart.operators import layers


def pairs(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_upsert_twice_is_once(spark):
    target, source = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (None, "n")], [(1, "b"), (2, "c"), (None, "m")]))
    once = layers.upsert(target, source, ["id"])
    assert pairs(once, "id", "v") == pairs(layers.upsert(once, source, ["id"]), "id", "v") == [("1", "b"), ("2", "c"), ("None", "m")]
    assert layers.upsert(target, source.limit(1), ["id"], full_refresh=True).count() == 1


def test_history(spark):
    current = spark.createDataFrame([(1, "free"), (2, "free"), (3, None)], "user_id int, plan string").select("*", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    source = spark.createDataFrame([(1, "premium"), (2, "free"), (3, None), (4, "new")], "user_id int, plan string")
    once = layers.history(current, source, "user_id", ["plan"], "2024-01-01")
    got = pairs(once, "user_id", "plan", "valid_from", "valid_to")
    assert got == [("1", "free", "2020-01-01", "2024-01-01"), ("1", "premium", "2024-01-01", "None"), ("2", "free", "2020-01-01", "None"), ("3", "None", "2020-01-01", "None"), ("4", "new", "2024-01-01", "None")]
    assert pairs(layers.history(once, source, "user_id", ["plan"], "2024-02-01"), "user_id", "plan", "valid_from", "valid_to") == got


def test_contract_policies(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", None, "5"), ("2", "z", "7"), ("bad", "y", "1")], "id string, name string, n string")
    contract = layers.Contract((layers.Field("id", "key", "int", "drop"), layers.Field("name", "name", "string", "default", "?"), layers.Field("n", "n", "int")), ("key",), ("n",), {"twice": "n * 2"})
    assert pairs(layers.clean(df, contract), "key", "name", "n", "twice") == [("1", "x", "None", "None"), ("2", "z", "7", "14")]
    strict = layers.Contract((layers.Field("n", "n", "int", "fail"),), ("n",))
    with pytest.raises(Exception, match="n is null"):
        layers.clean(df, strict).collect()


def test_increment_cascades():
    feeds = {"bronze": [], "silver": ["bronze"], "other": [], "gold": ["silver", "other"]}
    before = {n: layers.fingerprint(n) for n in feeds}
    assert set(layers.plan_increment(before, before, feeds).values()) == {"skip"}
    changed = before | {"bronze": "new"}
    assert layers.plan_increment(changed, before, feeds) == {"bronze": "build", "silver": "build", "other": "skip", "gold": "build"}


def test_history_with_null_keys(spark):
    current = spark.createDataFrame([(None, "free")], "user_id int, plan string").select("*", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    source = spark.createDataFrame([(None, "free")], "user_id int, plan string")
    assert layers.history(current, source, "user_id", ["plan"], "2024-01-01").count() == 1


def test_publish_only_what_passes(spark, tmp_path):
    path = str(tmp_path / "t")
    held = lambda: layers.published(spark, path).count()
    assert layers.publish(spark.range(3), path, [lambda t: layers.nulls(t, "id")]) == 0 and held() == 3
    assert layers.publish(spark.range(9), path, [lambda t: layers.outside(t, "id", high=4)]) == 4 and held() == 3
    assert layers.publish(layers.published(spark, path).filter("id > 0"), path) == 0 and held() == 2


def test_repeated_source_keys(spark):
    """Of two source rows of a key one counts: the later one where an order is given."""
    target = spark.createDataFrame([(1, 0, "a"), (None, 0, "n")], "k int, at int, v string")
    source = spark.createDataFrame([(1, 2, "new"), (1, 1, "old"), (1, None, "none"), (2, None, "x"), (2, None, "y"), (None, 1, "m"), (None, 0, "l")], "k int, at int, v string")
    assert pairs(layers.upsert(target, source, ["k"], latest=["at"]), "k", "v") == [("1", "new"), ("2", "y"), ("None", "m")]
    current = target.select(F.col("k"), "v", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    got = layers.history(current, source, "k", ["v"], "2024-01-01", latest=["at"])
    assert pairs(got.filter("valid_to IS NULL"), "k", "v") == [("1", "new"), ("2", "y"), ("None", "m")] and got.filter("valid_to IS NOT NULL").count() == 2
    contract = layers.Contract((layers.Field("k", "k", "int"), layers.Field("v", "v", "string")), ("k",))
    assert layers.clean(source.repartition(3), contract).count() == 3


def test_backfill_is_bounded(spark):
    days = spark.sql("SELECT date_add(DATE '2024-01-01', cast(id AS int)) AS d, 'old' AS v FROM range(60)")
    new = days.withColumn("v", F.lit("new"))
    got = layers.backfill(days, new, "d", "2024-01-10", "2024-01-12")
    assert got.count() == 60 and got.filter("v = 'new'").count() == 3
    with pytest.raises(layers.Refused):
        layers.backfill(days, new, "d", "2024-01-01", "2024-02-15")
    assert layers.backfill(days, new, "d", "2024-01-01", "2024-02-15", confirmed=True).filter("v = 'new'").count() == 46


def test_append_once_and_pull(spark, tmp_path):
    path = str(tmp_path / "t")
    assert layers.append_once(spark.range(3), path, "job") and not layers.append_once(spark.range(3), path, "job")
    assert layers.published(spark, path).count() == 3
    source = spark.createDataFrame([(1, 5, "a"), (2, 9, "b"), (None, 7, "n")], "id int, at int, v string")
    since = lambda mark: source if mark is None else source.filter(F.col("at") > mark)
    once = layers.pull(None, since, ["id"], "at")
    assert pairs(layers.pull(once, since, ["id"], "at"), "id", "v") == pairs(source, "id", "v")


def test_late_rows_do_not_win(spark, tmp_path):
    """Two starts of a stream: the second finds the state of the first, and its late row does not take the place of a later one."""
    from lumenmart.streaming import streams

    base, schema = f"file://{tmp_path}", "user int, at int, v string"
    for rows in ([(1, 5, "first"), (2, 1, "x")], [(1, 3, "late"), (2, 8, "new"), (None, 1, "n")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        streams.upsert_batches(streams.files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema), f"{base}/state", ["user"], "at", f"{base}/checkpoint")
    got = streams.upserted(spark, f"{base}/state")
    assert pairs(got, "user", "v") == [("1", "first"), ("2", "new"), ("None", "n")]
