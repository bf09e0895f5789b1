"""Cleaning contracts, upserts, history, increments and assertions."""

from pyspark.sql import functions as F

from lumenmart.operators import layers
from lumenmart.registry import register, table


def snapshots(spark, sf_dir):
    """Two states of the customers: some gone, some new, some with another segment."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    after = customer.filter("c_custkey % 10 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 3, "MOVED").otherwise(F.col("c_mktsegment")))
    return customer.filter("c_custkey % 10 <> 2"), after


OLD = "(SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 2)"
NEW = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 1)"


@register("merge_upsert", f"SELECT * FROM {NEW} UNION ALL SELECT * FROM {OLD} WHERE c_custkey NOT IN (SELECT c_custkey FROM {NEW})")
def merge_upsert(spark, sf_dir):
    return layers.upsert(*snapshots(spark, sf_dir), ["c_custkey"])


@register("merge_full_refresh", f"SELECT * FROM {NEW}")
def merge_full_refresh(spark, sf_dir):
    return layers.upsert(*snapshots(spark, sf_dir), ["c_custkey"], full_refresh=True)


@register(
    "merge_history",
    f"""SELECT o.c_custkey, o.c_mktsegment, DATE '2020-01-01' AS valid_from, CASE WHEN n.c_mktsegment IS DISTINCT FROM o.c_mktsegment AND n.c_custkey IS NOT NULL THEN DATE '2024-01-01' END AS valid_to
    FROM {OLD} o LEFT JOIN {NEW} n USING (c_custkey)
    UNION ALL SELECT n.c_custkey, n.c_mktsegment, DATE '2024-01-01', NULL FROM {NEW} n LEFT JOIN {OLD} o USING (c_custkey) WHERE o.c_mktsegment IS DISTINCT FROM n.c_mktsegment""",
)
def merge_history(spark, sf_dir):
    """Applied twice: the second time changes nothing."""
    before, after = snapshots(spark, sf_dir)
    current = before.select("c_custkey", "c_mktsegment", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    once = layers.history(current, after, "c_custkey", ["c_mktsegment"], "2024-01-01")
    return layers.history(once, after, "c_custkey", ["c_mktsegment"], "2024-02-01")


@register(
    "merge_inferred_members",
    """SELECT c_custkey, c_mktsegment, false AS is_inferred FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT DISTINCT o_custkey, NULL, true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def merge_inferred_members(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_mktsegment")
    return layers.inferred_members(known, table(spark, sf_dir, "orders"), "o_custkey", "c_custkey")


@register("merge_lookback", "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts)::DATE - 3 FROM events) GROUP BY 1")
def merge_lookback(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").cast("date").cast("string")).first()[0]  # null, and no rows, where the table is empty
    return layers.lookback(events, "ts", latest).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


CONTRACT = layers.Contract(
    fields=(
        layers.Field("event_id", "id", "bigint", "fail"), layers.Field("user_id", "who", "string", pii=True), layers.Field("kind", "kind", "string", "default", "none"),
        layers.Field("amount", "amount", "double", "drop"), layers.Field("ts", "at", "timestamp_ntz"),
    ),
    keys=("who",), latest=("at", "id"), derived={"large": "amount > 50"}, salt="pepper",
)


@register(
    "silver_contract",
    """SELECT id, who, kind, amount, "at", amount > 50 AS large FROM (SELECT event_id AS id, sha256(user_id::VARCHAR || 'pepper') AS who, coalesce(nullif(event_type, 'view'), 'none') AS kind,
    TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE value::VARCHAR END AS DOUBLE) AS amount, ts AS "at" FROM events) WHERE amount IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY who ORDER BY "at" DESC, id DESC) = 1""",
)
def silver_contract(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'view')"))
    return layers.clean(events.withColumn("amount", F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))), CONTRACT)


@register(
    "quality_assertions",
    """SELECT 'not_null' AS test, count(*) AS failing FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL
    UNION ALL SELECT 'unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'range', count(*) FROM lineitem WHERE l_quantity < 2 OR l_quantity > 48
    UNION ALL SELECT 'accepted_values', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT 'relationship', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
    UNION ALL SELECT 'row_count', count(*) FROM (SELECT count(*) AS n FROM orders) WHERE abs(n - 1) > 0.5
    UNION ALL SELECT 'not_empty', 0""",
)
def quality_assertions(spark, sf_dir):
    from lumenmart.plans import joins

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    known = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    tests = {
        "not_null": layers.nulls(orders.select(F.expr("nullif(o_orderstatus, 'P')").alias("s")), "s"), "unique": layers.repeated(items, "l_orderkey", "l_linenumber"),
        "range": layers.outside(items, "l_quantity", 2, 48), "accepted_values": layers.not_accepted(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]),
        "relationship": joins.orphans(orders, "o_custkey", known, "c_custkey"), "row_count": layers.count_changed(orders, 1, 0.5),
        "not_empty": orders.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"),
    }
    out = None
    for name, failing in tests.items():
        one = failing.agg(F.count(F.lit(1)).alias("failing")).select(F.lit(name).alias("test"), "failing")
        out = one if out is None else out.unionByName(one)
    return out


@register("quality_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def quality_repeated_keys(spark, sf_dir):
    return layers.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
