"""Join planning and the shapes of joins that metrics use."""

from pyspark.sql import functions as F

from lumenmart.functions import columns as c
from lumenmart.operators import temporal
from lumenmart.plans import joins
from lumenmart.registry import register, table

EDGES = [
    joins.Edge("lineitem", "l_orderkey", "orders", "o_orderkey"), joins.Edge("lineitem", "l_partkey", "part", "p_partkey"), joins.Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    joins.Edge("orders", "o_custkey", "customer", "c_custkey"), joins.Edge("customer", "c_nationkey", "nation", "n_nationkey"), joins.Edge("nation", "n_regionkey", "region", "r_regionkey"),
]


def tables(spark, sf_dir, *names):
    return {n: table(spark, sf_dir, n) for n in names}


@register(
    "join_key_uniqueness",
    """SELECT 'l_orderkey' AS key, round(count(DISTINCT l_orderkey) / count(l_orderkey), 6) AS ratio FROM lineitem
    UNION ALL SELECT 'l_linenumber', round(count(DISTINCT l_linenumber) / count(l_linenumber), 6) FROM lineitem""",
)
def key_uniqueness(spark, sf_dir):
    return joins.uniqueness(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@register(
    "join_reference_resolution",
    """SELECT count(*) AS values, count(r) AS resolved, round(count(r) / count(*), 6) AS ratio FROM (SELECT DISTINCT o_custkey AS l FROM orders)
    LEFT JOIN (SELECT DISTINCT c_custkey AS r FROM customer WHERE c_mktsegment <> 'BUILDING') ON l = r""",
)
def reference_resolution(spark, sf_dir):
    return joins.resolution(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey")


@register("join_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def orphans(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return joins.orphans(table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey").select("o_orderkey", "o_custkey")


@register(
    "join_star_by_plan",
    """SELECT r_name, p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def star_by_plan(spark, sf_dir):
    found = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region", "part")
    needed = {"lineitem": 1, "region": 1, "part": 1}
    base = joins.base_scores(EDGES, needed, {"lineitem": 1})[0][0]
    return joins.star(found, EDGES, base, list(needed)).groupBy("r_name", "p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


def _proven(many, column, one, key):
    return f"""SELECT '{many}' AS many, '{column}' AS column_name, '{one}' AS one, (SELECT CASE WHEN count(DISTINCT {key}) / count({key}) < 0.99 THEN 0.45 WHEN (SELECT count(r) / count(*) FROM (SELECT DISTINCT {column} AS l FROM {many} WHERE {column} IS NOT NULL)
    LEFT JOIN (SELECT DISTINCT {key} AS r FROM {one}) ON l = r) >= 0.5 THEN 0.7 ELSE 0.62 END FROM {one})::DOUBLE AS confidence"""


PROVEN = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_orderkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "supplier", "s_nationkey")]


@register("join_proven_edges", " UNION ALL ".join(_proven(*e) for e in PROVEN))
def proven_edges(spark, sf_dir):
    """Over whole tables: two references that hold, one that mostly finds nothing, and one to a column that is no key."""
    found = tables(spark, sf_dir, "orders", "customer", "lineitem", "nation", "supplier")
    edges = [joins.prove(many, found[many], column, one, found[one], key) for many, column, one, key in PROVEN]
    return spark.createDataFrame([(e.many, e.column, e.one, e.confidence) for e in edges], "many string, column_name string, one string, confidence double")


@register(
    "join_wide_table_with_unknown_members",
    """SELECT o_orderkey, coalesce(c_name, 'Unknown') AS c_name, coalesce(c_nationkey, -1) AS c_nationkey, coalesce(c_acctbal, -1) AS c_acctbal FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""",
)
def wide_table(spark, sf_dir):
    found = {"orders": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")}
    wide = joins.star(found, EDGES, "orders", ["customer"])
    return wide.select("o_orderkey", *[c.unknown_member(F.col(n), wide.schema[n].dataType).alias(n) for n in ("c_name", "c_nationkey", "c_acctbal")])


@register(
    "join_recurrence_within_days",
    """SELECT o_orderkey, EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate AND p.o_orderdate >= o.o_orderdate - INTERVAL 30 DAY) AS again FROM orders o""",
)
def recurrence(spark, sf_dir):
    """Whether the customer ordered in the 30 days before: a range frame, no self-join."""
    from pyspark.sql import Window

    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    w = Window.partitionBy("o_custkey").orderBy("at").rangeBetween(-30 * 86_400_000_000, -1)
    return table(spark, sf_dir, "orders").withColumn("at", micros).select("o_orderkey", (F.count(F.lit(1)).over(w) > 0).alias("again"))


@register(
    "join_value_in_effect",
    """WITH price AS (SELECT user_id, ts AS since, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '9999-01-01') AS until, event_id AS price_id FROM events WHERE event_type = 'signup')
    SELECT e.event_id, p.price_id FROM events e JOIN price p ON e.user_id = p.user_id AND e.ts >= p.since AND e.ts < p.until WHERE e.event_type = 'purchase'""",
)
def value_in_effect(spark, sf_dir):
    """Purchases with the user's last sign-up before them."""
    events = table(spark, sf_dir, "events")
    price = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("price_id"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.as_of(bought, price, ["user_id"], "ts", "since", ["price_id"], tie=["price_id"], inner=True).select("event_id", "price_id")


@register(
    "join_within_overlapping",
    """WITH w AS (SELECT user_id, event_id AS w, ts AS a, ts + INTERVAL 36 HOUR AS b FROM events WHERE event_type = 'error')
    SELECT w, count(*) AS n, round(sum(value), 2) AS total FROM events e JOIN w ON e.user_id = w.user_id AND e.ts BETWEEN a AND b GROUP BY w""",
)
def within_overlapping(spark, sf_dir):
    """What each user did in the 36 hours after each of their errors; these windows overlap."""
    events = table(spark, sf_dir, "events")
    windows = events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("w"), F.col("ts").alias("a"), F.expr("ts + INTERVAL 36 HOURS").alias("b"))
    found = temporal.within(events.select("user_id", "ts", "value"), windows, ["user_id"], F.col("ts"), "a", "b")
    return found.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register(
    "join_display_names",
    "SELECT coalesce(n_name, s_nationkey::VARCHAR) AS nation, count(*) AS suppliers FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey GROUP BY 1",
)
def display_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    named = table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return named.groupBy(F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))


@register(
    "join_compare_distributions",
    """WITH a AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1),
    b AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT coalesce(a.v, b.v) AS value, round(coalesce(a.p, 0), 6) AS whole, round(coalesce(b.p, 0), 6) AS part FROM a FULL JOIN b ON a.v = b.v""",
)
def compare_distributions(spark, sf_dir):
    from pyspark.sql import Window

    share = lambda df, name: df.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n")).select("value", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    orders = table(spark, sf_dir, "orders")
    both = share(orders, "whole").join(share(orders.filter("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"), "part"), "value", "full")
    return both.select("value", F.round(F.coalesce("whole", F.lit(0)), 6).alias("whole"), F.round(F.coalesce("part", F.lit(0)), 6).alias("part"))
