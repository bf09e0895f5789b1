"""Samples and their likeness, certificates, contract tests, tiers, cadence, cost attribution and lessons."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.operators import attribution, profiling, quality, sampling
from lumenmart.queries.kpi import STAR, star
from lumenmart.registry import register, table

HASH = "('0x' || substr(md5({k}::VARCHAR || '|{s}'), 1, 8))::BIGINT % 1000000"


def ranked(source, stratum, fraction, key="o_orderkey"):
    """SQL of quotas: of each stratum the rows whose hashes come first."""
    return f"""SELECT * EXCLUDE (k, n) FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({key}::VARCHAR || '|42'), {key}) AS k, count(*) OVER (PARTITION BY {stratum}) AS n
    FROM {source}) WHERE k <= greatest(round(n * {fraction}), 1)"""


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@register("sample_quotas", f"SELECT o_orderkey, o_orderpriority FROM ({ranked('orders', 'o_orderpriority, o_orderstatus', 0.1)})")
def sample_quotas(spark, sf_dir):
    return sampling.quotas(orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 0.1).select("o_orderkey", "o_orderpriority")


@register("sample_too_many_strata", f"SELECT o_orderkey FROM orders WHERE {HASH.format(k='o_orderkey', s=42)} < 100000")
def sample_too_many_strata(spark, sf_dir):
    return sampling.quotas(orders(spark, sf_dir), ["o_custkey"], "o_orderkey", 0.1, limit=20).select("o_orderkey")


CUTS = "(SELECT list_distinct([" + ", ".join(f"quantile_cont(o_totalprice, {k / 10})" for k in range(1, 10)) + "]) FROM orders)"
TARGET = f"(SELECT *, len(list_filter({CUTS}, lambda c: o_totalprice > c)) AS target FROM orders)"


@register("sample_by_target", f"SELECT o_orderkey FROM ({ranked(TARGET, 'target', 0.05)})")
def sample_by_target(spark, sf_dir):
    return sampling.by_target(orders(spark, sf_dir), "o_totalprice", "o_orderkey", 0.05).select("o_orderkey")


@register("sample_hybrid", f"SELECT o_orderkey FROM ({ranked(TARGET, 'o_orderstatus, target', 0.05)})")
def sample_hybrid(spark, sf_dir):
    return sampling.by_target(orders(spark, sf_dir), "o_totalprice", "o_orderkey", 0.05, ["o_orderstatus"]).select("o_orderkey")


TAILS = f"""(SELECT * FROM orders WHERE {HASH.format(k='o_orderkey', s=42)} < 50000 UNION SELECT * FROM orders WHERE {HASH.format(k='o_orderkey', s=59)} < 150000
    AND (o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.01) FROM orders) OR o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)))"""


def tailed(spark, sf_dir):
    full = orders(spark, sf_dir)
    return sampling.with_tails(sampling.hashed(full, "o_orderkey", 50), full, ["o_totalprice"], "o_orderkey", 0.05)


@register("sample_with_tails", f"SELECT o_orderkey FROM {TAILS}")
def sample_with_tails(spark, sf_dir):
    return tailed(spark, sf_dir).select("o_orderkey")


@register(
    "sample_likeness",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(sum(d) / 2, 6) AS distance, round(max(d), 6) AS largest FROM (SELECT abs(coalesce(a.n, 0) / (SELECT count(*) FROM orders) - coalesce(b.n, 0) / (SELECT count(*) FROM {TAILS})) AS d
        FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT {c} AS v, count(*) AS n FROM {TAILS} GROUP BY 1) b USING (v))""" for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def sample_likeness(spark, sf_dir):
    return sampling.distance(orders(spark, sf_dir), tailed(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


def _stats(source, name):
    each = [("mean", "avg(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"), *((q, f"quantile_cont(o_totalprice, {at})") for q, at in sampling.QUANTILES.items())]
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round({x}, 4) AS {name} FROM {source}" for m, x in each)


@register("sample_numbers", f"""SELECT 'o_totalprice' AS "column", metric, "full", sample, round(sample - "full", 4) AS delta FROM ({_stats('orders', '"full"')}) JOIN ({_stats(TAILS, 'sample')}) USING (metric)""")
def sample_numbers(spark, sf_dir):
    return sampling.numbers(orders(spark, sf_dir), tailed(spark, sf_dir), ["o_totalprice"])


@register(
    "sample_tail_shares",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) "
    + " UNION ALL ".join(
        f"""SELECT 'o_totalprice' AS "column", '{side}' AS tail, round((SELECT avg((o_totalprice {test})::INT) FROM orders, q), 6) AS full_share, round((SELECT avg((o_totalprice {test})::INT) FROM {TAILS}, q), 6) AS sample_share"""
        for side, test in (("low", "<= lo"), ("high", ">= hi"))
    ),
)
def sample_tail_shares(spark, sf_dir):
    return sampling.tail_shares(orders(spark, sf_dir), tailed(spark, sf_dir), ["o_totalprice"])


def _cells(source):
    edges = lambda c: f"(SELECT list_sort(list_distinct([{', '.join(f'quantile_cont({c}, {k / 10})' for k in range(11))}])) FROM lineitem)"
    place = lambda c: f"len(list_filter(list_slice({edges(c)}, 2, len({edges(c)}) - 1), lambda e: {c} >= e))"
    return f"SELECT bx, by_, count(*) / sum(count(*)) OVER () AS p FROM (SELECT {place('l_quantity')} AS bx, {place('l_extendedprice')} AS by_ FROM {source}) GROUP BY 1, 2"


LINES = f"(SELECT * FROM lineitem WHERE {HASH.format(k='l_orderkey', s=42)} < 100000)"


@register(
    "sample_joint_distance",
    f"SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS distance FROM ({_cells('lineitem')}) a FULL JOIN ({_cells(LINES)}) b USING (bx, by_)",
)
def sample_joint_distance(spark, sf_dir):
    full = table(spark, sf_dir, "lineitem")
    return sampling.joint_distance(full, sampling.hashed(full, "l_orderkey", 100), "l_quantity", "l_extendedprice")


HASHED = "('0x' || substr(md5(o_orderkey::VARCHAR || '|42'), 1, 8))::BIGINT % 1000000"


@register(
    "sample_score",
    f"""WITH f AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1),
    s AS (SELECT k, o_orderpriority AS v, count(*) / sum(count(*)) OVER (PARTITION BY k) AS q FROM orders JOIN (VALUES ('small', 10), ('large', 300)) AS t(k, m) ON {HASHED} < m * 1000 GROUP BY 1, 2),
    d AS (SELECT k, round(sum(abs(p - coalesce(q, 0))) / 2, 6) AS d FROM (SELECT k, f.v, p, q FROM f CROSS JOIN (SELECT DISTINCT k FROM s) LEFT JOIN s USING (k, v)) GROUP BY k)
    SELECT k AS name, round(100 * (1 - d), 2) AS score, CASE WHEN 100 * (1 - d) < 90 THEN 'increase_pct_or_candidates' ELSE 'use_current_sample' END AS advice FROM d""",
)
def sample_score(spark, sf_dir):
    """Scores of a small and a large sample of the orders, by how far their priorities are from the table's."""
    full, out = table(spark, sf_dir, "orders"), []
    for name, per_mille in (("small", 10), ("large", 300)):
        off = sampling.distance(full, sampling.hashed(full, "o_orderkey", per_mille), ["o_orderpriority"]).first()["distance"]
        out.append((name, *sampling.score({"distribution": off})))
    return spark.createDataFrame(out, "name string, score double, advice string")


@register("sample_transfer")
def sample_transfer(spark, sf_dir):
    """A forest of a tenth of the lines explains the price of all of them nearly as well; no SQL says that."""
    full = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    got = sampling.transfer(full, sampling.hashed(full, "l_orderkey", 100), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(k, round(v, 3)) for k, v in got.items()], "metric string, value double")


# Quality
ORPHANED = "(SELECT *, CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_custkey END AS cust FROM orders)"


def orphaned(spark, sf_dir):
    return orders(spark, sf_dir).withColumn("cust", F.when(F.col("o_orderkey") % 40 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))


@register(
    "quality_certificate",
    f"""WITH f AS {ORPHANED}, m AS (SELECT * FROM f LEFT JOIN customer ON cust = c_custkey), d AS (FROM m UNION ALL FROM m WHERE o_orderkey % 100 = 0)
    SELECT 'null_keys' AS "check", count(*) FILTER (cust IS NULL) + count(*) FILTER (o_totalprice IS NULL) = 0 AS ok, count(*) FILTER (cust IS NULL) + count(*) FILTER (o_totalprice IS NULL)::DOUBLE AS seen, 0::DOUBLE AS allowed FROM d
    UNION ALL SELECT 'no_fanout', (SELECT count(*) FROM d) = (SELECT count(*) FROM f), (SELECT count(*) FROM d) - (SELECT count(*) FROM f)::DOUBLE, 0
    UNION ALL SELECT 'referential[cust]', avg((c_custkey IS NULL)::INT) <= 0.02, avg((c_custkey IS NULL)::INT), 0.02 FROM m
    UNION ALL SELECT 'lossless[o_totalprice]', abs((SELECT sum(o_totalprice) FROM d) / sum(o_totalprice) - 1) <= 1e-6, round(abs((SELECT sum(o_totalprice) FROM d) - sum(o_totalprice)) / sum(o_totalprice), 9), 1e-6 FROM f
    UNION ALL SELECT 'gold_subset[finished]', true, 0, 1e-6""",
)
def quality_certificate(spark, sf_dir):
    """A join in which some rows came twice and some customers are missing: the certificate says so, and that a result is within the whole."""
    fact, customer = orphaned(spark, sf_dir), table(spark, sf_dir, "customer")
    joined = fact.join(customer, F.col("cust") == F.col("c_custkey"), "left")
    joined = joined.unionByName(joined.filter("o_orderkey % 100 = 0"))
    gold = fact.filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("sum_o_totalprice"))
    return quality.certify(joined, fact, ["cust"], ["o_totalprice"], {"cust": (customer, "c_custkey")}, {"finished": (gold, "sum_o_totalprice", "o_totalprice")})


@register("quality_shares", f"SELECT c_mktsegment, round(sum(share), 2) AS total FROM (SELECT c_mktsegment, o_orderstatus, count(*) / sum(count(*)) OVER () * 100 AS share FROM {STAR} GROUP BY 1, 2) GROUP BY 1 HAVING abs(round(sum(share), 2) - 100) > 0.5")
def quality_shares(spark, sf_dir):
    """Shares of the whole, tested as if they were shares of their segment: none of the groups adds up."""
    counted = star(spark, sf_dir).groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("whole"))
    return quality.shares_add_up(counted.join(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("whole") * 100), "share", ["c_mktsegment"])


@register(
    "quality_relationships",
    f"""SELECT 'referential[cust]' AS "check", avg((c_custkey IS NULL)::INT) <= 0 AS ok, avg((c_custkey IS NULL)::INT) AS seen, 0::DOUBLE AS allowed FROM {ORPHANED} LEFT JOIN customer ON cust = c_custkey
    UNION ALL SELECT 'unique[cust]', true, (SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)), 0
    UNION ALL SELECT 'referential[status]', true, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM orders)), 0
    UNION ALL SELECT 'unique[status]', false, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderstatus HAVING count(*) > 1)), 0""",
)
def quality_relationships(spark, sf_dir):
    """Tests on proven edges only: the third edge is none and is not tested."""
    o, c, bad = orders(spark, sf_dir), table(spark, sf_dir, "customer"), orphaned(spark, sf_dir)
    return quality.relationship_tests([(bad, "cust", c, "c_custkey", "cust", True), (o, "o_orderstatus", o, "o_orderstatus", "status", True), (o, "o_orderkey", c, "c_custkey", "guess", False)])


@register(
    "quality_parameters",
    """SELECT 'not_empty[orders]' AS "check", count(*) >= 1 AS ok, count(*)::DOUBLE AS seen, 1::DOUBLE AS allowed FROM orders UNION ALL SELECT 'not_empty[none]', count(*) >= 1, count(*)::DOUBLE, 1 FROM orders WHERE o_orderkey < 0
    UNION ALL SELECT 'row_count_delta[orders]', round(abs(count(*) - 0.9 * count(*)) / (0.9 * count(*)), 6) <= 0.2, round(abs(count(*) - (count(*) * 0.9)::INT) / (count(*) * 0.9)::INT, 6), 0.2 FROM orders
    UNION ALL SELECT 'plan[equi]', true, 0, 0 UNION ALL SELECT 'plan[cross]', false, 1, 0""",
)
def quality_parameters(spark, sf_dir):
    """Not empty; the number of rows against a stored one; and what a plan may not hold."""
    o, bad = orders(spark, sf_dir), ("CartesianProduct", "BroadcastNestedLoopJoin")
    stored = o.agg((F.count(F.lit(1)) * F.lit(0.9)).cast("int").alias("rows")).select(F.lit("orders").alias("name"), "rows")
    nation = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return quality.together([
        quality.not_empty(o, "orders"), quality.not_empty(o.filter("o_orderkey < 0"), "none"), quality.row_delta(o, stored, "orders", 0.2),
        quality.plan_has_no(nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey")), bad, "equi"), quality.plan_has_no(nation.join(regions, F.col("n_regionkey") > F.col("r_regionkey")), bad, "cross"),
    ])


@register("quality_duplicate_codes", "SELECT code, count(*) AS times FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 7 <> 0 THEN 'k' || o_custkey END AS code FROM orders) WHERE code IS NOT NULL AND trim(code) <> '' GROUP BY 1 HAVING count(*) > 1")
def quality_duplicate_codes(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("k"), "o_custkey"))
    return quality.repeated_keys(orders(spark, sf_dir).select(code.alias("code")), "code")


@register(
    "quality_suggested_tests",
    """SELECT unnest(['event_id', 'user_id', 'event_type']) AS column_name, 'not_null' AS test, NULL AS values UNION ALL SELECT 'event_type', 'accepted_values', string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events
    UNION ALL SELECT 'half', 'accepted_values', 'click' """,
)
def quality_suggested_tests(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_type") == "click", "click").alias("half"))
    return quality.suggested_tests(profiling.profile(events), events)


@register(
    "quality_tiers", "SELECT * FROM (VALUES ('orders', 'silver'), ('region', 'gold'), ('holes', 'bronze'), ('repeats', 'bronze'), ('loaded', 'bronze')) AS t(name, tier)",
)
def quality_tiers(spark, sf_dir):
    """By profiles of whole tables: clean ones, one with nulls in its key, one whose key repeats, one with columns of a load."""
    o, frames = orders(spark, sf_dir), {}
    frames["orders"] = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    frames["region"] = table(spark, sf_dir, "region")
    frames["holes"] = o.select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey")).alias("order_id"), "o_totalprice")
    frames["repeats"] = o.select((F.col("o_orderkey") % 9).alias("order_id"), "o_totalprice")
    frames["loaded"] = o.select("o_orderkey", F.lit("f").alias("_source_file"))
    out = []
    for name, f in frames.items():
        kinds = dict(f.dtypes)
        rows = [(r["column_name"], kinds[r["column_name"]], r["rows"], r["nulls"], r["distinct_values"]) for r in profiling.profile(f).collect()]  # a row for each column
        out.append((name, quality.tier(rows, business_ready=name == "region")))
    return spark.createDataFrame(out, "name string, tier string")


@register(
    "quality_topologies",
    "SELECT * FROM (VALUES ('events', 'flat'), ('wide', 'OBT'), ('staff', 'hierarchical'), ('sales', 'star'), ('tpch', 'snowflake'), ('two facts', 'galaxy'), ('chain', '3NF')) AS t(name, topology)",
)
def quality_topologies(spark, sf_dir):
    n = {t: len(table(spark, sf_dir, t).columns) for t in ("orders", "customer", "nation", "region", "lineitem", "part", "supplier", "events")}
    some = lambda *names: {t: n[t] for t in names}
    cases = {
        "events": (some("events"), []), "wide": ({"wide": 60}, []), "staff": ({"staff": 4, "log": 2}, [("staff", "staff")]), "sales": (some("lineitem", "part", "supplier"), [("lineitem", "part"), ("lineitem", "supplier")]),
        "tpch": (some("lineitem", "part", "orders", "customer", "nation"), [("lineitem", "part"), ("lineitem", "orders"), ("orders", "customer"), ("customer", "nation")]),
        "two facts": (some("lineitem", "events", "part", "supplier"), [("lineitem", "part"), ("lineitem", "supplier"), ("events", "part"), ("events", "supplier")]),
        "chain": (some("customer", "nation", "region"), [("customer", "nation"), ("nation", "region")]),
    }
    return spark.createDataFrame([(k, quality.topology(*v)) for k, v in cases.items()], "name string, topology string")


@register(
    "quality_arrivals",
    """SELECT event_type, CASE WHEN n < 3 OR span < 60 THEN 'one_shot' WHEN gap <= 300 THEN 'continuous' ELSE 'periodic' END AS arrival FROM (SELECT event_type, count(*) AS n, max(t) - min(t) AS span, median(g) AS gap
    FROM (SELECT event_type, t, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS g FROM (SELECT DISTINCT event_type, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'error' OR event_id < 20)) GROUP BY 1)""",
)
def quality_arrivals(spark, sf_dir):
    return quality.arrivals(table(spark, sf_dir, "events").filter("event_type <> 'error' OR event_id < 20"), "event_type", "ts")


@register(
    "quality_double_rows",
    """SELECT user_id, event_type, CASE WHEN day <> first_value(day) OVER w THEN 'cross_session' WHEN k <> first_value(k) OVER w THEN 'cross_agent' ELSE 'double_fire' END AS kind,
    CASE WHEN day <> first_value(day) OVER w OR k <> first_value(k) OVER w THEN 'warning' ELSE 'info' END AS level
    FROM (SELECT user_id, event_type, event_id, (event_id // 4000) AS day, event_id % 2 AS k FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id) QUALIFY row_number() OVER w > 1""",
)
def quality_double_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.floor(F.col("event_id") / 4000).alias("day"), (F.col("event_id") % 2).alias("k"))
    return quality.double_rows(events, ["user_id", "event_type"], "event_id", "day", "k")


# Attribution
def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("run-"), F.col("user_id") % 5).alias("run"), F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("at"), "event_type", "value", "event_id")


LEDGER = "(SELECT 'run-' || (user_id % 5) AS run, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS tm, event_type, value, event_id FROM events)"
WINDOWS = f"(SELECT run, min(tm) AS a, max(tm) AS z FROM {LEDGER} WHERE event_type = 'purchase' GROUP BY 1 HAVING max(tm) IS NOT NULL)"


@register("cost_usage_in_windows", f"SELECT run, round(sum(value), 2) AS value, count(*) AS turns FROM {LEDGER} JOIN {WINDOWS} USING (run) WHERE tm BETWEEN a AND z GROUP BY 1")
def cost_usage_in_windows(spark, sf_dir):
    """A run lasts from its first to its last purchase; rows whose time is no time can't be placed."""
    rows = ledger(spark, sf_dir)
    windows = attribution.run_windows(rows.filter("event_type = 'purchase'"), "run", "at", "at")
    return attribution.usage_in_windows(rows, windows, ["run"], "at", ["value"]).select("run", F.round("value", 2).alias("value"), "turns")


PRICES = "(SELECT * FROM (VALUES (0, 0.5, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10'), (0, 0.75, TIMESTAMP '2024-01-10', NULL), (1, 1.25, TIMESTAMP '2023-01-01', NULL)) AS p(sku, price, price_start, price_end))"


@register(
    "cost_shares",
    f"""WITH q AS (SELECT user_id % 4 AS warehouse, user_id % 7 AS run, ts AS start_time, ts + INTERVAL 1 MINUTE AS end_time, 1 + event_id % 90 AS duration FROM events WHERE event_type <> 'view' AND (user_id % 7 <> 3 OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15')),
    u AS (SELECT user_id % 4 AS warehouse, event_id % 2 AS sku, value AS quantity, ts AS usage_start, ts + INTERVAL 1 HOUR AS usage_end FROM events WHERE event_type = 'view'),
    m AS (SELECT warehouse, count(*) AS query_count, sum(duration) AS run_duration, min(start_time) AS a, max(end_time) AS z FROM q WHERE run = 3 GROUP BY 1),
    w AS (SELECT warehouse, sum(duration) AS warehouse_duration FROM q JOIN m USING (warehouse) WHERE start_time >= a AND end_time <= z GROUP BY 1),
    c AS (SELECT warehouse, sum(quantity) AS units, sum(quantity * price) AS cost FROM u JOIN m USING (warehouse) JOIN {PRICES} USING (sku) WHERE usage_end > a AND usage_start < z AND usage_start >= price_start AND (price_end IS NULL OR usage_start < price_end) GROUP BY 1)
    SELECT warehouse, query_count, run_duration, warehouse_duration, round(units, 4) AS units, round(cost, 4) AS cost, round(cost * run_duration / nullif(warehouse_duration, 0), 4) AS run_cost FROM m LEFT JOIN w USING (warehouse) LEFT JOIN c USING (warehouse)""",
)
def cost_shares(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    queries = events.filter("event_type <> 'view' AND (user_id % 7 <> 3 OR ts BETWEEN '2024-01-05' AND '2024-01-15')").select(
        (F.col("user_id") % 4).alias("warehouse"), (F.col("user_id") % 7).alias("run"), F.col("ts").alias("start_time"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("end_time"), (1 + F.col("event_id") % 90).alias("duration"),
    )
    usage = events.filter("event_type = 'view'").select(
        (F.col("user_id") % 4).alias("warehouse"), (F.col("event_id") % 2).alias("sku"), F.lit("h").alias("unit"), F.col("value").alias("quantity"), F.col("ts").alias("usage_start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("usage_end"),
    )
    prices = spark.createDataFrame([(0, "h", 0.5, "2024-01-01", "2024-01-10"), (0, "h", 0.75, "2024-01-10", None), (1, "h", 1.25, "2023-01-01", None)], "sku long, unit string, price double, price_start string, price_end string")
    prices = prices.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("price_start", "price_end")})
    return attribution.shares_of_cost(queries, usage, prices, 3)


@register(
    "pattern_stats",
    """SELECT event_type, count(*) AS attempts, count(*) FILTER (user_id % 3 = 0) AS keeps, round(avg(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END), 4) AS avg_delta, round(count(*) FILTER (user_id % 3 = 0) / count(*), 4) AS success_rate
    FROM events GROUP BY 1 ORDER BY keeps DESC, attempts DESC, 1 LIMIT 3""",
)
def pattern_stats(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 3 == 0, "keep").otherwise("drop").alias("decision"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("delta"))
    return attribution.pattern_stats(attempts, "event_type", "decision", "delta", 3)


RECORDS = """(SELECT event_type AS stage, user_id % 2 AS mode, value AS elapsed, CASE WHEN event_id % 3 > 0 THEN 'b' || (event_id * 7 % 9) END AS bottleneck FROM events WHERE user_id % 4 <> 1 AND event_id % 6 <> 5)"""


@register(
    "lessons",
    f"""SELECT stage, mode, successes, avg_elapsed, score, coalesce(b, '') AS bottlenecks FROM (SELECT stage, mode, count(*) AS successes, round(avg(elapsed), 6) AS avg_elapsed, round(count(*) / greatest(avg(elapsed), 0.001), 6) AS score FROM {RECORDS} GROUP BY 1, 2)
    LEFT JOIN (SELECT stage, mode, string_agg(bottleneck, ',' ORDER BY n DESC, bottleneck) AS b FROM (SELECT stage, mode, bottleneck, count(*) AS n, row_number() OVER (PARTITION BY stage, mode ORDER BY count(*) DESC, bottleneck) AS k
    FROM {RECORDS} WHERE bottleneck IS NOT NULL GROUP BY 1, 2, 3) WHERE k <= 5 GROUP BY 1, 2) USING (stage, mode)""",
)
def lessons(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), (F.col("user_id") % 2).alias("mode"), F.col("value").alias("elapsed"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("b"), F.col("event_id") * 7 % 9)).alias("bottleneck"),
        F.when(F.col("user_id") % 4 != 1, "success").otherwise("failed").alias("status"), F.when(F.col("event_id") % 6 != 5, "ok").otherwise("open").alias("validation"),
    )
    return attribution.lessons(records, ["stage", "mode"], "elapsed", "bottleneck")


@register("quality_types", "SELECT 'type[o_totalprice]' AS \"check\", true AS ok, 0::DOUBLE AS seen, 0::DOUBLE AS allowed UNION ALL SELECT 'type[o_orderstatus]', false, 1, 0")
def quality_types(spark, sf_dir):
    o = orders(spark, sf_dir)
    return quality.together([quality.typed(o, "o_totalprice", T.NumericType), quality.typed(o, "o_orderstatus", T.NumericType)])
