"""Profiles, samples, drift, importance, cross-filters, verification, sources and streams."""

from pyspark.sql import functions as F

from lumenmart.operators import kpi, layers, profiling, verify
from lumenmart.queries.kpi import STAR, mart, star
from lumenmart.registry import register, table
from lumenmart.sources import files
from lumenmart.streaming import streams


def _profile_sql(name, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM {name}" for c in columns
    )


@register("profile_columns", _profile_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
def profile_columns(spark, sf_dir):
    return profiling.profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@register(
    "profile_rates",
    f"""SELECT column_name, round(1 - nulls / rows, 6) AS fill_rate, round(distinct_values / (rows - nulls), 6) AS unique_ratio, distinct_values <= 50 AS categorical,
    CASE WHEN nulls / rows > 0.5 THEN 'excluded' WHEN nulls / rows > 0.05 THEN 'warn' ELSE 'ok' END AS audit
    FROM ({_profile_sql("(SELECT event_id, nullif(event_type, 'view') AS event_type, CASE WHEN event_id % 4 = 0 THEN user_id END AS user_id FROM events)", ["event_id", "event_type", "user_id"])})""",
)
def profile_rates(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("event_type"), F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("user_id"))
    return profiling.rates(profiling.profile(events))


@register("profile_downcast", "SELECT 'l_linenumber' AS column_name, 'tinyint' AS kind UNION ALL SELECT 'l_suppkey', CASE WHEN max(l_suppkey) <= 127 THEN 'tinyint' WHEN max(l_suppkey) <= 32767 THEN 'smallint' ELSE 'int' END FROM lineitem")
def profile_downcast(spark, sf_dir):
    return profiling.downcast(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_suppkey"])


@register(
    "profile_quantiles",
    "SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, "
    + ", ".join(f"round(quantile_cont(l_quantity, {q / 100}), 4) AS p{q:02d}" for q in (1, 25, 50, 75, 99)) + " FROM lineitem GROUP BY 1",
)
def profile_quantiles(spark, sf_dir):
    return profiling.quantiles(table(spark, sf_dir, "lineitem"), ["l_quantity"], (0.01, 0.25, 0.5, 0.75, 0.99), ("l_returnflag",)).drop("column_name")


@register("profile_footers", "SELECT 'o_orderkey' AS column_name, count(*) AS rows, count(o_orderkey) AS filled, min(o_orderkey)::DOUBLE AS least, max(o_orderkey)::DOUBLE AS greatest FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(o_totalprice), min(o_totalprice), max(o_totalprice) FROM orders")
def profile_footers(spark, sf_dir):
    return profiling.footer_profile(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@register("profile_catalog_table", "SELECT 'n_nationkey' AS column_name, 0 AS nulls, count(DISTINCT n_nationkey) AS distinct_values FROM nation UNION ALL SELECT 'region', count(*) FILTER (n_regionkey = 1), 4 FROM nation")
def profile_catalog_table(spark, sf_dir):
    import uuid

    name = f"nation_{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 1)").alias("region")).write.saveAsTable(name)
    out = profiling.table_profile(spark, name)
    spark.sql(f"DROP TABLE {name}")
    return out


@register("profile_approximate", "SELECT 'o_custkey' AS column_name, true AS near UNION ALL SELECT 'o_orderkey', true")
def profile_approximate(spark, sf_dir):
    """Approximate numbers of different values lie within a tenth of the exact ones."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    exact = profiling.profile(orders).select("column_name", F.col("distinct_values").alias("exact"))
    return profiling.profile(orders, exact=False).join(exact, "column_name").select("column_name", (F.abs(F.col("distinct_values") / F.col("exact") - 1) < 0.1).alias("near"))


@register("profile_freshness_lag", "SELECT event_type, date_diff('hour', max(ts), TIMESTAMP '2024-02-01') - CASE WHEN date_part('minute', max(ts)) * 60 + date_part('second', max(ts)) > 0 THEN 1 ELSE 0 END AS hours, max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 36 HOUR AS late FROM events GROUP BY 1")
def profile_freshness_lag(spark, sf_dir):
    """Whole hours since the last event of each kind, by a clock that is given, and whether that is over a day and a half."""
    from lumenmart.functions.columns import lag_hours

    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    latest = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("latest"))
    return latest.select("event_type", lag_hours(F.col("latest"), now).alias("hours"), (F.col("latest") < now - F.expr("INTERVAL 36 HOUR")).alias("late"))


HASH = "('0x' || substr(md5({k}::VARCHAR || '|42'), 1, 8))::BIGINT"


@register("sample_by_hash", f"SELECT o_orderkey FROM orders WHERE {HASH.format(k='o_orderkey')} % 1000 < 100")
def sample_by_hash(spark, sf_dir):
    return profiling.hashed_sample(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@register(
    "sample_stratified",
    """SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey)
    <= greatest(round(count(*) OVER (PARTITION BY o_orderpriority) * 0.05), 3)""",
)
def sample_stratified(spark, sf_dir):
    return profiling.stratified(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 0.05, 3).select("o_orderkey", "o_orderpriority")


@register(
    "sample_distance",
    f"""WITH a AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1),
    b AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE {HASH.format(k="o_orderkey")} % 1000 < 100 GROUP BY 1)
    SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS distance FROM a FULL JOIN b USING (v)""",
)
def sample_distance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return profiling.total_variation(orders, profiling.hashed_sample(orders, "o_orderkey", 100), "o_orderpriority")


@register(
    "drift_schema",
    """WITH a AS (SELECT column_name AS n, lower(data_type) AS t FROM duckdb_columns() WHERE table_name = 'supplier'), b AS (SELECT replace(column_name, 'acctbal', 'balance') AS n, CASE WHEN column_name = 's_nationkey' THEN 'varchar' ELSE lower(data_type) END AS t FROM duckdb_columns() WHERE table_name = 'supplier')
    SELECT coalesce(a.n, b.n) AS column_name, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE replace(a.t, 'integer', 'int') || ' -> ' || replace(b.t, 'varchar', 'string') END AS change FROM a FULL JOIN b USING (n) WHERE a.t IS DISTINCT FROM b.t""",
)
def drift_schema(spark, sf_dir):
    """The suppliers' schema before and after a column was renamed and another one became text."""
    before = table(spark, sf_dir, "supplier")
    after = before.withColumnRenamed("s_acctbal", "s_balance").withColumn("s_nationkey", F.col("s_nationkey").cast("string"))
    return spark.createDataFrame(profiling.schema_drift(before.schema, after.schema), "column_name string, change string")


@register(
    "drift_volume",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, abs(b.n - a.n) > 0.5 * a.n AS volume_drift, (b.n - b.filled) / b.n > 2 * (a.n - a.filled) / a.n AND (b.n - b.filled) / b.n > 0.05 AS null_drift
        FROM (SELECT count(*) AS n, count({c}) AS filled FROM events) a, (SELECT count(*) AS n, count({x}) AS filled FROM events WHERE event_id % 3 = 0) b""" for c, x in (("event_id", "event_id"), ("event_type", "CASE WHEN event_id % 2 = 0 THEN event_type END"))
    ),
)
def drift_volume(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    after = events.filter("event_id % 3 = 0").withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    return profiling.volume_drift(profiling.profile(events), profiling.profile(after))


@register(
    "anomaly_mad",
    """WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d),
    m AS (SELECT event_type, median(v) AS mid, count(*) AS n FROM r WHERE k > 1 GROUP BY 1), a AS (SELECT r.event_type, median(abs(v - mid)) AS mad FROM r JOIN m USING (event_type) WHERE k > 1 GROUP BY 1)
    SELECT r.event_type, round(v, 2) AS last, round(mid, 2) AS median, round(mad, 2) AS mad, n >= 4 AND CASE WHEN mad = 0 THEN abs(v - mid) > 0 ELSE abs(v - mid) > 3 * mad END AS flagged
    FROM r JOIN m USING (event_type) JOIN a USING (event_type) WHERE k = 1""",
)
def anomaly_mad(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    return profiling.anomalies(daily, "event_type", "day", "v")


@register(
    "importance_eta_squared",
    f"""WITH g AS (SELECT n_name, count(o_totalprice) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS ss FROM {STAR} GROUP BY 1),
    t AS (SELECT sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM g) SELECT round((b - s * s / n) / (ss - s * s / n), 4) AS eta_squared FROM t""",
)
def importance_eta_squared(spark, sf_dir):
    return profiling.eta_squared(star(spark, sf_dir), "n_name", "o_totalprice")


@register(
    "importance_concentration",
    f"""WITH t AS (SELECT n_name, sum(o_totalprice) AS t FROM {STAR} GROUP BY 1), p AS (SELECT t / sum(t) OVER () AS p FROM t)
    SELECT round(1 + sum(p * ln(p)) / ln(count(*)), 4) AS concentration, round(max(p), 4) AS top_share FROM p""",
)
def importance_concentration(spark, sf_dir):
    return profiling.concentration(star(spark, sf_dir), "n_name", "o_totalprice")


@register(
    "semantic_cross_filter",
    f"""SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM {STAR} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F' GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 12""",
)
def semantic_cross_filter(spark, sf_dir):
    chosen = kpi.slicer(star(spark, sf_dir), {"c_mktsegment": ["BUILDING", "MACHINERY"], "o_orderstatus": "F"})
    best = chosen.groupBy("n_name").agg(F.sum("o_totalprice").alias("t")).orderBy(F.desc_nulls_last("t"), "n_name").limit(12)
    return best.select("n_name", F.round("t", 2).alias("revenue"))


@register(
    "semantic_grid_page",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderpriority ILIKE '%h%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20",
)
def semantic_grid_page(spark, sf_dir):
    found = table(spark, sf_dir, "orders").filter((F.col("o_totalprice") > 1000) & F.col("o_orderpriority").ilike("%h%"))
    return found.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("semantic_cube", "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)")
def semantic_cube(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.cube("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register(
    "semantic_trailing_period",
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS k FROM m),
    e AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS c FROM r WHERE k > 1)
    SELECT month, n, n < 0.5 * (SELECT n FROM e WHERE i = c // 2 + 1) AS incomplete FROM r WHERE k = 1""",
)
def semantic_trailing_period(spark, sf_dir):
    """Whether the last month has less than half of the earlier months' (upper) median of rows: a row a month is left to compare."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    all_months = months.agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("m"))
    earlier = F.array_sort(F.transform(F.slice("m", 1, F.size("m") - 1), lambda x: x["n"]))
    last, mid = F.element_at("m", -1), F.get(earlier, F.floor(F.size(earlier) / 2).cast("int"))
    return all_months.select(last["month"].alias("month"), last["n"].alias("n"), (last["n"] < 0.5 * mid).alias("incomplete"))


@register("verify_equal_results", "SELECT 0::BIGINT AS differing")
def verify_equal_results(spark, sf_dir):
    """The monthly mart, and the same added up from daily rows."""
    daily = star(spark, sf_dir).groupBy(F.col("o_orderdate").cast("date").alias("day"), "c_mktsegment", "o_orderstatus").agg(F.sum("o_totalprice").alias("r"))
    again = daily.groupBy(F.date_trunc("month", "day").cast("date").alias("month"), "c_mktsegment", "o_orderstatus").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return verify.differing_rows(mart(spark, sf_dir), again).agg(F.count(F.lit(1)).alias("differing"))


@register(
    "verify_signature",
    """SELECT count(*) AS rows, 0::BIGINT AS o_orderkey_nulls, round(sum(o_orderkey::DOUBLE), 2) AS o_orderkey_sum, min(o_orderkey) AS o_orderkey_least, max(o_orderkey) AS o_orderkey_greatest,
    0::BIGINT AS o_orderstatus_nulls, count(DISTINCT o_orderstatus) AS o_orderstatus_distinct, sum(('0x' || substr(md5(o_orderstatus), 1, 8))::BIGINT) AS o_orderstatus_checksum FROM orders""",
)
def verify_signature(spark, sf_dir):
    return verify.signature(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@register(
    "verify_lineage",
    """WITH n AS (SELECT s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier))
    SELECT 's' || (SELECT min(s_suppkey) FROM supplier) AS name, 0 AS distance UNION ALL SELECT 'n' || n, 1 FROM n UNION ALL SELECT 'r' || r, 2 FROM n""",
)
def verify_lineage(spark, sf_dir):
    """All that a supplier comes from, over the edges of all suppliers and nations."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    edges = supplier.select(name("n", "s_nationkey").alias("source"), name("s", "s_suppkey").alias("target")).unionByName(nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target")))
    return verify.lineage(edges, f"s{supplier.agg(F.min('s_suppkey')).first()[0]}")


def _fresh(spark, what):
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lumenmart-{what}-{uuid.uuid4().hex}"


@register("source_csv_json_union", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS s_nationkey FROM supplier")
def source_csv_json_union(spark, sf_dir):
    """Half of the suppliers through CSV, half through JSON without the nation, read back by name."""
    base, supplier = _fresh(spark, "source"), table(spark, sf_dir, "supplier")
    supplier.filter("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(f"{base}/a.csv")
    supplier.filter("s_suppkey % 2 = 1").select("s_suppkey", "s_name").write.json(f"{base}/b.json")
    a = files.read(spark, f"{base}/a.csv", schema="s_suppkey bigint, s_name string, s_nationkey int").drop("_rescued")
    return a.unionByName(files.read(spark, f"{base}/b.json", schema="s_suppkey bigint, s_name string").drop("_rescued"), allowMissingColumns=True)


@register("source_bronze_new_files", "SELECT s_suppkey, 'erp' AS _source_system FROM supplier WHERE s_suppkey % 2 = 1")
def source_bronze_new_files(spark, sf_dir):
    base, supplier = _fresh(spark, "bronze"), table(spark, sf_dir, "supplier").select("s_suppkey")
    supplier.filter("s_suppkey % 2 = 0").write.parquet(base)
    ledger = spark.read.parquet(base).select(F.col("_metadata.file_name").alias("file")).distinct().collect()
    supplier.filter("s_suppkey % 2 = 1").write.mode("append").parquet(base)
    loaded = layers.with_provenance(spark.read.parquet(base), "erp", "2024-01-01 00:00:00")
    return files.not_loaded(loaded, spark.createDataFrame(ledger, "file string")).select("s_suppkey", "_source_system")


@register("stream_files_append", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_files_append(spark, sf_dir):
    """The events as files, through a stream that stops when all is read; the batch answer is the oracle."""
    base, events = _fresh(spark, "stream"), table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    streams.append_once(streams.files(spark, f"{base}/in", events.schema, per_batch=2), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(events.schema).parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("stream_upsert_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert_latest(spark, sf_dir):
    """Later events come in the first files and earlier ones after them, so late rows must not win; the table has one row a user as it is."""
    base, events = _fresh(spark, "upsert"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for k in (2, 0, 1):
        events.filter(F.pmod(F.floor(F.col("event_id") / 100), F.lit(3)) == k).write.mode("append").parquet(f"{base}/in")
    streams.upsert_batches(streams.files(spark, f"{base}/in", events.schema, per_batch=2), f"{base}/state", ["user_id"], "event_id", f"{base}/checkpoint")
    return streams.upserted(spark, f"{base}/state")


@register("stream_event_time_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_time_windows(spark, sf_dir):
    return streams.windows(table(spark, sf_dir, "events"), "ts", "6 hours", "1 day", "event_type")
