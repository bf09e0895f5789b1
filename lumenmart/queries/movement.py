"""Marts that grow, members that come late, backfills, publishing, loads by ledger, layers with other columns, and streams."""

import json
import uuid

from pyspark.sql import functions as F

from lumenmart.operators import layers
from lumenmart.queries.analysis import _fresh
from lumenmart.registry import register, table
from lumenmart.sources import files, web
from lumenmart.sources.versions import Versions
from lumenmart.streaming import streams

DAILY = "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {} GROUP BY 1, 2"


def daily(events):
    return events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("merge_incremental_mart", DAILY.format("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-18' OR ts >= TIMESTAMP '2024-01-17' OR event_id % 2 = 0)"))
def merge_incremental_mart(spark, sf_dir):
    """A mart of the first days, in which late rows of its last three days lack, brought up to date by them and the days after."""
    events = table(spark, sf_dir, "events")
    early = daily(events.filter("ts < '2024-01-15' OR (ts < '2024-01-18' AND event_id % 2 = 0)"))
    return layers.refresh(early, events, "ts", daily, ["day", "event_type"], "2024-01-18", 3)


@register("merge_resolved_members", "SELECT c_custkey, c_mktsegment, c_custkey % 5 = 0 AND c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 2 = 1 AS is_inferred FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 > 0 OR c_custkey % 2 = 0 OR c_custkey IN (SELECT o_custkey FROM orders))")
def merge_resolved_members(spark, sf_dir):
    """Every fifth customer is not known when its orders come; half of them arrive later."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    inferred = layers.inferred_members(customer.filter("c_custkey % 5 > 0"), table(spark, sf_dir, "orders"), "o_custkey", "c_custkey")
    return layers.resolve_members(inferred, customer.filter("c_custkey % 5 = 0 AND c_custkey % 2 = 0"), "c_custkey")


@register("merge_backfill", "SELECT event_id, CASE WHEN ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' THEN value * 2 ELSE value END AS value FROM events")
def merge_backfill(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return layers.backfill(events, events.withColumn("value", F.col("value") * 2), "ts", "2024-01-05", "2024-01-07").select("event_id", "value")


@register("merge_append_once", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def merge_append_once(spark, sf_dir):
    base, nation = _fresh(spark, "once"), table(spark, sf_dir, "nation")
    for _ in range(2):
        layers.append_once(nation, f"{base}/t", "nations")
    return layers.published(spark, f"{base}/t").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@register("merge_pull_above_mark", "SELECT o_orderkey, o_totalprice FROM orders")
def merge_pull_above_mark(spark, sf_dir):
    """Pulls twice: first to a date, then what lies above the mark; the second pull brings nothing twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    since = lambda mark: orders.filter("o_orderdate < '1999-01-01'") if mark is None else orders.filter(F.col("o_orderdate") > F.lit(mark))
    once = layers.pull(None, since, ["o_orderkey"], "o_orderdate")
    return layers.pull(layers.pull(once, since, ["o_orderkey"], "o_orderdate"), since, ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_totalprice")


@register("merge_documents", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'changed' ELSE n_name END AS n_name FROM nation")
def merge_documents(spark, sf_dir):
    path, nation = f"{_fresh(spark, 'documents')}/t", table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    layers.put(spark, path, nation, ["n_nationkey"])
    layers.put(spark, path, nation.filter("n_nationkey % 4 = 0").withColumn("n_name", F.lit("changed")), ["n_nationkey"])
    return layers.published(spark, path)


@register("sink_publish", "SELECT 'good' AS version, 0 AS failing, count(*) AS rows FROM nation UNION ALL SELECT 'bad', count(*) FILTER (n_regionkey > 3), (SELECT count(*) FROM nation) FROM nation")
def sink_publish(spark, sf_dir):
    """A table that passes is published; one that fails its checks leaves the published one as it is."""
    path, nation, out = f"{_fresh(spark, 'publish')}/t", table(spark, sf_dir, "nation"), []
    for version, df, high in (("good", nation, 4), ("bad", nation.limit(1000), 3)):
        failing = layers.publish(df, path, [lambda t, h=high: layers.outside(t, "n_regionkey", 0, h), lambda t: layers.nulls(t, "n_name")])
        out.append((version, failing, layers.published(spark, path).count()))
    return spark.createDataFrame(out, "version string, failing long, rows long")


@register("sink_compact", "SELECT 8 AS before, 1 AS after, count(*) AS rows, sum(s_suppkey) AS keys FROM supplier")
def sink_compact(spark, sf_dir):
    """Two loads of small files become one load of one file."""
    held, supplier = Versions(spark, f"{_fresh(spark, 'compact')}/t"), table(spark, sf_dir, "supplier")
    for rest in (0, 1):
        held.append({"data": supplier.filter(f"s_suppkey % 2 = {rest}").repartition(4)})
    count = lambda: sum(e["files"] for e in held.state()["parts"]["data"])
    before = count()
    held.compact()
    return held.read().agg(F.lit(before).alias("before"), F.lit(count()).alias("after"), F.count(F.lit(1)).alias("rows"), F.sum("s_suppkey").alias("keys"))


@register("sink_bronze_evolves", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS s_acctbal, 'erp' AS _source_system FROM supplier")
def sink_bronze_evolves(spark, sf_dir):
    """The second load has a column that the first lacked."""
    path, supplier = f"{_fresh(spark, 'bronze')}/t", table(spark, sf_dir, "supplier")
    for columns, rest in ((["s_suppkey"], 0), (["s_suppkey", "s_acctbal"], 1)):
        layers.append_bronze(layers.with_provenance(supplier, "erp", "2024-01-01 00:00:00").filter(f"s_suppkey % 2 = {rest}").select(*columns, "_source_system", "_source_file", "_load_ts"), path)
    return layers.read_bronze(spark, path).select("s_suppkey", "s_acctbal", "_source_system")


@register("sink_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def sink_by_month(spark, sf_dir):
    """Above the floor a table is written by month; the month is a column of the path."""
    path = f"{_fresh(spark, 'months')}/t"
    files.write_table(table(spark, sf_dir, "orders"), path, "o_orderdate", bytes_there=2, floor=1)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def _place(spark, df, path):
    """df as one JSON file of the given path."""
    df.coalesce(1).write.json(f"{path}-parts")
    fs, at = layers._fs(spark, f"{path}-parts")
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    to = layers._fs(spark, path)[1]
    fs.mkdirs(to.getParent())
    fs.rename(part, to)
    fs.delete(at, True)


@register(
    "source_ledger",
    """SELECT k AS run, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS files, count(*) FILTER (s_suppkey % 3 < CASE k WHEN 0 THEN 2 ELSE 3 END) AS rows,
    sum(s_suppkey) FILTER (s_suppkey % 3 < CASE k WHEN 0 THEN 2 ELSE 3 END) AS keys FROM supplier, range(4) AS r(k) GROUP BY k""",
)
def source_ledger(spark, sf_dir):
    """Files of one name in nested folders, then one more, then none, then the same folder under a new checkpoint: each is loaded once."""
    base, supplier, out = _fresh(spark, "ledger"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), None
    for k, (checkpoint, rests) in enumerate((("c", (0, 1)), ("c", (2,)), ("c", ()), ("d", ()))):
        for r in rests:
            _place(spark, supplier.filter(f"s_suppkey % 3 = {r}"), f"{base}/in{'/deep/er' * r}/a.json")
        held = Versions(spark, f"{base}/t")
        loaded = files.load_new(spark, f"{base}/in", held, f"{base}/{checkpoint}", "json", "s_suppkey bigint, s_name string")
        one = held.read().agg(F.lit(k).alias("run"), F.lit(loaded).alias("files"), F.count(F.lit(1)).alias("rows"), F.sum("s_suppkey").alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "sink_versions",
    """SELECT 'appended' AS version, count(*) AS rows, round(sum(s_acctbal), 2) AS balance FROM supplier UNION ALL SELECT 'first', count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_nationkey < 10
    UNION ALL SELECT 'replaced', count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_acctbal > 0""",
)
def sink_versions(spark, sf_dir):
    """A table is written, appended to, packed and replaced; every kept version can still be read."""
    supplier = table(spark, sf_dir, "supplier")
    held = Versions(spark, f"{_fresh(spark, 'versions')}/t")
    first = held.append({"data": supplier.filter("s_nationkey < 10")})
    held.append({"data": supplier.filter("s_nationkey >= 10").repartition(4)})
    held.compact()
    packed = held.state()["version"]
    held.replace({"data": supplier.filter("s_acctbal > 0")}, packed, checks=[lambda df: df.filter("s_acctbal <= 0")])
    out = None
    for name, version in (("first", first), ("appended", packed), ("replaced", None)):
        one = held.read(version=version).agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
        out = one if out is None else out.unionByName(one)
    return out


@register("source_rescued_rows", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_name END AS r_name, r_regionkey % 2 = 0 AS rescued FROM region")
def source_rescued_rows(spark, sf_dir):
    """Lines that are no JSON are kept as they are."""
    base = _fresh(spark, "rescued")
    line = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("not json "), "r_regionkey")).otherwise(F.to_json(F.struct("r_regionkey", "r_name")))
    table(spark, sf_dir, "region").select(line.alias("value")).write.text(f"{base}/a")
    got = files.read(spark, f"{base}/a", "json", "r_regionkey int, r_name string")
    key = F.coalesce("r_regionkey", F.regexp_extract("_rescued", r"(\d+)", 1).cast("int"))
    return got.select(key.alias("r_regionkey"), "r_name", F.col("_rescued").isNotNull().alias("rescued"))


@register("source_detected", "SELECT 'csv' AS kind, count(*) AS rows, 2 AS columns FROM region UNION ALL SELECT 'orc', count(*), 2 FROM region UNION ALL SELECT 'json', count(*), 2 FROM region UNION ALL SELECT 'parquet', count(*), 2 FROM region")
def source_detected(spark, sf_dir):
    """Folders without a suffix: the format is that of most of their files; each is staged and profiled."""
    region, out = table(spark, sf_dir, "region"), []
    for kind in ("csv", "orc", "json", "parquet"):
        base = _fresh(spark, f"detect{kind[0]}")
        writer = region.coalesce(1).write.option("header", True)
        writer.format(kind).save(f"{base}-in")
        profiled = files.process(spark, f"{base}-in", f"{base}-out").collect()  # a row for each column
        out.append((files.detect(spark, f"{base}-in"), profiled[0]["rows"], len(profiled)))
    return spark.createDataFrame(out, "kind string, rows long, columns int")


@register("source_modes", "SELECT 'bronze' AS mode, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_modes(spark, sf_dir):
    """Both tables have both modes, so both come from the preferred one: one from the catalog, one from files; only the columns needed are read."""
    name = f"nation_{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").createOrReplaceTempView(name)
    mode = files.run_mode({"nation": {"raw", "bronze"}, "region": {"raw", "bronze"}})
    got = files.staged(spark, {"nation": {"bronze": name}, "region": {"bronze": f"{sf_dir}/region.parquet"}}, mode, {"nation": ["n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"]})
    try:
        files.run_mode({"nation": {"raw"}, "region": {"bronze"}})
    except ValueError:
        return got["nation"].join(got["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(mode).alias("mode"), "n_name", "r_name")
    raise AssertionError("modes were mixed")


def _answers(spark, sf_dir):
    """Recorded answers of a source of customers, a page for each hundred of their keys."""
    body = F.to_json(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))))
    return table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(body.alias("answer"))


def _ask(one):
    if one["page"] % 4 == 3:
        raise OSError("no answer")
    return json.loads(one["answer"])


@register(
    "source_pages",
    """SELECT 'row' AS kind, c_custkey AS k, c_name AS v FROM customer WHERE c_custkey // 100 % 4 <> 3 AND c_custkey // 100 > 1
    UNION ALL SELECT DISTINCT 'failed', c_custkey // 100, 'OSError: no answer' FROM customer WHERE c_custkey // 100 % 4 = 3""",
)
def source_pages(spark, sf_dir):
    """Two pages were fetched before, and every fourth fails: the rest comes, the failures are put aside."""
    rows, failed = files.fetched(_answers(spark, sf_dir), _ask, "k long, v string", spark.createDataFrame([(0,), (1,)], "page long"))
    return rows.select(F.lit("row").alias("kind"), "k", "v").unionByName(failed.select(F.lit("failed").alias("kind"), F.col("page").alias("k"), F.col("error").alias("v")))


@register(
    "source_pages_resumed",
    """WITH p AS (SELECT DISTINCT c_custkey // 100 AS page FROM customer) SELECT (SELECT count(*) FROM p WHERE page < 6 AND page % 4 <> 3) AS first, (SELECT count(*) FROM p WHERE page >= 6 AND page % 4 <> 3) AS second,
    (SELECT count(*) FROM p WHERE page % 4 = 3) AS third, count(*) AS rows, count(DISTINCT c_custkey) AS keys FROM customer""",
)
def source_pages_resumed(spark, sf_dir):
    """A run that ends half way, one that goes on, and one that asks again for what had failed: each page is there once."""
    held, answers, came = Versions(spark, f"{_fresh(spark, 'pages')}/t"), _answers(spark, sf_dir), []
    for asked, ask in ((answers.filter("page < 6"), _ask), (answers, _ask), (answers, lambda one: json.loads(one["answer"]))):
        came.append(files.load_pages(asked, ask, held, "k long, v string")[0])
    counts = [F.lit(n).cast("long").alias(name) for name, n in zip(("first", "second", "third"), came, strict=True)]
    return files.page_rows(held).agg(*counts, F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("keys"))


@register("source_pages_stream", "SELECT c_custkey AS k, c_name AS v, c_custkey // 100 AS page FROM customer")
def source_pages_stream(spark, sf_dir):
    """A data source whose pages are recorded answers: a stream of its first pages, and, when more are there, of the rest."""
    at, customers = _fresh(spark, "answers"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.floor(F.col("c_custkey") / 100).alias("page"))
    customers.repartition("page").write.partitionBy("page").parquet(at)
    held, pages = Versions(spark, f"{_fresh(spark, 'pages')}/t"), customers.agg(F.max("page") + 1).first()[0]

    def fetch(asked):
        from pyarrow import fs, parquet

        system, root = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at.removeprefix("file:"))
        files_of = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/page={asked['page']}", allow_not_found=True)) if f.path.endswith(".parquet")]
        return [r for f in files_of for r in parquet.read_table(system.open_input_file(f)).to_pylist()]

    for number in (min(6, pages), pages):
        name = web.register_pages(spark, "recorded_customers", fetch, lambda number=number: number, "k long, v string")
        web.load_stream(spark, name, held, f"{held.path}_checkpoint")
    return files.page_rows(held).select("k", "v", F.col("_page").alias("page"))


@register("source_warehouse", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 500 GROUP BY 1")
def source_warehouse(spark, sf_dir):
    at = files.Warehouse(spark, {"customer": table(spark, sf_dir, "customer")}, {n: table(spark, sf_dir, n) for n in ("nation", "region")})
    for bad in ("DROP VIEW fact_customer", "SELECT 1; DROP VIEW x"):
        try:
            at.query(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    return at.query("SELECT r_name, count(*) AS customers FROM fact_customer JOIN dim_nation ON c_nationkey = n_nationkey JOIN dim_region ON n_regionkey = r_regionkey WHERE c_acctbal > :least GROUP BY 1", least=500)


@register("source_rows_by_parameter", "SELECT n_nationkey, n_name FROM nation")
def source_rows_by_parameter(spark, sf_dir):
    path = f"{_fresh(spark, 'rows')}/t"
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]  # a lookup of fixed size
    files.write_rows(spark, rows, "n_nationkey int, n_name string", path)
    return spark.read.parquet(path)


@register("source_storage", "SELECT 'nation' AS layer, 1 AS files, count(*) AS rows FROM nation UNION ALL SELECT 'orders', 3, count(*) FROM orders")
def source_storage(spark, sf_dir):
    base = _fresh(spark, "storage")
    table(spark, sf_dir, "nation").coalesce(1).write.parquet(f"{base}/nation")
    table(spark, sf_dir, "orders").repartition(3).write.parquet(f"{base}/orders")
    return files.storage(spark, {"nation": f"{base}/nation", "orders": f"{base}/orders"}).filter("bytes > 0").select("layer", "files", "rows")


@register("source_freshness", "SELECT count(*) AS rows, 1 AS files, false AS stale FROM orders UNION ALL SELECT count(*), 1, true FROM orders")
def source_freshness(spark, sf_dir):
    """A layer just written, looked at now and in ten years."""
    base = _fresh(spark, "fresh")
    table(spark, sf_dir, "orders").coalesce(1).write.parquet(base)
    now = spark.sql("SELECT cast(now() AS string)").first()[0]
    seen = files.as_of(spark, base, 24, now).unionByName(files.as_of(spark, base, 24, "2036-01-01 00:00:00")).select("files", "stale")
    return seen.join(F.broadcast(spark.read.parquet(base).agg(F.count(F.lit(1)).alias("rows"))))


@register("union_tagged", "SELECT s_name AS name, s_acctbal AS balance, NULL AS segment, 'erp' AS source_system FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment, 'crm' FROM customer")
def union_tagged(spark, sf_dir):
    erp = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    crm = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return files.tagged_union({"erp": erp, "crm": crm})


@register("union_by_position", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_by_position(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).union(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@register("union_diagonal_unique", "SELECT k, max(a) AS a, max(b) AS b FROM (SELECT n_nationkey AS k, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey + 100, NULL, r_name FROM region) GROUP BY 1")
def union_diagonal_unique(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    b = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("b"))
    return a.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True).dropDuplicates(["k"])


@register("union_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@register(
    "stream_windows_closed",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
)
def stream_windows_closed(spark, sf_dir):
    """Events come by day; each window is written once the watermark, a day behind, has passed it. The last day's windows stay open."""
    base, events = _fresh(spark, "windows"), table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    for k in range(3):
        events.filter(f"day(ts) > {k * 10} AND day(ts) <= {k * 10 + 10 if k < 2 else 31}").repartitionByRange(2, "ts").write.mode("append").parquet(f"{base}/in")
    timed = streams.files(spark, f"{base}/in", events.schema, per_batch=100).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.append_windows(timed, "ts", "6 hours", "1 day", f"{base}/out", f"{base}/checkpoint", "event_type")
    return spark.read.parquet(f"{base}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@register("stream_rescued", "SELECT count(*) FILTER (n_nationkey % 5 > 0) AS good, count(*) FILTER (n_nationkey % 5 = 0) AS rescued FROM nation")
def stream_rescued(spark, sf_dir):
    base, nation = _fresh(spark, "rescued-stream"), table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("n_nationkey", "n_name")))
    nation.select(line.alias("value")).write.text(f"{base}/in")
    schema = nation.select("n_nationkey", "n_name").schema
    streams.append_once(streams.files(spark, f"{base}/in", schema, "json", rescued=True), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").agg(F.count_if(F.col("_rescued").isNull()).alias("good"), F.count_if(F.col("_rescued").isNotNull()).alias("rescued"))


@register("stream_schema_evolves", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN s_name END AS s_name FROM supplier")
def stream_schema_evolves(spark, sf_dir):
    """Stopped, and started again with the column that has come; what was written before has none."""
    base, supplier = _fresh(spark, "evolve"), table(spark, sf_dir, "supplier")
    schema = supplier.select("s_suppkey").schema
    for columns, rest in ((["s_suppkey"], 0), (["s_suppkey", "s_name"], 1)):
        part = supplier.filter(f"s_suppkey % 2 = {rest}").select(*columns)
        part.write.mode("append").parquet(f"{base}/in")
        schema = streams.evolved(schema, part.schema)
        streams.append_once(streams.files(spark, f"{base}/in", schema), f"{base}/out", f"{base}/checkpoint")
    return spark.read.option("mergeSchema", True).parquet(f"{base}/out")
