"""Claims that the rows below a result bear out, lineage from plans, coverage of questions, shapes of values, and graphs of evidence."""

from dataclasses import replace

from pyspark.sql import functions as F

from lumenmart.functions import columns as c
from lumenmart.operators import evidence, kpi, proof, verify
from lumenmart.plans import joins, names
from lumenmart.queries.kpi import STAR, star
from lumenmart.registry import register, table

MEASURES = ["c_acctbal", "o_totalprice"]


def finished(spark, sf_dir):
    """A result that is limited to one status and one priority."""
    rows = star(spark, sf_dir).filter("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
    return rows.groupBy("c_mktsegment", "o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def marked(spark, sf_dir):
    """The star with a column that explains much of the price."""
    return star(spark, sf_dir).withColumn("size", F.when(F.col("o_totalprice") > 250_000, "large").otherwise("small"))


@register("claim_measure_behind", "SELECT 'o_totalprice' AS source, 'F' AS status, '5-LOW' AS priority UNION ALL SELECT NULL, 'F', '5-LOW'")
def claim_measure_behind(spark, sf_dir):
    """Found where the result is true; not found where one of its cells is changed."""
    gold, rows, out = finished(spark, sf_dir), star(spark, sf_dir), []
    wrong = gold.withColumn("revenue", F.when(F.col("c_mktsegment") == "BUILDING", F.col("revenue") + 1).otherwise(F.col("revenue")))
    for g in (gold, wrong):
        source, scope = proof.measure_behind(g, "revenue", ["c_mktsegment"], rows, MEASURES)
        out.append((source, scope["o_orderstatus"], scope["o_orderpriority"]))
    return spark.createDataFrame(out, "source string, status string, priority string")


@register(
    "claim_suggestions",
    f"""SELECT 'parameterize_scope' AS kind, 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) || ' values' AS detail FROM {STAR}
    UNION ALL SELECT 'parameterize_scope', 'o_orderpriority', count(DISTINCT o_orderpriority) || ' values' FROM {STAR}
    UNION ALL SELECT 'add_cut', 'size', printf('%.2f', round(sum(n * (m - t) * (m - t)) / any_value(v), 4)) FROM (SELECT count(*) AS n, avg(o_totalprice) AS m FROM {STAR} WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' GROUP BY o_totalprice > 250000),
    (SELECT avg(o_totalprice) AS t, var_pop(o_totalprice) * count(*) AS v FROM {STAR} WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')""",
)
def claim_suggestions(spark, sf_dir):
    return proof.suggestions(finished(spark, sf_dir), "revenue", ["c_mktsegment"], marked(spark, sf_dir), MEASURES)


@register("claim_rooted", f"SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM {STAR} WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '2000-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def claim_rooted(spark, sf_dir):
    """The chart on the rows, within bounds and a list; a scope that does not give the numbers gives no chart."""
    rows = star(spark, sf_dir)
    scope = {"o_orderdate": {"from": "1998-01-01", "lt": "2000-01-01"}, "o_orderstatus": ["F", "O"]}
    gold = proof.within_scope(rows, scope).groupBy("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    if proof.rooted(gold, "revenue", "c_mktsegment", rows, "o_totalprice", {**scope, "o_orderdate": {"gt": "1998-02-01"}}) is not None:
        raise AssertionError("a chart with other numbers was made")
    return proof.rooted(gold, "revenue", "c_mktsegment", rows, "o_totalprice", scope)


WHERE = "o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-07-01' AND o_orderstatus IN ('F', 'O') AND o_totalprice > 20000"


@register("claim_stated_scope", f"SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM {STAR} WHERE {WHERE} GROUP BY 1")
def claim_stated_scope(spark, sf_dir):
    """A result that shows none of the columns that it is limited by, on its rows, cut anew; without rows where its plan says more than a scope can."""
    rows = star(spark, sf_dir)
    gold = rows.withColumnRenamed("o_orderdate", "day").filter(WHERE.replace("o_orderdate", "day")).groupBy("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    inside = proof.scoped_rows(gold, "revenue", "c_mktsegment", rows, "o_totalprice")
    if inside is None or proof.scoped_rows(gold.filter("revenue > 0"), "revenue", "c_mktsegment", rows, "o_totalprice") is not None:
        raise AssertionError("the scope was not found, or a bound on groups was taken for one")
    return inside.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("claim_trend", "SELECT 'revenue' AS measure, CAST(date_trunc('year', o_orderdate) AS DATE) AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2")
def claim_trend(spark, sf_dir):
    """A total's course by the coarsest grain with two blocks; a number that no measure gives has none."""
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey", *[c.time_bucket(u, F.col("o_orderdate")).alias(u) for u in ("year", "quarter", "month")])
    total = rows.agg(F.sum("o_totalprice")).first()[0]
    measures = {"customers": ("count_distinct", "o_custkey"), "revenue": ("sum", "o_totalprice")}
    if proof.trend(total * 2, rows, measures, ["year", "quarter", "month"]) is not None:
        raise AssertionError("a trend of another number was made")
    name, grain, out = proof.trend(total, rows, measures, ["year", "quarter", "month"])
    return out.select(F.lit(name).alias("measure"), grain, F.round(name, 2).alias("value"))


@register("claim_columns", "SELECT * FROM (VALUES ('o_orderkey', 'measure'), ('o_orderdate', 'date'), ('day_text', 'date'), ('o_orderstatus', 'dimension'), ('year', 'date'), ('nothing', 'dimension'), ('flag', 'dimension')) AS t(name, kind)")
def claim_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    frame = orders.select("o_orderkey", "o_orderdate", F.col("o_orderdate").cast("string").alias("day_text"), "o_orderstatus", F.year("o_orderdate").alias("year"), F.lit(None).cast("string").alias("nothing"), (F.col("o_orderkey") > 5).alias("flag"))
    return spark.createDataFrame(list(proof.classify_columns(frame).items()), "name string, kind string")


@register(
    "claim_shapes",
    r"""SELECT CASE WHEN avg((abs(round(o_totalprice, 2) - o_totalprice) < 1e-9)::INT) >= 0.8 THEN 'currency_2dp' END AS price, CASE WHEN avg(regexp_matches(o_orderdate::DATE::VARCHAR, '^\d{4}-\d{2}-\d{2}$')::INT) >= 0.8 THEN 'iso_date' END AS day,
    CASE WHEN avg(regexp_matches('AB' || o_orderkey, '^[A-Za-z]+[-_]?\d+$')::INT) >= 0.8 THEN 'prefixed_numeric_code' END AS code, CASE WHEN avg(regexp_matches(substr(md5(o_orderkey::VARCHAR), 1, 8), '^[A-Za-z0-9]{6,12}$')::INT) >= 0.8 THEN 'fixed_length_alnum' END AS digest,
    NULL AS status, NULL AS "key", '100.5' AS half FROM orders""",
)
def claim_shapes(spark, sf_dir):
    """Money by its decimals though a float writes 100.5; whole numbers are no money; a letter has no shape."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.concat(F.lit("AB"), "o_orderkey").alias("code"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8).alias("digest"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"),
    )
    shapes = orders.agg(*[c.shape_of(F.col(f.name), f.dataType).alias(f.name) for f in orders.schema.fields])
    return shapes.withColumn("half", F.lit(100.5).cast("string"))


@register(
    "claim_value_kinds",
    "SELECT 'code' AS zip, 'identifier' AS digest, 'temporal' AS moment, 'long_label' AS name, 'label' AS segment, NULL AS few",
)
def claim_value_kinds(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.format_string("%05d", "c_custkey").alias("zip"), F.md5("c_name").alias("digest"), F.lit("2024-05-06 07:08").alias("moment"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") < 2, F.col("c_name")).alias("few"),
    )
    return customer.agg(*[c.value_kind(F.col(n)).alias(n) for n in customer.columns])


@register(
    "verify_same_result", "SELECT 'again' AS name, true AS same UNION ALL SELECT 'one cell', false UNION ALL SELECT 'other columns', false",
)
def verify_same_result(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    out = None
    for name, other in (("again", orders.repartition(5, "o_totalprice")), ("one cell", changed), ("other columns", orders.drop("o_orderstatus"))):
        one = verify.same_result(orders, other).select(F.lit(name).alias("name"), "same")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "verify_reproduces", "SELECT 'itself' AS name, true AS same UNION ALL SELECT 'a group lacks', false UNION ALL SELECT 'a cell differs', false",
)
def verify_reproduces(spark, sf_dir):
    """A result with a group of null equals itself."""
    full = table(spark, sf_dir, "orders").groupBy(F.expr("nullif(o_orderstatus, 'P')").alias("status")).agg(F.sum("o_totalprice").alias("m"))
    cases = {"itself": full, "a group lacks": full.filter("status IS NOT NULL"), "a cell differs": full.withColumn("m", F.col("m") * F.when(F.col("status") == "F", 1.1).otherwise(1.0))}
    return spark.createDataFrame([(n, verify.reproduces(full, g, ["status"], "m")) for n, g in cases.items()], "name string, same boolean")


LINEAGE = (
    ("nation", "n_name", "land", "derived"), ("nation", "n_name", "*", "grouped"), ("orders", "o_totalprice", "revenue", "derived"), ("orders", "o_totalprice", "per_order", "derived"), ("orders", "o_orderkey", "per_order", "derived"),
    ("orders", "o_custkey", "*", "joined"), ("customer", "c_custkey", "*", "joined"), ("customer", "c_nationkey", "*", "joined"), ("nation", "n_nationkey", "*", "joined"), ("orders", "o_orderstatus", "*", "filtered"),
)


@register("verify_column_lineage", " UNION ALL ".join(f"SELECT '{t}.{c}' AS source, '{target}' AS target, '{how}' AS how, count({c}) AS values FROM {t}" for t, c, target, how in LINEAGE))
def verify_column_lineage(spark, sf_dir):
    """From the plan's tree: what each output column, renamed or computed, is derived from, and the columns that decide about rows; and how many values each has."""
    rows = star(spark, sf_dir).filter("o_orderstatus = 'F'").withColumnRenamed("n_name", "land")
    out = rows.groupBy("land").agg(F.sum("o_totalprice").alias("revenue"), F.try_divide(F.sum("o_totalprice"), F.count("o_orderkey")).alias("per_order"))
    edges = verify.column_lineage(out)
    counted = None
    for t in sorted({s.partition(".")[0] for s, _, _ in edges}):
        df = table(spark, sf_dir, t)
        one = df.agg(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("source"), F.count(c).alias("values")) for c in df.columns]).alias("c")).select(F.inline("c"))
        counted = one if counted is None else counted.unionByName(one)
    return spark.createDataFrame(edges, "source string, target string, how string").join(counted, "source")


LINKS = "(SELECT 'o' || (o_orderkey % 50) AS source, 'c' || o_custkey AS target, o_orderkey FROM orders WHERE o_orderkey % 10 < 2 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation)"


def links(spark, sf_dir):
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"))
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 10 < 2").withColumn("k", F.col("o_orderkey") % 50)
    return pair(orders, "o", "k", "c", "o_custkey").unionByName(pair(table(spark, sf_dir, "customer"), "c", "c_custkey", "n", "c_nationkey")).unionByName(pair(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey"))


@register("evidence_impact", f"WITH RECURSIVE w(name, distance) AS (SELECT 'o1', 0 UNION SELECT target, distance + 1 FROM w JOIN {LINKS} ON source = name) SELECT name, min(distance) AS distance FROM w GROUP BY 1")
def evidence_impact(spark, sf_dir):
    return evidence.impact(links(spark, sf_dir), "o1")


@register("verify_trace", f"WITH RECURSIVE w(name, distance) AS (SELECT 'r2', 0 UNION SELECT source, distance + 1 FROM w JOIN {LINKS} ON target = name) SELECT name, min(distance) AS distance FROM w GROUP BY 1")
def verify_trace(spark, sf_dir):
    """All that a region comes from, over tables of links."""
    return verify.lineage(links(spark, sf_dir), "r2")


@register(
    "evidence_about",
    """WITH n AS (SELECT 'c' || c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation), e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer)
    SELECT id, kind, 'itself' AS relation FROM n WHERE lower(name) LIKE '%nation_7%' UNION SELECT source, 'customer', 'lives in' FROM e WHERE target IN (SELECT id FROM n WHERE lower(name) LIKE '%nation_7%')""",
)
def evidence_about(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    nodes = nodes.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind")))
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("lives in").alias("relation"))
    return evidence.about(nodes, edges, "NATION_7")


@register("evidence_groups", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey % 7) AS root FROM (SELECT o_orderkey, o_custkey FROM orders)")
def evidence_groups(spark, sf_dir):
    """Orders share a customer, and a second key ties customers together by sevens."""
    orders = table(spark, sf_dir, "orders")
    keyed = orders.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("key")).unionByName(orders.select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey") % 7).alias("key")))
    return evidence.sharing_groups(keyed, "o_orderkey", "key")


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: len(w) > 2))"


@register(
    "evidence_retrieve",
    f"""SELECT path, score, excerpt FROM (SELECT item_id::VARCHAR AS path, len(list_intersect({WORDS.format("title || ' ' || text")}, q)) + len(list_intersect({WORDS.format('title')}, q)) AS score, text[1:400] AS excerpt
    FROM (SELECT item_id, text, text[1:20] AS title FROM benchmark), (SELECT {WORDS.format('text')} AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))) WHERE score > 0 ORDER BY score DESC, path LIMIT 5""",
)
def evidence_retrieve(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    query = bench.orderBy("item_id").limit(1).first()["text"]
    texts = bench.select(F.col("item_id").cast("string").alias("path"), F.substring("text", 1, 20).alias("title"), "text")
    return evidence.retrieve(texts, "path", "title", "text", query)


@register(
    "evidence_decisions",
    """SELECT event_type AS name, CASE WHEN count(*) >= 1500 AND event_type IN ('view', 'click') THEN 'stream' WHEN event_type = 'signup' THEN NULL WHEN avg(value) > 49 OR event_type = 'error' THEN 'batch' END AS outcome,
    CASE WHEN event_type = 'signup' THEN 'mean' ELSE '' END AS lacking FROM events GROUP BY event_type""",
)
def evidence_decisions(spark, sf_dir):
    """Rules in order, on what the events say of each type: what is not known of sign-ups leaves a rule open."""
    rules = [("stream", {"rows": {"gte": 1500}, "kind": {"in": ["view", "click"]}}), ("batch", {"any_of": [{"mean": {"gt": 49}}, {"kind": {"in": ["error"]}}]})]
    known = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean")).collect()  # a row a type
    out = []
    for r in known:
        facts = {"kind": r.event_type, "rows": r["rows"]} | ({"mean": r["mean"]} if r.event_type != "signup" else {})
        outcome, lacking = evidence.decide(rules, facts)
        out.append((r.event_type, outcome, ",".join(lacking)))
    return spark.createDataFrame(out, "name string, outcome string, lacking string")


@register(
    "verify_coverage",
    """SELECT name, findings, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('as asked', ''), ('no time', 'grain: month lacks'), ('no filter', 'filter: o_orderstatus = ''F'' lacks'), ('other literal', 'filter: o_orderstatus = ''F'' lacks'),
    ('other operator', 'filter: o_totalprice >= 1000 lacks'), ('no limit', 'shape: not limited to 5'), ('other limit', 'shape: limited to 50, not 5'), ('other measure', 'measure: sum_o_totalprice lacks'),
    ('called so', 'measure: sum_o_totalprice is another aggregate'), ('other bound', 'bound: sum_o_totalprice >= 10 lacks')) AS t(name, findings)""",
)
def verify_coverage(spark, sf_dir):
    """What results lack of one question, by the trees of their plans."""
    rows = star(spark, sf_dir)
    asked = kpi.read("sum(o_totalprice)", "Month(o_orderdate), n_name, o_orderstatus = 'F', o_totalprice >= 1000", "top 5 having at least 10 orders")
    cases = {
        "as asked": asked, "no time": replace(asked, dims=asked.dims[1:]), "no filter": replace(asked, filters=asked.filters[1:]), "other literal": replace(asked, filters=("o_orderstatus = 'O'", asked.filters[1])),
        "other operator": replace(asked, filters=(asked.filters[0], "o_totalprice > 1000")), "no limit": replace(asked, top=None), "other limit": replace(asked, top=50), "other bound": replace(asked, having=(">=", 11.0)),
    }
    found = {name: verify.coverage(asked, kpi.answer(rows, other)) for name, other in cases.items()}
    other = replace(asked, measures=(kpi.Measure("avg", "o_totalprice"),), having=None)
    bare = replace(asked, having=None)
    found["other measure"] = verify.coverage(bare, kpi.answer(rows, other))
    found["called so"] = verify.coverage(bare, kpi.answer(rows, other).withColumnRenamed("avg_o_totalprice", "sum_o_totalprice"))
    out = spark.createDataFrame([(n, "; ".join(f)) for n, f in found.items()], "name string, findings string")
    return out.join(F.broadcast(table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("rows"))))


@register(
    "names_keys",
    """SELECT 'order' AS owner, 'order_id' AS key, 'updated_at' AS mark, count(DISTINCT o_orderkey) AS keys, max(o_orderdate) AS latest FROM orders
    UNION ALL SELECT 'event', 'event_id', 'created_at', count(DISTINCT event_id), max(ts) FROM events""",
)
def names_keys(spark, sf_dir):
    """Keys and marks that names of columns give, and what they hold."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("updated_at"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("created_at"))
    out = None
    for owner, df in (("order", orders), ("event", events)):
        key, mark = names.own_key(df.schema, owner)[0], names.mark_column(df.schema)
        one = df.agg(F.lit(owner).alias("owner"), F.lit(key).alias("key"), F.lit(mark).alias("mark"), F.count_distinct(key).alias("keys"), F.max(mark).alias("latest"))
        out = one if out is None else out.unionByName(one)
    return out


@register("join_candidate_keys", "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'l_orderkey'), ('part', 'p_partkey', 'l_partkey'), ('customer', 'c_nationkey', 'n_nationkey')) AS t(name, a, b)")
def join_candidate_keys(spark, sf_dir):
    """Columns of two tables that are called alike and end like a key."""
    t = lambda n: table(spark, sf_dir, n)
    pairs = {"orders": (t("orders"), t("lineitem")), "part": (t("part"), t("lineitem")), "customer": (t("customer"), t("nation"))}
    return spark.createDataFrame([(n, a, b) for n, (x, y) in pairs.items() for a, b in joins.candidate_keys(x, y)], "name string, a string, b string")


@register(
    "join_choices",
    "SELECT 'rows' AS asked, count(*)::VARCHAR AS found FROM lineitem UNION ALL SELECT * FROM (VALUES ('base', 'lineitem'), ('near', 'events'), ('pinned', 'orders'), ('flipped', 'orders.o_custkey = customer.c_custkey, true'), ('no edge', NULL), ('formula', 'customer'), ('exists', '')) AS t(asked, found)",
)
def join_choices(spark, sf_dir):
    """Where to start, what would do as well, a pinned start, an edge asked for the other way round, and what formulas make necessary."""
    edges = [joins.Edge("orders", "o_custkey", "customer", "c_custkey"), joins.Edge("lineitem", "l_orderkey", "orders", "o_orderkey"), joins.Edge("lineitem", "l_partkey", "part", "p_partkey", 0.45)]
    scores, rows = [("lineitem", 4.9), ("events", 4.6), ("orders", 3.0)], {n: table(spark, sf_dir, n).count() for n in ("lineitem", "events", "orders")}
    base, near = joins.choose_base(scores, rows)
    edge, flipped = joins.edge_between(edges, "customer", "orders")
    columns = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_acctbal"]}
    out = [
        ("rows", str(rows[base])), ("base", base), ("near", ",".join(near)), ("pinned", joins.choose_base(scores, rows, "orders")[0]), ("flipped", f"{edge.many}.{edge.column} = {edge.one}.{edge.key}, {str(flipped).lower()}"),
        ("no edge", joins.edge_between(edges, "part", "lineitem") and "found"), ("formula", ",".join(joins.formula_tables("o_orderkey + c_acctbal", "orders", columns))),
        ("exists", ",".join(joins.formula_tables("exists (select 1 from customer c where c.c_acctbal > 0 and c_custkey = o_custkey)", "orders", columns))),
    ]
    return spark.createDataFrame(out, "asked string, found string")


@register("join_broadcast_of_known_size", "SELECT c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_broadcast_of_known_size(spark, sf_dir):
    """The customers are broadcast when they are known to be small, and not when their size is not known."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    edges = [joins.Edge("orders", "o_custkey", "customer", "c_custkey")]
    hinted = joins.star(tables, edges, "orders", ["customer"], {"customer": 1 << 20})
    plain = joins.star(tables, edges, "orders", ["customer"])
    if "broadcast" not in hinted._jdf.queryExecution().logical().toString().lower() or "broadcast" in plain._jdf.queryExecution().logical().toString().lower():
        raise AssertionError("the hint is not where it should be")
    return hinted.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
