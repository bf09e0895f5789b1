"""Live measures, panels, drills, grids and what dimensions say, over the star and over a mart of it."""

import datetime

from pyspark.sql import functions as F

from lumenmart.operators import semantic
from lumenmart.plans import names
from lumenmart.queries.kpi import MART, STAR, mart, star
from lumenmart.registry import register, table

EDGES = [("orders", "customer"), ("customer", "nation"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("supplier", "nation")]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")


LINES = "(SELECT * FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"


@register("model_inference", "SELECT 'lineitem' AS fact, string_agg(n, ', ' ORDER BY n) AS measures FROM (VALUES ('Record Count'), ('Total L Discount'), ('Total L Extendedprice'), ('Total L Quantity'), ('Total L Tax')) AS t(n)")
def model_inference(spark, sf_dir):
    """The fact by the edges and its measures by names and types: keys and line numbers are none."""
    fact = semantic.infer_fact(EDGES, [])
    found = semantic.infer_measures(lines(spark, sf_dir), table(spark, sf_dir, fact).columns)
    return spark.createDataFrame([(fact, ", ".join(sorted(found)))], "fact string, measures string")


def model(spark, sf_dir):
    frame = lines(spark, sf_dir)
    found = semantic.infer_measures(frame, table(spark, sf_dir, "lineitem").columns)
    return semantic.Model(frame, {**found, "Parts": semantic.Live("count_distinct", "l_partkey")})


@register("live_sum", f'SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM {LINES} WHERE p_size BETWEEN 10 AND 20 GROUP BY 1')
def live_sum(spark, sf_dir):
    out = semantic.live(model(spark, sf_dir), "Total L Extendedprice", ["L_ReturnFlag", "not there"], {"P_SIZE": {"from": 10, "to": 20}, "unknown": 3})
    return out.select("l_returnflag", F.round("Total L Extendedprice", 2).alias("total"))


@register("live_count", f"SELECT l_linestatus, count(*) AS records FROM {LINES} WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def live_count(spark, sf_dir):
    return semantic.live(model(spark, sf_dir), "Record Count", ["l_linestatus"], {"l_returnflag": ["R", "A"]}).withColumnRenamed("Record Count", "records")


@register("live_count_distinct", f"SELECT p_type, count(DISTINCT l_partkey) AS parts FROM {LINES} GROUP BY 1")
def live_count_distinct(spark, sf_dir):
    return semantic.live(model(spark, sf_dir), "Parts", ["p_type"]).withColumnRenamed("Parts", "parts")


@register(
    "display_headlines",
    f"""WITH t AS (SELECT c_mktsegment, sum(revenue) AS revenue FROM {MART} GROUP BY 1) SELECT * FROM (
    SELECT 'ranking' AS kind, (SELECT c_mktsegment || ': ' || printf('%.2f', revenue) FROM t ORDER BY revenue DESC LIMIT 1) AS headline
    UNION ALL SELECT 'share', (SELECT count(*)::VARCHAR FROM t) UNION ALL SELECT 'sum', (SELECT printf('%.2f', sum(revenue)) FROM t)
    UNION ALL SELECT 'avg', (SELECT printf('%.2f', avg(revenue)) FROM t) UNION ALL SELECT 'max', (SELECT printf('%.2f', max(revenue)) FROM t))""",
)
def display_headlines(spark, sf_dir):
    """One number of a grouped result, by what it shows and by which function its measure had."""
    t = mart(spark, sf_dir).groupBy("c_mktsegment").agg(F.sum("revenue").alias("revenue"))
    out = semantic.headline(t, "revenue", "ranking", "c_mktsegment").select(F.lit("ranking").alias("kind"), "headline")
    out = out.unionByName(semantic.headline(t, "revenue", "share", "c_mktsegment").select(F.lit("share").alias("kind"), "headline"))
    for metric, shape in (("sum", ""), ("avg", ""), ("sum", "percent")):
        function = semantic.headline_function(metric, shape)
        out = out.unionByName(semantic.headline(t, "revenue", function=function).select(F.lit(function).alias("kind"), "headline"))
    return out


@register(
    "display_again",
    f"""SELECT c_mktsegment, round(avg(revenue), 2) AS mean, round(min(revenue), 2) AS least, round(sum(revenue) / sum(sum(revenue)) OVER () * 100, 4) AS percent FROM {MART} GROUP BY 1""",
)
def display_again(spark, sf_dir):
    m = mart(spark, sf_dir)
    mean = semantic.again(m, "revenue", ["c_mktsegment"], "avg").select("c_mktsegment", F.round("revenue", 2).alias("mean"))
    least = semantic.again(m, "revenue", ["c_mktsegment"], "min").select("c_mktsegment", F.round("revenue", 2).alias("least"))
    share = semantic.again(m, "revenue", ["c_mktsegment"], as_percent=True).select("c_mktsegment", F.round("revenue", 4).alias("percent"))
    return mean.join(least, "c_mktsegment").join(share, "c_mktsegment")


@register(
    "display_cap_two_ways",
    f"""WITH x AS (SELECT n_name, c_mktsegment, sum(o_totalprice) AS v FROM {STAR} GROUP BY 1, 2),
    a AS (SELECT n_name FROM x GROUP BY 1 ORDER BY sum(v) DESC, 1 LIMIT 12), y AS (SELECT CASE WHEN n_name IN (FROM a) THEN n_name ELSE 'Other' END AS n_name, c_mktsegment, v FROM x),
    b AS (SELECT c_mktsegment FROM y GROUP BY 1 ORDER BY sum(v) DESC, 1 LIMIT 3)
    SELECT n_name, CASE WHEN c_mktsegment IN (FROM b) THEN c_mktsegment ELSE 'Other' END AS c_mktsegment, round(sum(v), 2) AS o_totalprice FROM y GROUP BY 1, 2""",
)
def display_cap_two_ways(spark, sf_dir):
    return semantic.capped(star(spark, sf_dir), "n_name", "c_mktsegment", "o_totalprice", kinds=3)


@register(
    "display_order",
    """SELECT o_orderpriority AS category, count(*)::DOUBLE AS orders, row_number() OVER (ORDER BY substr(o_orderpriority, 1, 1)::INT) AS place FROM orders GROUP BY 1
    UNION ALL SELECT o_orderstatus, count(*)::DOUBLE, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) FROM orders GROUP BY 1""",
)
def display_order(spark, sf_dir):
    """Categories that all begin with a number come by it, others by the measure."""
    orders, out = table(spark, sf_dir, "orders"), None
    for column in ("o_orderpriority", "o_orderstatus"):
        counted = orders.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).cast("double").alias("orders"))
        one = semantic.in_order(counted, "category", "orders").select("category", "orders", "place")
        out = one if out is None else out.unionByName(one)
    return out


@register("display_preview", "SELECT least(count(*), 5000) AS rows FROM lineitem")
def display_preview(spark, sf_dir):
    return semantic.preview(table(spark, sf_dir, "lineitem")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "panel_top", f"SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM {STAR} WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 5",
)
def panel_top(spark, sf_dir):
    return semantic.panel(star(spark, sf_dir).withColumnRenamed("o_totalprice", "revenue"), "revenue", True, ["n_name"], {"c_mktsegment": "BUILDING"}, 5)


@register(
    "panel_cross_filter",
    f"""SELECT 'mart' AS frame, count(*) AS rows FROM {MART} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F'
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'region', count(*) FROM region""",
)
def panel_cross_filter(spark, sf_dir):
    frames = {"mart": mart(spark, sf_dir), "customer": table(spark, sf_dir, "customer"), "region": table(spark, sf_dir, "region")}
    out = None
    for name, frame in semantic.cross_filter(frames, {"C_MKTSEGMENT": ["BUILDING", "MACHINERY"], "o_orderstatus": "F", "r_name": []}).items():
        one = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("frame"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "drill_to_rows",
    f"""SELECT 'gold' AS source, c_mktsegment AS cut, round(sum(revenue), 2) AS revenue FROM {MART} GROUP BY ALL
    UNION ALL SELECT 'silver', n_name, round(sum(o_totalprice), 2) FROM {STAR} WHERE o_orderstatus = 'F' GROUP BY ALL""",
)
def drill_to_rows(spark, sf_dir):
    """From the result where it has the cut; from the rows below where it does not; and nothing where neither has it or the measure can't be added."""
    gold, silver = mart(spark, sf_dir), star(spark, sf_dir).withColumnRenamed("o_totalprice", "revenue")
    if semantic.drill(gold, silver, "revenue", True, ["planet"]) is not None or semantic.drill(gold, silver, "revenue", False, ["c_mktsegment"]) is not None:
        raise AssertionError("a drill that can't be made was made")
    a = semantic.drill(gold, silver, "revenue", True, ["C_MKTSEGMENT"]).select(F.lit("gold").alias("source"), F.col("c_mktsegment").alias("cut"), "revenue")
    b = semantic.drill(gold, silver, "revenue", True, ["n_name"], {"o_orderstatus": "F"}).select(F.lit("silver").alias("source"), F.col("n_name").alias("cut"), "revenue")
    return a.unionByName(b)


LADDER = ", ".join(f"count(DISTINCT date_trunc('{u}', o_orderdate)) AS {u}" for u in semantic.LADDER)


@register(
    "drill_start_grain",
    f"""WITH n AS (SELECT {LADDER} FROM orders) SELECT CASE WHEN year BETWEEN 2 AND 40 THEN 'year' WHEN quarter BETWEEN 2 AND 40 THEN 'quarter' WHEN month BETWEEN 2 AND 40 THEN 'month' ELSE 'day' END AS start,
    'quarter, month, day' AS finer FROM n""",
)
def drill_start_grain(spark, sf_dir):
    from lumenmart.functions.columns import time_bucket

    laddered = table(spark, sf_dir, "orders").select(*[time_bucket(u, F.col("o_orderdate")).alias(u) for u in semantic.LADDER])
    start, finer = semantic.start_grain(laddered)
    return spark.createDataFrame([(start, ", ".join(finer))], "start string, finer string")


@register(
    "drill_panels",
    f"""SELECT 'c_mktsegment' AS dimension, 'ring' AS kind, c_mktsegment AS value, round(sum(o_totalprice), 2) AS o_totalprice FROM {STAR} WHERE o_orderstatus = 'F' GROUP BY 3
    UNION ALL (SELECT 'n_name', 'ranking', n_name, round(sum(o_totalprice), 2) FROM {STAR} WHERE o_orderstatus = 'F' GROUP BY 3 ORDER BY sum(o_totalprice) DESC, 3 LIMIT 12)""",
)
def drill_panels(spark, sf_dir):
    """After a click on finished orders: what still varies, as a ring or a ranking; the status itself no more."""
    panels = semantic.drill_panels(star(spark, sf_dir).withColumn("same", F.lit(1)), ["o_orderstatus", "c_mktsegment", "n_name", "same"], "o_orderstatus", "F", "o_totalprice")
    out = None
    for dimension, (kind, rows) in panels.items():
        one = rows.select(F.lit(dimension).alias("dimension"), F.lit(kind).alias("kind"), F.col(dimension).alias("value"), "o_totalprice")
        out = one if out is None else out.unionByName(one)
    return out


ETA = "(SELECT sum(n * (m - t) * (m - t)) / (SELECT sum((o_totalprice - t) ** 2) FROM orders, (SELECT avg(o_totalprice) AS t FROM orders)) FROM (SELECT count(*) AS n, avg(o_totalprice) AS m FROM {0} GROUP BY {1}), (SELECT avg(o_totalprice) AS t FROM orders))"


@register(
    "importance_ranking",
    "SELECT * FROM (VALUES ("
    + "), (".join(f"'{d}', round({ETA.format(STAR, d)} * least(1, 12 / (SELECT count(DISTINCT {d}) FROM {STAR})), 4)" for d in ("o_orderpriority", "n_name", "c_mktsegment"))
    + ")) AS t(dimension, score)",
)
def importance_ranking(spark, sf_dir):
    return semantic.rank_dimensions(star(spark, sf_dir).withColumn("same", F.lit("x")), ["o_orderpriority", "n_name", "c_mktsegment", "same", "o_custkey"], "o_totalprice")


@register(
    "importance_of_counts",
    f"""SELECT 'o_orderstatus' AS dimension, round(1 + sum(p * ln(p)) / ln(count(*)), 4) AS score FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {STAR} GROUP BY o_orderstatus)""",
)
def importance_of_counts(spark, sf_dir):
    return semantic.rank_dimensions(star(spark, sf_dir), ["o_orderstatus"], None)


@register(
    "display_spread",
    f"""SELECT 'n_name' AS dimension, round(stddev_pop(t) / abs(avg(t)), 6) AS informativeness, max(t) >= 50 * min(t) AS log_scale FROM (SELECT sum(o_totalprice) AS t FROM {STAR} GROUP BY n_name)
    UNION ALL SELECT 'o_orderkey', round(stddev_pop(t) / abs(avg(t)), 6), max(t) >= 50 * min(t) FROM (SELECT sum(o_totalprice) AS t FROM {STAR} GROUP BY o_orderkey)""",
)
def display_spread(spark, sf_dir):
    s = star(spark, sf_dir)
    out = [semantic.spread(s, d, "o_totalprice").select(F.lit(d).alias("dimension"), "informativeness", "log_scale") for d in ("n_name", "o_orderkey")]
    return out[0].unionByName(out[1])


@register("display_names", "SELECT coalesce(r_name, n_regionkey::VARCHAR) AS n_regionkey, n_name FROM nation LEFT JOIN (FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey")
def display_names(spark, sf_dir):
    return semantic.display_names(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), "n_regionkey", table(spark, sf_dir, "region").filter("r_name <> 'ASIA'"), "r_regionkey", "r_name")


@register(
    "display_anonymous",
    """SELECT 'Customer ' || k AS c_name, c_acctbal FROM customer JOIN (SELECT c_name, row_number() OVER (ORDER BY sum(c_acctbal) DESC, c_name) AS k FROM customer GROUP BY 1) USING (c_name)""",
)
def display_anonymous(spark, sf_dir):
    return semantic.anonymous(table(spark, sf_dir, "customer").select("c_name", "c_acctbal"), "c_name", "c_acctbal", "Customer")


@register("filter_dates_as_text", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def filter_dates_as_text(spark, sf_dir):
    """Text in which every seventh row is no date: those rows go."""
    text = F.when(F.col("event_id") % 7 == 0, "none yet").otherwise(F.col("ts").cast("string"))
    return semantic.in_dates(table(spark, sf_dir, "events").select("event_id", text.alias("day")), "day", "2024-01-05", "2024-01-09").select("event_id")


def people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.lit("x@y").alias("e_mail"))


PEOPLE = "(SELECT c_custkey AS custkey, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer)"


@register("grid_rows", f"SELECT custkey, segment, balance, nation FROM {PEOPLE} WHERE balance >= 1000 AND segment ILIKE '%build%' AND nation::VARCHAR = '3' ORDER BY balance DESC, custkey LIMIT 20 OFFSET 5")
def grid_rows(spark, sf_dir):
    """Filters on hidden columns and unknown tests do nothing; names and mail are never shown."""
    tests = {
        "balance": {"filterType": "number", "type": "greaterThanOrEqual", "filter": 1000}, "segment": {"filterType": "text", "type": "contains", "filter": "Build"}, "nation": {"filterType": "text", "type": "equals", "filter": 3},
        "name": {"filterType": "text", "type": "equals", "filter": "nobody"}, "custkey": {"filterType": "number", "type": "drop", "filter": 1},
    }
    order = [{"colId": "balance", "sort": "desc"}, {"colId": "custkey", "sort": "asc"}, {"colId": "name", "sort": "asc"}]
    return semantic.grid(people(spark, sf_dir), {"filterModel": tests, "sortModel": order, "startRow": 5, "endRow": 25})[0]


@register("grid_block_cap", "SELECT least(1000, count(*)) AS shown, count(*) AS rows FROM customer")
def grid_block_cap(spark, sf_dir):
    rows, total = semantic.grid(people(spark, sf_dir), {"startRow": 0, "endRow": 1_000_000})
    return rows.agg(F.count(F.lit(1)).alias("shown")).join(F.broadcast(total))


@register(
    "grid_groups", f"SELECT nation, sum(balance) AS balance, count(custkey) AS custkey FROM {PEOPLE} WHERE segment = 'BUILDING' GROUP BY 1 ORDER BY 1 LIMIT 100",
)
def grid_groups(spark, sf_dir):
    """The second level below an opened first one; a function that is not known becomes a sum, or a count for text."""
    values = [{"field": "balance", "aggFunc": "median; drop"}, {"field": "custkey", "aggFunc": "count"}, {"field": "name", "aggFunc": "max"}]
    out = semantic.grid(people(spark, sf_dir), {"rowGroupCols": ["segment", {"id": "nation"}], "groupKeys": ["BUILDING"], "valueCols": values})[0]
    return out.select("nation", F.round("balance", 2).alias("balance"), "custkey")


@register("grid_leaves", f"SELECT custkey, segment, balance, nation FROM {PEOPLE} WHERE segment = 'BUILDING' AND nation = 7 ORDER BY custkey LIMIT 100")
def grid_leaves(spark, sf_dir):
    return semantic.grid(people(spark, sf_dir), {"rowGroupCols": ["segment", "nation"], "groupKeys": ["BUILDING", 7], "sortModel": [{"colId": "custkey", "sort": "asc"}]})[0]


@register(
    "names_sensitive",
    """SELECT 'customer' AS owner, 'name' AS name, 'name' AS kind, count(c_name) AS values FROM customer UNION ALL SELECT 'customer', 'card_verification_code', 'card_verification', count(c_acctbal) FROM customer
    UNION ALL SELECT 'customer', 'SubscriberId', 'health_plan_beneficiary', count(c_custkey) FROM customer UNION ALL SELECT 'customer', 'zip', 'address', count(c_nationkey) FROM customer
    UNION ALL SELECT 'pages', 'url', 'url', count(url) FROM pages""",
)
def names_sensitive(spark, sf_dir):
    """Columns of tables that hold personal data by their names, and how many values they have; a nation's name is none."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("card_verification_code"), F.col("c_custkey").alias("SubscriberId"), F.col("c_nationkey").alias("zip"), F.col("c_mktsegment").alias("segment"),
    )
    out = None
    for owner, df in (("customer", customer), ("nation", table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")), ("pages", table(spark, sf_dir, "pages")), ("orders", table(spark, sf_dir, "orders"))):
        found = {n: k for n in df.columns if (k := names.category(n, owner))}
        if found:
            one = df.agg(F.array(*[F.struct(F.lit(owner).alias("owner"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.count(n).alias("values")) for n, k in found.items()]).alias("f")).select(F.inline("f"))
            out = one if out is None else out.unionByName(one)
    return out


@register(
    "panel_range_filter", f"SELECT month, round(sum(revenue), 2) AS revenue FROM {MART} WHERE month >= DATE '1999-01-01' GROUP BY 1",
)
def panel_range_filter(spark, sf_dir):
    return semantic.panel(mart(spark, sf_dir), "revenue", True, ["month"], {"month": {"from": datetime.date(1999, 1, 1)}})
