"""Forms for volumes: selection, components, references in one pass, sketches, pages by key, hashes of rows in any order."""

from pyspark.sql import functions as F

from lumenmart.operators import graphs, selection, semantic, verify
from lumenmart.plans import joins
from lumenmart.registry import register, table


@register(
    "quantiles_by_selection",
    """SELECT l_returnflag, unnest([0.01, 0.25, 0.5, 0.999])::DOUBLE AS q, round(unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.999])), 4) AS value FROM lineitem GROUP BY l_returnflag""",
)
def by_selection(spark, sf_dir):
    """Few values are settled by counts, so that every group goes through rounds."""
    found = selection.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.999], ["l_returnflag"], few=1000)
    return found.select("l_returnflag", "q", F.round("value", 4).alias("value"))


LINKS = "SELECT o_custkey AS a, o_orderkey % 1500 AS b FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 60000"


@register(
    "graph_components",
    f"""WITH RECURSIVE e AS ({LINKS} UNION SELECT b, a FROM ({LINKS})), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
    SELECT node, min(other) AS root FROM r GROUP BY node""",
)
def components(spark, sf_dir):
    cheap = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice < 60000")
    return graphs.components(cheap.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b")))


KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"],
}
EACH = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v FROM {t}" for t, cs in KEYS.items() for c in cs)


@register(
    "join_all_references",
    f"""WITH r AS ({EACH}), d AS (SELECT t, c, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL), s AS (SELECT t, c, count(*) AS n, round(count(*) / sum(n), 6) AS u FROM d GROUP BY ALL),
    m AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM d x JOIN d y USING (v) GROUP BY ALL)
    SELECT x.t AS many, x.c AS column_name, y.t AS one, y.c AS key, x.n AS values, coalesce(m.n, 0) AS resolved, round(coalesce(m.n, 0) / x.n, 6) AS ratio, y.u AS key_ratio
    FROM s x JOIN s y ON x.c <> y.c LEFT JOIN m ON m.a = x.c AND m.b = y.c""",
)
def all_references(spark, sf_dir):
    return joins.references({t: table(spark, sf_dir, t) for t in KEYS}, KEYS)


@register(
    "semantic_sketches_roll_up",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue, true AS within FROM orders GROUP BY 1 UNION ALL SELECT 'F only', round(sum(o_totalprice), 2), true FROM orders WHERE o_orderstatus = 'F'""",
)
def sketches_roll_up(spark, sf_dir):
    """Customers of a mart by day, priority and status, counted again at coarser grains, within four standard errors of the exact count."""
    orders = table(spark, sf_dir, "orders")
    mart = semantic.sketched(orders, ["o_orderdate", "o_orderpriority", "o_orderstatus"], ["o_custkey"], ["o_totalprice"])
    bound = 4 * semantic.sketch_error()
    exact = orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))
    near = F.abs(F.col("distinct_o_custkey") - F.col("n")) <= bound * F.col("n")
    by = semantic.rolled(mart, ["o_orderpriority"], ["o_totalprice"]).join(exact, "o_orderpriority").select("o_orderpriority", F.round("o_totalprice", 2).alias("revenue"), near.alias("within"))
    one = orders.filter("o_orderstatus = 'F'").agg(F.count_distinct("o_custkey").alias("n"))
    drilled = semantic.rolled(mart, [], ["o_totalprice"], {"o_orderstatus": "F"}).join(F.broadcast(one))
    return by.unionByName(drilled.select(F.lit("F only").alias("o_orderpriority"), F.round("o_totalprice", 2).alias("revenue"), near.alias("within")))


@register("semantic_page_by_key", "SELECT l_orderkey, l_quantity, l_extendedprice FROM (SELECT DISTINCT l_orderkey, l_quantity, l_extendedprice FROM lineitem) ORDER BY l_quantity DESC, l_orderkey, l_extendedprice LIMIT 40 OFFSET 80")
def page_by_key(spark, sf_dir):
    """The third page; many rows tie in the quantity."""
    rows, after = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice").distinct(), None
    for _ in range(2):
        after = semantic.page_after(rows, [("l_quantity", "desc")], ["l_orderkey", "l_extendedprice"], after, 40).collect()[-1].asDict()
    return semantic.page_after(rows, [("l_quantity", "desc")], ["l_orderkey", "l_extendedprice"], after, 40)


@register("verify_multiset", "SELECT count(*) AS rows, true AS reordered, false AS one_cell, false AS a_row_twice FROM lineitem")
def multiset(spark, sf_dir):
    """Doubles in other partitions, one changed by its last bit, and one row more in place of another."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_extendedprice") / 7).alias("seventh"))
    # Keys may be any, so both rows are taken from those that are there: the first one, whose last bit a factor changes, and the last one.
    ends = rows.filter(F.abs("seventh").between(1e-300, 1e300)).agg(*[f(F.struct(*rows.columns)).alias(f.__name__) for f in (F.min, F.max)]).first()
    here = F.lit(ends["min"] is not None)
    for c in rows.columns:
        here &= F.col(c).eqNullSafe(F.lit(ends["min"] and ends["min"][c]))
    last_bit = rows.withColumn("seventh", F.when(here, F.col("seventh") * (1 + 2.0**-52)).otherwise(F.col("seventh")))
    twice = rows.select(*[F.when(here, F.lit(ends["max"] and ends["max"][c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in rows.columns])
    out = rows.agg(F.count(F.lit(1)).alias("rows"))
    for name, other in (("reordered", rows.repartition(7, "seventh").select(*reversed(rows.columns))), ("one_cell", last_bit), ("a_row_twice", twice)):
        out = out.join(F.broadcast(verify.same_result(rows, other).select(F.col("same").alias(name))))
    return out
