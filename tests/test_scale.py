import math
import random

import pytest
from pyspark.sql import functions as F

from lumenmart.functions import columns
from lumenmart.operators import graphs, profiling, sampling, selection, semantic, verify
from lumenmart.plans import joins
from lumenmart.queries import scale


def exact(values, q):
    """Interpolated between ranks; NaN is the largest."""
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    p = q * (len(v) - 1)
    k = math.floor(p)
    return v[k] if p == k else v[k] + (p - k) * (v[k + 1] - v[k])


@pytest.mark.parametrize("few", [50, 1_000_000])
def test_selection_equals_sorting(spark, few):
    r, at = random.Random(1), [0.0, 0.003, 0.5, 0.777, 1.0]
    rows = [("a", r.gauss(0, 1e6)) for _ in range(8000)] + [(None, r.expovariate(1e-9)) for _ in range(3000)] + [("ties", float(r.randrange(3))) for _ in range(2000)] + [("one", 5.0), ("none", None)]
    rows += [("wild", x * 10.0 ** r.randrange(-300, 300)) for x in (r.random() - 0.5 for _ in range(1500))]
    got = selection.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), "v", at, ["g"], few=few).collect()
    assert len(got) == 5 * len(at)
    for x in got:
        assert x["value"] == pytest.approx(exact([v for g, v in rows if g == x.g and v is not None], x.q), rel=1e-12), x


def test_selection_without_groups(spark):
    rows = spark.range(20_001).select((F.col("id") * 7919 % 20_001).alias("v"))
    assert {x.q: x["value"] for x in selection.quantiles(rows, "v", [0.25, 0.5, 1.0], few=100).collect()} == {0.25: 5000.0, 0.5: 10000.0, 1.0: 20000.0}
    assert selection.quantiles(rows.limit(0), "v", [0.5]).count() == 0
    two = rows.select("v", (-F.col("v")).alias("w"))
    assert {(x.column_name, x["value"]) for x in selection.of_columns(two, ["v", "w"], [0.1]).collect()} == {("v", 2000.0), ("w", -18000.0)}


def test_quantiles_sort_no_rows(spark, monkeypatch):
    """Rows are counted by hash; of more groups than are broadcast, the largest ones are."""
    rows = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit("hot")).when(F.col("id") % 41 > 0, (F.col("id") % 41).cast("string")).alias("g"), (F.col("id") * 7919 % 4001).cast("double").alias("v")).checkpoint()
    found = selection.quantiles(rows, "v", [0.25, 0.9], ["g"], few=100)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(selection, "HOT", 3, raising=False)
    want = {}
    for r in rows.collect():
        want.setdefault(r.g, []).append(r.v)
    for out in (found, selection.quantiles(rows, "v", [0.25, 0.9], ["g"], few=100)):
        assert {(r.g, r.q): round(r["value"], 6) for r in out.collect()} == {(g, q): round(exact(v, q), 6) for g, v in want.items() for q in (0.25, 0.9)}


def test_tails_of_nothing(spark):
    empty = spark.createDataFrame([], "v double, w double")
    assert {(r["column"], r["tail"], r.full_share) for r in sampling.tail_shares(empty, empty, ["v"]).collect()} == {("v", "low", None), ("v", "high", None)}
    assert profiling.quantiles(empty, ["v"]).first().p50 is None


def test_a_long_chain_is_one_component(spark):
    n = 10_000
    rows = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(-5, -5), (20_000, 20_001), (20_002, 20_001), (None, 3)], "a long, b long"))
    got = {r.root: r["n"] for r in graphs.components(rows.repartition(4)).groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: n, -5: 1, 20_000: 3}


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(0, k) for k in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {(x.node, x.root) for x in graphs.components(spark.createDataFrame(edges, "a int, b int")).collect()} == {(x, find(x)) for x in root}
    assert graphs.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_reachability_has_no_bound(spark):
    edges = spark.range(34).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"))
    assert {r.name: r.distance for r in verify.lineage(edges, "n34").collect()} == {f"n{34 - k}": k for k in range(35)}
    loop = edges.unionByName(spark.createDataFrame([("n34", "n0")], "source string, target string"))
    assert verify.walk(loop, "n5", "source", "target").count() == 35


def test_a_multiset_has_no_order(spark):
    rows = spark.range(100_000).select("id", (F.rand(1) * 1e12).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"), F.create_map(F.lit("k"), "id").alias("m")).checkpoint()
    same = lambda a, b: verify.same_result(a, b).first().same
    assert same(rows, rows.repartition(13, "v").select("m", "s", F.col("v").alias("V"), "id"))
    assert not same(rows, rows.withColumn("v", F.when(F.col("id") == 5, F.col("v") * (1 + 2.0**-52)).otherwise(F.col("v"))))
    assert not same(rows.filter("id < 5"), rows.filter("id < 4").unionByName(rows.filter("id = 3")))
    a, b = spark.createDataFrame([(1, None)], "a int, b int"), spark.createDataFrame([(None, 1)], "a int, b int")
    assert not same(a, b) and not same(a, a.withColumn("a", F.col("a").cast("long"))) and same(a.limit(0), b.limit(0))


def test_all_references_at_once(spark):
    tables = {
        "f": spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, None, 9), (7, "z", None)], "d_id int, code string, other long"), "d": spark.createDataFrame([(1, "x"), (2, "1"), (3, "2")], "id long, code string"),
    }
    got = {(r.many, r.column_name, r.one, r.key): (r["values"], r.resolved, r.ratio, r.key_ratio) for r in joins.references(tables, {"f": ["d_id", "code", "other"], "d": ["id", "code"]}).collect()}
    assert len(got) == 20
    assert got["f", "d_id", "d", "id"] == (3, 2, 0.666667, 1.0) and got["d", "id", "f", "d_id"] == (3, 2, 0.666667, 0.75)
    assert got["f", "code", "d", "code"] == (3, 1, 0.333333, 1.0) and got["f", "d_id", "d", "code"] == (3, 0, 0.0, 1.0) and got["f", "other", "f", "d_id"] == (3, 2, 0.666667, 0.75)
    found = joins.proven(joins.references(tables, {"f": ["d_id"], "d": ["id"]}))
    assert [(e.many, e.column, e.one, e.key) for e in found] == [("f", "d_id", "d", "id")]
    plan = joins.references(tables, {"f": ["d_id"], "d": ["id"]})
    assert all(v is not None for v in plan.first())


def test_pages_cover_each_row_once(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(k, r.choice([None, 1, 2, 2, 2]), r.choice(["a", "b", None])) for k in range(103)], "k int, x int, s string")
    for order in ([("x", "desc")], [("x", "asc"), ("s", "desc")], []):
        seen, after = [], None
        while page := semantic.page_after(rows, order, ["k"], after, 10).collect():
            seen += page
            after = page[-1].asDict()
        key = lambda row, o=order: [*(z for c, way in o for z in (row[c] is None, row[c] if row[c] is None or way == "asc" else (-row[c] if isinstance(row[c], int) else [-ord(x) for x in row[c]]))), row.k]
        assert len(seen) == 103 and seen == sorted(rows.collect(), key=lambda row: [(x is not None, x) if x is not None else (False, 0) for x in key(row)])


def test_sketches_roll_up_within_their_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 3).alias("kind"), (F.col("id") * 31 % 50_021).alias("user"), F.lit(1).alias("n"))
    mart = semantic.sketched(rows, ["day", "kind"], ["user"], ["n"])
    assert mart.count() == 30
    exact_ = {r.kind: r["u"] for r in rows.groupBy("kind").agg(F.count_distinct("user").alias("u")).collect()}
    for r in semantic.rolled(mart, ["kind"], ["n"]).collect():
        assert abs(r.distinct_user / exact_[r.kind] - 1) < 4 * semantic.sketch_error()
    assert semantic.rolled(mart, [], ["n"], {"kind": 1}).first()["n"] in (66_666, 66_667)


def test_places_in_an_order_come_from_ranges(spark):
    """Equal measures are told apart by name, null names and measures have their place, and more than one range is numbered."""
    rows = [(f"n{k:04d}", None if k % 97 == 0 else float(k % 3)) for k in range(3000)] + [(None, 1.0)]
    frame = spark.createDataFrame(rows, "name string, m double")
    ranked = semantic.numbered(frame.repartition(7), "k", F.desc_nulls_last("m"), F.asc_nulls_first("name"))
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or ""))
    assert [(r.name, r.m) for r in sorted(ranked.collect(), key=lambda r: r.k)] == order and sorted(r.k for r in ranked.select("k").collect()) == list(range(1, 3002))
    assert semantic.numbered(frame.limit(0), "k", F.col("name")).count() == 0
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_range" in plan
    shown = semantic.anonymous(frame.union(frame), "name", "m", "Item")
    assert shown.count() == 6002 and shown.select("name").distinct().count() == 3001


def test_the_query_of_multisets_needs_no_fixed_key(spark, tmp_path):
    rows = spark.createDataFrame([(100, 1, 0.0), (100, 2, 9.5), (300, 4, 7.25), (300, 4, 7.25)], "l_orderkey long, l_linenumber int, l_extendedprice double")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert scale.multiset(spark, str(tmp_path)).first().asDict() == {"rows": 4, "reordered": True, "one_cell": False, "a_row_twice": False}


def test_a_number_is_no_code(spark):
    rows = spark.range(1_000_000, 1_000_010).select("id", F.col("id").cast("string").alias("text"), (F.col("id") / 7).alias("part"))
    assert rows.agg(*[columns.shape_of(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]).first().asDict() == {"id": None, "text": "fixed_length_alnum", "part": None}
