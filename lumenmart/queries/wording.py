"""What questions say beyond the metric: values, ages, quoted text, grains, bounds, second measures, and what a share is of."""

from pyspark.sql import functions as F

from lumenmart.operators import kpi
from lumenmart.plans import names
from lumenmart.queries.kpi import AS_OF, STAR, star
from lumenmart.registry import register, table

PLACES = f"(SELECT *, upper(r_name[1]) || lower(r_name[2:]) AS SalesRegion FROM {STAR} LEFT JOIN region ON n_regionkey = r_regionkey)"
LABELS = {"order value": "o_totalprice", "Total Price": "o_totalprice", "account balance": "c_acctbal", "Market Segment": "c_mktsegment", "Nation": "n_name", "Order Date": "o_orderdate"}


def places(spark, sf_dir):
    return star(spark, sf_dir).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").withColumn("SalesRegion", F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 99))))


def asked(name, sql, *args, **options):
    """Registers what kpi.read makes of a wording; rows come by grain where no top is asked for."""

    @register(name, sql)
    def run(spark, sf_dir):
        return kpi.answer(places(spark, sf_dir), kpi.read(*args, **options), by_grain=True)

    return run


BY_REGION = "SELECT SalesRegion, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {} WHERE {} GROUP BY 1"
asked("wording_value", BY_REGION.format(PLACES, "SalesRegion = 'Europe'"), "sum(o_totalprice)", "SalesRegion", "revenue for europe SalesRegion")
asked("wording_value_by_initials", BY_REGION.format(PLACES, "SalesRegion = 'Asia'"), "sum(o_totalprice)", "SalesRegion", "revenue in asia SR")
asked("wording_quoted_value", BY_REGION.format(PLACES, "SalesRegion = 'Middle east'").replace("Middle east", "America"), "sum(o_totalprice)", "SalesRegion", "revenue where salesregion is 'America'")
asked("wording_compared_cut", BY_REGION.format(PLACES, "o_orderstatus = 'F'"), "sum(o_totalprice)", "SalesRegion, o_orderstatus = 'F'")
asked("wording_compared_numbers", BY_REGION.format(PLACES, "o_totalprice >= 250000 AND c_nationkey != 3"), "sum(o_totalprice)", "SalesRegion, o_totalprice >= 250000, c_nationkey != 3")
AGE = f"(year(DATE '{AS_OF}') - year(born))"
asked("wording_age_over", f"SELECT {AGE} AS age, count(*) AS count_rows FROM {PLACES} WHERE {AGE} > 70 GROUP BY 1", "count(*)", "Age(born)", "orders of customers above 70 years", as_of=AS_OF)
BY_NATION = f"SELECT n_name, count(*) AS count_rows FROM {PLACES} GROUP BY 1 HAVING count(*)"
asked("wording_having_any_noun", BY_NATION + " >= 550", "count(*)", "n_name", "nations with at least 550 patients")
asked("wording_having_over", BY_NATION + " > 560", "count(*)", "n_name", "nations having over 560 encounters")
MONTHLY = f"SELECT CAST(date_trunc('{{0}}', o_orderdate) AS DATE) AS {{0}}, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {PLACES} GROUP BY 1"
for _said, _unit in (("revenue per month", "month"), ("revenue every week", "week"), ("revenue by quarter", "quarter"), ("year over year revenue", "year"), ("daily revenue", "day")):
    asked(f"wording_grain_{_unit}", MONTHLY.format(_unit), "sum(o_totalprice)", "", _said, time_column="o_orderdate")
asked(
    "wording_second_average", f"SELECT c_mktsegment, count(*) AS count_rows, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM {PLACES} GROUP BY 1", "count(*)", "c_mktsegment",
    "How many orders, and the average order value for each segment?", labels=LABELS,
)
asked(
    "wording_second_total_top", f"SELECT n_name, count(DISTINCT o_custkey) AS count_distinct_o_custkey, round(sum(c_acctbal), 2) AS sum_c_acctbal FROM {PLACES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "count(distinct o_custkey)", "n_name", "top 5 nations by customers and the total account balance", labels=LABELS,
)
asked(
    "wording_second_count", f"SELECT c_mktsegment, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(*) AS count_rows FROM {PLACES} GROUP BY 1", "sum(o_totalprice)", "c_mktsegment",
    "revenue and the number of times they were placed",
)
asked(
    "wording_share_for_period",
    f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, SalesRegion, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY date_trunc('month', o_orderdate)) * 100, 2) AS share FROM {PLACES} GROUP BY date_trunc('month', o_orderdate), SalesRegion",
    "percentage of sum(o_totalprice) / sum(o_totalprice) for month", "Month(o_orderdate), SalesRegion",
)
SHARE_IN = f"SELECT c_mktsegment, o_orderstatus, round(count(*) / sum(count(*)) OVER ({{}}) * 100, 2) AS share FROM {PLACES} GROUP BY 1, 2"
asked(
    "wording_share_for_misspelt_group", SHARE_IN.format("PARTITION BY c_mktsegment"), "percentage of count(*) / count(*) for c_mktsegmnt", "c_mktsegment, o_orderstatus",
)
asked(
    "wording_share_grand_total", SHARE_IN.format(""), "percentage of count(*) / count(*) for c_mktsegment", "c_mktsegment, o_orderstatus", denominator="grand_total",
)
asked(
    "wording_filtered_share_of_all",
    f"SELECT count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS count_distinct_o_custkey, round(count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') / count(DISTINCT o_custkey) * 100, 2) AS share FROM {PLACES}",
    "percentage of total count(distinct o_custkey)", "o_orderstatus = 'F'",
)
asked(
    "wording_running_total_top",
    f"SELECT month, round(r, 2) AS running_total FROM (SELECT month, sum(m) OVER (ORDER BY month) AS r FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS m FROM {PLACES} GROUP BY 1)) ORDER BY r DESC, 1 LIMIT 3",
    "running total of sum(o_totalprice)", "Month(o_orderdate)", "top 3",
)
asked(
    "wording_ratio_having_top",
    f"SELECT n_name, round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS ratio FROM {PLACES} GROUP BY 1 HAVING sum(o_totalprice) > 140000000 ORDER BY sum(o_totalprice) / count(DISTINCT o_custkey) DESC, 1 LIMIT 4",
    "sum(o_totalprice) / count(distinct o_custkey)", "n_name", "top 4 nations with more than 140000000 revenue",
)


@register("wording_approximate_median", f"SELECT c_mktsegment, true AS near FROM {STAR} GROUP BY 1")
def approximate_median(spark, sf_dir):
    """The approximate median against the exact one: within a hundredth of the range of ranks."""
    both = kpi.answer(star(spark, sf_dir), kpi.Kpi((kpi.Measure("approx_median", "o_totalprice"), kpi.Measure("median", "o_totalprice")), (kpi.Dim("c_mktsegment"),)))
    return both.select("c_mktsegment", (F.abs(F.col("approx_median_o_totalprice") / F.col("median_o_totalprice") - 1) < 0.01).alias("near"))


@register(
    "names_resolve",
    """SELECT * FROM (VALUES ('market segment', 'c_mktsegment'), ('MarketSegment', 'c_mktsegment'), ('Nation of the customer', 'n_name'), ('total price of order', 'o_totalprice'), ('weather', NULL)) AS t(term, found)""",
)
def names_resolve(spark, sf_dir):
    """Terms found exactly, by their letters, by the words of a label, and not at all; the frame has the columns found."""
    columns = star(spark, sf_dir).columns
    found = [(t, names.resolve(t, {k: v for k, v in LABELS.items() if v in columns})) for t in ("market segment", "MarketSegment", "Nation of the customer", "total price of order", "weather")]
    return spark.createDataFrame(found, "term string, found string")


@register(
    "names_formula", "SELECT o_orderkey, round(coalesce(o_totalprice, 0) - greatest(o_custkey, 10), 2) AS net, month(o_orderdate) AS m FROM orders WHERE length(o_orderpriority) > 0",
)
def names_formula(spark, sf_dir):
    """Formulas over known columns and functions; text that could change data is refused before it reaches Spark."""
    orders = table(spark, sf_dir, "orders")
    for text in ("o_totalprice; drop table x", "o_totalprice -- all", "shell(o_custkey)", "o_nothing + 1"):
        try:
            names.formula(text, orders.columns)
        except names.Unsafe:
            continue
        raise AssertionError(f"{text!r} was let through")
    net = names.formula("round(coalesce(o_totalprice, 0) - greatest(o_custkey, 10), 2)", orders.columns)
    return orders.filter(F.length("o_orderpriority") > 0).select("o_orderkey", net.alias("net"), names.formula("month(o_orderdate)", orders.columns).alias("m"))
