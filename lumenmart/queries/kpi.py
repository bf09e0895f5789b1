"""Business metrics over the star schema."""

from dataclasses import replace

from pyspark.sql import functions as F

from lumenmart.operators import kpi
from lumenmart.registry import register, table

AS_OF = "2001-12-31"


def star(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .withColumn("born", F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") % 20000).cast("int")))
    )


STAR = """(SELECT *, DATE '1930-01-01' + (c_custkey % 20000)::INTEGER AS born FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


@register(
    "kpi_monthly_revenue_by_segment",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_mktsegment, round(sum(o_totalprice), 2) AS sum_o_totalprice
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2
    ORDER BY sum(o_totalprice) DESC, 1, 2 LIMIT 10""",
)
def monthly_revenue_by_segment(spark, sf_dir):
    asked = kpi.read("sum(o_totalprice)", "Month(o_orderdate), c_mktsegment", "top 10 for finished orders")
    return kpi.answer(star(spark, sf_dir), replace(asked, filters=("o_orderstatus = 'F'",)))


def metric(name, sql, *args, **changes):
    """Registers a metric that is read from its wording."""
    options = {k: changes.pop(k) for k in ("as_of", "time_column") if k in changes}

    @register(name, sql)
    def run(spark, sf_dir):
        return kpi.answer(star(spark, sf_dir), replace(kpi.read(*args, **options), **changes))

    return run


metric(
    "kpi_all_aggregates",
    f"""SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice, round(avg(o_totalprice), 2) AS avg_o_totalprice, count(*) AS count_rows,
    count(DISTINCT o_custkey) AS count_distinct_o_custkey, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, round(median(o_totalprice), 2) AS median_o_totalprice,
    round(stddev_samp(o_totalprice), 2) AS stddev_o_totalprice, round(var_samp(o_totalprice), 2) AS variance_o_totalprice FROM {STAR} GROUP BY 1""",
    "sum(o_totalprice), mean(o_totalprice), count(*), count(distinct o_custkey), min(o_totalprice), max(o_totalprice), median(o_totalprice), std(o_totalprice), var(o_totalprice)",
    "o_orderstatus",
)
metric("kpi_global_total", f"SELECT round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {STAR}", "sum(o_totalprice)")
metric("kpi_count_of_column_skips_nulls", f"SELECT n_name, count(nullif(o_orderstatus, 'P')) AS count_nullif_o_orderstatus_p FROM {STAR} GROUP BY 1", "count(nullif(o_orderstatus, 'P'))", "n_name")
metric("kpi_count_where", f"SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS count_rows FROM {STAR} GROUP BY 1", "count(o_orderstatus = 'F')", "c_mktsegment")
metric(
    "kpi_ratio_of_aggregates", f"SELECT c_mktsegment, round(sum(o_totalprice) / nullif(count(DISTINCT o_custkey), 0), 4) AS ratio FROM {STAR} GROUP BY 1", "sum(o_totalprice) / count(distinct o_custkey)",
    "c_mktsegment",
)
metric(
    "kpi_filtered_numerator", f"SELECT n_name, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / nullif(sum(o_totalprice), 0), 4) AS ratio FROM {STAR} GROUP BY 1",
    "sum(o_totalprice) / sum(o_totalprice)", "n_name", measures=(kpi.Measure("sum", "o_totalprice", "o_orderstatus = 'F'"), kpi.Measure("sum", "o_totalprice")),
)
metric("kpi_having_at_least", f"SELECT n_name, count(*) AS count_rows FROM {STAR} GROUP BY 1 HAVING count(*) >= 40", "count(*)", "n_name", "nations with at least 40 orders")
metric("kpi_having_more_than", f"SELECT n_name, count(*) AS count_rows FROM {STAR} GROUP BY 1 HAVING count(*) > 40", "count(*)", "n_name", "nations with more than 40 orders")
metric(
    "kpi_largest_is_top_20", f"SELECT c_custkey, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {STAR} GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20", "sum(o_totalprice)", "c_custkey",
    "who has the highest revenue",
)
metric(
    "kpi_prose_grain", f"SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, c_mktsegment, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM {STAR} GROUP BY 1, 2", "average(o_totalprice)",
    "c_mktsegment", "quarterly average order value", time_column="o_orderdate",
)
for _unit in kpi.UNITS:
    metric(f"kpi_by_{_unit}", f"SELECT CAST(date_trunc('{_unit}', o_orderdate) AS DATE) AS {_unit}, count(*) AS count_rows FROM {STAR} GROUP BY 1", "count(*)", f"{_unit.title()}(o_orderdate)")
metric("kpi_by_band", f"SELECT (floor(o_totalprice / 50000) * 50000)::BIGINT AS o_totalprice_band, count(*) AS count_rows FROM {STAR} GROUP BY 1", "count(*)", "Band(o_totalprice, 50000)")
metric("kpi_by_age", f"SELECT year(DATE '{AS_OF}') - year(born) AS age, count(*) AS count_rows FROM {STAR} GROUP BY 1", "count(*)", "Age(born)", as_of=AS_OF)
metric(
    "kpi_by_age_band",
    f"""SELECT CASE WHEN a < 18 THEN '<18' WHEN a < 35 THEN '18-34' WHEN a < 50 THEN '35-49' WHEN a < 65 THEN '50-64' WHEN a IS NOT NULL THEN '65+' END AS age_band,
    c_mktsegment, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM (SELECT *, year(DATE '{AS_OF}') - year(born) AS a FROM {STAR}) GROUP BY 1, 2""",
    "sum(o_totalprice)", "AgeBand(born), c_mktsegment", as_of=AS_OF,
)
metric("kpi_by_days_since", f"SELECT date_diff('day', born, DATE '{AS_OF}') AS days_since, count(*) AS count_rows FROM {STAR} GROUP BY 1", "count(*)", "DaysSince(born)", as_of=AS_OF)
metric(
    "kpi_share_of_total", f"SELECT c_mktsegment, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER () * 100, 2) AS share FROM {STAR} GROUP BY 1", "percentage of total sum(o_totalprice)", "c_mktsegment",
)
metric(
    "kpi_share_within_group",
    f"SELECT c_mktsegment, o_orderpriority, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY c_mktsegment) * 100, 2) AS share FROM {STAR} GROUP BY 1, 2",
    "percentage of group sum(o_totalprice)", "c_mktsegment, o_orderpriority",
)
metric(
    "kpi_share_within_period",
    f"""SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS year, c_mktsegment, round(count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('year', o_orderdate)) * 100, 2) AS share
    FROM {STAR} GROUP BY date_trunc('year', o_orderdate), c_mktsegment""",
    "share of total count(*)", "Year(o_orderdate), c_mktsegment", share="period",
)
metric(
    "kpi_share_each_customer_once",
    f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderpriority) AS nth FROM {STAR})
    SELECT o_orderpriority, round(count(DISTINCT o_custkey) / sum(count(DISTINCT o_custkey)) OVER () * 100, 2) AS share FROM last WHERE nth = 1 GROUP BY 1""",
    "percentage of total sum(distinct o_custkey)", "o_orderpriority", entity="o_custkey", latest=("o_orderdate", "o_orderkey"),
)
metric(
    "kpi_running_total",
    f"""SELECT month, c_mktsegment, round(sum(m) OVER (PARTITION BY c_mktsegment ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS running_total
    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_mktsegment, sum(o_totalprice) AS m FROM {STAR} GROUP BY 1, 2)""",
    "running total of sum(o_totalprice)", "Month(o_orderdate), c_mktsegment",
)
metric(
    "kpi_moving_average",
    f"""SELECT month, c_mktsegment, round(avg(m) OVER (PARTITION BY c_mktsegment ORDER BY month ROWS 2 PRECEDING), 2) AS moving_average
    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_mktsegment, sum(o_totalprice) AS m FROM {STAR} GROUP BY 1, 2)""",
    "3-month moving average of sum(o_totalprice)", "Month(o_orderdate), c_mktsegment",
)
metric(
    "kpi_rank_within",
    f"""SELECT c_mktsegment, n_name, round(m, 2) AS sum_o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY m DESC, c_mktsegment, n_name) AS rank
    FROM (SELECT c_mktsegment, n_name, sum(o_totalprice) AS m FROM {STAR} GROUP BY 1, 2)""",
    "rank of sum(o_totalprice) within c_mktsegment", "c_mktsegment, n_name",
)


@register(
    "kpi_cap_categories",
    f"""WITH t AS (SELECT n_name, sum(o_totalprice) AS v FROM {STAR} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, n_name) AS k FROM t)
    SELECT CASE WHEN k <= 12 THEN n_name ELSE 'Other' END AS n_name, round(sum(v), 2) AS o_totalprice FROM r GROUP BY 1""",
)
def cap_categories(spark, sf_dir):
    return kpi.cap_categories(star(spark, sf_dir), "n_name", "o_totalprice", 12)


MART = f"(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_mktsegment, o_orderstatus, round(sum(o_totalprice), 2) AS revenue FROM {STAR} GROUP BY 1, 2, 3)"


def mart(spark, sf_dir):
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    return star(spark, sf_dir).groupBy(month, "c_mktsegment", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("semantic_roll_up", f"SELECT c_mktsegment, round(sum(revenue), 2) AS revenue FROM {MART} WHERE o_orderstatus IN ('F', 'O') AND month BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1")
def roll_up(spark, sf_dir):
    import datetime

    chosen = {"o_orderstatus": ["F", "O"], "month": {"from": datetime.date(1996, 1, 1), "to": datetime.date(1998, 12, 31)}, "c_mktsegment": []}
    return kpi.roll_up(mart(spark, sf_dir), "revenue", ["c_mktsegment"], True, chosen)
