"""Dates, bands, masks, units, codes and JSON."""

from pyspark.sql import functions as F

from lumenmart.functions import columns as c
from lumenmart.registry import register, table

D = "DATE '2001-12-31'"
BORN = "(DATE '1930-01-01' + (c_custkey % 20000)::INTEGER)"


@register(
    "scalar_dates",
    f"""SELECT c_custkey, year({D}) - year({BORN}) AS age_calendar,
    (year({D}) - year({BORN}) - CASE WHEN strftime({BORN}, '%m%d') > '1231' THEN 1 ELSE 0 END)::INTEGER AS age_completed, date_diff('day', {BORN}, {D})::INTEGER AS days_since FROM customer""",
)
def dates(spark, sf_dir):
    born, as_of = F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") % 20000).cast("int")), F.lit("2001-12-31").cast("date")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", c.age_calendar(born, as_of).alias("age_calendar"), c.age_completed(born, as_of).alias("age_completed"), c.days_since(born, as_of).alias("days_since"),
    )


@register(
    "scalar_durations",
    """SELECT l_orderkey, l_linenumber, l_partkey, (epoch(l_shipdate) - epoch(o_orderdate))::BIGINT // 3600 >= 24 AS day_or_more,
    date_diff('month', o_orderdate, l_shipdate)::BIGINT AS months_crossed FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""",
)
def durations(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate >= o_orderdate")
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", (c.elapsed("HOUR", F.col("o_orderdate"), F.col("l_shipdate")) >= 24).alias("day_or_more"),
        c.boundaries("MONTH", F.col("o_orderdate"), F.col("l_shipdate")).alias("months_crossed"),
    )


@register(
    "scalar_temporal_ladder",
    "SELECT o_orderkey, " + ", ".join(f"date_trunc('{u}', o_orderdate)::DATE AS d_{u}" for u in ("year", "quarter", "month", "day")) + " FROM orders",
)
def ladder(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[x.alias(n) for n, x in c.temporal_ladder(F.col("o_orderdate"), "d").items()])


@register(
    "scalar_bands_and_amounts",
    """SELECT o_orderkey, (floor(o_totalprice / 1000) * 1000)::BIGINT AS band, (floor(o_totalprice / 1000) * 1000)::BIGINT || '-' || ((floor(o_totalprice / 1000) * 1000)::BIGINT + 999) AS label,
    round(coalesce(nullif(o_totalprice, 0), 0) - coalesce(CASE WHEN o_orderstatus = 'F' THEN 10 END, 0), 2) AS net,
    round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 THEN 0.45359237 END, 4) AS kilograms FROM orders""",
)
def bands_and_amounts(spark, sf_dir):
    price = F.col("o_totalprice")
    unit = F.when(F.col("o_orderkey") % 3 == 0, " kg").when(F.col("o_orderkey") % 3 == 1, "lb ").otherwise("box")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", c.band(price, 1000).alias("band"), c.band_label(price, 1000).alias("label"), F.round(c.net(price, F.when(F.col("o_orderstatus") == "F", 10)), 2).alias("net"),
        F.round(c.to_unit(price, unit, {"KG": 1.0, "LB": 0.45359237}), 4).alias("kilograms"),
    )


@register(
    "scalar_masks",
    """SELECT c_custkey, sha256(c_name) AS masked, sha256(coalesce(nullif(c_mktsegment, 'BUILDING'), '') || 'salt') AS salted, CASE WHEN c_name IS NOT NULL THEN '<redacted-pii>' END AS redacted,
    CASE WHEN c_custkey % 120 > 89 THEN '90+' ELSE (c_custkey % 120)::VARCHAR END AS age, sha256(length(c_custkey::VARCHAR) || ':' || c_custkey || '|' || coalesce(length(nullif(c_mktsegment, 'BUILDING')) || ':' || nullif(c_mktsegment, 'BUILDING'), '-')) AS surrogate FROM customer""",
)
def masks(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", c.masked(F.col("c_name")).alias("masked"), c.salted(F.expr("nullif(c_mktsegment, 'BUILDING')"), "salt").alias("salted"), c.redacted(F.col("c_name")).alias("redacted"),
        c.old_age_together(F.col("c_custkey") % 120).alias("age"), c.surrogate_key(F.col("c_custkey"), F.expr("nullif(c_mktsegment, 'BUILDING')")).alias("surrogate"),
    )


@register(
    "scalar_shapes",
    r"""SELECT round(avg(regexp_matches(o_totalprice::DECIMAL(18,2)::VARCHAR, '^-?\d+\.\d{2}$')::INTEGER), 4) AS currency, round(avg(regexp_matches(o_orderdate::DATE::VARCHAR, '^\d{4}-\d{2}-\d{2}$')::INTEGER), 4) AS iso_date,
    round(avg(regexp_matches(o_orderpriority, '^[A-Za-z]+[-_]?\d+$')::INTEGER), 4) AS code FROM orders""",
)
def shapes(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.round(c.shape_share(F.col("o_totalprice").cast("decimal(18,2)"), "currency_2dp"), 4).alias("currency"), F.round(c.shape_share(F.col("o_orderdate").cast("date"), "iso_date"), 4).alias("iso_date"),
        F.round(c.shape_share(F.col("o_orderpriority"), "prefixed_numeric_code"), 4).alias("code"),
    )


@register("scalar_json_leaf", "SELECT event_type, round(avg((props->>'$.k')::DOUBLE), 4) AS mean_k, count(props->>'$.missing') AS missing FROM events GROUP BY 1")
def json_leaf(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.round(F.avg(c.json_leaf(F.col("props"), "$.k").cast("double")), 4).alias("mean_k"), F.count(c.json_leaf(F.col("props"), "$.missing")).alias("missing"))


@register("scalar_array_elements", "SELECT label, round(avg(e), 4) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY 1")
def array_elements(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("e"))
    return each.groupBy("label").agg(F.round(F.avg("e"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@register(
    "scalar_lenient_casts",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN ts::DATE::VARCHAR ELSE 'n/a' END AS DATE) AS day, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS BIGINT) AS number FROM events",
)
def lenient_casts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", c.lenient_date(F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("date").cast("string")).otherwise("n/a")).alias("day"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")).try_cast("bigint").alias("number"),
    )
