"""Profiles, drift, anomalies and samples; each profile is one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.operators import sampling, selection, temporal
from lumenmart.plans.names import identifier

#: Bounds of whole-number types, smallest first.
WHOLE = (("tinyint", -(1 << 7), (1 << 7) - 1), ("smallint", -(1 << 15), (1 << 15) - 1), ("int", -(1 << 31), (1 << 31) - 1))


def leaves(schema: T.StructType, before: str = "", depth: int = 8) -> list[tuple[str, T.DataType]]:
    """Dotted paths of all leaves; an array's is marked by [] and is not opened."""
    out = []
    for f in schema.fields:
        name = f"{before}{f.name}"
        if isinstance(f.dataType, T.StructType) and depth:
            out += leaves(f.dataType, f"{name}.", depth - 1)
        else:
            out.append((f"{name}[]" if isinstance(f.dataType, T.ArrayType) else name, f.dataType))
    return out


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column_name, rows, nulls, distinct_values, least, greatest (as text) of each column: one pass."""
    columns = columns or [n for n, _ in leaves(df.schema) if not n.endswith("[]")]
    at = lambda n: F.col(f"`{n}`" if n in df.columns else n)  # noqa: E731  a name with a dot, or the path of a leaf
    count = F.count_distinct if exact else F.approx_count_distinct  # exact: each row is read once more for each column; not for wide tables
    stats = [
        F.struct(
            F.lit(n).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count_if(at(n).isNull()).alias("nulls"), count(at(n)).alias("distinct_values"),
            F.min(at(n)).cast("string").alias("least"), F.max(at(n)).cast("string").alias("greatest"),
        ) for n in columns
    ]
    return df.agg(F.array(*stats).alias("p")).select(F.inline("p"))


def rates(profiled: DataFrame) -> DataFrame:
    """Adds fill_rate, unique_ratio, categorical and the null audit to a profile."""
    null_rate = F.try_divide("nulls", "rows")
    return profiled.select(
        "column_name", F.round(1 - null_rate, 6).alias("fill_rate"), F.round(F.try_divide(F.col("distinct_values"), F.col("rows") - F.col("nulls")), 6).alias("unique_ratio"),
        (F.col("distinct_values") <= 50).alias("categorical"), F.when(null_rate > 0.5, "excluded").when(null_rate > 0.05, "warn").otherwise("ok").alias("audit"),
    )


def downcast(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, kind: the smallest whole-number type that holds the values."""
    def advice(n):
        fits = F.lit("bigint")
        for kind, low, high in WHOLE[::-1]:
            fits = F.when((F.min(n) >= low) & (F.max(n) <= high), kind).otherwise(fits)
        return F.struct(F.lit(n).alias("column_name"), fits.alias("kind"))

    return df.agg(F.array(*[advice(n) for n in columns]).alias("a")).select(F.inline("a"))


def schema_drift(before: T.StructType, after: T.StructType) -> list[tuple[str, str]]:
    """(column, added | removed | old -> new type)."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (before, after))
    return sorted([(n, "added") for n in b.keys() - a.keys()] + [(n, "removed") for n in a.keys() - b.keys()] + [(n, f"{a[n]} -> {b[n]}") for n in a.keys() & b.keys() if a[n] != b[n]])


def volume_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two profiles the columns whose rows moved by half, or whose null rate doubled and passed 5 %."""
    a = before.select("column_name", F.col("rows").alias("rows_before"), F.try_divide("nulls", "rows").alias("null_before"))
    b = after.select("column_name", F.col("rows").alias("rows_after"), F.try_divide("nulls", "rows").alias("null_after"))
    both = a.join(b, "column_name")
    rows = F.abs(F.col("rows_after") - F.col("rows_before")) > 0.5 * F.col("rows_before")
    nulls = (F.col("null_after") > 2 * F.col("null_before")) & (F.col("null_after") > 0.05)
    return both.select("column_name", rows.alias("volume_drift"), nulls.alias("null_drift"))


def anomalies(points: DataFrame, series: str, order: str, value: str, limit: float = 3.0, least: int = 4) -> DataFrame:
    """Of each series (null is one) the last point, its median and median absolute deviation (MAD) before, and whether it lies over `limit` MADs off.

    Points are results, a few for each period: a series is one array, and nothing is joined."""
    groups = points.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("p"))
    past = F.filter(F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: x["v"]), lambda v: v.isNotNull())

    def median(values):
        ordered, half = F.array_sort(values), F.floor(F.size(values) / 2).cast("int")
        return F.when(F.size(values) % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)

    rows = groups.filter("size(p) > 1").select(series, F.element_at("p", -1)["v"].alias("last"), past.alias("past")).withColumn("mid", median(F.col("past")))
    rows = rows.withColumn("mad", median(F.transform("past", lambda v: F.abs(v - F.col("mid")))))
    off = F.abs(F.col("last") - F.col("mid"))
    flagged = (F.size("past") >= least) & F.when(F.col("mad") == 0, off > 0).otherwise(off > limit * F.col("mad"))
    return rows.select(series, F.round("last", 2).alias("last"), F.round("mid", 2).alias("median"), F.round("mad", 2).alias("mad"), flagged.alias("flagged"))


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, least: int = 1, seed: int = 42) -> DataFrame:
    """Of each stratum round(n * fraction) rows, `least` at least; no stratum is sorted whole (`sampling.quotas`)."""
    return sampling.quotas(df, [stratum], key, fraction, least, seed)


def hashed_sample(df: DataFrame, key: str, per_mille: int, seed: int = 42) -> DataFrame:
    """About per_mille of a thousand rows, chosen by a hash of the key."""
    return df.filter(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") % 1000 < per_mille)


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Half the summed difference of two distributions of a column: one row."""
    share = lambda df, n: df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(column, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(n))
    both = share(a, "p").join(share(b, "q"), column, "full")
    return both.agg(F.round(F.sum(F.abs(F.coalesce("p", F.lit(0)) - F.coalesce("q", F.lit(0)))) / 2, 6).alias("distance"))


def explained(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """One row, `share`: how much of the measure's variance the groups of a dimension explain; rows that lack either don't count.

    Groups are counts, means and centred sums of squares, which Spark merges pairwise; no square of a value is summed, so a large mean costs no digits."""
    y = F.col(measure).cast("double")
    some = df.filter(F.col(dimension).isNotNull() & y.isNotNull())
    groups = some.groupBy(dimension).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("within"))
    # One row: means are centred on one of them before they are weighed.
    whole = groups.agg(F.max("mean").alias("origin"))
    moved = groups.join(F.broadcast(whole)).select("n", "within", (F.col("mean") - F.col("origin")).alias("d"))
    total = moved.agg(F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ss"))
    between = F.greatest(F.lit(0.0), F.col("ss") - F.try_divide(F.col("s") * F.col("s"), "n"))
    return total.select(F.try_divide(between, between + F.col("within")).alias("share"))


def eta_squared(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """`explained`, to 4 places."""
    return explained(df, dimension, measure).select(F.round("share", 4).alias("eta_squared"))


def concentration(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """1 - normalised entropy of the measure's totals; and the largest total's share."""
    totals = df.groupBy(dimension).agg(F.sum(measure).alias("t")).filter("t > 0")
    p = totals.select((F.col("t") / F.sum("t").over(Window.partitionBy())).alias("p"))
    return p.agg(F.round(1 + F.try_divide(F.sum(F.col("p") * F.ln("p")), F.ln(F.count(F.lit(1)))), 4).alias("concentration"), F.round(F.max("p"), 4).alias("top_share"))


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99), by: tuple[str, ...] = (), approximate: bool = False) -> DataFrame:
    """by, column_name, mean, std and a column for each quantile. Exact ones are selected (`selection`), so no task holds a group; approximate: one aggregation."""
    named = {q: f"p{round(q * 100):02d}" for q in at}
    quick = lambda c: [F.round(F.percentile_approx(c, F.lit(q), F.lit(10_000)).cast("double"), 4).alias(n) for q, n in named.items()] if approximate else []
    each = [F.struct(F.lit(c).alias("column_name"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), *quick(c)) for c in columns]
    base = df.groupBy(*by).agg(F.array(*each).alias("q")).select(*by, F.inline("q"))
    if approximate:
        return base
    keys = [*by, "column_name"]
    found = selection.of_columns(df, columns, at, by).groupBy(*keys).agg(*[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 4).alias(n) for q, n in named.items()])
    return temporal.left_by(base, found, keys)


def footer_profile(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """column_name, rows, filled, least, greatest of numeric columns from the footers of Parquet files, no data read: a session of its own pushes the aggregates down."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.sources.useV1SourceList", "")
    apart.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    stats = [x for k, c in enumerate(columns) for x in (F.count(c).alias(f"c{k}"), F.min(c).alias(f"a{k}"), F.max(c).alias(f"z{k}"))]
    row = apart.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *stats)
    each = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("rows"), F.col(f"c{k}").alias("filled"), F.col(f"a{k}").cast("double").alias("least"), F.col(f"z{k}").cast("double").alias("greatest")) for k, c in enumerate(columns)]
    return row.select(F.inline(F.array(*each)))


def table_profile(spark: SparkSession, name: str) -> DataFrame:
    """column_name, nulls and distinct_values that the catalog holds for a table, which it counts once and keeps."""
    table = ".".join(f"`{identifier(p)}`" for p in name.split("."))
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    out = []
    for f in spark.table(name).schema.fields:  # a few facts a column
        held = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} `{f.name}`").collect()}
        out.append((f.name, int(held["num_nulls"]), int(held["distinct_count"])))
    return spark.createDataFrame(out, "column_name string, nulls long, distinct_values long")
