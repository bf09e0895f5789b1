"""Whether tables and results can be relied on: certificates, contract tests, tiers, topologies, cadence and duplicates.

Each check is one aggregation and gives a row: check, ok, seen, allowed. What decides on names or on a schema's graph runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from statistics import median

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of keys that may lack a member; relative difference of totals; difference of shares from 100.
ORPHANS, TOTALS, SHARES = 0.02, 1e-6, 0.5
#: Null rates up to which data is silver, its keys are, and data is gold; uniqueness of keys for silver and for gold.
SILVER_NULLS, SILVER_KEY_NULLS, GOLD_NULLS, SILVER_UNIQUE, GOLD_UNIQUE = 0.01, 0.001, 0.0001, 0.999, 0.9999
#: Seconds between arrivals of a stream at most, arrivals of a cadence, and seconds of one upload.
STREAM_GAP, LEAST_ARRIVALS, UPLOAD_SPAN = 300.0, 3, 60.0
#: Different values that an accepted list may have; columns of one big table.
ACCEPTED, WIDE = 8, 50


def _row(df: DataFrame, name: str, seen, allowed, ok) -> DataFrame:
    return df.agg(seen.cast("double").alias("seen")).select(F.lit(name).alias("check"), ok(F.col("seen")).alias("ok"), "seen", F.lit(float(allowed)).alias("allowed"))


def together(checks: Iterable[DataFrame]) -> DataFrame:
    out = None
    for c in checks:
        out = c if out is None else out.unionByName(c)
    return out


# Certificates
def no_nulls(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _row(frame, "null_keys", F.coalesce(sum(F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)), 0, lambda x: x == 0)


def no_fan_out(frame: DataFrame, fact: DataFrame) -> DataFrame:
    """The joined frame has as many rows as its fact."""
    both = frame.select(F.lit(1).alias("n")).unionByName(fact.select(F.lit(-1).alias("n")))
    return _row(both, "no_fanout", F.coalesce(F.sum("n"), F.lit(0)), 0, lambda x: x == 0)


def resolved(fact: DataFrame, key: str, dimension: DataFrame, dimension_key: str, name: str, allowed: float = ORPHANS) -> DataFrame:
    """Share of the fact's rows whose key is there and has no member."""
    members = dimension.select(F.col(dimension_key).alias("_member")).dropna().distinct()
    counted = fact.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).join(members, F.col("_key") == F.col("_member"), "left")
    share = F.sum(F.when(F.col("_key").isNotNull() & F.col("_member").isNull(), F.col("_n")).otherwise(0)) / F.sum("_n")
    return _row(counted, f"referential[{name}]", F.coalesce(share, F.lit(0.0)), allowed, lambda x: x <= allowed)


def same_total(frame: DataFrame, fact: DataFrame, measure: str, tolerance: float = TOTALS) -> DataFrame:
    """Joining and cleaning lost nothing of the measure."""
    both = frame.agg(F.coalesce(F.sum(measure), F.lit(0)).alias("a")).join(F.broadcast(fact.agg(F.coalesce(F.sum(measure), F.lit(0)).alias("b"))))  # one row each
    off = F.abs(F.col("a") - F.col("b")) / F.greatest(F.lit(1.0), F.abs("b"))
    return _row(both, f"lossless[{measure}]", F.round(F.max(off), 9), tolerance, lambda x: x <= tolerance)


def typed(frame: DataFrame, column: str, kind: type) -> DataFrame:
    good = isinstance(frame.schema[column].dataType, kind)
    return frame.sparkSession.createDataFrame([(f"type[{column}]", good, float(not good), 0.0)], "check string, ok boolean, seen double, allowed double")


def part_of(gold: DataFrame, gold_measure: str, model: DataFrame, measure: str, name: str) -> DataFrame:
    """A result's total is at most the model's: it has a part of the same rows. seen: what it has too much."""
    both = gold.agg(F.coalesce(F.sum(gold_measure), F.lit(0)).alias("a")).join(F.broadcast(model.agg(F.coalesce(F.sum(measure), F.lit(0)).alias("b"))))
    return _row(both, f"gold_subset[{name}]", F.round(F.greatest(F.lit(0), F.max(F.col("a") - F.col("b"))), 4), TOTALS, lambda x: x <= TOTALS)


def certify(frame: DataFrame, fact: DataFrame, keys: Sequence[str], measures: Sequence[str], members: Mapping[str, tuple[DataFrame, str]], results: Mapping[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """All checks of a model: keys and measures without nulls, no rows made by joins, keys resolved, totals kept, results within the whole."""
    checks = [no_nulls(frame, [*keys, *measures]), no_fan_out(frame, fact)]
    checks += [resolved(fact, k, d, dk, k) for k, (d, dk) in members.items()] + [same_total(frame, fact, m) for m in measures]
    return together([*checks, *(part_of(g, gm, frame, m, n) for n, (g, gm, m) in (results or {}).items())])


def shares_add_up(view: DataFrame, share: str, within: Sequence[str] = ()) -> DataFrame:
    """Groups whose shares don't add up to 100; rounding may move them by half a point."""
    return view.groupBy(*within).agg(F.round(F.sum(share), 2).alias("total")).filter(F.abs(F.col("total") - 100) > SHARES)


def relationship_tests(edges: Iterable[tuple[DataFrame, str, DataFrame, str, str, bool]]) -> DataFrame:
    """For each proven edge (child, key, parent, key, name, proven): every key has its parent, and the parent's key is unique. Others have no tests."""
    checks = []
    for child, key, parent, parent_key, name, proven in edges:
        if proven:
            again = parent.dropna(subset=[parent_key]).groupBy(parent_key).agg(F.count(F.lit(1)).alias("n"))
            checks += [resolved(child, key, parent, parent_key, name, 0.0), _row(again, f"unique[{name}]", F.count_if(F.col("n") > 1), 0, lambda x: x == 0)]
    return together(checks)


# Assertions by parameters
def not_empty(df: DataFrame, name: str) -> DataFrame:
    return _row(df, f"not_empty[{name}]", F.count(F.lit(1)), 1, lambda x: x >= 1)


def row_delta(df: DataFrame, before: DataFrame, name: str, tolerance: float) -> DataFrame:
    """The number of rows against that which a table of counts (name, rows) holds for it: relative change."""
    stored = before.filter(F.col("name") == name).agg(F.max("rows").alias("before"))
    both = df.agg(F.count(F.lit(1)).alias("now")).join(F.broadcast(stored))
    return _row(both, f"row_count_delta[{name}]", F.round(F.max(F.abs(F.col("now") - F.col("before")) / F.col("before")), 6), tolerance, lambda x: x <= tolerance)


def plan_has_no(df: DataFrame, operators: Sequence[str], name: str) -> DataFrame:
    """The plan holds none of these operators; seen: how many of them it has."""
    plan = df._jdf.queryExecution().executedPlan().toString()  # no public way to a plan's operators
    held = sum(o in plan for o in operators)
    return df.sparkSession.createDataFrame([(f"plan[{name}]", held == 0, float(held), 0.0)], "check string, ok boolean, seen double, allowed double")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; nulls and blanks are no keys."""
    there = df
    for k in keys:
        there = there.filter(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    return there.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def suggested_tests(profiled: DataFrame, df: DataFrame) -> DataFrame:
    """From a profile: column_name, test and values. not_null where no null was seen, accepted_values where few values were."""
    rows = profiled.collect()  # a row for each column
    few = [r["column_name"] for r in rows if 0 < r["distinct_values"] <= ACCEPTED and dict(df.dtypes)[r["column_name"]] == "string"]
    tests = df.sparkSession.createDataFrame([(r["column_name"], "not_null", None) for r in rows if r["nulls"] == 0], "column_name string, test string, values string")
    for c in few:
        values = df.agg(F.concat_ws(",", F.sort_array(F.collect_set(c))).alias("values"))  # at most `ACCEPTED` of them
        tests = tests.unionByName(values.select(F.lit(c).alias("column_name"), F.lit("accepted_values").alias("test"), "values"))
    return tests


# Classes
def tier(profiles: Sequence[tuple[str, str, int, int, int]], business_ready: bool = False) -> str:
    """bronze, silver or gold of (column, type, rows, nulls, distinct values): by nulls, nulls and repeats in keys, and whether all is text still."""
    cells, nulls = sum(p[2] for p in profiles), sum(p[3] for p in profiles)
    keys = [p for p in profiles if p[0].lower().endswith(("id", "key", "code"))]
    rate = nulls / cells if cells else 1.0
    unique = max((d / n for _, _, n, _, d in keys if n), default=None)
    text = len(profiles) >= 3 and all(p[1] == "string" for p in profiles)
    marked = any(p[0].lower().startswith(("_ingestion", "_source", "_record_hash")) or "quarantine" in p[0].lower() for p in profiles)
    if marked or rate > SILVER_NULLS or any(k[3] for k in keys) or (unique is not None and unique < SILVER_UNIQUE) or text or not profiles:
        return "bronze"
    return "gold" if business_ready and rate <= GOLD_NULLS and (unique is None or unique >= GOLD_UNIQUE) else "silver"


def topology(columns: Mapping[str, int], edges: Sequence[tuple[str, str]]) -> str:
    """flat, OBT, hierarchical, star, snowflake, galaxy or 3NF of tables (and their number of columns) and references (child, parent)."""
    if len(columns) <= 1:
        return "unknown" if not columns else "OBT" if max(columns.values()) >= WIDE else "flat"
    if not edges:
        return "flat"
    between = {e for e in edges if e[0] != e[1]}
    if not between:
        return "hierarchical"
    children, parents = ({e[k] for e in between} for k in (0, 1))
    facts = {t for t in children - parents if len({p for c, p in between if c == t}) >= 2}
    if not facts:
        return "3NF"
    return "galaxy" if len(facts) > 1 else "snowflake" if children & parents else "star"


def arrival(seconds: Sequence[float]) -> str:
    """one_shot, periodic or continuous, by the gaps between the times of a source's files."""
    at = sorted(set(seconds))
    if not at:
        return "unknown"
    if len(at) < LEAST_ARRIVALS or at[-1] - at[0] < UPLOAD_SPAN:
        return "one_shot"
    return "continuous" if median(b - a for a, b in zip(at, at[1:], strict=False)) <= STREAM_GAP else "periodic"


def arrivals(df: DataFrame, source: str, at: str) -> DataFrame:
    """source, arrival: the cadence of many sources at once, from the time of each of their files."""
    times = df.select(source, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).distinct()
    w = Window.partitionBy(source).orderBy("_t")
    gaps = times.withColumn("_gap", F.col("_t") - F.lag("_t").over(w)).groupBy(source).agg(F.count(F.lit(1)).alias("n"), (F.max("_t") - F.min("_t")).alias("span"), F.median("_gap").alias("gap"))
    kind = F.when((F.col("n") < LEAST_ARRIVALS) | (F.col("span") < UPLOAD_SPAN * 1e6), "one_shot").when(F.col("gap") <= STREAM_GAP * 1e6, "continuous").otherwise("periodic")
    return gaps.select(source, kind.alias("arrival"))


def double_rows(ledger: DataFrame, keys: Sequence[str], order: str, session: str, agent: str) -> DataFrame:
    """Rows of a ledger after the first with their keys: keys, kind and level, by whether the session or the agent of the first row differs."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = ledger.select(*keys, F.row_number().over(w).alias("_n"), *[(~F.col(c).eqNullSafe(F.first(c).over(first))).alias(f"_{k}") for k, c in (("s", session), ("a", agent))])
    kind = F.when(F.col("_s"), "cross_session").when(F.col("_a"), "cross_agent").otherwise("double_fire")
    return marked.filter("_n > 1").select(*keys, kind.alias("kind"), F.when(F.col("_s") | F.col("_a"), "warning").otherwise("info").alias("level"))


def numeric(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]
