"""Joins by time: the last value before each moment, and moments within intervals, for keys of any size.

Neither is an equi-join by key whose result is filtered by time: for a key with many rows on both sides that makes their product. Both cut time into days (or
other steps), so that one key's rows lie in many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, since: str, take: Sequence[str], tie: Sequence[str] = (), step: str = "day", inner: bool = False) -> DataFrame:
    """left's rows with `take` of right's last row whose key is the same and whose `since` is not after `at` (null where there is none; inner: then left out).

    Of right's rows with one time the greatest by `tie` counts. Both sides are one union, sorted by key, step and time, along which the last value is carried; what a
    step begins with comes from the steps before it, of which a key has one row each. Null keys are one key; rows without a time find nothing and aren't found."""
    clash = [c for c in take if c in left.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    names = [*by, at, *[c for c in left.columns if c not in (*by, at)]]
    value, none = F.struct(*[F.col(c) for c in take]), "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in right.select(*take).schema) + ">"
    mine = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(none).alias("_v"), F.struct(*[F.col(c) for c in left.columns if c not in by]).alias("_row"))
    order = F.struct(F.col(since), *tie)
    facts = right.filter(F.col(since).isNotNull())
    latest = facts.groupBy(*by, since).agg(F.max_by(value, order).alias("_v")).select(*by, F.col(since).alias("_t"), F.lit(0).alias("_side"), "_v", F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    both = mine.unionByName(latest).withColumn("_step", F.date_trunc(step, "_t"))
    # The last value of each step, and from it what each later one begins with: a row a key and step.
    ends = latest.withColumn("_step", F.date_trunc(step, "_t")).groupBy(*by, "_step").agg(F.max_by("_v", "_t").alias("_end"))
    steps = left_by(both.select(*by, "_step").distinct(), ends, [*by, "_step"])
    before = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    begins = steps.select(*by, "_step", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    within = Window.partitionBy(*by, "_step").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = left_by(both.withColumn("_last", F.last("_v", ignorenulls=True).over(within)).filter("_side = 1"), begins, [*by, "_step"])
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_last", "_begin"))
    out = carried.withColumn("_f", found)
    out = out.filter("_f IS NOT NULL") if inner else out
    return out.select(*by, "_row.*", *[F.col("_f")[c].alias(c) for c in take]).select(*names, *take)


def left_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by keys of which null is one."""
    other = right.select(*[F.col(k).alias(f"_r_{n}") for n, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = None
    for n, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"_r_{n}"))
        same = test if same is None else same & test
    return left.join(other, same, "left").drop(*[f"_r_{n}" for n in range(len(keys))])


def within(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: Column, start: str, end: str, closed: bool = True, step_seconds: int = 86_400) -> DataFrame:
    """Points joined with the intervals of their key that hold their time; intervals may overlap. closed: the end belongs to the interval.

    An interval comes once for each step of time that it touches (those that points reach, where it has no end), so points meet the intervals of their key and step only."""
    stamp = lambda c: F.unix_seconds(c.cast("timestamp"))
    rows = points.withColumn("_lm_at", at).withColumn("_lm_step", F.floor(stamp(F.col("_lm_at")) / step_seconds)).filter("_lm_at IS NOT NULL")
    reach = rows.agg(F.min("_lm_step").alias("_lm_lo"), F.max("_lm_step").alias("_lm_hi"))  # one row
    first = F.greatest(F.floor(stamp(F.col(start)) / step_seconds), F.col("_lm_lo"))
    last = F.least(F.coalesce(F.floor(stamp(F.col(end)) / step_seconds), F.col("_lm_hi")), F.col("_lm_hi"))
    spans = intervals.filter(F.col(start).isNotNull()).join(F.broadcast(reach)).withColumn("_lm_first", first).withColumn("_lm_last", last).filter("_lm_first <= _lm_last")
    spans = spans.withColumn("_lm_step", F.explode(F.sequence("_lm_first", "_lm_last"))).drop("_lm_lo", "_lm_hi", "_lm_first", "_lm_last")
    inside = F.col("_lm_at") <= F.col(end) if closed else F.col("_lm_at") < F.col(end)
    found = rows.join(spans, [*by, "_lm_step"]).filter((F.col("_lm_at") >= F.col(start)) & (F.col(end).isNull() | inside))
    return found.drop("_lm_at", "_lm_step")
