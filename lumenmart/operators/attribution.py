"""What runs cost and what they teach: windows of runs, usage within them, prices in effect, weighted shares, and statistics of attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmart.operators import temporal


def run_windows(anchors: DataFrame, run: str, started: str, finished: str) -> DataFrame:
    """run, window_start, window_end: from the first start to the last finish; runs that lack either are left out."""
    out = anchors.groupBy(run).agg(F.min(F.col(started).try_cast("timestamp_ntz")).alias("window_start"), F.max(F.col(finished).try_cast("timestamp_ntz")).alias("window_end"))
    return out.dropna(subset=["window_start", "window_end"])


def usage_in_windows(usage: DataFrame, windows: DataFrame, by: Sequence[str], at: str, amounts: Sequence[str]) -> DataFrame:
    """Sums of amounts of the rows whose time lies in the window with the same `by`; times that don't read as one can't be placed and don't count."""
    within = temporal.within(usage, windows, by, F.col(at).try_cast("timestamp_ntz"), "window_start", "window_end")
    return within.groupBy(*by).agg(*[F.sum(a).alias(a) for a in amounts], F.count(F.lit(1)).alias("turns"))


def shares_of_cost(queries: DataFrame, usage: DataFrame, prices: DataFrame, run: object) -> DataFrame:
    """What a run cost on each warehouse: the warehouse's cost while the run went on, by the run's share of the time of all queries then.

    queries: warehouse, run, start_time, end_time, duration. usage: warehouse, sku, unit, quantity, usage_start, usage_end. prices: sku, unit, price,
    price_start, price_end (null: still). The run's windows are a row for each warehouse; usage meets the prices of its sku, unit and day."""
    mine = queries.filter(F.col("run") == F.lit(run)).groupBy("warehouse").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("duration").alias("run_duration"), F.min("start_time").alias("window_start"), F.max("end_time").alias("window_end")
    )
    window = mine.select("warehouse", "window_start", "window_end")
    others = queries.join(window, "warehouse").filter((F.col("start_time") >= F.col("window_start")) & (F.col("end_time") <= F.col("window_end")))
    whole = others.groupBy("warehouse").agg(F.sum("duration").alias("warehouse_duration"))
    used = usage.join(window, "warehouse").filter((F.col("usage_end") > F.col("window_start")) & (F.col("usage_start") < F.col("window_end")))
    priced = temporal.within(used, prices, ["sku", "unit"], F.col("usage_start"), "price_start", "price_end", closed=False)
    cost = priced.groupBy("warehouse").agg(F.sum("quantity").alias("units"), F.sum(F.col("quantity") * F.col("price")).alias("cost"))
    out = mine.join(whole, "warehouse", "left").join(cost, "warehouse", "left")
    share = F.try_divide("run_duration", F.nullif("warehouse_duration", F.lit(0)))
    return out.select("warehouse", "query_count", "run_duration", "warehouse_duration", F.round("units", 4).alias("units"), F.round("cost", 4).alias("cost"), F.round(F.col("cost") * share, 4).alias("run_cost"))


def pattern_stats(attempts: DataFrame, kind: str, decision: str, delta: str, top: int = 50) -> DataFrame:
    """kind, attempts, keeps, success_rate, avg_delta (a delta that is missing counts as 0): those kept most often first."""
    out = attempts.groupBy(kind).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(decision) == "keep").alias("keeps"), F.round(F.avg(F.coalesce(delta, F.lit(0))), 4).alias("avg_delta"))
    out = out.withColumn("success_rate", F.round(F.col("keeps") / F.col("attempts"), 4))
    return out.orderBy(F.desc("keeps"), F.desc("attempts"), kind).limit(top)


def lessons(records: DataFrame, keys: Sequence[str], elapsed: str, bottleneck: str, top: int = 5) -> DataFrame:
    """keys, successes, avg_elapsed, score (successes a second) and the most frequent bottlenecks, of runs that succeeded and were validated."""
    good = records.filter((F.col("status") == "success") & F.col("validation").isin("ok", "passed"))
    out = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("successes"), F.avg(elapsed).alias("_avg")).filter(F.col("_avg").isNotNull())
    kinds = good.filter(F.col(bottleneck).isNotNull()).groupBy(*keys, bottleneck).agg(F.count(F.lit(1)).alias("_n"))
    listed = kinds.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(bottleneck).alias("b")))), 1, top).alias("_l"))
    names = F.array_join(F.transform("_l", lambda x: x["b"]), ",")
    scored = out.join(listed, list(keys), "left").select(
        *keys, "successes", F.round("_avg", 6).alias("avg_elapsed"), F.round(F.col("successes") / F.greatest("_avg", F.lit(0.001)), 6).alias("score"), F.coalesce(names, F.lit("")).alias("bottlenecks")
    )
    return scored.orderBy(F.desc("score"), *keys)
