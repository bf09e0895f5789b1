"""Exact quantiles of groups of any size, by selection: no task sorts or holds a group.

Each round is one aggregation that gives every group its size, its number of different values (estimated) and a grid of approximate quantiles, whose error is a tenth of
the grid's spacing. The two grid values around a wanted rank, one further on each side, bound it; what lies below is counted, and only the band between goes on to the next
round, some 3 of `GRID` parts of the group. A group or band of few different values is settled by their counts.

What is known of a group reaches its rows by broadcast for the `HOT` largest groups, so that no key's rows meet in one task, and rows are only counted where they carry it: an aggregate
that kept it would sort them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.functions.columns import all_of
from lumenmart.operators.verify import settled

GRID = 500
#: Different values that one task sorts.
FEW = 50_000
#: Groups whose row is broadcast.
HOT = 10_000


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """by, q, value: for each group (null is one) the quantiles `at`, interpolated between ranks; null values don't count, NaN is the largest value."""
    at = list(dict.fromkeys(float(q) for q in at))
    keys = [f"_k{n}" for n in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    # A lone group has a key too, so that every round is alike.
    rows = rows.withColumn("_all", F.lit(0))
    group, targets, found, first = ["_all", *keys], None, [], True
    while True:
        stats = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("d"), F.percentile_approx("v", [k / GRID for k in range(GRID + 1)], F.lit(20 * GRID)).alias("g"))
        if first:  # every quantile of a group has its rank among the same rows
            place = lambda q: (F.col("n") - 1) * F.lit(q)
            wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.floor(place(q)).alias("rank"), (place(q) - F.floor(place(q))).alias("part")) for q in at])
            stats = stats.withColumn("t", wanted)
        else:
            stats = _with(stats, targets, group)
        stats = settled(stats)
        found.append(_by_counts(rows, stats.filter(F.col("d") <= few).select(*group, "n", "t"), group))
        large = stats.filter(F.col("d") > few)
        if large.isEmpty():
            break
        # Bounds of each wanted rank and of the next one; none at the ends of the grid.
        step = lambda r: r.cast("double") / (F.col("n") - 1) * GRID
        low = lambda t: F.when(F.floor(step(t["rank"])) >= 1, F.get("g", (F.floor(step(t["rank"])) - 1).cast("int"))).otherwise(F.lit(float("-inf")))
        high = lambda t: F.when(F.ceil(step(t["rank"] + 1)) < GRID, F.get("g", (F.ceil(step(t["rank"] + 1)) + 1).cast("int"))).otherwise(F.lit(float("nan")))
        bounds = large.select(*group, "n", F.transform("t", lambda t: F.struct(t["q"].alias("q"), t["rank"].alias("rank"), t["part"].alias("part"), low(t).alias("lo"), high(t).alias("hi"))).alias("t"))
        width = len(at) if first else 1
        met = _met(rows, bounds, group)
        below = met.groupBy(*group).agg(*[F.count_if(F.col("v") < F.get("t", F.lit(k))["lo"]).alias(f"_b{k}") for k in range(width)])
        below = _with(below.select(*group, F.array(*[f"_b{k}" for k in range(width)]).alias("below")), bounds, group)
        pairs = below.select(*group, F.inline(F.arrays_zip("t", "below")))
        inside = met.select(*group, "v", F.explode(F.filter("t", lambda t: (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))).alias("t"))
        rows = settled(inside.select(*group, "v", F.col("t")["q"].alias("_q")) if first else inside.select(*group, "v"))
        group = [*group, "_q"] if first else group
        pairs = pairs.withColumn("_q", F.col("t")["q"])
        one = F.struct(F.col("t")["q"].alias("q"), (F.col("t")["rank"] - F.col("below")).alias("rank"), F.col("t")["part"].alias("part"))
        targets, first = settled(pairs.select(*group, F.array(one).alias("t"))), False
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "q", "value")


def of_columns(df: DataFrame, columns: Sequence[str], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, column_name, q, value of several columns: they are groups of one selection, so df is read as often as for one."""
    each = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]
    return quantiles(df.select(*by, F.inline(F.array(*each))), "v", at, [*by, "column_name"])


def _with(rows: DataFrame, more: DataFrame, group: Sequence[str], how: str = "left") -> DataFrame:
    """Join by group, of which null is one; a row a group on the right."""
    other = more.select(*[F.col(g).alias(f"_r{g}") for g in group], "t")
    return rows.join(other, all_of([F.col(g).eqNullSafe(F.col(f"_r{g}")) for g in group]), how).drop(*[f"_r{g}" for g in group])


def _met(rows: DataFrame, more: DataFrame, group: Sequence[str]) -> DataFrame:
    """rows of the groups in `more` (group, n, t; settled), with t: the largest groups by broadcast, which leaves each of the others a `HOT`-th of all rows at most."""
    if not more.offset(HOT).limit(1).isEmpty():
        largest = settled(more.orderBy(F.desc("n"), *group).limit(HOT))
        other = more.join(F.broadcast(largest.select(*[F.col(g).alias(f"_l{g}") for g in group])), all_of([F.col(g).eqNullSafe(F.col(f"_l{g}")) for g in group]), "left_anti")
        return _with(rows, F.broadcast(largest), group, "inner").unionByName(_with(rows, other, group, "inner"))
    return _with(rows, F.broadcast(more), group, "inner")


def _by_counts(rows: DataFrame, more: DataFrame, group: Sequence[str]) -> DataFrame:
    """rows: group, v; more: group, n, t. The wanted ranks from the counts of different values, which few rows hold."""
    counts = _met(rows, more, group).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("v")))
    each = _with(upto, more, group).select(*group, "v", "upto", F.explode("t").alias("t"))
    rank = F.col("t")["rank"]
    keys = [g for g in group if g != "_q"]
    ends = each.groupBy(*keys, F.col("t")["q"].alias("q"), F.col("t")["part"].alias("part")).agg(
        F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > rank + 1, F.col("v"))).alias("b")
    )
    return ends.select(*keys, "q", F.when(F.col("part") > 0, F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).otherwise(F.col("a")).alias("value"))
