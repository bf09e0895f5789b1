"""Samples that repeat, and how well a sample stands for its table.

Rows are chosen by a hash of a key, so the same rows come each time and in any order of partitions. Exact quotas need no sort of a whole stratum: a
histogram of the hashes shows where the quota ends, and only the rows of that one bin are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.operators import selection

#: Strata beyond which rows are drawn without them; deciles of a target; weights of the penalties of a score.
STRATA_LIMIT = 10_000
DECILES = tuple(k / 10 for k in range(1, 10))
QUANTILES = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
WEIGHTS = {"distribution": 0.20, "fill": 0.10, "numeric": 0.15, "relationship": 0.15, "target": 0.20, "tail": 0.10, "target_relationship": 0.10, "model": 0.25}
LEAST_ROWS = 20


def hash_of(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hashed(df: DataFrame, key: str, per_mille: float, seed: int = 42) -> DataFrame:
    """About per_mille of a thousand rows."""
    return df.filter(F.conv(F.substring(hash_of(key, seed), 1, 8), 16, 10).cast("bigint") % 1_000_000 < per_mille * 1000)


def quotas(df: DataFrame, strata: Sequence[str], key: str, fraction: float, least: int = 1, seed: int = 42, limit: int = STRATA_LIMIT) -> DataFrame:
    """Of each stratum round(n * fraction) rows, `least` at least: those whose hashes come first. Beyond `limit` strata, about fraction of all rows."""
    if df.select(*strata).distinct().limit(limit + 1).count() > limit:
        return hashed(df, key, fraction * 1000, seed)
    drawn = df.withColumn("_h", hash_of(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    names = {s: f"_s{k}" for k, s in enumerate(strata)}
    bins = drawn.groupBy(*[F.col(s).alias(n) for s, n in names.items()], F.col("_b").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*names.values())
    bins = bins.withColumn("_upto", F.sum("_n").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.withColumn("_quota", F.greatest(F.round(F.sum("_n").over(whole) * fraction), F.lit(least))).filter("_upto - _n < _quota")
    same = F.col("_b") == F.col("_bin")
    for s, n in names.items():
        same &= F.col(s).eqNullSafe(F.col(n))
    placed = drawn.join(bins, same)
    nth = F.row_number().over(Window.partitionBy(*names.values(), "_bin").orderBy("_h", key))
    last = placed.filter("_upto > _quota").withColumn("_k", nth).filter("_k <= _quota - (_upto - _n)")
    return placed.filter("_upto <= _quota").select(*df.columns).unionByName(last.select(*df.columns))


def edges(df: DataFrame, column: str, at: Sequence[float] = DECILES, approximate: bool = False) -> list[float]:
    """Different values of a column's quantiles, in order: as many as asked for, whatever the table's size."""
    if approximate:
        return sorted({float(v) for v in df.agg(F.percentile_approx(column, list(at), 10_000).alias("q")).first()["q"] or [] if v is not None})
    return sorted({r["value"] for r in selection.quantiles(df, column, at).collect()})


def bin_of(column: str, cuts: Sequence[float]) -> Column:
    """How many of the cuts the value is over."""
    return sum((F.coalesce((F.col(column) > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def by_target(df: DataFrame, target: str, key: str, fraction: float, strata: Sequence[str] = (), least: int = 1, seed: int = 42) -> DataFrame:
    """A sample with quotas for the target's deciles, within other strata if there are any."""
    marked = df.withColumn("_target", bin_of(target, edges(df, target)))
    return quotas(marked, [*strata, "_target"], key, fraction, least, seed).drop("_target")


def outer(df: DataFrame, columns: Sequence[str], tail: float) -> dict[str, tuple[float, float]]:
    """The outer quantiles of each column that has values: two rows a column."""
    found: dict[str, dict[float, float]] = {}
    for r in selection.of_columns(df, columns, [tail, 1 - tail]).collect():
        found.setdefault(r["column_name"], {})[r["q"]] = r["value"]
    return {c: (v[tail], v[1 - tail]) for c, v in found.items()}


def with_tails(sample: DataFrame, df: DataFrame, columns: Sequence[str], key: str, fraction: float, tail: float = 0.01, boost: float = 3.0, seed: int = 42) -> DataFrame:
    """Adds to a sample rows of the tails of some columns, drawn `boost` times as often; a row comes once."""
    outside = F.lit(False)
    for c, (low, high) in outer(df, columns, tail).items():
        outside |= F.coalesce((F.col(c) <= low) | (F.col(c) >= high), F.lit(False))
    tails = hashed(df.filter(outside), key, min(1.0, fraction * max(1.0, boost)) * 1000, seed + 17)
    return sample.unionByName(tails, allowMissingColumns=True).dropDuplicates([key])


# How well a sample stands for its table
def distance(full: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distance (half the summed difference of the shares), largest (difference of one value)."""
    out = None
    for c in columns:
        a, b = (d.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")) for d in (full, sample))
        n, m = (d.agg(F.sum("n").alias(f"all_{k}")) for k, d in (("a", a), ("b", b)))  # one row each
        both = a.withColumnRenamed("n", "na").join(b.select(F.col("v").alias("w"), F.col("n").alias("nb")), F.col("v").eqNullSafe(F.col("w")), "full")
        off = F.abs(F.coalesce("na", F.lit(0)) / F.col("all_a") - F.coalesce("nb", F.lit(0)) / F.col("all_b"))
        one = both.join(F.broadcast(n)).join(F.broadcast(m)).agg(F.round(F.sum(off) / 2, 6).alias("distance"), F.round(F.max(off), 6).alias("largest"))
        one = one.select(F.lit(c).alias("column"), "distance", "largest")
        out = one if out is None else out.unionByName(one)
    return out


def numbers(full: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, metric, full, sample, delta: mean, deviation and exact quantiles of both."""
    def stats(df: DataFrame, name: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.round(x, 4).alias(name)) for c in columns for m, x in (("mean", F.avg(c)), ("std", F.stddev_samp(c)))]
        named = F.create_map(*[x for m, q in QUANTILES.items() for x in (F.lit(q), F.lit(m))])
        found = selection.of_columns(df, columns, list(QUANTILES.values())).select(F.col("column_name").alias("column"), named[F.col("q")].alias("metric"), F.round("value", 4).alias(name))
        return df.agg(F.array(*each).alias("s")).select(F.inline("s")).unionByName(found)

    both = stats(full, "full").join(stats(sample, "sample"), ["column", "metric"])
    return both.select("column", "metric", "full", "sample", F.round(F.col("sample") - F.col("full"), 4).alias("delta"))


def tail_shares(full: DataFrame, sample: DataFrame, columns: Sequence[str], tail: float = 0.01) -> DataFrame:
    """column, tail, full_share, sample_share beyond the full table's outer quantiles (null for a column without values): one pass over each of both."""
    cuts = outer(full, columns, tail)
    beyond = lambda c: (("low", F.col(c) <= cuts[c][0]), ("high", F.col(c) >= cuts[c][1])) if c in cuts else (("low", F.lit(None).cast("boolean")), ("high", F.lit(None).cast("boolean")))
    share = lambda c, t: F.round(F.try_divide(F.count_if(t), F.nullif(F.count(c), F.lit(0))), 6) if c in cuts else F.lit(None).cast("double")

    def shares(df: DataFrame, name: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("column"), F.lit(s).alias("tail"), share(c, t).alias(name)) for c in columns for s, t in beyond(c)]
        return df.agg(F.array(*each).alias("s")).select(F.inline("s"))

    return shares(full, "full_share").join(shares(sample, "sample_share"), ["column", "tail"])


def joint_distance(full: DataFrame, sample: DataFrame, x: str, y: str) -> DataFrame | None:
    """One row, `distance` of the joint distributions of x and y over the full table's deciles; None with few rows or values."""
    full, sample = (d.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna() for d in (full, sample))
    grid = [0.0, *DECILES, 1.0]
    ex, ey = edges(full, "x", grid), edges(full, "y", grid)
    if len(ex) < 3 or len(ey) < 3 or min(len(d.take(LEAST_ROWS)) for d in (full, sample)) < LEAST_ROWS:
        return None
    # Bins are closed on the left, the last one on both sides.
    place = lambda c, e: sum(((F.col(c) >= v).cast("int") for v in e[1:-1]), F.lit(0))
    within = F.col("x").between(ex[0], ex[-1]) & F.col("y").between(ey[0], ey[-1])

    def cells(df: DataFrame, n: str) -> DataFrame:
        counted = df.filter(within).groupBy(place("x", ex).alias("bx"), place("y", ey).alias("by")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select("bx", "by", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(n))  # a hundred cells

    both = cells(full, "p").join(cells(sample, "q"), ["bx", "by"], "full")
    return both.agg(F.round(F.sum(F.abs(F.coalesce("p", F.lit(0)) - F.coalesce("q", F.lit(0)))) / 2, 6).alias("distance"))


def score(penalties: dict[str, float | None]) -> tuple[float, str]:
    """(0 to 100, advice) from penalties between 0 and 1; those that are None have no weight."""
    held = {k: v for k, v in penalties.items() if v is not None}
    weight = sum(WEIGHTS[k] for k in held)
    out = round(max(0.0, min(100.0, 100 * (1 - (sum(WEIGHTS[k] * v for k, v in held.items()) / weight if weight else 0)))), 2)
    below = lambda k, bound: k in held and 100 * (1 - held[k]) < bound
    if below("model", 70):
        return out, "sample_not_model_ready"
    return out, "increase_pct_or_candidates" if out < 90 or below("target", 90) or below("tail", 85) else "use_current_sample"


def transfer(full: DataFrame, sample: DataFrame, target: str, features: Sequence[str], trees: int = 20, seed: int = 42) -> dict[str, float]:
    """A forest fitted on the sample and tried on the full table: explained variance of a numeric target, on both, and each feature's importance."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    fitted = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=6, seed=seed).fit(ready.transform(sample.dropna(subset=[target])))
    tried = RegressionEvaluator(labelCol=target, metricName="r2")
    out = {f"r2_{n}": tried.evaluate(fitted.transform(ready.transform(d.dropna(subset=[target])))) for n, d in (("sample", sample), ("full", full))}
    return out | {f: float(v) for f, v in zip(features, fitted.featureImportances.toArray(), strict=True)}
