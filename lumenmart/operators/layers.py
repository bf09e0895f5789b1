"""Bronze, silver and gold: provenance, cleaning contracts, upserts, history, increments and assertions.

Tables are Parquet directories. A changed table is a new version (`sources.versions`): what is read is never overwritten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.functions import columns as c
from lumenmart.plans.names import safe_expr
from lumenmart.sources.versions import Rejected, Versions


def with_provenance(df: DataFrame, system: str, loaded_at: str) -> DataFrame:
    """Adds _source_system, _source_file and _load_ts; the clock is given, so a load can be repeated."""
    return df.select("*", F.lit(system).alias("_source_system"), F.col("_metadata.file_name").alias("_source_file"), F.lit(loaded_at).cast("timestamp_ntz").alias("_load_ts"))


@dataclass(frozen=True)
class Field:
    """source to name, cast to kind; nulls: keep, default, drop or fail; pii: hashed with the salt."""

    source: str
    name: str
    kind: str
    nulls: str = "keep"
    default: object = None
    pii: bool = False


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    keys: tuple[str, ...]
    latest: tuple[str, ...] = ()
    derived: dict[str, str] = field(default_factory=dict)
    salt: str = ""


def clean(df: DataFrame, contract: Contract) -> DataFrame:
    """One projection: lenient casts, null policy, hashed fields, derived columns; then one row a key, the latest."""

    def value(f: Field) -> Column:
        x = F.col(f.source).try_cast(f.kind)
        if f.nulls == "default":
            x = F.coalesce(x, F.lit(f.default).cast(f.kind))
        if f.nulls == "fail":
            x = F.when(x.isNull(), F.raise_error(F.lit(f"{f.name} is null"))).otherwise(x)
        return (c.salted(x, contract.salt) if f.pii else x).alias(f.name)

    out = df.select(*[value(f) for f in contract.fields])
    if needed := [f.name for f in contract.fields if f.nulls == "drop"]:
        out = out.dropna(subset=needed)
    out = out.withColumns({n: safe_expr(e) for n, e in contract.derived.items()})
    return one_a_key(out, contract.keys, contract.latest) if contract.keys else out


def one_a_key(df: DataFrame, keys: Sequence[str], latest: Sequence[str] = ()) -> DataFrame:
    """The greatest row of each key (null keys are one) by `latest`, null before all else, then by its other columns, so that ties don't depend on partitions; combined
    before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = F.struct(*latest, *[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(f"`{c}`") for c in rest])
    whole = F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(whole, order).alias("_r")).select(*keys, "_r.*").select(*[F.col(f"`{c}`") for c in df.columns])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], full_refresh: bool = False, latest: Sequence[str] = ()) -> DataFrame:
    """Rows of source take the place of target's rows with their keys (null keys match each other); or of all of them. Of several source rows of a key the
    greatest by `latest`, then by its other columns, stands for it."""
    source = one_a_key(source, keys, latest)
    if full_refresh:
        return source
    same = None
    renamed = source.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    for k in keys:
        test = target[k].eqNullSafe(renamed[f"_s_{k}"])
        same = test if same is None else same & test
    return target.join(renamed, same, "left_anti").unionByName(source)


def history(current: DataFrame, source: DataFrame, key: str, tracked: list[str], at: str, latest: Sequence[str] = ()) -> DataFrame:
    """Type 2 history: changed rows are closed at `at` and opened anew; equal rows stay, so a second run changes nothing. Null keys match each other. Of several
    source rows of a key one counts, as in `upsert`, so a key has one open row."""
    now = F.lit(at).cast("date")
    source = one_a_key(source.select(*dict.fromkeys([key, *tracked, *latest])), [key], latest).select(key, *tracked)
    new = source.select(F.lit(True).alias("_there"), F.col(key).alias("_k"), *[F.col(t).alias(f"_n_{t}") for t in tracked])
    both = current.filter("valid_to IS NULL").join(new, F.col(key).eqNullSafe(F.col("_k")), "left")
    changed = F.col("_there").isNotNull() & ~c.all_of([F.col(t).eqNullSafe(F.col(f"_n_{t}")) for t in tracked])
    kept_rows = both.select(key, *tracked, "valid_from", F.when(changed, now).alias("valid_to"))
    closed = current.filter("valid_to IS NOT NULL").select(key, *tracked, "valid_from", "valid_to")
    same = both.filter(F.col("_there").isNotNull() & ~changed).select(F.col(key).alias("_same"))
    opened = source.join(same, F.col(key).eqNullSafe(F.col("_same")), "left_anti").select(key, *tracked, now.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return closed.unionByName(kept_rows).unionByName(opened)


def inferred_members(dimension: DataFrame, fact: DataFrame, column: str, key: str) -> DataFrame:
    """Rows for references that came before their member, marked as inferred."""
    missing = fact.select(F.col(column).alias(key)).filter(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")
    return dimension.withColumn("is_inferred", F.lit(False)).unionByName(missing.withColumn("is_inferred", F.lit(True)), allowMissingColumns=True)


def resolve_members(dimension: DataFrame, arrived: DataFrame, key: str) -> DataFrame:
    """Members that have come take the place of those that were inferred; no member becomes inferred again."""
    return upsert(dimension, arrived.withColumn("is_inferred", F.lit(False)).select(*dimension.columns), [key])


def lookback(df: DataFrame, event: str, latest, days: int = 3) -> DataFrame:
    """What may have changed since `latest`: the filter stands on the scan, below any aggregation."""
    return df.filter(F.col(event) >= F.date_sub(F.lit(latest).cast("date"), days))


def refresh(mart: DataFrame, facts: DataFrame, event: str, group: Callable[[DataFrame], DataFrame], keys: list[str], latest, days: int = 3) -> DataFrame:
    """An incremental mart: only facts since `days` before the latest event are read and grouped, and their groups take the place of the mart's."""
    return mart if latest is None else upsert(mart, group(lookback(facts, event, latest, days)), keys)


class Refused(ValueError):
    """What was asked for needs someone's word first."""


def backfill(target: DataFrame, source: DataFrame, event: str, first: str, last: str, most_days: int = 31, confirmed: bool = False) -> DataFrame:
    """target with its rows of the days first to last replaced by source's; longer spans than most_days must be confirmed."""
    span = (date.fromisoformat(last) - date.fromisoformat(first)).days + 1
    if span < 1:
        raise ValueError(f"{last} is before {first}")
    if span > most_days and not confirmed:
        raise Refused(f"{span} days are more than {most_days}")
    inside = F.col(event).cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return target.filter(~F.coalesce(inside, F.lit(False))).unionByName(source.filter(inside))


def append_once(df: DataFrame, path: str, job: str) -> bool:
    """Appends df to the table below path, unless the job has done so; then nothing happens and the result is False. Rows and mark are one version."""
    table = Versions(df.sparkSession, path)
    before = table.state()
    return job not in before["marks"] and table.append({"data": df}, mark=(job, 0)) > before["version"]


def pull(target: DataFrame | None, since: Callable[[object], DataFrame], keys: list[str], mark: str) -> DataFrame:
    """Rows above the target's high-water mark, merged by key: a second pull changes nothing. since(mark) reads them; None reads all."""
    if target is None:
        return since(None)
    return upsert(target, since(target.agg(F.max(mark)).first()[0]), keys)


def append_bronze(df: DataFrame, path: str) -> None:
    """Loaded rows join those that are there; their columns may be other ones."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """All that was loaded, with the columns of all loads; those that a load lacked are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def plan_increment(current: dict[str, str], before: dict[str, str], feeds: dict[str, list[str]]) -> dict[str, str]:
    """build or skip for each table, in order: a changed fingerprint or a built input builds it."""
    out: dict[str, str] = {}
    for name, inputs in feeds.items():
        out[name] = "build" if current.get(name) != before.get(name) or any(out.get(i) == "build" for i in inputs) else "skip"
    return out


def fingerprint(spec: object) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def publish(df: DataFrame, path: str, checks: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> int:
    """Write, audit, publish: df is written and read back; where none of its checks finds a row, it is the table's next version. Returns failing rows."""
    table = Versions(df.sparkSession, path)
    try:
        table.replace({"data": df}, table.state()["version"], checks=checks)
    except Rejected as e:
        return e.rows
    return 0


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    return Versions(spark, path).read()


def put(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Documents in a table of documents, by their keys: those with the same keys are replaced. Refused (versions.Conflict) if another writer comes between."""
    table = Versions(spark, path)
    base = table.state()["version"]
    held = table.read(version=base) if base >= 0 else None
    table.replace({"data": rows if held is None else upsert(held, rows, keys)}, base)


# Assertions: the rows that fail
def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def outside(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    tests = [F.col(column) < low if low is not None else F.lit(False), F.col(column) > high if high is not None else F.lit(False)]
    return df.filter(tests[0] | tests[1])


def not_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(values))


def count_changed(df: DataFrame, before: int, tolerance: float) -> DataFrame:
    """One row where the number of rows left the tolerance."""
    return df.agg(F.count(F.lit(1)).alias("rows")).filter(F.abs(F.col("rows") - before) > tolerance * before)
