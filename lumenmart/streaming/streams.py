"""Streams of files: read what is there with a rate limit, write once, upsert batches, and windows over event time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.sources.versions import Versions, stream_id


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_batch: int = 1000, rescued: bool = False) -> DataFrame:
    """A stream of the files below path; the schema is given, so it can't change unseen. rescued: csv and json rows that don't fit it come in _rescued."""
    reader = spark.readStream.format(kind).option("maxFilesPerTrigger", per_batch)
    if rescued and kind in ("csv", "json"):
        schema = T.StructType([*schema.fields, T.StructField("_rescued", T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rescued")
    return reader.schema(schema).load(path)


def evolved(before: T.StructType, now: T.StructType) -> T.StructType:
    """The schema for the next start of a stream: what was there, then new columns, nullable. A column of another type is an error."""
    held = {f.name: f for f in before.fields}
    for f in now.fields:
        if f.name in held and held[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} was {held[f.name].dataType.simpleString()} and is {f.dataType.simpleString()}")
    return T.StructType([*before.fields, *(T.StructField(f.name, f.dataType, True) for f in now.fields if f.name not in held)])


def kafka(spark: SparkSession, servers: str, topic: str, per_batch: int = 1_000_000) -> DataFrame:
    """Needs Spark's Kafka package on the cluster."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": per_batch}
    return spark.readStream.format("kafka").options(**options).load()


def append_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there, each row once: the file sink's log and the checkpoint see to it."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def newest(before: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one that is last in order (a null order comes before all others), of what was there and what has come: late rows don't win.
    Combined before the shuffle."""
    rows = batch if before is None else before.unionByName(batch)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.struct(order), F.struct(*rest))).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 32) -> None:
    """Keeps the newest row of each key in a versioned table below path. Its rows lie in buckets by key, and a micro-batch rewrites only those that it touches.

    Each batch is one version, known by the query's id and its number: run again it changes nothing, and a query with a new checkpoint goes on from what is there."""
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table, mark = Versions(spark, path), (stream_id(spark, checkpoint), number)
        state = table.state()
        if state["marks"].get(mark[0], -1) >= number:  # this batch, run again
            return
        bucket = F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))
        rows = newest(None, batch, keys, order).withColumn("_lm_bucket", bucket)
        touched = [r[0] for r in rows.select("_lm_bucket").distinct().collect()]  # at most `buckets`
        held = [df for b in touched if (df := table.read(b, state["version"] if state["version"] >= 0 else None)) is not None]
        before = reduce(DataFrame.unionByName, held) if held else None
        after = newest(before, rows.drop("_lm_bucket"), keys, order).withColumn("_lm_bucket", bucket)
        table.replace_by(after, "_lm_bucket", state["version"], mark)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that `upsert_batches` keeps below path."""
    table = Versions(spark, path)
    state = table.state(version)
    return reduce(DataFrame.unionByName, [table.read(p, state["version"]) for p in sorted(state["parts"])])


def append_windows(stream: DataFrame, event: str, length: str, late: str, path: str, checkpoint: str, *by: str) -> None:
    """Counts by event-time window, each written once, when the watermark has passed it; rows that come later than that are dropped."""
    windows(stream, event, length, late, *by).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def windows(df: DataFrame, event: str, length: str, late: str = "1 day", *by: str) -> DataFrame:
    """Counts by event-time window; late rows are awaited."""
    seen = df.withWatermark(event, late) if df.isStreaming else df
    return seen.groupBy(F.window(event, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
