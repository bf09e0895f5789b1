"""Reading and writing tables: formats by suffix, many files by name, files that were loaded before, rows that don't parse."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.operators.profiling import profile
from lumenmart.plans.names import identifier, safe_text
from lumenmart.sources.versions import Versions, stream_id

SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text", ".avro": "avro"}


def format_of(path: str) -> str:
    found = [f for s, f in SUFFIXES.items() if path.rstrip("/").lower().endswith(s)]
    if not found:
        raise ValueError(f"no known format: {path}")
    return found[0]


def read(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A frozen schema is read as it is; csv and json rows that don't fit it land in _rescued."""
    kind = kind or format_of(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if kind in ("csv", "json"):
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rescued")
            schema = T.StructType([*schema.fields, T.StructField("_rescued", T.StringType())])
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    return reader.load(path)


def read_all(spark: SparkSession, paths: list[str], kind: str | None = None, schema=None) -> DataFrame:
    """Files of one table, by column name; a column that a file lacks is null there."""
    frames = [read(spark, p, kind, schema) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def not_loaded(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of files (with _source_file) whose file the ledger does not name."""
    return files.join(ledger.select(F.col("file").alias("_loaded")).distinct(), F.col("_source_file") == F.col("_loaded"), "left_anti")


def since(spark: SparkSession, reader_options: dict, table: str, column: str, mark: object) -> DataFrame:
    """Rows of a JDBC table above a high-water mark (all of them if it is None); the database filters."""
    return spark.read.format("jdbc").options(**reader_options).option("dbtable", since_sql(table, column, mark)).load()


def since_sql(table: str, column: str, mark: object) -> str:
    """What the database is asked: plain names only, and the mark as a literal."""
    source = ".".join(identifier(part) for part in table.split("."))
    if mark is None:
        return source
    literal = str(mark) if isinstance(mark, (int, float)) and not isinstance(mark, bool) else "'" + str(mark).replace("'", "''") + "'"
    return f"(SELECT * FROM {source} WHERE {identifier(column)} > {literal}) AS t"


def write_table(df: DataFrame, path: str, by: str | None = None, bytes_there: int = 0, floor: int = 1 << 30) -> None:
    """zstd Parquet; from a size on partitioned by month of a date. Each month's rows lie together in few files, more for a month of more rows: AQE splits
    what a rebalance by month would put into one task."""
    out = df
    if by and bytes_there >= floor:
        out = df.withColumn("month", F.date_format(by, "yyyy-MM"))
        out.hint("rebalance", "month").write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(path)
        return
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and modified of each file below path, without its content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def detect(spark: SparkSession, path: str) -> str:
    """The format of a file or of most files below a folder, by suffix."""
    try:
        return format_of(path)
    except ValueError:
        suffix = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
        most = listed(spark, path).groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("suffix").isin(*SUFFIXES)).orderBy(F.desc("n"), "suffix").first()
        if most is None:
            raise
        return SUFFIXES[most["suffix"]]


def available(spark: SparkSession, kind: str) -> bool:
    """Whether this session has a reader for the format."""
    try:
        spark.read.format(kind).schema("x int").load([])
        return True
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
            return False
        return True


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A layer's table: through Delta where its log is there, which needs the package; else Parquet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path)
    if not available(spark, "delta"):
        raise RuntimeError(f"{path} is a Delta table and this session has no package for Delta")
    return spark.read.format("delta").load(path)


def run_mode(sources: dict[str, set[str]], prefer: str = "bronze") -> str:
    """raw or bronze for all sources of a query: the preferred one if every source has it; never some of each."""
    for mode in (prefer, *({"raw", "bronze"} - {prefer})):
        if all(mode in held for held in sources.values()):
            return mode
    raise ValueError(f"no one mode for all of {sorted(sources)}")


def staged(spark: SparkSession, tables: dict[str, dict[str, str]], mode: str, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables of a query, all by one mode, with the columns that it needs: a path is read, any other text is a table of the catalog."""
    out = {}
    for name, places in tables.items():
        where = places[mode]
        df = read(spark, where) if "/" in where else spark.table(".".join(identifier(p) for p in where.split(".")))
        out[name] = df.select(*columns[name])
    return out


SOURCE = ("_source_file", "_source_bytes", "_source_time")


def load_new(spark: SparkSession, path: str, table: Versions, checkpoint: str, kind: str, schema, per_batch: int = 1000) -> int:
    """Appends the files below path, in folders of any depth, that were not loaded before; returns how many.

    A checkpointed stream lists them. Each batch is one version of the table, with the rows (part `data`, and where each came from) and the ledger (part `ledger`:
    whole path, length and time of each file) together: there is no moment between the two. A batch that runs again is known by its number; under a new
    checkpoint the ledger says what is there. A file that has changed since is a new one."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.readStream.format(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    if kind == "csv":
        reader = reader.option("header", True)
    if kind in ("csv", "json"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rescued")
        schema = T.StructType([*schema.fields, T.StructField("_rescued", T.StringType())])
    meta = [F.col("_metadata.file_path").alias(SOURCE[0]), F.col("_metadata.file_size").alias(SOURCE[1]), F.col("_metadata.file_modification_time").alias(SOURCE[2])]
    files = lambda: 0 if (df := table.read("ledger")) is None else df.count()
    before = files()

    def one(batch: DataFrame, number: int) -> None:
        ledger = table.read("ledger")
        new = batch if ledger is None else batch.join(ledger, list(SOURCE), "left_anti")
        table.append_with(new, lambda written: {"ledger": written.select(*SOURCE).distinct()}, (stream_id(batch.sparkSession, checkpoint), number))

    stream = reader.schema(schema).load(path).select("*", *meta)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return files() - before


def _fetch(asked: DataFrame, fetch: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """The rows of each page, with _page and _error; a page without rows is one row, marked _empty."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        for batch in batches:
            for one in batch.to_dict("records"):
                try:
                    rows, error = fetch(one), None
                except Exception as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                out = pd.DataFrame([{n: r.get(n) for n in names} for r in rows] or [dict.fromkeys(names)], columns=names)
                yield out.assign(_page=one["page"], _error=error, _empty=not rows)

    return asked.repartition(asked.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"{schema}, _page long, _error string, _empty boolean")


def fetched(asked: DataFrame, fetch: Callable[[dict], list[dict]], schema: str, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages of a web source, fetched inside tasks: (rows with _page, pages that failed, with the error).

    asked: page, and what fetch needs to ask for it (an address, a token, a range). fetch(row) gives a page's rows; what it raises puts the page aside and stops nothing else.
    Pages that `done` (page) names are not fetched again."""
    got = _fetch(asked if done is None else asked.join(done.select("page").distinct(), "page", "left_anti"), fetch, schema)
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return got.filter("NOT _empty").select("_page", *names), got.filter("_error IS NOT NULL").select(F.col("_page").alias("page"), F.col("_error").alias("error"))


def load_pages(asked: DataFrame, fetch: Callable[[dict], list[dict]], table: Versions, schema: str) -> tuple[int, int]:
    """Pages that the table has not yet, fetched and appended: (pages that came, pages that failed).

    Rows (part `data`), pages that came (`pages`, the checkpoint: empty ones are among them) and pages put aside (`quarantine`, with the error) are one version, so a run that
    breaks off leaves nothing or all of it. Pages that failed are asked for again by the next run."""
    done = table.read("pages")
    got = _fetch(asked if done is None else asked.join(done, "page", "left_anti"), fetch, schema)
    counts = {}

    def parts(written: DataFrame) -> dict[str, DataFrame]:
        came, failed = written.filter("_error IS NULL").select(F.col("_page").alias("page")).distinct(), written.filter("_error IS NOT NULL").select(F.col("_page").alias("page"), F.col("_error").alias("error"))
        counts.update(came=came.count(), failed=failed.count())
        return {"pages": came, "quarantine": failed}

    table.append_with(got, parts)
    return counts["came"], counts["failed"]


def page_rows(table: Versions) -> DataFrame:
    """The rows of all pages that came."""
    return table.read().filter("NOT _empty").drop("_error", "_empty")


def process(spark: SparkSession, path: str, out: str) -> DataFrame:
    """A source staged as Parquet, and its profile."""
    read(spark, path, detect(spark, path)).write.mode("overwrite").option("compression", "zstd").parquet(out)
    return profile(spark.read.parquet(out))


def write_rows(spark: SparkSession, rows: list[dict], schema: str, path: str) -> int:
    """A few rows of the driver as a table: they go as one JSON parameter and are unpacked by Spark."""
    text = spark.createDataFrame([(json.dumps(rows, default=str),)], "j string")
    text.select(F.explode(F.from_json("j", f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in T._parse_datatype_string(schema).fields)}>>")).alias("r")).select("r.*").write.mode("append").parquet(path)
    return len(rows)


class Warehouse:
    """Facts and dimensions under names, and SELECTs over them."""

    def __init__(self, spark: SparkSession, facts: dict[str, DataFrame], dimensions: dict[str, DataFrame]):
        self.spark, self.names = spark, []
        for prefix, tables in (("fact", facts), ("dim", dimensions)):
            for name, df in tables.items():
                self.names.append(f"{prefix}_{identifier(name)}")
                df.createOrReplaceTempView(self.names[-1])

    def query(self, sql: str, **values: object) -> DataFrame:
        """One SELECT; values are bound, not pasted."""
        if not safe_text(sql).lstrip().lower().startswith(("select", "with")):
            raise ValueError("only a SELECT can be asked")
        return self.spark.sql(sql, args=values)


def storage(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """layer, files, bytes, rows of each directory, listed by Spark's own reader."""
    out = None
    for layer, path in paths.items():
        held = listed(spark, path, "*.parquet").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
        one = held.join(F.broadcast(rows)).select(F.lit(layer).alias("layer"), "files", "bytes", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def as_of(spark: SparkSession, path: str, stale_hours: float, now: str) -> DataFrame:
    """One row: files, as_of (the time of the newest file), hours old at `now`, and whether that is stale."""
    held = listed(spark, path, "*.parquet").agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("as_of"))
    hours = F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("as_of")) / 3600, 2)
    return held.select("files", "as_of", hours.alias("hours"), (hours > stale_hours).alias("stale"))


def tagged_union(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several systems with the system's name; columns meet by name."""
    out = None
    for system, df in frames.items():
        one = df.withColumn("source_system", F.lit(system))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
