"""What the corpus operators share: tables, the shared folder and columns with names of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="lumenmart-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lumenmart-{what}-{uuid.uuid4().hex}"


#: Rows of a file of `kept` where the number of rows is known.
FILE_ROWS = 200_000


def kept(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    rows: about how many come, for tables of narrow rows that little work makes: they are written in as many files as they fill, not in one a partition."""
    path = scratch(df.sparkSession, what)
    df = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def release(*tables: DataFrame | None) -> None:
    """Deletes what `kept` has written for these tables; only for those that no table still to be computed reads."""
    for path, spark in [(t.kept_at, t.sparkSession) for t in tables if t is not None and "kept_at" in vars(t)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept_by(df: DataFrame, what: str, *keys: str) -> DataFrame:
    """As `kept`, with the rows in buckets by keys: joins by them find these rows where they are and shuffle only the other side."""
    spark = df.sparkSession
    name = f"lumenmart_{what}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, what)).bucketBy(buckets, *keys).saveAsTable(name)
    return spark.table(name)
