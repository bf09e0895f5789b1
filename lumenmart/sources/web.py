"""A web source as a Spark data source: numbered pages, read in ranges by tasks, in one go or as a stream whose checkpoint knows the next page.

Results: a page without rows, or one that failed, is one row with nulls, marked `_empty`, and `_error` where it failed; nothing that a page raises stops the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumenmart.sources.files import load_pages
from lumenmart.sources.versions import Versions, stream_id

MARKS = "_page long, _error string, _empty boolean"


class Range(InputPartition):
    """Pages from `start` up to, without, `end`."""

    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _Pages:
    """What a reader in one go and one of a stream share."""

    def __init__(self, fetch: Callable[[dict], list[dict]], total: Callable[[], int], names: list[str], per_task: int):
        self.fetch, self.total, self.names, self.per_task = fetch, total, names, per_task

    def ranges(self, start: int, end: int) -> list[Range]:
        return [Range(k, min(k + self.per_task, end)) for k in range(start, end, self.per_task)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for page in range(partition.start, partition.end):
            try:
                rows, error = list(self.fetch({"page": page})), None
            except Exception as e:
                rows, error = [], f"{type(e).__name__}: {e}"
            for r in rows or [{}]:
                yield (*[r.get(n) for n in self.names], page, error, not rows)


class _AllPages(_Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(0, self.total()) or [Range(0, 0)]


class _NewPages(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.total()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start["page"], end["page"])


def register_pages(spark: SparkSession, name: str, fetch: Callable[[dict], list[dict]], total: Callable[[], int], schema: str, per_task: int = 16) -> str:
    """Makes a source known to `spark.read.format(name)` and `spark.readStream.format(name)`.

    fetch({"page": k}) gives the rows of a page, total() how many pages there are now; both go to the workers, so they hold only what can be sent there."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    whole = f"{schema}, {MARKS}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return whole

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _AllPages(fetch, total, names, per_task)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _NewPages(fetch, total, names, per_task)

    spark.dataSource.register(Source)
    return name


def load_stream(spark: SparkSession, name: str, table: Versions, checkpoint: str) -> None:
    """Appends the pages that came since the checkpoint. Rows, pages that came and pages put aside (parts `data`, `pages`, `quarantine`, as of `load_pages`) are one version
    a batch, marked by its number: a batch that runs again changes nothing, and under a new checkpoint the table says which pages it has."""

    def one(batch: DataFrame, number: int) -> None:
        done = table.read("pages")
        new = batch if done is None else batch.join(done.withColumnRenamed("page", "_page"), "_page", "left_anti").select(batch.columns)

        def parts(written: DataFrame) -> dict[str, DataFrame]:
            page = F.col("_page").alias("page")
            return {"pages": written.filter("_error IS NULL").select(page).distinct(), "quarantine": written.filter("_error IS NOT NULL").select(page, F.col("_error").alias("error"))}

        table.append_with(new, parts, (stream_id(batch.sparkSession, checkpoint), number))

    spark.readStream.format(name).load().writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retry(spark: SparkSession, table: Versions, fetch: Callable[[dict], list[dict]], schema: str) -> tuple[int, int]:
    """Asks again for the pages that were put aside and have not come since: (pages that came, pages that failed again)."""
    aside = table.read("quarantine")
    return (0, 0) if aside is None else load_pages(aside.select("page").distinct(), fetch, table, schema)
