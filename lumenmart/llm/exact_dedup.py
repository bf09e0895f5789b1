"""Exact deduplication by skew-safe combining.

Copies meet in three steps, each of which groups by the digest AND the whole normalised text, so that equal digests of
different texts never merge:

1. locally: the map-side half of the first aggregation combines the copies within each input task;
2. salted: (digest, text, salt) groups merge, where the salt follows the task, so that a text that fills a third of the
   corpus meets in `salts` places and not in one;
3. globally: the few salt winners of each text combine.

Only then does the text leave: members find their class by digest in a plain equi-join, which Spark splits where a digest
is hot. Should a digest ever cover two texts, those classes are joined by the text itself.

Defined results: null text counts as empty and is a text like any other, so empty texts are copies of each other; runs of
space, tab, line and page breaks count as one space; null ids sort last and stay only if no copy has an id; rows that repeat
both id and text are returned one by one, of which one is kept; an empty table gives an empty result; other columns of the
input, whatever their names, play no part (`decisions`) or stay as they are (`deduplicate`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmart.llm.common import kept

#: Fixed value: what counts as white space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm")).withColumn("digest", digest(F.col("norm")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each different text: digest, norm, keep_id (smallest id), group_size."""
    salted = (
        _keyed(docs, id_col, text_col, digest)
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _split(docs, id_col, text_col, salts, digest) -> tuple[DataFrame, DataFrame | None]:
    """Classes by digest alone, without texts; and those of digests with several texts (else None), with texts."""
    by_digest = kept(
        classes(docs, id_col, text_col, salts, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        "classes",
    )
    alone, several = by_digest.filter("texts = 1").drop("texts"), by_digest.filter("texts > 1").select("digest")
    if several.isEmpty():
        return alone, None
    hit = _with_columns_of(docs.withColumn("_lm_digest", digest(normalised(docs[text_col]))), several)
    return alone, kept(classes(hit, id_col, text_col, salts, digest), "collisions")


def _with_columns_of(docs: DataFrame, several: DataFrame) -> DataFrame:
    return docs.join(several, docs["_lm_digest"] == several["digest"], "left_semi").drop("_lm_digest")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    alone, collided = _split(docs, id_col, text_col, salts, digest)
    members = _keyed(docs, id_col, text_col, digest)
    # Without the text: rows that repeat id and text are counted, to come back as that many rows.
    narrow = members.select("digest", "id", *([] if digest is sha256 else [sha256(F.col("norm")).alias("sha")]))
    again = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n"))
    found = again.join(alone, "digest")
    if collided is not None:
        rest = members.join(collided.drop("group_size", "keep_id"), ["digest", "norm"], "left_semi").groupBy("digest", "norm", "id").agg(F.count(F.lit(1)).alias("n"))
        rest = rest.join(collided, ["digest", "norm"]).withColumn("sha", sha256(F.col("norm")))
        found = found.unionByName(rest.select(*found.columns)) if "sha" in found.columns else found.unionByName(rest.select("digest", "id", "n", "keep_id", "group_size"))
    sha = F.col("sha") if "sha" in found.columns else F.col("digest")
    each = found.select("id", "keep_id", "group_size", sha.alias("sha"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
    return each.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with all columns of docs. The join is by digest and id, so a hot digest is spread by its ids."""
    alone, collided = _split(docs, id_col, text_col, salts, sha256)
    winners = alone.select("digest", "keep_id")
    if collided is not None:
        winners = winners.unionByName(collided.select("digest", "keep_id"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), sha256(normalised(docs[text_col])).alias("digest"))
    stay = rows.join(winners, (rows["digest"] == winners["digest"]) & rows["id"].eqNullSafe(winners["keep_id"])).select(rows["digest"], "id", "row")
    return stay.dropDuplicates(["digest", "id"]).select("row.*")
