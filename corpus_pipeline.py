"""From raw documents to token ids: language, exact copies, near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, which the stage before has written as Parquet. All but the
last return the columns of docs; the last returns doc_id, ids and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenmart.llm import decontaminate, exact_dedup, language_id, near_dedup, piece_lattice
from lumenmart.llm.common import kept, table


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters and those between languages go."""
    return language_id.keep_recognised(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one with the smallest doc_id."""
    return near_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens."""
    import public_tokenizers

    return piece_lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "ids", "n_tokens")


STAGES = [
    ("language_id", recognised), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("sentencepiece", tokens),
]

#: Language models, signatures and segmentations can't be said in SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, name)
    return docs
