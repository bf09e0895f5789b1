import hashlib
import re

from pyspark.sql import functions as F

from lumenmart.llm import exact_dedup

ROWS = [
    (5, "a  b", "x"), (3, "a b", "y"), (9, "a\tb", "z"), (4, None, "n"), (8, "", "n"), (7, "A b", "q"), (6, "long " * 30_000, "l"), (2, "long " * 30_000, "l"),
    (11, "a b", "u"), (12, "twin", "t"), (12, "twin", "t"), (None, "a b", "none"), (None, "only", "none"),
]
SCHEMA = "doc_id long, text string, digest string"


def brute(rows):
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = min(known) if known else None, True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_decisions(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, exact_dedup.decisions(docs).collect()), key=str) == brute(ROWS)


def test_full_texts_decide_where_digests_collide(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    weak = exact_dedup.decisions(docs, digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 0))
    assert sorted(map(tuple, weak.collect()), key=str) == brute(ROWS)


def test_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([3, 4, 7, 2, 11, 12, None], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.decisions(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0
