import hashlib
import math
import zlib

from pyspark.sql import functions as F

from lumenmart.llm import sharding


def descend(key, node):
    """The shard that a key reaches, by hand."""
    while node.children:
        draws = [(-math.log((int(hashlib.md5(f"{key}|{c.name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / c.weight, k) for k, c in enumerate(node.children)]
        node = node.children[min(draws)[1]]
    return node.shard


def test_law_key_and_slots(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id")).alias("text"), F.lit(1).alias("shard"))
    rows = sharding.shard(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append((r.doc_id, r.slot))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        assert r.shard == descend(r.doc_id, sharding.tree()) and r.grown_shard == descend(r.doc_id, sharding.grown(sharding.tree(), 16))
        assert r["size"] == len(f"é{r.doc_id}".encode()) + 1 and r.text_crc32 == zlib.crc32(f"é{r.doc_id}".encode())
    assert set(by) == set(range(16)) and all(150 < len(v) < 350 for v in by.values())
    assert all([s for _, s in sorted(v)] == list(range(len(v))) for v in by.values())
    assert 100 < sum(r.grown_shard == 16 for r in rows) < 400


def test_a_weight_moves_rows_only_into_its_subtree(spark):
    from dataclasses import replace

    old = sharding.tree()
    rack = old.children[0].children[1]
    leaf = replace(rack.children[2], own_weight=3.0)
    heavy = replace(rack, children=(*rack.children[:2], leaf, *rack.children[3:]))
    new = replace(old, children=(replace(old.children[0], children=(old.children[0].children[0], heavy)), old.children[1]))
    both = spark.range(3000).select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).collect()
    region = set(range(8))
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    assert moved and all(b in region for _, b in moved)
    assert all(b == 6 for a, b in moved if a in {4, 5, 6, 7})


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (None, "x")], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 2] and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sorted(r.slot for r in rows if r.doc_id == 1)[1] - sorted(r.slot for r in rows if r.doc_id == 1)[0] == 1
    assert sharding.shard(docs.limit(0)).count() == 0
