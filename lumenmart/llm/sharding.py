"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A row descends it from the root: at each node every child draws a number in (0, 1)
from a hash of the row's key and the child's name, and the child with the smallest -ln(draw) / weight takes the row, so that
children receive rows in proportion to their weights. A child's draw depends on nothing but key and name. A changed weight
therefore moves rows only into (or out of) the subtree below it, and a new child only takes rows.

A shard added by `grown` opens a region of its own: had it joined an old rack, the heavier region would also attract rows for
that rack's neighbours. All of it is DataFrame expressions; the key alone decides, so nothing is shuffled to place a row.

Slots (gapless numbers within a shard, by key) come from a range partitioning of narrow rows by (shard, key): each range
numbers its own rows and adds the rows of the ranges before it, so no shard is gathered in one task.

Defined results: a null text has size 1 (no bytes, plus 1) and checksum null counted as of the empty text (0); null keys all
draw alike, so they share a shard; rows that repeat a key share a shard and take slots of their own in any order; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.llm.common import kept


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has its number, others have children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int = 16, per_rack: int = 4, racks_per_region: int = 2) -> Node:
    leaves = [Node(f"s{k}", shard=k) for k in range(shards)]
    racks = [Node(f"k{k}", tuple(leaves[i : i + per_rack])) for k, i in enumerate(range(0, shards, per_rack))]
    return Node("root", tuple(Node(f"r{k}", tuple(racks[i : i + racks_per_region])) for k, i in enumerate(range(0, len(racks), racks_per_region))))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    leaf = Node(f"s{shard}", shard=shard, own_weight=weight)
    return Node(root.name, (*root.children, Node(f"r+{shard}", (Node(f"k+{shard}", (leaf,)),))))


def _draw(key: Column, name: str) -> Column:
    """-ln of a number in (0, 1), from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(name))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(1 << 52)))


def place(key: Column, node: Node) -> Column:
    """The shard that the key reaches below node."""
    if not node.children:
        return F.lit(node.shard)
    drawn = [F.struct((_draw(key, c.name) / F.lit(c.weight)).alias("draw"), place(key, c).alias("shard")) for c in node.children]
    return F.array_min(F.array(*drawn))["shard"]


def slots(placed: DataFrame, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """placed with a column `slot`: gapless from 0 within each shard, in key order."""
    n = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = kept(placed.repartitionByRange(n, shard, key).withColumn("_lm_block", F.spark_partition_id()), "slots")
    sizes = ranged.groupBy(shard, "_lm_block").agg(F.count(F.lit(1)).alias("_lm_n"))  # at most shards + ranges rows
    before = sizes.select(shard, "_lm_block", (F.sum("_lm_n").over(Window.partitionBy(shard).orderBy("_lm_block")) - F.col("_lm_n")).alias("_lm_before"))
    within = F.row_number().over(Window.partitionBy(shard, "_lm_block").orderBy(key)) - 1
    return ranged.withColumn("_lm_within", within).join(F.broadcast(before), [shard, "_lm_block"]).withColumn("slot", (F.col("_lm_before") + F.col("_lm_within")).cast("long")).drop("_lm_block", "_lm_within", "_lm_before")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: Node | None = None, more: Node | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    root = root or tree()
    more = more or grown(root, 16)
    text = F.coalesce(docs[text_col], F.lit(""))
    placed = docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = placed.withColumn("shard", place(F.col("doc_id"), root).cast("int")).withColumn("grown_shard", place(F.col("doc_id"), more).cast("int"))
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
