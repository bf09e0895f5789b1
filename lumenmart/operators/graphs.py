"""Connected components of graphs of any size and shape, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmart.operators.verify import settled


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of an edge with the least node of its component.

    A round hangs each node's larger neighbours on its least one (large star), then all smaller neighbours (small star); it ends when a round changes nothing. Paths
    shrink to a fraction with every round, so a chain of n takes about log n of them. A node's neighbours are never gathered: its minimum is combined before the
    shuffle and joined back, and a hot node's rows can be split."""
    node = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    alone = node.filter("x = y").select(F.col("x").alias("node"))
    now = settled(node.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
        now, before = settled(small.distinct()), state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    own = now.select(F.col("y").alias("node")).unionByName(alone).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(own.select("node", F.col("node").alias("root")))
