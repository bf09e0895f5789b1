"""Connected components as Spark joins: smallest label by neighbours, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmart.llm.common import kept, release


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """rows: the number of edges, where it is known. node, root for each node of edges (a, b); root is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours' and then that label's own label, so a chain shrinks by
    halves. Minima combine before the shuffle, so a hub costs no more than its tasks. Self-loops and repeated edges do no harm;
    nulls are left out.
    """
    pairs = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = pairs.union(pairs.select("b", "a")).union(pairs.select("a", "a")).union(pairs.select("b", "b")).distinct()
    both = kept(both, "edges", None if rows is None else 4 * rows)
    n = both.count()
    labels = last = kept(both.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "labels", n)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("root_node"), F.col("root").alias("root_root"))
        new = (
            labels.join(near, labels["node"] == near["a"])
            .join(jump, F.col("near") == F.col("root_node"))
            .select("node", F.least("root", "near", "root_root").alias("new"), F.col("root").alias("old"))
        )
        new = kept(new, "labels", n)
        release(last)
        labels, last = new.select("node", F.col("new").alias("root")), new
        labels.kept_at = new.kept_at
        if new.filter("new <> old").isEmpty():
            release(both)
            return labels
