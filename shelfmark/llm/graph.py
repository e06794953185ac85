"""Connected components of an edge table, as a loop of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least value in u's neighbourhood, u included.

    The least values are checkpointed so that both sides of the join are plain exchanges, which Spark splits where a hub
    makes one partition large.
    """
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m"))
                .select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)
    until no edge moves. An edge keeps being one row, so a step is linear in the edges whatever the shape of the graph.
    Empty input gives no rows; self loops and repeated edges are ignored.
    """
    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _star(large)
        after = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        moved = after.join(current, ["u", "v"], "left_anti")
        if after.count() == current.count() and moved.isEmpty():
            break
        current = after
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
