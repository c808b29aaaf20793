"""Connected components of a graph of integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its
    smallest node.

    Alternates the large-star and small-star steps: each connects the neighbours of a node
    to its smallest neighbour, first the larger ones, then the smaller ones. Edge counts
    never grow, minima combine before the shuffle, and the number of rounds is logarithmic.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = cut_lineage(pair.distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        turned = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(turned.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
