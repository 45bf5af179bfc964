"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile.llm.storage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) of every node of edges (a, b), other than lone ones.

    Every round hangs the neighbours of each node under their least node, first
    the larger ones and then the smaller ones, until all hang under the least of
    their component: a logarithmic number of rounds. Minima are folded where the
    edges are read, and a node with very many edges is split by the skew join.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    tree = cut(edges.where("a <> b").select(high, low).distinct())
    before = None
    while True:
        found = tree.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # two numbers
        if found == before or not found[0]:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = found
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
