"""Connected components by alternating star contraction, on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long, undirected, a null-free pair). Returns node, root: root is the smallest node that is linked to node.

    Nodes without an edge don't appear. Each round is written, so lineage stays short; the smallest neighbour of a
    node is a plain minimum, combined before the shuffle, so a node with very many links needs no special case. The
    driver sees only the number of changed edges of a round."""
    spark = edges.sparkSession
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges-0")
    if now.isEmpty():
        return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    for i in range(1, MOST_ROUNDS):
        # Large star: all greater neighbours of a node move to its smallest neighbour (or itself).
        both = now.select("v", "u").union(now.select("u", "v")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        # Small star: the smaller neighbours of a node, and itself, move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        after = scratch.save(small.where("v <> u").distinct(), f"edges-{i}")
        # Stars are stable when no node has two smaller neighbours and no centre has one.
        same = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty() if after.count() == now.count() else False
        scratch.drop(f"edges-{i - 1}")
        now = after
        if same:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError("components did not settle")
