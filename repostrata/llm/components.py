"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repostrata.session import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is its smallest node.

    Each round ties larger neighbours to the smallest node around (large star), then the
    smaller ones (small star); the number of rounds grows with the logarithm of the longest
    chain. Nodes with many links never meet in one task: minima are combined before the
    shuffle, and the joins have one row per node on one side. Rounds are written to the
    shared folder, where only the last one stays. Links of a node with itself and null ends
    are ignored.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = links.where("a is not null and b is not null")
    edges, path = stored(links.where("a <> b").select(high, low).distinct())
    while not _starred(edges):
        done = path
        edges, path = stored(_small_star(_large_star(edges)))
        discard(edges.sparkSession, done)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _starred(edges: DataFrame) -> bool:
    """Whether all larger ends have one link and none of them is a smaller end: rounds would change nothing."""
    ends = edges.selectExpr("a as node", "1L as up", "0L as down").unionByName(edges.selectExpr("b as node", "0L as up", "1L as down"))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).where("n > 1").isEmpty()


def _digest(edges: DataFrame) -> tuple:
    # Edges are distinct, so two hashes tell tables apart; a sum of longs would overflow.
    hashed = [F.bit_xor(F.xxhash64(F.lit(seed), "a", "b")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *hashed).head())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
