"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The least neighbour of each node is staged before links meet it. So that join has links as they come on one side and one
# row for a node on the other, and adaptive execution splits the links of a node that has very many.


def _large_star(edges: DataFrame, work: Scratch) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = work.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, work: Scratch) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = work.table(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _simple(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, work: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); the root is the least node of its component.

    Nulls and loops are left out. Each step is staged in the shared folder, and goes when the next is there; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = work.table(_simple(edges), "links")
    mark = None
    for _ in range(max_rounds):
        star = work.table(_simple(_large_star(now, work)), "star")
        new = work.table(_simple(_small_star(star, work)), "links")
        work.drop(now, star)
        now, before = new, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
