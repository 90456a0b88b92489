"""Connected components of a graph held as rows, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    moved = down.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("c", "m")).distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of its component, for each node with an edge to another in ``edges`` (u, v of any ordered type).

    Every round is written and the one before it deleted, so that lineage and disk stay small. The rounds end when no edge moves;
    their number grows with the logarithm of the longest path, and running out of them is an error rather than a partial result.
    """
    print_of = lambda x: x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    edges = scratch.put(edges.select("u", "v").where("u <> v").distinct())
    before = print_of(edges)
    for _ in range(most_rounds):
        after = scratch.put(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges, now = after, print_of(after)
        if before == now:
            roots = scratch.put(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
            scratch.drop(edges)
            return roots
        before = now
    raise RuntimeError("components did not settle")
