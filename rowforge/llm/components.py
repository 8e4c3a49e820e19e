"""Connected components of an undirected graph of long ids, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the smallest id in the node's neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(_lowest(both).withColumn("low", F.least("a", "low")), "low")
    hung = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return materialize(hung.filter("a <> b").distinct(), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    low = materialize(_lowest(edges), "low")
    hung = edges.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return materialize(hung.union(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    ``edges`` has long columns ``a`` and ``b``. Large-star and small-star rounds alternate until nothing
    changes, a number of rounds that grows with the logarithm of the longest path. Every state is a table
    in shared storage, so a lost executor costs one round. A node with very many neighbours is a skewed
    join key between two plain exchanges, which adaptive execution splits; no step collects a
    neighbourhood. Self loops and repeated edges are harmless; no edges give an empty result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = _small_star(_large_star(edges))
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
