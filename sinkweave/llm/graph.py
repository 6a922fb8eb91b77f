"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rekeyed, unsized


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre (v) or has exactly one of them (u)."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0), F.lit(1)))
    return roles.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 OR a > 0 AND b > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given by its first two columns.

    Returns (node, component), one row for each node that has an edge to another node; the component is the
    smallest node of it. Loops, repeated edges and nulls have no effect. An empty graph gives an empty table.

    Each round shuffles the edges only; a hub's edges are never gathered in one row: the minimum is
    pre-aggregated, shuffled and joined back, in partitions that Spark can split (see ``rekeyed``). Rounds grow with the logarithm of the graph's diameter.
    """
    a, b = (edges[c] for c in edges.columns[:2])
    edges = edges.select(a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = unsized(cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    while not _are_stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = rekeyed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = rekeyed(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = unsized(cut(small.distinct()))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
