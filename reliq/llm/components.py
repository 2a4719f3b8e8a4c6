"""Connected components of an edge list by alternating large and small stars, each round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.llm.store import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these; ``edges`` point from larger to smaller."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), the component being its smallest node.

    Each node ends as a leaf of one star. Minima combine before the shuffle, so a hub costs no more than its edges; rounds
    grow with the logarithm of the longest chain. Loops are ignored; no edges give an empty table.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # Stars already: every node points to one smaller node and no node that is pointed to points on.
    while not _is_stars(now):
        now = stored(_small_star(_large_star(now).distinct()), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_stars(edges: DataFrame) -> bool:
    """Whether no node of the directed edges is both source and target, or source twice."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    bad = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out = 1 AND into = 1)")
    return bad.isEmpty()
