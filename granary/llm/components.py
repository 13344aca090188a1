"""Connected components of an edge table by alternating large and small stars.

Each round replaces every node's links by links to its smallest neighbour, first
towards larger neighbours, then towards smaller ones, until all links are stars: a node
has one smaller neighbour, its component, or is that itself. Minima and counts
are summed before they are shuffled, so a node with very many links is no hot group.
Rounds are written to the shared folder, which ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has a > b. Links of each node to the smallest of its neighbours and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # b is the node, a its larger neighbour
        moved = edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = edges.join(least, edges["a"] == least["u"])
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has just one, and no larger neighbours."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (x, y); the component is its smallest node."""
    edges = links.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    edges = written(edges, "edges", files)
    while not _stars(edges):
        edges = written(_star(_star(edges, large=True), large=False), "edges", files)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
