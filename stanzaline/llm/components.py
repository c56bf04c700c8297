"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours hang on the least of a node's neighbourhood.

    ``large`` moves a node's larger neighbours, else its smaller ones and the node itself. The least is
    aggregated before the shuffle; the join with it can be split where a node is hot.
    """
    near = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("low"))
    joined = near.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct()
    moved = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionAll(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    hung = edges.groupBy("a").agg(F.count("*").alias("n"))
    several = hung.where("n > 1").select("a")
    chained = edges.select("b").distinct().join(hung.select(F.col("a").alias("b")), "b").select(F.col("b").alias("a"))
    return several.unionAll(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its least node.

    Alternates large and small stars, each round written to the shared folder, until every node hangs on
    its component's least node. Rounds grow with the logarithm of the longest path; edges that are stars
    already need none.
    """
    edges = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        edges = common.materialize(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
