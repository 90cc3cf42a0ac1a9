"""Connected components over a table of links, with equi-joins and minimum aggregates only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _to_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One large-star (neighbours above the node) or small-star (the node and those below) step; rows may repeat."""
    both = edges if not larger_only else edges.unionByName(edges.select(F.col("component").alias("node"), F.col("node").alias("component")))
    # edges hold node > component; large-star looks at all neighbours of a node, small-star at the smaller ones
    least = both.groupBy("node").agg(F.min("component").alias("_m")).select("node", F.least("node", "_m").alias("_m"))
    joined = both.join(least, "node")
    if larger_only:
        out = joined.where(F.col("component") > F.col("node")).select(F.col("component").alias("node"), F.col("_m").alias("component"))
    else:
        out = joined.select(F.col("component").alias("node"), F.col("_m").alias("component")).unionByName(least.select("node", F.col("_m").alias("component")))
    return out.where("node > component")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and that one has none."""
    ends = edges.select("node", "component", F.lit(0).alias("below")).unionByName(
        edges.select(F.col("component").alias("node"), F.lit(None).cast(edges.schema["component"].dataType).alias("component"), F.lit(1).alias("below"))
    )
    of = ends.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("below").alias("below"))
    return of.where("low < high OR (low IS NOT NULL AND below = 1)").isEmpty()


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node that reaches a smaller one. The
    smallest nodes themselves and nodes without links have no row.

    Alternating large-star and small-star until only stars are left; rounds grow with the logarithm of a component's
    diameter. No group is gathered: a node with very many links only takes part in a minimum and in an equi-join. keep
    stores the rows of a round and cuts their lineage; links are read several times, so they should be stored as well.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    if _are_stars(edges):
        return keep(edges.distinct())
    while True:
        edges = keep(_to_minimum(_to_minimum(edges, True), False).distinct())
        if _are_stars(edges):
            return edges
