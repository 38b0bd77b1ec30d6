"""Connected components by repeated large-star and small-star rounds, each a pair of group-bys and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, files_for


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); isolated nodes do not occur.

    A node with very many neighbours is pre-aggregated to its smallest one; the join back is one that Spark can split.
    Rounds end when only stars around smallest nodes are left, so the result is exact whatever the shape of the graph.
    No round has more edges than twice the first, so all tables have as many files as suit those.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    files = files_for(2 * edges.count())
    while True:
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = scratch.table(low, "cc", files)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "cc", files)
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "cc", files)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        small = scratch.table(small.where("a <> b").distinct(), "cc", files)
        # done when all edges are stars around smallest nodes: no centre has a smaller neighbour, no node two centres
        centres = small.select(F.col("b").alias("a")).distinct()
        uneven = small.join(centres, "a", "left_semi").limit(1).count() or (
            small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        )
        edges = small
        if not uneven:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return scratch.table(
        stars.select(F.col("a").alias("node"), "component").unionByName(
            edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        ),
        "cc",
        files,
    )
