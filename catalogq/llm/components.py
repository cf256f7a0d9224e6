"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.llm.scratch import drop, store


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = _least(edges)
    others = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Null ends and loops are left out. A hot node costs one aggregated row per task and a
    join that adaptive execution can split; each round is written to the shared folder, so
    a lost executor costs one round. Ends when the edges are stars, after a number of
    rounds that grows with the logarithm of the nodes; edges that are stars already cost none.
    """
    real = edges.where("a is not null and b is not null and a <> b")
    now, path = store(real.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(now):
        after, after_path = store(small_star(large_star(now)), "edges")
        drop(now.sparkSession, path)
        now, path = after, after_path
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has one smaller neighbour, or only larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").agg(F.count("*")).first()[0] == 0
