"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("m").alias("a"), F.col("b"))
        .where("a <> b")
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
        .where("a <> b")
        .union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its least node.

    Each round halves the depth at least; no list of neighbours is ever collected, and the
    edge table is written between rounds, so lineage stays short.
    """
    edges = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if now["n"] == 0 or now == mark:
            break
        mark = now
        edges = materialize(small_star(large_star(edges)).distinct())
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
