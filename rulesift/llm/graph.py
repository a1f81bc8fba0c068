"""Connected components of an edge table, by alternating star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours move to its least neighbour (or itself).
    Small star: a node and its smaller neighbours move to the least of them."""
    if large:
        near = edges.select("u", "v").union(edges.select("v", "u"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the least node of its component.

    Each round is written to the shared scratch folder; rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        edges = materialize(_star(_star(edges, large=True), large=False), "edges")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now
