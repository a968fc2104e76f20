"""Distributed connected components by alternating large-star and small-star steps.

Each step links every neighbour of a node to the smallest node it knows, by a
grouped minimum and a join; the edges stay as many as they were, and after a
logarithmic number of rounds each component is a star around its smallest node.
Every round is a table in the shared folder. Nothing is collected but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step on edges ``a > b``."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    # Neighbours below a node and the node itself all go to the smallest of them.
    kept = edges.join(least, "a").select("a", F.col("m").alias("b")).where("a <> b")
    edges = large.unionAll(kept).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    small = edges.join(least, "a")
    return (
        small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; ``component`` is its smallest reachable node.

    Loops and repeated links do not matter; links with a null end are left out.
    """
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("ok"))
    links = materialize(links.where("ok").select("a", "b").distinct(), "links")
    seen = None
    while True:
        before, links = links, materialize(_star(links), "links")
        discard(before)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
