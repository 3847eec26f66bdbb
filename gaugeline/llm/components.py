"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) of every node that a link (a, b) names; the root is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour; the rounds needed grow with the logarithm of the number of nodes. A round is
    written before the next begins. Rounds end when the links are stars round the roots, so
    that a round changes nothing. No group of links is ever gathered: a node's minimum is
    partially aggregated and joined back.
    """
    edges = scratch.settle(links.where("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), f"{name}0")
    state, number = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(edges.select("y", "y")).distinct()
        state = tuple(now)
        both = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).union(edges.select("y", "x"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("x"), F.col("m").alias("y")).distinct()
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(small, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        number += 1
        edges = scratch.settle(moved.union(small.select("x", F.col("m").alias("y"))).distinct(), f"{name}{number}")
        scratch.drop(f"{name}{number - 1}")
