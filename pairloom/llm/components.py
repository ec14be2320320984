"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pinned


def _star(neighbours: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour (of a node ``u``) points to the smallest node around ``u``."""
    lowest = neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = neighbours.join(lowest, "u")
    if larger_only:
        return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` (``a``, ``b``).

    Nodes are long numbers. Each round is written to the shared folder, so a lost
    executor repeats one round at most; rounds grow with the logarithm of the longest
    chain. A self link gives no row; null ends are ignored; no links give no rows.
    """
    edges = pinned(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True).distinct()
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        edges = pinned(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
