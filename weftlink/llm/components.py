"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges of a node from which on it is a hub, and how many hubs there can be, by raising that number with the count of edges.
HUB, HUBS = 1 << 20, 5000


def beside(both: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """both (a, b) with m of its a, from least (a, m, n). The edges of hubs, which would all meet in one task, stay where they are:
    hubs have more than HUB edges and more than a HUBS-th of all, so that they are few enough to be broadcast."""
    many = max(HUB, edges // HUBS)
    if edges <= many:  # no node can have more
        return both.join(least.select("a", "m"), "a")
    hubs = F.broadcast(materialize(least.where(F.col("n") > many).select("a", "m"), "hubs"))
    return both.join(hubs, "a").unionByName(both.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= many).select("a", "m"), "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b) of longs; root is the smallest node that its edges reach.

    Alternating large-star and small-star rounds: every round rewires edges to the smallest neighbour and is written
    to the shared folder; the rounds end when none changes an edge. Only a count and a checksum reach the driver.
    Loops and rows with a null are left out; no edges give no rows.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = materialize(links, "edges"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        before = state
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = beside(both, least, before[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = beside(large, least, before[0]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
