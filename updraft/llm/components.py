"""Connected components of a link table by alternating stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. Here u > v."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (smallest node of its component) of every node in ``links`` (a, b).

    Links may repeat and may join a node to itself; nodes may be of any ordered
    type. Each round halves the depth of the trees at least; it ends when no link
    moves, and fails rather than return parts if ``rounds`` do not suffice.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = written(links, "links")
    state = None
    for _ in range(rounds):
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
    raise RuntimeError("components did not converge")
