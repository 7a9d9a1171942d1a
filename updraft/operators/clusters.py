"""Greedy proximity clusters of climbing aircraft, in parallel rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.rules import is_climbing
from updraft.session import durable


def _within(radius: float, a: str, b: str) -> Column:
    return ((F.abs(F.col(f"{a}lat") - F.col(f"{b}lat")) < radius)
            & (F.abs(F.col(f"{a}lon") - F.col(f"{b}lon")) < radius))


def _to_neighbours(points: DataFrame) -> DataFrame:
    """Each point once per cell of its 3 x 3 neighbourhood."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (points.withColumn("__a", F.explode(around)).withColumn("__b", F.explode(around))
            .withColumn("c_lat", F.col("c_lat") + F.col("__a"))
            .withColumn("c_lon", F.col("c_lon") + F.col("__b")).drop("__a", "__b"))


def find_seeds(points: DataFrame, scope: Sequence[str], order: str,
               radius: float = K.CLUSTER_RADIUS) -> DataFrame:
    """Seeds of the greedy clustering of ``points`` (columns scope, order, lat, lon).

    In feed order, a point is a seed when no earlier seed is near it. All points
    of one radius-sized cell are near each other, so a cell's earliest open point
    is its only candidate: every point meets at most nine candidates, however
    crowded the cell. A candidate with no earlier open point near it is certain
    to be a seed; each round settles those and closes what they cover, so the open set shrinks.
    """
    cell = [*scope, "c_lat", "c_lon"]
    open_points = durable(points.select(
        *scope, order, "lat", "lon",
        F.floor(F.col("lat") / radius).alias("c_lat"), F.floor(F.col("lon") / radius).alias("c_lon")))
    seeds = None
    while True:
        candidates = open_points.groupBy(*cell).agg(
            F.min_by("lat", order).alias("lat"), F.min_by("lon", order).alias("lon"),
            F.min(order).alias(order))
        rivals = _to_neighbours(candidates).select(
            *cell, F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon"), F.col(order).alias("k_order"))
        blocked = (open_points.join(rivals, cell)
                   .filter((F.col(order) < F.col("k_order"))
                           & (F.abs(F.col("lat") - F.col("k_lat")) < radius)
                           & (F.abs(F.col("lon") - F.col("k_lon")) < radius))
                   .select(*scope, F.col("k_order").alias(order)).distinct())
        found = durable(candidates.join(blocked, [*scope, order], "left_anti"))
        if found.isEmpty():
            return seeds if seeds is not None else found
        seeds = found if seeds is None else seeds.unionByName(found)
        # Only the new seeds close points, and only what is still open is looked at again.
        cover = _to_neighbours(found).select(*cell, F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
        open_points = durable(_near_join(open_points, cover, cell, radius, "s_", "left_anti"))


def _near_join(points: DataFrame, others: DataFrame, cell: Sequence[str], radius: float,
               prefix: str, how: str) -> DataFrame:
    p, o = points.alias("p"), others.alias("o")
    condition = ((F.abs(F.col("p.lat") - F.col(f"o.{prefix}lat")) < radius)
                 & (F.abs(F.col("p.lon") - F.col(f"o.{prefix}lon")) < radius))
    for c in cell:
        condition = condition & (F.col(f"p.{c}") == F.col(f"o.{c}"))
    return p.join(o, condition, how)


def cluster_members(climbing: DataFrame, scope: Sequence[str], order: str,
                    radius: float = K.CLUSTER_RADIUS) -> DataFrame:
    """``climbing`` with the ``seed`` (its order value) each row belongs to."""
    cell = [*scope, "c_lat", "c_lon"]
    climbing = durable(climbing)     # read by the rounds and by the members
    seeds = find_seeds(climbing, scope, order, radius)
    near = _to_neighbours(seeds).select(
        *[F.col(c).alias(f"s_{c}") for c in cell], F.col("lat").alias("s_lat"),
        F.col("lon").alias("s_lon"), F.col(order).alias("seed"))
    rows = climbing.withColumn("c_lat", F.floor(F.col("lat") / radius)).withColumn(
        "c_lon", F.floor(F.col("lon") / radius))
    condition = _within(radius, "", "s_") & (F.col("seed") <= F.col(order))
    for c in cell:
        condition = condition & (F.col(c) == F.col(f"s_{c}"))
    return (rows.join(near, condition)
            .groupBy(*scope, order, "lat", "lon", "alt", "vario").agg(F.min("seed").alias("seed")))


def cluster_summary(members: DataFrame, scope: Sequence[str], rounded: bool = True) -> DataFrame:
    """Centre, mean climb, size and mean altitude of each cluster."""
    summary = members.groupBy(*scope, "seed").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("vario").alias("avg_vario"),
        F.count(F.lit(1)).alias("count"), F.avg("alt").alias("est_alt_m"))
    if not rounded:
        return summary
    return summary.select(
        *scope, "seed", F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"),
        F.bround("avg_vario", 2).alias("avg_vario"), "count",
        F.rint("est_alt_m").cast("int").alias("est_alt_m"))


def cluster_climbs(live: DataFrame, evidence: Column, scope: Sequence[str] = (),
                   order: str = "first_seen", radius: float = K.CLUSTER_RADIUS,
                   min_vario: float = K.CLUSTER_VARIO, rounded: bool = True) -> DataFrame:
    """Active-lift clusters of a live table; ``order`` is the feed order, unique per scope."""
    climbing = live.filter(evidence & is_climbing(min_vario)).select(
        *scope, order, "lat", "lon", "alt", "vario")
    return cluster_summary(cluster_members(climbing, scope, order, radius), scope, rounded)
