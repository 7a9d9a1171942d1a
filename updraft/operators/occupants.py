"""Which candidate's grid samples which aircraft."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import snap
from updraft.operators.joins import salted_join


def first_candidates(evidence: DataFrame, cycle: Sequence[str], order: str = "first_seen",
                     limit: int = K.MAX_CANDIDATES) -> DataFrame:
    """The first aircraft of each cycle in feed order (the limit runs before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*cycle).orderBy(order))
    return evidence.withColumn("__n", rank).filter(F.col("__n") <= limit).drop("__n")


def _inside(lat: Column, lon: Column, grid: Column) -> Column:
    r = F.lit(K.GRID_RADIUS)
    return (lat.between(grid["g_lat"] - r, grid["g_lat"] + r)
            & lon.between(grid["g_lon"] - r, grid["g_lon"] + r))


def open_grids(candidates: DataFrame, cycle: Sequence[str], order: str = "first_seen",
               dark: str = "dark") -> DataFrame:
    """Grids that sample in each cycle, as an array in candidate order.

    A candidate inside an earlier open grid is sampled there and opens none; a
    dark one opens none either. At most MAX_CANDIDATES structs per cycle.
    """
    item = F.struct(F.col(order).alias("__o"), F.col("id").alias("g_id"), F.col("lat").alias("__lat"),
                    F.col("lon").alias("__lon"), snap("lat").alias("g_lat"),
                    snap("lon").alias("g_lon"), F.col(dark).alias("__dark"))
    ordered = candidates.groupBy(*cycle).agg(F.array_sort(F.collect_list(item)).alias("__c"))
    nothing = F.filter("__c", lambda c: F.lit(False))

    def step(opened: Column, c: Column) -> Column:
        sampled = F.exists(opened, lambda g: _inside(c["__lat"], c["__lon"], g))
        return F.when(c["__dark"] | sampled, opened).otherwise(F.array_append(opened, c))

    opened = F.aggregate("__c", nothing, step)
    return ordered.select(*cycle, F.transform(opened, lambda g: F.struct(
        g["g_id"].alias("g_id"), g["g_lat"].alias("g_lat"), g["g_lon"].alias("g_lon"),
        g["__lat"].alias("c_lat"), g["__lon"].alias("c_lon"))).alias("grids"))


def grid_occupants(evidence: DataFrame, candidates: DataFrame, cycle: Sequence[str],
                   order: str = "first_seen", dark: str = "dark") -> DataFrame:
    """Every aircraft of a cycle that lies in an open grid, with that grid.

    Each aircraft is sampled once, by the first open grid that holds it. The
    cycle's few grids travel to the aircraft; aircraft never meet each other.
    """
    grids = open_grids(candidates, cycle, order, dark)
    joined = salted_join(evidence, grids, list(cycle), "inner")
    first = F.get(F.filter("grids", lambda g: _inside(F.col("lat"), F.col("lon"), g)), F.lit(0))
    return (joined.withColumn("__g", first).filter(F.col("__g").isNotNull())
            .select(*evidence.columns, "__g.*"))
