"""Blending observed climbs into a predicted grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import grid_side
from updraft.functions.rules import is_climbing
from updraft.operators.blocks import computed_once

BIN = 0.1
SIDE = grid_side()
TOGETHER = 16    # grids of one centre that share a copy of its boosts


def climb_placements(centres: DataFrame, live: DataFrame, evidence: Column) -> DataFrame:
    """Climbing aircraft inside each grid, in grid coordinates.

    Grids are told apart by their centre (c_i, c_j): requests that snap to one
    centre share one grid and its climbs. A grid is about 0.1 degree wide, so it
    is repeated into the 0.1-degree bins it touches and aircraft look up their
    own bin.
    """
    south = F.col("c_i") * K.TERRAIN_RES - K.GRID_RADIUS
    west = F.col("c_j") * K.TERRAIN_RES - K.GRID_RADIUS
    span = (SIDE - 0.5) * K.GRID_RES

    def bins(first: Column) -> Column:
        return F.sequence(F.floor(first / BIN), F.floor((first + span) / BIN))

    grids = (centres.select("c_i", "c_j").distinct()
             .select("c_i", "c_j", south.alias("__s"), west.alias("__w"),
                     F.explode(bins(south)).alias("__by"))
             .withColumn("__bx", F.explode(bins(F.col("__w")))))
    climbing = live.filter(evidence & is_climbing(K.FUSION_VARIO)).select(
        "lat", "lon", "vario", F.floor(F.col("lat") / BIN).alias("__by"),
        F.floor(F.col("lon") / BIN).alias("__bx"))
    placed = climbing.join(grids, ["__by", "__bx"]).select(
        "c_i", "c_j", ((F.col("lat") - F.col("__s")) / K.GRID_RES).alias("ri"),
        ((F.col("lon") - F.col("__w")) / K.GRID_RES).alias("ci"),
        (F.least(F.col("vario") / 5.0, F.lit(1.0)) * 0.5).alias("strength"))
    return placed.filter((F.col("ri") >= 0) & (F.col("ri") < SIDE)
                         & (F.col("ci") >= 0) & (F.col("ci") < SIDE))


def row_boosts(placements: DataFrame) -> DataFrame:
    """What the climbs add to each grid row: (c_i, c_j, row, boost), one value per column.

    Each aircraft reaches 37 x 37 cells. It is dealt out by the 37 rows it reaches, and
    its cells are made where their row is summed, so that cells do not move. A row's
    array has 201 entries, NULL where nothing reaches.
    """
    tasks = int(placements.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reach(at: str) -> Column:
        centre = F.floor(at).cast("int")
        return F.sequence(F.greatest(centre - K.FUSION_WINDOW, F.lit(0)),
                          F.least(centre + K.FUSION_WINDOW, F.lit(SIDE - 1)))

    # Aircraft crowd in few bins: they are spread before they are multiplied.
    reached = placements.repartition(tasks, *placements.columns).withColumn("row", F.explode(reach("ri")))
    spread = reached.repartition(tasks, "c_i", "c_j", "row").withColumn("col", F.explode(reach("ci")))
    dy, dx = F.col("row") - F.col("ri"), F.col("col") - F.col("ci")
    bump = F.exp(-(dy * dy + dx * dx) / F.lit(2 * K.FUSION_SIGMA ** 2)) * F.col("strength")
    per_cell = spread.groupBy("c_i", "c_j", "row", "col").agg(F.sum(bump).alias("boost"))
    entries = per_cell.groupBy("c_i", "c_j", "row").agg(
        F.collect_list(F.struct("col", "boost")).alias("__e"))
    # Computed once: inside the lambda below, the map would be rebuilt per column.
    by_col = computed_once(entries, __b=F.map_from_entries("__e"))
    columns = F.sequence(F.lit(0), F.lit(SIDE - 1))
    return by_col.select("c_i", "c_j", "row", F.transform(
        columns, lambda c: F.try_element_at(F.col("__b"), c)).alias("boost"))


def grid_boosts(placements: DataFrame) -> DataFrame:
    """``row_boosts`` gathered per grid: (c_i, c_j, boosts row -> values)."""
    return row_boosts(placements).groupBy("c_i", "c_j").agg(
        F.map_from_entries(F.collect_list(F.struct("row", "boost"))).alias("boosts"))


def with_boosts(grids: DataFrame, requests: DataFrame, boosts: DataFrame) -> DataFrame:
    """``grids`` (one row a grid) dealt out over all tasks, each with the ``boosts`` of its centre or NULL.

    A centre's boosts are copied once per 16 of its ``requests``, not once per grid: the
    grids of a centre fall into shares by a hash of their request, and meet their copy where they lie.
    """
    tasks = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ["c_i", "c_j", "__share"]
    shares = requests.groupBy("c_i", "c_j").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("__shares"))
    share = F.pmod(F.xxhash64("request_id"), F.coalesce("__shares", F.lit(1).cast("bigint")))
    placed = grids.join(shares, ["c_i", "c_j"], "left").withColumn("__share", share).drop("__shares")
    copies = boosts.join(shares, ["c_i", "c_j"]).withColumn(
        "__share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__shares") - 1))).drop("__shares")
    return placed.repartition(tasks, *dealt).join(copies.repartition(tasks, *dealt), dealt, "left").drop("__share")


def fused(p_mean: Column, boost: Column) -> Column:
    """Heat of a cell after adding its boost, in [0, 1]."""
    return F.least(F.greatest(p_mean + F.coalesce(boost, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def heat_rows(requests: DataFrame) -> DataFrame:
    """(request_id, row): the grid rows of all requests, dealt out so that their cells meet the climbs in place."""
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = requests.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("row"))
    return rows.repartition(tasks, "request_id", "row")


def fuse_climbs(heat: DataFrame, requests: DataFrame, live: DataFrame, evidence: Column) -> DataFrame:
    """Stored heat cells (request_id, row, col, p_mean) with observed climbs blended in.

    ``requests`` gives each request's centre (request_id, c_i, c_j). What climbs add to a
    grid row goes to the heat's rows as one array; heat that comes dealt out by
    (request_id, row), as ``heat_rows`` deals it, is neither moved nor sorted.
    """
    boosts = requests.select("request_id", "c_i", "c_j").join(
        row_boosts(climb_placements(requests, live, evidence)), ["c_i", "c_j"]).drop("c_i", "c_j")
    tasks = int(heat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = boosts.repartition(tasks, "request_id", "row").hint("shuffle_hash")
    joined = heat.join(dealt, ["request_id", "row"], "left")
    return joined.withColumn("p_mean", fused(
        F.col("p_mean"), F.get(F.col("boost"), F.col("col")))).drop("boost")
