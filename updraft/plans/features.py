"""The 22-column feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions import atmosphere as A
from updraft.functions.geo import clip
from updraft.operators import terrain as TR

LAST = (TR.SIDE - 1) * TR.FINE


def time_features(ts: str | Column) -> list[Column]:
    """Cyclic hour and day-of-year columns of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    hour_sin, hour_cos = A.cyclic(A.decimal_hour(ts), 24)
    doy_sin, doy_cos = A.cyclic(F.dayofyear(ts), 365)
    return [hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"),
            doy_sin.alias("doy_sin"), doy_cos.alias("doy_cos")]


def with_default_landcover(df: DataFrame) -> DataFrame:
    """Constant land-cover columns where no land cover is joined."""
    missing = [c for c in ("land_use_heat", "land_use_albedo") if c not in df.columns]
    values = dict(zip(("land_use_heat", "land_use_albedo"), K.LAND_DEFAULT))
    return df.select("*", *[F.lit(values[c]).alias(c) for c in missing])


def build_features(cells: DataFrame, keys: list[str], ts: str = "ts",
                   alt: str = "alt_amsl") -> DataFrame:
    """Feature rows of grid cells that carry terrain and weather columns.

    ``alt`` is the observer's altitude above sea level; NULL means ground level.
    Time encodings should be attached per request (``time_features``); they are
    added here when the cells do not have them.
    """
    rows = with_default_landcover(cells)
    if "hour_sin" not in rows.columns:
        rows = rows.select("*", *time_features(ts))
    rows = rows.withColumn("alt_agl", A.height_above_ground(alt, "elevation"))
    return rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in K.FEATURES])


def own_cell(lat: str = "lat", lon: str = "lon") -> tuple[Column, Column]:
    """(row, col) of a point in the grid centred on (c_i, c_j)."""
    def index(value: str, centre: str) -> Column:
        low = F.col(centre) * K.TERRAIN_RES - K.GRID_RADIUS
        return clip(F.rint((F.col(value) - low) / F.lit(2 * K.GRID_RADIUS) * LAST), 0, LAST).cast("int")

    return index(lat, "c_i"), index(lon, "c_j")


def observation_features(df: DataFrame, half: int, keep: list[str], ts: str = "ts",
                         alt: str | None = "alt") -> DataFrame:
    """Feature rows of single observations, one cell each.

    ``df`` has the observation (lat, lon, alt, ts), its weather, the grid centre
    (c_i, c_j) and that centre's elevation window. Only the observation's own
    cell is computed; the 201 x 201 grid around it never exists.
    """
    row, col = own_cell()
    placed = df.withColumn("__r", row).withColumn("__c", col)
    elevation, slope, aspect = TR.cell_terrain(
        F.col("elevation_window"), half, F.col("__r"), F.col("__c"), F.col("c_i") * K.TERRAIN_RES)
    step = 2 * K.GRID_RADIUS / LAST
    placed = with_default_landcover(placed)
    terrain = placed.select(
        *[c for c in placed.columns if c not in ("lat", "lon", "elevation_window")],
        F.col("lat").alias("obs_lat"), F.col("lon").alias("obs_lon"),
        (F.col("c_i") * K.TERRAIN_RES - K.GRID_RADIUS + F.col("__r") * step).alias("lat"),
        (F.col("c_j") * K.TERRAIN_RES - K.GRID_RADIUS + F.col("__c") * step).alias("lon"),
        elevation.alias("elevation"), slope.alias("slope"), aspect.alias("aspect"),
        *time_features(ts))
    agl = F.lit(0.0) if alt is None else A.height_above_ground(alt, "elevation")
    return terrain.withColumn("alt_agl", agl).select(
        *keep, *[F.col(c).cast("double").alias(c) for c in K.FEATURES])
