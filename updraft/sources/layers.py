"""Weather JSON, point elevations, and GeoJSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft import constants as K


def weather_rows(df: DataFrame, json: str = "json") -> DataFrame:
    """One row per hour from hourly weather documents.

    A document holds parallel arrays under ``hourly``; its other columns (the
    cell it is for) are kept. Arrays of unequal length are padded with NULL.
    """
    kept = [c for c in df.columns if c != json]
    arrays = ", ".join(f"{name}: array<double>" for name in K.WEATHER_VARIABLES)
    hourly = F.from_json(json, f"hourly struct<time: array<string>, {arrays}>")["hourly"]
    rows = df.select(*kept, hourly.alias("__h")).select(
        *kept, F.posexplode(F.arrays_zip(
            F.col("__h.time").alias("time"),
            *[F.col(f"__h.{name}").alias(column) for name, column in K.WEATHER_VARIABLES.items()],
        )).alias("hour_index", "__r"))
    return rows.select(
        *kept, "hour_index",
        F.try_to_timestamp(F.col("__r.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("hour"),
        *[F.col(f"__r.{c}").alias(c) for c in K.WEATHER_VARIABLES.values()])


def read_point_elevations(spark: SparkSession, path: str) -> DataFrame:
    """Known elevations, keyed by coordinate in units of 1e-4 degree."""
    return spark.read.parquet(path).select("lat_e4", "lon_e4", "elevation")


def merge_elevations(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known elevations updated by fresh ones; one row per point, fresh wins.

    A null elevation from the source means sea level there.
    """
    both = known.select("lat_e4", "lon_e4", "elevation", F.lit(0).alias("__p")).unionByName(
        fresh.select("lat_e4", "lon_e4", F.coalesce("elevation", F.lit(0)).alias("elevation"),
                     F.lit(1).alias("__p")))
    return both.groupBy("lat_e4", "lon_e4").agg(F.max_by("elevation", "__p").alias("elevation"))


def geojson_features(cells: DataFrame, radius: float = K.GRID_RADIUS,
                     rows: int = 201, cols: int = 201) -> DataFrame:
    """One GeoJSON feature per cell worth showing.

    Input: (request_id, row, col, grid_lat, grid_lon, p_mean, thermal_base, cape).
    Polygons are centred on their sample; cells at 0.05 or less are dropped.
    """
    lat_step, lon_step = 2 * radius / (rows - 1), 2 * radius / (cols - 1)
    south = F.col("grid_lat") - radius + F.col("row") * lat_step - lat_step / 2
    west = F.col("grid_lon") - radius + F.col("col") * lon_step - lon_step / 2
    p = F.floor(F.col("p_mean") * 1000 + 0.5) / 1000.0
    placed = cells.select(
        "request_id", "row", "col", south.alias("s"), west.alias("w"),
        (south + lat_step).alias("n"), (west + lon_step).alias("e"),
        p.alias("p"), "thermal_base", "cape").filter("p > 0.05")

    def corner(lon: str, lat: str) -> Column:
        return F.array(F.col(lon), F.col(lat))

    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"),
                   corner("w", "n"), corner("w", "s"))
    return placed.select(
        "request_id", "row", "col",
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
            F.struct(F.col("p").alias("thermal_probability"),
                     F.col("thermal_base").alias("thermal_base_m"),
                     F.floor(F.col("cape") + 0.5).cast("int").alias("cape_j_per_kg")).alias("properties"),
        ).alias("feature"))


def write_geojson(cells: DataFrame, path: str, **grid) -> None:
    """Write features as newline-delimited GeoJSON text."""
    features = geojson_features(cells, **grid)
    features.select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)
