"""Joining hourly weather to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions import atmosphere as A
from updraft.functions.geo import hour_of, weather_cell
from updraft.operators.joins import salted_join

WEATHER = ("temp_2m", "humidity", "wind_speed", "wind_dir", "wind_u", "wind_v", "cape", "cin",
           "solar_ghi", "lapse_rate", "thermal_base", "pbl_height", "soil_temp")


def prepared(weather: DataFrame) -> DataFrame:
    """Weather rows with gaps filled per variable and derived columns added.

    Runs on the weather table, once per (cell, hour), before any join.
    """
    keys = [c for c in weather.columns if c not in K.WEATHER_FALLBACK]
    filled = weather.select(*keys, *[
        F.coalesce(c, F.lit(v)).alias(c) for c, v in K.WEATHER_FALLBACK.items()])
    u, v = A.wind_components("wind_speed", "wind_dir")
    return filled.select(
        *keys, "temp_2m", (F.col("humidity_pct") / 100.0).alias("humidity"),
        "wind_speed", "wind_dir", u.alias("wind_u"), v.alias("wind_v"), "cape", "cin", "solar_ghi",
        A.lapse_rate("temp_850", "temp_500").alias("lapse_rate"),
        A.thermal_base("temp_2m", "temp_850").alias("thermal_base"), "pbl_height", "soil_temp")


def _fallback_columns() -> dict[str, object]:
    u, v = A.wind_components(F.lit(K.WEATHER_FALLBACK["wind_speed"]), F.lit(K.WEATHER_FALLBACK["wind_dir"]))
    constants = {**K.WEATHER_FALLBACK, **K.WEATHER_FALLBACK_DERIVED}
    return {c: {"wind_u": u, "wind_v": v}.get(c, F.lit(constants.get(c))) for c in WEATHER}


def with_weather_key(df: DataFrame, ts: str = "ts", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the weather bucket of each row: half-degree cell and UTC hour."""
    return (df.withColumn("lat_b", weather_cell(lat)).withColumn("lon_b", weather_cell(lon))
            .withColumn("hour", hour_of(ts)))


def _attach(df: DataFrame, weather: DataFrame, on: list[str], strict: bool) -> DataFrame:
    joined = salted_join(df, weather.withColumn("__found", F.lit(True)), on,
                         "inner" if strict else "left")
    if strict:
        return joined.drop("__found")
    defaults = _fallback_columns()
    return joined.select(*[
        F.when(F.col("__found"), F.col(c)).otherwise(defaults[c]).alias(c) if c in defaults else F.col(c)
        for c in joined.columns if c != "__found"])


def with_weather(df: DataFrame, weather: DataFrame, strict: bool = False) -> DataFrame:
    """Weather of each row's bucket (lat_b, lon_b, hour).

    A missing hour reads as fixed fallback weather, or drops the row when
    ``strict``: training must not pair real labels with invented weather.
    """
    table = prepared(weather).select("lat_b", "lon_b", "hour", *WEATHER)
    return _attach(df, table, ["lat_b", "lon_b", "hour"], strict)


def forecast_hour(requests: DataFrame, weather: DataFrame) -> DataFrame:
    """Which hour of a cell's forecast answers (now + forecast_h).

    The hour with that very stamp, else the offset from the first hour, limited
    to the array. Input rows: (request_id, lat_b, lon_b, now, forecast_h).
    """
    cell = ["lat_b", "lon_b"]
    target = F.date_trunc("hour", "now") + F.make_dt_interval(hours=F.col("forecast_h"))
    asked = requests.withColumn("target", target)
    extent = weather.groupBy(*cell).agg(
        F.min_by("hour", "hour_index").alias("__first"), F.max("hour_index").alias("__last"))
    exact = weather.groupBy(*cell, F.col("hour").alias("target")).agg(
        F.min("hour_index").alias("__exact"))
    offset = F.rint((F.unix_seconds("target") - F.unix_seconds("__first")) / 3600.0)
    limited = F.greatest(F.lit(0.0), F.least(offset, F.col("__last").cast("double"))).cast("int")
    return (asked.join(extent, cell).join(exact, [*cell, "target"], "left")
            .withColumn("hour_index", F.coalesce("__exact", limited))
            .drop("__first", "__last", "__exact"))


def with_forecast(requests: DataFrame, weather: DataFrame) -> DataFrame:
    """Forecast weather for requests; cells without any forecast use the fallback."""
    chosen = forecast_hour(requests, weather).select("request_id", "hour_index")
    table = prepared(weather).select("lat_b", "lon_b", "hour_index", *WEATHER)
    return _attach(requests.join(chosen, "request_id", "left"), table,
                   ["lat_b", "lon_b", "hour_index"], strict=False)
