"""Labelled training samples from live cycles, history and flight logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.rules import above_thermal_base, is_dark, is_evidence, lift_label
from updraft.operators import terrain as TR
from updraft.operators.joins import salted_join
from updraft.operators.occupants import first_candidates, grid_occupants
from updraft.operators.sampling import systematic_sample
from updraft.operators.weather import WEATHER, prepared, with_weather, with_weather_key
from updraft.plans.features import observation_features

ADDED, NO_WEATHER, DARK, ABOVE_BASE = "added", "no_weather", "dark", "above_base"


def _verdict() -> Column:
    """Why an observation is or is not used."""
    return (F.when(~F.col("__known"), F.lit(NO_WEATHER))
            .when(is_dark(), F.lit(DARK))
            .when(above_thermal_base("alt", "elevation", "thermal_base"), F.lit(ABOVE_BASE))
            .otherwise(F.lit(ADDED)))


def judged_history(beacons: DataFrame, weather: DataFrame, lattice: DataFrame,
                   limit: int | None = 5000, ts: str = "ts", order: str = "seq") -> DataFrame:
    """Feature rows of sampled history with the verdict on each (``reason``).

    One plan: systematic sample of evidence rows, weather per bucket, terrain
    from a 3 x 3 lattice window per distinct centre, and the observation's own
    cell only. ``limit=None`` uses all evidence rows.
    """
    evidence = beacons.filter(is_evidence(null_is_tow=True))
    chosen = evidence if limit is None else systematic_sample(evidence, limit, order)
    rows = chosen.select(F.col(ts).alias("ts"), F.col(order).alias("seq"), "lat", "lon", "alt",
                         "vario", "circling")
    flagged = weather.withColumn("__known", F.lit(True))
    joined = _join_weather(with_weather_key(rows), flagged)
    placed = TR.with_windows(TR.with_centre(joined), lattice, half=1, missing="fill")
    keep = ["seq", "ts", "alt", "thermal_base", "__known", "label"]
    features = observation_features(placed.withColumn("label", lift_label()), 1, keep)
    return features.withColumn("reason", _verdict()).drop("__known")


def _join_weather(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    table = prepared(flagged).select("lat_b", "lon_b", "hour", "__known", *WEATHER)
    joined = salted_join(rows, table, ["lat_b", "lon_b", "hour"], "left")
    return joined.withColumn("__known", F.coalesce("__known", F.lit(False)))


def samples_of(judged: DataFrame) -> DataFrame:
    """The accepted rows in buffer layout."""
    return judged.filter(F.col("reason") == ADDED).select(
        *K.FEATURES, "label", F.col("ts").alias("sample_ts"), "seq")


def run_counters(judged: DataFrame) -> DataFrame:
    """Rows per verdict."""
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def judged_live(live: DataFrame, weather: DataFrame, lattice: DataFrame, cycle: Sequence[str],
                now: str = "now", order: str = "first_seen") -> DataFrame:
    """Feature rows of collection cycles over live tables.

    Per cycle: the first evidence aircraft open grids, every evidence aircraft
    in an open grid is sampled once, at its own cell and altitude, under the
    weather of the aircraft the grid was opened for.
    """
    evidence = live.filter(is_evidence(null_is_tow=False))
    candidates = first_candidates(evidence, cycle, order).select(*cycle, order, "id", "lat", "lon", now)
    lit = with_weather(with_weather_key(candidates, now), weather).withColumn("dark", is_dark())
    occupants = grid_occupants(evidence, lit, cycle, order)
    at_candidate = (occupants.withColumnRenamed("lat", "o_lat").withColumnRenamed("lon", "o_lon"))
    keyed = with_weather_key(at_candidate, now, "c_lat", "c_lon")
    rows = with_weather(keyed, weather).withColumn("lat", F.col("o_lat")).withColumn("lon", F.col("o_lon"))
    centred = TR.with_centre(rows, "g_lat", "g_lon")
    placed = TR.with_windows(centred, lattice, missing="fill").withColumn("label", lift_label())
    keep = [*cycle, "id", "g_id", F.col(now).alias("ts"), F.col(order).alias("seq"), "alt",
            "thermal_base", "label"]
    features = observation_features(placed, TR.HALF_WINDOW, keep, ts=now)
    reason = (F.when(above_thermal_base("alt", "elevation", "thermal_base"), F.lit(ABOVE_BASE))
              .otherwise(F.lit(ADDED)))
    return features.withColumn("reason", reason)


def sample_fixes(fixes: DataFrame, weather: DataFrame, lattice: DataFrame, time: str = "time",
                 order: str = "seq") -> DataFrame:
    """Buffer rows from thinned flight-log fixes (columns time, seq, lat, lon, vario, circling).

    Fixes without archived weather are left out. Height above ground is not part
    of these rows.
    """
    rows = fixes.select(F.col(time).alias("ts"), F.col(order).alias("seq"), "lat", "lon", "vario", "circling")
    joined = with_weather(with_weather_key(rows), weather, strict=True)
    placed = TR.with_windows(TR.with_centre(joined), lattice, half=1, missing="fill")
    features = observation_features(placed.withColumn("label", lift_label()), 1,
                                    ["ts", "seq", "label"], alt=None)
    return features.select(*K.FEATURES, "label", F.col("ts").alias("sample_ts"), "seq")
