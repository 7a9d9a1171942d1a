"""Aerotow detection: which soaring beacons were reported next to a climbing tug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import haversine_m
from updraft.functions.rules import is_soaring
from updraft.operators.blocks import number_block, with_shifted

# A bin must be at least the tow radius high; 0.004 degree is about 445 m.
LAT_BIN = 0.004
BLOCK_ROWS = 1 << 16   # of the feed, which orders a tug's beacons


def _lon_bins(lat_bin: Column) -> Column:
    """Longitude bins around the globe on a bin row, each at least a tow radius wide."""
    band = F.floor(lat_bin * F.lit(LAT_BIN))
    far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) + F.lit(0.01), F.lit(90.0))
    width = F.lit(LAT_BIN) / F.greatest(F.cos(F.radians(far)), F.lit(1e-4))
    return F.floor(F.lit(360.0) / width).cast("bigint")


def _lon_bin(lon: Column, bins: Column, step=0) -> Column:
    return F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(360.0) * bins).cast("bigint") + step, bins)


def tug_intervals(beacons: DataFrame, ts: str = "ts", order: str = "seq") -> DataFrame:
    """Tug beacons with the arrival number of the same tug's next beacon.

    A tug beacon is the tug's latest state from its own arrival until that next
    one, which turns "latest beacon before" into an interval test. Fitness to
    tow is judged afterwards: a descending report hides an earlier climbing one.
    """
    tugs = beacons.filter(F.col("ac_type") == K.TOW_TYPE).select(
        "id", "lat", "lon", "alt", "vario", ts, order)
    return with_shifted(tugs, ["id"], [order], number_block(order, BLOCK_ROWS),
                        {"next_seq": (F.col(order), -1)})


def tow_pairs_condition(g: str = "g", t: str = "t") -> Column:
    """Residual test of a binned (glider, tug interval) candidate."""
    age = F.col(f"{g}.__us") - F.col(f"{t}.t_us")
    return (
        (F.col(f"{t}.t_seq") < F.col(f"{g}.__seq"))
        & (F.col(f"{t}.t_next").isNull() | (F.col(f"{g}.__seq") < F.col(f"{t}.t_next")))
        & (age <= F.lit(int(K.TOW_MAX_AGE_S * 1e6)))
        & (F.abs(F.col(f"{t}.t_alt") - F.col(f"{g}.alt")) <= K.TOW_ALT_DIFF_M)
        & (haversine_m(F.col(f"{g}.lat"), F.col(f"{g}.lon"), F.col(f"{t}.t_lat"), F.col(f"{t}.t_lon"))
           <= K.TOW_RADIUS_M))


def flag_under_tow(beacons: DataFrame, ts: str = "ts", order: str = "seq",
                   tugs: DataFrame | None = None) -> DataFrame:
    """``beacons`` with ``under_tow`` evaluated for every row.

    Gliders look up tugs by (15 s bucket, latitude bin, longitude bin). Tugs are
    few and are repeated into the neighbouring bins; gliders are not. The
    existence test is a semi join, so no candidate pairs leave it, and adaptive
    execution can split a crowded bin on the glider side.

    ``tugs`` adds tug rows from outside ``beacons`` (the tail of an earlier
    micro-batch).
    """
    kept = [c for c in beacons.columns if c != "under_tow"]
    rows = beacons.select(*kept)
    source = rows if tugs is None else rows.unionByName(tugs, allowMissingColumns=True)
    bucket_us = int(K.TOW_MAX_AGE_S * 1e6)

    near = tug_intervals(source, ts, order).filter(F.col("vario") >= K.TOW_MIN_VARIO).select(
        F.col(order).alias("t_seq"), F.col("next_seq").alias("t_next"),
        F.unix_micros(ts).alias("t_us"), F.col("lat").alias("t_lat"),
        F.col("lon").alias("t_lon"), F.col("alt").alias("t_alt"))
    near = (
        near.withColumn("b_t", F.explode(F.sequence(
            F.floor(F.col("t_us") / bucket_us), F.floor(F.col("t_us") / bucket_us) + 1)))
        .withColumn("b_lat", F.explode(F.sequence(
            F.floor(F.col("t_lat") / LAT_BIN) - 1, F.floor(F.col("t_lat") / LAT_BIN) + 1)))
        .withColumn("__bins", _lon_bins(F.col("b_lat")))
        .withColumn("__step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("b_lon", _lon_bin(F.col("t_lon"), F.col("__bins"), F.col("__step")))
        .drop("__bins", "__step"))

    lat_bin = F.floor(F.col("lat") / LAT_BIN)
    soaring = F.coalesce(is_soaring(), F.lit(False))
    gliders = rows.filter(soaring).select(
        *kept, F.unix_micros(ts).alias("__us"), F.col(order).alias("__seq"),
        F.floor(F.unix_micros(ts) / bucket_us).alias("b_t"), lat_bin.alias("b_lat"),
        _lon_bin(F.col("lon"), _lon_bins(lat_bin)).alias("b_lon"))
    g, t = gliders.alias("g"), near.alias("t")
    condition = (
        (F.col("g.b_t") == F.col("t.b_t")) & (F.col("g.b_lat") == F.col("t.b_lat"))
        & (F.col("g.b_lon") == F.col("t.b_lon")) & tow_pairs_condition())
    towed = g.join(t, condition, "left_semi").select(*kept).withColumn("under_tow", F.lit(True))
    free = g.join(t, condition, "left_anti").select(*kept).withColumn("under_tow", F.lit(False))
    other = rows.filter(~soaring).withColumn("under_tow", F.lit(False))
    return towed.unionByName(free).unionByName(other)

