"""Weather, time-encoding and unit scalars as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import as_col

TWO_PI = 2.0 * math.pi


def wind_components(speed, direction) -> tuple[Column, Column]:
    """(u, v) of a wind given by speed and the direction it blows from."""
    rad = F.radians(as_col(direction))
    return -as_col(speed) * F.sin(rad), -as_col(speed) * F.cos(rad)


def cyclic(value, period: float) -> tuple[Column, Column]:
    """(sin, cos) encoding of a periodic value."""
    angle = F.lit(TWO_PI) * as_col(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def decode_cyclic(sin_col, cos_col, period: float) -> Column:
    """The periodic value back from its (sin, cos) encoding."""
    angle = F.atan2(as_col(sin_col), as_col(cos_col))
    wrapped = F.when(angle < 0, angle + F.lit(TWO_PI)).otherwise(angle)
    return wrapped / F.lit(TWO_PI) * F.lit(float(period))


def decode_timestamp(hour_sin, hour_cos, doy_sin, doy_cos, year: int) -> Column:
    """UTC timestamp rebuilt from cyclic columns, in an assumed year."""
    hour = decode_cyclic(hour_sin, hour_cos, 24)
    doy = decode_cyclic(doy_sin, doy_cos, 365)
    start = F.unix_micros(F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp"))
    micros = ((doy - F.lit(1.0)) * F.lit(24.0) + hour) * F.lit(3600e6)
    return F.timestamp_micros(start + F.rint(micros).cast("bigint"))


def decimal_hour(ts) -> Column:
    """Hour of day with minutes as a fraction (seconds do not count)."""
    return F.hour(as_col(ts)) + F.minute(as_col(ts)) / F.lit(60.0)


def lapse_rate(temp_850, temp_500) -> Column:
    """Temperature drop per km between the 850 and 500 hPa levels."""
    return (as_col(temp_850) - as_col(temp_500)) / F.lit(3.5)


def thermal_base(temp_2m, temp_850) -> Column:
    """Estimated height of the thermal base above ground, whole metres."""
    gradient = F.greatest(
        F.lit(1.0), (as_col(temp_2m) - as_col(temp_850)) / F.lit(1.5))
    metres = ((as_col(temp_2m) - F.lit(8.0)) / gradient * F.lit(1000.0)).cast("int")
    return F.greatest(F.lit(0), metres)


def height_above_ground(alt, elevation) -> Column:
    """Altitude over the ground, never negative; 0 for an unknown altitude."""
    return F.coalesce(
        F.greatest(F.lit(0.0), as_col(alt).cast("double") - as_col(elevation)), F.lit(0.0))


def feet_to_metres(feet) -> Column:
    return F.rint(as_col(feet) * F.lit(K.METRES_PER_FOOT)).cast("int")


def fpm_to_mps(fpm) -> Column:
    return F.bround(as_col(fpm) * F.lit(K.MPS_PER_FPM), 2)


def knots_to_kmh(knots) -> Column:
    return F.rint(as_col(knots) * F.lit(K.KMH_PER_KNOT)).cast("int")


def rot_to_deg_s(rot) -> Column:
    return as_col(rot) * F.lit(K.DEG_S_PER_HALF_TURN_MIN)


def degrees_minutes(degrees, minutes, hemisphere, negative: str) -> Column:
    """Decimal degrees from whole degrees, decimal minutes and a hemisphere letter."""
    value = as_col(degrees).cast("double") + as_col(minutes).cast("double") / F.lit(60.0)
    return F.when(as_col(hemisphere) == negative, -value).otherwise(value)
