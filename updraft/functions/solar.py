"""Sun position and terrain illumination as Column expressions.

Formulas: the general solar position calculations published by NOAA, a Fourier
series in the fractional year, then the sun vector in the local east-north-up
frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from updraft.functions.atmosphere import TWO_PI, decode_cyclic
from updraft.functions.geo import as_col, clip

# Fourier coefficients (fixed values): constant, then (cos, sin) per harmonic.
EQUATION_OF_TIME = (0.000075, ((0.001868, -0.032077), (-0.014615, -0.040849)))
DECLINATION = (
    0.006918,
    ((-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.001480)),
)
MINUTES_PER_RADIAN_OF_TIME = 229.18


def _fourier(series, gamma: Column) -> Column:
    constant, harmonics = series
    total = F.lit(constant)
    for n, (cos_k, sin_k) in enumerate(harmonics, 1):
        angle = gamma * F.lit(float(n))
        total = total + F.lit(cos_k) * F.cos(angle) + F.lit(sin_k) * F.sin(angle)
    return total


def _positive_mod(value: Column, period: float) -> Column:
    return value - F.lit(period) * F.floor(value / F.lit(period))


def sun_position(lat, lon, doy, hour) -> tuple[Column, Column]:
    """(elevation, azimuth) of the sun in degrees; azimuth is a compass bearing."""
    doy, hour = as_col(doy), as_col(hour)
    gamma = F.lit(TWO_PI / 365.0) * (doy - F.lit(1.0) + (hour - F.lit(12.0)) / F.lit(24.0))
    decl = _fourier(DECLINATION, gamma)
    offset = F.lit(MINUTES_PER_RADIAN_OF_TIME) * _fourier(EQUATION_OF_TIME, gamma)
    solar_minutes = _positive_mod(
        hour * F.lit(60.0) + offset + F.lit(4.0) * as_col(lon), 1440.0)
    angle = F.radians(solar_minutes / F.lit(4.0) - F.lit(180.0))
    phi = F.radians(as_col(lat))
    east = -F.cos(decl) * F.sin(angle)
    north = F.sin(decl) * F.cos(phi) - F.cos(decl) * F.sin(phi) * F.cos(angle)
    up = clip(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle), -1.0, 1.0)
    bearing = F.degrees(F.atan2(east, north))
    azimuth = F.when(bearing < 0, bearing + F.lit(360.0)).otherwise(bearing)
    return F.degrees(F.asin(up)), azimuth


def cos_incidence(slope, aspect, sun_elevation, sun_azimuth) -> Column:
    """Share of the beam a tilted surface receives, in [0, 1]; 0 at night."""
    tilt, facing = F.radians(as_col(slope)), F.radians(as_col(aspect))
    height, bearing = F.radians(as_col(sun_elevation)), F.radians(as_col(sun_azimuth))
    beam = (F.cos(tilt) * F.sin(height)
            + F.sin(tilt) * F.cos(height) * F.cos(bearing - facing))
    return F.when(height <= 0, F.lit(0.0)).otherwise(clip(beam, 0.0, 1.0))


def solar_feature(lat="lat", lon="lon", slope="slope", aspect="aspect",
                  hour_sin="hour_sin", hour_cos="hour_cos",
                  doy_sin="doy_sin", doy_cos="doy_cos") -> Column:
    """Illumination of a stored feature row, from its own columns."""
    hour = decode_cyclic(hour_sin, hour_cos, 24)
    doy = decode_cyclic(doy_sin, doy_cos, 365)
    elevation, azimuth = sun_position(lat, lon, doy, hour)
    return cos_incidence(slope, aspect, elevation, azimuth)

