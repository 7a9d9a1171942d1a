"""Spatial and lattice arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from updraft import constants as K

ColumnLike = Column | str


def as_col(value) -> Column:
    """A Column from a Column, a column name or a number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value, low: float, high: float) -> Column:
    """``value`` limited to [low, high]."""
    return F.least(F.greatest(as_col(value), F.lit(float(low))), F.lit(float(high)))


def lattice_index(value, res: float = K.TERRAIN_RES) -> Column:
    """Integer index of the lattice point nearest to a coordinate (half to even)."""
    return F.rint(as_col(value) / F.lit(res)).cast("bigint")


def snap(value, res: float = K.TERRAIN_RES) -> Column:
    """Coordinate of the nearest lattice point, at 6 decimals."""
    return F.round(F.rint(as_col(value) / F.lit(res)) * F.lit(res), 6)


def grid_side(radius: float = K.GRID_RADIUS, res: float = K.GRID_RES) -> int:
    """Points per axis of a grid that includes both edges."""
    return round(2 * radius / res) + 1


def grid_index(lat, lon, south, north, west, east, rows: int, cols: int) -> Column:
    """Row-major cell index of a point in a grid, NULL outside it."""
    lat, lon = as_col(lat), as_col(lon)
    south, north, west, east = (as_col(v) for v in (south, north, west, east))
    row = F.rint((lat - south) / (north - south) * F.lit(rows - 1))
    col = F.rint((lon - west) / (east - west) * F.lit(cols - 1))
    inside = lat.between(south, north) & lon.between(west, east)
    cell = clip(row, 0, rows - 1) * F.lit(cols) + clip(col, 0, cols - 1)
    return F.when(inside, cell.cast("bigint"))


def centre_index(rows: int, cols: int) -> int:
    """Row-major index of a grid's middle cell."""
    return (rows // 2) * cols + cols // 2


def prior_cell(value) -> Column:
    """Cell index of a coordinate in the climb-prior lattice (floor)."""
    return F.floor(as_col(value) / F.lit(K.PRIOR_RES)).cast("bigint")


def hour_of(ts) -> Column:
    """UTC hour bucket of a timestamp."""
    return F.date_trunc("hour", as_col(ts))


def weather_cell(value) -> Column:
    """Nearest half degree."""
    return F.rint(as_col(value) * F.lit(2.0)) / F.lit(2.0)


def point_key(value, dp: int) -> Column:
    """Integer key of a coordinate rounded to ``dp`` decimals."""
    return F.rint(as_col(value) * F.lit(float(10 ** dp))).cast("bigint")


def tile_name(lat, lon, size: int = K.TILE_DEG) -> Column:
    """Name of the land-cover tile holding a point: its south-west corner."""
    def corner(value):
        return (F.floor(as_col(value) / F.lit(float(size))) * F.lit(size)).cast("bigint")

    def label(value, positive, negative, width):
        sign = F.when(value >= 0, F.lit(positive)).otherwise(F.lit(negative))
        return F.concat(sign, F.lpad(F.abs(value).cast("string"), width, "0"))

    return F.concat(label(corner(lat), "N", "S", 2), label(corner(lon), "E", "W", 3))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_lat = F.sin((p2 - p1) / F.lit(2.0))
    half_lon = F.sin(F.radians(as_col(lon2) - as_col(lon1)) / F.lit(2.0))
    chord = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2.0 * K.EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def screen_xy(lat, lon, south, north, west, east, rows: int, cols: int) -> tuple[Column, Column]:
    """Screen cell of a point: x grows east, y grows south, both clamped.

    Halves round up, as a screen rounds them.
    """
    x = F.floor((as_col(lon) - as_col(west)) / (as_col(east) - as_col(west))
                * F.lit(cols - 1) + F.lit(0.5))
    y = F.floor((as_col(north) - as_col(lat)) / (as_col(north) - as_col(south))
                * F.lit(rows - 1) + F.lit(0.5))
    return clip(x, 0, cols - 1).cast("int"), clip(y, 0, rows - 1).cast("int")


def group_id(doy, lat, lon) -> Column:
    """Packed id of (day of year, half-degree cell): one decision context."""
    n_lat = 180 * K.CELLS_PER_DEGREE + 1
    n_lon = 360 * K.CELLS_PER_DEGREE + 1
    per = F.lit(float(K.CELLS_PER_DEGREE))
    lat_i = clip(F.rint((as_col(lat) + F.lit(90.0)) * per), 0, n_lat - 1).cast("bigint")
    lon_j = clip(F.rint((as_col(lon) + F.lit(180.0)) * per), 0, n_lon - 1).cast("bigint")
    day = F.pmod(F.rint(as_col(doy)).cast("bigint"), F.lit(365))
    return (day * F.lit(n_lat) + lat_i) * F.lit(n_lon) + lon_j


def in_box(lat, lon, box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)) -> Column:
    """Inside (lat_min, lat_max, lon_min, lon_max), edges included."""
    south, north, west, east = box
    return as_col(lat).between(south, north) & as_col(lon).between(west, east)


def extrapolated(lat, lon, heading, speed_kmh, circling, age_s) -> tuple[Column, Column]:
    """Dead-reckoned position of an aircraft ``age_s`` after its last fix.

    Circling, slow, unknown-track or stale aircraft stay where they reported.
    """
    lat, lon = as_col(lat), as_col(lon)
    heading, speed, age = as_col(heading), as_col(speed_kmh), as_col(age_s)
    usable = (
        ~F.coalesce(as_col(circling), F.lit(False))
        & heading.isNotNull() & speed.isNotNull() & age.isNotNull()
        & (speed >= K.EXTRAPOLATE_MIN_KMH)
        & (age > 0) & (age <= K.EXTRAPOLATE_MAX_S)
    )
    metres = speed / F.lit(3.6) * age
    track = F.radians(heading.cast("double"))
    shrink = F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    new_lat = lat + metres * F.cos(track) / F.lit(K.METRES_PER_DEGREE)
    new_lon = lon + metres * F.sin(track) / (F.lit(K.METRES_PER_DEGREE) * shrink)
    return F.when(usable, new_lat).otherwise(lat), F.when(usable, new_lon).otherwise(lon)
