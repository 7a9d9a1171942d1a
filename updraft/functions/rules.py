"""Predicates, labels and score heuristics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import as_col, clip, in_box


def type_name(ac_type) -> Column:
    """Name of an aircraft type code."""
    pairs = [F.lit(v) for item in K.AIRCRAFT_TYPE_NAMES.items() for v in item]
    return F.element_at(F.create_map(*pairs), as_col(ac_type).cast("int"))


def is_admitted(ac_type="ac_type") -> Column:
    """Types allowed into the system at all (an allow-list)."""
    return as_col(ac_type).isin(*K.ADMITTED_TYPES)


def is_soaring(ac_type="ac_type", types=K.SOARING_TYPES) -> Column:
    """Aircraft that climb on lift alone."""
    return as_col(ac_type).isin(*types)


def is_evidence(null_is_tow: bool, ac_type="ac_type", under_tow="under_tow") -> Column:
    """Climb attributable to lift: soaring and not on a rope.

    Live rows read a missing ``under_tow`` as false (``null_is_tow=False``);
    stored history reads it as "never evaluated" and drops the row
    (``null_is_tow=True``).
    """
    towed = F.coalesce(as_col(under_tow), F.lit(null_is_tow))
    return F.coalesce(is_soaring(ac_type), F.lit(False)) & ~towed


def is_climbing(min_vario: float, circling="circling", vario="vario") -> Column:
    """Circling and climbing faster than a threshold."""
    return F.coalesce(as_col(circling) & (as_col(vario) > F.lit(float(min_vario))), F.lit(False))


def lift_label(circling="circling", vario="vario", threshold: float = K.LABEL_VARIO) -> Column:
    """1 for observed lift, else 0."""
    return is_climbing(threshold, circling, vario).cast("int")


def plausible_coordinates(lat="lat", lon="lon", box=(-90.0, 90.0, -180.0, 180.0)) -> Column:
    """Coordinates inside the configured box rather than grid indices."""
    return in_box(lat, lon, box)


def is_dark(solar_ghi="solar_ghi") -> Column:
    """Too little sun for any surface heating."""
    return as_col(solar_ghi) < F.lit(K.MIN_SOLAR_GHI)


def above_thermal_base(alt, ground, base) -> Column:
    """Flying above the estimated thermal base (a missing base never rejects)."""
    known = as_col(base).isNotNull() & (as_col(base) > 0)
    return F.coalesce(
        known & ((as_col(alt) - as_col(ground)) > (as_col(base) + F.lit(K.BASE_MARGIN_M))),
        F.lit(False))


def airborne(agl="agl", speed_kmh="speed_kmh") -> Column:
    """Height decides where known, then speed, else keep."""
    return (F.when(as_col(agl).isNotNull(), as_col(agl) > K.AIRBORNE_AGL_M)
            .when(as_col(speed_kmh).isNotNull(), as_col(speed_kmh) > K.AIRBORNE_KMH)
            .otherwise(F.lit(True)))


def terrain_multiplier(elevation="elevation", slope="slope", aspect="aspect") -> Column:
    """Per-cell terrain factor: sun-facing, steep and elevated ground gains."""
    facing = F.lit(0.75) + F.lit(0.25) * F.cos(F.radians(as_col(aspect) - F.lit(180.0)))
    steep = clip(F.lit(1.0) + as_col(slope) / F.lit(45.0), 1.0, 1.4)
    high = clip(F.lit(1.0) + as_col(elevation) / F.lit(800.0), 1.0, 1.25)
    return facing * steep * high


def weather_score(cape="cape", cin="cin", solar_ghi="solar_ghi") -> Column:
    """Weather half of the physics score, in [0, 1]."""
    energy = clip(as_col(cape) / F.lit(1500.0), 0.0, 1.0)
    heating = F.lit(0.4) + F.lit(0.6) * clip(as_col(solar_ghi) / F.lit(600.0), 0.0, 1.0)
    release = clip(F.lit(1.0) - F.abs(as_col(cin)) / F.lit(200.0), 0.0, 1.0)
    return energy * heating * release


def physics_probability(cape="cape", cin="cin", solar_ghi="solar_ghi",
                        multiplier: Column | None = None) -> Column:
    """Lift probability without a trained model."""
    if multiplier is None:
        multiplier = terrain_multiplier()
    return clip(weather_score(cape, cin, solar_ghi) * multiplier, 0.0, 1.0)


def round_probability(value) -> Column:
    """Probability at the precision that is sent out (half to even)."""
    return F.bround(as_col(value), K.PROB_DP)
