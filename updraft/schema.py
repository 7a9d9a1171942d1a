"""Table schemas and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from updraft.constants import FEATURES

BEACONS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("alt", T.IntegerType()),
    T.StructField("vario", T.DoubleType()),
    T.StructField("heading", T.IntegerType()),
    T.StructField("speed_kmh", T.IntegerType()),
    T.StructField("circling", T.BooleanType()),
    T.StructField("ac_type", T.IntegerType()),
    T.StructField("ac_type_name", T.StringType()),
    T.StructField("is_tow", T.BooleanType()),
    T.StructField("under_tow", T.BooleanType()),
])

FIXES = T.StructType([
    T.StructField("flight", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("alt", T.DoubleType()),
    T.StructField("vario", T.DoubleType()),
    T.StructField("turn_rate", T.DoubleType()),
    T.StructField("circling", T.BooleanType()),
])

SAMPLES = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [T.StructField("label", T.IntegerType()),
       T.StructField("sample_ts", T.TimestampType()),
       T.StructField("seq", T.LongType())]
)


class SchemaMismatch(ValueError):
    """A stored table does not have the columns this version of the code reads."""


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    """``df`` unchanged, or SchemaMismatch naming the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaMismatch(f"{what} lacks {', '.join(missing)}")
    return df
