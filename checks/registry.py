"""Registration of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import view, with_views
from updraft.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EPOCH = 1718956800   # 2024-06-21 08:00:00 UTC, start of the compressed clock
YEAR_START = 1704067200   # 2024-01-01 00:00:00 UTC


def query(name: str, views=(), sql: str | None = None):
    """Register a function of (read) as a query; ``read(view)`` gives a DataFrame, on request a streaming one."""
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda v, stream=False: prepared(spark, sf_dir, v, stream))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return register


def prepared(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A view with the timestamp columns the operators read."""
    df = view(spark, sf_dir, name, stream)
    if name in ("aprs_lines", "igc_lines"):
        # Stands for a table of raw text lines: the text is built once, then parsed.
        return durable(df)
    if name == "beacons":
        df = df.withColumn("ts", F.timestamp_seconds(F.lit(EPOCH) + F.col("t_dense_s"))).withColumn(
            "ts_hist", F.col("ts_hist").cast("timestamp")).withColumn("is_tow", F.col("ac_type") == 2)
    if name == "weather_hours":
        df = df.withColumn("hour", F.timestamp_seconds(F.lit(YEAR_START) + F.col("hour_no") * 3600)).drop("hour_no")
    if name == "prediction_requests":
        df = df.withColumn("ts", F.timestamp_seconds(F.lit(YEAR_START) + F.col("hour_no") * 3600)).drop("hour_no")
    return df


def r6(*names: str | Column) -> list[Column]:
    """Columns rounded to 6 decimals under their own names."""
    return [F.round(n, 6).alias(n) for n in names]


def seconds(ts: str) -> Column:
    return F.unix_seconds(ts).alias(ts)
