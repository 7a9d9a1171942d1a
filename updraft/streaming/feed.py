"""Structured Streaming forms of the feed operators.

Event time is arrival time. Stateful queries use a watermark on ``ts``
(5 minutes unless given), which bounds their state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from updraft import constants as K
from updraft.functions.geo import prior_cell
from updraft.functions.rules import is_evidence, lift_label
from updraft.operators.live import (
    Bounds, in_viewport, latest_by, live_state, positions_since, positions_to_wire, to_wire,
    visible_positions)
from updraft.operators.terrain import with_agl
from updraft.operators.tow import flag_under_tow
from updraft.sources.beacons import WORLD, parse_beacons
from updraft.sources.store import delete_path

WATERMARK = "5 minutes"
# Arrival numbers: 27 bits of batch, 10 bits of partition, 26 bits of row.
ROW_BITS, PARTITION_BITS = 26, 10


def numbered(batch: DataFrame, batch_id: int, name: str = "seq") -> DataFrame:
    """``batch`` with arrival numbers that grow across micro-batches.

    The number depends on the batch, partition and row position only, so a
    replayed batch gets the same ones. A partition with more rows than its bits
    can number is an error.
    """
    packed = batch.coalesce(1 << PARTITION_BITS)
    row = F.monotonically_increasing_id()
    within = row.bitwiseAND(F.lit((1 << 33) - 1))
    checked = F.when(within < F.lit(1 << ROW_BITS), within).otherwise(
        F.raise_error(F.lit("too many rows in a partition to number them")).cast("bigint"))
    position = F.shiftleft(F.shiftright(row, 33), ROW_BITS) + checked
    return packed.withColumn(name, F.lit(batch_id << (ROW_BITS + PARTITION_BITS)) + position)


def parsed_stream(lines: DataFrame, arrival: Column | None = None, box=WORLD) -> DataFrame:
    """Beacons of a text stream with their arrival time."""
    stamped = lines.withColumn("ts", F.current_timestamp() if arrival is None else arrival)
    return parse_beacons(stamped, box=box)


def append_stream(beacons: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Continuous append to a date-partitioned table through the exactly-once file sink."""
    return (beacons.withColumn("date", F.to_date("ts")).writeStream.format("parquet")
            .partitionBy("date").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def tow_batch(path: str, order: str = "seq", lateness: str = WATERMARK,
              state: str | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer that resolves aerotow before rows reach the history.

    A batch sees its own tugs and, of the batches before, each tug's last report: any
    earlier one had been superseded when the batch's gliders were heard. These last
    reports are the state, a folder per batch next to the history (``state``): a batch
    reads its predecessor's by name and writes its own, without tugs unheard for longer
    than a tow lasts plus ``lateness``. So a batch costs what its rows and the active
    tugs cost, however long the stream has run. The history is laid out by date, and
    below it by batch: a batch overwrites its own folders, so a replay leaves no duplicates.
    """
    folder = state or f"{path.rstrip('/')}.tugs"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch if order in batch.columns else numbered(batch, batch_id, order)
        rows = rows.drop("under_tow")
        before = _stored(spark, f"{folder}/{batch_id - 1}")
        tugs = rows.limit(0) if before is None else before.select(*rows.columns)
        flagged = flag_under_tow(rows, order=order, tugs=None if before is None else tugs)
        (flagged.withColumn("date", F.to_date("ts")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path))
        newest = rows.select("ts").unionByName(tugs.select("ts")).agg(F.max("ts").alias("t")).select(
            (F.col("t") - F.expr(f"INTERVAL {int(K.TOW_MAX_AGE_S)} SECONDS") - F.expr(f"INTERVAL {lateness}")).alias("t"))
        heard = rows.filter(F.col("ac_type") == K.TOW_TYPE).unionByName(tugs)
        latest_by(heard, ["id"], order).filter(F.col("ts") >= newest.scalar()).write.mode("overwrite").parquet(
            f"{folder}/{batch_id}")
        # The predecessor's stays for a replay of this batch.
        delete_path(spark, f"{folder}/{batch_id - 2}")

    return write


def live_frame(history: DataFrame, elevations: DataFrame, asof, bounds: Bounds | None,
               cursor: int) -> tuple[DataFrame, DataFrame]:
    """One viewer frame as of a time: visible aircraft with height, and all their new positions."""
    shown = in_viewport(live_state(history, asof), bounds)
    new = positions_since(history.filter(F.col("ts") <= F.lit(asof)), cursor)
    if bounds is not None:
        new = visible_positions(new, shown)
    return to_wire(with_agl(shown, elevations)), positions_to_wire(new)


def track_sessions(beacons: DataFrame, gap: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Flights as sessions of an aircraft's beacons."""
    return (beacons.withWatermark("ts", watermark)
            .groupBy("id", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("beacons"), F.max("ts").alias("last_ts"),
                 F.max("alt").alias("max_alt"))
            .select("id", F.col("w.start").alias("first_ts"), "last_ts", "beacons", "max_alt"))


def hourly_climb_index(beacons: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Climb-index buckets, each emitted once when its hour is complete."""
    return (beacons.filter(is_evidence(null_is_tow=True)).withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 hour").alias("w"), prior_cell("lat").alias("lat_cell"),
                     prior_cell("lon").alias("lon_cell"))
            .agg(F.sum(lift_label()).alias("climbs"), F.count(F.lit(1)).alias("total"))
            .select(F.col("w.start").alias("hour"), "lat_cell", "lon_cell", "climbs", "total"))


def retrain_batch(collect: Callable[[DataFrame, int], DataFrame], buffer_path: str,
                  retrain: Callable[[SparkSession], None]) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of the rolling retrain: collect samples, store them, refit.

    ``collect`` turns a batch into buffer rows; ``retrain`` reads the buffer.
    The samples of a batch overwrite its own partition, so a replay is harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        samples = collect(batch, batch_id)
        (samples.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(buffer_path))
        retrain(batch.sparkSession)

    return write


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                interval: str | None = None) -> DataStreamWriter:
    """A stream driving a micro-batch writer, at an interval or over what is available."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
