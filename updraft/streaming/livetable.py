"""The live table as keyed state: one entry per aircraft, dropped by event-time timers.

A batch touches the aircraft it holds and no others; nothing is rewritten and no
version is listed, so a batch costs what its rows cost however long the stream has
run. The table is read from the state of the last committed batch.

State of an aircraft is what ``live_state`` may still ask for: the last report's time
and run start, and the reports that no later one dominates. A report is dominated if
a later one in feed order has a time at least as late, so in a feed in time order one
report is kept, and after late ones a few.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from updraft import constants as K
from updraft.operators.live import latest_by

WATERMARK = "5 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns the state adds to a report.
TIME, FIRST = "__us", "first_seen"


class LiveRows(StatefulProcessor):
    """Folds an aircraft's reports, in feed order, into its live entry."""

    def __init__(self, stored: T.StructType, order: str, ttl_s: int):
        self.stored, self.order, self.ttl_us = stored, order, ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last_us long, run long, timer_ms long")
        self.rows = handle.getListState("rows", self.stored)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.stored.fieldNames()
        time, order = names.index(TIME), names.index(self.order)
        last_us, run, timer = self.head.get() if self.head.exists() else (None, None, None)
        kept = [tuple(r) for r in self.rows.get()] if last_us is not None else []
        for r in sorted(rows, key=lambda r: r[self.order]):
            us = r[TIME]
            if last_us is None or us - last_us >= self.ttl_us:
                run = r[self.order]
            last_us = us
            kept = [k for k in kept if k[time] > us]
            kept.append(tuple(run if n == FIRST else r[n] for n in names))
        # Reports that have left with the aircraft's own clock cannot come back.
        newest = max(k[time] for k in kept)
        kept = [k for k in kept if k[time] > newest - self.ttl_us]
        expiry = -(-(newest + self.ttl_us) // 1000)
        if timer != expiry:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expiry)
        self.head.update((last_us, run, expiry))
        self.rows.put(kept)
        best = max(kept, key=lambda k: k[order])
        yield Row(id=key[0], **dict(zip(names, best)), present=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.head.clear()
        self.rows.clear()
        yield Row(id=key[0], **{n: None for n in self.stored.fieldNames()}, present=False)

    def close(self) -> None:
        pass


def _encoded(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, which pass through Python and back without a time zone."""
    return df.select(*[F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
                       for f in df.schema])


def _decoded(df: DataFrame, schema: T.StructType) -> DataFrame:
    stamps = {f.name for f in schema if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.timestamp_micros(c).alias(c) if c in stamps else c for c in df.columns])


def _stored_schema(encoded: T.StructType, order: str) -> T.StructType:
    """A report without its id, with its time in microseconds and its run start."""
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in encoded if f.name != "id"],
                         T.StructField(TIME, T.LongType()), T.StructField(FIRST, encoded[order].dataType)])


def live_changes(beacons: DataFrame, ttl_s: int = K.LIVE_TTL_S, ts: str = "ts", order: str = "seq",
                 watermark: str = WATERMARK) -> DataFrame:
    """What each batch changes in the live table: entries that are new or moved, and those that leave.

    An entry has the columns of ``beacons`` and ``first_seen``; ``present`` is false
    for an aircraft whose time to live has passed the watermark. The watermark's
    delay must not be below the time to live: later rows are dropped by Spark, and only
    rows that could not be live any more may be.
    """
    encoded = _encoded(beacons).schema
    stored = _stored_schema(encoded, order)
    # A second timestamp column carries the watermark, since the reports' own are encoded.
    stamped = beacons.withColumn("__event", F.col(ts).cast("timestamp")).withWatermark("__event", watermark)
    plain = stamped.select(
        *[F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
          for f in beacons.schema], F.unix_micros("__event").alias(TIME), "__event")
    out = T.StructType([T.StructField("id", beacons.schema["id"].dataType), *stored.fields,
                        T.StructField("present", T.BooleanType())])
    changes = plain.groupBy("id").transformWithState(
        LiveRows(stored, order, ttl_s), out, outputMode="Update", timeMode="EventTime")
    return _decoded(changes.drop(TIME), beacons.schema)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def start_live(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Start a stream of ``live_changes``; the checkpoint holds the table. Keyed state with timers needs RocksDB."""
    spark = SparkSession.active()
    with _setting(spark, PROVIDER, ROCKSDB):
        return writer.outputMode("update").option("checkpointLocation", checkpoint).start()


def read_live(spark: SparkSession, checkpoint: str, schema: T.StructType, ttl_s: int = K.LIVE_TTL_S,
              order: str = "seq") -> DataFrame:
    """The live table of the last committed batch, as of the newest report, from the stream's state.

    ``schema`` is that of the reports. Timers wait for the watermark, so entries that
    have left since are filtered here.
    """
    with _setting(spark, PROVIDER, ROCKSDB):
        state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    rows = state.select(F.col("key.id").alias("id"), "list_element.*")
    newest = rows.agg(F.max(TIME).alias("t")).select((F.col("t") - F.lit(ttl_s * 1_000_000)).alias("t")).scalar()
    live = latest_by(rows.filter(F.col(TIME) > newest), ["id"], order)
    return _decoded(live.drop(TIME), schema).select("id", *[f.name for f in schema if f.name != "id"], FIRST)
