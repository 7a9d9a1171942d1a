"""Beacon text, beacon history tables and their retention."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions import atmosphere as A
from updraft.functions.geo import in_box
from updraft.functions.rules import is_admitted, type_name
from updraft.operators.blocks import computed_once
from updraft.schema import require_columns

WORLD = (-90.0, 90.0, -180.0, 180.0)

# Text layout of an uncompressed position report (fixed values).
POSITION = r"\d{4}\.\d+[NS][/\\]\d{5}\.\d+[EW]"
ALTITUDE = r"/A=(\d+)"
CLIMB = r"([+-]\d+)fpm"
TURN = r"([+-]\d+(?:\.\d+)?)rot"
COURSE_SPEED = r"[EW][^\s/\\](\d{3}/\d{3})"
TYPE_BYTE = r"\bid([0-9A-Fa-f]{2})[0-9A-Fa-f]{6}"


def read_beacon_text(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Newline-delimited beacon text, one ``value`` per line."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path)


def parse_beacons(lines: DataFrame, value: str = "value", box=WORLD) -> DataFrame:
    """Typed beacons from text lines; works on batch and streaming frames.

    Comments, status lines, other payload kinds, lines without a position and
    aircraft that cannot be identified as admitted types are dropped. Columns of
    ``lines`` other than ``value`` are kept. Each pattern runs once per line;
    everything else is substring work inside code generation.
    """
    text = F.col(value)
    kept = [c for c in lines.columns if c != value]

    def number(pattern: str, kind: str) -> Column:
        return F.regexp_extract("__p", pattern, 1).try_cast(kind)

    payload = (
        lines.filter(
            (F.length(text) > 0) & ~text.startswith("#")
            & text.contains(">") & text.contains(":"))
        .select(*kept, F.trim(F.substring_index(text, ">", 1)).alias("id"),
                F.expr(f"substring(`{value}`, instr(`{value}`, ':') + 1)").alias("__p"))
        .filter(F.substring("__p", 1, 1).isin("/", "@")))
    # Type first: most lines that are dropped are dropped here, before the
    # other patterns run.
    typed = computed_once(payload, ac_type=F.shiftright(F.conv(
        F.nullif(F.regexp_extract("__p", TYPE_BYTE, 1), F.lit("")), 16, 10).cast("int"), 2)
        .bitwiseAND(F.lit(15))).filter(is_admitted("ac_type"))
    tokens = computed_once(
        typed,
        __pos=F.replace(F.regexp_extract("__p", POSITION, 0), F.lit("\\"), F.lit("/")),
        __feet=number(ALTITUDE, "bigint"), __fpm=number(CLIMB, "bigint"), __rot=number(TURN, "double"),
        __cs=F.regexp_extract("__p", COURSE_SPEED, 1),
    ).filter(F.col("__pos") != "")

    def coordinate(token: Column, degrees: int, negative: str) -> Column:
        minutes = token.substr(F.lit(degrees + 1), F.length(token) - F.lit(degrees + 1))
        return A.degrees_minutes(
            F.left(token, F.lit(degrees)), minutes, F.right(token, F.lit(1)), negative)

    located = computed_once(
        tokens, lat=coordinate(F.substring_index("__pos", "/", 1), 2, "S"),
        lon=coordinate(F.substring_index("__pos", "/", -1), 3, "W")).filter(in_box("lat", "lon", box))
    course = F.left(F.col("__cs"), F.lit(3)).try_cast("int")
    knots = F.right(F.col("__cs"), F.lit(3)).try_cast("int")
    return located.select(
        *kept, "id", "lat", "lon",
        F.coalesce(A.feet_to_metres("__feet"), F.lit(0)).alias("alt"),
        F.coalesce(A.fpm_to_mps("__fpm"), F.lit(0.0)).alias("vario"),
        F.when(course > 0, course).alias("heading"),
        F.coalesce(A.knots_to_kmh(knots), F.lit(0)).alias("speed_kmh"),
        (F.abs(F.coalesce(A.rot_to_deg_s("__rot"), F.lit(0.0))) > K.CIRCLING_DEG_S).alias("circling"),
        "ac_type", type_name("ac_type").alias("ac_type_name"),
        (F.col("ac_type") == K.TOW_TYPE).alias("is_tow"),
        F.lit(None).cast("boolean").alias("under_tow"),   # until tow flagging has run
    )


def append_beacons(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to the history table, partitioned by date.

    Rows are range-partitioned on (date, id, ts) first: a task writes few files,
    a busy id is split by time, and row-group statistics on id stay selective.
    """
    (df.withColumn("date", F.to_date(ts))
       .repartitionByRange("date", "id", ts)
       .sortWithinPartitions("date", "id", ts)
       .write.mode("append").partitionBy("date").parquet(path))


def read_beacons(spark: SparkSession, path: str, since: datetime | None = None,
                 until: datetime | None = None, box=WORLD, ts: str = "ts",
                 ordered: bool = False) -> DataFrame:
    """History rows in a time window and box.

    The window prunes date partitions and, with the box, reaches the scan.
    Columns added by later writers read as NULL in older files.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if since is not None:
        df = df.filter((F.col("date") >= F.lit(since.date())) & (F.col(ts) >= F.lit(since)))
    if until is not None:
        df = df.filter((F.col("date") <= F.lit(until.date())) & (F.col(ts) <= F.lit(until)))
    if tuple(box) != WORLD:
        df = df.filter(in_box("lat", "lon", box))
    return df.orderBy(ts) if ordered else df


def window_days(days_back: float | None, retention: float = K.RETENTION_DAYS) -> float:
    """Days of history to read: never more than is retained."""
    return retention if days_back is None else min(days_back, retention)


def retain(df: DataFrame, now: datetime, days: float = K.RETENTION_DAYS, ts: str = "ts",
           box=WORLD) -> DataFrame:
    """Rows younger than ``days`` and inside the box."""
    kept = df.filter(F.col(ts) >= F.lit(now - timedelta(days=days)))
    return kept if tuple(box) == WORLD else kept.filter(in_box("lat", "lon", box))


def _renamed(fs, source, target) -> None:
    """Rename that fails loudly; file systems report failure by their return value."""
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def _complete_purge(fs, hadoop, root) -> None:
    """Finish the renames of a purge that was stopped.

    A partition is renamed away only when its survivors are staged whole: a staged
    folder without its partition is complete, one beside its partition may not be.
    """
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    for name in names:
        if name.startswith(".staged-"):
            staged, boundary = hadoop.Path(root, name), hadoop.Path(root, f"date={name[8:]}")
            if f".expired-{name[8:]}" in names and not fs.exists(boundary):
                _renamed(fs, staged, boundary)
            else:
                fs.delete(staged, True)
    for name in names:
        if name.startswith(".expired-"):
            fs.delete(hadoop.Path(root, name), True)


def purge_history(spark: SparkSession, path: str, now: datetime,
                  days: float = K.RETENTION_DAYS, ts: str = "ts") -> int:
    """Drop expired rows from the stored history; returns how many went.

    Whole expired date partitions are removed as folders. Only the one date the
    cutoff falls in is rewritten: its survivors are staged in a sibling folder,
    the old partition is renamed away, the staged one renamed in, and only then the
    old one deleted. A run that stopped between the renames is completed first.
    """
    cutoff = now - timedelta(days=days)
    utc = cutoff.astimezone(timezone.utc) if cutoff.tzinfo else cutoff
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _complete_purge(fs, hadoop, root)
    table = spark.read.option("mergeSchema", "true").parquet(path)
    require_columns(table, [ts, "date"], "beacon history")
    expired = table.filter(
        (F.col("date") <= F.lit(utc.date())) & (F.col(ts) < F.lit(cutoff)))
    removed = expired.count()
    if removed == 0:
        return 0
    boundary = hadoop.Path(root, f"date={utc.date().isoformat()}")
    if fs.exists(boundary):
        staged, old = (hadoop.Path(root, f".{kind}-{utc.date().isoformat()}") for kind in ("staged", "expired"))
        survivors = table.filter((F.col("date") == F.lit(utc.date())) & (F.col(ts) >= F.lit(cutoff))).drop("date")
        below = ["batch"] if "batch" in table.columns else []      # the stream's layout
        survivors.write.mode("overwrite").partitionBy(*below).parquet(staged.toString())
        _renamed(fs, boundary, old)
        _renamed(fs, staged, boundary)
        fs.delete(old, True)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < utc.date().isoformat():
            fs.delete(status.getPath(), True)
    return removed
