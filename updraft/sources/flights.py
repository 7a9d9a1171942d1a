"""Flight-log sources: IGC text, CSV logs and JSON records of external feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import in_box
from updraft.operators.blocks import with_running

WORLD = (-90.0, 90.0, -180.0, 180.0)
LINE_KEY = ("flight",)
LINE_ORDER = ("block", "line")


def read_igc_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all IGC files under a folder: (flight, block, line, value).

    Files are read line by line and may be split: ``block`` is the offset of the
    split within its file and ``line`` increases in reading order within a split,
    so (block, line) is file order without ever holding a whole file in one row.
    """
    return (spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{igc,IGC}").text(path)
            .select(F.col("_metadata.file_path").alias("flight"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), "value"))


def _header_date(line: Column) -> Column:
    digits = F.regexp_replace(F.substr(line, F.lit(6)), "[^0-9]", "")
    year = F.substring(digits, 5, 2).try_cast("int")
    full = F.when(year < 70, year + 2000).otherwise(year + 1900)
    text = F.concat_ws("-", full.cast("string"), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    is_header = line.startswith("HFDTE") | line.startswith("HPDTE")
    return F.when(is_header & (F.length(digits) >= 6),
                  F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def parse_igc_lines(lines: DataFrame) -> DataFrame:
    """Position fixes from IGC lines.

    The date of a fix is the last date header above it in its file. Carrying it
    down is a running "last" per split, so a file may be arbitrarily long.
    """
    text = F.trim("value")
    wanted = lines.withColumn("value", text).select(
        *LINE_KEY, *LINE_ORDER, "value", _header_date(F.col("value")).alias("__header"),
    ).filter(F.col("__header").isNotNull() | F.col("value").startswith("B"))
    dated = with_running(wanted, LINE_KEY, LINE_ORDER, F.col("block"),
                         {"date": ("last", F.col("__header"))})

    def field(start: int, length: int, kind: str) -> Column:
        return F.substring("value", start, length).try_cast(kind)

    record = dated.filter(
        F.col("value").startswith("B") & (F.length("value") >= 35) & F.col("date").isNotNull()
    ).select(
        *LINE_KEY, *LINE_ORDER, "date",
        field(2, 2, "int").alias("hh"), field(4, 2, "int").alias("mi"), field(6, 2, "int").alias("ss"),
        field(8, 2, "int").alias("lat_d"), field(10, 5, "double").alias("lat_m"),
        F.substring("value", 15, 1).alias("ns"),
        field(16, 3, "int").alias("lon_d"), field(19, 5, "double").alias("lon_m"),
        F.substring("value", 24, 1).alias("ew"),
        field(26, 5, "double").alias("pressure_alt"), field(31, 5, "double").alias("alt"),
    ).filter(
        F.col("hh").between(0, 23) & F.col("mi").between(0, 59) & F.col("ss").between(0, 59)
        & F.col("lat_d").isNotNull() & F.col("lat_m").isNotNull()
        & F.col("lon_d").isNotNull() & F.col("lon_m").isNotNull() & F.col("alt").isNotNull())

    def degrees(whole: str, milli: str, hemisphere: str, negative: str) -> Column:
        value = F.col(whole) + F.col(milli) / F.lit(1000.0) / F.lit(60.0)
        return F.when(F.col(hemisphere) == negative, -value).otherwise(value)

    seconds = F.col("hh") * 3600 + F.col("mi") * 60 + F.col("ss")
    midnight = F.unix_seconds(F.col("date").cast("timestamp"))
    return record.select(
        *LINE_KEY, *LINE_ORDER,
        F.timestamp_seconds(midnight + seconds).alias("time"),
        degrees("lat_d", "lat_m", "ns", "S").alias("lat"),
        degrees("lon_d", "lon_m", "ew", "W").alias("lon"),
        "alt", "pressure_alt")


def read_igc(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of every IGC file under ``path``."""
    return parse_igc_lines(read_igc_lines(spark, path))


def read_flight_logs(spark: SparkSession, path: str) -> DataFrame:
    """IGC fixes and CSV logs of a folder as one table (missing columns NULL)."""
    igc = read_igc(spark, path).withColumn(
        "source", F.regexp_extract("flight", r"([^/]+)\.[^./]+$", 1)
    ).withColumnRenamed("alt", "gps_alt").withColumnRenamed("pressure_alt", "press_alt").select(
        "source", "lat", "lon", "gps_alt", "press_alt",
        F.hour("time").alias("hh"), F.minute("time").alias("mm"), F.second("time").alias("ss"))
    csv = (spark.read.option("header", "true").option("inferSchema", "true")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path))
    return igc.unionByName(csv, allowMissingColumns=True)


def fixes_from_snapshot(df: DataFrame, asof, json: str = "json", box=WORLD) -> DataFrame:
    """Fixes from track-snapshot objects ``{"a": [{"1": lat, "2": lon, ...}]}``.

    Snapshots carry no turn rate; circling is inferred from the climb rate.
    """
    kept = [c for c in df.columns if c != json]
    aircraft = df.select(*kept, F.explode(
        F.from_json(json, "a array<map<string,string>>")["a"]).alias("__a"))

    def number(key: str) -> Column:
        raw = F.try_element_at("__a", F.lit(key))
        return F.when(raw.isNull(), F.lit(0.0)).otherwise(raw.try_cast("double"))

    fixes = aircraft.select(
        *kept, F.lit(asof).cast("timestamp").alias("time"), number("1").alias("lat"),
        number("2").alias("lon"), number("3").alias("alt"), number("4").alias("vario"),
        F.lit(0.0).alias("turn_rate"))
    return (fixes.filter(in_box("lat", "lon", box)
                         & F.col("alt").isNotNull() & F.col("vario").isNotNull())
            .withColumn("circling", F.col("vario") > K.LABEL_VARIO))


def fixes_from_thermals(df: DataFrame, default_date, json: str = "json", box=WORLD) -> DataFrame:
    """Fixes from thermal records with alternative keys and defaults.

    A zero or empty value falls through to the next alternative, as a missing
    one does.
    """
    kept = [c for c in df.columns if c != json]

    def text(*names: str) -> Column:
        found = [F.get_json_object(json, f"$.{n}") for n in names]
        return F.coalesce(*[
            F.when((v != "") & (F.coalesce(v.try_cast("double"), F.lit(1.0)) != 0.0), v)
            for v in found])

    def number(*names: str) -> Column:
        return text(*names).try_cast("double")

    raw_time = F.coalesce(text("date", "datetime"), F.lit(str(default_date)))
    fixes = df.select(
        *kept, raw_time.try_cast("timestamp").alias("time"),
        number("latitude", "lat").alias("lat"), number("longitude", "lon").alias("lon"),
        F.coalesce(number("altitude"), F.lit(800.0)).alias("alt"),
        F.coalesce(number("avg_climb", "vario"), F.lit(2.0)).alias("vario"),
        F.lit(15.0).alias("turn_rate"), F.lit(True).alias("circling"))
    return fixes.filter(in_box("lat", "lon", box) & F.col("time").isNotNull())
