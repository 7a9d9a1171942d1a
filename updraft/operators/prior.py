"""Lagged climb prior: how often aircraft climbed over a patch of ground before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import hour_of, prior_cell
from updraft.functions.rules import is_evidence, is_soaring, lift_label
from updraft.operators import terrain as TR
from updraft.operators.joins import salted_join

CELL = ("lat_cell", "lon_cell")
# Prior cells on either side of a centre that a grid may touch, rounding at cell borders included.
REACH = TR.HALF_WINDOW + 1


def climb_index(beacons: DataFrame, types=K.SOARING_TYPES, ts: str = "ts", lat: str = "lat",
                lon: str = "lon") -> DataFrame:
    """Climbing and total beacons per (hour, cell) of untowed soaring aircraft."""
    counted = beacons.filter(is_evidence(null_is_tow=True) if types == K.SOARING_TYPES else (
        is_soaring(types=types) & ~F.coalesce("under_tow", F.lit(True))))
    return counted.groupBy(
        hour_of(ts).alias("hour"), prior_cell(lat).alias("lat_cell"), prior_cell(lon).alias("lon_cell"),
    ).agg(F.sum(lift_label()).alias("climbs"), F.count(F.lit(1)).alias("total"))


def index_statistics(index: DataFrame) -> DataFrame:
    """Size and overall climb rate of a climb index, one row."""
    return index.agg(
        F.count(F.lit(1)).alias("buckets"), F.count_distinct("hour").alias("hours"),
        F.coalesce(F.sum("climbs"), F.lit(0)).alias("climbs"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("beacons"),
        F.coalesce(F.try_divide(F.sum("climbs"), F.sum("total")), F.lit(0.0)).alias("global_rate"))


def prior_cutoff(ts: str | Column = "ts", lag_hours: int = K.PRIOR_LAG_HOURS) -> Column:
    """Hour bucket before which history may be used for a sample at ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return hour_of(ts - F.expr(f"INTERVAL {lag_hours} HOURS"))


def _before(events: DataFrame, window) -> DataFrame:
    return events.select(
        "*", F.sum("climbs").over(window).alias("__c"), F.sum("total").over(window).alias("__t"))


def prior_values(asked: DataFrame, index: DataFrame, smoothing: float = K.PRIOR_SMOOTHING) -> DataFrame:
    """Prior for distinct (lat_cell, lon_cell, cutoff) questions.

    Questions and buckets of a cell share one ordered window in which questions
    sort first within their hour, so only earlier buckets count. A cell has at
    most one question and one bucket per hour, however many rows lie behind
    them. The overall rate comes from the same construction over hourly totals:
    its single task handles one row per hour of history.
    """
    zero = F.lit(0).cast("bigint")

    def question(columns: list) -> DataFrame:
        return asked.select(*columns, F.col("cutoff").alias("hour"), F.lit(0).alias("__kind"),
                            zero.alias("climbs"), zero.alias("total")).distinct()

    buckets = index.select(*CELL, "hour", F.lit(1).alias("__kind"), "climbs", "total")
    per_cell = Window.partitionBy(*CELL).orderBy("hour", "__kind")
    cell_state = _before(question([*CELL]).unionByName(buckets), per_cell).filter("__kind = 0").select(
        *CELL, F.col("hour").alias("cutoff"), "__c", "__t")

    hourly = index.groupBy("hour").agg(F.sum("climbs").alias("climbs"), F.sum("total").alias("total"))
    overall = Window.orderBy("hour", "__kind")
    global_state = _before(
        question([]).unionByName(hourly.select("hour", F.lit(1).alias("__kind"), "climbs", "total")),
        overall).filter("__kind = 0").select(
        F.col("hour").alias("cutoff"), F.try_divide("__c", "__t").alias("__g"))

    rate = F.col("__g")
    value = (F.when(rate.isNull(), F.lit(None).cast("double"))
             .when(F.col("__t") == 0, rate)
             .otherwise((F.col("__c") + smoothing * rate) / (F.col("__t") + smoothing)))
    return cell_state.join(global_state, "cutoff", "left").select(
        *CELL, "cutoff", value.alias("prior"))


def with_prior(samples: DataFrame, index: DataFrame, ts: str = "ts", lat: str = "lat",
               lon: str = "lon", lag_hours: int = K.PRIOR_LAG_HOURS,
               smoothing: float = K.PRIOR_SMOOTHING) -> DataFrame:
    """``samples`` with their lagged, shrunk climb rate (``prior``).

    NULL where no history precedes the cutoff; the overall rate where the cell
    itself has none. Samples are reduced to distinct (cell, hour) questions
    before anything is computed.
    """
    keyed = (samples.withColumn("lat_cell", prior_cell(lat)).withColumn("lon_cell", prior_cell(lon))
             .withColumn("cutoff", prior_cutoff(ts, lag_hours)))
    asked = keyed.select(*CELL, "cutoff").distinct()
    answers = prior_values(asked, index, smoothing)
    return salted_join(keyed, answers, [*CELL, "cutoff"], "left").select(*samples.columns, "prior")


def with_prior_window(requests: DataFrame, index: DataFrame, ts: str = "ts", lag_hours: int = K.PRIOR_LAG_HOURS,
                      smoothing: float = K.PRIOR_SMOOTHING) -> DataFrame:
    """``requests`` (with c_i, c_j) with the priors of all cells their grid touches, row-major (``prior_window``).

    A grid of 40,401 cells lies on at most (2 REACH + 1)^2 prior cells, which are asked
    for once per centre and cutoff.
    """
    keyed = requests.withColumn("cutoff", prior_cutoff(ts, lag_hours))
    side, steps = 2 * REACH + 1, F.sequence(F.lit(-REACH), F.lit(REACH))
    key = ["c_i", "c_j", "cutoff"]
    cells = (keyed.select(*key).distinct().withColumn("__a", F.explode(steps)).withColumn("__b", F.explode(steps))
             .select(*key, ((F.col("__a") + REACH) * side + F.col("__b") + REACH).alias("__k"),
                     (F.col("c_i") + F.col("__a")).alias("lat_cell"), (F.col("c_j") + F.col("__b")).alias("lon_cell")))
    answers = prior_values(cells.select(*CELL, "cutoff").distinct(), index, smoothing)
    windows = cells.join(answers, [*CELL, "cutoff"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct("__k", "prior"))).alias("__w")).select(*key, F.col("__w.prior").alias("prior_window"))
    return salted_join(keyed, windows, key, "left").select(*requests.columns, "prior_window")


def grid_prior(requests: DataFrame, index: DataFrame, ts: str = "ts", lag_hours: int = K.PRIOR_LAG_HOURS,
               smoothing: float = K.PRIOR_SMOOTHING) -> DataFrame:
    """The prior of every cell of every request's grid: (request_id, row, col, lat, lon, prior).

    Each of a grid's rows takes its line of the prior window along, and a cell reads
    its entry: no cell is shuffled.
    """
    last = (TR.SIDE - 1) * TR.FINE
    step, side = 2 * K.GRID_RADIUS / last, 2 * REACH + 1
    asked = with_prior_window(TR.with_centre(requests), index, ts, lag_hours, smoothing)
    rows = TR.spread(asked.select("request_id", "c_i", "c_j", "prior_window", F.explode(
        F.sequence(F.lit(0), F.lit(last))).alias("row")))
    rows = rows.withColumn("lat", F.col("c_i") * K.TERRAIN_RES - K.GRID_RADIUS + F.col("row") * step)
    line = F.slice("prior_window", ((prior_cell("lat") - F.col("c_i") + REACH) * side + 1).cast("int"), F.lit(side))
    cells = rows.select("request_id", "row", "lat", "c_j", line.alias("__line"),
                        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("col")).withColumn(
        "lon", F.col("c_j") * K.TERRAIN_RES - K.GRID_RADIUS + F.col("col") * step)
    at = (prior_cell("lon") - F.col("c_j") + REACH).cast("int")
    return cells.select("request_id", "row", "col", "lat", "lon", F.get(F.col("__line"), at).alias("prior"))
