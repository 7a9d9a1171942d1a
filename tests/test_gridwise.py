"""Whole grids as arrays against cells made and scored row by row."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions import atmosphere as A
from updraft.functions.rules import round_probability
from updraft.operators import fusion, gridwise
from updraft.operators import terrain as TR
from updraft.operators.forest import NOISY, Forest, Split, Uncertainty
from updraft.plans import predict
from updraft.plans.features import time_features, with_default_landcover

CHANCE, NOON = random.Random(4), datetime(2024, 6, 21, 12)
# More thresholds than are compared one by one, and more patterns than a table holds.
MANY = Forest(tuple(Split(name, CHANCE.uniform(low, high), CHANCE.uniform(-.2, .2), Split("cape", CHANCE.uniform(500, 800), -.1, .1))
                    for name, low, high in (("elevation", 200, 450), ("slope", 0, 12), ("aspect", 0, 360), ("lat", 45.95, 46.05),
                                            ("lon", 14.95, 15.05), ("alt_agl", 400, 800)) for _ in range(12)))
MIXED = Forest((Split("cape", 700.0, Split("slope", 9.0, 0.1, Split("cin", -60.0, 0.3, -0.2)), Split("hour_cos", 0.0, 0.4, -0.3)),
                Split("alt_agl", 600.0, Split("elevation", 320.0, 0.0, Split("cape", 640.0, -0.5, 0.5)), 0.2),
                Split("lon", 15.0012, Split("land_use_heat", 0.4, 0.3, 0.1), Split("lat", 46.0, 0.2, -0.1)),
                Split("aspect", 170.0, -0.2, 0.2), Split("soil_temp", 3.5, 0.1, Split("wind_u", 2.0, -0.1, 0.05)), 0.07))


def lattice(spark, elevation):
    at = spark.range(4590, 4612).withColumnRenamed("id", "lat_i").crossJoin(
        spark.range(1490, 1512).withColumnRenamed("id", "lon_j"))
    return at.withColumn("elevation", F.expr(elevation).cast("double"))


def requests(spark, rows):
    asked = spark.createDataFrame(rows, "request_id string, lat double, lon double, alt_amsl double, ts timestamp, cape double")
    return asked.select("*", *[F.lit({"cin": -65.0}.get(n, 3.0)).alias(n) for n in NOISY if n != "cape"])


def one_by_one(asked, ground, forest, live, missing, draws):
    ready = predict.prepared_requests(asked, ground, missing=missing).select(
        "request_id", "c_i", "c_j", "alt_amsl", "elevation_window", *time_features("ts"))
    cells = with_default_landcover(TR.grid_cells(TR.grid_rows(ready))).withColumn(
        "alt_agl", A.height_above_ground("alt_amsl", "elevation"))
    keep = ["request_id", "row", "col", "lat", "lon", "c_i", "c_j"]
    heat = Uncertainty(forest, draws, 0).spread(cells, asked, keep)
    boosts = fusion.row_boosts(fusion.climb_placements(TR.with_centre(asked), live, F.lit(True)))
    return heat.join(boosts, ["c_i", "c_j", "row"], "left").withColumn(
        "p_mean", fusion.fused(F.col("p_mean"), F.get("boost", F.col("col"))))


@pytest.mark.parametrize("elevation, forest, missing", [
    ("200 + (lat_i * 7 + lon_j * 13) % 250", MIXED, "drop"),
    ("200 + (lat_i * lat_i + lon_j * 13) % 250", MANY, "drop"),
    ("if((lat_i * 5 + lon_j * 3) % 17 = 0, null, if(lon_j = 1503 and lat_i > 4602, double('NaN'), lat_i * lon_j % 90))", MIXED, "drop"),
    ("if(lat_i = 4601 and lon_j = 1501, null, 300)", MIXED, "fill")])
def test_grids_equal_cells_one_by_one(spark, elevation, forest, missing):
    """Also with unknown and undefined ground, altitude, weather, time and place, and requests that share an id."""
    rows = [("a", 46.0, 15.0, 900.0, NOON, 650.0), ("b", 46.01, 15.0, None, NOON, 690.0), ("c", 46.0, 15.01, 950.0, None, None),
            ("d", 46.0, 15.0, math.nan, NOON, math.nan), ("a", 46.01, 15.01, 700.0, NOON, 10.0), (None, 46.0, 15.0, 900.0, NOON, 650.0)]
    if missing == "fill":
        rows += [("e", None, 15.0, 900.0, NOON, 650.0), ("f", 46.0, None, None, NOON, 650.0), ("g", 10.0, 15.0, 900.0, NOON, 650.0)]
    asked, ground = requests(spark, rows), lattice(spark, elevation)
    live = spark.createDataFrame([("x", 46.0021, 15.0013, 2.0, True), ("y", 45.97, 15.0, 9.0, True)],
                                 "id string, lat double, lon double, vario double, circling boolean")
    heat = predict.predict_grids_with_model(asked, ground, forest, live=live, evidence=F.lit(True), missing=missing,
                                            draws=7, rounded=False)
    names, values = ["request_id", "row", "col"], ["lat", "lon", "p_mean", "p_std"]
    got, want = (df.select(*names, *values, *[F.col(v).isNull().alias(f"no_{v}") for v in values]).toPandas().sort_values(
        [*names, "lat", "lon", "p_mean"]) for df in (heat, one_by_one(asked, ground, forest, live, missing, 7)))
    for exact in (*names, *[f"no_{v}" for v in values]):
        assert got[exact].tolist() == want[exact].tolist()
    np.testing.assert_allclose(got[values].to_numpy(), want[values].to_numpy(), rtol=1e-9, atol=1e-9)


def test_rounding_equals_the_engine_on_ties(spark):
    values = [i / 2000 for i in range(2001)] + [CHANCE.random() for _ in range(500)] + [0.0125 + 2e-18, math.nextafter(0.0125, 1)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_probability("v")).collect()]
    assert gridwise.rounded_half_even(np.array(values)).tolist() == want


def test_cells_are_made_once_and_boosts_are_copied_by_share(spark):
    """A grid is worked on as a whole where it lies: its rows are made once, its climbs come once per 16 grids of a centre."""
    asked = requests(spark, [(str(i), 46.0, 15.0, 900.0, NOON, 650.0) for i in range(40)])
    live = spark.createDataFrame([("x", 46.0021, 15.0013, 2.0, True)], "id string, lat double, lon double, vario double, circling boolean")
    heat = predict.predict_grids_with_model(asked, lattice(spark, "lat_i % 90"), MIXED, live=live, evidence=F.lit(True))
    plan = heat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "__patterns" not in plan
    boosts = fusion.grid_boosts(fusion.climb_placements(TR.with_centre(asked), live, F.lit(True)))
    met = fusion.with_boosts(TR.with_centre(asked), TR.with_centre(asked), boosts)
    assert met.count() == 40 and met.where("boosts is null").count() == 0
    shares = F.pmod(F.xxhash64("request_id"), F.lit(3))
    assert 1 < asked.select(shares).distinct().count() <= math.ceil(40 / fusion.TOGETHER) == 3
    assert K.MONTE_CARLO_DRAWS == 50 and heat.count() == 40 * 201 * 201
