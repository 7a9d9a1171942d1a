"""Grids whose cells stay where they are made."""

import math
import re

import pytest
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.operators import fusion
from updraft.operators import terrain as TR
from updraft.operators.forest import NOISY, Forest, Split, Uncertainty
from updraft.plans import predict

TREES = Forest((Split("cape", 700.0, Split("slope", 9.0, 0.1, Split("cin", -60.0, 0.3, -0.2)), 0.4),
                Split("elevation", 320.0, 0.0, Split("cape", 500.0, -0.5, 0.5)), Split("lon", 15.0012, 0.2, -0.1)))
LIVE = "id string, lat double, lon double, vario double"


def lattice(spark):
    at = spark.range(4590, 4612).withColumnRenamed("id", "lat_i").crossJoin(
        spark.range(1490, 1512).withColumnRenamed("id", "lon_j"))
    return at.withColumn("elevation", 200 + (F.col("lat_i") * 7 + F.col("lon_j") * 13) % 250)


def requests(spark, ids):
    rows = spark.createDataFrame([(i, k, 46.0 + k / 100, 15.0) for k, i in enumerate(ids)],
                                 "request_id long, k long, lat double, lon double")
    return rows.select("request_id", "lat", "lon", (900.0 + 50 * F.col("k")).alias("alt_amsl"),
                       F.timestamp_seconds(F.lit(1718956800) + 3600 * F.col("k")).alias("ts"),
                       *[(F.lit({"cape": 650.0, "cin": -65.0}.get(n, 3.0)) + 10 * F.col("k")).alias(n) for n in NOISY])


def live(spark):
    return spark.createDataFrame([("a", 46.0021, 15.0013, 2.0), ("b", 46.0021, 15.0452, 3.0), ("c", 45.97, 15.0, 9.0)], LIVE).withColumn(
        "circling", F.lit(True))


def exchanged(df):
    """What each exchange of the plan deals by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^\[]*)", plan)


@pytest.mark.parametrize("ids", [[1, 2], [1, 1, 2], [None, 3]])
def test_model_cells_stay_with_their_grid(spark, ids):
    """Equal to the spread of loose cells, also for repeated and null ids, and no exchange by pattern."""
    asked = requests(spark, ids)
    heat = predict.predict_grids_with_model(asked, lattice(spark), TREES, live=live(spark), evidence=F.lit(True),
                                            draws=5, rounded=False)
    assert not any("pattern" in by for by in exchanged(heat))
    ready = predict.prepared_requests(asked, lattice(spark))
    cells = TR.grid_cells(TR.grid_rows(ready.select("request_id", "c_i", "c_j", "alt_amsl", "elevation_window")))
    wanted = Uncertainty(TREES, 5, 0).spread(cells, asked, ["request_id", "row", "col"])
    wanted = wanted.groupBy("request_id").agg(F.count("*"), F.sum("p_std"), F.min("p_mean"))
    got = heat.groupBy("request_id").agg(F.count("*"), F.sum("p_std"), F.min("p_mean"))
    assert sorted(map(tuple, got.collect())) == [
        (i, n, pytest.approx(s, rel=1e-9), pytest.approx(m, abs=1e-9)) for i, n, s, m in sorted(map(tuple, wanted.collect()))]


def test_a_grid_is_dealt_out_before_its_rows_are_made(spark):
    """Windows cross the network once a request, and rows are not shuffled."""
    ready = predict.prepared_requests(requests(spark, [1, 2, 3]), lattice(spark))
    cells = TR.grid_cells(TR.grid_rows(ready.select("request_id", "c_i", "c_j", "elevation_window")))
    assert cells.count() == 3 * 201 * 201
    assert not any("row" in by for by in exchanged(cells))
    per_row = cells.groupBy("request_id", "row").agg(F.count("*").alias("n"))
    assert not any("row" in by for by in exchanged(per_row))
    assert per_row.where("n <> 201").count() == 0 and per_row.count() == 3 * 201


def test_climbs_reach_stored_heat_in_place(spark):
    """Boosts equal a loop over aircraft; neither heat nor contributions are dealt out by cell."""
    asked = TR.with_centre(requests(spark, [1, 2]))
    heat = fusion.heat_rows(asked).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(200)))).withColumn("p_mean", F.lit(0.2))
    fused = fusion.fuse_climbs(heat, asked, live(spark), F.lit(True))
    assert not any("col#" in by for by in exchanged(fused)) and "SortMergeJoin [request_id" not in (
        fused._jdf.queryExecution().executedPlan().toString())
    got = {(r.request_id, r.row, r.col): r.p_mean for r in fused.where("p_mean > 0.2").collect()}
    want = {}
    for i, c_i in ((1, 4600), (2, 4601)):
        for _, lat, lon, vario in [("a", 46.0021, 15.0013, 2.0), ("b", 46.0021, 15.0452, 3.0), ("c", 45.97, 15.0, 9.0)]:
            ri, ci = (lat - (c_i * 0.01 - 0.05)) / 0.0005, (lon - (1500 * 0.01 - 0.05)) / 0.0005
            if not (0 <= ri < 201 and 0 <= ci < 201):
                continue
            for r in range(max(0, int(ri) - 18), min(200, int(ri) + 18) + 1):
                for c in range(max(0, int(ci) - 18), min(200, int(ci) + 18) + 1):
                    want[i, r, c] = want.get((i, r, c), 0) + min(vario / 5, 1) * 0.5 * math.exp(
                        -((r - ri) ** 2 + (c - ci) ** 2) / (2 * K.FUSION_SIGMA ** 2))
    assert got.keys() == want.keys() and len(want) > 3000
    assert all(got[k] == pytest.approx(min(1, 0.2 + v), abs=1e-9) for k, v in want.items())
    assert fused.count() == 2 * 201 * 201
