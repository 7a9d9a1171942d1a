"""Predicted lift grids for many requests in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import centre_index
from updraft.functions.rules import round_probability
from updraft.operators import fusion, montecarlo
from updraft.operators import terrain as TR
from updraft.operators.forest import Forest, Uncertainty
from updraft.operators.landcover import LAYERS, with_cover_windows
from updraft.plans.features import build_features, time_features, with_default_landcover

CELL_KEYS = ["request_id", "row", "col"]


def prepared_requests(requests: DataFrame, lattice: DataFrame, landcover: DataFrame | None = None,
                      missing: str = "drop") -> DataFrame:
    """Requests with their snapped centre, lattice windows and working altitude.

    ``requests`` carry weather already, ``landcover`` holds the ``cover_windows`` of
    their centres. Without an altitude the default is the grid's mean terrain plus the
    working height.
    """
    placed = TR.with_windows(TR.with_centre(requests), lattice, missing=missing)
    if landcover is not None:
        placed = with_cover_windows(placed, landcover)
    mean = TR.window_mean(F.col("elevation_window"))
    return (placed.withColumn("terrain_mean", mean)
            .withColumn("alt_source", F.when(F.col("alt_amsl").isNull(), "default").otherwise("observer"))
            .withColumn("alt_amsl", F.coalesce(F.col("alt_amsl").cast("double"),
                                               F.col("terrain_mean") + K.WORKING_AGL_M)))


def predict_grids(requests: DataFrame, lattice: DataFrame, live: DataFrame | None = None,
                  evidence: Column | None = None, missing: str = "drop",
                  draws: int = K.MONTE_CARLO_DRAWS, seed: int = 0, rounded: bool = True) -> DataFrame:
    """Heat cells (request_id, row, col, lat, lon, p_mean, p_std) without a trained model.

    Noise runs and observed climbs join once per request. One shuffle spreads the
    requests; from there on a cell is arithmetic on its row, so the 201 rows and 40,401
    cells of a request never move between tasks.
    """
    ready = montecarlo.physics_draws(prepared_requests(requests, lattice, missing=missing), draws=draws,
                                     seed=seed)
    slim = ready.select("request_id", "c_i", "c_j", "elevation_window", *montecarlo.BASE)
    if live is not None:
        placed = fusion.climb_placements(TR.with_centre(requests), live, evidence)
        slim = slim.join(fusion.grid_boosts(placed), ["c_i", "c_j"], "left")
    rows = TR.grid_rows(slim, carried={"boost": ("boosts", "row")} if live is not None else {})
    cells = montecarlo.physics_monte_carlo(TR.grid_cells(rows), draws)
    heat = F.col("p_mean")
    if live is not None:
        heat = fusion.fused(heat, F.get(F.col("boost"), F.col("col")))
    clipped = F.least(F.greatest(heat, F.lit(0.0)), F.lit(1.0))
    std = F.col("p_std")
    if rounded:
        clipped, std = round_probability(clipped), round_probability(std)
    return cells.select(*CELL_KEYS, "lat", "lon", clipped.alias("p_mean"), std.alias("p_std"))


def grid_features(requests: DataFrame, lattice: DataFrame, landcover: DataFrame | None = None,
                  missing: str = "drop", ts: str = "ts") -> DataFrame:
    """The 22-column feature matrix of every cell of every request."""
    values = ("elevation",) if landcover is None else ("elevation", "land_use_heat", "land_use_albedo")
    ready = prepared_requests(requests, lattice, landcover, missing).select("*", *time_features(ts))
    ready = ready.drop("lat", "lon")
    cells = TR.grid_cells(TR.grid_rows(ready, values), values)
    return build_features(cells, CELL_KEYS, ts)


def predict_grids_with_model(requests: DataFrame, lattice: DataFrame, forest: Forest,
                             landcover: DataFrame | None = None, live: DataFrame | None = None,
                             evidence: Column | None = None, missing: str = "drop", ts: str = "ts",
                             draws: int = K.MONTE_CARLO_DRAWS, seed: int = 0, rounded: bool = True) -> DataFrame:
    """Heat cells (request_id, row, col, lat, lon, p_mean, p_std) of a fitted forest.

    ``ts`` is the time the grid answers for, forecast hours included. Runs are evaluated
    once per request and pattern of cell tests, however many cells share the pattern.
    A request's windows and weather cross the network, its cells never do.
    """
    values = ("elevation",) if landcover is None else ("elevation", *LAYERS)
    layers = dict(zip(LAYERS, K.LAND_DEFAULT if landcover is None else (None, None)))
    timed = time_features(ts)
    ready = prepared_requests(requests, lattice, landcover, missing).select(
        "request_id", "c_i", "c_j", F.col("alt_amsl").cast("double").alias("alt_amsl"),
        *[f"{v}_window" for v in values], *timed)
    spread = Uncertainty(forest, draws, seed)
    weather = requests.where(F.col("request_id").isNotNull()).select("request_id", *spread.noisy)
    grids = ready.join(weather, "request_id")
    if live is None:
        # Not by the join's key alone, or adaptive execution folds the tasks of the join.
        grids = TR.spread(grids, ("request_id", "c_i", "c_j"))
    else:
        centred = TR.with_centre(requests)
        grids = fusion.with_boosts(grids, centred, fusion.grid_boosts(fusion.climb_placements(centred, live, evidence)))
    return spread.heat_cells(grids, layers, ("hour_sin", "hour_cos", "doy_sin", "doy_cos"), rounded)


def grid_summary(heat: DataFrame) -> DataFrame:
    """Per request: peak, mean and centre heat, mean uncertainty and cell count."""
    cell = F.col("row") * fusion.SIDE + F.col("col")
    return heat.groupBy("request_id").agg(
        F.max("p_mean").alias("heat_max"), F.avg("p_mean").alias("heat_mean"),
        F.avg("p_std").alias("std_mean"), F.count(F.lit(1)).alias("cells"),
        F.max(F.when(cell == centre_index(fusion.SIDE, fusion.SIDE), F.col("p_mean"))).alias("heat_centre"))


def response_header(requests: DataFrame, lattice: DataFrame, missing: str = "drop") -> DataFrame:
    """What is sent next to the heat cells: grid, altitude used, rounded weather."""
    ready = prepared_requests(requests, lattice, missing=missing)
    whole = [c for c in ("wind_dir", "cape", "cin", "solar_ghi", "pbl_height")]
    tenth = [c for c in ("temp_2m", "wind_speed", "lapse_rate", "soil_temp")]
    return ready.select(
        "request_id", F.lit(fusion.SIDE).alias("rows"), F.lit(fusion.SIDE).alias("cols"),
        F.round(F.col("c_i") * K.TERRAIN_RES, 6).alias("grid_lat"),
        F.round(F.col("c_j") * K.TERRAIN_RES, 6).alias("grid_lon"),
        F.rint("alt_amsl").cast("int").alias("alt_amsl"),
        F.rint(F.col("alt_amsl") - F.col("terrain_mean")).cast("int").alias("alt_agl"),
        "alt_source", "thermal_base",
        F.rint(F.col("humidity") * 100).cast("int").alias("humidity"),
        *[F.rint(c).cast("int").alias(c) for c in whole],
        *[F.bround(c, 1).alias(c) for c in tenth])
