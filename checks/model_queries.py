"""Terrain, weather, land cover, prior, prediction, metrics and training."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.feed_queries import FEED_RUNS, KIN_SQL, THIN_SQL, thinned
from checks.registry import YEAR_START, query, r6
from updraft import constants as K
from updraft.functions import atmosphere as A
from updraft.functions import geo as G
from updraft.functions.rules import (
    above_thermal_base, is_dark, is_evidence, physics_probability, plausible_coordinates,
    round_probability, terrain_multiplier)
from updraft.functions.solar import cos_incidence, solar_feature, sun_position
from updraft.operators import fusion, landcover, metrics, montecarlo, prior, sampling, splits
from updraft.operators import live as L
from updraft.operators import terrain as TR
from updraft.operators import weather as W
from updraft.operators.forest import NOISY, Forest, Split
from updraft.operators.forest import scored as scored_by_forest
from updraft.operators.occupants import first_candidates, grid_occupants
from updraft.plans import evaluation, predict, samples, training

# --- Geometry ----------------------------------------------------------------


@query("spatial_scalars", ["beacons"], """
WITH b AS (SELECT *, lat_hist - 46.8e0 AS la, lon - 15.03e0 AS lo FROM beacons)
SELECT seq, CAST(round_even(lat / 0.01e0, 0) AS BIGINT) AS lattice_i, round(round_even(lon / 0.01e0, 0) * 0.01e0, 6) AS snapped,
  CAST(floor(la / 0.01e0) AS BIGINT) AS prior_i, CAST(floor(lo / 0.01e0) AS BIGINT) AS prior_j,
  round_even(lat_hist * 2, 0) / 2 AS weather_lat, CAST(round_even(lon * 10000, 0) AS BIGINT) AS key4,
  concat(CASE WHEN floor(la / 3) >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(CAST(abs(floor(la / 3) * 3) AS BIGINT) AS VARCHAR), 2, '0'),
         CASE WHEN floor(lon / 3) >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(CAST(abs(floor(lon / 3) * 3) AS BIGINT) AS VARCHAR), 3, '0')) AS tile,
  CASE WHEN lat BETWEEN 46.01 AND 46.03 AND lon BETWEEN 15.01 AND 15.05
    THEN CAST(round_even((lat - 46.01e0) / (46.03e0 - 46.01e0) * 20, 0) * 41 + round_even((lon - 15.01e0) / (15.05e0 - 15.01e0) * 40, 0) AS BIGINT) END AS cell,
  CAST(least(99, greatest(0, floor((lon - 15.01e0) / (15.05e0 - 15.01e0) * 99 + 0.5e0))) AS INT) AS x,
  CAST(least(49, greatest(0, floor((46.03e0 - lat) / (46.03e0 - 46.01e0) * 49 + 0.5e0))) AS INT) AS y,
  ((dayofyear(ts_hist) % 365) * 361 + CAST(round_even((lat_hist + 90) * 2, 0) AS BIGINT)) * 721 + CAST(round_even((lon + 180) * 2, 0) AS BIGINT) AS gid,
  CAST(epoch(date_trunc('hour', ts_hist)) AS BIGINT) AS hour, alt - 400 BETWEEN -90 AND 90 AS plausible FROM b""")
def _(read):
    b = read("beacons").withColumn("la", F.col("lat_hist") - 46.8).withColumn("lo", F.col("lon") - 15.03)
    x, y = G.screen_xy("lat", "lon", 46.01, 46.03, 15.01, 15.05, 50, 100)
    return b.select(
        "seq", G.lattice_index("lat").alias("lattice_i"), G.snap("lon").alias("snapped"),
        G.prior_cell("la").alias("prior_i"), G.prior_cell("lo").alias("prior_j"),
        G.weather_cell("lat_hist").alias("weather_lat"), G.point_key("lon", 4).alias("key4"),
        G.tile_name("la", "lon").alias("tile"),
        G.grid_index("lat", "lon", 46.01, 46.03, 15.01, 15.05, 21, 41).alias("cell"), x.alias("x"), y.alias("y"),
        G.group_id(F.dayofyear("ts_hist"), "lat_hist", "lon").alias("gid"),
        F.unix_seconds(G.hour_of("ts_hist")).alias("hour"),
        plausible_coordinates((F.col("alt") - 400).cast("double"), F.lit(0.0)).alias("plausible"))


# --- Prior -------------------------------------------------------------------

INDEX = """idx AS (SELECT CAST(epoch(date_trunc('hour', ts_hist)) AS BIGINT) AS hour, CAST(floor(lat_hist / 0.01e0) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.01e0) AS BIGINT) AS lon_cell,
  CAST(sum(CASE WHEN circling AND vario > 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS climbs, count(*) AS total
  FROM beacons WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, true) GROUP BY ALL)"""


def index_of(read):
    return prior.climb_index(read("beacons"), ts="ts_hist", lat="lat_hist")


@query("climb_index", ["beacons"], f"WITH {INDEX} SELECT * FROM idx")
def climb_index(read):
    return index_of(read).withColumn("hour", F.unix_seconds("hour"))


@query("index_statistics", ["beacons"], f"""WITH {INDEX}
SELECT count(*) AS buckets, count(DISTINCT hour) AS hours, CAST(sum(climbs) AS BIGINT) AS climbs, CAST(sum(total) AS BIGINT) AS beacons,
  round(sum(climbs) / sum(total), 6) AS global_rate FROM idx""")
def _(read):
    return prior.index_statistics(index_of(read)).withColumn("global_rate", F.round("global_rate", 6))


PRIOR = """
q AS (SELECT DISTINCT CAST(floor(lat_hist / 0.01e0) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.01e0) AS BIGINT) AS lon_cell,
  CAST(epoch(date_trunc('hour', ts_hist - INTERVAL 24 HOURS)) AS BIGINT) AS cutoff FROM beacons),
g AS (SELECT c.cutoff, sum(i.climbs) / sum(i.total) AS rate FROM (SELECT DISTINCT cutoff FROM q) c JOIN idx i ON i.hour < c.cutoff GROUP BY c.cutoff),
s AS (SELECT q.*, coalesce(sum(i.climbs), 0) AS c, coalesce(sum(i.total), 0) AS t FROM q
  LEFT JOIN idx i ON i.lat_cell = q.lat_cell AND i.lon_cell = q.lon_cell AND i.hour < q.cutoff GROUP BY ALL),
pv AS (SELECT s.lat_cell, s.lon_cell, s.cutoff, CASE WHEN g.rate IS NULL THEN NULL WHEN s.t = 0 THEN g.rate ELSE (s.c + 50 * g.rate) / (s.t + 50) END AS prior
  FROM s LEFT JOIN g ON s.cutoff = g.cutoff)"""


@query("climb_prior", ["beacons"], f"""WITH {INDEX}, {PRIOR}
SELECT b.seq, round(pv.prior, 6) AS prior FROM beacons b JOIN pv ON pv.lat_cell = CAST(floor(b.lat_hist / 0.01e0) AS BIGINT)
  AND pv.lon_cell = CAST(floor(b.lon / 0.01e0) AS BIGINT) AND pv.cutoff = CAST(epoch(date_trunc('hour', b.ts_hist - INTERVAL 24 HOURS)) AS BIGINT)""")
def _(read):
    return prior.with_prior(read("beacons"), index_of(read), "ts_hist", "lat_hist").select("seq", *r6("prior"))


REQ = """rq AS (SELECT *, CAST(round_even(lat / 0.01e0, 0) AS BIGINT) AS c_i, CAST(round_even(lon / 0.01e0, 0) AS BIGINT) AS c_j FROM prediction_requests)"""


@query("prior_grid", ["beacons", "prediction_requests"], f"""WITH {INDEX}, {REQ},
cells AS (SELECT request_id, CAST(floor((c_i * 0.01e0 - 0.05e0 + r * 0.0005e0) / 0.01e0) AS BIGINT) AS lat_cell,
    CAST(floor((c_j * 0.01e0 - 0.05e0 + c * 0.0005e0) / 0.01e0) AS BIGINT) AS lon_cell, 1704067200 + hour_no // 1 * 3600 - 86400 AS cutoff, count(*) AS n
  FROM rq, range(0, 201) t(r), range(0, 201) u(c) GROUP BY ALL),
q AS (SELECT DISTINCT lat_cell, lon_cell, cutoff FROM cells),
g AS (SELECT c.cutoff, sum(i.climbs) / sum(i.total) AS rate FROM (SELECT DISTINCT cutoff FROM q) c JOIN idx i ON i.hour < c.cutoff GROUP BY c.cutoff),
s AS (SELECT q.*, coalesce(sum(i.climbs), 0) AS c, coalesce(sum(i.total), 0) AS t FROM q
  LEFT JOIN idx i ON i.lat_cell = q.lat_cell AND i.lon_cell = q.lon_cell AND i.hour < q.cutoff GROUP BY ALL),
pv AS (SELECT s.*, CASE WHEN g.rate IS NULL THEN NULL WHEN s.t = 0 THEN g.rate ELSE (s.c + 50 * g.rate) / (s.t + 50) END AS prior FROM s LEFT JOIN g ON s.cutoff = g.cutoff)
SELECT request_id, CAST(sum(n) FILTER (prior IS NOT NULL) AS BIGINT) AS cells, round(sum(n * prior), 5) AS total FROM cells JOIN pv USING (lat_cell, lon_cell, cutoff) GROUP BY request_id""")
def _(read):
    return prior.grid_prior(read("prediction_requests"), index_of(read)).groupBy("request_id").agg(
        F.when(F.count("prior") > 0, F.count("prior")).alias("cells"), F.round(F.sum("prior"), 5).alias("total"))


# --- Weather -----------------------------------------------------------------

WX = """wx AS (SELECT lat_b, lon_b, hour_no, t2 AS temp_2m, hum / 100 AS humidity, ws AS wind_speed, wd AS wind_dir,
    0 - ws * sin(radians(wd)) AS wind_u, 0 - ws * cos(radians(wd)) AS wind_v, cape, cin, ghi AS solar_ghi, (t8 - t5) / 3.5e0 AS lapse_rate,
    greatest(0, CAST(trunc((t2 - 8) / greatest(1, (t2 - t8) / 1.5e0) * 1000) AS INT)) AS thermal_base, pbl AS pbl_height, soil AS soil_temp
  FROM (SELECT lat_b, lon_b, hour_no, coalesce(temp_2m, 18e0) AS t2, coalesce(humidity_pct, 60e0) AS hum, coalesce(wind_speed, 12e0) AS ws, coalesce(wind_dir, 270e0) AS wd,
    coalesce(cape, 600e0) AS cape, coalesce(cin, -30e0) AS cin, coalesce(solar_ghi, 500e0) AS ghi, coalesce(temp_850, 5e0) AS t8, coalesce(temp_500, -12e0) AS t5,
    coalesce(pbl_height, 1500e0) AS pbl, coalesce(soil_temp, 20e0) AS soil FROM weather_hours))"""
BW = """bw AS (SELECT *, round_even(lat_hist * 2, 0) / 2 AS lat_b, round_even(lon * 2, 0) / 2 AS lon_b,
  CAST((epoch(date_trunc('hour', ts_hist)) - 1704067200) / 3600 AS BIGINT) AS hour_no FROM beacons)"""
WXCOLS = ("temp_2m", "humidity", "wind_u", "wind_v", "cape", "cin", "solar_ghi", "lapse_rate", "pbl_height", "soil_temp")


def observed_weather(read, strict):
    weather = read("weather_hours")
    rows = read("beacons").withColumn("lat", F.col("lat_hist"))
    return W.with_weather(W.with_weather_key(rows, "ts_hist"), weather, strict)


@query("weather_join", ["beacons", "weather_hours"], f"""WITH {WX}, {BW}
SELECT seq, {', '.join(f"round(CASE WHEN wx.hour_no IS NULL THEN {v} ELSE wx.{c} END, 6) AS {c}" for c, v in dict(
    temp_2m='18e0', humidity='0.6e0', wind_u='-12e0 * sin(radians(270e0))', wind_v='-12e0 * cos(radians(270e0))', cape='600e0', cin='-30e0',
    solar_ghi='500e0', lapse_rate='4.9e0', pbl_height='1500e0', soil_temp='20e0').items())},
  CASE WHEN wx.hour_no IS NULL THEN 1200 ELSE thermal_base END AS thermal_base
FROM bw LEFT JOIN wx ON bw.lat_b = wx.lat_b AND bw.lon_b = wx.lon_b AND bw.hour_no = wx.hour_no""")
def _(read):
    return observed_weather(read, False).select("seq", *r6(*WXCOLS), "thermal_base")


@query("weather_strict", ["beacons", "weather_hours"], f"""WITH {WX}, {BW}
SELECT seq, round(wx.cape, 6) AS cape, wx.solar_ghi < 50 AS dark, thermal_base > 0 AND alt - 250 > thermal_base + 300 AS above
FROM bw JOIN wx ON bw.lat_b = wx.lat_b AND bw.lon_b = wx.lon_b AND bw.hour_no = wx.hour_no""")
def _(read):
    return observed_weather(read, True).select(
        "seq", *r6("cape"), is_dark().alias("dark"), above_thermal_base("alt", F.lit(250), "thermal_base").alias("above"))


@query("forecast_weather", ["prediction_requests", "weather_hours"], f"""WITH {WX},
f AS (SELECT *, hour_no - first_no AS hour_index, first_no, last_no FROM (SELECT *, min(hour_no) OVER (PARTITION BY lat_b) AS first_no, max(hour_no) OVER (PARTITION BY lat_b) AS last_no FROM wx)),
r AS (SELECT request_id, round_even(lat * 2, 0) / 2 AS lat_b, hour_no + request_id % 48 + CASE WHEN request_id % 10 = 9 THEN 900 ELSE 0 END AS want FROM prediction_requests)
SELECT request_id, CAST(least(greatest(want - f0.first_no, 0), f0.last_no - f0.first_no) AS INT) AS hour_index, coalesce(f.cape, 600e0) AS cape, coalesce(f.temp_2m, 18e0) AS temp_2m
FROM r JOIN (SELECT DISTINCT lat_b, first_no, last_no FROM f) f0 ON f0.lat_b = r.lat_b
LEFT JOIN f ON f.lat_b = r.lat_b AND f.hour_index = least(greatest(want - f0.first_no, 0), f0.last_no - f0.first_no)""")
def _(read):
    weather = read("weather_hours")
    first = F.min(F.unix_seconds("hour")).over(Window.partitionBy("lat_b", "lon_b"))
    hourly = weather.withColumn("hour_index", ((F.unix_seconds("hour") - first) / 3600).cast("int"))
    late = F.when(F.col("request_id") % 10 == 9, 900).otherwise(0)
    asked = read("prediction_requests").select(
        "request_id", G.weather_cell("lat").alias("lat_b"), G.weather_cell("lon").alias("lon_b"),
        F.col("ts").alias("now"), (F.col("request_id") % 48 + late).cast("int").alias("forecast_h"))
    return W.with_forecast(asked, hourly).select("request_id", "hour_index", "cape", "temp_2m")


# --- Terrain -----------------------------------------------------------------

SLOPE = """degrees(atan(sqrt(pow({dx}, 2) + pow({dy}, 2)))) AS slope,
  CASE WHEN pow({dx}, 2) + pow({dy}, 2) < 1e-18 THEN 180 WHEN degrees(atan2(-{dx}, -{dy})) < 0 THEN degrees(atan2(-{dx}, -{dy})) + 360 ELSE degrees(atan2(-{dx}, -{dy})) END AS aspect"""
GRID = f"""{REQ},
good AS (SELECT c_i, c_j FROM (SELECT DISTINCT c_i, c_j FROM rq) c JOIN elevation_points e ON e.lat_i BETWEEN c_i - 5 AND c_i + 5 AND e.lon_j BETWEEN c_j - 5 AND c_j + 5
  GROUP BY c_i, c_j HAVING count(*) = 121),
centres AS (SELECT c_i, c_j, r, c, c_i * 0.01e0 - 0.05e0 + r * 0.0005e0 AS lat, c_j * 0.01e0 - 0.05e0 + c * 0.0005e0 AS lon,
  least(r // 20, 9) AS a, least(c // 20, 9) AS b, r / 20e0 - least(r // 20, 9) AS wy, c / 20e0 - least(c // 20, 9) AS wx
  FROM good, range(0, 201) t(r), range(0, 201) u(c)),
fine AS (SELECT n.*, (e00.elevation * (1 - wx) + e01.elevation * wx) * (1 - wy) + (e10.elevation * (1 - wx) + e11.elevation * wx) * wy AS elevation
  FROM centres n
  JOIN elevation_points e00 ON e00.lat_i = c_i - 5 + a AND e00.lon_j = c_j - 5 + b JOIN elevation_points e01 ON e01.lat_i = c_i - 5 + a AND e01.lon_j = c_j - 4 + b
  JOIN elevation_points e10 ON e10.lat_i = c_i - 4 + a AND e10.lon_j = c_j - 5 + b JOIN elevation_points e11 ON e11.lat_i = c_i - 4 + a AND e11.lon_j = c_j - 4 + b),
diff AS (SELECT c_i, c_j, r, c, lat, lon, elevation,
  (coalesce(lead(elevation) OVER wr, elevation) - coalesce(lag(elevation) OVER wr, elevation)) / ((CASE WHEN c IN (0, 200) THEN 1 ELSE 2 END) * (0.0005e0 * 111320 * cos(radians(c_i * 0.01e0)))) AS dx,
  (coalesce(lead(elevation) OVER wc, elevation) - coalesce(lag(elevation) OVER wc, elevation)) / ((CASE WHEN r IN (0, 200) THEN 1 ELSE 2 END) * (0.0005e0 * 111320)) AS dy
  FROM fine WINDOW wr AS (PARTITION BY c_i, c_j, r ORDER BY c), wc AS (PARTITION BY c_i, c_j, c ORDER BY r)),
grid AS (SELECT *, {SLOPE.format(dx='dx', dy='dy')} FROM diff)"""


@query("upsample_terrain", ["prediction_requests", "elevation_points"], f"""WITH {GRID}
SELECT request_id, r AS row, round(avg(elevation), 5) AS elevation, round(avg(slope), 5) AS slope, round(avg(sin(radians(aspect)) * slope), 5) AS facing,
  round(min(grid.lat), 6) AS lat, round(max(grid.lon), 6) AS lon FROM rq JOIN grid USING (c_i, c_j) GROUP BY request_id, r""")
def _(read):
    cells = TR.upsample(read("prediction_requests"), read("elevation_points"))
    return cells.groupBy("request_id", "row").agg(
        F.round(F.avg("elevation"), 5).alias("elevation"), F.round(F.avg("slope"), 5).alias("slope"),
        F.round(F.avg(F.sin(F.radians("aspect")) * F.col("slope")), 5).alias("facing"),
        F.round(F.min("lat"), 6).alias("lat"), F.round(F.max("lon"), 6).alias("lon"))


@query("slope_aspect", ["elevation_points"], f"""
WITH z AS (SELECT (lat_i - 4593) // 50 AS zone, (lat_i - 4593) % 50 AS row, lon_j - 1493 AS col, elevation FROM elevation_points),
d AS (SELECT *, (coalesce(lead(elevation) OVER wr, elevation) - coalesce(lag(elevation) OVER wr, elevation))
    / ((CASE WHEN lead(elevation) OVER wr IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(elevation) OVER wr IS NULL THEN 0 ELSE 1 END) * 1113.2e0) AS dx,
  (coalesce(lead(elevation) OVER wc, elevation) - coalesce(lag(elevation) OVER wc, elevation))
    / ((CASE WHEN lead(elevation) OVER wc IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(elevation) OVER wc IS NULL THEN 0 ELSE 1 END) * 1113.2e0) AS dy
  FROM z WINDOW wr AS (PARTITION BY zone, row ORDER BY col), wc AS (PARTITION BY zone, col ORDER BY row)),
s AS (SELECT *, {SLOPE.format(dx='dx', dy='dy')} FROM d)
SELECT zone, row, col, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM s""")
def _(read):
    grid = read("elevation_points").select(
        F.floor((F.col("lat_i") - 4593) / 50).alias("zone"), ((F.col("lat_i") - 4593) % 50).alias("row"),
        (F.col("lon_j") - 1493).alias("col"), "elevation")
    return TR.with_slope_aspect(grid, ["zone"], cell_m=1113.2).select("zone", "row", "col", *r6("slope", "aspect"))


# --- Land cover --------------------------------------------------------------

HEAT = "CASE class " + " ".join(f"WHEN {k} THEN {h}e0" for k, (h, _) in K.LAND_CLASSES.items()) + " ELSE 0.4e0 END"
ALBEDO = "CASE class " + " ".join(f"WHEN {k} THEN {a}e0" for k, (_, a) in K.LAND_CLASSES.items()) + " ELSE 0.2e0 END"


@query("landcover_class", ["landcover_pixels"], f"""
SELECT class, count(*) AS n, round(avg({HEAT}), 6) AS heat, round(avg({ALBEDO}), 6) AS albedo FROM landcover_pixels GROUP BY class""")
def _(read):
    return landcover.with_landcover_class(read("landcover_pixels")).groupBy("class").agg(
        F.count("*").alias("n"), F.round(F.avg("land_use_heat"), 6).alias("heat"),
        F.round(F.avg("land_use_albedo"), 6).alias("albedo"))


def cover_cells(read, rows=7, cols=7):
    pixels = read("landcover_pixels").select(
        "area", "px", "py", "class", F.lit(46.4).alias("raster_north"), F.lit(15.0).alias("raster_west"),
        F.lit(0.01).alias("pixel_deg"), F.lit(46.003).alias("south"), F.lit(15.003).alias("west"), F.lit(0.05).alias("cell_deg"))
    return landcover.block_average(landcover.pixel_cells(pixels, rows, cols), ["area"], rows, cols)


COVER = f"""px AS (SELECT area, class,
    CAST(least(6, greatest(0, round_even((46.4e0 - (py + 0.5e0) * 0.01e0 - 46.003e0) / 0.05e0, 0))) AS INT) AS row,
    CAST(least(6, greatest(0, round_even((15e0 + (px + 0.5e0) * 0.01e0 - 15.003e0) / 0.05e0, 0))) AS INT) AS col FROM landcover_pixels
  WHERE (46.4e0 - (py + 0.5e0) * 0.01e0 - 46.003e0) / 0.05e0 BETWEEN -0.5e0 AND 6.5e0 AND (15e0 + (px + 0.5e0) * 0.01e0 - 15.003e0) / 0.05e0 BETWEEN -0.5e0 AND 6.5e0),
avgs AS (SELECT area, row, col, avg({HEAT}) AS h, avg({ALBEDO}) AS a FROM px GROUP BY ALL),
cover AS (SELECT f.area, CAST(f.row AS INT) AS row, CAST(f.col AS INT) AS col, coalesce(h, 0e0) AS heat, coalesce(a, 0e0) AS albedo
  FROM (SELECT area, row, col FROM (SELECT DISTINCT area FROM landcover_pixels), range(0, 7) t(row), range(0, 7) u(col)) f
  LEFT JOIN avgs USING (area, row, col))"""


@query("landcover_grid", ["landcover_pixels"], f"""WITH {COVER}
SELECT area, row, col, round(heat + 1e-9, 6) AS heat, round(albedo + 1e-9, 6) AS albedo FROM cover""")
def _(read):
    return cover_cells(read).select(
        "area", "row", "col", F.round(F.col("land_use_heat") + 1e-9, 6).alias("heat"),
        F.round(F.col("land_use_albedo") + 1e-9, 6).alias("albedo"))


def cover_areas(read):
    return cover_cells(read).select(
        (46 + F.col("area") / F.lit(2.0)).alias("area_lat"), F.lit(15.0).alias("area_lon"), "row", "col",
        "land_use_heat", "land_use_albedo")


@query("landcover_point", ["beacons", "landcover_pixels"], f"""WITH {COVER},
b AS (SELECT seq, round_even(lat_hist * 2, 0) / 2 AS al, round_even(lon * 2, 0) / 2 AS ao, lat_hist, lon FROM beacons),
p AS (SELECT seq, al, ao, CAST(least(6, greatest(0, round_even((lat_hist - (al - 0.25e0)) / 0.5e0 * 6, 0))) AS INT) AS row,
  CAST(least(6, greatest(0, round_even((lon - (ao - 0.25e0)) / 0.5e0 * 6, 0))) AS INT) AS col FROM b)
SELECT seq, round(coalesce(heat, 0.4e0) + 1e-9, 6) AS heat, round(coalesce(albedo, 0.2e0) + 1e-9, 6) AS albedo FROM p
LEFT JOIN cover ON 46 + cover.area / 2 = p.al AND p.ao = 15 AND cover.row = p.row AND cover.col = p.col""")
def _(read):
    rows = landcover.with_landcover_at_point(read("beacons").select("seq", "lat_hist", "lon"), cover_areas(read),
                                             side=7, lat="lat_hist")
    return rows.select("seq", F.round(F.col("land_use_heat") + 1e-9, 6).alias("heat"),
                       F.round(F.col("land_use_albedo") + 1e-9, 6).alias("albedo"))


def cover_rasters(read):
    """A 40 x 40 raster per area, placed over the requests' zones; the last areas lack pixels."""
    area = read("landcover_pixels").select(F.col("area").alias("tile")).distinct()
    return area.select("tile", (46.1 + F.col("tile") / F.lit(2.0)).alias("raster_north"), F.lit(14.95).alias("raster_west"),
                       F.lit(0.004).alias("pixel_deg"), F.lit(40).alias("width"), F.lit(40).alias("height"))


def cover_windows(read, centred):
    """Cover windows around the (tile, c_i, c_j) of ``centred``."""
    pixels = read("landcover_pixels").withColumnRenamed("area", "tile")
    rasters = cover_rasters(read)
    return landcover.cover_windows(centred, landcover.summed_area(pixels, rasters), rasters)


def centred_requests(read):
    return TR.with_centre(read("prediction_requests")).withColumn("tile", F.col("request_id") % 4)


def window_sql(centres: str) -> str:
    """Means of the 11 x 11 cells around each of the centres (z, c_i, c_j), pixel by pixel."""
    return f"""cw0 AS (SELECT DISTINCT z, c_i, c_j FROM {centres} WHERE z IN (SELECT area FROM landcover_pixels)),
cpx AS (SELECT z, c_i, c_j, class, (46.1e0 + z / 2e0 - (py + 0.5e0) * 0.004e0 - (c_i * 0.01e0 - 0.05e0)) / 0.01e0 AS dn,
    (14.95e0 + (px + 0.5e0) * 0.004e0 - (c_j * 0.01e0 - 0.05e0)) / 0.01e0 AS al FROM cw0 JOIN landcover_pixels ON area = z),
cwa AS (SELECT z, c_i, c_j, least(10, greatest(0, round_even(dn, 0))) AS r, least(10, greatest(0, round_even(al, 0))) AS c, avg({HEAT}) AS heat, avg({ALBEDO}) AS albedo
  FROM cpx WHERE dn BETWEEN -0.5e0 AND 10.5e0 AND al BETWEEN -0.5e0 AND 10.5e0 GROUP BY ALL),
cw AS (SELECT k.z, k.c_i, k.c_j, k.r, k.c, CASE WHEN k.z NOT IN (SELECT area FROM landcover_pixels) THEN 0.4e0 ELSE coalesce(heat, 0) END AS heat,
    CASE WHEN k.z NOT IN (SELECT area FROM landcover_pixels) THEN 0.2e0 ELSE coalesce(albedo, 0) END AS albedo
  FROM (SELECT DISTINCT z, c_i, c_j, r, c FROM {centres}, range(0, 11) t(r), range(0, 11) u(c)) k
  LEFT JOIN cwa USING (z, c_i, c_j, r, c))"""


ZQ = "zq AS (SELECT *, request_id % 4 AS z FROM rq)"


@query("landcover_window", ["prediction_requests", "landcover_pixels"], f"""WITH {REQ}, {ZQ}, {window_sql('zq')}
SELECT request_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(heat + 1e-9, 6) AS heat, round(albedo + 1e-9, 6) AS albedo FROM zq JOIN cw USING (z, c_i, c_j)""")
def _(read):
    asked = centred_requests(read)
    filled = landcover.with_cover_windows(asked, cover_windows(read, asked))
    cells = filled.select("request_id", F.posexplode(F.arrays_zip(*[f"{v}_window" for v in landcover.LAYERS])).alias("k", "v"))
    return cells.select(
        "request_id", F.floor(F.col("k") / 11).cast("int").alias("row"), (F.col("k") % 11).alias("col"),
        F.round(F.col("v.land_use_heat_window") + 1e-9, 6).alias("heat"),
        F.round(F.col("v.land_use_albedo_window") + 1e-9, 6).alias("albedo"))


COVER_FINE = """cf AS (SELECT n.z, n.c_i, n.c_j, n.r, n.c, (v00.heat * (1 - wx) + v01.heat * wx) * (1 - wy) + (v10.heat * (1 - wx) + v11.heat * wx) * wy AS heat,
    (v00.albedo * (1 - wx) + v01.albedo * wx) * (1 - wy) + (v10.albedo * (1 - wx) + v11.albedo * wx) * wy AS albedo
  FROM (SELECT DISTINCT z, c_i, c_j, r, c, least(r // 20, 9) AS a, least(c // 20, 9) AS b, r / 20e0 - least(r // 20, 9) AS wy, c / 20e0 - least(c // 20, 9) AS wx
    FROM zq, range(0, 201) t(r), range(0, 201) u(c)) n
  JOIN cw v00 ON v00.z = n.z AND v00.c_i = n.c_i AND v00.c_j = n.c_j AND v00.r = a AND v00.c = b JOIN cw v01 ON v01.z = n.z AND v01.c_i = n.c_i AND v01.c_j = n.c_j AND v01.r = a AND v01.c = b + 1
  JOIN cw v10 ON v10.z = n.z AND v10.c_i = n.c_i AND v10.c_j = n.c_j AND v10.r = a + 1 AND v10.c = b JOIN cw v11 ON v11.z = n.z AND v11.c_i = n.c_i AND v11.c_j = n.c_j AND v11.r = a + 1 AND v11.c = b + 1)"""


@query("upsample_landcover", ["prediction_requests", "landcover_pixels"], f"""WITH {REQ}, {ZQ}, {window_sql('zq')}, {COVER_FINE}
SELECT request_id, r AS row, count(*) AS n, round(avg(heat) + 1e-9, 5) AS heat, round(max(albedo) + 1e-9, 5) AS albedo FROM zq JOIN cf USING (z, c_i, c_j) GROUP BY request_id, r""")
def _(read):
    asked = centred_requests(read)
    filled = landcover.with_cover_windows(asked, cover_windows(read, asked)).drop("lat", "lon")
    cells = TR.grid_cells(TR.grid_rows(filled, landcover.LAYERS), landcover.LAYERS)
    return cells.groupBy("request_id", "row").agg(
        F.count("*").alias("n"), F.round(F.avg("land_use_heat") + 1e-9, 5).alias("heat"),
        F.round(F.max("land_use_albedo") + 1e-9, 5).alias("albedo"))


@query("landcover_at_centre", ["beacons", "landcover_pixels"], f"""WITH
zb AS (SELECT seq, lat_hist, lon, CAST(floor((lat_hist - 46) * 2) AS BIGINT) AS z, CAST(round_even(lat_hist / 0.01e0, 0) AS BIGINT) AS c_i, CAST(round_even(lon / 0.01e0, 0) AS BIGINT) AS c_j FROM beacons),
{window_sql('zb')},
p AS (SELECT *, least(10, greatest(0, round_even((lat_hist - (c_i * 0.01e0 - 0.05e0)) / 0.1e0 * 10, 0))) AS r, least(10, greatest(0, round_even((lon - (c_j * 0.01e0 - 0.05e0)) / 0.1e0 * 10, 0))) AS c FROM zb)
SELECT seq, round(heat + 1e-9, 6) AS heat, round(albedo + 1e-9, 6) AS albedo FROM p JOIN cw USING (z, c_i, c_j, r, c)""")
def _(read):
    points = TR.with_centre(read("beacons").select("seq", "lat_hist", "lon"), "lat_hist").withColumn(
        "tile", F.floor((F.col("lat_hist") - 46) * 2))
    rows = landcover.with_landcover_at_centre(points, cover_windows(read, points), lat="lat_hist")
    return rows.select("seq", F.round(F.col("land_use_heat") + 1e-9, 6).alias("heat"),
                       F.round(F.col("land_use_albedo") + 1e-9, 6).alias("albedo"))


# --- Sun and physics ---------------------------------------------------------

SUN = """s0 AS (SELECT seq, lat_hist AS lat, lon, dayofyear(ts_hist) AS doy, hour(ts_hist) + minute(ts_hist) / 60e0 AS h,
    seq % 40 AS slope, seq * 7 % 360 AS aspect, 200 + seq % 300 AS elevation FROM beacons),
s1 AS (SELECT *, 2 * pi() / 365 * (doy - 1 + (h - 12) / 24) AS g FROM s0),
s2 AS (SELECT *, 0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.001480e0 * sin(3 * g) AS d,
    h * 60 + 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) + 4 * lon AS m FROM s1),
s3 AS (SELECT *, radians((m - 1440 * floor(m / 1440)) / 4 - 180) AS w, radians(lat) AS p FROM s2),
s4 AS (SELECT *, degrees(asin(greatest(-1, least(1, sin(p) * sin(d) + cos(p) * cos(d) * cos(w))))) AS sun_elevation,
    degrees(atan2(0 - cos(d) * sin(w), sin(d) * cos(p) - cos(d) * sin(p) * cos(w))) AS az FROM s3),
sun AS (SELECT *, CASE WHEN az < 0 THEN az + 360 ELSE az END AS sun_azimuth,
    CASE WHEN sun_elevation <= 0 THEN 0 ELSE least(1, greatest(0, cos(radians(slope)) * sin(radians(sun_elevation))
      + sin(radians(slope)) * cos(radians(sun_elevation)) * cos(radians(az - aspect)))) END AS incidence FROM s4)"""


@query("solar_incidence", ["beacons"], f"""WITH {SUN}
SELECT seq, round(sun_elevation, 5) AS sun_elevation, round(sun_azimuth, 5) AS sun_azimuth, round(incidence, 6) AS incidence, round(incidence, 6) AS stored FROM sun""")
def _(read):
    hour, doy = A.decimal_hour("ts_hist"), F.dayofyear("ts_hist")
    h_sin, h_cos = A.cyclic(hour, 24)
    d_sin, d_cos = A.cyclic(doy, 365)
    rows = read("beacons").select(
        "seq", F.col("lat_hist").alias("lat"), "lon", hour.alias("h"), doy.alias("doy"), (F.col("seq") % 40).alias("slope"),
        (F.col("seq") * 7 % 360).alias("aspect"), h_sin.alias("hour_sin"), h_cos.alias("hour_cos"),
        d_sin.alias("doy_sin"), d_cos.alias("doy_cos"))
    elevation, azimuth = sun_position("lat", "lon", "doy", "h")
    rows = rows.select("*", elevation.alias("e"), azimuth.alias("a"))
    return rows.select("seq", F.round("e", 5).alias("sun_elevation"), F.round("a", 5).alias("sun_azimuth"),
                       F.round(cos_incidence("slope", "aspect", "e", "a"), 6).alias("incidence"),
                       F.round(solar_feature(), 6).alias("stored"))


MULT = "(0.75e0 + 0.25e0 * cos(radians(aspect - 180))) * least(1.4e0, greatest(1, 1 + slope / 45e0)) * least(1.25e0, greatest(1, 1 + elevation / 800e0))"


@query("physics_score", ["beacons"], f"""
WITH f AS (SELECT seq, seq % 40 AS slope, seq * 7 % 360 AS aspect, 200 + seq % 300 AS elevation, CAST(seq * 11 % 1800 AS DOUBLE) AS cape,
  CAST(0 - seq * 17 % 250 AS DOUBLE) AS cin, CAST(seq * 3 % 900 AS DOUBLE) AS ghi FROM beacons),
s AS (SELECT *, {MULT} AS m, least(1, greatest(0, cape / 1500)) * (0.4e0 + 0.6e0 * least(1, greatest(0, ghi / 600))) * least(1, greatest(0, 1 - abs(cin) / 200)) AS w FROM f)
SELECT seq, round(m + 1e-9, 6) AS multiplier, round(least(1, greatest(0, w * m)) + 1e-9, 6) AS p, round(round_even(least(1, greatest(0, w * m)), 3), 6) AS p3 FROM s""")
def _(read):
    s = F.col("seq")
    rows = read("beacons").select(
        "seq", (s % 40).alias("slope"), (s * 7 % 360).alias("aspect"), (200 + s % 300).alias("elevation"),
        (s * 11 % 1800).cast("double").alias("cape"), (0 - s * 17 % 250).cast("double").alias("cin"),
        (s * 3 % 900).cast("double").alias("solar_ghi"))
    p = physics_probability()
    return rows.select("seq", F.round(terrain_multiplier() + 1e-9, 6).alias("multiplier"), F.round(p + 1e-9, 6).alias("p"),
                       round_probability(p).alias("p3"))


@query("time_codes", ["beacons"], """
WITH h AS (SELECT seq, dayofyear(ts_hist) AS doy, hour(ts_hist) + minute(ts_hist) / 60e0 AS h, alt, seq % 900 AS ground, ts_hist FROM beacons)
SELECT seq, round(sin(2 * pi() * h / 24), 6) AS hour_sin, round(cos(2 * pi() * doy / 365), 6) AS doy_cos, round(h, 6) AS decoded_hour,
  CAST(epoch(date_trunc('minute', ts_hist)) AS BIGINT) AS decoded, CAST(greatest(0, alt - ground) AS DOUBLE) AS agl FROM h""")
def _(read):
    h_sin, h_cos = A.cyclic(A.decimal_hour("ts_hist"), 24)
    d_sin, d_cos = A.cyclic(F.dayofyear("ts_hist"), 365)
    rows = read("beacons").select("seq", "alt", h_sin.alias("hs"), h_cos.alias("hc"), d_sin.alias("ds"), d_cos.alias("dc"))
    when = A.decode_timestamp("hs", "hc", "ds", "dc", 2024)
    return rows.select(
        "seq", F.round("hs", 6).alias("hour_sin"), F.round("dc", 6).alias("doy_cos"),
        F.round(A.decode_cyclic("hs", "hc", 24), 6).alias("decoded_hour"),
        (F.rint(F.unix_micros(when) / 60e6) * 60).cast("bigint").alias("decoded"),
        A.height_above_ground("alt", F.col("seq") % 900).alias("agl"))


# --- Prediction --------------------------------------------------------------

UNIFORM = "((CAST(('0x' || substr(sha256(concat_ws('|', 0, request_id, d, '{c}', {k})), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def normal_sql(column: str) -> str:
    u1, u2 = UNIFORM.format(c=column, k=1), UNIFORM.format(c=column, k=2)
    return f"sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})"


RW = f"""{WX}, rw AS (SELECT q.request_id, q.c_i, q.c_j, q.alt_amsl, q.hour_no, x.* EXCLUDE (lat_b, lon_b, hour_no) FROM rq q JOIN wx x
  ON x.lat_b = round_even(q.lat * 2, 0) / 2 AND x.lon_b = round_even(q.lon * 2, 0) / 2 AND x.hour_no = q.hour_no)"""
RUNS = f"""dr AS (SELECT request_id, d, cape * (1 + 0.15e0 * {normal_sql('cape')}) AS cape, cin * (1 + 0.2e0 * {normal_sql('cin')}) AS cin,
    solar_ghi * (1 + 0.1e0 * {normal_sql('solar_ghi')}) AS ghi FROM rw, range(1, 51) t(d)),
runs AS (SELECT request_id, list(least(1, greatest(0, cape / 1500)) * (0.4e0 + 0.6e0 * least(1, greatest(0, ghi / 600))) * least(1, greatest(0, 1 - abs(cin) / 200))) AS w
  FROM dr GROUP BY request_id)"""
LIVE = """lv AS (SELECT id, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, arg_max(vario, seq) AS vario, arg_max(circling, seq) AS circling,
  arg_max(ac_type, seq) AS ac_type, arg_max_null(under_tow, seq) AS under_tow FROM beacons GROUP BY id),
pl AS (SELECT request_id, (lv.lat - (c_i * 0.01e0 - 0.05e0)) / 0.0005e0 AS ri, (lv.lon - (c_j * 0.01e0 - 0.05e0)) / 0.0005e0 AS ci, least(lv.vario / 5, 1) * 0.5e0 AS st
  FROM rq, lv WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, false) AND circling AND vario > 1.0),
bo AS (SELECT request_id, r, c, sum(exp(0 - (pow(r - ri, 2) + pow(c - ci, 2)) / 72) * st) AS boost FROM pl, range(0, 201) t(r), range(0, 201) u(c)
  WHERE ri >= 0 AND ri < 201 AND ci >= 0 AND ci < 201 AND r BETWEEN floor(ri) - 18 AND floor(ri) + 18 AND c BETWEEN floor(ci) - 18 AND floor(ci) + 18 GROUP BY ALL)"""


def requests_with_weather(read):
    keyed = W.with_weather_key(read("prediction_requests"))
    return W.with_weather(keyed, read("weather_hours"), strict=True)


def latest(read):
    return L.latest_by(read("beacons").select("id", "seq", "lat", "lon", "alt", "vario", "circling", "ac_type", "under_tow"), ["id"])


@query("predict_grid", ["prediction_requests", "elevation_points", "weather_hours", "beacons"], f"""WITH {GRID}, {RW}, {RUNS}, {LIVE},
heat AS (SELECT request_id, r, c, list_avg(list_transform(w, lambda x: least(1, x * m))) AS p, list_stddev_pop(list_transform(w, lambda x: least(1, x * m))) AS sd
  FROM (SELECT request_id, r, c, w, {MULT} AS m FROM rw JOIN grid USING (c_i, c_j) JOIN runs USING (request_id))),
fused AS (SELECT request_id, r, c, least(1, greatest(0, p + coalesce(boost, 0))) AS p, sd FROM heat LEFT JOIN bo USING (request_id, r, c))
SELECT request_id, round(max(p), 5) AS heat_max, round(avg(p), 5) AS heat_mean, round(avg(sd), 5) AS std_mean, count(*) AS cells FROM fused GROUP BY request_id""")
def predict_grid(read, missing="drop"):
    heat = predict.predict_grids(requests_with_weather(read), read("elevation_points"), latest(read),
                                 is_evidence(False), missing=missing, rounded=False)
    out = predict.grid_summary(heat)
    return out.select("request_id", "cells", *[F.round(c, 5).alias(c) for c in ("heat_max", "heat_mean", "std_mean")])


# A forest with every kind of subtree: noisy above cell columns, below them, alone and absent.
FOREST = Forest((
    Split("cape", 600.7, Split("slope", 6.0137, -0.3, 0.1), Split("land_use_heat", 0.453741, 0.05, 0.4)),
    Split("elevation", 321.237, Split("cin", -80.5, -0.25, Split("pbl_height", 1200.3, 0.05, 0.3)),
          Split("solar_ghi", 450.9, -0.1, 0.2)),
    Split("alt_agl", 913.377, Split("lon", 15.02537, 0.12, -0.08), Split("land_use_albedo", 0.191337, 0.02, -0.15)),
    Split("temp_2m", 17.53, -0.2, Split("lapse_rate", 5.03, 0.0, 0.25)),
    Split("hour_cos", -0.6, 0.15, -0.1),
    Split("slope", 4.0071, Split("soil_temp", 20.31, Split("hour_sin", 0.1, -0.05, 0.08), 0.1),
          Split("wind_u", 0.37, 0.06, -0.04)),
))


def forest_sql(forest, noisy: str = "x.") -> str:
    """The margin of a forest, noisy columns read from the draw ``x``."""
    def node(n) -> str:
        if not isinstance(n, Split):
            return f"{n!r}e0"
        name = f"{noisy}{n.feature}" if n.feature in NOISY else n.feature
        return f"CASE WHEN {name} <= {n.threshold!r}e0 THEN {node(n.low)} ELSE {node(n.high)} END"

    return " + ".join(f"({node(t)})" for t in forest.trees)


FALLBACK = dict(temp_2m='18e0', humidity='0.6e0', wind_u='-12e0 * sin(radians(270e0))', wind_v='-12e0 * cos(radians(270e0))', cape='600e0',
                cin='-30e0', solar_ghi='500e0', lapse_rate='4.9e0', pbl_height='1500e0', soil_temp='20e0')
# Weather of the requests' forecast hours and its draws.
FORECAST = f"""{WX}, fh AS (SELECT *, hour_no - first_no AS hour_index FROM (SELECT *, min(hour_no) OVER (PARTITION BY lat_b) AS first_no, max(hour_no) OVER (PARTITION BY lat_b) AS last_no FROM wx)),
fr AS (SELECT rq.*, round_even(lat * 2, 0) / 2 AS lat_b, hour_no + request_id % 48 AS want FROM rq),
fw AS (SELECT fr.* EXCLUDE (lat_b), {', '.join(f'coalesce(f.{c}, {v}) AS {c}' for c, v in FALLBACK.items())}
  FROM fr JOIN (SELECT DISTINCT lat_b, first_no, last_no FROM fh) f0 ON f0.lat_b = fr.lat_b
  LEFT JOIN fh f ON f.lat_b = fr.lat_b AND f.hour_index = least(greatest(want - f0.first_no, 0), f0.last_no - f0.first_no)),
fd AS (SELECT request_id, list({'{'}{', '.join(f"'{n}': {n} * (1 + {sd!r}e0 * {normal_sql(n)})" if kind == 'rel' else f"'{n}': {n} + {sd!r}e0 * {normal_sql(n)}" for n, kind, sd in K.NOISE)}{'}'}) AS w
  FROM fw, range(1, 51) t(d) GROUP BY request_id)"""


def forecast_requests(read):
    """Requests with the weather and the time of their forecast hour."""
    weather = read("weather_hours")
    first = F.min(F.unix_seconds("hour")).over(Window.partitionBy("lat_b", "lon_b"))
    hourly = weather.withColumn("hour_index", ((F.unix_seconds("hour") - first) / 3600).cast("int"))
    hours = (F.col("request_id") % 48).cast("int")
    asked = read("prediction_requests").select(
        "request_id", "lat", "lon", "alt_amsl", G.weather_cell("lat").alias("lat_b"), G.weather_cell("lon").alias("lon_b"),
        F.col("ts").alias("now"), hours.alias("forecast_h"), (F.col("ts") + F.make_dt_interval(hours=hours)).alias("ts"))
    return W.with_forecast(asked, hourly)


@query("predict_grid_model", ["prediction_requests", "elevation_points", "weather_hours", "landcover_pixels", "beacons"], f"""WITH {GRID}, {ZQ}, {window_sql('zq')}, {COVER_FINE}, {FORECAST}, {LIVE},
tm AS (SELECT c_i, c_j, avg(elevation) AS tm FROM fine GROUP BY c_i, c_j),
a AS (SELECT fw.request_id, fw.c_i, fw.c_j, coalesce(CAST(alt_amsl AS DOUBLE), tm + 1000) AS alt, sin(2 * pi() * (want % 24) / 24) AS hour_sin, cos(2 * pi() * (want % 24) / 24) AS hour_cos,
    request_id % 4 AS z FROM fw JOIN tm USING (c_i, c_j)),
ce AS (SELECT request_id, w, hour_sin, hour_cos, grid.r, grid.c, grid.lon, elevation, slope, aspect, heat AS land_use_heat, albedo AS land_use_albedo, greatest(0, alt - elevation) AS alt_agl
  FROM a JOIN fd USING (request_id) JOIN grid USING (c_i, c_j) JOIN cf ON cf.z = a.z AND cf.c_i = a.c_i AND cf.c_j = a.c_j AND cf.r = grid.r AND cf.c = grid.c),
pr AS (SELECT request_id, r, c, {MULT} AS m, list_transform(w, lambda x: 1 / (1 + exp(-2 * ({forest_sql(FOREST)})))) AS p FROM ce),
hm AS (SELECT request_id, r, c, least(1, greatest(0, list_avg(p) * m)) AS p, list_stddev_pop(p) * m AS sd FROM pr),
fu AS (SELECT request_id, r, c, round_even(least(1, greatest(0, p + coalesce(boost, 0))), 3) AS p, round_even(sd, 3) AS sd FROM hm LEFT JOIN bo USING (request_id, r, c))
SELECT request_id, round(max(p), 5) AS heat_max, round(avg(p), 5) AS heat_mean, round(avg(sd), 5) AS std_mean, round(max(p) FILTER (r = 100 AND c = 100), 5) AS heat_centre, count(*) AS cells FROM fu GROUP BY request_id""")
def _(read):
    asked = forecast_requests(read)
    centred = TR.with_centre(asked).withColumn("tile", F.col("request_id") % 4)
    heat = predict.predict_grids_with_model(
        asked, read("elevation_points"), FOREST, cover_windows(read, centred), latest(read), is_evidence(False))
    return predict.grid_summary(heat).select(
        "request_id", "cells", *[F.round(c, 5).alias(c) for c in ("heat_max", "heat_mean", "std_mean", "heat_centre")])


@query("served_scores", ["beacons"], f"""WITH f AS (SELECT seq, {', '.join(f'CAST(seq * {7 + 2 * i} % {401 + 10 * i} AS DOUBLE) / {10 ** (i % 3)} AS {c}' for i, c in enumerate(K.FEATURES))} FROM beacons)
SELECT seq, round(1 / (1 + exp(-2 * ({forest_sql(FOREST, '')}))) * {MULT}, 6) AS score FROM f""")
def _(read):
    rows = read("beacons").select("seq", *[
        ((F.col("seq") * (7 + 2 * i) % (401 + 10 * i)).cast("double") / float(10 ** (i % 3))).alias(c)
        for i, c in enumerate(K.FEATURES)])
    return scored_by_forest(rows, FOREST).select("seq", F.round(F.col("score") * terrain_multiplier(), 6).alias("score"))


@query("response_header", ["prediction_requests", "elevation_points", "weather_hours"], f"""WITH {GRID}, {RW},
tm AS (SELECT c_i, c_j, avg(elevation) AS tm FROM fine GROUP BY c_i, c_j),
a AS (SELECT rw.*, tm, coalesce(CAST(alt_amsl AS DOUBLE), tm + 1000) AS alt FROM rw JOIN tm USING (c_i, c_j))
SELECT request_id, 201 AS rows, 201 AS cols, round(c_i * 0.01e0, 6) AS grid_lat, round(c_j * 0.01e0, 6) AS grid_lon, CAST(round_even(alt, 0) AS INT) AS alt_amsl,
  CAST(round_even(alt - tm, 0) AS INT) AS alt_agl, CASE WHEN alt_amsl IS NULL THEN 'default' ELSE 'observer' END AS alt_source, thermal_base,
  CAST(round_even(humidity * 100, 0) AS INT) AS humidity, CAST(wind_dir AS INT) AS wind_dir, CAST(cape AS INT) AS cape, CAST(cin AS INT) AS cin,
  CAST(solar_ghi AS INT) AS solar_ghi, CAST(pbl_height AS INT) AS pbl_height, temp_2m, wind_speed, round(lapse_rate, 1) AS lapse_rate, soil_temp FROM a""")
def _(read):
    return predict.response_header(requests_with_weather(read), read("elevation_points"))


FEATURE_MEANS = ("lat", "lon", "elevation", "slope", "alt_agl", "land_use_heat", "land_use_albedo")
FEATURE_PEAKS = ("temp_2m", "humidity", "wind_u", "wind_v", "cape", "cin", "solar_ghi", "lapse_rate", "hour_sin", "hour_cos",
                 "doy_sin", "doy_cos", "pbl_height", "soil_temp")


@query("grid_features", ["prediction_requests", "elevation_points", "weather_hours", "landcover_pixels"], f"""WITH {GRID}, {ZQ}, {window_sql('zq')}, {COVER_FINE}, {RW},
tm AS (SELECT c_i, c_j, avg(elevation) AS tm FROM fine GROUP BY c_i, c_j),
a AS (SELECT rw.*, coalesce(CAST(alt_amsl AS DOUBLE), tm + 1000) AS alt, TIMESTAMP '2024-01-01' + to_hours(CAST(hour_no AS INT)) AS ts, request_id % 4 AS z FROM rw JOIN tm USING (c_i, c_j)),
f AS (SELECT a.* EXCLUDE (c_i, c_j, z), grid.*, heat AS land_use_heat, albedo AS land_use_albedo, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
    sin(2 * pi() * dayofyear(ts) / 365) AS doy_sin, cos(2 * pi() * dayofyear(ts) / 365) AS doy_cos, greatest(0, alt - elevation) AS alt_agl
  FROM a JOIN grid USING (c_i, c_j) JOIN cf USING (z, c_i, c_j, r, c))
SELECT request_id, r AS row, count(*) AS n, round(avg(sin(radians(aspect)) * slope), 5) AS facing,
  {', '.join(f'round(avg({c}) + 1e-9, 5) AS {c}' for c in FEATURE_MEANS)}, {', '.join(f'round(max({c}), 6) AS {c}' for c in FEATURE_PEAKS)} FROM f GROUP BY request_id, r""")
def _(read):
    asked = requests_with_weather(read).withColumn("tile", F.col("request_id") % 4)
    rows = predict.grid_features(asked, read("elevation_points"), cover_windows(read, TR.with_centre(asked)))
    return rows.groupBy("request_id", "row").agg(
        F.count("*").alias("n"), F.round(F.avg(F.sin(F.radians("aspect")) * F.col("slope")), 5).alias("facing"),
        *[F.round(F.avg(c) + 1e-9, 5).alias(c) for c in FEATURE_MEANS], *[F.round(F.max(c), 6).alias(c) for c in FEATURE_PEAKS])


@query("fuse_climbs", ["prediction_requests", "beacons"], f"""WITH {REQ}, {LIVE}
SELECT request_id, r AS row, round(sum(least(1, 0.2e0 + boost)), 5) AS heat, count(*) AS touched FROM bo GROUP BY request_id, r""")
def _(read):
    asked = TR.with_centre(read("prediction_requests"))
    heat = fusion.heat_rows(asked).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(200)))).withColumn("p_mean", F.lit(0.2))
    cells = fusion.fuse_climbs(heat, asked, latest(read), is_evidence(False))
    boosts = cells.filter("p_mean > 0.2")
    return boosts.groupBy("request_id", "row").agg(
        F.round(F.sum("p_mean"), 5).alias("heat"), F.count("*").alias("touched"))


@query("monte_carlo", ["prediction_requests", "weather_hours"], f"""WITH {REQ}, {RW}, {RUNS},
f AS (SELECT request_id, request_id % 40 AS slope, request_id * 7 % 360 AS aspect, 300 AS elevation FROM rw),
m AS (SELECT request_id, w, {MULT} AS m FROM f JOIN runs USING (request_id))
SELECT request_id, round(list_avg(list_transform(w, lambda x: least(1, x * m))), 6) AS p_mean, round(list_stddev_pop(list_transform(w, lambda x: least(1, x * m))), 6) AS p_std FROM m""")
def _(read):
    rid = F.col("request_id")
    rows = requests_with_weather(read).select(
        "request_id", "cape", "cin", "solar_ghi", (rid % 40).alias("slope"), (rid * 7 % 360).alias("aspect"),
        F.lit(300).alias("elevation"), montecarlo.noise_draws(rid).alias("draws"))
    scored = montecarlo.monte_carlo(rows, lambda c: physics_probability(c["cape"], c["cin"], c["solar_ghi"]))
    return scored.select("request_id", *r6("p_mean", "p_std"))


# --- Metrics and splits ------------------------------------------------------

SG = "sg AS (SELECT *, ((doy % 365) * 361 + CAST(round_even((lat + 90) * 2, 0) AS BIGINT)) * 721 + CAST(round_even((lon + 180) * 2, 0) AS BIGINT) AS gid FROM scored)"


def pairs_sql(score: str, name: str) -> str:
    return f"""{name} AS (SELECT p.gid, sum(CASE WHEN p.{score} > n.{score} THEN 1 WHEN p.{score} = n.{score} THEN 0.5e0 ELSE 0 END) AS concordant, count(*) AS pairs
  FROM sg p JOIN sg n ON p.gid = n.gid AND p.label = 1 AND n.label = 0 GROUP BY p.gid)"""


def scored(read):
    return splits.with_group(read("scored"), doy="doy")


@query("group_pairs", ["scored"], f"WITH {SG}, {pairs_sql('score_a', 'pa')} SELECT gid, CAST(concordant AS DOUBLE) AS concordant, pairs FROM pa")
def _(read):
    return metrics.group_pairs(scored(read), "score_a")


@query("grouped_auc", ["scored"], f"""WITH {SG}, {pairs_sql('score_b', 'pb')}
SELECT round(sum(concordant) / sum(pairs), 6) AS micro, round(avg(concordant / pairs), 6) AS macro, count(*) AS groups, CAST(sum(pairs) AS BIGINT) AS pairs FROM pb""")
def _(read):
    return metrics.grouped_auc(metrics.group_pairs(scored(read), "score_b")).select(
        *r6("micro", "macro"), "groups", "pairs")


DRAWS = """gi AS (SELECT *, row_number() OVER (ORDER BY gid) AS i, count(*) OVER () AS n FROM {g}),
sl AS (SELECT d, CAST(floor((CAST(('0x' || substr(sha256(concat_ws('|', 0, d, i)), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0 * n) AS BIGINT) + 1 AS pick FROM gi, range(0, {k}) t(d))"""


@query("bootstrap_ci", ["scored"], f"""WITH {SG}, {pairs_sql('score_a', 'pa')}, {DRAWS.format(g='pa', k=2000)},
dv AS (SELECT d, sum(concordant) / sum(pairs) AS v FROM sl JOIN gi ON gi.i = sl.pick GROUP BY d)
SELECT (SELECT round(sum(concordant) / sum(pairs), 6) FROM pa) AS point, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi,
  (SELECT count(*) FROM pa) AS groups FROM dv""")
def _(read):
    return metrics.bootstrap_ci(metrics.group_pairs(scored(read), "score_a")).select(*r6("point", "lo", "hi"), "groups")


@query("paired_delta_ci", ["scored"], f"""WITH {SG}, {pairs_sql('score_a', 'pa')}, {pairs_sql('score_b', 'pb')},
pp AS (SELECT pa.gid, pa.concordant AS ca, pa.pairs AS ta, pb.concordant AS cb, pb.pairs AS tb FROM pa JOIN pb ON pa.gid = pb.gid), {DRAWS.format(g='pp', k=2000)},
dv AS (SELECT d, sum(cb) / sum(tb) - sum(ca) / sum(ta) AS v FROM sl JOIN gi ON gi.i = sl.pick GROUP BY d)
SELECT (SELECT round(sum(cb) / sum(tb) - sum(ca) / sum(ta), 6) FROM pp) AS point, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi,
  (SELECT count(*) FROM pp) AS groups FROM dv""")
def _(read):
    rows = scored(read)
    return metrics.paired_delta_ci(metrics.group_pairs(rows, "score_a"), metrics.group_pairs(rows, "score_b")).select(
        *r6("point", "lo", "hi"), "groups")


PAIRED = f"""{SG}, {pairs_sql('score_a', 'pa')}, {pairs_sql('score_b', 'pb')},
pp AS (SELECT pa.gid, pa.concordant AS ca, pa.pairs AS ta, pb.concordant AS cb, pb.pairs AS tb FROM pa JOIN pb ON pa.gid = pb.gid)"""


@query("rankers_report", ["scored"], f"""WITH {PAIRED}, {DRAWS.format(g='pp', k=2000)},
dv AS (SELECT d, sum(ca) / sum(ta) AS va, sum(cb) / sum(tb) AS vb FROM sl JOIN gi ON gi.i = sl.pick GROUP BY d)
SELECT 'a' AS ranker, (SELECT round(sum(ca) / sum(ta), 6) FROM pp) AS micro, (SELECT round(avg(ca / ta), 6) FROM pp) AS macro, round(quantile_cont(va, 0.025), 6) AS lo,
  round(quantile_cont(va, 0.975), 6) AS hi, (SELECT count(*) FROM pp) AS groups, (SELECT CAST(sum(ta) AS BIGINT) FROM pp) AS pairs FROM dv
UNION ALL SELECT 'b', (SELECT round(sum(cb) / sum(tb), 6) FROM pp), (SELECT round(avg(cb / tb), 6) FROM pp), round(quantile_cont(vb, 0.025), 6),
  round(quantile_cont(vb, 0.975), 6), (SELECT count(*) FROM pp), (SELECT CAST(sum(tb) AS BIGINT) FROM pp) FROM dv""")
def _(read):
    rows = scored(read)
    report = evaluation.rankers_report([("a", rows, "score_a"), ("b", rows, "score_b")])
    return report.select("ranker", *r6("micro", "macro", "lo", "hi"), "groups", "pairs")


# Challenger, incumbent and rejections so far of each situation the gate is asked about.
SITUATIONS = (("first", "b", None, 0), ("better", "b", "a", 0), ("worse", "a", "b", 0),
              ("worse once more", "a", "b", K.MAX_CONSECUTIVE_SKIPS - 1))


@query("gate_decisions", ["scored"], f"""WITH {PAIRED}, {DRAWS.format(g='pp', k=1000)},
dv AS (SELECT d, sum(cb) / sum(tb) - sum(ca) / sum(ta) AS v FROM sl JOIN gi ON gi.i = sl.pick GROUP BY d),
ci AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM dv),
sc AS (SELECT count(*) AS n, sum(ca) / sum(ta) AS a, sum(cb) / sum(tb) AS b FROM pp),
st AS (SELECT * FROM (VALUES ('first', 'b', false, 0), ('better', 'b', true, 0), ('worse', 'a', true, 0), ('worse once more', 'a', true, 11)) t(situation, challenger, incumbent, skips)),
q AS (SELECT st.*, n, CASE challenger WHEN 'a' THEN a ELSE b END AS score, CASE challenger WHEN 'a' THEN -hi ELSE lo END AS lo, CASE challenger WHEN 'a' THEN -lo ELSE hi END AS hi FROM st, sc, ci),
r AS (SELECT *, CASE WHEN n < 30 THEN CASE WHEN incumbent THEN 'benchmark too small' ELSE 'unverified first model' END
  WHEN incumbent AND hi < 0 THEN CASE WHEN skips + 1 < 12 THEN 'reliably worse' ELSE 're-baselined' END ELSE 'accepted' END AS reason FROM q)
SELECT situation, reason, reason IN ('accepted', 're-baselined', 'unverified first model') AS accepted, n AS groups, round(CASE WHEN n >= 30 THEN score END, 6) AS score,
  CASE WHEN n >= 30 AND incumbent THEN round(lo, 6) END AS lo, CASE WHEN n >= 30 AND incumbent THEN round(hi, 6) END AS hi,
  CAST(CASE WHEN reason = 'reliably worse' THEN skips + 1 WHEN n < 30 THEN skips ELSE 0 END AS BIGINT) AS skipped FROM r""")
def _(read):
    rows = scored(read)
    pairs = {c: metrics.group_pairs(rows, f"score_{c}") for c in "ab"}
    results = {c: metrics.grouped_auc(p).first() for c, p in pairs.items()}
    out = []
    for situation, challenger, incumbent, skips in SITUATIONS:
        found, delta = results[challenger], None
        if incumbent and found["groups"] >= K.MIN_BENCH_GROUPS:
            row = metrics.paired_delta_ci(pairs[incumbent], pairs[challenger], draws=K.GATE_DRAWS).first()
            delta = (row["point"], row["lo"], row["hi"])
        d = training.decide(found["groups"], found["micro"], incumbent is not None,
                            results[incumbent]["micro"] if incumbent else None, delta, skips)
        lo, hi = (round(d.delta[1], 6), round(d.delta[2], 6)) if d.delta else (None, None)
        out.append((situation, d.reason, d.accepted, d.groups, None if d.score is None else round(d.score, 6), lo, hi, d.skipped))
    return rows.sparkSession.createDataFrame(
        out, "situation string, reason string, accepted boolean, groups long, score double, lo double, hi double, skipped long")


@query("global_auc", ["scored"], """
WITH k AS (SELECT label, rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2 AS r FROM scored),
t AS (SELECT sum(r) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM k)
SELECT round((rs - p * (p + 1) / 2) / (p * n), 6) AS auc, p * n AS pairs FROM t""")
def _(read):
    return metrics.average_rank_auc(read("scored"), "score_b").select(*r6("auc"), "pairs")


@query("classification_report", ["scored"], """
WITH c AS (SELECT label, CASE WHEN score_b > 0.5 THEN 1 ELSE 0 END AS called FROM scored),
k AS (SELECT l, count(*) FILTER (label = l AND called = l) AS tp, count(*) FILTER (called = l) AS pc, count(*) FILTER (label = l) AS sup FROM c, range(0, 2) t(l) GROUP BY l)
SELECT CAST(l AS INT) AS label, round(tp / pc, 6) AS precision, round(tp / sup, 6) AS recall, round(2 * (tp / pc) * (tp / sup) / (tp / pc + tp / sup), 6) AS f1, sup AS support FROM k""")
def _(read):
    return metrics.classification_report(read("scored"), "score_b").select(
        "label", *r6("precision", "recall", "f1"), "support")


def side_sql(salt: str) -> str:
    return f"CAST(('0x' || substr(sha256('{salt}|' || gid), 1, 15)) AS BIGINT)"


@query("frozen_split", ["scored"], f"""WITH {SG}
SELECT seq, gid, CASE WHEN {side_sql(K.BENCH_SALT)} % 5 = 0 THEN 'benchmark' WHEN {side_sql(K.EARLY_STOP_SALT)} % 5 = 0 THEN 'earlystop' ELSE 'train' END AS split FROM sg""")
def _(read):
    return splits.with_split(scored(read)).select("seq", "gid", "split")


@query("group_folds", ["scored"], f"""WITH {SG}, u AS (SELECT gid, row_number() OVER (ORDER BY {side_sql(K.FOLD_SALT + '/0')}, gid) AS n FROM (SELECT DISTINCT gid FROM sg))
SELECT seq, CAST((n - 1) % 5 AS INT) AS fold FROM sg JOIN u USING (gid)""")
def _(read):
    return splits.with_fold(scored(read)).select("seq", "fold")


STRATA = f"""st AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY CAST(('0x' || substr(sha256('{K.FOLD_SALT}/stratified/0|' || seq), 1, 15)) AS BIGINT), seq) - 1) % 5 AS INT) AS fold FROM scored)"""


@query("stratified_folds", ["scored"], f"WITH {STRATA} SELECT seq, label, fold FROM st")
def _(read):
    return splits.stratified_folds(read("scored")).select("seq", "label", "fold")


@query("fold_report", ["scored"], f"""WITH {STRATA},
k AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY score_b) + (count(*) OVER (PARTITION BY fold, score_b) - 1) / 2 AS r FROM st),
t AS (SELECT fold, sum(r) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM k GROUP BY fold)
SELECT round(avg((rs - p * (p + 1) / 2) / (p * n)), 6) AS mean, round(stddev_pop((rs - p * (p + 1) / 2) / (p * n)), 6) AS sd, count(*) AS folds FROM t""")
def _(read):
    return metrics.fold_report(splits.stratified_folds(read("scored")), "score_b").select(*r6("mean", "sd"), "folds")


# --- Samples and training ----------------------------------------------------

EV = "ev AS (SELECT * FROM beacons WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, true))"


@query("systematic_sample", ["beacons"], f"""WITH {EV}
SELECT seq, id FROM ev WHERE seq % greatest(1, ((SELECT count(*) FROM ev) + 4999) // 5000) = 0 ORDER BY seq LIMIT 5000""")
def _(read):
    return sampling.systematic_sample(read("beacons").filter(is_evidence(True)), 5000).select("seq", "id")


@query("newest_samples", ["beacons"], f"""WITH {EV} SELECT count(*) AS n, min(seq) AS oldest FROM (SELECT seq FROM ev ORDER BY seq DESC LIMIT 200000)""")
def _(read):
    from updraft.sources.store import newest_samples

    return newest_samples(read("beacons").filter(is_evidence(True)).select("seq")).agg(
        F.count("*").alias("n"), F.min("seq").alias("oldest"))


def own_cell_sql(src: str, half: int = 1) -> str:
    """Terrain of each row's own cell: ``src`` has lat, lon, c_i, c_j; 0 without a whole window."""
    return f"""whole AS (SELECT c_i, c_j, true AS known FROM (SELECT DISTINCT c_i, c_j FROM {src}) k JOIN elevation_points e
  ON e.lat_i BETWEEN c_i - {half} AND c_i + {half} AND e.lon_j BETWEEN c_j - {half} AND c_j + {half} GROUP BY c_i, c_j HAVING count(*) = {(2 * half + 1) ** 2}),
fc AS (SELECT *, CAST(round_even((lat - (c_i * 0.01e0 - 0.05e0)) / 0.1e0 * 200, 0) AS BIGINT) AS r,
  CAST(round_even((lon - (c_j * 0.01e0 - 0.05e0)) / 0.1e0 * 200, 0) AS BIGINT) AS c FROM {src}),
fq AS (SELECT DISTINCT c_i, c_j, r, c FROM fc),
nb AS (SELECT *, y // 20 AS li, x // 20 AS lj, y % 20 / 20e0 AS wy, x % 20 / 20e0 AS wx FROM (
  SELECT *, c_i * 20 - 100 + least(200, greatest(0, r + a)) AS y, c_j * 20 - 100 + least(200, greatest(0, c + b)) AS x
  FROM fq, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b))),
ne AS (SELECT nb.*, CASE WHEN known THEN (coalesce(e00.elevation, 0) * (1 - wx) + coalesce(e01.elevation, 0) * wx) * (1 - wy) + (coalesce(e10.elevation, 0) * (1 - wx) + coalesce(e11.elevation, 0) * wx) * wy ELSE 0 END AS e
  FROM nb LEFT JOIN whole USING (c_i, c_j)
  LEFT JOIN elevation_points e00 ON e00.lat_i = li AND e00.lon_j = lj LEFT JOIN elevation_points e01 ON e01.lat_i = li AND e01.lon_j = lj + 1
  LEFT JOIN elevation_points e10 ON e10.lat_i = li + 1 AND e10.lon_j = lj LEFT JOIN elevation_points e11 ON e11.lat_i = li + 1 AND e11.lon_j = lj + 1),
te AS (SELECT c_i, c_j, r, c, max(e) FILTER (a = 0 AND b = 0) AS elevation,
  (max(e) FILTER (a = 1) - max(e) FILTER (a = -1)) / (CASE WHEN r IN (0, 200) THEN 1 ELSE 2 END * 0.0005e0 * 111320) AS dy,
  (max(e) FILTER (b = 1) - max(e) FILTER (b = -1)) / (CASE WHEN c IN (0, 200) THEN 1 ELSE 2 END * 0.0005e0 * 111320 * cos(radians(c_i * 0.01e0))) AS dx FROM ne GROUP BY c_i, c_j, r, c),
td AS (SELECT fc.*, elevation, (c_i * 0.01e0 - 0.05e0) + r * 0.0005e0 AS cell_lat, {SLOPE.format(dx='dx', dy='dy')} FROM fc JOIN te USING (c_i, c_j, r, c))"""


SNAP = "CAST(round_even(lat / 0.01e0, 0) AS BIGINT) AS c_i, CAST(round_even(lon / 0.01e0, 0) AS BIGINT) AS c_j"
HIST = f"""{WX}, pt AS (SELECT *, {SNAP} FROM (SELECT seq, ts_hist AS ts, lat_hist AS lat, lon, alt, vario, circling FROM beacons WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, true))),
{own_cell_sql('pt')},
tj AS (SELECT td.*, wx.cape, wx.humidity, wx.solar_ghi, wx.thermal_base, wx.hour_no IS NOT NULL AS known FROM td LEFT JOIN wx
  ON wx.lat_b = round_even(td.lat * 2, 0) / 2 AND wx.lon_b = round_even(td.lon * 2, 0) / 2 AND wx.hour_no = CAST((epoch(date_trunc('hour', ts)) - 1704067200) / 3600 AS BIGINT)),
judged AS (SELECT *, CASE WHEN NOT known THEN 'no_weather' WHEN solar_ghi < 50 THEN 'dark' WHEN thermal_base > 0 AND alt - elevation > thermal_base + 300 THEN 'above_base' ELSE 'added' END AS reason FROM tj)"""


def history(read, limit=None):
    rows = read("beacons").withColumn("lat", F.col("lat_hist"))
    return samples.judged_history(rows, read("weather_hours"), read("elevation_points"), limit, ts="ts_hist")


@query("history_samples", ["beacons", "weather_hours", "elevation_points"], f"""WITH {HIST}
SELECT seq, CAST(circling AND vario > 1.5 AS INT) AS label, round(cell_lat, 6) AS lat, round(elevation, 5) AS elevation, round(slope, 5) AS slope,
  round(cape, 6) AS cape, round(humidity, 6) AS humidity, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60e0) / 24), 6) AS hour_sin,
  round(greatest(0, alt - elevation), 5) AS alt_agl FROM judged WHERE reason = 'added'""")
def _(read):
    rows = samples.samples_of(history(read))
    return rows.select("seq", "label", *r6("lat", "cape", "humidity", "hour_sin"),
                       *[F.round(c, 5).alias(c) for c in ("elevation", "slope", "alt_agl")])


@query("sample_counters", ["beacons", "weather_hours", "elevation_points"], f"WITH {HIST} SELECT reason, count(*) AS rows FROM judged GROUP BY reason")
def _(read):
    return samples.run_counters(history(read))


def cycles(read):
    live = L.live_snapshots(read("beacons").select("id", "seq", "ts", "lat", "lon", "alt", "vario", "circling", "ac_type", "under_tow"))
    shifted = F.lit(YEAR_START) + F.pmod(F.col("cycle") * 3600, F.lit(700 * 3600))
    return live.withColumn("now", F.timestamp_seconds(shifted))


CYC = f"""{WX}, {FEED_RUNS}, live AS (SELECT CAST(ceil((1718956800 + t_dense_s) / 300.0e0) AS BIGINT) AS cycle, id, arg_max(run, seq) AS ord, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon,
    arg_max(alt, seq) AS alt, arg_max(vario, seq) AS vario, arg_max(circling, seq) AS circling, arg_max(ac_type, seq) AS ac_type, arg_max_null(under_tow, seq) AS under_tow FROM feed_runs GROUP BY 1, 2),
ev AS (SELECT *, cycle % 700 AS hour_no FROM live WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, false)),
cand AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY ord) AS n, round(round_even(lat / 0.01e0, 0) * 0.01e0, 6) AS g_lat, round(round_even(lon / 0.01e0, 0) * 0.01e0, 6) AS g_lon
  FROM ev QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY ord) <= 20),
cd AS (SELECT cand.*, coalesce(wx.solar_ghi, 500) < 50 AS dark FROM cand LEFT JOIN wx ON wx.lat_b = round_even(lat * 2, 0) / 2 AND wx.lon_b = round_even(lon * 2, 0) / 2 AND wx.hour_no = cand.hour_no),
walk AS (SELECT cycle, 0 AS n, CAST([] AS STRUCT(id VARCHAR, la DOUBLE, lo DOUBLE)[]) AS op FROM (SELECT DISTINCT cycle FROM cd)
  UNION ALL
  SELECT w.cycle, w.n + 1, CASE WHEN c.dark OR len(list_filter(w.op, lambda o: c.lat BETWEEN o.la - 0.05e0 AND o.la + 0.05e0 AND c.lon BETWEEN o.lo - 0.05e0 AND o.lo + 0.05e0)) > 0
    THEN w.op ELSE list_append(w.op, {'{'}'id': c.id, 'la': c.g_lat, 'lo': c.g_lon{'}'}) END
  FROM walk w JOIN cd c ON c.cycle = w.cycle AND c.n = w.n + 1),
grids AS (SELECT cycle, op FROM walk QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY n DESC) = 1),
occ AS (SELECT ev.*, list_filter(op, lambda o: ev.lat BETWEEN o.la - 0.05e0 AND o.la + 0.05e0 AND ev.lon BETWEEN o.lo - 0.05e0 AND o.lo + 0.05e0)[1] AS g FROM ev JOIN grids USING (cycle))"""


@query("grid_occupants", ["beacons", "weather_hours"], f"""WITH RECURSIVE {CYC}
SELECT cycle, id, g.id AS g_id, round(g.la, 6) AS g_lat FROM occ WHERE g IS NOT NULL""")
def _(read):
    evidence = cycles(read).filter(is_evidence(False))
    first = first_candidates(evidence, ["cycle"]).select("cycle", "first_seen", "id", "lat", "lon", "now")
    lit = W.with_weather(W.with_weather_key(first, "now"), read("weather_hours")).withColumn("dark", is_dark())
    return grid_occupants(evidence, lit, ["cycle"]).select("cycle", "id", "g_id", *r6("g_lat"))


@query("live_samples", ["beacons", "weather_hours", "elevation_points"], f"""WITH RECURSIVE {CYC},
pt AS (SELECT o.*, round_even(o.g.la / 0.01e0, 0)::BIGINT AS c_i, round_even(o.g.lo / 0.01e0, 0)::BIGINT AS c_j, k.lat AS k_lat, k.lon AS k_lon
  FROM occ o JOIN cd k ON k.cycle = o.cycle AND k.id = o.g.id WHERE o.g IS NOT NULL),
{own_cell_sql('pt', 5)},
j AS (SELECT td.*, coalesce(wx.cape, 600) AS cape, coalesce(wx.thermal_base, 1200) AS base FROM td LEFT JOIN wx
  ON wx.lat_b = round_even(k_lat * 2, 0) / 2 AND wx.lon_b = round_even(k_lon * 2, 0) / 2 AND wx.hour_no = td.hour_no)
SELECT cycle, id, g.id AS g_id, CAST(circling AND vario > 1.5 AS INT) AS label, CASE WHEN base > 0 AND alt - elevation > base + 300 THEN 'above_base' ELSE 'added' END AS reason,
  round(cell_lat, 6) AS lat, round(elevation, 5) AS elevation, round(slope, 5) AS slope, round(cape, 6) AS cape, round(greatest(0, alt - elevation), 5) AS alt_agl FROM j""")
def _(read):
    judged = samples.judged_live(cycles(read), read("weather_hours"), read("elevation_points"), ["cycle"])
    return judged.select("cycle", "id", "g_id", "label", "reason", *r6("lat", "cape"),
                         *[F.round(c, 5).alias(c) for c in ("elevation", "slope", "alt_agl")])


@query("fix_samples", ["igc_lines", "weather_hours", "elevation_points"], f"""WITH RECURSIVE {KIN_SQL}, {THIN_SQL}, {WX},
pt AS (SELECT k.line AS seq, k.lat, k.lon, k.vario, abs(turn_rate) > 8 AS circling, CAST(floor(k.t / 3600) AS BIGINT) % 700 AS hour_no,
  CAST(round_even(k.lat / 0.01e0, 0) AS BIGINT) AS c_i, CAST(round_even(k.lon / 0.01e0, 0) AS BIGINT) AS c_j FROM kin k JOIN chain c ON c.flight = k.flight AND c.line = k.line),
{own_cell_sql('pt')}
SELECT seq, CAST(circling AND vario > 1.5 AS INT) AS label, round(cell_lat, 6) AS lat, round(elevation, 5) AS elevation, round(wx.cape, 6) AS cape, 0e0 AS alt_agl
FROM td JOIN wx ON wx.lat_b = round_even(td.lat * 2, 0) / 2 AND wx.lon_b = round_even(td.lon * 2, 0) / 2 AND wx.hour_no = td.hour_no""")
def _(read):
    fixes = thinned(read).withColumn("seq", F.col("line"))
    moved = F.timestamp_seconds(F.lit(YEAR_START) + F.pmod(F.unix_seconds("time"), F.lit(700 * 3600)))
    rows = samples.sample_fixes(fixes.withColumn("time", moved), read("weather_hours"), read("elevation_points"))
    return rows.select("seq", "label", *r6("lat", "cape", "alt_agl"), F.round("elevation", 5).alias("elevation"))


def buffer(read):
    from updraft.session import durable

    return durable(samples.samples_of(history(read)))


# The stored samples with their group, split and fold.
TRAINED = f"""{HIST},
sm AS (SELECT seq, CAST(circling AND vario > 1.5 AS INT) AS label, ((dayofyear(ts) % 365) * 361 + CAST(round_even((cell_lat + 90) * 2, 0) AS BIGINT)) * 721
    + CAST(round_even((c_j * 0.01e0 - 0.05e0 + c * 0.0005e0 + 180) * 2, 0) AS BIGINT) AS gid FROM judged WHERE reason = 'added'),
sp AS (SELECT *, CASE WHEN {side_sql(K.BENCH_SALT)} % 5 = 0 THEN 'benchmark' WHEN {side_sql(K.EARLY_STOP_SALT)} % 5 = 0 THEN 'earlystop' ELSE 'train' END AS split FROM sm),
bg AS (SELECT gid, sum(label) * sum(1 - label) AS pairs FROM sp WHERE split = 'benchmark' GROUP BY gid HAVING sum(label) * sum(1 - label) > 0),
sz AS (SELECT (SELECT count(*) FROM sm) AS n, (SELECT coalesce(sum(label), 0) FROM sm) AS p, (SELECT count(*) FROM bg) AS g, (SELECT coalesce(sum(pairs), 0) FROM bg) AS pairs)"""


@query("train_and_gate", ["beacons", "weather_hours", "elevation_points"], f"""WITH {TRAINED},
r AS (SELECT *, CASE WHEN n < 100 THEN 'too few samples' WHEN p < 20 THEN 'too few positives' WHEN g < 30 THEN 'unverified first model' ELSE 'accepted' END AS reason FROM sz)
SELECT n AS samples, CAST(p AS BIGINT) AS positives, reason, n >= 100 AND p >= 20 AS accepted, CASE WHEN n >= 100 AND p >= 20 THEN g ELSE 0 END AS groups,
  n >= 100 AND p >= 20 AND g >= 30 AS scored, 0 AS skipped FROM r""")
def _(read):
    """The first model of a buffer: fitted with the default settings on the frozen split, and gated."""
    rows = buffer(read)
    stored, decision = training.fit_and_gate(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    scored_well = decision.score is not None and 0 < decision.score < 1
    return rows.sparkSession.createDataFrame(
        [(size["n"], size["p"], decision.reason, decision.accepted, decision.groups, scored_well, decision.skipped)],
        "samples long, positives long, reason string, accepted boolean, groups long, scored boolean, skipped int")


def layers_of(read):
    return evaluation.Layers(index=index_of(read), landcover=cover_areas(read))


RANKERS = ("constant", "terrain", "physics", "incidence", *[f"{v} ({kind})" for v in evaluation.VARIANTS for kind in ("raw", "served")])


@query("compare_variants", ["beacons", "weather_hours", "elevation_points", "landcover_pixels"], f"""WITH {TRAINED}
SELECT ranker, g AS groups, CAST(pairs AS BIGINT) AS pairs, CASE WHEN ranker = 'constant' THEN 0.5e0 END AS fixed FROM sz, (VALUES {', '.join(f"('{r}')" for r in RANKERS)}) t(ranker) WHERE g > 0""")
def _(read):
    """All five variants with the default settings on the frozen benchmark."""
    report, _verdicts = evaluation.compare(buffer(read), layers=layers_of(read), mode="holdout")
    return report.select("ranker", "groups", "pairs", F.when(F.col("ranker") == "constant", F.round("micro", 6)).alias("fixed"))


@query("out_of_fold", ["beacons", "weather_hours", "elevation_points"], f"""WITH {TRAINED},
u AS (SELECT gid, row_number() OVER (ORDER BY {side_sql(K.FOLD_SALT + '/0')}, gid) AS n FROM (SELECT DISTINCT gid FROM sm))
SELECT CAST((u.n - 1) % 5 AS INT) AS fold, count(*) AS rows, count(DISTINCT gid) AS groups, CAST(sum(label) AS BIGINT) AS positives, count(*) AS scored FROM sm JOIN u USING (gid) GROUP BY 1""")
def _(read):
    """Every sample scored once by a model of the default settings that never saw its group."""
    rows = evaluation.out_of_fold(buffer(read), evaluation.VARIANTS["base"])
    return rows.groupBy("fold").agg(
        F.count("*").alias("rows"), F.count_distinct("gid").alias("groups"), F.sum("label").alias("positives"),
        F.count_if(F.col("score").between(0, 1)).alias("scored"))
