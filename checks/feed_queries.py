"""Feed parsing, live tables, positions and tracks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query, r6, seconds
from updraft import constants as K
from updraft.functions.geo import extrapolated, point_key
from updraft.functions.rules import airborne, is_evidence, is_soaring, lift_label, type_name
from updraft.operators import live as L
from updraft.operators import tracks
from updraft.operators.blocks import number_block
from updraft.operators.clusters import cluster_climbs
from updraft.operators.splits import label_balance
from updraft.operators.terrain import plan_lookups, with_agl, with_ground
from updraft.operators.tow import flag_under_tow
from updraft.session import ensure_checkpoint_dir
from updraft.sources.beacons import parse_beacons, retain
from updraft.sources.flights import fixes_from_snapshot, fixes_from_thermals, parse_igc_lines
from updraft.sources.layers import geojson_features, merge_elevations, weather_rows
from updraft.streaming import feed as S
from updraft.streaming import livetable as LT

NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.AIRCRAFT_TYPE_NAMES.items())


# An aircraft's place in the feed is where its current run without a silence of 300 s began.
FEED_RUNS = """feed_runs AS (SELECT *, max(CASE WHEN prev IS NULL OR t_dense_s - prev >= 300 THEN seq END) OVER (PARTITION BY id ORDER BY seq) AS run
  FROM (SELECT *, lag(t_dense_s) OVER (PARTITION BY id ORDER BY seq) AS prev FROM beacons))"""


@query("parse_beacons", ["aprs_lines"], f"""
WITH t AS (
  SELECT seq, trim(split_part(value, '>', 1)) AS id, substr(value, strpos(value, ':') + 1) AS p FROM aprs_lines
  WHERE value NOT LIKE '#%' AND value LIKE '%>%' AND value LIKE '%:%'),
u AS (
  SELECT *, regexp_extract(p, '(\\d{{2}})(\\d{{2}}\\.\\d+)([NS])[/\\\\](\\d{{3}})(\\d{{2}}\\.\\d+)([EW])',
      ['a','b','c','d','e','f']) AS m,
    regexp_extract(p, '\\bid([0-9A-Fa-f]{{2}})[0-9A-Fa-f]{{6}}', 1) AS b,
    regexp_extract(p, '/A=(\\d+)', 1) AS ft, regexp_extract(p, '([+-]\\d+)fpm', 1) AS fpm,
    regexp_extract(p, '([+-]\\d+(\\.\\d+)?)rot', 1) AS rot,
    regexp_extract(p, '[EW][^\\s/\\\\](\\d{{3}})/(\\d{{3}})', ['course','kn']) AS cs
  FROM t WHERE p LIKE '/%' OR p LIKE '@%'),
w AS (SELECT *, (CAST(('0x' || b) AS INT) >> 2) & 15 AS ac_type FROM u WHERE m.a <> '' AND b <> '')
SELECT seq, id,
  round((CAST(m.a AS DOUBLE) + CAST(m.b AS DOUBLE) / 60) * CASE m.c WHEN 'S' THEN -1 ELSE 1 END, 6) AS lat,
  round((CAST(m.d AS DOUBLE) + CAST(m.e AS DOUBLE) / 60) * CASE m.f WHEN 'W' THEN -1 ELSE 1 END, 6) AS lon,
  CAST(coalesce(round_even(TRY_CAST(ft AS DOUBLE) * 0.3048e0, 0), 0) AS INT) AS alt,
  coalesce(round_even(TRY_CAST(fpm AS DOUBLE) * 0.00508e0, 2), 0) AS vario,
  CASE WHEN TRY_CAST(cs.course AS INT) > 0 THEN CAST(cs.course AS INT) END AS heading,
  CAST(coalesce(round_even(TRY_CAST(cs.kn AS DOUBLE) * 1.852e0, 0), 0) AS INT) AS speed_kmh,
  coalesce(abs(TRY_CAST(rot AS DOUBLE) * 3.0e0) > 8, false) AS circling,
  CAST(ac_type AS INT) AS ac_type, CASE ac_type {NAMES} END AS ac_type_name,
  ac_type = 2 AS is_tow, CAST(NULL AS BOOLEAN) AS under_tow
FROM w WHERE ac_type IN (1, 2, 6, 7)
""")
def _(read):
    return parse_beacons(read("aprs_lines")).withColumns(
        {"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


IGC_SQL = """
h AS (SELECT *, CASE WHEN value LIKE 'HFDTE%' OR value LIKE 'HPDTE%' THEN regexp_replace(substr(value, 6), '[^0-9]', '', 'g') END AS dg FROM igc_lines),
d AS (SELECT *, last_value(CASE WHEN length(dg) >= 6 THEN make_date(2000 + CAST(substr(dg, 5, 2) AS INT), CAST(substr(dg, 3, 2) AS INT), CAST(substr(dg, 1, 2) AS INT)) END IGNORE NULLS)
        OVER (PARTITION BY flight ORDER BY line ROWS UNBOUNDED PRECEDING) AS day FROM h),
fixes AS (SELECT flight, block, line,
    epoch(CAST(day AS TIMESTAMP)) + CAST(substr(value, 2, 2) AS INT) * 3600 + CAST(substr(value, 4, 2) AS INT) * 60 + CAST(substr(value, 6, 2) AS INT) AS t,
    CAST(substr(value, 8, 2) AS INT) + CAST(substr(value, 10, 5) AS DOUBLE) / 1000 / 60 AS lat,
    CAST(substr(value, 16, 3) AS INT) + CAST(substr(value, 19, 5) AS DOUBLE) / 1000 / 60 AS lon,
    CAST(substr(value, 26, 5) AS DOUBLE) AS pressure_alt, CAST(substr(value, 31, 5) AS DOUBLE) AS alt
  FROM d WHERE value LIKE 'B%' AND length(value) >= 35 AND day IS NOT NULL)
"""


def igc_fixes(read):
    return parse_igc_lines(read("igc_lines"))


@query("igc_fixes", ["igc_lines"], f"""WITH {IGC_SQL}
SELECT flight, line, CAST(t AS BIGINT) AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, alt, pressure_alt FROM fixes""")
def _(read):
    return igc_fixes(read).select("flight", "line", seconds("time"), *r6("lat", "lon"), "alt", "pressure_alt")


KIN_SQL = f"""{IGC_SQL},
k0 AS (SELECT *, lag(t) OVER w AS t1, lag(lat) OVER w AS la1, lag(lon) OVER w AS lo1, lag(alt) OVER w AS al1,
    lag(t, 2) OVER w AS t2, lag(lat, 2) OVER w AS la2, lag(lon, 2) OVER w AS lo2, count(*) OVER (PARTITION BY flight) AS n
  FROM fixes WINDOW w AS (PARTITION BY flight ORDER BY line)),
k1 AS (SELECT *, t - t1 AS dt,
    degrees(atan2((lon - lo1) * cos(radians(lat)), lat - la1)) AS b1,
    degrees(atan2((lo1 - lo2) * cos(radians(la1)), la1 - la2)) AS b2 FROM k0 WHERE n >= 2),
k2 AS (SELECT *, (CASE WHEN b1 < 0 THEN b1 + 360 ELSE b1 END) - (CASE WHEN b2 < 0 THEN b2 + 360 ELSE b2 END) + 180 AS q FROM k1),
kin AS (SELECT flight, block, line, t, lat, lon, alt,
    CASE WHEN t1 IS NULL THEN 0 ELSE (alt - al1) / dt END AS vario,
    CASE WHEN t2 IS NOT NULL AND t1 > t2 THEN (q - 360 * floor(q / 360) - 180) / dt ELSE 0 END AS turn_rate
  FROM k2 WHERE t1 IS NULL OR dt > 0)
"""


def kinematics(read):
    return tracks.with_kinematics(igc_fixes(read), ["flight"], ["block", "line"], F.col("block"))


@query("igc_kinematics", ["igc_lines"], f"""WITH {KIN_SQL}
SELECT flight, line, CAST(t AS BIGINT) AS time, round(vario, 6) AS vario, round(turn_rate, 6) AS turn_rate, abs(turn_rate) > 8 AS circling FROM kin""")
def _(read):
    return kinematics(read).select("flight", "line", seconds("time"), *r6("vario", "turn_rate"), "circling")


def thinned(read):
    return tracks.thin(kinematics(read), ["flight"], "time", ["block", "line"], F.col("block"), block_s=120)


THIN_SQL = """
first_row AS (SELECT flight, arg_min(line, line) AS line, arg_min(t, line) AS t FROM kin GROUP BY flight),
chain AS (SELECT flight, line, t FROM first_row
  UNION ALL
  SELECT c.flight, n.line, n.t FROM chain c, LATERAL (
    SELECT k.line, k.t FROM kin k WHERE k.flight = c.flight AND k.line > c.line AND k.t >= c.t + 30 ORDER BY k.line LIMIT 1) n)"""


@query("thin_fixes", ["igc_lines"], f"""WITH RECURSIVE {KIN_SQL}, {THIN_SQL}
SELECT flight, line, CAST(t AS BIGINT) AS time FROM chain""")
def _(read):
    return thinned(read).select("flight", "line", seconds("time"))


@query("thin_cells", ["beacons"], """WITH RECURSIVE
b AS (SELECT seq, t_dense_s AS t, CAST(round_even(lat * 100, 0) AS BIGINT) * 100000 + CAST(round_even(lon * 100, 0) AS BIGINT) AS cell FROM beacons),
chain AS (SELECT cell, min(seq) AS seq, min(t) AS t FROM b GROUP BY cell
  UNION ALL
  SELECT c.cell, n.seq, n.t FROM chain c, LATERAL (
    SELECT k.seq, k.t FROM b k WHERE k.cell = c.cell AND k.t >= c.t + 30 ORDER BY k.seq LIMIT 1) n)
SELECT cell, seq FROM chain""")
def _(read):
    cell = point_key("lat", K.COARSE_DP) * 100000 + point_key("lon", K.COARSE_DP)
    cells = read("beacons").select("seq", "ts", cell.alias("cell"))
    return tracks.thin(cells, ["cell"], "ts", ["seq"], number_block("seq", 4096)).select("cell", "seq")


@query("snapshot_fixes", ["snapshot_json"], """
WITH a AS (SELECT doc, unnest(from_json(json, '{"a":["JSON"]}').a) AS r FROM snapshot_json),
f AS (SELECT doc, TRY_CAST(json_extract_string(r, '$."1"') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(r, '$."2"') AS DOUBLE) AS lon,
  TRY_CAST(json_extract_string(r, '$."3"') AS DOUBLE) AS alt, TRY_CAST(json_extract_string(r, '$."4"') AS DOUBLE) AS vario FROM a)
SELECT doc, lat, lon, alt, vario, vario > 1.5 AS circling FROM f
WHERE vario IS NOT NULL AND lat BETWEEN 46 AND 47.5 AND lon BETWEEN 15 AND 15.8""")
def _(read):
    fixes = fixes_from_snapshot(read("snapshot_json"), "2024-06-21 12:00:00", box=(46.0, 47.5, 15.0, 15.8))
    return fixes.select("doc", "lat", "lon", "alt", "vario", "circling")


@query("thermal_fixes", ["thermal_json"], """
WITH f AS (SELECT doc,
  coalesce(nullif(CAST(json_extract(json, '$.latitude') AS DOUBLE), 0), nullif(CAST(json_extract(json, '$.lat') AS DOUBLE), 0)) AS lat,
  coalesce(nullif(CAST(json_extract(json, '$.longitude') AS DOUBLE), 0), nullif(CAST(json_extract(json, '$.lon') AS DOUBLE), 0)) AS lon,
  coalesce(nullif(CAST(json_extract(json, '$.avg_climb') AS DOUBLE), 0), nullif(CAST(json_extract(json, '$.vario') AS DOUBLE), 0), 2.0) AS vario,
  coalesce(nullif(CAST(json_extract(json, '$.altitude') AS DOUBLE), 0), 800.0) AS alt,
  coalesce(json_extract_string(json, '$.date'), '2024-06-30') AS day FROM thermal_json)
SELECT doc, lat, lon, CAST(vario AS DOUBLE) AS vario, CAST(alt AS DOUBLE) AS alt, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS time
FROM f WHERE lat BETWEEN 46 AND 47.5""")
def _(read):
    fixes = fixes_from_thermals(read("thermal_json"), "2024-06-30", box=(46.0, 47.5, -180.0, 180.0))
    return fixes.select("doc", "lat", "lon", "vario", "alt", seconds("time"))


@query("weather_rows", ["weather_json"], """
WITH i AS (SELECT doc, json, unnest([0, 1]) AS hour_index FROM weather_json)
SELECT doc, CAST(hour_index AS INT) AS hour_index,
  CAST(epoch(CAST(json_extract_string(json, '$.hourly.time[' || hour_index || ']') AS TIMESTAMP)) AS BIGINT) AS hour,
""" + ",\n".join(f"  TRY_CAST(json_extract_string(json, '$.hourly.{k}[' || hour_index || ']') AS DOUBLE) AS {v}"
                 for k, v in K.WEATHER_VARIABLES.items()) + "\nFROM i")
def _(read):
    rows = weather_rows(read("weather_json"))
    return rows.select("doc", "hour_index", seconds("hour"), *K.WEATHER_VARIABLES.values())


@query("evidence_labels", ["beacons"], """
SELECT ac_type IN (1, 6, 7) AS soaring,
  ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, false) AS live_evidence,
  ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, true) AS history_evidence,
  CAST(circling AND vario > 1.5 AS INT) AS label, CAST(circling AND vario > 0.5 AS INT) AS clustering,
  CAST(circling AND vario > 1.0 AS INT) AS fusion, CAST(circling AND vario > 0.3 AS INT) AS density, count(*) AS n
FROM beacons GROUP BY ALL""")
def _(read):
    return read("beacons").groupBy(
        is_soaring().alias("soaring"), is_evidence(False).alias("live_evidence"),
        is_evidence(True).alias("history_evidence"), lift_label().alias("label"),
        lift_label(threshold=K.CLUSTER_VARIO).alias("clustering"),
        lift_label(threshold=K.FUSION_VARIO).alias("fusion"),
        lift_label(threshold=K.DENSITY_VARIO).alias("density")).agg(F.count("*").alias("n"))


@query("label_balance", ["beacons"], """
SELECT CAST(circling AND vario > 1.5 AS INT) AS label, count(*) AS rows FROM beacons
WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, true) GROUP BY 1""")
def _(read):
    return label_balance(read("beacons").filter(is_evidence(True)).select(lift_label().alias("label")))


@query("viewport", ["beacons"], """
SELECT seq, id FROM beacons WHERE lat BETWEEN 46 AND 46.025 AND (lon BETWEEN 374.99 AND 375.02 OR lon + 360 BETWEEN 374.99 AND 375.02)""")
def _(read):
    bounds = L.parse_bounds({"lat_min": "46", "lat_max": 46.025, "lon_min": 374.99, "lon_max": 375.02})
    return L.in_viewport(read("beacons"), bounds).select("seq", "id")


LATEST = "latest AS (SELECT * FROM beacons QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


@query("search_ids", ["beacons"], f"""
WITH {LATEST} SELECT id, seq, CAST(rank AS INT) AS rank FROM (
  SELECT id, seq, row_number() OVER (ORDER BY CASE WHEN lower(id) LIKE 'g1%' THEN 0 ELSE 1 END, id) AS rank
  FROM latest WHERE lower(id) LIKE '%g1%') WHERE rank <= 25""")
def _(read):
    from pyspark.sql import Window

    hits = L.search_ids(L.latest_by(read("beacons"), ["id"]), " G1 ", 40)
    rank = F.row_number().over(Window.orderBy((~F.lower("id").startswith("g1")).cast("int"), "id"))
    return hits.select("id", "seq", rank.alias("rank"))


@query("by_id", ["beacons"], f"WITH {LATEST} SELECT id, seq, alt, vario FROM latest WHERE id = 'G4'")
def _(read):
    return L.by_id(L.latest_by(read("beacons"), ["id"]), "G4").select("id", "seq", "alt", "vario")


@query("wire", ["beacons"], f"""
SELECT id, round(lat, 5) AS lat, round(lon, 5) AS lon, alt, vario, heading, speed_kmh, circling, ac_type = 2 AS is_tow,
  under_tow, ac_type, CASE ac_type {NAMES} END AS ac_type_name FROM beacons""")
def _(read):
    return L.to_wire(read("beacons").withColumn("ac_type_name", type_name("ac_type")))


@query("traffic_counts", ["beacons"], """
SELECT count(*) FILTER (speed_kmh > 30 AND circling) AS circling, count(*) FILTER (speed_kmh > 30 AND ac_type = 2) AS tow,
  count(*) FILTER (speed_kmh > 30) AS visible, count(*) AS total FROM beacons""")
def _(read):
    rows = read("beacons").withColumn("agl", F.lit(None).cast("double"))
    return L.traffic_counts(rows, airborne())


@query("live_snapshots", ["beacons"], f"""WITH {FEED_RUNS}
SELECT CAST(ceil(({'{'}E{'}'} + t_dense_s) / 300.0e0) AS BIGINT) AS cycle, id, max(seq) AS seq, arg_max(alt, seq) AS alt,
  arg_max(vario, seq) AS vario, arg_max(heading, seq) AS heading, arg_max(run, seq) AS first_seen FROM feed_runs GROUP BY 1, 2
""".replace("{E}", "1718956800").replace("arg_max(heading, seq)", "arg_max_null(heading, seq)"))
def _(read):
    return L.live_snapshots(read("beacons")).select("cycle", "id", "seq", "alt", "vario", "heading", "first_seen")


@query("live_state", ["beacons"], f"""WITH {FEED_RUNS},
m AS (SELECT max(t_dense_s) AS t FROM beacons)
SELECT id, max(seq) AS seq, arg_max(run, seq) AS first_seen, arg_max(alt, seq) AS alt FROM feed_runs, m
WHERE t_dense_s > m.t - 300 GROUP BY id""")
def _(read):
    beacons = read("beacons")
    asof = beacons.agg(F.max("ts")).scalar()
    return L.live_state(beacons, asof).select("id", "seq", "first_seen", "alt")


@query("track_sessions", ["beacons"], """
WITH g AS (SELECT *, CASE WHEN t_dense_s - lag(t_dense_s) OVER (PARTITION BY id ORDER BY t_dense_s) <= 300 THEN 0 ELSE 1 END AS cut FROM beacons),
s AS (SELECT *, sum(cut) OVER (PARTITION BY id ORDER BY t_dense_s) AS n FROM g)
SELECT id, 1718956800 + min(t_dense_s) AS first_ts, 1718956800 + max(t_dense_s) AS last_ts, count(*) AS beacons, max(alt) AS max_alt FROM s GROUP BY id, n""")
def _(read):
    return S.track_sessions(read("beacons")).select("id", seconds("first_ts"), seconds("last_ts"), "beacons", "max_alt")


@query("hourly_climbs", ["beacons"], """
SELECT CAST(epoch(date_trunc('hour', ts_hist)) AS BIGINT) AS hour, CAST(floor(lat_hist / 0.01e0) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.01e0) AS BIGINT) AS lon_cell,
  CAST(sum(CASE WHEN circling AND vario > 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS climbs, count(*) AS total
FROM beacons WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, true) GROUP BY ALL""")
def _(read):
    rows = read("beacons").withColumns({"ts": F.col("ts_hist"), "lat": F.col("lat_hist")})
    return S.hourly_climb_index(rows).select(seconds("hour"), "lat_cell", "lon_cell", "climbs", "total")


@query("live_stream", ["beacons"], f"""WITH {FEED_RUNS},
m AS (SELECT max(t_dense_s) AS t FROM beacons)
SELECT id, max(seq) AS seq, arg_max(run, seq) AS first_seen, arg_max(alt, seq) AS alt FROM feed_runs, m
WHERE t_dense_s > m.t - 300 GROUP BY id""")
def _(read):
    """The keyed live table after a stream over the whole event table."""
    reports = read("beacons", stream=True).select("seq", "id", "ts", "lat", "lon", "alt", "vario", "ac_type")
    checkpoint = f"{ensure_checkpoint_dir(reports.sparkSession).rstrip('/')}/live-{uuid.uuid4().hex}"
    query = LT.start_live(LT.live_changes(reports).writeStream.format("noop").trigger(availableNow=True), checkpoint)
    query.awaitTermination()
    return LT.read_live(reports.sparkSession, checkpoint, reports.schema).select("id", "seq", "first_seen", "alt")


@query("positions_since", ["beacons"], """
SELECT id, seq, lat, lon, alt FROM beacons QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) <= 20""")
def _(read):
    return L.positions_since(read("beacons"), -1, K.BUFFER_CAP_IDLE)


@query("path_tail", ["beacons"], """
SELECT id, count(*) AS n, min(seq) AS first_seq FROM (
  SELECT * FROM beacons QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) <= 2000) GROUP BY id""")
def _(read):
    return L.path_tail(read("beacons")).groupBy("id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("visible_positions", ["beacons"], f"""
WITH {LATEST} SELECT id, seq, round(lat, 5) AS lat, round(lon, 5) AS lon, alt FROM beacons
WHERE id IN (SELECT id FROM latest WHERE lat BETWEEN 46 AND 46.02)""")
def _(read):
    beacons = read("beacons")
    shown = L.in_viewport(L.latest_by(beacons, ["id"]), (46.0, 46.02, 10.0, 20.0))
    return L.visible_positions(beacons, shown).select(
        "id", "seq", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "alt")


@query("current_segment", ["beacons"], """
WITH m AS (SELECT max(t_dense_s) AS t FROM beacons),
r AS (SELECT b.*, t_dense_s - lag(t_dense_s) OVER (PARTITION BY id ORDER BY seq) AS gap FROM beacons b, m WHERE t_dense_s >= m.t - 57600),
c AS (SELECT id, max(t_dense_s) FILTER (gap > 300) AS cut FROM r GROUP BY id)
SELECT r.id, r.seq FROM r JOIN c ON r.id = c.id WHERE c.cut IS NULL OR r.t_dense_s >= c.cut""")
def _(read):
    beacons = read("beacons")
    return L.current_segment(beacons, beacons.agg(F.max("ts")).scalar()).select("id", "seq")


FRAMES = """frames AS (
  SELECT id, frame, seq, floor(lat * 100) AS glat, floor(lon * 100) AS glon FROM (
    SELECT *, CAST(floor(t_dense_s / 60e0) AS BIGINT) AS frame FROM beacons)
  QUALIFY row_number() OVER (PARTITION BY id, frame ORDER BY seq DESC) = 1)"""


@query("position_stamps", ["beacons"], f"""
WITH {FRAMES},
p AS (SELECT *, lag(frame) OVER w AS pf, lag(glat) OVER w AS pla, lag(glon) OVER w AS plo FROM frames WINDOW w AS (PARTITION BY id ORDER BY frame)),
e AS (SELECT *, CASE WHEN pf IS NULL OR pf <> frame - 1 THEN -1 WHEN pla <> glat OR plo <> glon THEN frame * 60 END AS mark FROM p)
SELECT id, frame, CAST(nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY frame ROWS UNBOUNDED PRECEDING), -1) AS BIGINT) AS rx FROM e""")
def _(read):
    frame = F.floor(F.col("t_dense_s") / F.lit(60.0)).cast("bigint")
    latest = L.latest_by(read("beacons").withColumn("frame", frame).select("id", "frame", "seq", "lat", "lon"),
                         ["id", "frame"])
    frames = latest.select("id", "frame", F.floor(F.col("lat") * 100).alias("lat"),
                           F.floor(F.col("lon") * 100).alias("lon"),
                           F.timestamp_seconds(F.col("frame") * 60).alias("ts"))
    return L.position_stamps(frames, block_frames=16).select("id", "frame", seconds("rx"))


@query("merge_track", ["beacons"], """
WITH s AS (SELECT * FROM beacons WHERE circling), l AS (SELECT * FROM beacons WHERE NOT circling OR vario > 3),
last AS (SELECT id, arg_max(lat, seq) AS la, arg_max(lon, seq) AS lo FROM s GROUP BY id)
SELECT id, seq, 0 AS part FROM s UNION ALL
SELECT l.id, l.seq, 1 AS part FROM l LEFT JOIN last ON l.id = last.id
WHERE last.id IS NULL OR abs(l.lat - la) > 1e-6 OR abs(l.lon - lo) > 1e-6""")
def _(read):
    beacons = read("beacons")
    merged = L.merge_track(beacons.filter("circling"), beacons.filter("NOT circling OR vario > 3"))
    return merged.select("id", "seq", "part")


@query("prefer_streamed", ["beacons"], """
WITH s AS (SELECT id, max(seq) AS seq, arg_max(alt, seq) AS alt FROM beacons WHERE alt < 600 GROUP BY id),
p AS (SELECT id, max(seq) AS seq, arg_max(alt, seq) AS alt FROM beacons WHERE speed_kmh >= 60 GROUP BY id)
SELECT coalesce(s.id, p.id) AS id, coalesce(s.seq, p.seq) AS seq, CASE WHEN s.id IS NOT NULL THEN s.alt ELSE p.alt END AS alt
FROM s FULL JOIN p ON s.id = p.id""")
def _(read):
    rows = read("beacons").select("id", "seq", "alt", "speed_kmh")
    pick = ["id", "seq", "alt"]
    return L.prefer_streamed(L.latest_by(rows.filter("alt < 600").select(*pick), ["id"]),
                             L.latest_by(rows.filter("speed_kmh >= 60").select(*pick), ["id"]))


@query("extrapolate", ["beacons"], """
WITH a AS (SELECT *, CAST(seq % 20 AS DOUBLE) AS age FROM beacons),
u AS (SELECT *, NOT circling AND heading IS NOT NULL AND speed_kmh >= 5 AND age > 0 AND age <= 15 AS ok, speed_kmh / 3.6e0 * age AS d FROM a)
SELECT seq, round(CASE WHEN ok THEN lat + d * cos(radians(heading)) / 111320 ELSE lat END, 6) AS lat,
  round(CASE WHEN ok THEN lon + d * sin(radians(heading)) / (111320 * greatest(0.01e0, cos(radians(lat)))) ELSE lon END, 6) AS lon FROM u""")
def _(read):
    lat, lon = extrapolated("lat", "lon", "heading", "speed_kmh", "circling",
                            (F.col("seq") % 20).cast("double"))
    return read("beacons").select("seq", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("retention", ["beacons"], """
SELECT seq, id FROM beacons WHERE ts_hist >= TIMESTAMP '2024-01-28 12:00:00' AND lat_hist BETWEEN 46 AND 47""")
def _(read):
    from datetime import datetime, timezone

    rows = read("beacons").withColumn("lat", F.col("lat_hist"))
    now = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
    return retain(rows, now, ts="ts_hist", box=(46.0, 47.0, -180.0, 180.0)).select("seq", "id")


@query("under_tow", ["beacons"], """
WITH t AS (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS nxt FROM beacons WHERE ac_type = 2),
tt AS (SELECT * FROM t WHERE vario >= 0.3e0),
hit AS (SELECT DISTINCT g.seq FROM beacons g JOIN tt ON tt.seq < g.seq AND (tt.nxt IS NULL OR g.seq < tt.nxt)
    AND tt.t_dense_s >= g.t_dense_s - 15 AND tt.t_dense_s <= g.t_dense_s
  WHERE g.ac_type IN (1, 6, 7) AND abs(tt.alt - g.alt) <= 100
    AND 2 * 6371000 * asin(sqrt(pow(sin(radians(tt.lat - g.lat) / 2), 2)
      + cos(radians(g.lat)) * cos(radians(tt.lat)) * pow(sin(radians(tt.lon - g.lon) / 2), 2))) <= 400)
SELECT seq, id, seq IN (SELECT seq FROM hit) AS under_tow FROM beacons""")
def _(read):
    return flag_under_tow(read("beacons")).select("seq", "id", "under_tow")


@query("cluster_climbs", ["beacons"], f"""WITH RECURSIVE {FEED_RUNS},
live AS (SELECT CAST(ceil((1718956800 + t_dense_s) / 300.0e0) AS BIGINT) AS cycle, id, arg_max(run, seq) AS ord, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon,
    arg_max(alt, seq) AS alt, arg_max(vario, seq) AS vario, arg_max(circling, seq) AS circling, arg_max(ac_type, seq) AS ac_type,
    arg_max_null(under_tow, seq) AS under_tow FROM feed_runs GROUP BY 1, 2),
climbing AS (SELECT cycle, ord, lat, lon, alt, vario FROM live WHERE ac_type IN (1, 6, 7) AND NOT coalesce(under_tow, false) AND circling AND vario > 0.5),
r AS (
  SELECT cycle, ord, lat, lon, alt, vario, CAST(NULL AS BIGINT) AS seed FROM climbing
  UNION ALL
  SELECT cycle, ord, lat, lon, alt, vario,
    CASE WHEN abs(lat - first_value(lat) OVER w) < 0.012e0 AND abs(lon - first_value(lon) OVER w) < 0.012e0 THEN first_value(ord) OVER w END AS seed
  FROM r WHERE seed IS NULL WINDOW w AS (PARTITION BY cycle ORDER BY ord))
SELECT cycle, seed, round(avg(lat) + 1e-9, 6) AS lat, round(avg(lon) + 1e-9, 6) AS lon, round(avg(vario) + 1e-9, 6) AS avg_vario,
  count(*) AS count, round(avg(alt) + 1e-9, 6) AS est_alt_m FROM r WHERE seed IS NOT NULL GROUP BY cycle, seed""")
def _(read):
    live = L.live_snapshots(read("beacons"))
    out = cluster_climbs(live, is_evidence(False), ["cycle"], rounded=False)
    return out.select("cycle", "seed", "count", *[
        F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("lat", "lon", "avg_vario", "est_alt_m")])


ELEV4 = """e4 AS (SELECT lat_i * 100 AS lat_e4, lon_j * 100 AS lon_e4, elevation FROM elevation_points
  UNION ALL SELECT lat_i * 100 + 1 + lat_i % 7, lon_j * 100 + lon_j % 9 + 1, elevation + 60 FROM elevation_points)"""


def elevations_e4(read):
    points = read("elevation_points")
    coarse = points.select((F.col("lat_i") * 100).alias("lat_e4"), (F.col("lon_j") * 100).alias("lon_e4"), "elevation")
    fine = points.select((F.col("lat_i") * 100 + 1 + F.col("lat_i") % 7).alias("lat_e4"),
                         (F.col("lon_j") * 100 + F.col("lon_j") % 9 + 1).alias("lon_e4"),
                         (F.col("elevation") + 60).alias("elevation"))
    return coarse.unionByName(fine)


@query("with_ground", ["beacons", "elevation_points"], f"""
WITH {ELEV4} SELECT b.seq, e4.elevation AS ground FROM beacons b LEFT JOIN e4
  ON e4.lat_e4 = CAST(round_even(b.lat * 100, 0) AS BIGINT) * 100 AND e4.lon_e4 = CAST(round_even(b.lon * 100, 0) AS BIGINT) * 100""")
def _(read):
    return with_ground(read("beacons"), elevations_e4(read)).select("seq", "ground")


@query("with_agl", ["beacons", "elevation_points"], f"""
WITH {ELEV4} SELECT b.seq, b.alt - CASE WHEN b.alt - c.elevation <= 150 AND coalesce(speed_kmh, 0) <= 40 THEN coalesce(f.elevation, c.elevation) ELSE c.elevation END AS agl
FROM beacons b
LEFT JOIN e4 c ON c.lat_e4 = CAST(round_even(b.lat * 100, 0) AS BIGINT) * 100 AND c.lon_e4 = CAST(round_even(b.lon * 100, 0) AS BIGINT) * 100
LEFT JOIN e4 f ON f.lat_e4 = CAST(round_even(b.lat * 10000, 0) AS BIGINT) AND f.lon_e4 = CAST(round_even(b.lon * 10000, 0) AS BIGINT)""")
def _(read):
    return with_agl(read("beacons"), elevations_e4(read)).select("seq", "agl")


@query("plan_lookups", ["beacons", "elevation_points"], f"""
WITH {ELEV4}, w AS (SELECT CAST(round_even(lat * 1000, 0) AS BIGINT) * 10 AS lat_e4, CAST(round_even(lon * 1000, 0) AS BIGINT) * 10 AS lon_e4, min(seq) AS first_order
  FROM beacons GROUP BY 1, 2),
u AS (SELECT w.*, row_number() OVER (ORDER BY first_order, w.lat_e4, w.lon_e4) AS n FROM w LEFT JOIN e4 ON w.lat_e4 = e4.lat_e4 AND w.lon_e4 = e4.lon_e4 WHERE e4.lat_e4 IS NULL)
SELECT lat_e4, lon_e4, first_order, CAST(floor((n - 1) / 100) AS INT) AS chunk FROM u WHERE n <= 300""")
def _(read):
    return plan_lookups(read("beacons"), elevations_e4(read), max_chunks=3, dp=3)


# A viewer's frame at the end of the feed: the middle of the map, positions of the last 200 reports.
FRAME_BOX = (46.01, 46.03, 15.01, 15.05)
FRAME_SQL = f"""{FEED_RUNS},
live AS (SELECT id, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, arg_max(alt, seq) AS alt, arg_max(speed_kmh, seq) AS speed_kmh, arg_max(vario, seq) AS vario FROM feed_runs,
    (SELECT max(t_dense_s) AS t FROM beacons) m WHERE t_dense_s > m.t - 300 GROUP BY id),
shown AS (SELECT * FROM live WHERE lat BETWEEN 46.01 AND 46.03 AND lon BETWEEN 15.01 AND 15.05)"""


def frame(read):
    beacons = read("beacons").drop("under_tow").withColumn("under_tow", F.lit(False))
    end = beacons.agg(F.max("ts").alias("t")).scalar()
    cursor = L.cursor_head(beacons).scalar() - 200
    return S.live_frame(beacons, elevations_e4(read), end, FRAME_BOX, cursor)


@query("frame_aircraft", ["beacons", "elevation_points"], f"""WITH {FRAME_SQL}, {ELEV4}
SELECT id, round(round_even(s.lat, 5), 6) AS lat, round(round_even(s.lon, 5), 6) AS lon, s.alt, s.vario,
  s.alt - CASE WHEN s.alt - c.elevation <= 150 AND coalesce(speed_kmh, 0) <= 40 THEN coalesce(f.elevation, c.elevation) ELSE c.elevation END AS agl
FROM shown s LEFT JOIN e4 c ON c.lat_e4 = CAST(round_even(s.lat * 100, 0) AS BIGINT) * 100 AND c.lon_e4 = CAST(round_even(s.lon * 100, 0) AS BIGINT) * 100
LEFT JOIN e4 f ON f.lat_e4 = CAST(round_even(s.lat * 10000, 0) AS BIGINT) AND f.lon_e4 = CAST(round_even(s.lon * 10000, 0) AS BIGINT)""")
def _(read):
    shown, _ = frame(read)
    return shown.select("id", *r6("lat", "lon"), "alt", "vario", "agl")


@query("frame_positions", ["beacons"], f"""WITH {FRAME_SQL}
SELECT id, round(round_even(lat, 5), 6) AS lat, round(round_even(lon, 5), 6) AS lon, alt FROM beacons
WHERE seq > (SELECT max(seq) FROM beacons) - 200 AND id IN (SELECT id FROM shown)""")
def _(read):
    _, new = frame(read)
    return new.select("id", *r6("lat", "lon"), "alt")


@query("merge_elevations", ["beacons", "elevation_points"], """
WITH k AS (SELECT lat_i * 100 AS lat_e4, lon_j * 100 AS lon_e4, elevation FROM elevation_points),
f AS (SELECT CAST(round_even(lat * 100, 0) AS BIGINT) * 100 AS lat_e4, CAST(round_even(lon * 100, 0) AS BIGINT) * 100 AS lon_e4, max(alt) AS elevation FROM beacons GROUP BY 1, 2)
SELECT coalesce(k.lat_e4, f.lat_e4) AS lat_e4, coalesce(k.lon_e4, f.lon_e4) AS lon_e4, coalesce(f.elevation, k.elevation) AS elevation
FROM k FULL JOIN f ON k.lat_e4 = f.lat_e4 AND k.lon_e4 = f.lon_e4""")
def _(read):
    known = read("elevation_points").select(
        (F.col("lat_i") * 100).alias("lat_e4"), (F.col("lon_j") * 100).alias("lon_e4"), "elevation")
    fresh = read("beacons").groupBy((point_key("lat", 2) * 100).alias("lat_e4"),
                                    (point_key("lon", 2) * 100).alias("lon_e4")).agg(F.max("alt").alias("elevation"))
    return merge_elevations(known, fresh)


@query("geojson", ["beacons"], """
WITH c AS (SELECT seq % 50 AS request_id, seq % 201 AS row, (seq * 7) % 201 AS col, (seq * 13) % 1009 / 1009e0 AS p, seq % 5 * 300 AS base, seq % 997 + 0.25e0 AS cape, seq FROM beacons)
SELECT request_id, row, col, floor(p * 1000 + 0.5) / 1000 AS p, base AS thermal_base, CAST(floor(cape + 0.5) AS INT) AS cape,
  round(15 - 0.05e0 + col * 0.0005e0 - 0.00025e0, 6) AS west, round(46 - 0.05e0 + row * 0.0005e0 + 0.00025e0, 6) AS north
FROM c WHERE floor(p * 1000 + 0.5) / 1000 > 0.05""")
def _(read):
    seq = F.col("seq")
    cells = read("beacons").select(
        (seq % 50).alias("request_id"), (seq % 201).alias("row"), ((seq * 7) % 201).alias("col"),
        F.lit(46.0).alias("grid_lat"), F.lit(15.0).alias("grid_lon"),
        ((seq * 13) % 1009 / F.lit(1009.0)).alias("p_mean"), (seq % 5 * 300).alias("thermal_base"),
        (seq % 997 + F.lit(0.25)).alias("cape"))
    ring = F.get(F.col("feature.geometry.coordinates"), F.lit(0))
    return geojson_features(cells).select(
        "request_id", "row", "col", F.col("feature.properties.thermal_probability").alias("p"),
        F.col("feature.properties.thermal_base_m").alias("thermal_base"),
        F.col("feature.properties.cape_j_per_kg").alias("cape"),
        F.round(F.get(F.get(ring, F.lit(0)), F.lit(0)), 6).alias("west"),
        F.round(F.get(F.get(ring, F.lit(2)), F.lit(1)), 6).alias("north"))

