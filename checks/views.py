"""Derived input views over the test tables.

The tables hold no positions, so position-like columns are integer arithmetic on
event and user numbers. Each text runs unchanged in Spark SQL and in DuckDB.
Reference layers (terrain, weather) are sums over all events, so that every row
of the table changes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "beacons": """
SELECT event_id AS seq,
       concat('G', CAST(user_id AS STRING)) AS id,
       ts AS ts_hist,
       event_id AS t_dense_s,
       CAST(CASE user_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 8 ELSE 1 END AS INT) AS ac_type,
       46 + CAST((event_id * event_id * 31 + user_id * 97) % 401 AS DOUBLE) / 10000 AS lat,
       15 + CAST((event_id * event_id * 17 + user_id * 53) % 601 AS DOUBLE) / 10000 AS lon,
       46 + CAST(user_id % 4 AS DOUBLE) / 2 + CAST((event_id * event_id * 31 + user_id * 97) % 401 AS DOUBLE) / 10000 AS lat_hist,
       400 + (event_id * event_id * 7 + user_id * 17) % 997 AS alt,
       CAST((event_id * 13 + user_id * 7) % 81 - 30 AS DOUBLE) / 10 AS vario,
       abs((event_id * 11) % 41 - 20) > 8 AS circling,
       CASE WHEN (event_id * 37) % 360 = 0 THEN NULL ELSE (event_id * 37) % 360 END AS heading,
       (event_id * 29) % 140 AS speed_kmh,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 19 = 0 END AS under_tow
FROM events
""",
    # Lattice of 20 x 20 points in each of four latitude zones; every event changes its point's height.
    "elevation_points": """
SELECT 4593 + 50 * (k % 4) + CAST((k - k % 4) / 4 AS BIGINT) % 20 AS lat_i,
       1493 + CAST((k - k % 80) / 80 AS BIGINT) AS lon_j,
       200 + (k * k * 7 + m * 13) % 300 AS elevation
FROM (SELECT event_id % 1600 AS k, CAST(sum(event_id) % 1000003 AS BIGINT) AS m FROM events GROUP BY event_id % 1600) p
""",
    # 720 hours x 4 half-degree cells; every event changes its hour's values, and some hours are missing.
    "weather_hours": """
SELECT 46 + CAST(k % 4 AS DOUBLE) / 2 AS lat_b, CAST(15 AS DOUBLE) AS lon_b,
       CAST((k - k % 4) / 4 AS BIGINT) AS hour_no,
       CAST(m * 7 % 20 + 8 AS DOUBLE) AS temp_2m, CAST(m * 3 % 60 + 30 AS DOUBLE) AS humidity_pct,
       CAST(m * 5 % 25 AS DOUBLE) AS wind_speed, CAST(m * 37 % 360 AS DOUBLE) AS wind_dir,
       CAST(m * 11 % 1500 AS DOUBLE) AS cape, CAST(0 - m * 17 % 200 AS DOUBLE) AS cin,
       CAST(greatest(0, 900 - 25 * ((CAST((k - k % 4) / 4 AS BIGINT) % 24) - 12) * ((CAST((k - k % 4) / 4 AS BIGINT) % 24) - 12)) AS DOUBLE) AS solar_ghi,
       CAST(m * 7 % 20 - 4 AS DOUBLE) AS temp_850, CAST(0 - 20 + m % 9 AS DOUBLE) AS temp_500,
       CASE WHEN m % 13 = 0 THEN NULL ELSE CAST(400 + m * 19 % 1800 AS DOUBLE) END AS pbl_height,
       CAST(m * 7 % 20 + 10 AS DOUBLE) AS soil_temp
FROM (SELECT event_id % 2880 AS k, CAST(sum(event_id) % 1000003 AS BIGINT) AS m FROM events GROUP BY event_id % 2880) p
WHERE m % 7 <> 3
""",
    "landcover_pixels": """
SELECT event_id % 40 AS px, CAST((event_id - event_id % 40) / 40 AS BIGINT) % 40 AS py,
       CAST((event_id - event_id % 1600) / 1600 AS BIGINT) AS area,
       CASE (event_id * event_id * 3) % 11 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 80 WHEN 9 THEN 100 ELSE 0 END AS class
FROM events
""",
    "prediction_requests": """
SELECT s_suppkey AS request_id,
       46 + CAST(s_suppkey % 4 AS DOUBLE) / 2 + CAST(s_suppkey * 13 % 401 AS DOUBLE) / 10000 AS lat,
       15 + CAST(s_suppkey * 7 % 601 AS DOUBLE) / 10000 AS lon,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 900 + s_suppkey % 25 * 40 END AS alt_amsl,
       24 * (s_suppkey % 28) + 9 + s_suppkey % 7 AS hour_no
FROM supplier
""",
    "scored": """
SELECT event_id AS seq, CAST((event_id * event_id * 13) % 101 AS DOUBLE) / 100 AS score_a,
       CAST((event_id * event_id * 13) % 101 AS DOUBLE) / 100
         + CASE WHEN abs((event_id * 11) % 41 - 20) > 8 AND (event_id * 13 + user_id * 7) % 81 - 30 > 15 THEN 0.25e0 ELSE 0.0e0 END AS score_b,
       CASE WHEN abs((event_id * 11) % 41 - 20) > 8 AND (event_id * 13 + user_id * 7) % 81 - 30 > 15 THEN 1 ELSE 0 END AS label,
       dayofyear(ts) AS doy,
       46 + CAST(user_id % 4 AS DOUBLE) / 2 + CAST((event_id * event_id * 31 + user_id * 97) % 401 AS DOUBLE) / 10000 AS lat,
       15 + CAST((event_id * event_id * 17 + user_id * 53) % 601 AS DOUBLE) / 10000 AS lon
FROM events WHERE user_id % 10 NOT IN (0, 3)
""",
    "aprs_lines": """
SELECT event_id AS seq,
  concat('FLR', lpad(CAST(user_id AS STRING), 6, '0'), '>APRS,qAS,TEST:/120000h46',
    lpad(CAST((event_id * event_id * 31) % 60 AS STRING), 2, '0'), '.', lpad(CAST((event_id * 7) % 100 AS STRING), 2, '0'), 'N/015',
    lpad(CAST((event_id * event_id * 17) % 60 AS STRING), 2, '0'), '.', lpad(CAST((event_id * 3) % 100 AS STRING), 2, '0'), 'E''',
    lpad(CAST((event_id * 37) % 360 AS STRING), 3, '0'), '/', lpad(CAST((event_id * 29) % 90 AS STRING), 3, '0'),
    '/A=', lpad(CAST(1300 + (event_id * event_id * 7) % 3000 AS STRING), 6, '0'),
    CASE WHEN event_id % 17 = 0 THEN '' ELSE concat(' id', CASE user_id % 10 WHEN 0 THEN '0A' WHEN 1 THEN '1A' WHEN 2 THEN '1E' WHEN 3 THEN '22' ELSE '06' END, 'ABCDEF') END,
    CASE WHEN event_id % 2 = 0 THEN ' +' ELSE ' -' END, lpad(CAST((event_id * 13) % 700 AS STRING), 3, '0'), 'fpm ',
    CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END, CAST((event_id * 11) % 7 AS STRING), '.5rot') AS value
FROM events
""",
    # Flight logs: one flight per 200 events, a date header every 100 lines,
    # fixes every 4 s with an occasional repeated or skipped time.
    "igc_lines": """
SELECT concat('F', CAST((event_id - event_id % 200) / 200 AS BIGINT)) AS flight,
  CAST((event_id % 200 - event_id % 200 % 50) / 50 AS BIGINT) AS block, event_id AS line,
  CASE WHEN event_id % 100 = 0 THEN concat('HFDTE', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '0624')
       WHEN event_id % 41 = 7 THEN 'LXXX comment'
       ELSE concat('B', lpad(CAST(10 + CAST((event_id % 200 * 4 - event_id % 200 * 4 % 3600) / 3600 AS BIGINT) AS STRING), 2, '0'),
         lpad(CAST(CAST(((event_id % 200 - CASE WHEN event_id % 29 = 3 THEN 1 ELSE 0 END) * 4 % 3600 - (event_id % 200 - CASE WHEN event_id % 29 = 3 THEN 1 ELSE 0 END) * 4 % 60) / 60 AS BIGINT) AS STRING), 2, '0'),
         lpad(CAST((event_id % 200 - CASE WHEN event_id % 29 = 3 THEN 1 ELSE 0 END) * 4 % 60 AS STRING), 2, '0'),
         '46', lpad(CAST(1000 + (event_id * 37 + event_id * event_id * 3) % 900 AS STRING), 5, '0'), 'N',
         '015', lpad(CAST(2000 + (event_id * 53 + event_id * event_id * 5) % 900 AS STRING), 5, '0'), 'E',
         'A', lpad(CAST(900 + event_id % 50 AS STRING), 5, '0'), lpad(CAST(800 + (event_id * event_id) % 61 AS STRING), 5, '0')) END AS value
FROM events
""",
    "snapshot_json": """
SELECT event_id AS doc,
  concat('{"a":[{"0":"G', CAST(user_id AS STRING), '","1":"', CAST(46 + user_id % 3 AS STRING), '.', lpad(CAST(event_id * 31 % 1000 AS STRING), 3, '0'),
    '","2":"15.', lpad(CAST(event_id * 17 % 1000 AS STRING), 3, '0'), '","3":"', CAST(500 + event_id % 700 AS STRING),
    '","4":"', CAST(event_id % 5 AS STRING), '.', CAST(event_id % 10 AS STRING), '"},{"0":"X","1":"46.5","2":"15.25","3":"800","4":"',
    CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE '2.5' END, '"}]}') AS json
FROM events
""",
    "thermal_json": """
SELECT event_id AS doc,
  concat('{', CASE WHEN event_id % 2 = 0 THEN '"latitude":' ELSE '"lat":' END, CAST(46 + user_id % 3 AS STRING), '.', lpad(CAST(event_id * 31 % 1000 AS STRING), 3, '0'),
    ',', CASE WHEN event_id % 3 = 0 THEN '"longitude":' ELSE '"lon":' END, '15.', lpad(CAST(event_id * 17 % 1000 AS STRING), 3, '0'),
    CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"avg_climb":', CAST(event_id % 4 AS STRING), '.', CAST(event_id % 2 * 5 AS STRING)) END,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"vario":', CAST(1 + event_id % 3 AS STRING), '.25') END,
    CASE WHEN event_id % 6 = 0 THEN '' ELSE concat(',"altitude":', CAST(event_id % 3 * 700 AS STRING)) END,
    CASE WHEN event_id % 8 = 0 THEN '' ELSE concat(',"date":"2024-06-', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '"') END,
    '}') AS json
FROM events
""",
    "weather_json": """
SELECT event_id AS doc,
  concat('{"hourly":{"time":["2024-06-01T', lpad(CAST(event_id % 23 AS STRING), 2, '0'), ':00","2024-06-01T', lpad(CAST(event_id % 23 + 1 AS STRING), 2, '0'), ':00"],',
    '"temperature_2m":[', CAST(10 + event_id % 17 AS STRING), '.5,null],"relativehumidity_2m":[', CAST(30 + event_id % 60 AS STRING), ',55],',
    '"windspeed_10m":[', CAST(event_id % 25 AS STRING), ',7],"winddirection_10m":[', CAST(event_id % 360 AS STRING), ',180],',
    '"cape":[', CAST(event_id % 1500 AS STRING), ',800],"convective_inhibition":[-', CAST(event_id % 200 AS STRING), ',-10],',
    '"shortwave_radiation":[', CAST(event_id % 900 AS STRING), ',450],"temperature_850hPa":[', CAST(event_id % 15 AS STRING), ',4],',
    '"temperature_500hPa":[-', CAST(10 + event_id % 15 AS STRING), ',-15],"boundary_layer_height":[', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(400 + event_id % 1800 AS STRING) END, ',1000],',
    '"soil_temperature_0_to_7cm":[', CAST(8 + event_id % 20 AS STRING), ',15]}}') AS json
FROM events
""",
}

TABLES = ("events", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A derived view as a DataFrame over the parquet tables in ``sf_dir``, read as a stream if asked for."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    frames = {}
    for table in TABLES:
        if f"FROM {table}" in text:
            path = f"{sf_dir}/{table}.parquet"
            stored = spark.read.parquet(path)
            # A pattern, since a stream takes no single file by name.
            pattern = f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet"
            frames[table] = spark.readStream.schema(stored.schema).parquet(pattern) if stream else stored
            text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **frames)


def with_views(names, body: str) -> str:
    """DuckDB SQL with the named views as leading common table expressions."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body else ""
    rest = body.strip()
    for prefix in ("WITH RECURSIVE", "WITH"):
        if rest.startswith(prefix):
            return f"WITH {recursive}{ctes}, {rest[len(prefix):].lstrip()}"
    return f"WITH {ctes} {rest}"
