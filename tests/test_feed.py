"""Feed, live and track operators on small cases and against brute force."""

import math
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from updraft.functions.rules import is_evidence
from updraft.operators import live as L
from updraft.operators.blocks import number_block, with_row_number, with_running, with_shifted
from updraft.operators.clusters import cluster_members
from updraft.operators.terrain import with_agl
from updraft.operators.tow import flag_under_tow, tug_intervals
from updraft.operators import tracks
from updraft.operators.tracks import thin
from updraft.sources import beacons as B
from updraft.sources.flights import read_flight_logs, read_igc

LINE = "ICA4B07C2>APRS,qAS,TESTRX:/083015h4637.81N/00741.35E'274/052/A=005810 id054B07C2 +312fpm -1.4rot 11.0dB 0e"
T0 = datetime(2024, 6, 21, 8, tzinfo=timezone.utc)


def parse(spark, *lines):
    return B.parse_beacons(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def test_parse_fields(spark):
    (row,) = parse(spark, LINE)
    assert row["id"] == "ICA4B07C2" and row["ac_type_name"] == "glider" and not row["is_tow"]
    assert row["lat"] == pytest.approx(46 + 37.81 / 60, abs=1e-4)
    assert row["lon"] == pytest.approx(7 + 41.35 / 60, abs=1e-4)
    assert row["alt"] == round(5810 * 0.3048) and row["speed_kmh"] == round(52 * 1.852) and row["heading"] == 274
    assert row["vario"] == pytest.approx(312 * 0.00508, abs=0.006)
    assert not row["circling"] and row["under_tow"] is None      # not judged yet


def test_parse_rejects(spark):
    no_id, no_place = LINE.replace(" id054B07C2", ""), LINE.replace("4637.81N", "46xx.81N")
    assert parse(spark, no_id, no_place, "", "# server says hello", "X>Y:>on the ground", "no colon here") == []


@pytest.mark.parametrize("ac_type,admitted", [(t, t in (1, 2, 6, 7)) for t in range(16)])
def test_parse_admits_only_known_types(spark, ac_type, admitted):
    flags = f"{ac_type * 4 + 1:02X}"
    rows = parse(spark, LINE.replace("id054B07C2", f"id{flags}4B07C2"))
    assert [r["ac_type"] for r in rows] == ([ac_type] if admitted else [])


def test_parse_course_zero_and_turn(spark):
    (row,) = parse(spark, LINE.replace("'274/", "'000/").replace("-1.4rot", "+3.1rot"))
    assert row["heading"] is None and row["circling"]


def test_place_in_the_feed_is_the_start_of_the_run(spark):
    """A is heard every minute, B joins later; a silence of 300 s puts C at the end."""
    heard = [(0, "A"), (0, "C")] + [(60 * k, "A") for k in range(1, 11)] + [(301, "B"), (590, "C")]
    heard.sort()
    rows = [(n, i, T0 + timedelta(seconds=s)) for n, (s, i) in enumerate(heard)]
    df = spark.createDataFrame(rows, "seq long, id string, ts timestamp")
    out = L.live_state(df, T0 + timedelta(seconds=600)).orderBy("first_seen").collect()
    assert [r["id"] for r in out] == ["A", "B", "C"]


def test_tow_order_is_the_feed(spark):
    """A late report does not break a tug's next beacon."""
    rows = [(1, "T", T0), (2, "T", T0 + timedelta(seconds=1000)), (3, "T", T0 + timedelta(seconds=100))]
    df = spark.createDataFrame([(s, i, t, 46.0, 15.0, 900, 2.0, 2) for s, i, t in rows],
                               "seq long, id string, ts timestamp, lat double, lon double, alt long, vario double, ac_type int")
    assert {r["seq"]: r["next_seq"] for r in tug_intervals(df).collect()} == {1: 2, 2: 3, 3: None}


def test_bounds():
    good = {"lat_min": "46", "lat_max": 47, "lon_min": 170, "lon_max": 190}
    assert L.parse_bounds(good) == (46.0, 47.0, 170.0, 190.0)
    for bad in (None, [], {**good, "lat_min": "x"}, {**good, "lat_min": 48}, {**good, "lon_max": 600}):
        assert L.parse_bounds(bad) is None
    assert L.pad_bounds((0, 4, 0, 8)) == (-1.0, 5.0, -2.0, 10.0)


def test_viewport_across_date_line(spark):
    df = spark.createDataFrame([("a", 46.5, -179.5), ("b", 46.5, 179.0), ("c", 46.5, 100.0)], "id string, lat double, lon double")
    shown = L.in_viewport(df, (46.0, 47.0, 178.0, 182.0))
    assert sorted(r["id"] for r in shown.collect()) == ["a", "b"]


def test_search_prefix_first_and_limits(spark):
    df = spark.createDataFrame([("XFLR",), ("FLR2",), ("FLR1",), ("abc",)], "id string")
    assert [r["id"] for r in L.search_ids(df, " flr ", 5).collect()] == ["FLR1", "FLR2", "XFLR"]
    assert L.search_ids(df, "  ").count() == 0 and L.search_ids(df, "flr", -3).count() == 0


def test_agl_two_resolutions(spark):
    known = spark.createDataFrame([(398100, 305200, 800), (398123, 305187, 850)], "lat_e4 long, lon_e4 long, elevation int")
    rows = spark.createDataFrame(
        [("slow", 1, 39.8123, 30.5187, 900, 20), ("fast", 2, 39.8123, 30.5187, 900, 90),
         ("high", 3, 39.8123, 30.5187, 2000, 20), ("far", 4, 10.0, 10.0, 500, 20)],
        "id string, seq long, lat double, lon double, alt int, speed_kmh int")
    agl = {r["id"]: r["agl"] for r in with_agl(rows, known).collect()}
    assert agl == {"slow": 50, "fast": 100, "high": 1200, "far": None}


def tow_rows(**over):
    tug = {"id": "T", "ac_type": 2, "lat": 51.0010, "lon": -1.0, "alt": 520, "vario": 2.0, "t": 0, **over}
    glider = {"id": "G", "ac_type": 1, "lat": 51.0, "lon": -1.0, "alt": 500, "vario": 2.0, "t": 5}
    return [tug, glider]


def flagged(spark, rows):
    data = [(r["id"], r["ac_type"], r["lat"], r["lon"], r["alt"], r["vario"], T0 + timedelta(seconds=r["t"]), i)
            for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, ac_type int, lat double, lon double, alt int, vario double, ts timestamp, seq long")
    return {r["seq"]: r["under_tow"] for r in flag_under_tow(df).collect()}


@pytest.mark.parametrize("over,expected", [
    ({}, True), ({"vario": 0.1}, False), ({"alt": 700}, False), ({"lat": 51.01}, False),
    ({"t": -11}, False), ({"t": -10}, True), ({"ac_type": 1}, False)])
def test_tow_geometry(spark, over, expected):
    assert flagged(spark, tow_rows(**over))[1] is expected


def test_tow_latest_report_decides(spark):
    rows = tow_rows()
    rows.insert(1, {**rows[0], "vario": -1.0, "t": 3})
    assert flagged(spark, rows)[2] is False


def distance(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(x))


def test_tow_brute_force_near_date_line(spark):
    rng = random.Random(3)
    rows = [{"id": f"{'T' if tug else 'G'}{rng.randrange(6)}", "ac_type": 2 if tug else 1,
             "lat": 60 + rng.random() * 0.02, "lon": ((180 + (rng.random() - 0.5) * 0.03 + 180) % 360) - 180,
             "alt": rng.randrange(400, 700), "vario": rng.uniform(-1, 3), "t": i // 2}
            for i in range(400) for tug in [rng.random() < 0.4]]
    expected, last = {}, {}
    for i, r in enumerate(rows):
        expected[i] = r["ac_type"] == 1 and any(
            r["t"] - o["t"] <= 15 and o["vario"] >= 0.3 and abs(o["alt"] - r["alt"]) <= 100 and distance(r, o) <= 400
            for o in last.values())
        if r["ac_type"] == 2:
            last[r["id"]] = r
    assert any(expected.values())
    assert flagged(spark, rows) == expected


def greedy(points, radius=0.012):
    left, out = list(points), {}
    while left:
        seed, rest = left[0], []
        for p in left:
            near = abs(p[1] - seed[1]) < radius and abs(p[2] - seed[2]) < radius
            (out.__setitem__(p[0], seed[0]) if near else rest.append(p))
        left = rest
    return out


@pytest.mark.parametrize("seed,spread", [(1, 0.05), (2, 0.3), (3, 0.011)])
def test_clusters_brute_force(spark, seed, spread):
    rng = random.Random(seed)
    points = [(i, 46 + rng.random() * spread, 15 + rng.random() * spread) for i in range(150)]
    df = spark.createDataFrame([(*p, 900, 2.0) for p in points], "ord long, lat double, lon double, alt int, vario double")
    found = {r["ord"]: r["seed"] for r in cluster_members(df, [], "ord").collect()}
    assert found == greedy(points)


@pytest.mark.parametrize("seed", [1, 2])
def test_thin_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for key in "abc":
        t = 0
        for _ in range(200):
            t += rng.choice([0, 1, 3, 7, 40, -20, 900])
            rows.append((key, seq, T0 + timedelta(seconds=t)))
            seq += 1
    kept, last = [], {}
    for key, n, t in rows:
        if key in last and (t - last[key]).total_seconds() < 30:
            continue
        kept.append(n)
        last[key] = t
    df = spark.createDataFrame(rows, "k string, seq long, ts timestamp")
    got = thin(df, ["k"], "ts", ["seq"], number_block("seq", 32), block_s=60)
    assert sorted(r["seq"] for r in got.collect()) == kept


@pytest.mark.parametrize("fanin", [2, 16])
def test_thin_with_a_hot_cell_and_microseconds(spark, monkeypatch, fanin):
    """One cell holds a third of all rows, at several rows a second over a few hours, then a long silence."""
    monkeypatch.setattr(tracks, "FANIN", fanin)
    rng = random.Random(11)
    rows, us = [], 0
    for n in range(6000):
        us += rng.choice([100, 9_999, 400_000, 2_000_000, 30_000_000]) if n % 3 else rng.randrange(10 ** 6)
        us += 86_400_000_000 * (n == 5000)
        cell = "hot" if n % 3 == 0 else f"c{rng.randrange(40)}"
        rows.append((cell, n, T0 + timedelta(microseconds=us)))
    kept, last = [], {}
    for cell, n, t in rows:
        if cell not in last or t - last[cell] >= timedelta(seconds=30):
            kept.append(n)
            last[cell] = t
    df = spark.createDataFrame(rows, "k string, seq long, ts timestamp")
    for block_s in (30, 600):
        got = thin(df, ["k"], "ts", ["seq"], number_block("seq", 512), block_s=block_s)
        assert sorted(r["seq"] for r in got.collect()) == kept
    assert thin(df.limit(0), ["k"], "ts", ["seq"], number_block("seq", 512)).collect() == []


def test_block_windows_equal_plain_windows(spark):
    from pyspark.sql import Window

    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("ab"), i, rng.choice([None, rng.randrange(9)])) for i in range(300)],
                               "k string, n long, v int")
    block = number_block("n", 7)
    w = Window.partitionBy("k").orderBy("n")
    expected = df.select("k", "n", F.lag("v", 2).over(w).alias("p"), F.lead("v", 1).over(w).alias("q"),
                         F.sum("v").over(w).alias("s"), F.last("v", True).over(w).alias("l"), F.max("v").over(w).alias("m"))
    mine = with_shifted(df, ["k"], ["n"], block, {"p": (F.col("v"), 2), "q": (F.col("v"), -1)})
    mine = with_running(mine, ["k"], ["n"], block, {
        "s": ("sum", F.col("v")), "l": ("last", F.col("v")), "m": ("max", F.col("v"))})
    assert sorted(map(str, mine.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    numbered = with_row_number(df, ["n"], block, "r").select("n", "r").collect()
    assert all(r["r"] == r["n"] + 1 for r in numbered)


def test_history_roundtrip_and_purge(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [("a", T0 - timedelta(hours=h), 46.0, 15.0 + h / 100, 900) for h in range(0, 96, 8)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, lat double, lon double, alt int")
    B.append_beacons(df, path)
    since = T0 - timedelta(hours=30)
    assert B.read_beacons(spark, path, since=since).count() == sum(r[1] >= since for r in rows)
    assert B.read_beacons(spark, path, box=(45.0, 47.0, 15.0, 15.2)).count() == 3
    cut = T0 - timedelta(days=2)
    assert B.purge_history(spark, path, T0) == sum(r[1] < cut for r in rows)
    assert B.read_beacons(spark, path).count() == sum(r[1] >= cut for r in rows)
    assert B.purge_history(spark, path, T0) == 0
    # A purge stopped between its renames is completed by the next one.
    day = (T0 - timedelta(days=1)).date().isoformat()
    left = B.read_beacons(spark, path).count()
    spark.read.parquet(f"{path}/date={day}").write.parquet(f"{path}/.staged-{day}")
    os.rename(f"{path}/date={day}", f"{path}/.expired-{day}")
    assert B.purge_history(spark, path, T0) == 0
    assert B.read_beacons(spark, path).count() == left and not os.path.exists(f"{path}/.expired-{day}")
    assert B.window_days(None) == 2.0 and B.window_days(7) == 2.0 and B.window_days(1) == 1


def test_flight_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = "B1000004601000N01502000EA0090000800"
    (tmp_path / "one.igc").write_text(f"AXXX\n{good}\nHFDTE210624\n{good}\nB100004460100XN01502000EA0090000800\nB1000084601000S01502000WA0090000820\n")
    (tmp_path / "sub" / "two.IGC").write_text(f"HFDTEDATE:210695\n{good}\n")
    (tmp_path / "log.csv").write_text("lat,lon,gps_alt,vario\n46.5,15.5,900,2.5\n")
    fixes = read_igc(spark, str(tmp_path)).orderBy("time").collect()
    assert [f["time"].year for f in fixes] == [1995, 2024, 2024]
    assert fixes[2]["lat"] == pytest.approx(-(46 + 1 / 60)) and fixes[2]["lon"] < 0 and fixes[2]["alt"] == 820
    logs = read_flight_logs(spark, str(tmp_path))
    assert logs.count() == 4 and logs.filter("vario = 2.5 AND hh IS NULL").count() == 1


def test_live_evidence_and_history_evidence_differ(spark):
    df = spark.createDataFrame([(1, None), (1, False), (1, True), (2, False), (None, False)], "ac_type int, under_tow boolean")
    assert df.filter(is_evidence(False)).count() == 2 and df.filter(is_evidence(True)).count() == 1
