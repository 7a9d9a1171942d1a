"""Streaming forms against their batch results."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from checks.registry import prepared
from checks.views import view
from updraft.operators import live as L
from updraft.operators.prior import climb_index
from updraft.operators.tow import flag_under_tow
from updraft.plans import training
from updraft.sources import store
from updraft.sources.beacons import parse_beacons, purge_history, read_beacons
from updraft.streaming import feed as S
from updraft.streaming import livetable as LT

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 6, 21, 8, tzinfo=timezone.utc)


def source(spark, tmp_path, df, parts=4):
    """``df`` as ordered files and a stream over them, one file per batch."""
    path = str(tmp_path / "in")
    for i in range(parts):
        (df.filter(F.floor(F.col("seq") * parts / 1000) == i).coalesce(1)
         .write.mode("append").parquet(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def columns(spark):
    return prepared(spark, SF, "beacons").select(
        "seq", "id", "ts", "lat", "lon", "alt", "vario", "circling", "ac_type", "under_tow")


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_parse_and_append(spark, tmp_path):
    lines = view(spark, SF, "aprs_lines").cache()
    text = str(tmp_path / "text")
    lines.select("value").coalesce(2).write.text(text)
    stream = S.parsed_stream(spark.readStream.text(text))
    run(S.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == parse_beacons(lines).count()


def cut_source(spark, folder, df, cuts):
    """``df`` as files cut at the given feed numbers and a stream over them, one file per batch."""
    for low, high in zip([-1, *cuts], [*cuts, 1 << 60]):
        df.filter((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)     # files are read in the order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [0])
def test_tow_over_random_batches_equals_batch(spark, tmp_path, seed):
    rows = columns(spark).drop("under_tow")
    cuts = sorted(random.Random(seed).sample(range(1000), 4))
    out = str(tmp_path / "out")
    query = S.run_batches(cut_source(spark, str(tmp_path / "in"), rows, cuts), S.tow_batch(out), str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {(r["seq"], r["under_tow"]) for r in spark.read.parquet(out).select("seq", "under_tow").collect()}
    want = {(r["seq"], r["under_tow"]) for r in flag_under_tow(rows).select("seq", "under_tow").collect()}
    assert got == want and any(t for _, t in want)
    # Two states are left, whatever the number of batches; a replay changes nothing.
    assert sorted(p.name for p in (tmp_path / "out.tugs").iterdir()) == ["3", "4"]
    last = rows.filter(F.col("seq") > cuts[-1])
    S.tow_batch(out)(last, 4)
    assert spark.read.parquet(out).count() == rows.count()
    # The history's readers take the stream's layout.
    newest = rows.agg(F.max("ts")).first()[0]
    assert read_beacons(spark, out, since=newest - timedelta(days=1)).count() > 0
    before = read_beacons(spark, out).count()
    gone = purge_history(spark, out, newest, days=0.01)
    assert 0 < gone < before and read_beacons(spark, out).count() == before - gone


def feed_with_silences(seed):
    """Reports of five aircraft with silences beyond the time to live, equal times and late rows."""
    rng = random.Random(seed)
    rows, t = [], 0
    for n in range(240):
        t += rng.choice([0, 1, 5, 60, 200, 700]) if rng.random() < 0.3 else 2
        late = rng.choice([0, 0, 0, 20, 250])
        rows.append((n, rng.choice("ABCDE"), T0 + timedelta(seconds=t - late, microseconds=rng.randrange(10 ** 6)),
                     46.0 + n, None if n % 3 else n))
    return rows


def live_rows(df):
    return sorted(df.select("id", "seq", "first_seen", "ts", "lat", "ac_type").collect())


@pytest.mark.parametrize("seed", [1])
def test_live_state_over_random_batches_equals_batch(spark, tmp_path, seed):
    rows = feed_with_silences(seed)
    schema = "seq long, id string, ts timestamp, lat double, ac_type int"
    checkpoint, folder, seen = str(tmp_path / "cp"), str(tmp_path / "in"), []
    cuts = sorted(random.Random(seed).sample(range(1, 240), 2))
    for high in [*cuts, 240]:
        low = len(seen)
        seen = rows[:high]
        part = spark.createDataFrame(rows[low:high], schema)
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        writer = LT.live_changes(stream).writeStream.format("noop").trigger(availableNow=True)
        query = LT.start_live(writer, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
        want = L.live_state(spark.createDataFrame(seen, schema), max(r[2] for r in seen))
        assert live_rows(LT.read_live(spark, checkpoint, part.schema)) == live_rows(want)
    # A batch whose commit is lost runs again from the state before it.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink(missing_ok=True)
    query = LT.start_live(writer, checkpoint)
    query.awaitTermination(120)
    assert query.exception() is None
    assert live_rows(LT.read_live(spark, checkpoint, part.schema)) == live_rows(want)


def test_changes_tell_who_leaves(spark, tmp_path):
    schema = "seq long, id string, ts timestamp, lat double"
    folder, changes = str(tmp_path / "in"), str(tmp_path / "changes")
    for n, (seconds, name) in enumerate([(0, "A"), (10, "B"), (3000, "B"), (3010, "B")]):
        row = spark.createDataFrame([(n, name, T0 + timedelta(seconds=seconds), 46.0)], schema)
        row.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(row.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(changes)

    query = LT.start_live(LT.live_changes(stream).writeStream.foreachBatch(keep).trigger(availableNow=True),
                          str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(changes).orderBy("batch", "seq").select("id", "seq", "first_seen", "present").collect()
    assert [tuple(r) for r in got if r["present"]] == [("A", 0, 0, True), ("B", 1, 1, True), ("B", 2, 2, True), ("B", 3, 2, True)]
    assert [r["id"] for r in got if not r["present"]] == ["A"]


def test_rolling_retrain(spark, tmp_path):
    """Each batch stores its samples and refits; the newest model serves."""
    from tests.test_models import buffer_rows

    rows = buffer_rows(spark, groups=40).cache()
    folder, buffer, models, fits = str(tmp_path / "in"), str(tmp_path / "buffer"), str(tmp_path / "m"), []
    for low in (0, 240):
        rows.filter((F.col("seq") >= low) & (F.col("seq") < low + 240)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def retrain(session):
        stored = session.read.parquet(buffer)
        fits.append(stored.count())
        store.save_model(session, training.fit(stored, config=training.FitConfig(rounds=len(fits), depth=1)), models, None)

    query = S.run_batches(stream, S.retrain_batch(lambda batch, _: batch, buffer, retrain), str(tmp_path / "cp")).start()
    query.awaitTermination(240)
    assert query.exception() is None and fits == [240, 480]
    assert store.load_model(spark, models).model.stages[-1].getNumTrees == 2


def test_hourly_index(spark, tmp_path):
    rows = columns(spark).withColumn("ts", F.timestamp_seconds(F.lit(1718956800) + F.col("seq") * 60))
    end = rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1718956800 + 10 ** 6))).withColumns(
        {"seq": F.lit(999).cast("bigint"), "ac_type": F.lit(1), "under_tow": F.lit(False)})
    stream = source(spark, tmp_path, rows.unionByName(end))
    out = str(tmp_path / "out")
    run(S.hourly_climb_index(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = {tuple(r) for r in spark.read.parquet(out).select("hour", "lat_cell", "lon_cell", "climbs", "total").collect()}
    want = {tuple(r) for r in climb_index(rows).select("hour", "lat_cell", "lon_cell", "climbs", "total").collect()}
    assert got == want and len(got) > 10


def test_sessions_keep_exact_gap(spark, tmp_path):
    times = [0, 100, 400, 701, 5000]
    rows = spark.createDataFrame([(i * 200, "a", T0 + timedelta(seconds=t), 900) for i, t in enumerate(times)],
                                 "seq long, id string, ts timestamp, alt int")
    out = str(tmp_path / "out")
    run(S.track_sessions(source(spark, tmp_path, rows)).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = spark.read.parquet(out).orderBy("first_ts").collect()
    assert [r["beacons"] for r in got][:2] == [3, 1]


def test_frame_and_numbering(spark):
    rows = columns(spark)
    asof = rows.agg(F.max("ts")).first()[0]
    empty = spark.createDataFrame([], "lat_e4 long, lon_e4 long, elevation int")
    full = rows.withColumn("speed_kmh", F.lit(50))
    shown, new = S.live_frame(full, empty, asof, (46.0, 46.02, 14.0, 16.0), 900)
    ids = {r["id"] for r in shown.collect()}
    assert ids and {r["id"] for r in new.collect()} <= ids
    first, second = (S.numbered(rows.select("id"), b) for b in (0, 1))
    assert first.agg(F.max("seq")).first()[0] < second.agg(F.min("seq")).first()[0]
    assert first.select("seq").distinct().count() == rows.count()
