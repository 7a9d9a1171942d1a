"""Terrain, prior, metrics, splits and gate rules."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions import atmosphere as A
from updraft.functions.rules import terrain_multiplier
from updraft.functions.solar import cos_incidence, sun_position
from updraft.operators import forest, landcover, metrics, montecarlo, prior, splits
from updraft.operators import terrain as TR
from updraft.plans import evaluation, training
from updraft.schema import SAMPLES
from updraft.sources import store

T0 = datetime(2024, 8, 14, 12, tzinfo=timezone.utc)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_linear_field_is_reproduced(spark):
    lattice = spark.createDataFrame(
        [(i, j, float(1000 * i + 7 * j)) for i in range(4590, 4612) for j in range(1490, 1512)],
        "lat_i long, lon_j long, elevation double")
    requests = spark.createDataFrame([(1, 46.004, 14.997)], "request_id int, lat double, lon double")
    cells = TR.upsample(requests, lattice)
    assert cells.count() == 201 * 201
    off = cells.filter(F.abs(F.col("elevation") - (F.col("lat") * 100000 + F.col("lon") * 700)) > 1e-3)
    assert off.count() == 0
    ends = cells.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert list(ends) == pytest.approx([45.95, 46.05, 14.95, 15.05])


def test_grid_paths_agree(spark):
    rng = random.Random(2)
    lattice = spark.createDataFrame(
        [(i, j, float(rng.randrange(200, 900))) for i in range(4590, 4612) for j in range(1490, 1512)],
        "lat_i long, lon_j long, elevation double")
    requests = spark.createDataFrame([(1, 46.0, 15.0)], "request_id int, lat double, lon double")
    fused = TR.upsample(requests, lattice)
    plain = TR.with_slope_aspect(fused.drop("slope", "aspect"), ["request_id"], F.lit(46.0))
    both = fused.alias("a").join(plain.alias("b"), ["request_id", "row", "col"])
    assert both.filter((F.abs(F.col("a.slope") - F.col("b.slope")) > 1e-6)
                       | (F.abs(F.sin(F.radians(F.col("a.aspect") - F.col("b.aspect")))) * F.col("a.slope") > 1e-5)).count() == 0
    mean = TR.with_windows(TR.with_centre(requests), lattice).select(TR.window_mean(F.col("elevation_window")).alias("m"))
    assert mean.first()["m"] == pytest.approx(fused.agg(F.avg("elevation")).first()[0])


def test_aspect_faces_downhill(spark):
    for north, east, expected in ((-1, 0, 0.0), (0, -1, 90.0), (1, 0, 180.0), (0, 1, 270.0), (0, 0, 180.0)):
        _, aspect = TR.tilt(F.lit(float(east)), F.lit(float(north)))
        assert value(spark, aspect) == pytest.approx(expected)


def test_sun(spark):
    elevation, azimuth = sun_position(F.lit(0.0), F.lit(0.0), F.lit(80), F.lit(12.0))
    assert value(spark, elevation) > 85
    elevation, azimuth = sun_position(F.lit(51.5), F.lit(0.0), F.lit(172), F.lit(12.0))
    assert value(spark, elevation) == pytest.approx(61.9, abs=1) and value(spark, azimuth) == pytest.approx(180, abs=2)
    assert value(spark, cos_incidence(F.lit(0.0), F.lit(0.0), F.lit(-5.0), F.lit(0.0))) == 0.0
    assert value(spark, cos_incidence(F.lit(30.0), F.lit(180.0), F.lit(60.0), F.lit(180.0))) == pytest.approx(1.0)


def test_weather_formulas(spark):
    assert value(spark, A.thermal_base(F.lit(20.0), F.lit(5.0))) == 1200
    assert value(spark, A.thermal_base(F.lit(5.0), F.lit(5.0))) == 0
    u, v = A.wind_components(F.lit(10.0), F.lit(270.0))
    assert value(spark, u) == pytest.approx(10.0) and value(spark, v) == pytest.approx(0.0, abs=1e-9)


def test_landcover_mixture(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 10), ("a", 0, 0, 60)], "area string, row int, col int, class int")
    cells = {(r["row"], r["col"]): r["land_use_heat"] for r in landcover.block_average(pixels, ["area"], 1, 2).collect()}
    assert cells == {(0, 0): pytest.approx(0.55), (0, 1): 0.0}


def beacons(spark, rows):
    data = [(T0 + timedelta(hours=h), 46.005, 15.0 + 0.01 * cell + 0.005, 1, up, 2.0, False)
            for h, cell, up, n in rows for _ in range(n)]
    return spark.createDataFrame(data, "ts timestamp, lat double, lon double, ac_type int, circling boolean, vario double, under_tow boolean")


def prior_at(spark, history, cell, hours=0.0):
    index = prior.climb_index(history)
    at = spark.createDataFrame([(T0 + timedelta(hours=hours), 46.005, 15.0 + 0.01 * cell + 0.005)], "ts timestamp, lat double, lon double")
    return prior.with_prior(at, index).first()["prior"]


def test_prior_shrinkage_and_leak_guard(spark):
    rows = [(-30, 0, True, 90), (-30, 0, False, 10), (-30, 1, True, 10), (-30, 1, False, 890), (-30, 2, True, 1)]
    history = beacons(spark, rows)
    rate = 101 / 1001
    assert prior_at(spark, history, 0) == pytest.approx((90 + 50 * rate) / 150)
    assert prior_at(spark, history, 2) == pytest.approx((1 + 50 * rate) / 51)
    assert prior_at(spark, history, 9) == pytest.approx(rate)
    later = history.unionByName(beacons(spark, [(-24, 0, True, 500), (0, 0, True, 500)]))
    assert prior_at(spark, later, 0) == pytest.approx((90 + 50 * rate) / 150)
    assert prior_at(spark, later, 0, -20) is None


def brute_pairs(rows):
    out = {}
    for g in {r[0] for r in rows}:
        pos = [r[1] for r in rows if r[0] == g and r[2] == 1]
        neg = [r[1] for r in rows if r[0] == g and r[2] == 0]
        if pos and neg:
            out[g] = (sum((p > n) + 0.5 * (p == n) for p in pos for n in neg), len(pos) * len(neg))
    return out


def test_pairs_brute_force_and_example(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.choice([rng.random() - 0.5, 0.25, -3.0]), rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "gid long, s double, label int")
    got = {r["gid"]: (r["concordant"], r["pairs"]) for r in metrics.group_pairs(df, "s").collect()}
    assert got == brute_pairs(rows)
    small = spark.createDataFrame([(1, 0.0, 1), (1, 1.0, 0), (2, 1.0, 1), (2, 1.0, 1), (2, 0.0, 0), (2, 0.0, 0)], "gid long, s double, label int")
    auc = metrics.grouped_auc(metrics.group_pairs(small, "s")).first()
    assert (auc["micro"], auc["macro"], auc["groups"], auc["pairs"]) == (0.8, 0.5, 2, 5)


def test_no_mixed_groups(spark):
    pairs = metrics.group_pairs(spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 0)], "gid long, s double, label int"), "s")
    auc = metrics.grouped_auc(pairs).first()
    assert math.isnan(auc["micro"]) and auc["groups"] == 0 and auc["pairs"] == 0
    ci = metrics.bootstrap_ci(pairs, 20).first()
    assert math.isnan(ci["lo"]) and ci["groups"] == 0


def test_bootstrap_methods_agree_and_pairing(spark):
    rng = random.Random(6)
    rows = [(g, rng.random() + 0.3 * y, rng.random() + 0.9 * y, y) for g in range(60) for y in (0, 1) for _ in range(4)]
    df = spark.createDataFrame(rows, "gid long, a double, b double, label int")
    pa, pb = metrics.group_pairs(df, "a").cache(), metrics.group_pairs(df, "b").cache()
    index, poisson = (metrics.bootstrap_ci(pa, 800, method=m).first() for m in ("index", "poisson"))
    assert index["lo"] < index["point"] < index["hi"]
    assert index["lo"] == pytest.approx(poisson["lo"], abs=0.02) and index["hi"] == pytest.approx(poisson["hi"], abs=0.02)
    better = metrics.paired_delta_ci(pa, pb, 300).first()
    assert better["lo"] > 0 and better["groups"] == 60
    same = metrics.paired_delta_ci(pa, pa, 100).first()
    assert (same["lo"], same["hi"]) == (0.0, 0.0)
    other = metrics.paired_delta_ci(pa, pb.filter("gid < 30"), 100).first()
    assert math.isnan(other["point"]) and other["groups"] == 0


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(4000).select((F.col("id") % 500).alias("gid"))
    sides = splits.with_split(df).groupBy("gid").agg(F.count_distinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0
    share = splits.with_split(df).filter("split = 'benchmark'").count() / 4000
    assert 0.12 < share < 0.28
    folds = splits.group_folds(df, 5).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {100}
    assert splits.group_folds(df, 5, seed=1).join(splits.group_folds(df, 5), ["gid", "fold"]).count() < 500


def test_gate_rules():
    d = training.decide
    assert not d(10, 0.7, True, 0.6, None, 0).accepted
    first = d(10, 0.7, False, None, None, 0)
    assert first.accepted and first.score is None
    assert not d(40, float("nan"), True, 0.6, None, 0).accepted
    assert d(40, 0.7, True, None, (-0.2, -0.3, -0.1), 0).accepted
    assert d(40, 0.7, True, 0.7, (-0.01, -0.05, 0.01), 3).skipped == 0
    worse = d(40, 0.6, True, 0.7, (-0.1, -0.2, -0.05), 3)
    assert not worse.accepted and worse.skipped == 4
    assert d(40, 0.6, True, 0.7, (-0.1, -0.2, -0.05), K.MAX_CONSECUTIVE_SKIPS - 1).accepted


def buffer_rows(spark, groups=60, per=12, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(per):
            slope = rng.random() * 30
            label = int(rng.random() < 1 / (1 + math.exp(-(slope - 15) / 3)))
            angle = 2 * math.pi * (g % 300 + 1) / 365
            f = dict.fromkeys(K.FEATURES, 0.5) | {
                "lat": 46.0 + g % 7, "lon": 15.0 + g % 11, "slope": slope, "aspect": 180.0, "elevation": 300.0,
                "doy_sin": math.sin(angle), "doy_cos": math.cos(angle)}
            rows.append((*[float(f[n]) for n in K.FEATURES], label, T0, g * per + i))
    return spark.createDataFrame(rows, SAMPLES)


def test_fit_gate_and_store(spark, tmp_path):
    rows = buffer_rows(spark, groups=260).cache()
    quick = training.FitConfig(rounds=4, depth=3)
    model, decision = training.fit_and_gate(rows, config=quick)
    assert decision.accepted and decision.groups >= K.MIN_BENCH_GROUPS and decision.score > 0.6
    path = str(tmp_path / "m")
    store.save_model(spark, model.model, path, model.bench_score)
    loaded = store.load_model(spark, path)
    assert loaded.bench_score == pytest.approx(decision.score)
    assert store.load_model(spark, path, K.FEATURES[:5]) is None and store.load_model(spark, path + "x") is None
    few, refused = training.fit_and_gate(rows.limit(50), loaded)
    assert few is loaded and refused.reason == "too few samples"
    assert store.newest_samples(rows, 10).agg(F.min("seq")).first()[0] == rows.count() - 10


def test_buffer_of_another_width_is_set_aside(spark, tmp_path):
    rows, path = buffer_rows(spark, groups=4).cache(), str(tmp_path / "buffer")
    assert store.read_buffer(spark, path) is None and store.set_aside(spark, path) == []
    store.append_buffer(rows, path)
    store.append_buffer(rows, path)
    assert store.read_buffer(spark, path).count() == 2 * rows.count()
    # The library now works with fewer features: the old rows stay where they are, new ones start a buffer.
    assert store.read_buffer(spark, path, features=K.FEATURES[:5]) is None
    store.append_buffer(rows.limit(7), path, K.FEATURES[:5])
    assert store.read_buffer(spark, path, features=K.FEATURES[:5]).count() == 7
    ((number, reason, folder),) = store.set_aside(spark, path)
    assert number == 0 and "22 features" in reason and spark.read.parquet(folder).count() == 2 * rows.count()


def test_damaged_buffer_is_set_aside(spark, tmp_path):
    rows, path = buffer_rows(spark, groups=2).cache(), str(tmp_path / "buffer")
    store.append_buffer(rows, path)
    for file in (tmp_path / "buffer" / "data-0").rglob("*.parquet"):
        file.write_bytes(b"not a table")
    for crc in (tmp_path / "buffer" / "data-0").rglob("*.crc"):
        crc.unlink()
    store.append_buffer(rows, path)
    assert store.read_buffer(spark, path).count() == rows.count()
    assert [(n, r.split(":")[0]) for n, r, _ in store.set_aside(spark, path)] == [(0, "unreadable")]


def test_stop_between_model_and_score_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    rows, path = buffer_rows(spark, groups=6).cache(), str(tmp_path / "m")
    small, other = (training.fit(rows, config=training.FitConfig(rounds=n, depth=1)) for n in (1, 2))
    store.save_model(spark, small, path, 0.5)

    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            store.save_model(spark, other, path, 0.9)
    kept = store.load_model(spark, path)
    assert kept.bench_score == 0.5 and kept.model.stages[-1].getNumTrees == 1
    for score in (0.6, 0.7, 0.8):
        store.save_model(spark, other, path, score)
    newest = store.load_model(spark, path)
    assert newest.bench_score == 0.8 and newest.model.stages[-1].getNumTrees == 2
    assert sorted(p.name for p in (tmp_path / "m").glob("model-*")) == ["model-2", "model-3"]


def test_noise_is_seeded_and_normal(spark):
    draws = spark.range(200).select(F.explode(montecarlo.noise_draws(F.col("id"), 20)).alias("d"))
    stats = draws.agg(F.avg("d.cape"), F.stddev("d.cape")).first()
    assert stats[0] == pytest.approx(0, abs=0.02) and stats[1] == pytest.approx(0.15, abs=0.01)


@pytest.fixture(scope="module")
def small_model(spark):
    """A model whose labels depend on slope (a cell's own column) and cape (a noisy one)."""
    rng = random.Random(8)
    rows = []
    for n in range(600):
        f = {c: rng.random() for c in K.FEATURES} | {
            "slope": 30 * rng.random(), "cape": 1500 * rng.random(), "aspect": 360 * rng.random(), "elevation": 900 * rng.random()}
        chance = 1 / (1 + math.exp(-(f["slope"] - 15) / 4 - (f["cape"] - 700) / 300))
        rows.append((*[float(f[c]) for c in K.FEATURES], int(rng.random() < chance), T0, n))
    samples = spark.createDataFrame(rows, SAMPLES).withColumn("gid", F.col("seq") % 12).cache()
    return samples, training.fit(samples, config=training.FitConfig(rounds=8, depth=3))


def test_forest_scores_like_the_model(spark, small_model):
    samples, model = small_model
    trees = forest.forest_of(model)
    theirs = training.raw_score(samples, model).select("seq", F.col("score").alias("theirs"))
    both = forest.scored(samples, trees).join(theirs, "seq").select("score", "theirs").collect()
    assert len(trees.trees) == 8 and all(r[0] == pytest.approx(r[1], abs=1e-12) for r in both)
    for rounds in (1, 5):
        shorter = training.raw_score(samples, training.cut(model, rounds)).select("seq", F.col("score").alias("theirs"))
        both = forest.scored(samples, trees.first(rounds)).join(shorter, "seq").select("score", "theirs").collect()
        assert all(r[0] == pytest.approx(r[1], abs=1e-12) for r in both)


def test_early_stop_equals_a_loop_over_rounds(spark, small_model):
    samples, model = small_model
    train, held = samples.filter("gid < 9").cache(), samples.filter("gid >= 9").cache()
    config = training.FitConfig(rounds=12, depth=2, patience=2)
    whole = training.fit(train, config=config)
    short = training.fit(train, config=training.FitConfig(rounds=5, depth=2))
    assert forest.forest_of(whole).first(5) == forest.forest_of(short)     # longer fits begin with shorter ones
    scores = []
    for n in range(1, 13):
        rows = training.raw_score(held, training.cut(whole, n)).select("gid", "score", "label").collect()
        won = brute_pairs([tuple(r) for r in rows]).values()
        scores.append(sum(c for c, _ in won) / sum(t for _, t in won))
    staged = training.staged_scores(held, whole)
    assert [n for n, _ in staged] == list(range(1, 13)) and [s for _, s in staged] == pytest.approx(scores)
    best = 0
    for n in range(1, 12):
        if scores[n] > scores[best]:
            best = n
        elif n - best >= 2:
            break
    assert training.fit(train, config=config, early_stop=held).stages[-1].getNumTrees == best + 1
    assert training.best_round([], 2) == (None, False)
    assert training.best_round([(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.6), (5, 0.9)], 2) == (2, True)
    one_label = held.withColumn("label", F.lit(1))
    assert training.fit(train, config=training.FitConfig(rounds=3, depth=1), early_stop=one_label).stages[-1].getNumTrees == 3


def test_uncertainty_equals_a_row_per_draw(spark, small_model):
    samples, model = small_model
    weather = samples.limit(3).select(F.col("seq").alias("request_id"), *forest.NOISY)
    cells = samples.limit(40).select("seq", *[c for c in K.FEATURES if c not in forest.NOISY]).withColumn(
        "request_id", F.col("seq") % 3)
    for trees in (forest.forest_of(model), forest.Forest((0.25,)), forest.Forest((
            forest.Split("cape", 700.0, forest.Split("slope", 9.0, 0.1, forest.Split("cin", 0.5, 0.3, -0.2)), 0.4),
            forest.Split("slope", 20.0, 0.0, forest.Split("cape", 500.0, -0.5, 0.5))))):
        got = {r["seq"]: (r["p_mean"], r["p_std"]) for r in forest.Uncertainty(trees, draws=7, seed=3).spread(
            cells, weather, ["request_id", "seq"]).collect()}
        drawn = cells.join(weather, "request_id").withColumn(
            "d", F.explode(montecarlo.noise_draws(F.col("request_id"), 7, 3)))
        moved = drawn.select("seq", *[c for c in K.FEATURES if c not in forest.NOISY], *[
            montecarlo.perturbed(c, F.col(c), F.col("d")).alias(c) for c in forest.NOISY])
        served = forest.scored(moved, trees).withColumn("score", F.col("score") * terrain_multiplier())
        want = served.groupBy("seq").agg(F.least(F.avg("score"), F.lit(1.0)), F.stddev_pop("score")).collect()
        assert len(got) == len(want) == 40
        assert all(got[r[0]] == (pytest.approx(r[1], abs=1e-9), pytest.approx(r[2], abs=1e-7)) for r in want)


def test_folds_never_see_their_groups(spark, small_model):
    samples, _ = small_model
    located = samples.drop("gid").withColumns({"lat": 46.0 + F.col("seq") % 6, "doy_sin": F.lit(0.5), "doy_cos": F.lit(0.5)})
    quick = training.FitConfig(rounds=2, depth=1)
    rows = evaluation.out_of_fold(located, evaluation.VARIANTS["base"], k=3, config=quick)
    assert rows.count() == rows.select("seq").distinct().count() == 600
    assert rows.groupBy("gid").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    report, verdicts = evaluation.compare(located, ("base", "solar"), mode="cv", k=3, draws=50, config=quick)
    assert {r["ranker"] for r in report.collect()} >= {"constant", "base (raw)", "solar (served)"}
    (row,) = verdicts.collect()
    assert (row["a"], row["b"]) == ("base", "solar") and row["verdict"] == evaluation.verdict(row["lo"], row["hi"], "base", "solar")


def test_notebook_report_and_importance(spark, small_model):
    samples, model = small_model
    quick = training.FitConfig(rounds=3, depth=2)
    folds, classes = evaluation.stratified_report(samples, config=quick, k=3)
    row = folds.first()
    assert row["folds"] == 3 and row["mean"] > 0.6 and 0 <= row["sd"] < 0.2
    assert sum(r["support"] for r in classes.collect()) == 600
    assert {n for n, _ in training.feature_importance(model, K.FEATURES)[:2]} == {"slope", "cape"}


def test_incumbent_is_replaced_only_when_not_reliably_worse(spark):
    rows = buffer_rows(spark, groups=260, per=8).cache()
    quick = training.FitConfig(rounds=2, depth=2, patience=1)
    good = store.StoredModel(training.fit(rows, config=quick), 0.9, K.FEATURES)
    flipped = rows.withColumn("label", 1 - F.col("label"))
    bad = training.fit(flipped, config=quick)
    kept, refused = training.fit_and_gate(rows.withColumn("slope", F.lit(1.0)), good, 0, quick, 200)
    assert refused.delta is not None and kept is (good if not refused.accepted else kept)
    replaced, accepted = training.fit_and_gate(rows, store.StoredModel(bad, 0.1, K.FEATURES), 3, quick, 200)
    assert accepted.accepted and accepted.skipped == 0 and accepted.delta[1] > 0 and replaced.model is not bad
