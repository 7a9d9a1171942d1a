"""Offline comparison of feature variants and simple rankers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.atmosphere import decode_timestamp
from updraft.functions.rules import physics_probability, terrain_multiplier
from updraft.functions.solar import solar_feature
from updraft.operators.landcover import with_landcover_at_point
from updraft.operators.metrics import classification_report, draw_sums, fold_report, group_pairs, paired_delta_ci
from updraft.operators.prior import index_statistics, with_prior
from updraft.operators.splits import on_side, stratified_folds, with_fold, with_group, with_split
from updraft.plans.training import NOTEBOOK_CONFIG, FitConfig, fit, in_parallel, raw_score
from updraft.session import durable


@dataclass(frozen=True)
class Layers:
    """Tables a variant may read beyond the stored feature rows."""

    index: DataFrame | None = None
    landcover: DataFrame | None = None
    year: int = 2024


@dataclass(frozen=True)
class Variant:
    """A feature set: how to derive it from stored rows, and its column names."""

    transform: Callable[[DataFrame, Layers], DataFrame]
    features: tuple[str, ...]


def with_solar(df: DataFrame) -> DataFrame:
    """Illumination column of stored feature rows."""
    return df.withColumn("cos_incidence", solar_feature())


def _prior(df: DataFrame, layers: Layers) -> DataFrame:
    timed = df.withColumn("__ts", decode_timestamp(
        "hour_sin", "hour_cos", "doy_sin", "doy_cos", layers.year))
    valued = with_prior(timed, layers.index, "__ts").drop("__ts")
    rate = index_statistics(layers.index).select("global_rate").scalar()
    return (valued.withColumn("prior_missing", F.col("prior").isNull().cast("double"))
            .withColumn("prior", F.coalesce(F.col("prior"), rate)))


def _landcover(df: DataFrame, layers: Layers) -> DataFrame:
    return with_landcover_at_point(df, layers.landcover)


PRIOR_FEATURES = (*K.FEATURES, "prior", "prior_missing")
VARIANTS: dict[str, Variant] = {
    "base": Variant(lambda df, layers: df, K.FEATURES),
    "solar": Variant(lambda df, layers: with_solar(df), (*K.FEATURES, "cos_incidence")),
    "landcover": Variant(_landcover, K.FEATURES),
    "prior": Variant(_prior, PRIOR_FEATURES),
    "both": Variant(lambda df, layers: _prior(_landcover(df, layers), layers), PRIOR_FEATURES),
}


def out_of_fold(samples: DataFrame, variant: Variant, layers: Layers = Layers(), k: int = 5,
                seed: int = 0, config: FitConfig = FitConfig()) -> DataFrame:
    """Every row scored by a model that never saw its group.

    The folds share one stored table with fold numbers and are fitted side by side. The
    early-stop slice comes from inside each training fold; it is skipped if it would
    hold all of the fold or none of it.
    """
    folded = durable(with_fold(variant.transform(with_group(samples), layers), k, seed).withColumn(
        "held", on_side("gid", K.EARLY_STOP_SALT)))

    def scored(fold: int) -> DataFrame:
        train, test = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        share = train.agg(F.count_if("held").alias("h"), F.count(F.lit(1)).alias("n")).first()
        if 0 < share["h"] < share["n"]:
            model = fit(train.filter(~F.col("held")), variant.features, config, train.filter("held"))
        else:
            model = fit(train, variant.features, config)
        return raw_score(test, model).drop("held")

    return reduce(DataFrame.unionByName, in_parallel(
        samples.sparkSession, [partial(scored, fold) for fold in range(k)]))


def held_out(samples: DataFrame, variant: Variant, layers: Layers = Layers(),
             config: FitConfig = FitConfig()) -> DataFrame:
    """Benchmark rows scored by a model fitted on the frozen training side."""
    split = durable(with_split(variant.transform(with_group(samples), layers)))
    model = fit(split.filter("split = 'train'"), variant.features, config,
                split.filter("split = 'earlystop'"))
    return raw_score(split.filter("split = 'benchmark'"), model)


def stratified_report(samples: DataFrame, features: Sequence[str] = K.NOTEBOOK_FEATURES,
                      config: FitConfig = NOTEBOOK_CONFIG, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The notebook's model: AUC over label-stratified folds, and precision and recall of all rows out of fold.

    Rows of one group may fall into several folds here, which flatters the score; the
    group-wise form is ``out_of_fold``.
    """
    folded = durable(stratified_folds(samples, k, seed))

    def scored(fold: int) -> DataFrame:
        model = fit(folded.filter(F.col("fold") != fold), features, config)
        return raw_score(folded.filter(F.col("fold") == fold), model)

    rows = durable(reduce(DataFrame.unionByName, in_parallel(
        samples.sparkSession, [partial(scored, fold) for fold in range(k)])))
    return fold_report(rows, "score"), classification_report(rows, "score")


def rankers_report(rankers: Sequence[tuple[str, DataFrame, str]],
                   draws: int = K.REPORT_DRAWS) -> DataFrame:
    """Pooled and mean score with its interval, one row per (name, rows, score column).

    All rankers are counted in one pass, and their intervals come from one set
    of resampled groups.
    """
    shift = 1 << 44
    long = reduce(DataFrame.unionByName, [
        rows.select("label", (F.col("gid") + F.lit(i * shift)).alias("gid"), F.col(score).alias("s"))
        for i, (_, rows, score) in enumerate(rankers)])
    which = F.floor(F.col("gid") / F.lit(shift)).cast("int")
    pairs = durable(group_pairs(long, "s").withColumn("r", which))
    count = range(len(rankers))
    wide = pairs.groupBy(F.pmod("gid", F.lit(shift)).alias("gid")).agg(*[
        F.max(F.when(F.col("r") == i, F.col(c))).alias(f"{c}{i}") for i in count for c in ("concordant", "pairs")])
    sums = draw_sums(wide, "gid", draws, 0, [f"{c}{i}" for i in count for c in ("concordant", "pairs")])
    bounds = F.array(F.lit(0.025), F.lit(0.975))
    intervals = sums.agg(*[
        F.percentile(F.col(f"concordant{i}") / F.col(f"pairs{i}"), bounds).alias(f"b{i}") for i in count])
    rows = intervals.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("r"), F.lit(name).alias("ranker"), F.get(F.col(f"b{i}"), F.lit(0)).alias("lo"),
        F.get(F.col(f"b{i}"), F.lit(1)).alias("hi")) for i, (name, _, _) in enumerate(rankers)])))
    scores = pairs.groupBy("r").agg(
        (F.sum("concordant") / F.sum("pairs")).alias("micro"),
        F.avg(F.col("concordant") / F.col("pairs")).alias("macro"),
        F.count(F.lit(1)).alias("groups"), F.sum("pairs").alias("pairs"))
    return rows.join(scores, "r").select("ranker", "micro", "macro", "lo", "hi", "groups", "pairs")


def baseline_scores(rows: DataFrame) -> DataFrame:
    """Feature rows with the scores of rankers that need no model."""
    return rows.select(
        "*", F.lit(0.5).alias("constant"), terrain_multiplier().alias("terrain"),
        physics_probability().alias("physics"), solar_feature().alias("incidence"))


def verdict(lo: float, hi: float, a: str, b: str) -> str:
    """Which of two variants a paired interval favours."""
    return f"{b} better" if lo > 0 else f"{a} better" if hi < 0 else "inconclusive"


def compare(samples: DataFrame, variants: Sequence[str] = tuple(VARIANTS), layers: Layers = Layers(),
            mode: str = "cv", k: int = 5, draws: int = K.REPORT_DRAWS,
            config: FitConfig = FitConfig()) -> tuple[DataFrame, DataFrame | None]:
    """Report of all rankers, and each variant against the first one.

    ``mode="cv"`` scores every row out of fold; ``"holdout"`` uses the frozen benchmark.
    The second table has (a, b, point, lo, hi, groups, verdict), one row per other
    variant; it is None with a single variant. Variants are fitted side by side.
    """
    samples = durable(samples)

    def scored(name: str) -> DataFrame:
        variant = VARIANTS[name]
        rows = (out_of_fold(samples, variant, layers, k, config=config) if mode == "cv"
                else held_out(samples, variant, layers, config))
        # Each ranker below reads the scores several times; the models run once.
        return durable(rows.withColumn("served", F.col("score") * terrain_multiplier()))

    tables = dict(zip(variants, in_parallel(
        samples.sparkSession, [partial(scored, name) for name in variants])))
    reference = baseline_scores(tables[variants[0]])
    rankers = [(n, reference, n) for n in ("constant", "terrain", "physics", "incidence")]
    for name, rows in tables.items():
        rankers += [(f"{name} (raw)", rows, "score"), (f"{name} (served)", rows, "served")]
    first, *others = variants
    if not others:
        return rankers_report(rankers, draws), None
    pairs = {v: durable(group_pairs(tables[v], "served")) for v in variants}
    judged = []
    for other in others:
        row = paired_delta_ci(pairs[first], pairs[other], draws).first()
        judged.append((first, other, row["point"], row["lo"], row["hi"], int(row["groups"]),
                       verdict(row["lo"], row["hi"], first, other)))
    table = samples.sparkSession.createDataFrame(
        judged, "a string, b string, point double, lo double, hi double, groups long, verdict string")
    return rankers_report(rankers, draws), table
