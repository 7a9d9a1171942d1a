"""Fitting boosted trees and deciding whether a fit may serve."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.rules import terrain_multiplier
from updraft.operators.forest import forest_of, with_staged_margins
from updraft.operators.metrics import group_pairs, grouped_auc, paired_delta_ci
from updraft.operators.splits import with_group, with_split
from updraft.session import durable, ensure_checkpoint_dir
from updraft.sources.store import StoredModel


@dataclass(frozen=True)
class FitConfig:
    """Boosting settings."""

    rounds: int = 200
    depth: int = 5
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    patience: int = 20    # rounds without a better score on the early-stop rows


NOTEBOOK_CONFIG = FitConfig(rounds=400, depth=6, rate=0.05)


def fit(samples: DataFrame, features: Sequence[str] = K.FEATURES, config: FitConfig = FitConfig(),
        early_stop: DataFrame | None = None) -> PipelineModel:
    """Boosted trees on labelled rows; positives weigh (negatives / positives), at least 1.

    ``early_stop`` rows choose the boosting round (``best_round``); without a group that
    holds both labels there is nothing to choose by, and all rounds stay.
    """
    ensure_checkpoint_dir(samples.sparkSession)
    total = samples.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    weight = max(1.0, (total["n"] - total["p"]) / max(1, total["p"]))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    rows = assembler.transform(samples.select(*features, "label").withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0))))

    def boosted(rounds: int) -> PipelineModel:
        return PipelineModel([assembler, GBTClassifier(
            featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=config.depth,
            stepSize=config.rate, subsamplingRate=config.row_share, featureSubsetStrategy=str(config.column_share),
            seed=config.seed).fit(rows)])

    if early_stop is None:
        return boosted(config.rounds)
    # A longer fit begins with the trees of a shorter one, so rounds are doubled until patience is spent: at most
    # twice the rounds that are needed, and what all rounds would have given.
    rounds = min(config.rounds, 2 * config.patience)
    while True:
        model = boosted(rounds)
        found, spent = best_round(staged_scores(early_stop, model, features), config.patience)
        if spent or rounds == config.rounds or found is None:
            break
        rounds = min(config.rounds, 2 * rounds)
    if found is None:
        return model if rounds == config.rounds else boosted(config.rounds)
    return cut(model, found)


def staged_scores(rows: DataFrame, model: PipelineModel,
                  features: Sequence[str] = K.FEATURES) -> list[tuple[int, float]]:
    """(round, grouped score of ``rows``) after each boosting round, all rounds in one pass.

    A row's margins are running sums of its tree values, so the model is evaluated once.
    Rows without ``gid`` are one group. Rounds without a mixed group are not listed.
    """
    gid = F.col("gid").cast("string") if "gid" in rows.columns else F.lit("all")
    plain = rows.select(*features, "label", gid.alias("gid"))
    staged = with_staged_margins(plain, forest_of(model, features), features)
    rounds = staged.select("label", "gid", F.posexplode("margins").alias("round", "margin"))
    keyed = rounds.select("label", "margin", F.concat_ws("/", (F.col("round") + 1).cast("string"), "gid").alias("gid"))
    pairs = group_pairs(keyed, "margin").withColumn("round", F.substring_index("gid", "/", 1).cast("int"))
    scores = pairs.groupBy("round").agg((F.sum("concordant") / F.sum("pairs")).alias("score")).orderBy("round")
    return [(r["round"], r["score"]) for r in scores.collect()]


def best_round(scores: Sequence[tuple[int, float]], patience: int) -> tuple[int | None, bool]:
    """The first best round before ``patience`` rounds in a row bring nothing better, and whether they did."""
    best, found = None, None
    for n, score in scores:
        if best is None or score > best:
            best, found = score, n
        elif n - found >= patience:
            return found, True
    return found, False


def cut(model: PipelineModel, rounds: int) -> PipelineModel:
    """The pipeline with its first ``rounds`` trees."""
    *front, trees = model.stages
    whole, sc = trees._java_obj, SparkContext._active_spark_context
    if rounds >= trees.getNumTrees:
        return model
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        kept[i], weights[i] = whole.trees()[i], whole.treeWeights()[i]
    shorter = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        whole.uid(), kept, weights, whole.numFeatures(), whole.numClasses())
    return PipelineModel([*front, GBTClassificationModel(shorter)])


def in_parallel(spark: SparkSession, tasks: Sequence[Callable[[], object]], threads: int = 8) -> list:
    """Results of independent tasks, started side by side: small fits leave most of a cluster idle."""
    run = inheritable_thread_target(spark)(lambda task: task())
    with ThreadPool(max(1, min(threads, len(tasks)))) as pool:
        return pool.map(run, tasks)


def raw_score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` with the model's lift probability as ``score``."""
    return model.transform(rows).select(
        *rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def served(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` with the score that would be served: probability times terrain factor."""
    return raw_score(rows, model).withColumn("score", F.col("score") * terrain_multiplier())


def feature_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by decreasing importance."""
    weights = model.stages[-1].featureImportances
    return sorted(((n, float(weights[i])) for i, n in enumerate(features)), key=lambda p: -p[1])


@dataclass(frozen=True)
class Decision:
    """Outcome of the gate."""

    accepted: bool
    reason: str
    score: float | None = None
    delta: tuple[float, float, float] | None = None
    groups: int = 0
    skipped: int = 0


def decide(benchmark_groups: int, score: float, incumbent_present: bool,
           incumbent_score: float | None, delta: tuple[float, float, float] | None,
           skipped: int) -> Decision:
    """The acceptance rule, on numbers alone.

    A fit is rejected only when the paired interval lies wholly below zero, and
    a run of rejections ends by accepting. Too few mixed groups: keep what
    serves, or accept unscored when nothing does.
    """
    if benchmark_groups < K.MIN_BENCH_GROUPS:
        if incumbent_present:
            return Decision(False, "benchmark too small", groups=benchmark_groups, skipped=skipped)
        return Decision(True, "unverified first model", groups=benchmark_groups, skipped=skipped)
    if not math.isfinite(score):
        return Decision(False, "score not finite", groups=benchmark_groups, skipped=skipped)
    if incumbent_score is not None and delta is not None and delta[2] < 0:
        skipped += 1
        if skipped < K.MAX_CONSECUTIVE_SKIPS:
            return Decision(False, "reliably worse", score, delta, benchmark_groups, skipped)
        return Decision(True, "re-baselined", score, delta, benchmark_groups, 0)
    return Decision(True, "accepted", score, delta, benchmark_groups, 0)


def fit_and_gate(samples: DataFrame, incumbent: StoredModel | None = None, skipped: int = 0,
                 config: FitConfig = FitConfig(), draws: int = K.GATE_DRAWS,
                 ) -> tuple[StoredModel | None, Decision]:
    """Fit on the frozen split and gate the result against the serving model.

    Returns the model that should serve from now on. Only counts, scores and
    interval bounds reach the driver.
    """
    samples = durable(samples)     # counted, fitted and scored several times
    size = samples.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    if size["n"] < K.MIN_SAMPLES:
        return incumbent, Decision(False, "too few samples", skipped=skipped)
    if size["p"] < K.MIN_POSITIVES:
        return incumbent, Decision(False, "too few positives", skipped=skipped)
    split = with_split(with_group(samples))
    part = {s: split.filter(F.col("split") == s) for s in ("train", "earlystop", "benchmark")}
    model = fit(part["train"], config=config, early_stop=part["earlystop"])
    pairs = group_pairs(served(part["benchmark"], model), "score")
    result = grouped_auc(pairs).first()
    delta = None
    if (incumbent is not None and incumbent.bench_score is not None
            and result["groups"] >= K.MIN_BENCH_GROUPS and math.isfinite(result["micro"])):
        current = group_pairs(served(part["benchmark"], incumbent.model), "score")
        row = paired_delta_ci(current, pairs, draws=draws).first()
        delta = (row["point"], row["lo"], row["hi"])
    decision = decide(result["groups"], result["micro"], incumbent is not None,
                      incumbent.bench_score if incumbent else None, delta, skipped)
    if not decision.accepted:
        return incumbent, decision
    return StoredModel(model, decision.score, tuple(K.FEATURES)), decision
