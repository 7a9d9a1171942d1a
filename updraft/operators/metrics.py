"""Within-group ranking scores and their bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.operators.blocks import number_block, with_row_number, with_running
from updraft.operators.montecarlo import hashed_uniform
from updraft.session import durable

SCORE_BLOCKS = 65_536
POISSON_TOP = 20   # beyond any draw of a double
# Up to this many groups (five numbers each) are broadcast to the draws; more meet
# them in a shuffle. The draws are the same either way.
BROADCAST_GROUPS = 200_000


def _score_block(score: Column) -> Column:
    """Block of a score: a monotone map of the real line onto SCORE_BLOCKS bins."""
    return F.floor((F.atan(score) / F.lit(math.pi) + F.lit(0.5)) * F.lit(float(SCORE_BLOCKS))).cast("bigint")


def group_pairs(df: DataFrame, score: str, label: str = "label", gid: str = "gid") -> DataFrame:
    """Correctly ordered and total positive/negative pairs per mixed-label group.

    Ties count half. Rows are first counted per (group, distinct score); a pair
    count is then "negatives below me" from a block-wise running sum, so no
    pair is ever formed and a huge group is cut into score blocks.
    """
    is_pos = (F.col(label) == 1).cast("bigint")
    counts = df.groupBy(gid, F.col(score).alias("__s")).agg(
        F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg"))
    ranked = with_running(counts, [gid], ["__s"], _score_block(F.col("__s")),
                          {"__upto": ("sum", F.col("neg"))})
    won = F.col("pos") * (F.col("__upto") - F.col("neg") + F.col("neg") * 0.5)
    return ranked.groupBy(gid).agg(
        F.sum(won).alias("concordant"),
        (F.sum("pos") * F.sum("neg")).alias("pairs")).filter("pairs > 0")


def grouped_auc(pairs: DataFrame) -> DataFrame:
    """Pooled (micro) and per-group mean (macro) score, one row."""
    nan = F.lit(float("nan"))
    return pairs.agg(
        F.coalesce(F.try_divide(F.sum("concordant"), F.sum("pairs")), nan).alias("micro"),
        F.coalesce(F.avg(F.col("concordant") / F.col("pairs")), nan).alias("macro"),
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def paired(pairs_a: DataFrame, pairs_b: DataFrame, gid: str = "gid") -> DataFrame:
    """Pair counts of two rankers side by side, per group."""
    a = pairs_a.select(gid, F.col("concordant").alias("ca"), F.col("pairs").alias("ta"))
    b = pairs_b.select(gid, F.col("concordant").alias("cb"), F.col("pairs").alias("tb"))
    return a.join(b, gid, "full_outer")


def _indexed(groups: DataFrame, gid: str, count: int, draws: int, seed: int,
             columns: list[str]) -> DataFrame:
    """Draw sums by resampling group indices (draws x groups rows)."""
    indexed = with_row_number(groups, [gid], number_block(gid, 100_000), "__i")
    slots = indexed.select(F.col("__i").alias("__slot")).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = F.floor(hashed_uniform(F.lit(seed), F.col("draw"), F.col("__slot")) * count) + 1
    drawn = slots.select("draw", picked.cast("bigint").alias("__i"))
    members = indexed.select("__i", *columns)
    if count <= BROADCAST_GROUPS:
        members = F.broadcast(members)
    return drawn.join(members, "__i").groupBy("draw").agg(
        *[F.sum(c).alias(c) for c in columns])


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) variate from a uniform, by its cumulative distribution."""
    expr, cumulative, term = None, 0.0, math.exp(-1.0)
    for k in range(POISSON_TOP):
        cumulative += term
        term /= k + 1
        hit = uniform < cumulative
        expr = F.when(hit, F.lit(k)) if expr is None else expr.when(hit, F.lit(k))
    return expr.otherwise(F.lit(POISSON_TOP))


def _weighted(groups: DataFrame, gid: str, draws: int, seed: int, columns: list[str]) -> DataFrame:
    """Draw sums with Poisson weights: one pass, partial sums only leave the map."""
    rows = groups.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    uniform = hashed_uniform(F.lit(seed), F.col("draw"), F.col(gid))
    weighted = rows.withColumn("__w", poisson_weight(uniform)).filter("__w > 0")
    return weighted.groupBy("draw").agg(*[F.sum(F.col(c) * F.col("__w")).alias(c) for c in columns])


def draw_sums(groups: DataFrame, gid: str, draws: int, seed: int, columns: list[str],
              method: str = "index") -> DataFrame:
    """Sums of per-group columns under each bootstrap draw of whole groups.

    ``index`` draws as many groups as there are, with replacement, whatever their
    number; ``poisson`` weights each group instead. The caller chooses, the size never.
    """
    if method == "index":
        return _indexed(groups, gid, groups.count(), draws, seed, columns)
    if method == "poisson":
        return _weighted(groups, gid, draws, seed, columns)
    raise ValueError(f"unknown resampling method {method!r}")


def _interval(draw_values: DataFrame, alpha: float) -> DataFrame:
    bounds = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    nan = F.lit(float("nan"))
    return draw_values.agg(bounds.alias("__b")).select(
        F.coalesce(F.get("__b", F.lit(0)), nan).alias("lo"),
        F.coalesce(F.get("__b", F.lit(1)), nan).alias("hi"))


def bootstrap_ci(pairs: DataFrame, draws: int = K.REPORT_DRAWS, alpha: float = 0.05, seed: int = 0,
                 gid: str = "gid", method: str = "index") -> DataFrame:
    """Percentile interval of the pooled score, resampling whole groups.

    One row: point, lo, hi, groups. Draws depend only on hashes, so a rerun gives
    the same interval. The table of groups is stored first: it is read several times.
    """
    pairs = durable(pairs.select(gid, "concordant", "pairs"))
    sums = draw_sums(pairs, gid, draws, seed, ["concordant", "pairs"], method)
    values = sums.select((F.col("concordant") / F.col("pairs")).alias("value"))
    point = grouped_auc(pairs).select(F.col("micro").alias("point"), "groups")
    return _one_row(point, _interval(values, alpha)).select("point", "lo", "hi", "groups")


def paired_delta_ci(pairs_a: DataFrame, pairs_b: DataFrame, draws: int = K.REPORT_DRAWS,
                    alpha: float = 0.05, seed: int = 0, gid: str = "gid",
                    method: str = "index") -> DataFrame:
    """Interval of (B - A) over the same resampled groups.

    One row: point, lo, hi, groups; NaN and 0 groups when there are none or the
    two rankers cover different groups.
    """
    both = durable(paired(pairs_a, pairs_b, gid))
    columns = ["ca", "ta", "cb", "tb"]
    sums = draw_sums(both.dropna(), gid, draws, seed, columns, method)
    values = sums.select((F.col("cb") / F.col("tb") - F.col("ca") / F.col("ta")).alias("value"))
    nan = F.lit(float("nan"))
    matched = (F.count(F.lit(1)) > 0) & (F.count_if(F.col("ta").isNull() | F.col("tb").isNull()) == 0)
    delta = F.try_divide(F.sum("cb"), F.sum("tb")) - F.try_divide(F.sum("ca"), F.sum("ta"))
    point = both.agg(F.coalesce(delta, nan).alias("point"), matched.alias("__ok"),
                     F.count(F.lit(1)).alias("groups"))
    row = _one_row(point, _interval(values, alpha))
    return row.select(
        *[F.when(F.col("__ok"), F.col(c)).otherwise(nan).alias(c) for c in ("point", "lo", "hi")],
        F.when(F.col("__ok"), F.col("groups")).otherwise(F.lit(0).cast("bigint")).alias("groups"))


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two single-row results side by side."""
    key = F.lit(1)
    return left.withColumn("__one", key).join(right.withColumn("__one", key), "__one").drop("__one")


def average_rank_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Global ROC AUC: the within-group score with everything in one group."""
    return grouped_auc(group_pairs(df.withColumn("__all", F.lit(0)), score, label, "__all")).select(
        F.col("micro").alias("auc"), "pairs")


def fold_report(df: DataFrame, score: str, label: str = "label", fold: str = "fold") -> DataFrame:
    """Mean and population deviation of the global ROC AUC over folds, one row; folds of one label do not count."""
    auc = group_pairs(df, score, label, fold).select((F.col("concordant") / F.col("pairs")).alias("auc"))
    return auc.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"), F.count(F.lit(1)).alias("folds"))


def classification_report(df: DataFrame, probability: str, label: str = "label",
                          threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class at a threshold."""
    called = (F.col(probability) > threshold).cast("int")
    cells = df.groupBy(F.col(label).alias("__y"), called.alias("__p")).agg(
        F.count(F.lit(1)).alias("n"))
    by_class = cells.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("label").agg(
        F.sum(F.when((F.col("__y") == F.col("label")) & (F.col("__p") == F.col("label")), F.col("n"))
              .otherwise(0)).alias("__tp"),
        F.sum(F.when(F.col("__p") == F.col("label"), F.col("n")).otherwise(0)).alias("__called"),
        F.sum(F.when(F.col("__y") == F.col("label"), F.col("n")).otherwise(0)).alias("support"))
    precision = F.coalesce(F.try_divide("__tp", "__called"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("__tp", "support"), F.lit(0.0))
    return by_class.select(
        "label", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        "support")
