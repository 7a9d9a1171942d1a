"""Mixing documents to target shares by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Each round scales the cells'
weights so that they meet the target share of every source, then of every
language, then of every topic, until a round changes nothing. A cell's weight over
its tokens is how much more or less of it the mix wants; times a common rate, cut
at 1, it is the probability with which each of its documents is drawn, and the
rate is set so that the expected tokens meet the budget. Columns and SQL
functions only.

* Null source or language is a level of its own; null text is an empty one and
  has no tokens. Cells without tokens have no weight and probability 1: nothing
  is gained by dropping them.
* Targets leave out a level: it keeps its own share. Shares are scaled to sum to 1
  over the levels present. Margins that no weights can meet (levels that never
  occur together) end after ``ROUNDS`` rounds with the last axis met.
* A document's draw depends on its doc_id and the seed alone, so repeated rows
  and retries agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import read, written

AXES = ("source", "lang", "topic")
ROUNDS = 30
TOLERANCE = 1e-4
#: Default targets: shares of tokens to this power, evened out by that.
TEMPER = 0.7
#: Share of all tokens that the mix draws.
BUDGET = 0.7
SEED = 17
GRID, REFINE = 64, 3
SALTS = 16
#: Cells up to this many (some 20 MB) are broadcast to the documents; more are joined by a salted shuffle.
BROADCAST_CELLS = 200_000

WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, symbols, contact, brief or prose."""
    words = F.regexp_count(text, F.lit(WORD))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&", ""))
    return (F.when(F.length(text) - F.length(F.translate(text, "|", "")) > F.lit(0.2) * words, "table")
            .when(marks > words, "symbols").when(text.contains("@") | text.contains("http"), "contact")
            .when(words < 100, "brief").otherwise("prose"))


def level(column: str) -> Column:
    """A level's name that cannot be null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("none"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the three levels and the tokens (words) of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", level("source").alias("source"), level("lang").alias("lang"),
                       topic_of(text).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Tokens of every cell; combined within tasks first, so a hot cell is one row per task."""
    return rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def tempered_targets(cells: DataFrame, axis: str, temper: float = TEMPER) -> DataFrame:
    """Share per level of an axis: its tokens to the power ``temper``, before scaling."""
    return cells.groupBy(axis).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("share"))


def _targets(cells: DataFrame, axis: str, shares: DataFrame, total: float) -> DataFrame:
    """Target tokens per level present; the scaling sum is one number."""
    levels = cells.groupBy(axis).agg((F.sum("tokens") / F.lit(total)).alias("own"))
    known = levels.join(shares.select(axis, F.col("share").cast("double")), axis, "left")
    given = known.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("own")))).first()
    rest = given[1] or 0.0
    scale = (1.0 - rest) / given[0] if given[0] else 0.0
    return known.select(axis, (F.coalesce(F.col("share") * scale, F.col("own")) * total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: tokens scaled until every margin meets its target.

    ``targets`` gives (axis, share) per axis; each round is stored, and ends the
    loop if no factor differs from 1 by more than the tolerance.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumn("weight", F.col("tokens").cast("double"))
    aims = {a: written(_targets(cells, a, targets[a], total), "targets") for a in AXES}
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for axis in AXES:
            sums = now.groupBy(axis).agg(F.sum("weight").alias("sum"))
            factor = sums.join(aims[axis], axis).select(axis, (F.col("target") / F.col("sum")).alias(f"f_{axis}"))
            now = now.join(factor, axis).withColumn("weight", F.col("weight") * F.col(f"f_{axis}"))
        now = written(now, "raked")
        moved = now.agg(F.max(F.greatest(*[F.abs(F.col(f"f_{a}") - 1) for a in AXES]))).first()[0]
        now = now.drop(*[f"f_{a}" for a in AXES])
        if moved <= tolerance:
            break
    return now


def drawn_rate(cells: DataFrame, budget: float = BUDGET) -> float:
    """The common rate at which the expected tokens meet the budget.

    Each pass sums the expected tokens for a whole grid of rates and narrows the
    interval to one grid step.
    """
    ratio = F.col("weight") / F.col("tokens")
    row = cells.agg(F.sum("tokens"), F.min(ratio)).first()
    if not row[0]:
        return 1.0
    low, high, aim = 0.0, 1.0 / row[1], budget * row[0]
    for _ in range(REFINE):
        rates = [low + (high - low) * k / GRID for k in range(1, GRID + 1)]
        tried = cells.select("tokens", ratio.alias("ratio"), F.posexplode(F.array(*[F.lit(r) for r in rates])))
        sums = tried.groupBy("pos").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * F.col("col"))).alias(
            "expected")).orderBy("pos").collect()            # GRID rows
        step = next((r["pos"] for r in sums if r["expected"] >= aim), GRID - 1)
        low, high = (rates[step - 1] if step else low), rates[step]
    return high


def calibrated(rows: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """Cells of ``rows`` with tokens, weight and the probability of their documents."""
    cells = written(cells_of(rows), "cells")
    raked = rake(cells, targets or {a: tempered_targets(cells, a) for a in AXES})
    rate = drawn_rate(raked, budget)
    p = F.least(F.lit(1.0), F.round(F.col("weight") / F.col("tokens") * rate, 9))
    return raked.withColumn("probability", p)


def draw(rows: DataFrame, cells: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (with doc_id and the axes) with ``weight`` per token, ``probability`` and ``kept``."""
    c = cells.select(*AXES, (F.col("weight") / F.col("tokens")).alias("weight"), "probability")
    if cells.count() <= BROADCAST_CELLS:
        out = rows.join(F.broadcast(c), list(AXES), "left")
    else:
        c = c.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        out = rows.withColumn("salt", salt).join(c, [*AXES, "salt"], "left").drop("salt")
    out = out.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    # 53 bits of the hash as a number from 0 to 1.
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) * F.lit(2.0 ** -53)
    return out.withColumn("kept", uniform < F.col("probability"))


def op9_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(features(read(spark, sf_dir, "documents")), "features")
    def name(axis: str) -> Column:
        return F.when(F.col(axis) != "none", F.substring(axis, 2, 1 << 30)).alias(axis)

    return draw(rows, calibrated(rows)).select(
        "doc_id", name("source"), name("lang"), "topic", "n_tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept")
