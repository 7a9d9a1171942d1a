"""Boosted trees as data: read from a fitted model, flattened into arrays, evaluated as Columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.rules import terrain_multiplier
from updraft.operators import gridwise
from updraft.operators.blocks import computed_once
from updraft.operators.montecarlo import mean_and_std, noise_draws, perturbed

NOISY = tuple(n for n, _, _ in K.NOISE)
WORD = 62     # tests in one number of a pattern


@dataclass(frozen=True)
class Split:
    """An inner node: rows with ``feature`` <= ``threshold`` go low."""

    feature: str
    threshold: float
    low: Split | float
    high: Split | float


Node = Split | float


@dataclass(frozen=True)
class Forest:
    """Trees whose leaf values already carry the tree's weight; their sum is the margin."""

    trees: tuple[Node, ...]

    def first(self, rounds: int) -> Forest:
        return Forest(self.trees[:rounds])


def probability(margin: Column) -> Column:
    """Lift probability of a margin (the logistic loss of boosted trees doubles it)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


# --- From a fitted model ---------------------------------------------------------

_TREE = re.compile(r"^Tree \d+ \(weight (\S+)\):$")
_TEST = re.compile(r"^(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)$")
_LEAF = re.compile(r"^Predict: (\S+)$")


def forest_of(model: PipelineModel, features: Sequence[str] = K.FEATURES) -> Forest:
    """The trees of a fitted pipeline, from its own description: one call to the JVM."""
    lines = [line.strip() for line in model.stages[-1].toDebugString.splitlines()[1:] if line.strip()]
    at, trees = 0, []

    def node(weight: float) -> Node:
        nonlocal at
        leaf = _LEAF.match(lines[at])
        if leaf:
            at += 1
            return float(leaf[1]) * weight
        test = _TEST.match(lines[at])
        at += 1
        low = node(weight)
        if not _TEST.match(lines[at]):
            raise ValueError(f"not a tree of numeric splits: {lines[at]!r}")
        at += 1
        return Split(features[int(test[2])], float(test[3]), low, node(weight))

    while at < len(lines):
        head = _TREE.match(lines[at])
        if not head:
            raise ValueError(f"not a tree: {lines[at]!r}")
        at += 1
        trees.append(node(float(head[1])))
    return Forest(tuple(trees))


# --- Flattened ---------------------------------------------------------------------

def _depth(node: Node) -> int:
    return 0 if not isinstance(node, Split) else 1 + max(_depth(node.low), _depth(node.high))


def flattened(forest: Forest, features: Sequence[str]) -> tuple[Column, int]:
    """(struct of node arrays, depth). A leaf is a node that leads to itself."""
    place = {n: i for i, n in enumerate(features)}
    nodes: dict[str, list] = {"feature": [], "threshold": [], "low": [], "high": [], "value": []}

    def add(node: Node) -> int:
        here = len(nodes["value"])
        inner = isinstance(node, Split)
        for name, value in (("feature", place[node.feature] if inner else 0), ("low", here), ("high", here),
                            ("threshold", node.threshold if inner else 0.0), ("value", 0.0 if inner else node)):
            nodes[name].append(value)
        if inner:
            nodes["low"][here], nodes["high"][here] = add(node.low), add(node.high)
        return here

    roots = [add(t) for t in forest.trees]
    schema = ("feature array<int>, threshold array<double>, low array<int>, high array<int>, value array<double>, "
              "roots array<int>")
    return F.from_json(F.lit(json.dumps({**nodes, "roots": roots})), schema), max(map(_depth, forest.trees), default=0)


def tree_values(forest: Forest, features: Sequence[str] = K.FEATURES) -> Column:
    """What each tree adds to a row's margin, in boosting order."""
    trees, depth = flattened(forest, features)
    row = F.array(*[F.col(c).cast("double") for c in features])

    def step(x: Column, node: Column) -> Column:
        goes_low = F.get(x, F.get(trees["feature"], node)) <= F.get(trees["threshold"], node)
        return F.when(goes_low, F.get(trees["low"], node)).otherwise(F.get(trees["high"], node))

    levels = F.array_repeat(F.lit(0), depth)
    # The row's array is built once: as the only element of an outer array it is bound to a name.
    return F.get(F.transform(F.array(row), lambda x: F.transform(trees["roots"], lambda root: F.get(
        trees["value"], F.aggregate(levels, root, lambda n, _: step(x, n))))), F.lit(0))


def with_staged_margins(rows: DataFrame, forest: Forest, features: Sequence[str] = K.FEATURES,
                        name: str = "margins") -> DataFrame:
    """``rows`` with the margin after each round: running sums of the tree values, in one pass."""
    valued = computed_once(rows, __trees=tree_values(forest, features))
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("seen"))
    sums = F.aggregate("__trees", start, lambda a, v: F.struct(
        (a["total"] + v).alias("total"), F.array_append(a["seen"], a["total"] + v).alias("seen")), lambda a: a["seen"])
    return valued.withColumn(name, sums).drop("__trees")


def scored(rows: DataFrame, forest: Forest, features: Sequence[str] = K.FEATURES) -> DataFrame:
    """``rows`` with the forest's probability as ``score``."""
    valued = computed_once(rows, __trees=tree_values(forest, features))
    margin = F.aggregate("__trees", F.lit(0.0), lambda s, v: s + v)
    return valued.withColumn("score", probability(margin)).drop("__trees")


# --- Uncertainty ---------------------------------------------------------------------

def _is_noisy(node: Node) -> bool:
    """Whether a subtree has splits, all of them on noisy columns."""
    return isinstance(node, Split) and node.feature in NOISY and all(
        not isinstance(n, Split) or _is_noisy(n) for n in (node.low, node.high))


@dataclass(frozen=True)
class _Part:
    """Value of a subtree for a cell under a draw; ``array`` holds all draws where the cell merely picks one."""

    value: Callable[[Column], Column]
    draws: bool = False
    array: Column | None = None


def _picked(array: Column) -> _Part:
    return _Part(lambda d: F.get(array, d), True, array)


class Uncertainty:
    """How a forest's score spreads over forecast noise, without a row per draw.

    Weather, and so every noisy column, is constant over a grid. Each subtree that
    splits on noisy columns alone is resolved once per request and draw, as is each
    noisy split above cell columns (``request_runs``). A cell enters by the outcomes of
    its own tests alone, its ``pattern``; cells of a request with one pattern share one
    evaluation of the draws, and the terrain factor, which differs, comes after it.
    """

    def __init__(self, forest: Forest, draws: int = K.MONTE_CARLO_DRAWS, seed: int = 0):
        self.forest, self.draws, self.seed = forest, draws, seed
        self.subtrees: list[Node] = []
        self.splits: list[tuple[str, float]] = []
        self.tests: list[tuple[str, float]] = []
        self.parts = [self._part(t) for t in forest.trees]

    @staticmethod
    def _place(known: list, item) -> int:
        if item not in known:
            known.append(item)
        return known.index(item)

    def _part(self, node: Node) -> _Part:
        if not isinstance(node, Split):
            return _Part(lambda d: F.lit(float(node)))
        if _is_noisy(node):
            return _picked(F.get(F.col("noisy_values"), F.lit(self._place(self.subtrees, node))))
        low, high = self._part(node.low), self._part(node.high)
        if node.feature in NOISY:
            runs = F.get(F.col("noisy_low"), F.lit(self._place(self.splits, (node.feature, node.threshold))))
            return _Part(lambda d: F.when(F.get(runs, d), low.value(d)).otherwise(high.value(d)), True)
        word, bit = divmod(self._place(self.tests, (node.feature, node.threshold)), WORD)
        goes_low = F.get(F.col("pattern"), F.lit(word)).bitwiseAND(F.lit(1 << bit)) != 0
        sides = [p.array if p.draws else F.array_repeat(p.value(F.lit(0)), self.draws) for p in (low, high)]
        if (low.draws or high.draws) and all(side is not None for side in sides):
            return _picked(F.when(goes_low, sides[0]).otherwise(sides[1]))
        return _Part(lambda d: F.when(goes_low, low.value(d)).otherwise(high.value(d)), low.draws or high.draws)

    def request_runs(self, requests: DataFrame, key: str = "request_id") -> DataFrame:
        """(key, noisy_values, noisy_low): noisy subtrees and splits of each request, per draw."""
        draws = computed_once(requests, __draws=noise_draws(F.col(key), self.draws, self.seed))

        def under(node: Node, d: Column) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            test = perturbed(node.feature, F.col(node.feature), d) <= F.lit(node.threshold)
            return F.when(test, under(node.low, d)).otherwise(under(node.high, d))

        def resolved(node: Node) -> Column:
            return F.transform("__draws", lambda d: under(node, d))

        def lows(name: str, threshold: float) -> Column:
            return F.transform("__draws", lambda d: perturbed(name, F.col(name), d) <= F.lit(threshold))

        values, low = [resolved(n) for n in self.subtrees], [lows(*split) for split in self.splits]
        return draws.select(
            key, (F.array(*values) if values else F.array().cast("array<array<double>>")).alias("noisy_values"),
            (F.array(*low) if low else F.array().cast("array<array<boolean>>")).alias("noisy_low"))

    def pattern(self) -> Column:
        """Outcomes of all tests on a cell's own columns, as bits of numbers."""
        words = [self.tests[i:i + WORD] for i in range(0, len(self.tests), WORD)] or [[]]
        return F.array(*[reduce(lambda a, b: a + b, [
            F.when(F.col(name) <= F.lit(threshold), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
            for bit, (name, threshold) in enumerate(word)], F.lit(0).cast("bigint")) for word in words])

    def pattern_scores(self, patterns: DataFrame) -> DataFrame:
        """``patterns`` (with their request's runs) with mean and population deviation of the probability."""
        fixed = [p.value(F.lit(0)) for p in self.parts if not p.draws]
        picked = {f"__v{i}": p.array for i, p in enumerate(self.parts) if p.array is not None}
        mixed = [p for p in self.parts if p.draws and p.array is None]
        rows = computed_once(patterns, __base=reduce(lambda a, b: a + b, fixed, F.lit(0.0)), **picked)

        def margin(d: Column) -> Column:
            terms = [F.get(F.col(c), d) for c in picked] + [p.value(d) for p in mixed]
            return reduce(lambda a, b: a + b, terms, F.col("__base"))

        runs = F.transform(F.sequence(F.lit(0), F.lit(self.draws - 1)), lambda d: probability(margin(d)))
        mean, deviation = mean_and_std(F.col("__runs"))
        kept = [c for c in patterns.columns if c not in ("noisy_values", "noisy_low")]
        return computed_once(rows, __runs=runs).select(*kept, mean.alias("__mean"), deviation.alias("__std"))

    def spread(self, cells: DataFrame, requests: DataFrame, keep: Sequence[str], key: str = "request_id") -> DataFrame:
        """The ``keep`` columns of ``cells`` with p_mean and p_std of the served score.

        The spread is over the noise of each cell's request, which ``requests`` hold in one row
        per ``key``. The served score is the probability times the terrain factor; the
        mean is clipped, single runs are not. Only kept columns meet the patterns' scores.
        """
        keyed = cells.select(*keep, self.pattern().alias("pattern"), terrain_multiplier().alias("__factor"))
        patterns = keyed.select(key, "pattern").distinct().join(self.request_runs(requests, key), key)
        return keyed.join(self.pattern_scores(patterns), [key, "pattern"]).select(*keep, *self._served())

    @staticmethod
    def _served() -> list[Column]:
        """p_mean and p_std of a cell from its pattern's moments and its terrain factor."""
        return [F.least(F.greatest(F.col("__mean") * F.col("__factor"), F.lit(0.0)), F.lit(1.0)).alias("p_mean"),
                (F.col("__std") * F.col("__factor")).alias("p_std")]

    def heat_cells(self, grids: DataFrame, layers: dict[str, float | None], timed: Sequence[str],
                   rounded: bool = False, key: str = "request_id") -> DataFrame:
        """``spread`` of all cells of ``grids``, made and scored one grid at a time where it lies.

        ``grids`` have the ``noisy`` columns of their request (see ``gridwise.heat_rows`` for the
        others). Patterns are those of a grid; its cells never move.
        """
        cuts: dict[str, list[float]] = {}
        for name, threshold in sorted(set(self.tests)):
            cuts.setdefault(name, []).append(float(threshold))

        def plan(node: Node):
            """A node as plain data: a cell test knows its threshold's place, a noisy one its threshold."""
            if not isinstance(node, Split):
                return float(node)
            cut = float(node.threshold)
            place = cut if node.feature in NOISY else cuts[node.feature].index(cut)
            return node.feature, place, plan(node.low), plan(node.high)

        # Added up in the order of pattern_scores.
        order = sorted(range(len(self.parts)), key=lambda i: (self.parts[i].draws, self.parts[i].array is None))
        trees = [plan(self.forest.trees[i]) for i in order]
        rows = gridwise.heat_rows(
            grids.withColumn("noise_key", F.col(key).cast("string")), key, {n: np.array(c) for n, c in cuts.items()},
            trees, self.noisy, self.draws, self.seed, layers, tuple(timed), rounded)
        return gridwise.heat_cells(rows, key)

    @property
    def noisy(self) -> tuple[str, ...]:
        """The noisy columns that the forest tests."""
        def tested(node: Node) -> set[str]:
            return {node.feature} | tested(node.low) | tested(node.high) if isinstance(node, Split) else set()

        seen = set().union(*map(tested, self.forest.trees))
        return tuple(n for n in NOISY if n in seen)
