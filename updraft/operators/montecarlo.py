"""Forecast-uncertainty passes over scored cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.rules import terrain_multiplier, weather_score


def hashed_uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) that depends only on its key, through SHA-256."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")
    return (number + F.lit(0.5)) / F.lit(float(16 ** 13))


def hashed_normal(*parts: Column) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    u1 = hashed_uniform(*parts, F.lit(1))
    u2 = hashed_uniform(*parts, F.lit(2))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def noise_draws(key: Column, draws: int = K.MONTE_CARLO_DRAWS, seed: int = 0,
                columns: tuple[str, ...] | None = None) -> Column:
    """Array of draws for one request: a struct of one normal per noisy column.

    A draw is shared by all cells of the request, as forecast error is.
    """
    noisy = [n for n in K.NOISE if columns is None or n[0] in columns]
    return F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: F.struct(*[
        (hashed_normal(F.lit(seed), key, d, F.lit(name)) * F.lit(scale)).alias(name)
        for name, _, scale in noisy]))


def perturbed(name: str, value: Column, draw: Column) -> Column:
    """A weather value under one draw."""
    kind = {n: k for n, k, _ in K.NOISE}[name]
    noise = draw[name]
    return value * (F.lit(1.0) + noise) if kind == "rel" else value + noise


def mean_and_std(values: Column) -> tuple[Column, Column]:
    """(mean clipped to [0, 1], population standard deviation) of an array.

    Sums are taken around the first element, which keeps the deviation exact
    without folding the mean into a second pass.
    """
    n, pivot = F.size(values).cast("double"), F.get(values, F.lit(0))
    first = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - pivot)) / n
    second = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - pivot) * (v - pivot)) / n
    mean = pivot + first
    return (F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)),
            F.sqrt(F.greatest(second - first * first, F.lit(0.0))))


def monte_carlo(df: DataFrame, score: Callable[[dict[str, Column]], Column],
                draws: str = "draws") -> DataFrame:
    """Add p_mean and p_std of any Column score over the draws of each row.

    ``score`` receives the noisy columns by name under one draw. The runs stay
    an array inside the row: nothing is multiplied out or shuffled.
    """
    names = [n for n, _, _ in K.NOISE]
    runs = F.transform(F.col(draws), lambda d: score(
        {n: perturbed(n, F.col(n), d) for n in names if n in df.columns}))
    rows = df.withColumn("__runs", runs)
    mean, std = mean_and_std(F.col("__runs"))
    return rows.withColumn("p_mean", mean).withColumn("p_std", std).drop("__runs")


def physics_draws(requests: DataFrame, key: str = "request_id", draws: int = K.MONTE_CARLO_DRAWS,
                  seed: int = 0) -> DataFrame:
    """Per-request weather scores under noise, in the form cells look them up.

    Only weather is noisy and weather is constant over a grid, so the noisy half
    of the physics score is computed per request, not per cell: the runs in
    increasing order, their running sums and running sums of squares, and their
    mean and deviation.
    """
    noise = noise_draws(F.col(key), draws, seed, ("cape", "cin", "solar_ghi"))
    runs = requests.withColumn("__runs", F.array_sort(F.transform(noise, lambda d: weather_score(
        perturbed("cape", F.col("cape"), d), perturbed("cin", F.col("cin"), d),
        perturbed("solar_ghi", F.col("solar_ghi"), d)))))
    mean, std = mean_and_std(F.col("__runs"))

    def running(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0.0)),
                           lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))

    return runs.select(
        *requests.columns, F.col("__runs").alias("base_runs"),
        running(F.col("__runs")).alias("base_sums"),
        running(F.transform("__runs", lambda v: v * v)).alias("base_squares"),
        F.array_max("__runs").alias("base_top"), mean.alias("base_mean"), std.alias("base_std"))


BASE = ("base_runs", "base_sums", "base_squares", "base_top", "base_mean", "base_std")


def physics_monte_carlo(cells: DataFrame, draws: int = K.MONTE_CARLO_DRAWS) -> DataFrame:
    """p_mean and p_std of physics scores on cells carrying ``physics_draws``.

    A cell's runs are its terrain factor times the request's runs, clipped at 1.
    How many stay below 1 is a binary search in the ordered runs; the moments
    then follow from the running sums. Everything is generated code, with no
    loop over the runs.
    """
    rows = cells.withColumn("__m", terrain_multiplier()).withColumn("__k", F.lit(0))
    step = 1 << (draws.bit_length() - 1)
    while step:
        probe = F.get(F.col("base_runs"), F.col("__k") + (step - 1))
        rows = rows.withColumn("__k", F.when(
            probe * F.col("__m") <= 1.0, F.col("__k") + step).otherwise(F.col("__k")))
        step //= 2
    m, k, n = F.col("__m"), F.col("__k"), F.lit(float(draws))
    whole = F.col("base_top") * m <= 1.0
    mean = (m * F.get(F.col("base_sums"), k) + (n - k)) / n
    rows = rows.withColumn("p_mean", F.when(whole, F.col("base_mean") * m).otherwise(mean))
    square = (m * m * F.get(F.col("base_squares"), k) + (n - k)) / n
    deviation = F.sqrt(F.greatest(square - F.col("p_mean") * F.col("p_mean"), F.lit(0.0)))
    return rows.withColumn("p_std", F.when(whole, F.col("base_std") * m).otherwise(deviation)).drop(
        "__m", "__k", *BASE)
