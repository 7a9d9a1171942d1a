"""Systematic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def systematic_sample(df: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """Every n-th row by number, n = total / limit rounded up, at most ``limit`` rows.

    The total is a scalar subquery of the same plan, so nothing runs before the
    query itself does.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"))
    rate = total.select(F.greatest(
        F.lit(1).cast("bigint"), F.ceil(F.col("n") / F.lit(limit)).cast("bigint")).alias("r")).scalar()
    return df.filter(F.pmod(F.col(order), rate) == 0).orderBy(order).limit(limit)
