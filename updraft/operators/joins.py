"""Join helpers for keys that may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                salts: int = SALTS, spread: Sequence[str] | None = None) -> DataFrame:
    """Join many rows to a lookup with at most one row per key.

    A key that owns a large share of ``rows`` is spread over ``salts`` tasks; the
    lookup is repeated once per salt. The salt is a hash of the row's own values,
    so a retried task computes the same one.
    """
    salt = F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(salts)).cast("int")
    repeated = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", salt).join(repeated, [*on, "__salt"], how).drop("__salt")
