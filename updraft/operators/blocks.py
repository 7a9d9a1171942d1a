"""Sequence operators that never need a whole key in one task.

A plain ``lag`` or running sum over ``partitionBy(id)`` puts every row of an id
into one task, so one busy id decides the run time. Here a key's sequence is cut
into blocks by a function of the row's own order value (an hour of time, a
stretch of lines). Rows shuffle on (key, block); what has to cross a block
boundary is reduced first, to a handful of rows per block, and only those few
meet in a per-key window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later filters read instead of recomputing.

    A filter on a projected column is pushed below the projection with the whole
    expression copied into it, once per use. Producing the columns with a
    one-element generator keeps costly ones (pattern matches) at one evaluation
    per row. It is the outer form because the plain one gains a "not empty"
    filter that is pushed down with a copy of the whole array.
    """
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def time_block(ts, seconds: int) -> Column:
    """Block number of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def number_block(value, width: float) -> Column:
    """Block number of a numeric order column."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(width)).cast("bigint")


def with_shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                 shifts: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Add lag (offset > 0) and lead (offset < 0) columns per key.

    ``block`` must not decrease along ``order``. Values within a block come from
    a window over (key, block). Only rows within reach of a block edge look
    further, in a window over the edge rows alone: at most 2 x max offset rows
    per block.
    """
    depth = max(abs(offset) for _, offset in shifts.values())
    out = df.columns
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*order)

    def shifted(expr: Column, offset: int, window) -> Column:
        boxed = F.struct(expr.alias("v"))
        move = F.lag(boxed, offset) if offset > 0 else F.lead(boxed, -offset)
        return move.over(window)

    near = df.withColumn(BLOCK, block).select(
        "*",
        *[shifted(e, o, inner).alias(f"__{n}") for n, (e, o) in shifts.items()],
        (F.lag(F.lit(1), depth).over(inner).isNull()
         | F.lead(F.lit(1), depth).over(inner).isNull()).alias("__edge"),
    )
    middle = near.filter(~F.col("__edge")).select(
        *out, *[F.col(f"__{n}.v").alias(n) for n in shifts])
    edges = near.filter("__edge").select(
        *out, *[F.coalesce(F.col(f"__{n}"), shifted(e, o, across)).alias(f"__{n}")
                for n, (e, o) in shifts.items()],
    ).select(*out, *[F.col(f"__{n}.v").alias(n) for n in shifts])
    return middle.unionByName(edges)


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                 running: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running aggregates per key: ``name -> (kind, expression)``.

    Kinds are ``sum``, ``max`` and ``last`` (last non-null value). Block totals
    are aggregated with map-side combine, accumulated over the blocks of a key,
    and handed to each block as one carry row that sorts first; the rows
    themselves are windowed per (key, block).
    """
    out = df.columns
    keyed = df.withColumn(BLOCK, block).select(
        "*", *[e.alias(f"__v_{n}") for n, (_, e) in running.items()])
    position = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])

    def total(kind: str, name: str) -> Column:
        value = F.col(f"__v_{name}")
        if kind == "sum":
            return F.sum(value)
        if kind == "max":
            return F.max(value)
        return F.max_by(value, F.when(value.isNotNull(), position))

    def accumulate(kind: str, name: str, window) -> Column:
        value = F.col(f"__v_{name}")
        if kind == "sum":
            return F.sum(value).over(window)
        if kind == "max":
            return F.max(value).over(window)
        return F.last(value, ignorenulls=True).over(window)

    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = keyed.groupBy(*keys, BLOCK).agg(
        *[total(kind, n).alias(f"__v_{n}") for n, (kind, _) in running.items()]
    ).select(*keys, BLOCK, *[accumulate(kind, n, before).alias(f"__v_{n}")
                             for n, (kind, _) in running.items()])
    both = keyed.withColumn("__row", F.lit(1)).unionByName(
        carry.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, BLOCK).orderBy("__row", *order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    return both.select(
        *out, "__row", *[accumulate(kind, n, upto).alias(n) for n, (kind, _) in running.items()]
    ).filter("__row = 1").select(*out, *running)


def with_row_number(df: DataFrame, order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Add a dense global row number without a single-task sort of the rows.

    Only the per-block counts (one row per block) meet in one task.
    """
    return with_running(df, [], order, block, {name: ("sum", F.lit(1))})
