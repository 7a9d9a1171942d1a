"""Frozen, group-disjoint splits and balanced folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.atmosphere import decode_cyclic
from updraft.functions.geo import group_id
from updraft.operators.blocks import with_row_number, with_running
from updraft.operators.joins import salted_join


def group_hash(gid: str | Column, salt: str) -> Column:
    """60-bit hash of a group under a salt."""
    gid = F.col(gid) if isinstance(gid, str) else gid
    text = F.concat(F.lit(salt), F.lit("|"), gid.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def with_group(df: DataFrame, lat: str = "lat", lon: str = "lon", doy: str | None = None) -> DataFrame:
    """Add the group id, from a day-of-year column or the cyclic encoding of one."""
    day = F.col(doy) if doy else decode_cyclic("doy_sin", "doy_cos", 365)
    return df.withColumn("gid", group_id(day, lat, lon))


def on_side(gid: str | Column, salt: str, modulus: int = K.HOLDOUT_MODULUS) -> Column:
    """Whether a group falls on the selected 1-in-N side."""
    return F.pmod(group_hash(gid, salt), F.lit(modulus)) == 0


def with_split(df: DataFrame, gid: str = "gid") -> DataFrame:
    """Add ``split``: benchmark, earlystop or train. A group never straddles two.

    A pure function of the group id: it neither shuffles nor changes when the
    table grows.
    """
    side = (F.when(on_side(gid, K.BENCH_SALT), F.lit("benchmark"))
            .when(on_side(gid, K.EARLY_STOP_SALT), F.lit("earlystop"))
            .otherwise(F.lit("train")))
    return df.withColumn("split", side)


def group_folds(df: DataFrame, k: int = 5, seed: int = 0, gid: str = "gid") -> DataFrame:
    """(gid, fold): folds that differ by at most one group, in seeded hash order.

    Groups are numbered in blocks of their hash, which is uniform, so no task
    sorts them all.
    """
    groups = df.select(gid).distinct().withColumn("__h", group_hash(gid, f"{K.FOLD_SALT}/{seed}"))
    numbered = with_row_number(groups, ["__h", gid], F.shiftright("__h", 48), "__n")
    return numbered.select(gid, F.pmod(F.col("__n") - 1, F.lit(k)).cast("int").alias("fold"))


def with_fold(df: DataFrame, k: int = 5, seed: int = 0, gid: str = "gid") -> DataFrame:
    """Add ``fold`` to every row of ``df``."""
    return salted_join(df, group_folds(df, k, seed, gid), [gid], "inner")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 0, label: str = "label", key: str = "seq") -> DataFrame:
    """``df`` with ``fold``: rows of each label dealt evenly, in seeded hash order of their key.

    Rows of a label are numbered in blocks of their hash, so a label that holds
    most rows is many blocks.
    """
    hashed = df.withColumn("__h", group_hash(key, f"{K.FOLD_SALT}/stratified/{seed}"))
    numbered = with_running(hashed, [label], ["__h", key], F.shiftright("__h", 48), {"__n": ("sum", F.lit(1))})
    return numbered.withColumn("fold", F.pmod(F.col("__n") - 1, F.lit(k)).cast("int")).drop("__h", "__n")


def label_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
