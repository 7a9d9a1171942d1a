"""Flight kinematics and thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.operators.blocks import time_block, with_running, with_shifted
from updraft.session import durable

# Neighbouring blocks whose maps are composed into one.
FANIN = 32
# Before any time, with room to add a step.
NOTHING_KEPT = -(1 << 62)


def _bearing(lat: Column, lon: Column, from_lat: Column, from_lon: Column) -> Column:
    east = (lon - from_lon) * F.cos(F.radians(lat))
    angle = F.degrees(F.atan2(east, lat - from_lat))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def with_kinematics(fixes: DataFrame, keys: Sequence[str], order: Sequence[str],
                    block: Column) -> DataFrame:
    """Climb rate, turn rate and circling between consecutive fixes.

    A flight's first fix has no motion. Fixes that do not move time forward are
    dropped but still count as predecessors; flights of one fix give nothing.
    """
    here = F.struct("time", "lat", "lon", "alt")
    seen = with_shifted(fixes, keys, order, block, {
        "__p1": (here, 1), "__p2": (here, 2), "__next": (F.lit(1), -1)})

    def seconds(after: Column, before: Column) -> Column:
        return (F.unix_micros(after) - F.unix_micros(before)) / 1e6

    p1, p2 = F.col("__p1"), F.col("__p2")
    first = p1.isNull()
    dt, dt2 = seconds(F.col("time"), p1["time"]), seconds(p1["time"], p2["time"])
    turn = (_bearing(F.col("lat"), F.col("lon"), p1["lat"], p1["lon"])
            - _bearing(p1["lat"], p1["lon"], p2["lat"], p2["lon"]))
    turn = turn + 180.0 - 360.0 * F.floor((turn + 180.0) / 360.0) - 180.0
    moving = seen.filter((first & F.col("__next").isNotNull()) | (dt > 0))
    rows = moving.select(
        *fixes.columns,
        F.when(first, F.lit(0.0)).otherwise((F.col("alt") - p1["alt"]) / dt).alias("vario"),
        F.when(p2.isNotNull() & (dt2 > 0), turn / dt).otherwise(F.lit(0.0)).alias("turn_rate"))
    return rows.withColumn("circling", F.abs("turn_rate") > K.CIRCLING_DEG_S)


def thin(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], order_block: Column,
         seconds: int = 30, block_s: int = 600) -> DataFrame:
    """At most one row per ``seconds`` since the last kept row, in feed order.

    Keeping a row depends on the last one kept, which makes the rule sequential.
    It is evaluated exactly, without a whole key in one task:

    1. only rows that move time forward can ever be kept, so others go first;
    2. each (key, time block) is reduced to a map: for every time at which a chain may
       enter it, the last time that chain keeps in it (few, as entries lie within
       ``seconds``, each found by binary searches);
    3. maps of ``FANIN`` neighbouring blocks are composed into one, and so on up to
       one map a key: a logarithmic number of shuffles, each a fraction of the one before;
    4. on the way back down every block learns the last row kept before it;
    5. each block then keeps its own rows independently.
    """
    step = seconds * 1_000_000
    front = with_running(df, keys, order, order_block, {"__front": ("max", F.unix_micros(ts))},
                         inclusive=False)
    forward = front.withColumn("__us", F.unix_micros(ts)).filter(
        F.col("__front").isNull() | (F.col("__us") > F.col("__front"))).drop("__front")
    # Read three times below, so it is materialised once.
    forward = durable(forward.withColumn("__tb", time_block(ts, block_s)))
    ends = forward.agg(F.min("__tb").alias("lo"), F.max("__tb").alias("hi")).first()
    if ends["lo"] is None:
        return forward.select(*df.columns)
    blocks = forward.groupBy(*keys, (F.col("__tb") - ends["lo"]).alias("__b")).agg(
        F.array_sort(F.collect_list("__us")).alias("__t"))
    times = F.col("__t")
    hops = F.sequence(F.lit(1), F.lit(-(-block_s // seconds)))
    # A small share of the rows; every level above is computed from it.
    maps = durable(blocks.select(*keys, "__b", _exits(times, step, hops).alias("__x")).select(*keys, "__b", "__x.*"))
    entered = _entered(maps, keys, step, ends["hi"] - ends["lo"] + 1)
    start = F.struct(F.col("__enter").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    folded = F.aggregate(times, start, lambda acc, t: F.when(
        t >= acc["last"] + step,
        F.struct(t.alias("last"), F.array_append(acc["kept"], t).alias("kept"))).otherwise(acc))
    kept = blocks.join(entered, [*keys, "__b"]).select(*keys, F.explode(folded["kept"]).alias("__us"))
    return forward.join(kept, [*keys, "__us"], "left_semi").select(*df.columns)


def _first_at_least(ordered: Column, value: Column) -> Column:
    """Position of the first element of an ordered array that is not below ``value``; its size if none is."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(ordered, middle) < value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below, s["hi"]).otherwise(middle).alias("hi")))

    size = F.size(ordered)
    rounds = F.sequence(F.lit(1), F.length(F.bin(size.cast("bigint"))))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda s: s["lo"])


def _entries(times: Column, step: int) -> Column:
    """Times at which a chain that kept a row before them all may go on: up to the first a step after the first."""
    return F.filter(times, lambda t, i: (i == 0) | (F.get(times, i - 1) < F.get(times, F.lit(0)) + step))


def _exits(times: Column, step: int, hops: Column) -> Column:
    """The map of a block: its entries, and the last time that a chain from each of them keeps."""
    def last_kept(entry: Column) -> Column:
        return F.aggregate(hops, entry, lambda last, _: F.coalesce(
            F.get(times, _first_at_least(times, last + step)), last))

    entries = _entries(times, step)
    return F.struct(entries.alias("upto"), F.transform(entries, last_kept).alias("leave"))


def _through(last: Column, block: Column, step: int) -> Column:
    """The last time kept after a block, given the last one kept before it."""
    at = _first_at_least(block["upto"], last + step)
    return F.coalesce(F.get(block["leave"], at), last)


def _entered(maps: DataFrame, keys: Sequence[str], step: int, width: int) -> DataFrame:
    """(keys, __b, __enter): the last time kept before each block, from the maps of blocks 0 to ``width`` - 1."""
    levels = []
    while True:
        groups = maps.groupBy(*keys, F.floor(F.col("__b") / FANIN).alias("__p")).agg(
            F.array_sort(F.collect_list(F.struct("__b", "upto", "leave"))).alias("__c"))
        levels.append(groups)
        width = -(-width // FANIN)
        if width <= 1:
            break
        entries = _entries(F.flatten(F.transform("__c", lambda c: c["upto"])), step)
        composed = groups.withColumn("upto", entries).withColumn("leave", F.transform("upto", lambda e: F.aggregate(
            "__c", e - step, lambda last, c: _through(last, c, step))))
        maps = composed.select(*keys, F.col("__p").alias("__b"), "upto", "leave")

    entered = None
    for groups in reversed(levels):
        if entered is None:
            known = groups.withColumn("__enter", F.lit(NOTHING_KEPT))
        else:
            known = groups.join(entered.withColumnRenamed("__b", "__p"), [*keys, "__p"])
        nothing = F.array().cast("array<struct<__b:bigint,__enter:bigint>>")
        begin = F.struct(F.col("__enter").alias("last"), nothing.alias("seen"))
        walked = F.aggregate("__c", begin, lambda s, c: F.struct(
            _through(s["last"], c, step).alias("last"),
            F.array_append(s["seen"], F.struct(c["__b"].alias("__b"), s["last"].alias("__enter"))).alias("seen")))
        entered = known.select(*keys, F.inline(walked["seen"]))
    return entered
