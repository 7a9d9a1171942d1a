"""Live-feed operators: current state, positions, search, viewport and wire rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import as_col
from updraft.operators.blocks import number_block, time_block, with_running, with_shifted
from updraft.operators.joins import salted_join

Bounds = tuple[float, float, float, float]
# Rows of the feed in a block of run starts.
RUN_BLOCK_ROWS = 1 << 16


def latest_by(df: DataFrame, keys: Sequence[str], order: str = "seq",
              first_seen: str | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key.

    One aggregate with map-side combine: a key that owns most of the rows leaves
    each map task as a single row.
    """
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), order).alias("__row")]
    if first_seen:
        aggs.append(F.min(order).alias(first_seen))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "__row.*", *([first_seen] if first_seen else []))


def with_run_start(df: DataFrame, ttl_s: int, ts: str = "ts", order: str = "seq",
                   name: str = "first_seen") -> DataFrame:
    """Add where each row's run began: the order of the first row after the last silence.

    A silence is ``ttl_s`` seconds or more between two reports of an aircraft. Both
    steps work in blocks of the order, so a busy aircraft is spread over tasks.
    """
    block = number_block(order, RUN_BLOCK_ROWS)
    lagged = with_shifted(df, ["id"], [order], block, {"__prev": (F.unix_micros(ts), 1)})
    silent = F.coalesce(F.unix_micros(ts) - F.col("__prev") >= ttl_s * 1_000_000, F.lit(True))
    return with_running(lagged, ["id"], [order], block,
                        {name: ("last", F.when(silent, F.col(order)))}).drop("__prev")


def live_state(df: DataFrame, asof, ttl_s: int = K.LIVE_TTL_S, ts: str = "ts",
               order: str = "seq") -> DataFrame:
    """Latest row per aircraft heard less than ``ttl_s`` ago, with its feed order.

    ``first_seen`` is where the aircraft entered the live table: the start of its
    current run without a silence of ``ttl_s``, which may lie before the window.
    """
    now = F.lit(asof)
    if isinstance(asof, (int, float)):
        past, fresh = F.col(ts) <= now, F.col(ts) > now - F.lit(ttl_s)
    else:
        now = now.cast("timestamp")
        past, fresh = F.col(ts) <= now, F.col(ts) > now - F.expr(f"INTERVAL {ttl_s} SECONDS")
    runs = with_run_start(df.filter(past), ttl_s, ts, order)
    return latest_by(runs.filter(fresh), ["id"], order)


def live_snapshots(df: DataFrame, every_s: int = K.LIVE_TTL_S, ts: str = "ts",
                   order: str = "seq") -> DataFrame:
    """Live tables at the end of every ``every_s`` cycle, in one pass.

    ``cycle`` ends at cycle x every_s; with the default, a cycle's table is what
    ``live_state`` returns at that instant.
    """
    us = F.unix_micros(ts)
    cycle = F.ceil(us / F.lit(every_s * 1_000_000)).cast("bigint")
    runs = with_run_start(df, every_s, ts, order)
    return latest_by(runs.withColumn("cycle", cycle), ["cycle", "id"], order)


def positions_since(df: DataFrame, cursor: int, cap: int | None = None,
                    order: str = "seq") -> DataFrame:
    """Positions after a read cursor: all, or the newest ``cap`` per aircraft if asked for.

    ``seq > cursor`` is pushed to the scan, and a per-id limit is applied in each
    map task before the shuffle.
    """
    new = df.filter(F.col(order) > cursor).select("id", "lat", "lon", "alt", order)
    if cap is None:
        return new
    newest = Window.partitionBy("id").orderBy(F.col(order).desc())
    return (new.withColumn("__n", F.row_number().over(newest))
            .filter(F.col("__n") <= cap).drop("__n"))

def cursor_head(df: DataFrame, order: str = "seq") -> DataFrame:
    """Where a new reader starts."""
    return df.agg(F.coalesce(F.max(order), F.lit(0).cast("bigint")).alias("cursor"))


def path_tail(df: DataFrame, cap: int = K.PATH_CAP, order: str = "seq") -> DataFrame:
    """The newest ``cap`` positions of each path."""
    return positions_since(df, -1, cap, order)


def parse_bounds(raw: object) -> Bounds | None:
    """A validated viewport, or None for "no filter".

    Anything malformed, inverted or spanning the whole globe means no filter.
    """
    if not isinstance(raw, Mapping):
        return None
    try:
        south, north, west, east = (
            float(raw[k]) for k in ("lat_min", "lat_max", "lon_min", "lon_max"))
    except (KeyError, TypeError, ValueError):
        return None
    ordered = south <= north and west <= east
    return (south, north, west, east) if ordered and east - west < 360.0 else None


def pad_bounds(bounds: Bounds, share: float = 0.25) -> Bounds:
    """A viewport grown by a share of its size on every side."""
    south, north, west, east = bounds
    dy, dx = (north - south) * share, (east - west) * share
    return south - dy, north + dy, west - dx, east + dx


def in_viewport(df: DataFrame, bounds: Bounds | None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside a viewport that may reach across the date line."""
    if bounds is None:
        return df
    south, north, west, east = bounds
    shown = F.col(lon)
    turns = (0.0, 360.0, -360.0)
    exact = reduce(or_, [(shown + F.lit(t)).between(west, east) for t in turns])
    # The same test on the bare column, a hair wider, is what can reach the scan.
    bare = reduce(or_, [shown.between(west - t - 1e-6, east - t + 1e-6) for t in turns])
    return df.filter(F.col(lat).between(south, north) & bare & exact)


def visible_positions(positions: DataFrame, visible: DataFrame) -> DataFrame:
    """Positions of the aircraft that are shown."""
    return positions.join(visible.select("id"), "id", "left_semi")


def search_ids(df: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Substring search on id: prefix hits first, then by id."""
    needle = query.strip().lower()
    wanted = max(0, min(limit, K.SEARCH_CAP))
    if not needle or wanted == 0:
        return df.limit(0)
    low = F.lower("id")
    return (df.filter(low.contains(needle))
            .orderBy((~low.startswith(needle)).cast("int"), "id").limit(wanted))


def by_id(df: DataFrame, wanted: str) -> DataFrame:
    """One aircraft by exact id; an unknown id gives no rows."""
    return df.filter(F.col("id") == wanted)


def to_wire(df: DataFrame) -> DataFrame:
    """The columns a client reads, coordinates at 5 decimals."""
    present = [c for c in K.WIRE_FIELDS if c in df.columns]
    return df.select(*[
        F.bround(c, K.COORD_DP).alias(c) if c in ("lat", "lon") else F.col(c) for c in present])


def positions_to_wire(df: DataFrame) -> DataFrame:
    """Positions as sent: no sequence numbers, coordinates at 5 decimals."""
    return df.select("id", F.bround("lat", K.COORD_DP).alias("lat"),
                     F.bround("lon", K.COORD_DP).alias("lon"), "alt")


def traffic_counts(df: DataFrame, visible: Column) -> DataFrame:
    """How many aircraft circle, tow, are shown and exist."""
    shown = F.coalesce(visible, F.lit(False))
    return df.agg(
        F.count_if(shown & F.col("circling")).alias("circling"),
        F.count_if(shown & F.col("is_tow")).alias("tow"),
        F.count_if(shown).alias("visible"), F.count(F.lit(1)).alias("total"))


def position_stamps(frames: DataFrame, block_frames: int = 3600, frame: str = "frame",
                    ts: str = "ts") -> DataFrame:
    """When each aircraft's position last changed, per frame (``rx``).

    NULL on first sight, and again after a frame the aircraft was missing from.
    """
    block = F.floor(F.col(frame) / F.lit(block_frames)).cast("bigint")
    here = F.struct("lat", "lon", frame)
    seen = with_shifted(frames, ["id"], [frame], block, {"__prev": (here, 1)})
    known = F.col("__prev").isNotNull() & (F.col(f"__prev.{frame}") == F.col(frame) - 1)
    moved = (F.col("__prev.lat") != F.col("lat")) | (F.col("__prev.lon") != F.col("lon"))
    event = (F.when(~known, F.struct(F.lit(None).cast("timestamp").alias("rx")))
             .when(moved, F.struct(F.col(ts).cast("timestamp").alias("rx"))))
    marked = with_running(seen, ["id"], [frame], block, {"__mark": ("last", event)})
    return marked.select(*frames.columns, F.col("__mark.rx").alias("rx"))


def merge_track(stored: DataFrame, live: DataFrame, order: str = "seq") -> DataFrame:
    """Stored track followed by the live tail without its duplicates.

    Live rows within 1e-6 degree of an aircraft's last stored row are dropped.
    """
    last = stored.groupBy("id").agg(F.max_by("lat", order).alias("__lat"),
                                    F.max_by("lon", order).alias("__lon"))
    columns = ["id", "lat", "lon", "alt", order]
    near = (F.abs(F.col("lat") - F.col("__lat")) <= 1e-6) & (F.abs(F.col("lon") - F.col("__lon")) <= 1e-6)
    tail = salted_join(live.select(*columns), last, ["id"], "left").filter(
        ~F.coalesce(near, F.lit(False))).select(*columns)
    return (stored.select(*columns, F.lit(0).alias("part"))
            .unionByName(tail.withColumn("part", F.lit(1))))


def prefer_streamed(streamed: DataFrame, polled: DataFrame) -> DataFrame:
    """One row per id: the streamed copy where there is one, else the polled one."""
    rest = [c for c in streamed.columns if c != "id"]
    left = streamed.select("id", F.struct(*rest).alias("__s"))
    right = polled.select("id", F.struct(*rest).alias("__p"))
    return left.join(right, "id", "full_outer").select(
        "id", F.coalesce("__s", "__p").alias("__r")).select("id", "__r.*")


def current_segment(df: DataFrame, asof, gap_s: int = K.TRACK_GAP_S,
                    lookback_s: int = K.TRACK_LOOKBACK_S, ts: str = "ts", order: str = "seq",
                    block_s: int = 3600) -> DataFrame:
    """Each aircraft's current flight: rows after its last gap longer than ``gap_s``.

    Gap ends come from block-wise lags; per aircraft only the latest one matters,
    which is a max aggregate.
    """
    end = F.lit(asof).cast("timestamp")
    recent = df.filter((F.col(ts) >= end - F.expr(f"INTERVAL {lookback_s} SECONDS")) & (F.col(ts) <= end))
    lagged = with_shifted(recent, ["id"], [ts, order], time_block(ts, block_s),
                          {"__prev": (F.col(ts), 1)})
    silent = F.unix_micros(as_col(ts)) - F.unix_micros("__prev") > gap_s * 1_000_000
    cuts = lagged.groupBy("id").agg(F.max(F.when(silent, F.col(ts))).alias("__cut"))
    return salted_join(recent, cuts, ["id"], "left").filter(
        F.col("__cut").isNull() | (F.col(ts) >= F.col("__cut"))).drop("__cut")
