"""Whole grids as arrays: the cells of one request at a time, a few array operations a grid.

Follows ``terrain.grid_rows``, ``terrain.grid_cells``, ``rules.terrain_multiplier`` and the
patterns of ``forest.Uncertainty`` operation by operation. Unknown numbers are NaN in the
arrays; where Spark tells null from NaN, a mask of the nulls goes along. The functions
travel to the workers by value, so a worker needs numpy and pyarrow alone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from updraft import constants as K
from updraft.operators.terrain import CELL_M, FINE, LEVEL, SIDE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAST = (SIDE - 1) * FINE
GRID_SIDE = LAST + 1
RADIUS, TERRAIN_RES, DECIMALS = K.GRID_RADIUS, K.TERRAIN_RES, K.PROB_DP
STEP = 2 * RADIUS / LAST
NOISE = {name: (kind, scale) for name, kind, scale in K.NOISE}
AT = np.arange(GRID_SIDE)
LOW = np.minimum(AT // FINE, SIDE - 2)         # lattice row or column before each grid row or column
SHARE = AT / float(FINE) - LOW
INSIDE = (AT - LOW * FINE) / float(FINE)
UP, DOWN = np.minimum(AT + 1, LAST), np.maximum(AT - 1, 0)
SEAMS = np.arange(FINE, LAST, FINE)            # grid columns on inner lattice columns
FEW = 8                # thresholds of a feature that are compared one by one
TABLE = 1 << 18        # pattern numbers below this are told apart by a table
BLOCK = 4096           # patterns whose draws are evaluated at once


# --- Cells ---------------------------------------------------------------------------

def window_rows(window: np.ndarray) -> np.ndarray:
    """A lattice window at the grid's rows (201 x 11)."""
    share = SHARE[:, None]
    return window[LOW] * (1.0 - share) + window[LOW + 1] * share


def at_columns(rows: np.ndarray) -> np.ndarray:
    """Numbers at the lattice columns of each grid row, at all grid columns."""
    first = np.take(rows, LOW, axis=1)
    return first + (np.take(rows, LOW + 1, axis=1) - first) * INSIDE


def either(holes: np.ndarray) -> np.ndarray:
    """Where a number between two lattice columns has a hole on one side."""
    return holes[:, LOW] | holes[:, LOW + 1]


def terrain_cells(window: np.ndarray, holes: np.ndarray | None, centre_lat: float | None):
    """(elevation, slope, aspect, elevation nulls, slope and aspect nulls) of a grid.

    ``holes`` are the window's nulls, None without any; so are the two masks.
    """
    rows = window_rows(window)
    span = ((UP - DOWN) * CELL_M)[:, None]
    wide = 1e-6 if centre_lat is None else max(CELL_M * np.cos(np.radians(centre_lat)), 1e-6)
    square = float(FINE) * wide
    gy = at_columns((rows[UP] - rows[DOWN]) / span)
    gx = np.take((rows[:, 1:] - rows[:, :-1]) / square, LOW, axis=1)
    seam = (rows[:, 2:] - rows[:, :-2]) / (2.0 * square)
    level_null = tilt_null = None
    if holes is None:
        gx[:, SEAMS] = seam
    else:
        row_holes = holes[LOW] | holes[LOW + 1]
        level_null = either(row_holes)
        known = ~row_holes[:, :-2]
        gx[:, SEAMS] = np.where(known, seam, gx[:, SEAMS])
        across = level_null.copy()
        across[:, SEAMS] = np.where(known, row_holes[:, 2:], across[:, SEAMS])
        tilt_null = across | either(row_holes[UP] | row_holes[DOWN])
    steep = gx * gx + gy * gy
    slope = np.degrees(np.arctan(np.sqrt(steep)))
    bearing = np.degrees(np.arctan2(-gx + 0.0, -gy + 0.0))
    bearing += np.where(bearing < 0, 360.0, 0.0)
    bearing[steep < LEVEL * LEVEL] = 180.0
    return at_columns(rows), slope, bearing, level_null, tilt_null


def terrain_factor(elevation: np.ndarray, slope: np.ndarray, aspect: np.ndarray,
                   level_null: np.ndarray | None) -> np.ndarray:
    """``rules.terrain_multiplier``; least and greatest take a NaN for the largest number and skip nulls."""
    facing = 0.75 + 0.25 * np.cos(np.radians(aspect - 180.0))
    steep = np.fmin(np.maximum(1.0 + slope / 45.0, 1.0), 1.4)
    high = np.fmin(np.maximum(1.0 + elevation / 800.0, 1.0), 1.25)
    if level_null is not None:
        high[level_null] = 1.0
    return facing * steep * high


def rounded_half_even(values: np.ndarray) -> np.ndarray:
    """``rules.round_probability``: ties are those of the shortest decimal text."""
    scale = 10.0 ** DECIMALS
    scaled = values * scale
    whole = np.rint(scaled)
    out = whole / scale
    for i in np.flatnonzero(np.abs(np.abs(scaled - whole) - 0.5) < 1e-9):
        text = Decimal(repr(float(values.flat[i])))
        out.flat[i] = float(text.quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_EVEN))
    return out


# --- Patterns ------------------------------------------------------------------------

def passed(thresholds: np.ndarray, values) -> np.ndarray:
    """How many of the ordered thresholds a value is not at or below; all of them for NaN."""
    values = np.asarray(values, dtype="float64")
    if len(thresholds) > FEW:
        return np.searchsorted(thresholds, values, side="left")
    count = np.zeros(values.shape, dtype="int64")
    for threshold in thresholds:
        count += ~(values <= threshold)
    return count


def patterns(thresholds: dict[str, np.ndarray], columns: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(each cell's pattern number, per feature how many thresholds each pattern has passed)."""
    counts = {name: passed(cuts, columns[name]) for name, cuts in thresholds.items()}
    number, known = np.zeros((GRID_SIDE, GRID_SIDE), dtype="int64"), 1

    def numbered() -> tuple[np.ndarray, np.ndarray]:
        """Numbers without gaps, and a cell that has each."""
        flat = number.ravel()
        if known > TABLE:
            _, cell, dense = np.unique(flat, return_index=True, return_inverse=True)
            return dense.reshape(number.shape), cell
        cell = np.full(known, -1)
        cell[flat] = np.arange(flat.size)
        seen = np.flatnonzero(cell >= 0)
        dense = np.zeros(known, dtype="int64")
        dense[seen] = np.arange(len(seen))
        return dense[number], cell[seen]

    for name, count in counts.items():
        if known > TABLE:
            number, cell = numbered()
            known = len(cell)
        number = number * (len(thresholds[name]) + 1) + count
        known *= len(thresholds[name]) + 1
    number, cell = numbered()
    return number, {name: np.broadcast_to(count, number.shape).ravel()[cell] for name, count in counts.items()}


def drawn_weather(seed: int, key: str, weather: dict[str, float | None], draws: int) -> dict[str, np.ndarray]:
    """Each noisy column under each draw, by the hashes of ``montecarlo.noise_draws``; NaN if unknown."""
    moved = {}
    for name, value in weather.items():
        kind, scale = NOISE[name]
        hashed = [[int(sha256(f"{seed}|{key}|{d}|{name}|{u}".encode()).hexdigest()[:13], 16) for d in range(1, draws + 1)]
                  for u in (1, 2)]
        first, second = (np.array(hashed, dtype="float64") + 0.5) / float(16 ** 13)
        noise = np.sqrt(-2.0 * np.log(first)) * np.cos(2.0 * np.pi * second) * scale
        value = np.nan if value is None else value
        moved[name] = value * (1.0 + noise) if kind == "rel" else value + noise
    return moved


def tree_draws(node, counts: dict[str, np.ndarray], moved: dict[str, np.ndarray]):
    """A planned tree's value by draw (down) and pattern (across)."""
    if isinstance(node, float):
        return node
    name, cut, low, high = node
    goes_low = (moved[name] <= cut)[:, None] if name in moved else counts[name] <= cut
    return np.where(goes_low, tree_draws(low, counts, moved), tree_draws(high, counts, moved))


def pattern_moments(trees: list, draws: int, counts: dict[str, np.ndarray], n: int,
                    moved: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the probability over the draws, per pattern."""
    means, deviations = np.empty(n), np.empty(n)
    for start in range(0, n, BLOCK):
        part = slice(start, min(start + BLOCK, n))
        here = {name: count[part] for name, count in counts.items()}
        margin = 0.0
        for tree in trees:
            margin = margin + tree_draws(tree, here, moved)
        runs = 1.0 / (1.0 + np.exp(-2.0 * np.broadcast_to(margin, (draws, part.stop - start))))
        off = runs - runs[0]
        first, second = off.sum(axis=0) / draws, (off * off).sum(axis=0) / draws
        means[part] = np.fmin(np.maximum(runs[0] + first, 0.0), 1.0)
        deviations[part] = np.sqrt(np.maximum(second - first * first, 0.0))
    return means, deviations


# --- Grids in and out ----------------------------------------------------------------

def numbers(scalar: pa.Scalar, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray | None]:
    """(numbers, nulls) of a list; an unknown list is all unknown."""
    if not scalar.is_valid:
        return np.full(shape, np.nan), np.ones(shape, dtype=bool)
    array = scalar.values
    nulls = array.is_null().to_numpy(zero_copy_only=False).reshape(shape) if array.null_count else None
    return array.to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(shape), nulls


def boost_cells(scalar: pa.Scalar) -> np.ndarray | None:
    """A grid's boosts from the map of its rows; None where nothing climbs."""
    if not scalar.is_valid or not len(scalar.values):
        return None
    rows, lists = scalar.values.field(0), scalar.values.field(1)
    cells = np.zeros((GRID_SIDE, GRID_SIDE))
    cells[rows.to_numpy()] = lists.flatten().fill_null(0.0).to_numpy().reshape(len(rows), GRID_SIDE)
    return cells


def grid_heat(row: dict[str, pa.Scalar], thresholds: dict[str, np.ndarray], trees: list, noisy: tuple[str, ...],
              draws: int, seed: int, layers: dict[str, float | None], timed: tuple[str, ...],
              rounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """p_mean, p_std and the nulls of p_std of the cells of one grid.

    ``layers`` are land-cover columns: a constant, or None where the row has their window.
    """
    square = (SIDE, SIDE)
    window, holes = numbers(row["elevation_window"], square)
    c_i, c_j, alt = row["c_i"].as_py(), row["c_j"].as_py(), row["alt_amsl"].as_py()
    elevation, slope, aspect, level_null, tilt_null = terrain_cells(
        window, holes, None if c_i is None else c_i * TERRAIN_RES)
    shape = elevation.shape
    lat, lon = (np.full(GRID_SIDE, np.nan) if c is None else c * TERRAIN_RES - RADIUS + AT * STEP for c in (c_i, c_j))
    agl = np.zeros(shape) if alt is None else np.maximum(0.0, alt - elevation)
    if level_null is not None:
        agl[level_null] = 0.0
    columns = {"lat": lat[:, None], "lon": lon, "elevation": elevation, "slope": slope, "aspect": aspect, "alt_agl": agl}
    for name in timed:
        columns[name] = np.nan if row[name].as_py() is None else row[name].as_py()
    for name, constant in layers.items():
        if name in thresholds:
            columns[name] = constant if constant is not None else at_columns(
                window_rows(numbers(row[f"{name}_window"], square)[0]))

    moved = drawn_weather(seed, row["noise_key"].as_py(), {n: row[n].as_py() for n in noisy}, draws)
    number, counts = patterns(thresholds, columns)
    means, deviations = pattern_moments(trees, draws, counts, int(number.max()) + 1, moved)
    factor = terrain_factor(elevation, slope, aspect, level_null)
    mean = np.fmin(np.maximum(means[number] * factor, 0.0), 1.0)
    deviation = deviations[number] * factor
    if tilt_null is not None:
        mean[tilt_null] = 0.0
    if "boosts" in row:
        boosts = boost_cells(row["boosts"])
        if boosts is not None:
            mean = np.fmin(np.maximum(mean + boosts, 0.0), 1.0)
    if rounded:
        mean, deviation = rounded_half_even(mean), rounded_half_even(deviation)
    return mean, deviation, tilt_null


def heat_rows(grids: DataFrame, key: str, *settings) -> DataFrame:
    """(key, c_i, c_j, row, means, deviations): the grid rows of ``grids``, made where their grid lies.

    ``grids`` have c_i, c_j, alt_amsl, noise_key (the key as text), their lattice windows and the
    columns that ``settings``, those of ``grid_heat``, name; boosts where climbs are blended in.
    """
    cells = ArrayType(DoubleType())
    schema = StructType([*[grids.schema[c] for c in (key, "c_i", "c_j")], StructField("row", IntegerType()),
                         StructField("means", cells), StructField("deviations", cells)])
    return grids.mapInArrow(_maker(key, *settings), schema)


def _maker(key: str, *settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ends = pa.array(AT.astype("int32")), pa.array(np.arange(0, GRID_SIDE ** 2 + 1, GRID_SIDE, dtype="int32"))
        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                    mean, deviation, nulls = grid_heat(row, *settings)
                    spread = pa.array(deviation.ravel(), mask=None if nulls is None else nulls.ravel())
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.repeat(row[c], GRID_SIDE) for c in (key, "c_i", "c_j")], rows,
                         pa.ListArray.from_arrays(ends, pa.array(mean.ravel())), pa.ListArray.from_arrays(ends, spread)],
                        names=[key, "c_i", "c_j", "row", "means", "deviations"])

    return make


def heat_cells(rows: DataFrame, key: str) -> DataFrame:
    """The cells of ``heat_rows``: (key, row, col, lat, lon, p_mean, p_std)."""
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(LAST))))
    return cells.select(
        key, "row", "col", (F.col("c_i") * TERRAIN_RES - RADIUS + F.col("row") * STEP).alias("lat"),
        (F.col("c_j") * TERRAIN_RES - RADIUS + F.col("col") * STEP).alias("lon"),
        F.get("means", F.col("col")).alias("p_mean"), F.get("deviations", F.col("col")).alias("p_std"))
