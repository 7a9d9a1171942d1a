"""Ground elevation, grids and terrain shape.

A fine grid is never stored. It is a bilinear view of the 0.01-degree lattice,
so a request carries its lattice window (121 numbers) and every cell computes
what it needs from that: no shuffle happens at cell level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import grid_side, lattice_index, point_key
from updraft.operators.joins import salted_join

# Fine cells per lattice step (0.01 / 0.0005).
FINE = round(K.TERRAIN_RES / K.GRID_RES)
HALF_WINDOW = round(K.GRID_RADIUS / K.TERRAIN_RES)
SIDE = 2 * HALF_WINDOW + 1
CELL_M = K.GRID_RES * K.METRES_PER_DEGREE
LEVEL = 1e-9


# --- Point lookups -----------------------------------------------------------

def with_ground(df: DataFrame, elevations: DataFrame, dp: int = K.COARSE_DP,
                name: str = "ground") -> DataFrame:
    """Ground elevation at the point rounded to ``dp`` decimals; NULL on a miss.

    ``elevations`` is keyed by integer (lat_e4, lon_e4). A null stored elevation
    reads 0.
    """
    scale = 10 ** (4 - dp)
    known = elevations.select(
        F.col("lat_e4").alias("__ky"), F.col("lon_e4").alias("__kx"),
        F.coalesce("elevation", F.lit(0)).alias(name))
    keyed = df.withColumn("__ky", point_key("lat", dp) * scale).withColumn(
        "__kx", point_key("lon", dp) * scale)
    return salted_join(keyed, known, ["__ky", "__kx"], "left").drop("__ky", "__kx")


def with_agl(df: DataFrame, elevations: DataFrame, dedupe: tuple[str, ...] = ("id", "seq")) -> DataFrame:
    """Height above ground at two resolutions.

    Slow aircraft that the coarse lattice puts near the ground use the fine
    point where one is known (0 m counts). The others do not take part in the
    fine lookup: their key is a hash of their own identity, which spreads them
    evenly and never matches.
    """
    coarse = with_ground(df, elevations, K.COARSE_DP, "__coarse")
    wants = ((F.col("alt") - F.col("__coarse") <= K.PRECISE_BAND_M)
             & (F.coalesce("speed_kmh", F.lit(0)) <= K.PRECISE_MAX_KMH))
    asked = F.coalesce(wants, F.lit(False))
    fine = elevations.select(
        F.lit(True).alias("__asked"), F.col("lat_e4").alias("__ky"), F.col("lon_e4").alias("__kx"),
        F.coalesce("elevation", F.lit(0)).alias("__fine"))
    keyed = coarse.select(
        "*", asked.alias("__asked"),
        F.when(asked, point_key("lat", K.PRECISE_DP)).otherwise(F.xxhash64(*dedupe)).alias("__ky"),
        F.when(asked, point_key("lon", K.PRECISE_DP)).otherwise(F.lit(0)).cast("bigint").alias("__kx"))
    joined = salted_join(keyed, fine, ["__asked", "__ky", "__kx"], "left")
    return joined.withColumn("agl", F.col("alt") - F.coalesce("__fine", "__coarse")).drop(
        "__coarse", "__fine", "__asked", "__ky", "__kx")


def plan_lookups(df: DataFrame, elevations: DataFrame, max_chunks: int = 2,
                 dp: int = K.COARSE_DP, order: str = "seq") -> DataFrame:
    """Points whose elevation should be asked for next, in request chunks of 100.

    Distinct unknown points in order of first appearance; the budget is at most
    ``max_chunks`` chunks, so only that many rows are ever ranked.
    """
    scale = 10 ** (4 - dp)
    wanted = df.select((point_key("lat", dp) * scale).alias("lat_e4"),
                       (point_key("lon", dp) * scale).alias("lon_e4"), order)
    first = wanted.groupBy("lat_e4", "lon_e4").agg(F.min(order).alias("first_order"))
    unknown = first.join(elevations.select("lat_e4", "lon_e4"), ["lat_e4", "lon_e4"], "left_anti")
    budget = unknown.orderBy("first_order", "lat_e4", "lon_e4").limit(max_chunks * K.ELEVATION_CHUNK)
    rank = F.row_number().over(Window.orderBy("first_order", "lat_e4", "lon_e4"))
    return budget.select(
        "lat_e4", "lon_e4", "first_order",
        F.floor((rank - 1) / F.lit(K.ELEVATION_CHUNK)).cast("int").alias("chunk"))


# --- Lattice windows ---------------------------------------------------------

def with_centre(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the snapped grid centre as lattice indices (c_i, c_j)."""
    return df.withColumn("c_i", lattice_index(lat)).withColumn("c_j", lattice_index(lon))


def lattice_windows(centres: DataFrame, lattice: DataFrame, half: int = HALF_WINDOW,
                    values: tuple[str, ...] = ("elevation",)) -> DataFrame:
    """Square lattice windows around distinct centres, as row-major arrays.

    South to north, west to east. A centre whose window has a hole gives no row.
    Each array holds (2 half + 1)^2 numbers.
    """
    steps = F.sequence(F.lit(-half), F.lit(half))
    side = 2 * half + 1
    points = (centres.select("c_i", "c_j").distinct()
              .withColumn("__a", F.explode(steps)).withColumn("__b", F.explode(steps))
              .withColumn("lat_i", F.col("c_i") + F.col("__a"))
              .withColumn("lon_j", F.col("c_j") + F.col("__b")))
    position = (F.col("__a") + half) * side + F.col("__b") + half
    found = points.join(lattice.select("lat_i", "lon_j", *values), ["lat_i", "lon_j"]).groupBy(
        "c_i", "c_j").agg(F.collect_list(F.struct(
            position.alias("k"), *[F.col(v).cast("double").alias(v) for v in values])).alias("__w"))
    ordered = F.array_sort("__w")
    return found.filter(F.size("__w") == side * side).withColumn("__w", ordered).select(
        "c_i", "c_j", *[F.col(f"__w.{v}").alias(f"{v}_window") for v in values])


def with_windows(df: DataFrame, lattice: DataFrame, half: int = HALF_WINDOW,
                 missing: str = "drop", values: tuple[str, ...] = ("elevation",),
                 fill: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``df`` (with c_i, c_j) and the lattice window of each row's centre.

    ``missing="fill"`` gives rows without a complete window a constant one, the
    documented fallback for unknown terrain; ``"drop"`` leaves them out.
    """
    windows = lattice_windows(df, lattice, half, values)
    joined = salted_join(df, windows, ["c_i", "c_j"], "inner" if missing == "drop" else "left")
    if missing == "drop":
        return joined
    n = (2 * half + 1) ** 2
    for value, constant in zip(values, fill):
        joined = joined.withColumn(f"{value}_window", F.coalesce(
            f"{value}_window", F.array_repeat(F.lit(float(constant)), n)))
    return joined


def bilinear(window: Column, side: int, y: Column, x: Column) -> Column:
    """Value of a row-major lattice window at fractional indices (y, x)."""
    y0 = F.least(F.floor(y), F.lit(side - 2)).cast("int")
    x0 = F.least(F.floor(x), F.lit(side - 2)).cast("int")
    dy, dx = y - y0, x - x0

    def at(i: Column, j: Column) -> Column:
        return F.get(window, i * side + j)

    return ((at(y0, x0) * (1.0 - dx) + at(y0, x0 + 1) * dx) * (1.0 - dy)
            + (at(y0 + 1, x0) * (1.0 - dx) + at(y0 + 1, x0 + 1) * dx) * dy)


def window_mean(window: Column, side: int = SIDE, fine: int = FINE) -> Column:
    """Mean of the upsampled grid, from its lattice window alone.

    Each lattice point's share of the fine cells is fixed, so no cell is built.
    """
    points = (side - 1) * fine + 1
    share = [(fine + 1) / 2 if k in (0, side - 1) else float(fine) for k in range(side)]
    weights = F.array(*[F.lit(a * b / points ** 2) for a in share for b in share])
    return F.aggregate(F.zip_with(window, weights, lambda e, w: e * w), F.lit(0.0), lambda s, v: s + v)


def tilt(gx: Column, gy: Column) -> tuple[Column, Column]:
    """(slope, aspect) in degrees from the eastward and northward gradients.

    Aspect is the compass bearing the slope faces (downhill). Level ground reads
    180, which is what signed zeros give; Spark's atan2 drops the sign of zero.
    Gradients under a nanometre per metre are rounding noise and count as level.
    """
    steep = gx * gx + gy * gy
    slope = F.degrees(F.atan(F.sqrt(steep)))
    bearing = F.degrees(F.atan2(-gx, -gy))
    return slope, (F.when(steep < LEVEL * LEVEL, F.lit(180.0))
                   .when(bearing < 0, bearing + F.lit(360.0)).otherwise(bearing))


def slope_aspect(north: Column, south: Column, east: Column, west: Column,
                 ns_span: Column, ew_span: Column) -> tuple[Column, Column]:
    """(slope, aspect) from neighbouring elevations and the distances they span."""
    return tilt((east - west) / ew_span, (north - south) / ns_span)


def east_west_cell_m(lat: Column, cell_m: float = CELL_M) -> Column:
    """East-west size of a cell at a latitude."""
    return F.greatest(F.lit(cell_m) * F.cos(F.radians(lat)), F.lit(1e-6))


# --- Grids -------------------------------------------------------------------

def explode_grid(requests: DataFrame, radius: float = K.GRID_RADIUS,
                 res: float = K.GRID_RES) -> DataFrame:
    """All cells of the grids around (c_i, c_j): row, col, lat, lon.

    Edges are included; rows run north, columns run east.
    """
    last = grid_side(radius, res) - 1
    axis = F.sequence(F.lit(0), F.lit(last))
    step = 2 * radius / last
    return (requests.withColumn("row", F.explode(axis)).withColumn("col", F.explode(axis))
            .withColumn("lat", F.col("c_i") * K.TERRAIN_RES - radius + F.col("row") * step)
            .withColumn("lon", F.col("c_j") * K.TERRAIN_RES - radius + F.col("col") * step))


def spread(requests: DataFrame, by: tuple[str, ...] | None = None) -> DataFrame:
    """Requests over all tasks, one task a grid: windows cross the network once a request, rows and cells never.

    A few requests are a few kilobytes, which adaptive execution would fold into one
    task; the cells they turn into are not. The explicit count keeps the requests apart.
    """
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(tasks, *(by or (("request_id",) if "request_id" in requests.columns else ("c_i", "c_j"))))


def grid_rows(requests: DataFrame, values: tuple[str, ...] = ("elevation",),
              carried: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per grid row, each lattice window reduced to that row's ten squares.

    Along a grid row a value is linear between lattice columns, so a square is
    described by its two end values; for ``elevation`` also by the north-south
    gradient at both ends and the end value before it. A cell then needs
    neither an array nor a neighbour.

    ``carried`` maps a new column to (map column, key column): each grid row
    takes its own entry along instead of the whole map.
    """
    return rows_in_place(spread(requests), values, carried)


def rows_in_place(requests: DataFrame, values: tuple[str, ...] = ("elevation",),
                  carried: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``grid_rows`` of requests that are spread already."""
    last = (SIDE - 1) * FINE
    rows = requests.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(last))))
    for name, (source, key) in (carried or {}).items():
        rows = rows.withColumn(name, F.try_element_at(source, F.col(key))).drop(source)

    def vector(window: str, row: Column) -> Column:
        y = row / F.lit(float(FINE))
        low = F.least(F.floor(y), F.lit(SIDE - 2)).cast("int")
        share = y - low
        return F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda b: (
            F.get(F.col(window), low * SIDE + b) * (F.lit(1.0) - share)
            + F.get(F.col(window), (low + 1) * SIDE + b) * share))

    row = F.col("row")
    up, down = F.least(row + 1, F.lit(last)), F.greatest(row - 1, F.lit(0))
    span = (up - down) * F.lit(CELL_M)
    vectors = {f"__{v}": vector(f"{v}_window", row) for v in values}
    if "elevation" in values:
        vectors["__gy"] = F.zip_with(vector("elevation_window", up), vector("elevation_window", down),
                                     lambda n, s: (n - s) / span)
    kept = [c for c in rows.columns if c not in [f"{v}_window" for v in values]]
    shaped = rows.select(*kept, *[e.alias(n) for n, e in vectors.items()])

    def square(b: Column) -> Column:
        ends = [F.get(F.col(n), b + i).alias(f"{n}{i}") for n in vectors for i in (0, 1)]
        before = [F.get(F.col("__elevation"), b - 1).alias("__before")] if "elevation" in values else []
        return F.struct(b.alias("__b"), *ends, *before)

    squares = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 2)), square)
    return shaped.select(*kept, squares.alias("__squares"))


def grid_cells(rows: DataFrame, values: tuple[str, ...] = ("elevation",)) -> DataFrame:
    """Cells of prepared grid rows: values, and slope and aspect for elevation."""
    kept = [c for c in rows.columns if c != "__squares"]
    # Outer: a plain generator would get a "not empty" filter with a copy of the
    # whole array expression pushed below the shuffle.
    squares = rows.select(*kept, F.inline_outer("__squares"))
    inside, closing = (F.sequence(F.lit(0), F.lit(n)) for n in (FINE - 1, FINE))
    cells = squares.withColumn("__d", F.explode(
        F.when(F.col("__b") == SIDE - 2, closing).otherwise(inside)))
    share = F.col("__d") / F.lit(float(FINE))

    def between(name: str) -> Column:
        return F.col(f"__{name}0") + (F.col(f"__{name}1") - F.col(f"__{name}0")) * share

    step = 2 * K.GRID_RADIUS / ((SIDE - 1) * FINE)
    col = F.col("__b") * FINE + F.col("__d")
    added = [between(v).alias(v) for v in values]
    if "elevation" in values:
        # Inside a square the east-west gradient is constant; on an inner lattice
        # column it is the mean of the squares on either side.
        square_m = F.lit(float(FINE)) * east_west_cell_m(F.col("c_i") * K.TERRAIN_RES)
        seam = (F.col("__d") == 0) & F.col("__before").isNotNull()
        gx = F.when(seam, (F.col("__elevation1") - F.col("__before")) / (2.0 * square_m)).otherwise(
            (F.col("__elevation1") - F.col("__elevation0")) / square_m)
        slope, aspect = tilt(gx, between("gy"))
        added += [slope.alias("slope"), aspect.alias("aspect")]
    return cells.select(
        *kept, col.alias("col"),
        (F.col("c_i") * K.TERRAIN_RES - K.GRID_RADIUS + F.col("row") * step).alias("lat"),
        (F.col("c_j") * K.TERRAIN_RES - K.GRID_RADIUS + col * step).alias("lon"), *added)


def upsample(requests: DataFrame, lattice: DataFrame, missing: str = "drop") -> DataFrame:
    """Fine grids (elevation, slope, aspect) around each request's snapped centre."""
    centred = with_centre(requests).drop("lat", "lon")
    return grid_cells(grid_rows(with_windows(centred, lattice, missing=missing)))


def cell_terrain(window: Column, half: int, row: Column, col: Column,
                 centre_lat: Column) -> tuple[Column, Column, Column]:
    """(elevation, slope, aspect) of one fine cell, from a window around the centre.

    ``row`` and ``col`` count from the south-west corner of the 201 x 201 grid. A
    window of half width 1 is enough for cells within half a lattice step of
    the centre, which is where an observation's own cell always is.
    """
    side = 2 * half + 1
    last = (SIDE - 1) * FINE
    shift = HALF_WINDOW - half
    up, down = F.least(row + 1, F.lit(last)), F.greatest(row - 1, F.lit(0))
    right, left = F.least(col + 1, F.lit(last)), F.greatest(col - 1, F.lit(0))

    def at(r: Column, c: Column) -> Column:
        return bilinear(window, side, r / F.lit(float(FINE)) - shift, c / F.lit(float(FINE)) - shift)

    slope, aspect = slope_aspect(
        at(up, col), at(down, col), at(row, right), at(row, left),
        (up - down) * F.lit(CELL_M), (right - left) * east_west_cell_m(centre_lat))
    return at(row, col), slope, aspect


def with_slope_aspect(grid: DataFrame, keys: list[str], centre_lat: Column | None = None,
                      cell_m: float = CELL_M) -> DataFrame:
    """Slope and aspect of stored elevation grids (keys, row, col, elevation).

    Central differences inside, one-sided at the edges. Window partitions are
    single grid rows and columns.
    """
    across = Window.partitionBy(*keys, "row").orderBy("col")
    along = Window.partitionBy(*keys, "col").orderBy("row")
    here = F.col("elevation")
    east, west = F.lead(here).over(across), F.lag(here).over(across)
    north, south = F.lead(here).over(along), F.lag(here).over(along)

    def span(after: Column, before: Column) -> Column:
        return F.when(after.isNotNull(), 1).otherwise(0) + F.when(before.isNotNull(), 1).otherwise(0)

    ew_m = F.lit(cell_m) if centre_lat is None else east_west_cell_m(centre_lat, cell_m)
    slope, aspect = slope_aspect(
        F.coalesce(north, here), F.coalesce(south, here), F.coalesce(east, here), F.coalesce(west, here),
        span(north, south) * F.lit(cell_m), span(east, west) * ew_m)
    return grid.select("*", slope.alias("slope"), aspect.alias("aspect"))
