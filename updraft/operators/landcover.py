"""Land-cover properties on the terrain lattice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.geo import clip, weather_cell
from updraft.operators.blocks import computed_once
from updraft.operators.joins import salted_join
from updraft.operators.terrain import SIDE

# Heat and albedo are summed as whole numbers of this size, so that differences of large sums stay exact.
UNIT = 1_000_000
LAYERS = ("land_use_heat", "land_use_albedo")


def _lookup(value: Column, index: int, table: dict, default: float) -> Column:
    pairs = [F.lit(v) for key, props in table.items() for v in (key, props[index])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def class_heat(land_class: str | Column) -> Column:
    """Relative heat yield of a land-cover class (a constant map, no join)."""
    value = F.col(land_class) if isinstance(land_class, str) else land_class
    return _lookup(value.cast("int"), 0, K.LAND_CLASSES, K.LAND_DEFAULT[0])


def class_albedo(land_class: str | Column) -> Column:
    """Albedo of a land-cover class."""
    value = F.col(land_class) if isinstance(land_class, str) else land_class
    return _lookup(value.cast("int"), 1, K.LAND_CLASSES, K.LAND_DEFAULT[1])


def with_landcover_class(df: DataFrame, land_class: str = "class") -> DataFrame:
    """Heat and albedo of each row's class."""
    return df.select("*", class_heat(land_class).alias("land_use_heat"),
                     class_albedo(land_class).alias("land_use_albedo"))


def pixel_cells(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Output cell of each raster pixel.

    Pixel rows run south from the raster's north edge while grid rows run north,
    so cells come from pixel-centre coordinates. Pixels more than half a cell beyond
    the outer cell centres are left out. Input columns: px, py, the
    raster's ``raster_north``, ``raster_west`` and ``pixel_deg``, and the grid's
    ``south``, ``west`` (first cell centres) and ``cell_deg``.
    """
    lat = F.col("raster_north") - (F.col("py") + 0.5) * F.col("pixel_deg")
    lon = F.col("raster_west") + (F.col("px") + 0.5) * F.col("pixel_deg")
    down = (lat - F.col("south")) / F.col("cell_deg")
    along = (lon - F.col("west")) / F.col("cell_deg")
    # Only pixels inside the grid's cells; those on its very border go to the edge cell.
    return pixels.filter(down.between(-0.5, rows - 0.5) & along.between(-0.5, cols - 0.5)).select(
        "*", clip(F.rint(down), 0, rows - 1).cast("int").alias("row"),
        clip(F.rint(along), 0, cols - 1).cast("int").alias("col"))


def block_average(pixels: DataFrame, area: Sequence[str], rows: int, cols: int) -> DataFrame:
    """Mean heat and albedo of the pixels in each grid cell; empty cells read 0.

    Pixels are summed in the map tasks; a shuffle carries one row per cell.
    """
    means = pixels.groupBy(*area, "row", "col").agg(
        F.avg(class_heat("class")).alias("__h"), F.avg(class_albedo("class")).alias("__a"))
    full = (pixels.select(*area).distinct()
            .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
            .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
    return full.join(means, [*area, "row", "col"], "left").select(
        *area, "row", "col", F.coalesce("__h", F.lit(0.0)).alias("land_use_heat"),
        F.coalesce("__a", F.lit(0.0)).alias("land_use_albedo"))


def with_landcover_at_point(df: DataFrame, cells: DataFrame, radius: float = 0.25, side: int = 51,
                            lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Land cover of the nearest cell of the half-degree area a point belongs to.

    ``cells`` holds (area_lat, area_lon, row, col, land_use_heat,
    land_use_albedo). Points in areas without cover take the neutral default.
    """
    def index(value: str, centre: str) -> Column:
        spread = (F.col(value) - (F.col(centre) - radius)) / F.lit(2 * radius) * (side - 1)
        return clip(F.rint(spread), 0, side - 1).cast("int")

    base = df.drop("land_use_heat", "land_use_albedo")
    keyed = (base.withColumn("area_lat", weather_cell(lat)).withColumn("area_lon", weather_cell(lon))
             .withColumn("row", index(lat, "area_lat")).withColumn("col", index(lon, "area_lon")))
    joined = salted_join(keyed, cells, ["area_lat", "area_lon", "row", "col"], "left")
    return joined.select(
        *base.columns,
        F.coalesce("land_use_heat", F.lit(K.LAND_DEFAULT[0])).alias("land_use_heat"),
        F.coalesce("land_use_albedo", F.lit(K.LAND_DEFAULT[1])).alias("land_use_albedo"))


# --- Windows of any request, from one summed-area table -----------------------

def summed_area(pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """Summed-area table of a raster's land cover: (tile, py, px, n, heat, albedo).

    An entry sums all pixels north and west of it, itself included, in whole numbers
    of 1 / ``UNIT``. Any block of pixels is then four entries, however many requests
    ask for blocks of whatever size. ``pixels`` are (tile, py, px, class); pixels the
    raster lacks count nothing. ``rasters`` give each tile's ``width`` and ``height``.
    Sums run along pixel rows, then along pixel columns: a window never holds more
    than one row or column of a tile.
    """
    every = (rasters.select("tile", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("py"), "width")
             .select("tile", "py", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("px")))
    one = F.col("class").isNotNull().cast("bigint")
    counted = every.join(pixels.select("tile", "py", "px", "class"), ["tile", "py", "px"], "left").select(
        "tile", "py", "px", one.alias("n"),
        *[(F.rint(value * UNIT).cast("bigint") * one).alias(name) for name, value in (
            ("heat", class_heat("class")), ("albedo", class_albedo("class")))])

    def running(df: DataFrame, line: str, along: str) -> DataFrame:
        upto = Window.partitionBy("tile", line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("tile", "py", "px", *[F.sum(c).over(upto).alias(c) for c in ("n", "heat", "albedo")])

    return running(running(counted, "py", "px"), "px", "py")


def cover_windows(centres: DataFrame, table: DataFrame, rasters: DataFrame, radius: float = K.GRID_RADIUS,
                  side: int = SIDE) -> DataFrame:
    """Mean heat and albedo of the ``side`` x ``side`` cells around each centre, as row-major arrays.

    ``centres`` carry (tile, c_i, c_j), the snapped lattice point; ``rasters`` the
    tiles' ``raster_north``, ``raster_west``, ``pixel_deg``, ``width`` and ``height``.
    Cells run south to north and west to east like the terrain's. A pixel belongs to the
    cell nearest to its centre; pixels more than half a cell outside are left out, empty
    cells read 0. A centre costs (side + 1)^2 corner reads whatever the pixel size. Centres
    without a raster give no row.
    """
    cell = 2 * radius / (side - 1)
    placed = centres.select("tile", "c_i", "c_j").distinct().join(rasters, "tile")
    south, west = F.col("c_i") * K.TERRAIN_RES - radius, F.col("c_j") * K.TERRAIN_RES - radius

    def cells_of(first: Column, count: Column, coordinate, origin: Column):
        """(pixels that may lie in the window, what gives the cell of each; NULL outside)."""
        inside = F.sequence(F.greatest(first, F.lit(0)), F.least(
            first + F.ceil(F.lit(cell * side) / F.col("pixel_deg")).cast("int") + 3, count - 1))
        pixels = F.when((first < count) & (F.element_at(inside, -1) >= 0), inside).otherwise(
            F.array().cast("array<int>"))

        def cell_of(pixel: Column) -> Column:
            at = (coordinate(pixel) - origin) / F.lit(cell)
            return F.when(at.between(-0.5, side - 0.5), clip(F.rint(at), 0, side - 1).cast("int"))

        return pixels, lambda name: F.transform(name, cell_of)

    top, left = F.col("raster_north"), F.col("raster_west")
    first_y = F.floor((top - (south + 2 * radius + cell / 2)) / F.col("pixel_deg")).cast("int") - 1
    first_x = F.floor((west - cell / 2 - left) / F.col("pixel_deg")).cast("int") - 1
    ys, rows = cells_of(first_y, F.col("height"), lambda p: top - (p + 0.5) * F.col("pixel_deg"), south)
    xs, cols = cells_of(first_x, F.col("width"), lambda p: left + (p + 0.5) * F.col("pixel_deg"), west)
    # Each step is computed once a centre; plain projections would be copied into the lambdas that use them.
    lined = computed_once(computed_once(placed, __ys=ys, __xs=xs), __rows=rows("__ys"), __cols=cols("__xs"))

    def edges(pixels: str, cells: str, inward) -> Column:
        """Last pixel before each of the side + 1 cell borders, in the raster's direction."""
        before = F.coalesce(F.array_min(F.zip_with(
            pixels, cells, lambda p, c: F.when(c.isNotNull(), p))), F.lit(0)) - 1
        return F.transform(F.sequence(F.lit(0), F.lit(side)), lambda k: before + F.size(
            F.filter(cells, lambda c: F.coalesce(inward(c, k), F.lit(False)))))

    borders = computed_once(lined, __y=edges("__ys", "__rows", lambda c, k: c >= k),
                            __x=edges("__xs", "__cols", lambda c, k: c < k))
    # Outer, since plain generators get filters with copies of their arrays, pushed down to every input row.
    corners = borders.select("tile", "c_i", "c_j", "__x", F.posexplode_outer("__y").alias("__a", "py")).select(
        "tile", "c_i", "c_j", "__a", "py", F.posexplode_outer("__x").alias("__b", "px"))
    wide = side + 1
    sums = ("n", "heat", "albedo")
    read = corners.join(table, ["tile", "py", "px"], "left").groupBy("c_i", "c_j").agg(F.array_sort(F.collect_list(
        F.struct((F.col("__a") * wide + F.col("__b")).alias("k"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    )).alias("__s")).select("c_i", "c_j", *[F.col(f"__s.{c}").alias(c) for c in sums])

    def block(name: str, k: Column) -> Column:
        row, col = F.floor(k / side).cast("int"), k % side

        def corner(a: Column, b: Column) -> Column:
            return F.get(F.col(name), a * wide + b)

        return corner(row, col + 1) - corner(row, col) - corner(row + 1, col + 1) + corner(row + 1, col)

    def mean(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(
            F.try_divide(block(name, k) / F.lit(float(UNIT)), block("n", k)), F.lit(0.0)))

    return read.select("c_i", "c_j", *[mean(s).alias(f"{layer}_window") for s, layer in zip(sums[1:], LAYERS)])


def with_cover_windows(df: DataFrame, windows: DataFrame, side: int = SIDE) -> DataFrame:
    """``df`` (with c_i, c_j) and its cover windows; the neutral default where there is no raster."""
    joined = salted_join(df, windows, ["c_i", "c_j"], "left")
    return joined.withColumns({f"{layer}_window": F.coalesce(
        F.col(f"{layer}_window"), F.array_repeat(F.lit(float(default)), side * side))
        for layer, default in zip(LAYERS, K.LAND_DEFAULT)})


def with_landcover_at_centre(df: DataFrame, windows: DataFrame, radius: float = K.GRID_RADIUS, side: int = SIDE,
                             lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Land cover of each point, from the window around its own snapped centre (c_i, c_j)."""
    def index(value: str, centre: str) -> Column:
        low = F.col(centre) * K.TERRAIN_RES - radius
        return clip(F.rint((F.col(value) - low) / F.lit(2 * radius) * (side - 1)), 0, side - 1).cast("int")

    placed = with_cover_windows(df.drop(*LAYERS), windows, side)
    at = index(lat, "c_i") * side + index(lon, "c_j")
    return placed.withColumns({layer: F.get(F.col(f"{layer}_window"), at) for layer in LAYERS}).drop(
        *[f"{layer}_window" for layer in LAYERS])
