"""Operators on the long grid table ``(time, iy, ix, lat, lon, value)``.

Stencils run on square tiles with a halo: border cells are copied to the neighbouring tiles, one
shuffle groups each tile, and every row or column window that follows is satisfied by that
grouping. A task therefore holds at most (tile + 2 halo)^2 cells per key, whatever the grid size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G

TILE = 256

# Accepted spellings of the dimension names.
NAME_MAP = {
    "time": ("time", "date", "datetime", "t"),
    "lat": ("lat", "latitude", "y"),
    "lon": ("lon", "longitude", "x"),
}


def normalise_names(df: DataFrame) -> DataFrame:
    """Rename dimension columns to time, lat and lon; raise when one cannot be found."""
    lower = {c.lower(): c for c in df.columns}
    found = {}
    for target, spellings in NAME_MAP.items():
        hit = next((lower[s] for s in spellings if s in lower), None)
        if hit is None:
            raise ValueError(f"no {target} column among {df.columns}")
        found[hit] = target
    return df.withColumnsRenamed(found)


def crop(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Bounding box, both ends included, whichever way the axes run; reaches the scan as a filter."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def signed_longitudes(df: DataFrame, lon: str = "lon") -> DataFrame:
    """0..360 longitudes to -180..180, only when the data use the former."""
    top = df.agg(F.max(lon)).scalar()
    return df.withColumn(lon, F.when(top > 180, G.wrap_180(lon)).otherwise(F.col(lon)))


def vertices_like(vertices: DataFrame, grid: DataFrame, lon: str = "lon") -> DataFrame:
    """Polygon longitudes in the convention of the grid."""
    top = grid.agg(F.max(lon)).scalar()
    return vertices.withColumn(lon, F.when(top > 180, G.wrap_360(lon)).otherwise(G.wrap_180(lon)))


def axes_from_2d(df: DataFrame) -> DataFrame:
    """Curvilinear coordinates averaged to one latitude per row and one longitude per column."""
    lat = df.groupBy("iy").agg(F.avg("lat").alias("lat"))
    lon = df.groupBy("ix").agg(F.avg("lon").alias("lon"))
    return df.drop("lat", "lon").join(lat, "iy").join(lon, "ix")


def axis_spacing(df: DataFrame, axis: str, how: str = "median") -> DataFrame:
    """One-row spacing of an axis: first, mean or median difference of its distinct values.

    The distinct coordinates of one axis number at most the grid's rows or columns.
    """
    marks = df.where(F.col(axis).isNotNull()).select(axis).distinct()
    order = Window.orderBy(axis)
    gaps = marks.select(F.col(axis), (F.lead(axis).over(order) - F.col(axis)).alias("gap")).where(
        F.col("gap").isNotNull()
    )
    pick = {
        "first": F.min_by("gap", axis),
        "mean": F.avg("gap"),
        "median": F.median("gap"),
    }[how]
    return gaps.agg(F.abs(pick).alias("spacing"))


def with_cell_area(df: DataFrame, form: str = "cosine", spacing: str = "median", axes_of: DataFrame | None = None) -> DataFrame:
    """Add ``area_km2`` from the spacing of the grid (of ``axes_of`` when ``df`` is part of it).

    The spacing is read by two scalar subqueries; with a known one use ``cell_area_km2`` directly.
    """
    source = df if axes_of is None else axes_of
    dlat = axis_spacing(source, "lat", spacing).scalar()
    dlon = axis_spacing(source, "lon", spacing).scalar()
    return df.withColumn("area_km2", G.cell_area_km2("lat", dlat, dlon, form))


def with_cell_areas(df: DataFrame, forms: dict[str, str], spacing: str = "median", axes_of: DataFrame | None = None) -> DataFrame:
    """A column of cell areas for each name and form; the spacing of the grid is read once for all of them."""
    source = df if axes_of is None else axes_of
    step = [axis_spacing(source, axis, spacing).withColumnRenamed("spacing", axis) for axis in ("lat", "lon")]
    both = step[0].agg(F.struct(F.first("lat").alias("lat"), F.lit(step[1].scalar()).alias("lon"))).scalar()
    spaced = df.withColumn("_step", both)
    return spaced.withColumns({n: G.cell_area_km2("lat", F.col("_step.lat"), F.col("_step.lon"), f) for n, f in forms.items()}).drop("_step")


def axis_limits(df: DataFrame) -> Column:
    """Scalar subquery with the first and last row and column of the grid."""
    return df.agg(
        F.struct(
            F.min("iy").alias("y0"), F.max("iy").alias("y1"),
            F.min("ix").alias("x0"), F.max("ix").alias("x1"),
        )
    ).scalar()


def tiled(df: DataFrame, halo: int, keys: list[str], tile: int = TILE) -> DataFrame:
    """Copy border cells to the tiles that need them and group every (keys, tile) in one task."""

    def spread(c: str) -> Column:
        low = F.floor((F.col(c) - halo) / tile)
        high = F.floor((F.col(c) + halo) / tile)
        return F.explode(F.sequence(low, high))

    return (
        df.withColumn("_ty", spread("iy"))
        .withColumn("_tx", spread("ix"))
        .withColumn(
            "_core",
            (F.col("_ty") == F.floor(F.col("iy") / tile)) & (F.col("_tx") == F.floor(F.col("ix") / tile)),
        )
        .repartition(*keys, "_ty", "_tx")
    )


def untiled(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_ty", "_tx", "_core")


def _lines(keys: list[str]):
    down = Window.partitionBy(*keys, "_ty", "_tx", "ix").orderBy("iy")
    across = Window.partitionBy(*keys, "_ty", "_tx", "iy").orderBy("ix")
    return down, across


def box_smooth(tiles: DataFrame, keys: list[str], values: list[str], size: int) -> DataFrame:
    """Centred size x size mean on tiled data; null unless the whole window is present."""
    if size <= 1:
        return tiles
    low, high = -(size // 2), size - 1 - size // 2
    down, across = (w.rangeBetween(low, high) for w in _lines(keys))
    full = lambda c, w: F.when(F.count(c).over(w) == size, F.sum(c).over(w))
    tiles = tiles.withColumns({v: full(F.col(v), down) for v in values})
    return tiles.withColumns({v: full(F.col(v), across) / float(size * size) for v in values})


def _slope(f: str, coord: str, index: str, window, first: Column, last: Column) -> Column:
    """Second-order derivative on an uneven axis, one-sided at the two ends of the grid.

    A neighbour counts only when it is the adjacent index, so missing cells give null.
    """

    def at(c: str, k: int) -> Column:
        shift = F.lead if k > 0 else F.lag
        ok = shift(index, abs(k)).over(window) == F.col(index) + k
        return F.when(ok, shift(c, abs(k)).over(window))

    f0, x0 = F.col(f), F.col(coord)
    h1, h2 = x0 - at(coord, -1), at(coord, 1) - x0
    centre = (h1 * h1 * at(f, 1) + (h2 * h2 - h1 * h1) * f0 - h2 * h2 * at(f, -1)) / (h1 * h2 * (h1 + h2))

    def edge(sign: int) -> Column:
        d1 = at(coord, sign) - x0
        d2 = at(coord, 2 * sign) - at(coord, sign)
        return (
            -(2 * d1 + d2) / (d1 * (d1 + d2)) * f0
            + (d1 + d2) / (d1 * d2) * at(f, sign)
            - d1 / (d2 * (d1 + d2)) * at(f, 2 * sign)
        )

    i = F.col(index)
    return F.when(i == first, edge(1)).when(i == last, edge(-1)).otherwise(centre)


def gradients(tiles: DataFrame, keys: list[str], value: str, limits: Column) -> DataFrame:
    """Add ``df_dx`` and ``df_dy`` per metre on tiled data (halo of 2 cells needed)."""
    down, across = _lines(keys)
    dlat = _slope(value, "lat", "iy", down, limits["y0"], limits["y1"])
    dlon = _slope(value, "lon", "ix", across, limits["x0"], limits["x1"])
    return tiles.withColumn("df_dy", dlat / G.M_PER_DEG_LAT).withColumn(
        "df_dx", dlon / G.metres_per_degree_lon("lat")
    )


def spatial_gradient(grid: DataFrame, value: str = "value", keys: list[str] = ("time",), tile: int = TILE) -> DataFrame:
    keys = list(keys)
    return untiled(gradients(tiled(grid, 2, keys, tile), keys, value, axis_limits(grid)))


def smooth(grid: DataFrame, size: int, value: str = "value", keys: list[str] = ("time",), tile: int = TILE) -> DataFrame:
    keys = list(keys)
    return untiled(box_smooth(tiled(grid, size // 2 + 1, keys, tile), keys, [value], size))
