"""Blocks of cells that share one series, their footprints, labels and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid as O
from . import polygons as P
from .bands import axis_band
from .order import global_rank

# Compass names of a 3 x 3 neighbourhood, north row first.
COMPASS = ("NW", "N", "NE", "W", "C", "E", "SW", "S", "SE")


def cell_signatures(grid: DataFrame, decimals: int = 6, value: str = "value") -> DataFrame:
    """A 128-bit signature of each cell's whole rounded series; cells without data drop out.

    Hashes of the (time, value) pairs are combined by exclusive or, which needs neither order nor
    a collected array, so the aggregate is partial and a cell's record may be of any length. Steps
    without a value do not enter: a missing row and a null are the same gap.
    """
    v = F.bround(value, decimals) + F.lit(0.0)
    return (
        grid.where(F.col(value).isNotNull())
        .groupBy("iy", "ix")
        .agg(
            F.max("lat").alias("lat"), F.max("lon").alias("lon"),
            F.count(F.lit(1)).alias("_n"),
            F.bit_xor(F.xxhash64("time", v)).alias("_h1"),
            F.bit_xor(F.xxhash64(F.lit("second"), v, "time")).alias("_h2"),
        )
    )


def discover_blocks(grid: DataFrame, decimals: int = 6) -> DataFrame:
    """One row per group of cells with identical series: footprint, centre, size, first cell."""
    dlat = O.axis_spacing(grid, "lat").scalar()
    dlon = O.axis_spacing(grid, "lon").scalar()
    cells = cell_signatures(grid, decimals)
    return (
        cells.groupBy("_n", "_h1", "_h2")
        .agg(
            F.min("lat").alias("south"), F.max("lat").alias("north"),
            F.min("lon").alias("west"), F.max("lon").alias("east"),
            F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"),
            F.count(F.lit(1)).alias("cells"), F.min(F.struct("iy", "ix")).alias("rep"),
        )
        .withColumns(
            {
                "south": F.col("south") - dlat / 2, "north": F.col("north") + dlat / 2,
                "west": F.col("west") - dlon / 2, "east": F.col("east") + dlon / 2,
                "rep_iy": F.col("rep.iy"), "rep_ix": F.col("rep.ix"),
            }
        )
        .drop("_n", "_h1", "_h2", "rep")
    )


def numbered_blocks(blocks: DataFrame) -> DataFrame:
    """Labels B001, B002, ... from north to south, then west to east."""
    ranked = global_rank(blocks, [F.desc("lat_c"), F.asc("lon_c"), F.asc("rep_iy"), F.asc("rep_ix")], "_k")
    return ranked.withColumn("block_id", F.format_string("B%03d", "_k")).drop("_k")


def quadrant(lat_centre: Column, lon_centre: Column) -> Column:
    """NE, NW, SE or SW of a block's rectangle centre against a reference point."""
    lat, lon = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    return F.concat(F.when(lat > lat_centre, "N").otherwise("S"), F.when(lon < lon_centre, "W").otherwise("E"))


def six_block_labels(blocks: DataFrame) -> DataFrame:
    """NW N NE over SW S SE when there are exactly six blocks, running names otherwise."""
    ranked = global_rank(blocks, [F.desc("lat_c"), F.asc("lon_c"), F.asc("rep_iy"), F.asc("rep_ix")], "_k")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    row = F.when(F.col("_k") <= 3, 0).otherwise(1)
    # Only a set of six reaches the window: at most three rows a side.
    six = ranked.where(total == 6).withColumn("_row", row)
    col = F.row_number().over(Window.partitionBy("_row").orderBy("lon_c"))
    names = F.array(*[F.array(*[F.lit(x) for x in r]) for r in (("NW", "N", "NE"), ("SW", "S", "SE"))])
    labelled = six.withColumn("label", F.get(F.get(names, F.col("_row")), col - 1)).drop("_row")
    other = ranked.where(total != 6).withColumn("label", F.concat(F.lit("Block"), F.col("_k").cast("string")))
    return labelled.unionByName(other).drop("_k")


def blocks_in_region(blocks: DataFrame, polygon: DataFrame, mode: str = "intersects", min_fraction: float = 0.0) -> DataFrame:
    """Blocks overlapping a region by at least a fraction, or with their centre inside it."""
    edge = P.edges(polygon)
    if mode == "center_in":
        points = blocks.withColumns({"iy": F.col("block_id"), "lat": F.col("lat_c"), "lon": F.col("lon_c")})
        spans = P.row_spans(edge, points.select("iy", "lat"))
        return P.points_in_regions(points, spans).drop("iy", "lat", "lon").withColumn("fraction", F.lit(1.0))
    rects = blocks.select(F.col("block_id").alias("rect"), "west", "south", "east", "north")
    shared = P.overlaps(rects, edge).where(F.col("fraction") >= min_fraction)
    return blocks.join(shared.select(F.col("rect").alias("block_id"), "region", "fraction"), "block_id")


def adjacent_block(blocks: DataFrame, target_quadrant: str, candidate_quadrant: str) -> DataFrame:
    """The candidate whose east edge is nearest the target's west edge, shared latitudes rewarded."""
    t = blocks.where(F.col("quadrant") == target_quadrant).agg(
        F.min_by(F.struct("west", "south", "north"), "block_id")
    ).scalar()
    gap = F.abs(F.col("east") - t["west"])
    shared = F.greatest(F.lit(0.0), F.least(F.col("north"), t["north"]) - F.greatest(F.col("south"), t["south"]))
    score = F.col("score")
    rows = blocks.where(F.col("quadrant") == candidate_quadrant).withColumn("score", gap - shared)
    return rows.agg(F.min_by(F.struct("block_id", "score"), F.struct(score, F.col("block_id"))).alias("b")).select("b.*")


def nearest_index(points: DataFrame, axis: DataFrame, index: str, coord: str) -> DataFrame:
    """Nearest axis entry per point (of two equally near ones the larger coordinate).

    The axis is turned into half-open cells between midpoints; points are clamped to the axis and
    meet the cells by an equi-join on coordinate bands.
    """
    band = axis_band(axis, coord)
    order = Window.orderBy(coord)  # an axis is as long as one side of the grid
    lo = (F.lag(coord).over(order) + F.col(coord)) / 2
    hi = (F.lead(coord).over(order) + F.col(coord)) / 2
    cells = axis.select(
        index, F.coalesce(lo, F.col(coord)).alias("_lo"), F.coalesce(hi, F.col(coord) + 1e-9).alias("_hi")
    ).withColumn("_band", F.explode(F.sequence(F.floor(F.col("_lo") / band), F.floor(F.col("_hi") / band))))
    ends = axis.agg(F.struct(F.min(coord).alias("a"), F.max(coord).alias("b"))).scalar()
    clamped = F.greatest(F.least(F.col(coord), ends["b"]), ends["a"])
    p = points.withColumn("_at", clamped).withColumn("_band", F.floor(F.col("_at") / band))
    return p.join(cells, "_band").where("_at >= _lo and _at < _hi").drop("_band", "_at", "_lo", "_hi")


def nearest_cells(points: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``iy`` and ``ix`` of the nearest cell of each point ``(lat, lon)``."""
    return nearest_index(nearest_index(points, rows, "iy", "lat"), cols, "ix", "lon")


def neighbourhoods(points: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """3 x 3 cells around each point's nearest cell, shifted inward at the edges, compass labels.

    Indices are taken as contiguous; latitude may run either way.
    """
    at = nearest_cells(points, rows, cols)
    lim_y = rows.agg(F.struct(F.min("iy").alias("a"), F.max("iy").alias("b"))).scalar()
    lim_x = cols.agg(F.struct(F.min("ix").alias("a"), F.max("ix").alias("b"))).scalar()
    centre = lambda c, l: F.greatest(F.least(F.col(c), l["b"] - 1), l["a"] + 1)
    at = at.withColumns({"_cy": centre("iy", lim_y), "_cx": centre("ix", lim_x)}).drop("iy", "ix", "lat", "lon")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cells = at.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    cells = cells.withColumns({"iy": F.col("_cy") + F.col("_dy"), "ix": F.col("_cx") + F.col("_dx")})
    spots = cells.join(rows, "iy").join(cols, "ix")
    ascending = rows.agg(F.max_by("iy", "lat") > F.min_by("iy", "lat")).scalar()
    down = F.when(ascending, 1 - F.col("_dy")).otherwise(F.col("_dy") + 1)
    names = F.array(*[F.lit(n) for n in COMPASS])
    return spots.withColumn("cell_id", F.get(names, down * 3 + F.col("_dx") + 1)).drop("_cy", "_cx", "_dy", "_dx")
