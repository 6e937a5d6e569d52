"""How often points are covered by regions, and edges in square cells.

A region's cover at the corner of a cell is the running sum of its crossings along the row of cells; from the
corner to a point only the edges that pass through the point's cell matter. Cells are about as large as a mean
edge, so a long edge is listed in the cells along it and sets nothing for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .levels import at_point, banded

#: Where cells start, in cells: off any coordinate that data are likely to have.
SHIFT = 0.3819660112501051


def cell(x: Column, size) -> Column:
    return F.floor(x / size - SHIFT)


def mean_size(edges: DataFrame) -> Column:
    """Scalar subquery: a power of two, at least as large as the mean extent of the edges and less than twice that."""
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return edges.agg(F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.nullif(F.avg(extent), F.lit(0.0))))), F.lit(1.0))).scalar()


def in_cells(edges: DataFrame, size, ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """One row per cell ``(iy, ix)`` that an edge passes through or nearly touches; ``size`` may be a column."""
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    slack = 1e-6 * size
    rows = F.sequence(cell(F.least(y1, y2) - slack, size), cell(F.greatest(y1, y2) + slack, size))
    e = edges.withColumn("iy", F.explode(rows))
    x_at = lambda y: F.when(y2 == y1, x1).otherwise(x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    low = F.greatest(F.least(y1, y2), (F.col("iy") + SHIFT) * size - slack)
    high = F.least(F.greatest(y1, y2), (F.col("iy") + 1 + SHIFT) * size + slack)
    flat = F.abs(y2 - y1) <= 2 * slack
    xa, xb = F.when(flat, x1).otherwise(x_at(low)), F.when(flat, x2).otherwise(x_at(high))
    return e.withColumn("ix", F.explode(F.sequence(cell(F.least(xa, xb) - slack, size), cell(F.greatest(xa, xb) + slack, size))))


def inside_left(edges: DataFrame, ring: list[str]) -> DataFrame:
    """``edges`` turned so that the inside of their polygon is on the left, whichever way the ring was written; ring 0 is the shell."""
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    turned = edges.groupBy(*ring).agg(area.alias("_a")).select(*ring, ((F.col("_a") < 0) != (F.col("ring") > 0)).alias("_back"))
    way = lambda a, b: F.when(F.col("_back"), F.col(b)).otherwise(F.col(a))
    both = {"x1": way("x1", "x2"), "y1": way("y1", "y2"), "x2": way("x2", "x1"), "y2": way("y2", "y1")}
    return edges.join(turned, ring).withColumns(both).drop("_back")


def rises(y1: Column, y2: Column, y: Column) -> Column:
    """Change of cover on passing an edge eastward just above ``y``: 1 where it leads down, -1 up, 0 where it does not cross."""
    return F.when((y1 > y) == (y2 > y), 0).when(y1 > y2, 1).otherwise(-1)


def cover_at(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(point, region, cover)`` for points ``(point, px, py)`` and the regions around them, by edges with the inside on the left.

    A point on an edge counts as just above and west of itself. No point meets a region's edges beyond its cell.
    """
    size = mean_size(edges)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    first, last = F.ceil(F.least(y1, y2) / size - SHIFT), F.ceil(F.greatest(y1, y2) / size - SHIFT) - 1
    crossed = edges.where(last >= first).withColumn("iy", F.explode(F.sequence(first, last)))
    line = (F.col("iy") + SHIFT) * size
    crossed = crossed.groupBy("region", "iy", cell(x1 + (line - y1) / (y2 - y1) * (x2 - x1), size).alias("ix")).agg(F.sum(-F.signum(y2 - y1)).alias("change"))
    along = Window.partitionBy("region", "iy").orderBy("ix")
    spans = crossed.select(
        "region", "iy", (F.col("ix") + 1).alias("low"), F.lead("ix").over(along).alias("high"), F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("cover")
    ).where("cover <> 0 and high >= low")
    placed = points.select("point", "px", "py", cell(F.col("py"), size).alias("iy"), cell(F.col("px"), size).alias("ix"))
    # Three quarters beyond the last cell: a span of one cell has a length, and that of two fits their level.
    far = at_point(placed, "ix", banded(spans, F.col("low").cast("double"), F.col("high") + 0.75), on=["iy"]).where("ix >= low and ix <= high")
    near = placed.join(in_cells(edges, size).select("region", "iy", "ix", "x1", "y1", "x2", "y2"), ["iy", "ix"])
    left, bottom = (F.col("ix") + SHIFT) * size, (F.col("iy") + SHIFT) * size
    y_at = y1 + F.try_divide(left - x1, x2 - x1) * (y2 - y1)
    up = F.when(((x1 > left) != (x2 > left)) & (y_at > bottom) & (y_at <= F.col("py")), F.signum(x2 - x1)).otherwise(0.0)
    x_at = x1 + F.try_divide(F.col("py") - y1, y2 - y1) * (x2 - x1)
    east = F.when(((y1 > F.col("py")) != (y2 > F.col("py"))) & (x_at > left) & (x_at < F.col("px")), rises(y1, y2, F.col("py"))).otherwise(0)
    local = near.select("point", "region", (up + east).alias("cover"))
    both = far.select("point", "region", "cover").unionByName(local)
    return both.groupBy("point", "region").agg(F.round(F.sum("cover")).cast("long").alias("cover")).where("cover <> 0")
