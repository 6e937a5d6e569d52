"""Polygons as vertex tables ``(region, part, ring, seq, lon, lat)``.

Everything works on edges: parity spans per grid row, clipped areas, moments and half-plane clips
are sums or flat maps over edges, so a polygon of any length is spread over the cluster. Ring 0 is
the shell, further rings are holes; a repeated closing vertex does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from .cover import SHIFT, cell, cover_at, in_cells, inside_left, rises
from .levels import at_point, banded, level_of
from .materialise import materialise
from .sequence import positions, with_next

RING = ["region", "part", "ring"]


def edges(vertices: DataFrame) -> DataFrame:
    """Edges ``(x1, y1) -> (x2, y2)`` of every ring, closed, with their position."""
    start = positions(vertices, RING, "seq").select(
        *RING, "pos", "n", F.col("lon").alias("x1"), F.col("lat").alias("y1")
    )
    return with_next(start, RING, {"x2": "x1", "y2": "y1"}, wrap=True).drop("n")


def projected(vertices: DataFrame) -> DataFrame:
    """Vertices in equal-area kilometres (still called lon and lat)."""
    x, y = G.equal_area_xy("lat", "lon")
    return vertices.withColumns({"lon": x / 1000.0, "lat": y / 1000.0})


def measures(vertices: DataFrame) -> DataFrame:
    """Bounds, planar area and centroid per region, holes taken off."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges(vertices).groupBy(*RING).agg(
        F.min("x1").alias("west"), F.max("x1").alias("east"),
        F.min("y1").alias("south"), F.max("y1").alias("north"),
        (F.sum(cross) / 2).alias("a"),
        (F.sum((F.col("x1") + F.col("x2")) * cross) / 6).alias("mx"),
        (F.sum((F.col("y1") + F.col("y2")) * cross) / 6).alias("my"),
    )
    turn = F.signum("a") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    total = F.sum(F.col("a") * turn)
    return rings.groupBy("region").agg(
        F.min("west").alias("west"), F.min("south").alias("south"),
        F.max("east").alias("east"), F.max("north").alias("north"),
        total.alias("area"),
        F.try_divide(F.sum(F.col("mx") * turn), total).alias("cx"),
        F.try_divide(F.sum(F.col("my") * turn), total).alias("cy"),
    )


def area_km2(vertices: DataFrame) -> DataFrame:
    return measures(projected(vertices)).select("region", F.col("area").alias("area_km2"))


def row_spans(edge_table: DataFrame, rows: DataFrame, row: str = "iy", own: bool = False) -> DataFrame:
    """Inside intervals ``[x0, x1)`` of every region on every grid row (even-odd rule).

    ``rows`` holds ``(row, lat)``. Rows probe the edges at the level of each edge's own height; with
    ``own`` the rows carry a region instead and meet only its edges.
    """
    y1, y2, lat = F.col("y1"), F.col("y2"), F.col("lat")
    slanted = edge_table.where(y1 != y2)
    if own:
        met = slanted.join(rows.select(row, "lat", "region"), "region")
    else:
        met = at_point(rows.select(row, "lat"), "lat", banded(slanted, F.least(y1, y2), F.greatest(y1, y2)))
    hits = met.where((y1 > lat) != (y2 > lat)).withColumn(
        "x0", F.col("x1") + (lat - y1) / (y2 - y1) * (F.col("x2") - F.col("x1"))
    )
    order = Window.partitionBy("region", row).orderBy("x0")
    return (
        hits.select("region", row, "lat", "x0", F.row_number().over(order).alias("_k"), F.lead("x0").over(order).alias("x1"))
        .where(F.col("_k") % 2 == 1)
        .drop("_k")
    )


def cells_in_regions(cells: DataFrame, mask: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Tag cells ``(iy, ix, ...)`` with the regions whose mask holds them, and the mask's columns ``carry``.

    An equi-join on the cell: the mask is geometry only, one row per region and cell whatever the
    number of times, and no cell meets a region that does not hold it.
    """
    return cells.join(mask.select("region", "iy", "ix", *carry), ["iy", "ix"])


def points_in_regions(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points ``(iy, lon)``, each with a row index of its own, tagged with the regions around them."""
    s = banded(spans.select("region", "iy", "x0", "x1"), F.col("x0"), F.col("x1"))
    return at_point(points, "lon", s, on=["iy"]).where((F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1"))).drop("x0", "x1")


def region_mask(spans: DataFrame, cols: DataFrame) -> DataFrame:
    """The cells ``(region, iy, ix, lat, lon)`` of every region, from spans and the column axis, at the level of each span's width."""
    return (
        at_point(cols.select("ix", "lon"), "lon", banded(spans, F.col("x0"), F.col("x1")))
        .where((F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")))
        .select("region", "iy", "ix", "lat", "lon")
    )


def edge_cells(edge_table: DataFrame, lat0: float, lon0: float, dlat: float, dlon: float) -> DataFrame:
    """Cells an edge passes through on the regular grid with centres ``lat0 + dlat * iy`` etc."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    row_of = lambda y: F.floor((y - lat0) / dlat + 0.5)
    col_of = lambda x: F.floor((x - lon0) / dlon + 0.5)
    e = edge_table.withColumn("iy", F.explode(F.sequence(row_of(F.least(y1, y2)), row_of(F.greatest(y1, y2)))))
    bottom, top = lat0 + dlat * (F.col("iy") - 0.5), lat0 + dlat * (F.col("iy") + 0.5)
    x_at = lambda y: F.when(y2 == y1, x1).otherwise(x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    lo_y, hi_y = F.greatest(F.least(y1, y2), bottom), F.least(F.greatest(y1, y2), top)
    xa = F.when(y1 == y2, x1).otherwise(x_at(lo_y))
    xb = F.when(y1 == y2, x2).otherwise(x_at(hi_y))
    e = e.withColumn("ix", F.explode(F.sequence(col_of(F.least(xa, xb)), col_of(F.greatest(xa, xb)))))
    return e.select("region", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix")).distinct()


def touched_cells(edge_table: DataFrame, rows: DataFrame, cols: DataFrame, lat0: float, lon0: float, dlat: float, dlon: float) -> DataFrame:
    """Cells with their centre inside, or with any edge through them."""
    centre = region_mask(row_spans(edge_table, rows), cols).select("region", "iy", "ix")
    border = edge_cells(edge_table, lat0, lon0, dlat, dlon)
    border = border.join(rows.select("iy"), "iy", "left_semi").join(cols.select("ix"), "ix", "left_semi")
    return centre.unionByName(border).distinct()


#: An edge is listed in cells down to this part of its extent (a power of two), and in larger ones along its path.
FINEST = 10


def _extent(a: str, b: str, c: str, d: str) -> Column:
    return F.greatest(F.abs(F.col(b) - F.col(a)), F.abs(F.col(d) - F.col(c)))


def edges_in_rects(rects: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Pairs of rectangles ``(rect, west, south, east, north)`` and edges in a square ``(x0, y0, size)`` that both pass through.

    Squares have the size of the rectangle, or a 1024th of the edge where that is larger; each rectangle lies
    in four of a size at most, each edge is listed along its path for every size of rectangles. So a long edge
    or a large rectangle widens nothing for the others. A pair may have several squares, which do not overlap.
    """
    r = rects.withColumn("_r", level_of(_extent("west", "east", "south", "north")))
    e = edge_table.withColumn("_e", level_of(_extent("x1", "x2", "y1", "y2")) - FINEST)
    sizes = r.agg(F.sort_array(F.collect_set("_r"))).scalar()
    coarse = e.agg(F.sort_array(F.collect_set("_e"))).scalar()
    e = e.withColumn("_sizes", sizes).withColumn("_m", F.explode(F.expr("array_distinct(transform(_sizes, l -> greatest(l, _e)))"))).drop("_sizes")
    e = in_cells(e, F.pow(F.lit(2.0), F.col("_m")))
    r = r.withColumn("_coarse", coarse).withColumn("_m", F.explode(F.expr("array_distinct(concat(array(_r), filter(_coarse, l -> l > _r)))"))).drop("_coarse")
    size = F.pow(F.lit(2.0), F.col("_m"))
    r = r.withColumn("iy", F.explode(F.sequence(cell(F.col("south"), size), cell(F.col("north"), size))))
    r = r.withColumn("ix", F.explode(F.sequence(cell(F.col("west"), size), cell(F.col("east"), size))))
    met = r.join(e, ["_m", "iy", "ix"]).where("_m = greatest(_r, _e)")
    return met.withColumns({"size": size, "x0": (F.col("ix") + SHIFT) * size, "y0": (F.col("iy") + SHIFT) * size}).drop("_m", "_r", "_e")


def overlaps(rects: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Exact area shared by rectangles ``(rect, west, south, east, north)`` and regions.

    The cover at a rectangle's upper left corner, and the edges that pass through it, say all: no rectangle
    meets an edge elsewhere, so the rows grow with the borders that are drawn and the pairs that share an area.
    """
    e = materialise(inside_left(edge_table, RING).select("region", "x1", "y1", "x2", "y2"))
    rects = materialise(rects.select("rect", "west", "south", "east", "north"))
    west, east, south, north = (F.col(c) for c in ("west", "east", "south", "north"))
    x1, y1, x2, y2, x0, y0, size = (F.col(c) for c in ("x1", "y1", "x2", "y2", "x0", "y0", "size"))
    met = edges_in_rects(rects, e)
    # Part of the edge within rectangle and square, by its share from the first to the second end.
    low_x, high_x, low_y, high_y = F.greatest(west, x0), F.least(east, x0 + size), F.greatest(south, y0), F.least(north, y0 + size)
    dx, dy = x2 - x1, y2 - y1

    def share(start: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(low - start, step), F.try_divide(high - start, step)
        never = (step == 0) & ((start < low) | (start >= high))
        return F.when(never, 2.0).when(step == 0, 0.0).otherwise(F.least(a, b)), F.when(step == 0, 1.0).otherwise(F.greatest(a, b))

    ax, bx = share(x1, dx, low_x, high_x)
    ay, by = share(y1, dy, low_y, high_y)
    a, b = F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)
    under = F.when(b > a, -(b - a) * dx * (y1 + (a + b) / 2 * dy - south)).otherwise(0.0)
    x_top = x1 + F.try_divide(north - y1, dy) * dx
    here = (x_top >= west) & (x_top < east) & (cell(x_top, size) == F.col("ix")) & (cell(north, size) == F.col("iy"))
    beyond = F.when(((y1 > north) != (y2 > north)) & here, rises(y1, y2, north) * (east - x_top) * (north - south)).otherwise(0.0)
    local = met.select("rect", "region", (under + beyond).alias("area"))
    corners = cover_at(rects.select(F.col("rect").alias("point"), west.alias("px"), north.alias("py")), e)
    full = rects.select("rect", ((east - west) * (north - south)).alias("full"))
    whole = corners.select(F.col("point").alias("rect"), "region", F.lit(None).cast("double").alias("area"), "cover")
    both = local.withColumn("cover", F.lit(0).cast("long")).unionByName(whole).groupBy("rect", "region").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.sum("cover").alias("cover"))
    shared = F.round(F.col("area") + F.col("cover") * F.col("full"), 12)  # sums of parts: halves and wholes come out as such
    fraction = F.round(shared / F.col("full"), 12)
    return both.join(full, "rect").select("rect", "region", shared.alias("shared"), fraction.alias("fraction")).where(F.col("shared") > 1e-12)


def clip_half_plane(vertices: DataFrame, a: float, b: float, c: float) -> DataFrame:
    """Keep the side ``a * lon + b * lat + c >= 0`` of every ring.

    Each edge yields its crossing with the line and its inside end point; the order column keeps
    the ring together.
    """
    side = lambda x, y: F.lit(float(a)) * F.col(x) + F.lit(float(b)) * F.col(y) + F.lit(float(c))
    s1, s2 = side("x1", "y1"), side("x2", "y2")
    t = s1 / (s1 - s2)
    point = lambda x, y, k: F.struct(x.alias("lon"), y.alias("lat"), F.lit(k).alias("k"))
    cut = point(
        F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1")), 0
    )
    crosses = (s1 >= 0) != (s2 >= 0)
    got = F.filter(
        F.array(F.when(crosses, cut), F.when(s2 >= 0, point(F.col("x2"), F.col("y2"), 1))),
        lambda p: p.isNotNull(),
    )
    return edges(vertices).select(*RING, "pos", F.explode(got).alias("p")).select(
        *RING, (F.col("pos") * 2 + F.col("p.k")).alias("seq"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")
    )


def clip_box(vertices: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    for a, b, c in ((1, 0, -west), (-1, 0, east), (0, 1, -south), (0, -1, north)):
        vertices = clip_half_plane(vertices, a, b, c)
    return vertices


def split_at(vertices: DataFrame, a: float, b: float, c: float, names: tuple[str, str]) -> DataFrame:
    """Both sides of a straight cut, with ``side`` naming the piece; areas add up to the whole."""
    keep = clip_half_plane(vertices, a, b, c).withColumn("side", F.lit(names[0]))
    rest = clip_half_plane(vertices, -a, -b, -c).withColumn("side", F.lit(names[1]))
    return keep.unionByName(rest)


def split_at_longitude(vertices: DataFrame, lon: float) -> DataFrame:
    return split_at(vertices, -1.0, 0.0, lon, ("west", "east"))


def split_by_strip(vertices: DataFrame, a: float, b: float, c: float, half: float) -> DataFrame:
    """What a strip around the line ``a x + b y + c = 0``, ``half`` wide on either side, leaves of every region.

    ``split_i`` numbers the pieces 0 and 1 of a region cut in two, on the negative and the positive side of the
    line; a region with one piece left has -1. Nothing is left of a region within the strip.
    """
    n = (a * a + b * b) ** 0.5
    a, b, c = a / n, b / n, c / n
    off = a * F.col("lon") + b * F.col("lat") + c
    sides = vertices.groupBy("region").agg((F.min(off) < -half).alias("_low"), (F.max(off) > half).alias("_high"))
    low = clip_half_plane(vertices, -a, -b, -c - half).join(sides.where("_low"), "region").withColumn("split_i", F.lit(0))
    high = clip_half_plane(vertices, a, b, c - half).join(sides.where("_high"), "region").withColumn("split_i", F.lit(1))
    pieces = low.unionByName(high)
    return pieces.withColumn("split_i", F.when(F.col("_low") & F.col("_high"), F.col("split_i")).otherwise(-1)).drop("_low", "_high")


def label_points(vertices: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Centroid when it lies inside, else the middle of the widest inside stretch at its latitude.

    With a ``box`` (west, south, east, north) regions are clipped first; those without area in it are left out.
    """
    if box is not None:
        vertices = clip_box(vertices, *box)
        vertices = vertices.join(measures(vertices).where("area > 0").select("region"), "region", "left_semi")
    m = measures(vertices).select("region", "cx", "cy")
    rows = m.select("region", F.col("cy").alias("lat"), F.lit(0).alias("row"))
    j = row_spans(edges(vertices), rows, row="row", own=True).drop("row", "lat").join(m, "region")
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1"))
    widest = F.max_by((F.col("x0") + F.col("x1")) / 2, F.struct(F.col("x1") - F.col("x0"), -F.col("x0")))
    picked = j.groupBy("region").agg(F.max(inside).alias("inside"), widest.alias("mid"))
    return m.join(picked, "region").select(
        "region", F.when(F.col("inside"), F.col("cx")).otherwise(F.col("mid")).alias("lon"),
        F.col("cy").alias("lat"), "inside",
    )
