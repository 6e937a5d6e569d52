"""Planar overlay of polygons: outlines of unions, differences and intersections, as rings.

Polygons of two layers are cut at all their crossings and touching points, equal pieces are added up to one
edge with the change of cover across it, and the cover beside each edge decides whether it bounds the result.
What remains is chained into rings. Every step is a join or a sum over edges:

- edges meet in square cells about as large as a mean edge, so the pairs grow with the edges;
- the cover at a cell's corner is a running sum of the crossings along its row of cells, and from there to an
  edge only the edges of that cell count;
- at a vertex an edge goes on to the next one clockwise, which keeps parts that touch in a point apart;
- the rings come from pointer doubling: in round k each edge knows the least id among the 2^k edges ahead of
  it and how far that is, which in the end names the ring and the place in it.

Coordinates are put on a grid of 2^-36 units, so that a point has the same coordinates on all edges through it.
Edges that lie on each other from end to end are one edge from the start, so copies of a polygon meet nothing twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import polygons as P
from .cover import SHIFT, cell, in_cells, inside_left
from .levels import at_point, banded
from .materialise import materialise, release

#: Units per degree (or kilometre) of the grid of coordinates.
GRID = 2.0**36
#: A vertex this near to an edge lies on it.
NEAR = 2.0 / GRID
#: A vertex this near to the line between its neighbours is no corner.
STRAIGHT = 4.0 / GRID
RULES = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "difference": lambda a, b: (a > 0) & (b == 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
}


def snapped(x: Column) -> Column:
    return F.floor(x * GRID + 0.5) / GRID


def oriented_edges(polygons: DataFrame, label: str, layer: int = 0) -> DataFrame:
    """Edges ``(label, layer, x1, y1, x2, y2)`` with the inside on the left, whichever way the rings were written."""
    part = F.struct(F.col(label).alias("label"), F.col("region").alias("region"), F.col("part").alias("part"))
    e = P.edges(polygons.withColumns({"part": part, "lon": snapped(F.col("lon")), "lat": snapped(F.col("lat"))}))
    e = inside_left(e, P.RING).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    return e.select(F.col("part.label").alias("label"), F.lit(layer).alias("layer"), "x1", "y1", "x2", "y2")


def _cell_size(edges: DataFrame, ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> float:
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    extent = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    return edges.agg(2 * F.avg(extent)).first()[0] or 1.0


def _split_points(edges: DataFrame, size: float) -> DataFrame:
    """``(id, px, py)``: where edges are crossed or touched by others of their label."""
    cells = in_cells(edges, size)
    a, b = cells.alias("a"), cells.alias("b")
    met = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.iy") == F.col("b.iy")) & (F.col("a.ix") == F.col("b.ix")) & (F.col("a.id") < F.col("b.id")))
    c = lambda s, k: F.col(f"{s}.{k}")
    dx, dy = (lambda s: c(s, "x2") - c(s, "x1")), (lambda s: c(s, "y2") - c(s, "y1"))

    def touch(s: str, o: str, k: int) -> Column:
        """End ``k`` of edge ``o``, where it lies within edge ``s``."""
        px, py = c(o, f"x{k}"), c(o, f"y{k}")
        along = (px - c(s, "x1")) * dx(s) + (py - c(s, "y1")) * dy(s)
        square = dx(s) * dx(s) + dy(s) * dy(s)
        off = F.abs((px - c(s, "x1")) * dy(s) - (py - c(s, "y1")) * dx(s))
        same = ((px == c(s, "x1")) & (py == c(s, "y1"))) | ((px == c(s, "x2")) & (py == c(s, "y2")))
        return F.when((off <= NEAR * F.sqrt(square)) & (along > 0) & (along < square) & ~same, F.struct(c(s, "id").alias("id"), px.alias("px"), py.alias("py")))

    touching = F.filter(F.array(touch("a", "b", 1), touch("a", "b", 2), touch("b", "a", 1), touch("b", "a", 2)), lambda p: p.isNotNull())
    across = dx("a") * dy("b") - dy("a") * dx("b")
    gx, gy = c("b", "x1") - c("a", "x1"), c("b", "y1") - c("a", "y1")
    t, u = F.try_divide(gx * dy("b") - gy * dx("b"), across), F.try_divide(gx * dy("a") - gy * dx("a"), across)
    at = F.struct(snapped(c("a", "x1") + t * dx("a")).alias("px"), snapped(c("a", "y1") + t * dy("a")).alias("py"))
    point = lambda s: F.struct(c(s, "id").alias("id"), F.col("at.px").alias("px"), F.col("at.py").alias("py"))
    found = met.withColumn("touching", touching).withColumn("at", F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), at))
    points = F.when(F.size("touching") > 0, F.col("touching")).when(F.col("at").isNotNull(), F.array(point("a"), point("b")))
    return found.select(F.explode(points).alias("p")).select("p.*").distinct()


def _merged(edges: DataFrame, d0: Column, d1: Column) -> DataFrame:
    """``(label, ax, ay, bx, by, d0, d1, id)``: equal edges added up to one that points east (or north), without those beside which nothing changes."""
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    first = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    way = F.when(ahead, 1).otherwise(-1)
    added = edges.groupBy(
        "label", first("x1", "x2").alias("ax"), first("y1", "y2").alias("ay"), first("x2", "x1").alias("bx"), first("y2", "y1").alias("by")
    ).agg(F.sum(way * d0).alias("d0"), F.sum(way * d1).alias("d1"))
    return added.where("d0 <> 0 or d1 <> 0").withColumn("id", F.monotonically_increasing_id())


def noded(edges: DataFrame) -> tuple[DataFrame, float]:
    """Edges that meet at their ends only, ``(id, label, ax, ay, bx, by, d0, d1)``, and the cell size for them.

    They point east (or north), ``d0`` and ``d1`` say by how much the cover of each layer is larger on their left. Edges
    beside which nothing changes are left out.
    """
    edges = materialise(_merged(edges, F.when(F.col("layer") == 0, 1).otherwise(0), F.when(F.col("layer") == 1, 1).otherwise(0)).toDF("label", "x1", "y1", "x2", "y2", "d0", "d1", "id"))
    size = _cell_size(edges)
    ends = edges.select("id", F.explode(F.array(*[F.struct(F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py")) for k in (1, 2)])).alias("p")).select("id", "p.*")
    points = ends.unionByName(_split_points(edges, size)).distinct().join(edges, "id")
    along = (F.col("px") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("py") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    order = Window.partitionBy("id").orderBy(along)
    pieces = points.select("label", "d0", "d1", F.col("px").alias("x1"), F.col("py").alias("y1"), F.lead("px").over(order).alias("x2"), F.lead("py").over(order).alias("y2")).where("x2 is not null")
    out = materialise(_merged(pieces, F.col("d0"), F.col("d1")))
    release(edges)
    return out, _cell_size(out, ("ax", "ay", "bx", "by"))  # pieces may be far shorter than the edges they come from


def _covers(edges: DataFrame, size: float) -> DataFrame:
    """``edges`` with the cover of each layer just west of the middle (north of it, on level edges): ``c0, c1``."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    line = lambda k: (k + SHIFT) * size
    # Crossings of the lower sides of cells, added up along each row.
    lines = F.sequence(F.ceil(F.least(ay, by) / size - SHIFT), F.ceil(F.greatest(ay, by) / size - SHIFT) - 1)
    crossed = edges.where(F.ceil(F.greatest(ay, by) / size - SHIFT) > F.ceil(F.least(ay, by) / size - SHIFT)).withColumn("iy", F.explode(lines))
    x = ax + (line(F.col("iy")) - ay) / (by - ay) * (bx - ax)
    down = -F.signum(by - ay)
    crossed = crossed.groupBy("label", "iy", cell(x, size).alias("ix")).agg(*[F.sum(down * F.col(f"d{k}")).alias(f"w{k}") for k in (0, 1)])
    middle = edges.withColumns({"mx": (ax + bx) / 2, "my": (ay + by) / 2})
    middle = middle.withColumns({"iy": cell(F.col("my"), size), "ix": cell(F.col("mx"), size)})
    wanted = middle.select("label", "iy", "ix").distinct().withColumns({"w0": F.lit(0.0), "w1": F.lit(0.0), "wanted": F.lit(True)})
    before = Window.partitionBy("label", "iy").orderBy("ix").rangeBetween(Window.unboundedPreceding, -1)
    corner = crossed.withColumn("wanted", F.lit(False)).unionByName(wanted).select(
        "label", "iy", "ix", "wanted", *[F.coalesce(F.sum(f"w{k}").over(before), F.lit(0.0)).alias(f"w{k}") for k in (0, 1)]
    ).where("wanted").drop("wanted")
    # From the corner up its side and then east to the middle, past the edges of the cell.
    near = in_cells(edges, size, ("ax", "ay", "bx", "by")).select("label", "iy", "ix", *[F.col(c).alias(f"f_{c}") for c in ("id", "ax", "ay", "bx", "by", "d0", "d1")])
    met = middle.join(near, ["label", "iy", "ix"])
    fx, fy, gx, gy, mx, my = (F.col(c) for c in ("f_ax", "f_ay", "f_bx", "f_by", "mx", "my"))
    left, bottom = line(F.col("ix")), line(F.col("iy"))
    y_at = fy + F.try_divide(left - fx, gx - fx) * (gy - fy)
    x_at = fx + F.try_divide(my - fy, gy - fy) * (gx - fx)
    up = F.when((fx > left) != (gx > left), F.when((y_at > bottom) & (y_at <= my), 1)).otherwise(0)
    east = F.when(((fy > my) != (gy > my)) & (F.col("f_id") != F.col("id")), F.when((x_at > left) & (x_at < mx), -F.signum(gy - fy))).otherwise(0)
    passed = F.coalesce(up, F.lit(0)) + F.coalesce(east, F.lit(0.0))
    local = met.groupBy("id").agg(*[F.sum(passed * F.col(f"f_d{k}")).alias(f"s{k}") for k in (0, 1)])
    out = middle.join(corner, ["label", "iy", "ix"]).join(local, "id")
    return out.select("id", "label", "ax", "ay", "bx", "by", "d0", "d1", *[F.round(F.col(f"w{k}") + F.col(f"s{k}")).cast("long").alias(f"c{k}") for k in (0, 1)])


def boundary(edges: DataFrame, rule: str = "union") -> DataFrame:
    """Directed edges ``(id, label, x1, y1, x2, y2)`` around the result, with its inside on their left.

    ``edges`` are those of ``oriented_edges``, of one layer or of two. The areas to their left add up to that of the result.
    """
    cut, size = noded(edges)
    covered = _covers(cut, size)
    rising = F.col("by") >= F.col("ay")
    left = [F.when(rising, F.col(f"c{k}")).otherwise(F.col(f"c{k}") + F.col(f"d{k}")) for k in (0, 1)]
    right = [F.when(rising, F.col(f"c{k}") - F.col(f"d{k}")).otherwise(F.col(f"c{k}")) for k in (0, 1)]
    sided = covered.withColumns({"on_left": RULES[rule](*left), "on_right": RULES[rule](*right)}).where("on_left <> on_right")
    way = lambda a, b: F.when(F.col("on_left"), F.col(a)).otherwise(F.col(b))
    out = materialise(sided.select("id", "label", way("ax", "bx").alias("x1"), way("ay", "by").alias("y1"), way("bx", "ax").alias("x2"), way("by", "ay").alias("y2")))
    release(cut)
    return out


def _successors(edges: DataFrame) -> DataFrame:
    """``edges`` with ``next``, the edge that follows on the ring, and ``corner``, whether the ring turns between them."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    one = lambda x, y, angle, leaves: edges.select(
        "label", F.col(x).alias("x"), F.col(y).alias("y"), angle.alias("angle"), F.lit(leaves).alias("leaves"), "id", dx.alias("dx"), dy.alias("dy")
    )
    rays = one("x1", "y1", F.atan2(dy, dx), True).unionByName(one("x2", "y2", F.atan2(-dy, -dx), False))
    at = Window.partitionBy("label", "x", "y").orderBy("angle")
    out = F.when(F.col("leaves"), F.struct("id", "dx", "dy"))
    before = F.last(out, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    highest = F.last(out, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    onward = rays.withColumn("on", F.coalesce(before, highest)).where("not leaves")
    turn = F.abs(F.col("dx") * F.col("on.dy") - F.col("dy") * F.col("on.dx"))
    cx, cy = F.col("dx") + F.col("on.dx"), F.col("dy") + F.col("on.dy")
    chord = F.sqrt(cx * cx + cy * cy)
    closed = F.when(F.col("on").isNull(), F.raise_error("the outline of a region does not close")).otherwise(F.col("on.id"))
    met = onward.select("id", closed.alias("next"), ((turn > STRAIGHT * chord) | (F.col("dx") * F.col("on.dx") + F.col("dy") * F.col("on.dy") < 0)).alias("corner"))
    return edges.join(met, "id")


def ranked(links: DataFrame) -> DataFrame:
    """``(id, ring, ahead)`` from ``(id, next)`` in closed chains: the least id of the chain, and the steps to it.

    Pointer doubling: about log2 of the longest chain rounds, each a join of all rows with themselves.
    """
    now = materialise(links.select("id", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead")))
    reach = 1
    while True:
        far = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"), F.col("ahead").alias("ahead2"))
        less = F.col("ring2") < F.col("ring")
        after = materialise(now.join(far, "to").select(
            "id", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), F.when(less, F.col("ahead2") + reach).otherwise(F.col("ahead")).alias("ahead"), less.alias("changed")
        ))
        release(now)
        now, reach = after.drop("changed"), 2 * reach
        now._stage_path = after._stage_path
        if reach > 2 and not after.where("changed").head(1):
            return now.select("id", "ring", "ahead")


def rings(edges: DataFrame) -> DataFrame:
    """Directed edges chained: ``(label, ring, seq, x1, y1, x2, y2, corner)``, where ``corner`` tells of the end of an edge."""
    linked = materialise(_successors(edges))
    placed = linked.join(ranked(linked), "id")
    return placed.select("label", "ring", (-F.col("ahead")).alias("seq"), F.col("id") == F.col("ring"), "x1", "y1", "x2", "y2", "corner").toDF(
        "label", "ring", "seq", "first", "x1", "y1", "x2", "y2", "corner"
    ).withColumn("seq", F.when(F.col("first"), F.lit(-(1 << 60))).otherwise(F.col("seq"))).drop("first")


def ring_measures(chained: DataFrame) -> DataFrame:
    """Per ring its signed area (below 0: a hole), length, corners and least vertex ``low``."""
    cross = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return chained.groupBy("label", "ring").agg(
        F.sum(cross).alias("area"), F.sum(length).alias("length"), F.count_if("corner").alias("corners"), F.min(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("low")
    )


def pieces(chained: DataFrame) -> DataFrame:
    """``(label, ring, piece, area, length, corners, low)``: each ring with the shell of its piece.

    A hole belongs to the ring that lies next to the west of its westernmost vertex: a shell, or another hole of the
    same piece, which leads on to one.
    """
    measured = materialise(ring_measures(chained))
    holes = measured.where("area < 0").select("label", "ring", F.col("low.x").alias("hx"), F.col("low.y").alias("hy"))
    y1, y2, hy = F.col("y1"), F.col("y2"), F.col("hy")
    sides = banded(chained.where(y1 != y2).select("label", F.col("ring").alias("west"), "x1", "y1", "x2", "y2"), F.least(y1, y2), F.greatest(y1, y2))
    met = at_point(holes, "hy", sides, on=["label"])
    x = F.col("x1") + (hy - y1) / (y2 - y1) * (F.col("x2") - F.col("x1"))
    met = met.where(((y1 > hy) != (y2 > hy)) & (x < F.col("hx")) & (F.col("west") != F.col("ring"))).withColumn("x", x)
    owner = met.groupBy("label", "ring").agg(F.max_by("west", "x").alias("to"))
    roots = measured.join(owner, ["label", "ring"], "left").select("label", "ring", F.coalesce("to", "ring").alias("piece"))
    while True:
        roots = materialise(roots)
        up = roots.select("label", F.col("ring").alias("piece"), F.col("piece").alias("above"))
        raised = roots.join(up, ["label", "piece"])
        if not raised.where("above <> piece").head(1):
            return measured.join(roots, ["label", "ring"])
        roots = raised.select("label", "ring", F.col("above").alias("piece"))


def outline(polygons: DataFrame, label: str) -> DataFrame:
    """Polygons of one label united: vertices ``(region, part, ring, seq, lon, lat)``, region the label, overlaps once.

    A part is a piece of the union, its ring 0 the shell; a vertex between two edges in line is left out.
    """
    chained = materialise(rings(boundary(oriented_edges(polygons, label))))
    return vertices(chained)


def vertices(chained: DataFrame) -> DataFrame:
    """Chained edges as a vertex table, one part per piece."""
    named = pieces(chained).select("label", "ring", "piece", F.when(F.col("area") > 0, 0).otherwise(1).alias("hole"))
    corners = chained.where("corner").join(named, ["label", "ring"])
    return corners.select(
        F.col("label").alias("region"), F.col("piece").alias("part"), F.when(F.col("hole") == 0, F.lit(0).cast("long")).otherwise(F.col("ring") + 1).alias("ring"),
        "seq", F.col("x2").alias("lon"), F.col("y2").alias("lat"),
    )


def _stretches(lines: DataFrame, key: str) -> DataFrame:
    """Segments of each line, ``(key, seq, lon, lat, lon2, lat2)``."""
    order = Window.partitionBy(key).orderBy("seq")
    s = lines.select(key, "seq", "lon", "lat", F.lead("lon").over(order).alias("lon2"), F.lead("lat").over(order).alias("lat2"))
    return s.where("lon2 <> lon or lat2 <> lat")


def _around(spots: DataFrame, stretches: DataFrame, half: float, sides: int) -> DataFrame:
    """Other columns with ``(k, lon, lat)``: the corners of the disc around each spot and of the box along each stretch."""
    dx, dy = F.col("lon2") - F.col("lon"), F.col("lat2") - F.col("lat")
    size = F.sqrt(dx * dx + dy * dy)
    nx, ny = -dy / size * half, dx / size * half
    corner = lambda end, sign: F.struct((F.col(f"lon{end}") + sign * nx).alias("lon"), (F.col(f"lat{end}") + sign * ny).alias("lat"))
    kept = lambda df: [c for c in df.columns if c not in ("lon", "lat", "lon2", "lat2")]
    boxes = stretches.select(*kept(stretches), F.posexplode(F.array(corner("", -1), corner("2", -1), corner("2", 1), corner("", 1))).alias("k", "p"))
    turns = [F.struct((F.col("lon") + half * math.cos(2 * math.pi * i / sides)).alias("lon"), (F.col("lat") + half * math.sin(2 * math.pi * i / sides)).alias("lat")) for i in range(sides)]
    discs = spots.select(*kept(spots), F.posexplode(F.array(*turns)).alias("k", "p"))
    return boxes.unionByName(discs).select("*", "p.lon", "p.lat").drop("p")


def line_buffer(lines: DataFrame, key: str, half: float, sides: int = 32) -> DataFrame:
    """Polygons ``(region, part, ring, seq, lon, lat)`` that together cover all within ``half`` of each line, region the line.

    One rectangle per segment and one polygon of ``sides`` corners on the circle around each vertex, so joins and caps are round to
    within half * (1 - cos(pi / sides)). They overlap: overlay counts that once.
    """
    part = lambda kind: F.struct(F.lit(kind).alias("kind"), "seq").alias("part")
    stretches = _stretches(lines, key).select(F.col(key).alias("region"), part(0), "lon", "lat", "lon2", "lat2")
    spots = lines.select(F.col(key).alias("region"), part(1), "lon", "lat")
    return _around(spots, stretches, half, sides).select("region", "part", F.lit(0).alias("ring"), F.col("k").alias("seq"), "lon", "lat")


def _united_buffer(lines: DataFrame, key: str, half: float, sides: int) -> DataFrame:
    """The same without telling lines apart, ``(part, ring, seq, lon, lat)``: what lies in one place in several lines is there once."""
    kept = _stretches(lines, key).select("lon", "lat", "lon2", "lat2").distinct()
    stretches = kept.select(F.struct(F.lit(0).alias("kind"), "lon", "lat", "lon2", "lat2").alias("part"), "lon", "lat", "lon2", "lat2")
    spots = lines.select("lon", "lat").distinct().select(F.struct(F.lit(1).alias("kind"), "lon", "lat", F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).alias("part"), "lon", "lat")
    return _around(spots, stretches, half, sides).select("part", F.lit(0).alias("ring"), F.col("k").alias("seq"), "lon", "lat")


def _boxes(polygons: DataFrame, keys: list[str]) -> DataFrame:
    return polygons.groupBy(*keys).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))


def without_lines(polygons: DataFrame, lines: DataFrame, key: str, half: float, sides: int = 32) -> DataFrame:
    """What the buffers of ``lines`` leave of each region, one row per ring: ``(region, split_i, ring, area, length, corners)``.

    ``split_i`` numbers the pieces of a region from 0 by their least vertex (west, then
    south); a region left whole or in one piece has -1, one that lies within the buffers has no row.
    """
    cutter = materialise(_united_buffer(lines, key, half, sides))
    met = _overlapping(_boxes(cutter, ["part"]), _boxes(polygons, ["region"]))
    cut = cutter.join(met, "part")
    edges = oriented_edges(polygons, "region").unionByName(oriented_edges(cut.select("region", "part", "ring", "seq", "lon", "lat"), "region", layer=1))
    chained = materialise(rings(boundary(edges, "difference")))
    found = pieces(chained)
    shells = found.where("area > 0").select("label", "piece", "low")
    number = Window.partitionBy("label").orderBy("low", "piece")
    many = F.count(F.lit(1)).over(Window.partitionBy("label"))
    shells = shells.select("label", "piece", F.when(many > 1, F.row_number().over(number) - 1).otherwise(-1).alias("split_i"))
    return found.join(shells, ["label", "piece"]).select(F.col("label").alias("region"), "split_i", "ring", "area", "length", "corners")


def _overlapping(parts: DataFrame, regions: DataFrame) -> DataFrame:
    """``(part, region)`` whose boxes overlap: a box of one side meets those of the other in the cells that both cover."""
    size = regions.agg(F.greatest(F.avg(F.col("e") - F.col("w")), F.avg(F.col("n") - F.col("s")))).first()[0] or 1.0
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    celled = lambda df: df.withColumn("cx", span("w", "e")).withColumn("cy", span("s", "n"))
    a, b = celled(parts).alias("a"), celled(regions).alias("b")
    on = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    apart = (F.col("a.w") > F.col("b.e")) | (F.col("b.w") > F.col("a.e")) | (F.col("a.s") > F.col("b.n")) | (F.col("b.s") > F.col("a.n"))
    return a.join(b, on).where(~apart).select("part", "region").distinct()
