"""Outlines of united regions, and regions cut by buffered lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import overlay as O
from ..operators import polygons as P
from .registry import query

_GRID, _NEAR, _STRAIGHT = repr(O.GRID), repr(O.NEAR), repr(O.STRAIGHT)
_SQL_RULES = {"union": "({a}0 > 0)", "difference": "({a}0 > 0 AND {a}1 = 0)"}


def _snap(x: str) -> str:
    return f"floor(({x}) * {_GRID} + 0.5e0) / {_GRID}"


def _oriented(source: str, label: str, layer: int) -> str:
    """Oriented edges of rings ``source`` (with columns label, poly, ring, seq, lon, lat)."""
    return f"""
      SELECT {label} AS label, {layer} AS layer, CASE WHEN back THEN x2 ELSE x1 END AS x1, CASE WHEN back THEN y2 ELSE y1 END AS y1,
        CASE WHEN back THEN x1 ELSE x2 END AS x2, CASE WHEN back THEN y1 ELSE y2 END AS y2
      FROM (SELECT *, (sum(x1 * y2 - x2 * y1) OVER (PARTITION BY {label}, poly, ring) < 0) <> (ring > 0) AS back FROM (
        SELECT {label}, poly, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM (SELECT *, {_snap('lon')} AS x, {_snap('lat')} AS y FROM {source}) WINDOW w AS (PARTITION BY {label}, poly, ring ORDER BY seq)))
      WHERE x1 <> x2 OR y1 <> y2"""


def _touch(s: str, o: str, k: int) -> str:
    px, py, dx, dy = f"{o}.x{k}", f"{o}.y{k}", f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    return f"""SELECT {s}.id, {px} AS px, {py} AS py, a.id AS ia, b.id AS ib FROM near WHERE abs(({px} - {s}.x1) * {dy} - ({py} - {s}.y1) * {dx}) <= {_NEAR} * sqrt({dx} * {dx} + {dy} * {dy})
        AND ({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy} > 0 AND ({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy} < {dx} * {dx} + {dy} * {dy}
        AND NOT ({px} = {s}.x1 AND {py} = {s}.y1) AND NOT ({px} = {s}.x2 AND {py} = {s}.y2)"""


def overlay_sql(edges: str, rule: str) -> str:
    """CTEs that end in ``whole``: label, piece, area, length, corners, rings, low, by comparing all edges of a label."""
    inside = lambda side: _SQL_RULES[rule].format(a=side)
    touches = " UNION ALL ".join(_touch(s, o, k) for s, o in (("a", "b"), ("b", "a")) for k in (1, 2))
    dxa, dya, dxb, dyb = "(a.x2 - a.x1)", "(a.y2 - a.y1)", "(b.x2 - b.x1)", "(b.y2 - b.y1)"
    across = f"({dxa} * {dyb} - {dya} * {dxb})"
    return f"""
    e AS (SELECT *, row_number() OVER () AS id FROM ({edges})),
    near AS (
      SELECT a, b FROM e a JOIN e b ON a.label = b.label AND a.id < b.id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 1e-9 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 1e-9
        AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 1e-9 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 1e-9
    ),
    touching AS ({touches}),
    crossing AS (
      SELECT a.id AS ia, b.id AS ib, {_snap(f"a.x1 + t * {dxa}")} AS px, {_snap(f"a.y1 + t * {dya}")} AS py FROM (
        SELECT a, b, ((b.x1 - a.x1) * {dyb} - (b.y1 - a.y1) * {dxb}) / {across} AS t, ((b.x1 - a.x1) * {dya} - (b.y1 - a.y1) * {dxa}) / {across} AS u FROM near WHERE {across} <> 0)
      WHERE t > 0 AND t < 1 AND u > 0 AND u < 1
    ),
    fresh AS (SELECT * FROM crossing ANTI JOIN touching USING (ia, ib)),
    points AS (
      SELECT id, px, py FROM touching UNION SELECT ia, px, py FROM fresh UNION SELECT ib, px, py FROM fresh UNION SELECT id, x1, y1 FROM e UNION SELECT id, x2, y2 FROM e
    ),
    parts AS (
      SELECT label, layer, px, py, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM points JOIN e ON e.id = points.id
      WINDOW w AS (PARTITION BY e.id ORDER BY (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
    ),
    n AS (
      SELECT *, (ax + bx) / 2 AS mx, (ay + by_) / 2 AS my, row_number() OVER () AS id FROM (
        SELECT label, CASE WHEN ahead THEN px ELSE qx END AS ax, CASE WHEN ahead THEN py ELSE qy END AS ay, CASE WHEN ahead THEN qx ELSE px END AS bx, CASE WHEN ahead THEN qy ELSE py END AS by_,
          sum(CASE WHEN layer <> 0 THEN 0 WHEN ahead THEN 1 ELSE -1 END) AS d0, sum(CASE WHEN layer <> 1 THEN 0 WHEN ahead THEN 1 ELSE -1 END) AS d1
        FROM (SELECT *, px < qx OR (px = qx AND py < qy) AS ahead FROM parts WHERE qx IS NOT NULL) GROUP BY ALL)
      WHERE d0 <> 0 OR d1 <> 0
    ),
    c AS (
      SELECT n.id, sum(-sign(f.by_ - f.ay) * f.d0) AS c0, sum(-sign(f.by_ - f.ay) * f.d1) AS c1
      FROM n JOIN n f ON f.label = n.label AND f.id <> n.id AND least(f.ay, f.by_) <= n.my AND greatest(f.ay, f.by_) > n.my AND f.ax + (n.my - f.ay) / (f.by_ - f.ay) * (f.bx - f.ax) < n.mx GROUP BY n.id
    ),
    sides AS (
      SELECT n.*, coalesce(c0, 0) + CASE WHEN by_ >= ay THEN 0 ELSE d0 END AS l0, coalesce(c1, 0) + CASE WHEN by_ >= ay THEN 0 ELSE d1 END AS l1,
        coalesce(c0, 0) - CASE WHEN by_ >= ay THEN d0 ELSE 0 END AS r0, coalesce(c1, 0) - CASE WHEN by_ >= ay THEN d1 ELSE 0 END AS r1
      FROM n LEFT JOIN c ON c.id = n.id
    ),
    b AS (
      SELECT id, label, CASE WHEN f THEN ax ELSE bx END AS x1, CASE WHEN f THEN ay ELSE by_ END AS y1, CASE WHEN f THEN bx ELSE ax END AS x2, CASE WHEN f THEN by_ ELSE ay END AS y2
      FROM (SELECT *, {inside('l')} AS f FROM sides WHERE {inside('l')} <> {inside('r')})
    ),
    rays AS (
      SELECT label, x1 AS x, y1 AS y, atan2(y2 - y1, x2 - x1) AS angle, true AS leaves, id, x2 - x1 AS dx, y2 - y1 AS dy FROM b
      UNION ALL SELECT label, x2, y2, atan2(y1 - y2, x1 - x2), false, id, x2 - x1, y2 - y1 FROM b
    ),
    turned AS (
      SELECT *, coalesce(last_value(CASE WHEN leaves THEN struct_pack(id := id, dx := dx, dy := dy) END IGNORE NULLS) OVER (PARTITION BY label, x, y ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        last_value(CASE WHEN leaves THEN struct_pack(id := id, dx := dx, dy := dy) END IGNORE NULLS) OVER (PARTITION BY label, x, y ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS o FROM rays
    ),
    next AS (
      SELECT id, o.id AS onward, abs(dx * o.dy - dy * o.dx) > {_STRAIGHT} * sqrt((dx + o.dx) * (dx + o.dx) + (dy + o.dy) * (dy + o.dy)) OR dx * o.dx + dy * o.dy < 0 AS corner FROM turned WHERE NOT leaves
    ),
    walk AS (SELECT id, id AS root FROM next UNION SELECT next.onward, walk.root FROM walk JOIN next ON next.id = walk.id WHERE walk.root < next.onward),
    ringed AS (SELECT b.*, corner, ring FROM b JOIN next ON next.id = b.id JOIN (SELECT id, min(root) AS ring FROM walk GROUP BY id) r ON r.id = b.id),
    rings AS (
      SELECT label, ring, sum(x1 * y2 - x2 * y1) / 2 AS area, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length, sum(corner::INT) AS corners, min(struct_pack(x := x1, y := y1)) AS low
      FROM ringed GROUP BY ALL
    ),
    owner AS (
      SELECT h.ring, arg_max(s.ring, s.x1 + (h.low.y - s.y1) / (s.y2 - s.y1) * (s.x2 - s.x1)) AS above
      FROM rings h JOIN ringed s ON s.label = h.label AND s.ring <> h.ring AND (s.y1 > h.low.y) <> (s.y2 > h.low.y) AND s.x1 + (h.low.y - s.y1) / (s.y2 - s.y1) * (s.x2 - s.x1) < h.low.x
      WHERE h.area < 0 GROUP BY h.ring
    ),
    climb AS (SELECT ring, ring AS top, area FROM rings UNION ALL SELECT climb.ring, owner.above, (SELECT area FROM rings WHERE rings.ring = owner.above) FROM climb JOIN owner ON owner.ring = climb.top),
    whole AS (
      SELECT label, top AS piece, sum(rings.area) AS area, sum(length) AS length, CAST(sum(corners) AS BIGINT) AS corners, count(*) AS rings, min(CASE WHEN rings.area > 0 THEN low END) AS low
      FROM rings JOIN (SELECT ring, top FROM climb WHERE area > 0) t ON t.ring = rings.ring GROUP BY label, top
    )"""


def _by_piece(found):
    """Rings of a piece added up."""
    return found.groupBy("label", "piece").agg(
        F.sum("area").alias("area"), F.sum("length").alias("length"), F.sum("corners").alias("corners"), F.count(F.lit(1)).alias("rings"), F.min(F.when(F.col("area") > 0, F.col("low"))).alias("low")
    )


@query(
    "so_07b_outline",
    "group:i west_x:f west_y:f area:f length:f corners:i rings:i",
    f"""WITH RECURSIVE {overlay_sql(_oriented("(SELECT *, region % 4 AS g, region AS poly FROM r_lakes)", "g", 0), "union")}
        SELECT label AS "group", low.x AS west_x, low.y AS west_y, area, length, corners, rings FROM whole""",
)
def _(t):
    """Pieces of the outlines of united lakes, with their holes."""
    lakes = t.lakes.withColumn("group", F.col("region") % 4)
    chained = O.materialise(O.rings(O.boundary(O.oriented_edges(lakes, "group"))))
    return _by_piece(O.pieces(chained)).select(F.col("label").alias("group"), F.col("low.x").alias("west_x"), F.col("low.y").alias("west_y"), "area", "length", "corners", "rings")


@query(
    "so_07c_outline_vertices",
    "group:i vertices:i area:f",
    f"""WITH RECURSIVE {overlay_sql(_oriented("(SELECT *, region % 4 AS g, region AS poly FROM r_lakes)", "g", 0), "union")}
        SELECT label AS "group", CAST(sum(corners) AS BIGINT) AS vertices, sum(area) AS area FROM whole GROUP BY label""",
)
def _(t):
    """The outline as a vertex table, measured as any other polygons."""
    lakes = t.lakes.withColumn("group", F.col("region") % 4)
    united = O.materialise(O.outline(lakes, "group"))
    return united.groupBy(F.col("region").alias("group")).agg(F.count(F.lit(1)).alias("vertices")).join(P.measures(united).select(F.col("region").alias("group"), "area"), "group")


_HALF, _SIDES = 0.03125, 16
_DISC = ", ".join(f"struct_pack(k := {i}, x := {math.cos(2 * math.pi * i / _SIDES)!r}, y := {math.sin(2 * math.pi * i / _SIDES)!r})" for i in range(_SIDES))
_CUTTER = f"""
  SELECT line_id, 2 * seq AS poly, 0 AS ring, unnest(range(4)) AS seq, unnest([lon + ny, lon2 + ny, lon2 - ny, lon - ny]) AS lon, unnest([lat - nx, lat2 - nx, lat2 + nx, lat + nx]) AS lat FROM (
    SELECT *, (lon2 - lon) / sqrt((lon2 - lon) * (lon2 - lon) + (lat2 - lat) * (lat2 - lat)) * {_HALF!r} AS nx, (lat2 - lat) / sqrt((lon2 - lon) * (lon2 - lon) + (lat2 - lat) * (lat2 - lat)) * {_HALF!r} AS ny
    FROM (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM r_channels WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE lon2 IS NOT NULL)
  UNION ALL SELECT line_id, 2 * seq + 1, 0, d.k, lon + {_HALF!r} * d.x, lat + {_HALF!r} * d.y FROM (SELECT *, unnest([{_DISC}]) AS d FROM r_channels)"""
_CUT = f"""
  SELECT b.region, c.line_id * 1000 + c.poly AS poly, c.ring, c.seq, c.lon, c.lat FROM cutter c JOIN (SELECT line_id, poly, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM cutter GROUP BY ALL) p ON p.line_id = c.line_id AND p.poly = c.poly
  JOIN (SELECT region, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM r_basins GROUP BY ALL) b ON p.w <= b.e AND b.w <= p.e AND p.s <= b.n AND b.s <= p.n"""


@query(
    "geo_08d_split_by_buffered_lines",
    "region:i split_i:i area:f length:f corners:i rings:i",
    f"""WITH RECURSIVE cutter AS ({_CUTTER}),
        {overlay_sql(_oriented("(SELECT *, 0 AS poly FROM r_basins)", "region", 0) + " UNION ALL " + _oriented(f"({_CUT})", "region", 1), "difference")}
        SELECT label AS region, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN row_number() OVER (PARTITION BY label ORDER BY low.x, low.y) - 1 ELSE -1 END AS split_i, area, length, corners, rings FROM whole""",
)
def _(t):
    """Basins cut by all channels, each a sixteenth of a degree wide, into numbered pieces."""
    left = O.without_lines(t.basins, t.channels, "line_id", _HALF, _SIDES)
    return left.groupBy("region", "split_i").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.sum("corners").alias("corners"), F.count(F.lit(1)).alias("rings"))
