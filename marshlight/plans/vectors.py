"""Queries for blocks, channels, sampling and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import channels as H
from ..operators import polygons as P
from ..operators import regions as A
from ..operators import zonal as Z
from ..operators.materialise import materialise
from .registry import query
from .zones import _OVERLAP


def _storage(t):
    """A 12 x 12 storage grid, delivered to six decimals, whose 3 x 3 squares share one series each; some months missing."""
    k = F.col("l_partkey")
    block = t.table("lineitem").groupBy(
        F.trunc("l_shipdate", "MM").alias("time"), (k % 4).cast("int").alias("by"), (F.expr("l_partkey div 4") % 4).cast("int").alias("bx")
    ).agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("s"), F.count(F.lit(1)).alias("n"))
    three = F.array(F.lit(0), F.lit(1), F.lit(2))
    cells = block.withColumn("dy", F.explode(three)).withColumn("dx", F.explode(three)).select(
        "time", (F.col("by") * 3 + F.col("dy")).alias("iy"), (F.col("bx") * 3 + F.col("dx")).alias("ix"),
        # Differences below the rounding of the signature must not separate cells.
        (F.round(F.expr("(s * 1024) div (10 * n)") / 1024.0, 6) + F.col("dy") * 1e-9).alias("value"),
    )
    return materialise(cells.withColumns({"lat": -20.25 + 0.25 * F.col("iy"), "lon": 21.5 + 0.25 * F.col("ix")}))


_BLOCKS = """
WITH s AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, CAST(l_partkey % 4 AS INTEGER) AS ty, CAST((l_partkey // 4) % 4 AS INTEGER) AS tx,
                  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT time, ty * 3 + dy AS iy, tx * 3 + dx AS ix, round(((s * 1024) // (10 * n)) / 1024e0, 6) AS value FROM s, (SELECT unnest(range(3)) AS dy), (SELECT unnest(range(3)) AS dx)),
g AS (SELECT iy, ix, string_agg(time || '=' || round(value, 6), ';' ORDER BY time) AS sig FROM c GROUP BY iy, ix),
b AS (SELECT min(-20.25e0 + 0.25e0 * iy) - 0.125e0 AS south, max(-20.25e0 + 0.25e0 * iy) + 0.125e0 AS north, min(21.5e0 + 0.25e0 * ix) - 0.125e0 AS west,
             max(21.5e0 + 0.25e0 * ix) + 0.125e0 AS east, avg(-20.25e0 + 0.25e0 * iy) AS lat_c, avg(21.5e0 + 0.25e0 * ix) AS lon_c, count(*) AS cells, min(iy) AS rep_iy, min(ix) AS rep_ix
      FROM g GROUP BY sig),
r AS (SELECT *, 'B' || lpad(CAST(row_number() OVER (ORDER BY lat_c DESC, lon_c, rep_iy, rep_ix) AS VARCHAR), 3, '0') AS block_id,
             CASE WHEN (south + north) / 2 > -19.3e0 THEN 'N' ELSE 'S' END || CASE WHEN (west + east) / 2 < 22.8e0 THEN 'W' ELSE 'E' END AS quadrant FROM b)"""


def _blocks(t):
    b = B.numbered_blocks(B.discover_blocks(_storage(t)))
    return b.withColumn("quadrant", B.quadrant(F.lit(-19.3), F.lit(22.8)))


@query(
    "ag_31_block_discovery",
    "block_id:s south:f north:f west:f east:f lat_c:f lon_c:f cells:i rep_iy:i rep_ix:i quadrant:s",
    _BLOCKS + " SELECT * FROM r",
)
def _(t):
    return _blocks(t)


_FRACTION = ", rc AS (SELECT block_id AS rect, west, east, south, north FROM r), p AS (" + _OVERLAP.split("p AS (", 1)[1].replace("FROM c JOIN", "FROM rc JOIN").replace("/ 0.0625e0", "/ 0.5625e0")


@query(
    "ag_31b_blocks_in_region",
    "block_id:s region:i fraction:f",
    _BLOCKS + _FRACTION.replace("SELECT rect, region, sum(abs(area)", ", o AS (SELECT rect, region, sum(abs(area)").rstrip() + ") SELECT rect AS block_id, region, fraction FROM o WHERE fraction >= 0.05e0",
)
def _(t):
    return B.blocks_in_region(_blocks(t), t.basins, min_fraction=0.05)


@query(
    "ag_31c_block_centre_in_region",
    "block_id:s region:i",
    _BLOCKS + """ SELECT block_id, region FROM r JOIN r_basin_edges e ON (y1 > lat_c) <> (y2 > lat_c) AND x1 + (lat_c - y1) / (y2 - y1) * (x2 - x1) > lon_c
    GROUP BY ALL HAVING count(*) % 2 = 1""",
)
def _(t):
    return B.blocks_in_region(_blocks(t), t.basins, mode="center_in")


@query(
    "wn_17_block_labels",
    "label:s lat_c:f lon_c:f kind:s",
    _BLOCKS + """ SELECT 'Block' || row_number() OVER (ORDER BY lat_c DESC, lon_c) AS label, lat_c, lon_c, 'all' AS kind FROM r
    UNION ALL SELECT CASE WHEN north > -18e0 THEN 'N' ELSE 'S' END || CASE WHEN west < 22e0 THEN 'W' WHEN west > 22.5e0 THEN 'E' ELSE '' END, lat_c, lon_c, 'six' FROM r WHERE south > -19e0 AND east < 23.7e0""",
)
def _(t):
    b = B.discover_blocks(_storage(t))
    every = B.six_block_labels(b).withColumn("kind", F.lit("all"))
    six = B.six_block_labels(b.where("south > -19 AND east < 23.7")).withColumn("kind", F.lit("six"))
    return every.unionByName(six)


@query(
    "jn_15_adjacent_block",
    "block_id:s score:f",
    _BLOCKS + """, t AS (SELECT * FROM r WHERE quadrant = 'NE' ORDER BY block_id LIMIT 1)
    SELECT r.block_id, abs(r.east - t.west) - greatest(0e0, least(r.north, t.north) - greatest(r.south, t.south)) AS score FROM r, t WHERE r.quadrant = 'NW' ORDER BY score, r.block_id LIMIT 1""",
)
def _(t):
    return B.adjacent_block(_blocks(t), "NE", "NW")


def _points(t):
    k = F.col("c_custkey")
    return t.table("customer").select(
        k, (-20.5 + (k % 111) / 32.0).alias("lat"), (21.25 + (k % 107) / 32.0).alias("lon")
    )


_PTS = "(SELECT c_custkey, -20.5e0 + (c_custkey % 111) / 32e0 AS lat, 21.25e0 + (c_custkey % 107) / 32e0 AS lon FROM customer)"


@query(
    "jn_08_nearest_cell",
    "c_custkey:i iy:i ix:i",
    f"SELECT c_custkey, CAST(greatest(0, least(11, floor((lat + 20.25e0) / 0.25e0 + 0.5e0))) AS INTEGER) AS iy, CAST(greatest(0, least(11, floor((lon - 21.5e0) / 0.25e0 + 0.5e0))) AS INTEGER) AS ix FROM {_PTS}",
)
def _(t):
    return B.nearest_cells(_points(t), *Z.axes(t.kept_grid))


@query(
    "geo_07_neighbourhood",
    "c_custkey:i cell_id:s iy:i ix:i",
    f"""SELECT c_custkey, CASE WHEN dy = 1 THEN 'N' WHEN dy = -1 THEN 'S' ELSE '' END || CASE WHEN dx = -1 THEN 'W' WHEN dx = 1 THEN 'E' WHEN dy = 0 THEN 'C' ELSE '' END AS cell_id, iy + dy AS iy, ix + dx AS ix
        FROM (SELECT c_custkey, CAST(greatest(1, least(10, floor((lat + 20.25e0) / 0.25e0 + 0.5e0))) AS INTEGER) AS iy, CAST(greatest(1, least(10, floor((lon - 21.5e0) / 0.25e0 + 0.5e0))) AS INTEGER) AS ix FROM {_PTS}),
             (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)""",
)
def _(t):
    n = B.neighbourhoods(_points(t), *Z.axes(t.kept_grid))
    return n.withColumn("cell_id", F.when(F.col("cell_id") == "C", "C").otherwise(F.col("cell_id")))


_FLD = """(SELECT iy, ix, any_value(lat) AS lat, any_value(lon) AS lon, CASE WHEN (iy + ix) % 9 <> 4 THEN avg(value) - 0.5e0 END AS u_perp, max(value) - avg(value) AS v_perp, avg(value) > 0.5e0 AS mask_front FROM r_grid GROUP BY iy, ix)"""


def _field(t):
    f = t.grid.groupBy("iy", "ix").agg(
        F.max("lat").alias("lat"), F.max("lon").alias("lon"), (F.avg("value") - 0.5).alias("u_perp"),
        (F.max("value") - F.avg("value")).alias("v_perp"), (F.avg("value") > 0.5).alias("mask_front"),
    )
    return materialise(f.withColumn("u_perp", F.when((F.col("iy") + F.col("ix")) % 9 != 4, F.col("u_perp"))))


def _sample_sql(points: str, ident: str) -> str:
    return f"""
loc AS (SELECT p.*, CAST(ceil((lat + 20.25e0) / 0.25e0) - 1 AS INTEGER) AS y0, CAST(ceil((lon - 21.5e0) / 0.25e0) - 1 AS INTEGER) AS x0 FROM {points} p),
ib AS (SELECT *, (lat - (-20.25e0 + 0.25e0 * y0)) / 0.25e0 AS wy, (lon - (21.5e0 + 0.25e0 * x0)) / 0.25e0 AS wx FROM loc WHERE y0 BETWEEN 0 AND 10 AND x0 BETWEEN 0 AND 10),
cn AS (SELECT ib.*, f.u_perp, f.v_perp, f.mask_front, (CASE WHEN f.iy > y0 THEN wy ELSE 1 - wy END) * (CASE WHEN f.ix > x0 THEN wx ELSE 1 - wx END) AS w,
              (CASE WHEN f.iy > y0 THEN wy > 0.5e0 ELSE wy <= 0.5e0 END) AND (CASE WHEN f.ix > x0 THEN wx > 0.5e0 ELSE wx <= 0.5e0 END) AS near
       FROM ib JOIN {_FLD} f ON f.iy BETWEEN y0 AND y0 + 1 AND f.ix BETWEEN x0 AND x0 + 1),
sm AS (SELECT {ident}, CASE WHEN count(u_perp) = 4 THEN sum(u_perp * w) END AS u, CASE WHEN count(v_perp) = 4 THEN sum(v_perp * w) END AS v, bool_or(mask_front AND near) AS m FROM cn GROUP BY {ident})"""


@query(
    "jn_13_bilinear",
    "c_custkey:i u_perp:f v_perp:f mask_front:b",
    f"WITH {_sample_sql(_PTS, 'c_custkey')} SELECT p.c_custkey, u AS u_perp, v AS v_perp, coalesce(m, false) AS mask_front FROM {_PTS} p LEFT JOIN sm ON sm.c_custkey = p.c_custkey",
)
def _(t):
    return H.sample_field(_points(t), _field(t), ["c_custkey"], ["u_perp", "v_perp"], ["mask_front"])


_ELL = "(1e0 / 298.257223563e0)"


def _utm_sql(source: str) -> str:
    """``source`` with x and y in metres of zone 34 south."""
    return f"""(SELECT * EXCLUDE (phi, dl, n, e, tt, xi0, eta0, a, a1, a2, a3),
  500000e0 + 0.9996e0 * a * (eta0 + a1 * cos(2*xi0) * sinh(2*eta0) + a2 * cos(4*xi0) * sinh(4*eta0) + a3 * cos(6*xi0) * sinh(6*eta0)) AS x,
  10000000e0 + 0.9996e0 * a * (xi0 + a1 * sin(2*xi0) * cosh(2*eta0) + a2 * sin(4*xi0) * cosh(4*eta0) + a3 * sin(6*xi0) * cosh(6*eta0)) AS y
FROM (SELECT *, atan2(tt, cos(dl)) AS xi0, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta0, 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS a,
             n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3
      FROM (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS tt
            FROM (SELECT *, radians(lat) AS phi, radians(lon - 21e0) AS dl, {_ELL} / (2 - {_ELL}) AS n, sqrt({_ELL} * (2 - {_ELL})) AS e FROM {source}))))"""


_STEP = 2000.0
_SAMPLES = f"""
vx AS (SELECT * FROM {_utm_sql('r_channels')}),
sg AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d FROM (SELECT line_id, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vx WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL),
ch AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY seq) AS s1, sum(d) OVER (PARTITION BY line_id) AS len FROM sg),
ks AS (SELECT line_id, len, CAST(greatest(1, ceil(len / {_STEP}e0)) AS INTEGER) AS n FROM ch GROUP BY line_id, len),
kk AS (SELECT line_id, len, n, unnest(range(n + 1)) AS pos FROM (SELECT line_id, max(len) AS len, max(n) AS n FROM ks GROUP BY line_id)),
sp AS (SELECT kk.line_id, kk.pos, kk.n, kk.pos * kk.len / kk.n AS s_m, arg_min(ch.x + (kk.pos * kk.len / kk.n - (s1 - d)) / d * (x2 - x), seq) AS x, arg_min(ch.y + (kk.pos * kk.len / kk.n - (s1 - d)) / d * (y2 - y), seq) AS y, max(kk.len) AS len
       FROM kk JOIN ch ON ch.line_id = kk.line_id AND kk.pos * kk.len / kk.n >= s1 - d - 1e-6 AND kk.pos * kk.len / kk.n <= s1 + 1e-6 GROUP BY ALL),
tg AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM sp WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
tn AS (SELECT *, dx / sqrt(dx*dx + dy*dy) AS tx, dy / sqrt(dx*dx + dy*dy) AS ty FROM tg)"""


@query(
    "geo_05_densify",
    "line_id:i pos:i s_km:f x_km:f y_km:f",
    f"WITH {_SAMPLES} SELECT line_id, pos, s_m / 1e3 AS s_km, x / 1e3 AS x_km, y / 1e3 AS y_km FROM sp",
)
def _(t):
    s = H.densify(H.to_metres(t.channels, H.local_zone(t.channels)), _STEP)
    return _in_km(s)


def _in_km(s):
    return s.withColumns({"s_km": F.col("s_m") / 1e3, "x_km": F.col("x") / 1e3, "y_km": F.col("y") / 1e3})


@query("wn_19_tangents", "line_id:i pos:i tx:f ty:f", f"WITH {_SAMPLES} SELECT line_id, pos, tx, ty FROM tn")
def _(t):
    return H.channel_samples(t.channels, _STEP)


_APEX = "(SELECT x AS ax, y AS ay FROM " + _utm_sql("(SELECT -19e0 AS lat, 22.9e0 AS lon)") + ")"
_ORIENTED = f"""{_SAMPLES},
fl AS (SELECT line_id, ((x - ax) * tx + (y - ay) * ty) < 0 AS flip FROM tn, {_APEX} WHERE pos = (n + 1) // 2),
ot AS (SELECT tn.line_id, CASE WHEN flip THEN n - pos ELSE pos END AS pos, CASE WHEN flip THEN len - s_m ELSE s_m END AS s_m, x, y, CASE WHEN flip THEN -tx ELSE tx END AS tx, CASE WHEN flip THEN -ty ELSE ty END AS ty, flip
       FROM tn JOIN fl ON fl.line_id = tn.line_id)"""


@query(
    "geo_06_orient_outward",
    "line_id:i pos:i s_km:f x_km:f y_km:f tx:f ty:f flipped:b",
    f"WITH {_ORIENTED} SELECT line_id, pos, s_m / 1e3 AS s_km, x / 1e3 AS x_km, y / 1e3 AS y_km, tx, ty, flip AS flipped FROM ot",
)
def _(t):
    return _in_km(H.channel_samples(t.channels, _STEP, (-19.0, 22.9)))


_INVERSE = f"""(SELECT * EXCLUDE (f, n, e2, a, xi, eta, xi0, eta0, chi, b1, b2, b3, d1, d2, d3),
   degrees(chi + d1 * sin(2*chi) + d2 * sin(4*chi) + d3 * sin(6*chi)) AS lat, 21e0 + degrees(atan2(sinh(eta0), cos(xi0))) AS lon
 FROM (SELECT *, asin(sin(xi0) / cosh(eta0)) AS chi FROM (SELECT *,
   xi - b1 * sin(2*xi) * cosh(2*eta) - b2 * sin(4*xi) * cosh(4*eta) - b3 * sin(6*xi) * cosh(6*eta) AS xi0,
   eta - b1 * cos(2*xi) * sinh(2*eta) - b2 * cos(4*xi) * sinh(4*eta) - b3 * cos(6*xi) * sinh(6*eta) AS eta0
   FROM (SELECT *, (y - 10000000e0) / (0.9996e0 * a) AS xi, (x - 500000e0) / (0.9996e0 * a) AS eta,
     n/2 - 2*n*n/3 + 37*n*n*n/96 AS b1, n*n/48 + n*n*n/15 AS b2, 17*n*n*n/480 AS b3, 2*n - 2*n*n/3 - 2*n*n*n AS d1, 7*n*n/3 - 8*n*n*n/5 AS d2, 56*n*n*n/15 AS d3
     FROM (SELECT *, 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS a FROM (SELECT ot.*, {_ELL} AS f, {_ELL} / (2 - {_ELL}) AS n, 0e0 AS e2 FROM ot))))))"""
# Sampling indices need coordinates that do not sit on a cell edge within rounding.
_ALONG = f"""WITH {_ORIENTED}, pt AS (SELECT * FROM {_INVERSE}), {_sample_sql('pt', 'line_id, pos')},
al AS (SELECT pt.line_id, pt.pos, s_m, lat, lon, tx, ty, u, v, coalesce(m, false) AS m FROM pt LEFT JOIN sm ON sm.line_id = pt.line_id AND sm.pos = pt.pos)"""


@query(
    "geo_03_speed_along_channels",
    "line_id:i pos:i lat:f lon:f u_perp:f v_perp:f speed_perp:f v_along:f mask_front:b",
    _ALONG + " SELECT line_id, pos, lat, lon, u AS u_perp, v AS v_perp, CASE WHEN m THEN sqrt(u*u + v*v) END AS speed_perp, CASE WHEN m AND abs(u * tx + v * ty) >= 0.01e0 THEN u * tx + v * ty END AS v_along, m AS mask_front FROM al",
)
def _(t):
    return H.speed_along_channels(_field(t), t.channels, step_m=_STEP, apex=(-19.0, 22.9), min_speed=0.01)


@query(
    "geo_03b_reach_median",
    "line_id:i v_along_median:f",
    _ALONG + " SELECT line_id, median(u * tx + v * ty) AS v_along_median FROM al WHERE m AND u IS NOT NULL AND v IS NOT NULL GROUP BY line_id",
)
def _(t):
    return H.reach_medians(H.speed_along_channels(_field(t), t.channels, step_m=_STEP, apex=(-19.0, 22.9)))


_NEAREST = f"""WITH {_ORIENTED},
cl AS (SELECT * FROM {_utm_sql(_FLD)}),
nn AS (SELECT iy, ix, any_value(u_perp) AS u, any_value(v_perp) AS v, min((cl.x - ot.x) * (cl.x - ot.x) + (cl.y - ot.y) * (cl.y - ot.y)) AS d2,
              arg_min(struct_pack(tx := tx, ty := ty), struct_pack(d := (cl.x - ot.x) * (cl.x - ot.x) + (cl.y - ot.y) * (cl.y - ot.y), l := line_id, p := pos)) AS t
       FROM cl, ot WHERE mask_front AND u_perp IS NOT NULL GROUP BY iy, ix)"""


@query(
    "geo_04_parallel_to_channel",
    "iy:i ix:i v_parallel:f v_parallel_abs:f dist_km:f",
    _NEAREST + f""" SELECT f.iy, f.ix, nn.u * t.tx + nn.v * t.ty AS v_parallel, abs(nn.u * t.tx + nn.v * t.ty) AS v_parallel_abs, sqrt(d2) / 1e3 AS dist_km
    FROM {_FLD} f LEFT JOIN (SELECT * FROM nn WHERE d2 <= 40000e0 * 40000e0) nn ON nn.iy = f.iy AND nn.ix = f.ix""",
)
def _(t):
    out = H.parallel_to_channel(_field(t), t.channels, step_m=_STEP, apex=(-19.0, 22.9), max_distance_m=40000.0)
    return out.withColumn("dist_km", F.col("dist_to_channel_m") / 1e3)


@query(
    "jn_09_nearest_channel",
    "iy:i ix:i line_id:i pos:i dist_km:f",
    f"""WITH {_SAMPLES}, cl AS (SELECT * FROM {_utm_sql(_FLD)}),
        nn AS (SELECT iy, ix, min((cl.x - tn.x) * (cl.x - tn.x) + (cl.y - tn.y) * (cl.y - tn.y)) AS d2, arg_min(struct_pack(l := line_id, p := pos), struct_pack(d := (cl.x - tn.x) * (cl.x - tn.x) + (cl.y - tn.y) * (cl.y - tn.y), l := line_id, p := pos)) AS b FROM cl, tn GROUP BY iy, ix)
        SELECT iy, ix, b.l AS line_id, b.p AS pos, sqrt(d2) / 1e3 AS dist_km FROM nn""",
)
def _(t):
    zone = H.local_zone(t.channels)
    samples = H.channel_samples(t.channels, _STEP, None, zone).withColumn("sid", F.struct("line_id", "pos"))
    hit = H.nearest_sample(H.to_metres(_field(t), zone), samples, ["iy", "ix"], ["line_id", "pos"], 4 * _STEP)
    return hit.withColumn("dist_km", F.col("distance") / 1e3)


_AT = "(SELECT line_id, arg_min(x + (len * {0}e0 - (s1 - d)) / d * (x2 - x), seq) AS px, arg_min(y + (len * {0}e0 - (s1 - d)) / d * (y2 - y), seq) AS py FROM ch WHERE len * {0}e0 BETWEEN s1 - d AND s1 GROUP BY line_id)"


@query(
    "geo_11_point_and_angle",
    "line_id:i x_km:f y_km:f angle:f",
    f"""WITH {_SAMPLES}, a AS {_AT.format(0.35)}, b AS {_AT.format(0.36)}, g AS (SELECT a.line_id, a.px, a.py, degrees(atan2(b.py - a.py, b.px - a.px)) AS ang FROM a JOIN b ON a.line_id = b.line_id)
        SELECT line_id, px / 1e3 AS x_km, py / 1e3 AS y_km, CASE WHEN ang > 90 THEN ang - 180 WHEN ang < -90 THEN ang + 180 ELSE ang END AS angle FROM g""",
)
def _(t):
    p = H.points_at_fraction(H.to_metres(t.channels, H.local_zone(t.channels)), 0.35)
    return p.withColumns({"x_km": F.col("x") / 1e3, "y_km": F.col("y") / 1e3})


@query(
    "geo_11b_project_on_line",
    "c_custkey:i line_id:i dist_km:f s_km:f",
    f"""WITH {_SAMPLES}, pt AS (SELECT c_custkey, c_custkey % (SELECT count(*) FROM supplier) AS line_id, x AS px, y AS py FROM {_utm_sql(_PTS)}),
        pr AS (SELECT c_custkey, ch.line_id, seq, x, y, x2 - x AS ux, y2 - y AS uy, px, py, d, s1 - d AS s0, greatest(0e0, least(1e0, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / (d * d))) AS t FROM pt JOIN ch ON ch.line_id = pt.line_id),
        ds AS (SELECT *, sqrt((px - x - t * ux) * (px - x - t * ux) + (py - y - t * uy) * (py - y - t * uy)) AS dist FROM pr)
        SELECT c_custkey, line_id, min(dist) / 1e3 AS dist_km, arg_min(s0 + t * d, struct_pack(a := dist, b := seq)) / 1e3 AS s_km FROM ds GROUP BY c_custkey, line_id""",
)
def _(t):
    zone = H.local_zone(t.channels)
    lines = t.table("supplier").agg(F.count(F.lit(1))).scalar()
    pts = H.to_metres(_points(t), zone).select("c_custkey", (F.col("c_custkey") % lines).alias("line_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = H.project_on_lines(pts, H.to_metres(t.channels, zone))
    return out.withColumns({"dist_km": F.col("distance") / 1e3, "s_km": F.col("s_m") / 1e3})


@query(
    "sl_07_longest_and_nearest_part",
    "river:i longest:i nearest:i",
    f"""WITH {_SAMPLES}, ln AS (SELECT line_id, line_id % 4 AS river, max(len) AS len FROM ch GROUP BY line_id),
        bp AS (SELECT river, arg_min(line_id, struct_pack(a := -round(len, 3), b := line_id)) AS longest FROM ln GROUP BY river),
        q AS (SELECT x AS px, y AS py FROM {_utm_sql('(SELECT -19.1e0 AS lat, 22.7e0 AS lon)')}),
        pr AS (SELECT line_id, seq, x, y, x2 - x AS ux, y2 - y AS uy, px, py, greatest(0e0, least(1e0, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / (d * d))) AS t FROM ch, q),
        ds AS (SELECT line_id, line_id % 4 AS river, min(round(sqrt((px - x - t * ux) * (px - x - t * ux) + (py - y - t * uy) * (py - y - t * uy)), 3)) AS dist FROM pr GROUP BY line_id)
        SELECT bp.river, longest, (SELECT arg_min(line_id, struct_pack(a := dist, b := line_id)) FROM ds WHERE ds.river = bp.river) AS nearest FROM bp""",
)
def _(t):
    zone = H.local_zone(t.channels)
    lines = H.to_metres(t.channels, zone).withColumn("river", F.col("line_id") % 4)
    x, y = H.G.utm_forward(F.lit(-19.1), F.lit(22.7), "zone", "south")
    at = lines.select("river", x.alias("px"), y.alias("py")).distinct()
    a = H.longest_part(lines, "river", "line_id").groupBy("river").agg(F.max("line_id").alias("longest"))
    b = H.part_near_point(lines, at, "river", "line_id").groupBy("river").agg(F.max("line_id").alias("nearest"))
    return a.join(b, "river")


@query(
    "geo_12_named_regions",
    "name:s region:i area:f",
    """WITH cut AS (SELECT region, ring, sum(sign(x1 - x2) * (b - a) * (y1 + ((a + b) / 2 - x1) / (x2 - x1) * (y2 - y1) + 30)) AS a, side FROM (
         SELECT *, greatest(least(x1, x2), lo) AS a, least(greatest(x1, x2), hi) AS b FROM r_basin_edges, (VALUES ('west', -180e0, 22.6e0), ('east', 22.6e0, 180e0)) AS h(side, lo, hi) WHERE x1 <> x2 AND region = 4)
         WHERE b > a GROUP BY ALL),
       whole AS (SELECT region, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM r_basin_edges WHERE region <> 4 GROUP BY ALL)
       SELECT CASE side WHEN 'west' THEN 'upper' ELSE 'east_lower' END AS name, region, sum(abs(a) * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS area FROM cut GROUP BY ALL
       UNION ALL SELECT CASE region WHEN 2 THEN 'delta' WHEN 7 THEN 'highlands' END, region, sum(a * CASE WHEN ring = 0 THEN 1 ELSE -1 END) FROM whole GROUP BY region""",
)
def _(t):
    named = A.assemble_regions(t.basins, {2: "delta", 7: "highlands"}, 4, 22.6, ("upper", "east_lower"))
    key = F.concat_ws("/", F.col("region").cast("string"), F.coalesce("name", F.lit("")))
    m = P.measures(named.withColumn("region", key))
    return m.select(
        F.split("region", "/")[0].cast("bigint").alias("region"), F.nullif(F.split("region", "/")[1], F.lit("")).alias("name"), "area"
    )


_IN_BOX = _OVERLAP.replace(
    "SELECT DISTINCT iy * 100 + ix AS rect, lon - 0.125e0 AS west, lon + 0.125e0 AS east, lat - 0.125e0 AS south, lat + 0.125e0 AS north FROM r_grid",
    "SELECT 0 AS rect, 21.9e0 AS west, 23.1e0 AS east, -20.2e0 AS south, -18.4e0 AS north",
).replace("r_basin_edges", "r_lake_edges")


@query("src_12b_features_in_box", "region:i area:f", f"SELECT region, shared AS area FROM ({_IN_BOX})")
def _(t):
    inside = P.clip_box(t.lakes, 21.9, -20.2, 23.1, -18.4)
    return P.measures(inside).where("area > 1e-12").select("region", "area")


@query(
    "so_07_dissolve",
    "group:i vertices:i parts:i area:f",
    """WITH e AS (SELECT region % 4 AS g, region, x1, y1, x2, y2, (x2 - x1) / (y2 - y1) AS m FROM r_lake_edges WHERE y1 <> y2),
       c AS (SELECT a.g, (b.x1 - b.y1 * b.m - a.x1 + a.y1 * a.m) / (a.m - b.m) AS y, greatest(least(a.y1, a.y2), least(b.y1, b.y2)) AS lo, least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) AS hi
             FROM e a JOIN e b ON a.g = b.g AND a.region < b.region AND a.m <> b.m),
       y AS (SELECT g, y1 AS y FROM e UNION SELECT g, y FROM c WHERE y > lo AND y < hi),
       s AS (SELECT g, y AS lo, lead(y) OVER (PARTITION BY g ORDER BY y) AS hi FROM y),
       x AS (SELECT s.g, lo, hi, region, x1 + ((lo + hi) / 2 - y1) * m AS x FROM s JOIN e ON e.g = s.g AND least(y1, y2) < (lo + hi) / 2 AND greatest(y1, y2) > (lo + hi) / 2),
       i AS (SELECT g, lo, hi, x AS x0, lead(x) OVER w AS x1, row_number() OVER w AS k FROM x WINDOW w AS (PARTITION BY g, lo, region ORDER BY x)),
       f AS (SELECT g, hi - lo AS h, greatest(0, x1 - greatest(x0, coalesce(max(x1) OVER (PARTITION BY g, lo ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x0))) AS w FROM i WHERE k % 2 = 1)
       SELECT v.g AS "group", vertices, parts, area FROM (SELECT region % 4 AS g, count(*) AS vertices, count(DISTINCT region) AS parts FROM r_lake_edges GROUP BY ALL) v
       JOIN (SELECT g, sum(w * h) AS area FROM f GROUP BY g) a ON a.g = v.g""",
)
def _(t):
    merged = A.dissolve(t.lakes.withColumn("group", F.col("region") % 4), "group")
    counts = merged.groupBy(F.col("region").alias("group")).agg(F.count(F.lit(1)).alias("vertices"), F.count_distinct("part").alias("parts"))
    return counts.join(A.union_area(t.lakes.withColumn("group", F.col("region") % 4), "group").withColumnRenamed("region", "group"), "group")
