"""Queries for stencils, snapshot pairs and front motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fronts as V
from ..operators import grid as O
from ..operators.zonal import summary
from .registry import query


def _gradient_sql(source: str, keys: str, f: str) -> str:
    """df_dx and df_dy of column ``f`` of ``source (keys, iy, ix, lat, f)`` on the 6 x 6 grid."""
    on = " AND ".join(f"{{0}}.{k} = c.{k}" for k in keys.split(", "))
    near = []
    for axis, other in (("iy", "ix"), ("ix", "iy")):
        for k in (-2, -1, 1, 2):
            a = f"{axis[1]}{'m' if k < 0 else 'p'}{abs(k)}"
            near.append(f"LEFT JOIN {source} {a} ON {on.format(a)} AND {a}.{axis} = c.{axis} + ({k}) AND {a}.{other} = c.{other}")

    def slope(x: str) -> str:
        return f"""CASE WHEN c.i{x} = 0 THEN (-3 * c.{f} + 4 * {x}p1.{f} - {x}p2.{f}) / 0.5e0
                        WHEN c.i{x} = 5 THEN (3 * c.{f} - 4 * {x}m1.{f} + {x}m2.{f}) / 0.5e0
                        ELSE ({x}p1.{f} - {x}m1.{f}) / 0.5e0 END"""

    return f"""SELECT c.*, {slope('y')} / 111132e0 AS df_dy,
                      {slope('x')} / (111320e0 * cos(radians(c.lat))) AS df_dx FROM {source} c {' '.join(near)}"""


@query(
    "wn_13_gradient",
    "time:d iy:i ix:i gx:f gy:f",
    f"SELECT time, iy, ix, df_dx * 1e6 AS gx, df_dy * 1e6 AS gy FROM ({_gradient_sql('r_cube', 'time', 'value')})",
)
def _(t):
    g = O.spatial_gradient(t.kept_cube, tile=4)
    return g.select("time", "iy", "ix", (F.col("df_dx") * 1e6).alias("gx"), (F.col("df_dy") * 1e6).alias("gy"))


def _smooth_sql(source: str, f: str, size: int) -> str:
    lo, hi = -(size // 2), size - 1 - size // 2
    return f"""SELECT c.time, c.iy, c.ix, CASE WHEN count(n.{f}) = {size * size} THEN sum(n.{f}) / {size * size}e0 END AS value
               FROM {source} c JOIN {source} n ON n.time = c.time AND n.iy - c.iy BETWEEN {lo} AND {hi} AND n.ix - c.ix BETWEEN {lo} AND {hi}
               GROUP BY ALL"""


@query("wn_14_box_smooth", "time:d iy:i ix:i value:f", _smooth_sql("r_cube", "value", 3))
def _(t):
    return O.smooth(t.kept_cube, 3, tile=4)


@query("wn_14b_box_smooth_even", "time:d iy:i ix:i value:f", _smooth_sql("r_grid", "value", 2))
def _(t):
    return O.smooth(t.grid, 2, tile=5)


@query(
    "jn_07_nearest_time",
    "t1:d t2:d",
    """SELECT arg_min(time, struct_pack(a := abs(date_diff('day', time, DATE '1996-02-20')), b := -date_diff('day', DATE '1970-01-01', time))) AS t1,
              arg_min(time, struct_pack(a := abs(date_diff('day', time, DATE '1999-08-10')), b := -date_diff('day', DATE '1970-01-01', time))) AS t2
       FROM (SELECT DISTINCT time FROM r_cube)""",
)
def _(t):
    return V.nearest_pair(t.kept_cube, "1996-02-20", "1999-08-10")


_STEPS = "SELECT t1, t2, CAST(date_diff('day', t1, t2) AS DOUBLE) AS delta_days FROM (SELECT time AS t1, lead(time) OVER (ORDER BY time) AS t2 FROM (SELECT DISTINCT time FROM r_cube)) WHERE t2 IS NOT NULL"


@query("wn_15_time_steps", "t1:d t2:d delta_days:f", f"SELECT * FROM ({_STEPS}) WHERE delta_days <= 91")
def _(t):
    return V.time_steps(t.kept_cube, max_gap_days=91)


def _field_ctes(pairs: str, smooth: bool = False, band: str = "grad_mag >= edge") -> str:
    return f"""
WITH p AS ({pairs}),
m AS (SELECT *, 0.5e0 * (f1 + f2) AS f_mid, (f2 - f1) / date_diff('day', t1, t2) AS df_dt FROM p),
g AS ({_gradient_sql('m', 't1', 'f_mid')}),
h AS (SELECT *, sqrt(df_dx * df_dx + df_dy * df_dy) AS grad_mag FROM g),
q AS (SELECT t1, quantile_cont(grad_mag, 0.9) AS edge, median(grad_mag) AS med FROM h GROUP BY t1),
v AS (SELECT h.*, coalesce({band} AND grad_mag > med * 1e-3, false) AS mask_front,
             -df_dt / greatest(grad_mag, 1e-12) AS vn, df_dx / greatest(grad_mag, 1e-12) AS nx, df_dy / greatest(grad_mag, 1e-12) AS ny
      FROM h LEFT JOIN q ON q.t1 = h.t1),
f AS (SELECT *, CASE WHEN mask_front THEN vn END AS v_normal, CASE WHEN mask_front THEN vn * nx END AS u_perp, CASE WHEN mask_front THEN vn * ny END AS v_perp,
             CASE WHEN mask_front THEN nx END AS n_x, CASE WHEN mask_front THEN ny END AS n_y, date_diff('day', t1, t2) AS delta_days FROM v)"""


_ADJACENT = """SELECT s.t1, s.t2, g.iy, g.ix, any_value(g.lat) AS lat, any_value(g.lon) AS lon, max(g.value) FILTER (g.time = s.t1) AS f1, max(g.value) FILTER (g.time = s.t2) AS f2
               FROM r_cube g JOIN (SELECT time AS t1, lead(time) OVER (ORDER BY time) AS t2 FROM (SELECT DISTINCT time FROM r_cube)) s ON g.time = s.t1 OR g.time = s.t2
               WHERE s.t2 IS NOT NULL GROUP BY ALL"""
_TWO = """SELECT DATE '1996-04-01' AS t1, DATE '1999-07-01' AS t2, iy, ix, any_value(lat) AS lat, any_value(lon) AS lon,
                 max(value) FILTER (time = DATE '1996-04-01') AS f1, max(value) FILTER (time = DATE '1999-07-01') AS f2
          FROM r_cube WHERE time IN (DATE '1996-04-01', DATE '1999-07-01') GROUP BY iy, ix"""

_FIELD = "t1:d t2:d iy:i ix:i v_km:f u_km:f vp_km:f n_x:f n_y:f grad:f rate:f mask_front:b"
_FIELD_SQL = """ SELECT t1, t2, iy, ix, v_normal / 1e3 AS v_km, u_perp / 1e3 AS u_km, v_perp / 1e3 AS vp_km, n_x, n_y, grad_mag * 1e6 AS grad, df_dt * 1e3 AS rate, mask_front FROM f"""


def _km(field):
    return field.select(
        "t1", "t2", "iy", "ix", (F.col("v_normal") / 1e3).alias("v_km"), (F.col("u_perp") / 1e3).alias("u_km"),
        (F.col("v_perp") / 1e3).alias("vp_km"), "n_x", "n_y", (F.col("grad_mag") * 1e6).alias("grad"),
        (F.col("df_dt") * 1e3).alias("rate"), "mask_front",
    )


def _pair_field(t, **kw):
    return V.front_velocity(V.snapshot_pair(t.kept_cube, "1996-04-03", "1999-06-20"), t.kept_cube, tile=4, **kw)


@query("geo_01_front_velocity", _FIELD, _field_ctes(_TWO) + _FIELD_SQL)
def _(t):
    return _km(_pair_field(t))


@query("geo_01b_front_band", _FIELD, _field_ctes(_TWO, band="abs(f_mid - 0.5e0) <= 0.05e0") + _FIELD_SQL)
def _(t):
    return _km(_pair_field(t, front_value=0.5, bandwidth=0.05))


def _smooth_pairs(size: int) -> str:
    lo, hi = -(size // 2), size - 1 - size // 2
    part = lambda f: f"CASE WHEN count(n.{f}) = {size * size} THEN sum(n.{f}) / {size * size}e0 END AS {f}"
    return f"""SELECT c.t1, c.t2, c.iy, c.ix, any_value(c.lat) AS lat, any_value(c.lon) AS lon, {part('f1')}, {part('f2')}
               FROM ({_TWO}) c JOIN ({_TWO}) n ON n.iy - c.iy BETWEEN {lo} AND {hi} AND n.ix - c.ix BETWEEN {lo} AND {hi} GROUP BY c.t1, c.t2, c.iy, c.ix"""


@query("geo_01c_front_smoothed", _FIELD, _field_ctes(_smooth_pairs(2)) + _FIELD_SQL)
def _(t):
    return _km(_pair_field(t, smooth_px=2))


_CLASS_SQL = """, d AS (SELECT *, sqrt(u_perp * u_perp + v_perp * v_perp) AS speed, u_perp * (1 / sqrt(2e0)) - v_perp * (1 / sqrt(2e0)) AS v_SE,
       (lon - 22e0) * 111320e0 * cos(radians(lat)) AS dx, (lat + 19.6e0) * 111132e0 AS dy FROM f),
e AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, v_SE / greatest(speed, 1e-12))))) AS a_se,
             (u_perp * dx + v_perp * dy) / greatest(sqrt(dx * dx + dy * dy), 1e-12) AS v_out FROM d),
c AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, v_out / greatest(speed, 1e-12))))) AS a_out FROM e),
k AS (SELECT *, coalesce(mask_front AND speed >= 10 AND a_se <= 60, false) AS al_se, coalesce(mask_front AND speed >= 10 AND a_out <= 60, false) AS al_out FROM c)"""


def _classified(t):
    field = V.front_velocity(V.adjacent_pairs(t.kept_cube), t.kept_cube, tile=4)
    return V.classify_direction(field, angle_tol_deg=60.0, min_speed=10.0, apex=(-19.6, 22.0))


@query(
    "geo_02_direction_classes",
    "t1:d iy:i ix:i v_se_km:f a_se:f al_se:b v_out_km:f a_out:f al_out:b",
    _field_ctes(_ADJACENT) + _CLASS_SQL
    + " SELECT t1, iy, ix, v_SE / 1e3 AS v_se_km, CASE WHEN mask_front THEN a_se END AS a_se, al_se, v_out / 1e3 AS v_out_km, CASE WHEN mask_front THEN a_out END AS a_out, al_out FROM k",
)
def _(t):
    return _classified(t).select(
        "t1", "iy", "ix", (F.col("v_SE") / 1e3).alias("v_se_km"), F.col("angle_to_SE").alias("a_se"),
        F.col("aligned_SE").alias("al_se"), (F.col("v_outward_apex") / 1e3).alias("v_out_km"),
        F.col("angle_to_outward").alias("a_out"), F.col("aligned_outward").alias("al_out"),
    )


@query(
    "ag_43_front_summary",
    "t1:d front_pixels:i pct_aligned_SE:f median_km:f pct_aligned_outward:f median_out_km:f",
    _field_ctes(_ADJACENT) + _CLASS_SQL
    + """ SELECT t1, count(*) FILTER (mask_front) AS front_pixels, 100e0 * count(*) FILTER (al_se) / greatest(count(*) FILTER (mask_front), 1) AS "pct_aligned_SE",
         median(v_SE) / 1e3 AS median_km, 100e0 * count(*) FILTER (al_out) / greatest(count(*) FILTER (mask_front), 1) AS pct_aligned_outward, median(v_out) / 1e3 AS median_out_km FROM k GROUP BY t1""",
)
def _(t):
    s = V.front_summary(_classified(t))
    return s.withColumns({"median_km": F.col("median_v_SE") / 1e3, "median_out_km": F.col("median_v_outward") / 1e3})


def _climatology_sql(w: str) -> str:
    return _field_ctes(_ADJACENT) + f""",
g2 AS (SELECT month(t1 + CAST((date_diff('day', t1, t2) // 2) AS INTEGER)) AS month, iy, ix, sum(v_normal * {w}) / sum({w}) / 1e3 AS v_km, sum(u_perp * {w}) / sum({w}) / 1e3 AS u_km,
              sum(v_perp * {w}) / sum({w}) / 1e3 AS vp_km, count(*) AS pairs FROM f WHERE v_normal IS NOT NULL GROUP BY ALL)
SELECT m.month, c.iy, c.ix, v_km, u_km, vp_km, coalesce(pairs, 0) AS pairs_count FROM (SELECT DISTINCT iy, ix FROM r_cube) c
CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN g2 ON g2.month = m.month AND g2.iy = c.iy AND g2.ix = c.ix"""


def _climatology(t, weighted: bool):
    field = V.front_velocity(V.adjacent_pairs(t.kept_cube), t.kept_cube, tile=4)
    c = V.velocity_climatology(field, t.kept_cube, weighted)
    return c.withColumns({"v_km": F.col("v_normal_mean") / 1e3, "u_km": F.col("u_perp_mean") / 1e3, "vp_km": F.col("v_perp_mean") / 1e3})


@query("ag_42_velocity_climatology", "month:i iy:i ix:i v_km:f u_km:f vp_km:f pairs_count:i", _climatology_sql("1e0"))
def _(t):
    return _climatology(t, False)


@query("ag_42b_velocity_climatology_weighted", "month:i iy:i ix:i v_km:f u_km:f vp_km:f pairs_count:i", _climatology_sql("delta_days"))
def _(t):
    return _climatology(t, True)


@query("ag_34_robust_limit", "limit:f", "SELECT quantile_cont(abs(value - 0.5e0), 0.98) AS \"limit\" FROM r_grid")
def _(t):
    return V.robust_limit(t.kept_grid.withColumn("value", F.col("value") - 0.5), "value")


@query(
    "ag_46_mean_field_limits",
    "low:f high:f",
    "SELECT quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM (SELECT avg(value) AS m FROM r_grid GROUP BY iy, ix)",
)
def _(t):
    return V.mean_field_limits(t.grid)


@query("ag_35_summary", "iy:i min:f max:f mean:f", "SELECT iy, min(value) AS min, max(value) AS max, avg(value) AS mean FROM r_grid GROUP BY iy")
def _(t):
    return summary(t.grid, ["iy"])
