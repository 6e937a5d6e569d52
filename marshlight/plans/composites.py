"""Queries for composites, transitions and seasonal maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import composite as K
from ..operators import grid as O
from ..operators import zonal as Z
from .registry import query
from .zones import _AREA, _HIST

_CODES = range(5)


@query(
    "ag_14_class_climatology",
    "month:i " + " ".join(f"mean_{c}:f std_{c}:f" for c in _CODES),
    f"""WITH h AS (SELECT time, {_HIST} FROM r_grid GROUP BY time)
        SELECT month(time) AS month, {', '.join(f'avg(class_{c} * 0.0009e0) AS mean_{c}, stddev_samp(class_{c} * 0.0009e0) AS std_{c}' for c in _CODES)}
        FROM h GROUP BY ALL""",
)
def _(t):
    return K.class_climatology(Z.class_histogram(t.classes, ["time"]))


_TRANS = """SELECT a.year, a.iy, a.ix, a.cls * 10 + b.cls AS code FROM r_grid a
            JOIN r_grid b ON a.year = b.year AND a.iy = b.iy AND a.ix = b.ix AND a.month = 1 AND b.month = 7"""


@query("sc_12_transition_code", "year:i iy:i ix:i code:i", _TRANS)
def _(t):
    return K.transitions(t.classes, 1, 7)


@query(
    "ag_15_transition_histogram",
    "year:i code:i pixels:i km2:f",
    f"""WITH t AS ({_TRANS}), k AS (SELECT a * 10 + b AS code FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b))
        SELECT y.year, k.code, count(t.code) AS pixels, count(t.code) * 0.0009e0 AS km2
        FROM (SELECT DISTINCT year FROM t) y CROSS JOIN k LEFT JOIN t ON t.year = y.year AND t.code = k.code GROUP BY ALL""",
)
def _(t):
    return K.transition_histogram(K.transitions(t.classes, 1, 7))


@query(
    "ag_16_modal_transition",
    "iy:i ix:i code:i share:f",
    f"""WITH t AS ({_TRANS}), c AS (SELECT iy, ix, code, count(*) AS n FROM t GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, code) AS k FROM c)
        SELECT r.iy, r.ix, r.code, s.share FROM r JOIN (SELECT iy, ix, avg(CASE WHEN code = 14 THEN 1e0 ELSE 0e0 END) AS share FROM t GROUP BY iy, ix) s
        ON s.iy = r.iy AND s.ix = r.ix WHERE k = 1""",
)
def _(t):
    codes = K.transitions(t.classes, 1, 7)
    return K.modal_transition(codes).join(K.transition_share(codes, 14), ["iy", "ix"])


@query(
    "ag_17_transition_area",
    "year:i km2:f",
    f"""SELECT year, sum(CASE WHEN code = 4 THEN {_AREA.format('')} ELSE 0 END) AS km2
        FROM (SELECT *, -20.25e0 + 0.25e0 * iy AS lat FROM ({_TRANS})) GROUP BY year""",
)
def _(t):
    area = O.with_cell_area(t.grid.select("iy", "ix", "lat", "lon").distinct())
    return K.transition_area(K.transitions(t.classes, 1, 7), area, 4)


@query(
    "ag_18_wetness",
    "iy:i ix:i ever_wet:b wet_count:i wet_frac:f",
    """SELECT iy, ix, count(*) FILTER (value >= 0.5e0) > 0 AS ever_wet, count(*) FILTER (value >= 0.5e0) AS wet_count,
              count(*) FILTER (value >= 0.5e0) / (SELECT count(DISTINCT time) FROM r_grid) AS wet_frac FROM r_grid GROUP BY iy, ix""",
)
def _(t):
    return K.wetness(t.grid)


def _jas_binary(t):
    return t.classes.where("month BETWEEN 7 AND 9").select("year", "iy", "ix", (F.col("cls") > 3).cast("double").alias("value"))


def _coded(t):
    return t.classes.where("month = 9").select("year", "iy", "ix", F.least("cls", F.lit(3)).cast("double").alias("value"))


_LS = """SELECT iy, ix, avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) AS share FROM
         (SELECT year, iy, ix, avg(CASE WHEN cls > 3 THEN 1e0 ELSE 0e0 END) AS v FROM r_grid WHERE month BETWEEN 7 AND 9 GROUP BY ALL) GROUP BY ALL"""
_IL = """SELECT iy, ix, avg(CASE WHEN cls = 1 THEN 1e0 ELSE 0e0 END) AS share FROM r_grid WHERE month = 9 AND cls < 3 GROUP BY ALL"""


@query(
    "ag_19_wet_year_share",
    "iy:i ix:i difference:f",
    f"""SELECT coalesce(a.iy, b.iy) AS iy, coalesce(a.ix, b.ix) AS ix, nullif(coalesce(a.share, 0) - coalesce(b.share, 0), 0) AS difference
        FROM ({_LS}) a FULL JOIN ({_IL}) b ON a.iy = b.iy AND a.ix = b.ix""",
)
def _(t):
    v = F.col("value")
    return K.share_difference(
        K.wet_year_share(_jas_binary(t)), K.wet_year_share(_coded(t), valid=v != 3, wet=v == 1)
    )


@query(
    "ag_20_wet_months",
    "iy:i ix:i wet_months:f",
    """SELECT iy, ix, count(*) FILTER (cls > 2) / (SELECT count(DISTINCT year) FROM r_grid) AS wet_months FROM r_grid GROUP BY iy, ix""",
)
def _(t):
    return K.mean_wet_months(t.classes.withColumn("value", (F.col("cls") > 2).cast("double")))


@query(
    "ag_20b_wet_months_by_year",
    "year:i iy:i ix:i wet_months:i",
    "SELECT year, iy, ix, count(*) FILTER (cls > 2) AS wet_months FROM r_grid GROUP BY ALL",
)
def _(t):
    return K.wet_months_per_year(t.classes.withColumn("value", (F.col("cls") > 2).cast("double")))


@query(
    "ag_21_agreement",
    "code:i cells:i",
    """WITH a AS (SELECT iy, ix, avg(value) > 0.5e0 AS wet FROM r_grid GROUP BY ALL), b AS (SELECT iy, ix, avg(cls) >= 2 AS wet FROM r_grid GROUP BY ALL),
       c AS (SELECT CASE WHEN coalesce(a.wet, false) AND coalesce(b.wet, false) THEN 2 WHEN a.wet THEN 1 WHEN b.wet THEN 3 END AS code
             FROM a FULL JOIN b ON a.iy = b.iy AND a.ix = b.ix)
       SELECT code, count(*) AS cells FROM c WHERE code IS NOT NULL GROUP BY code""",
)
def _(t):
    a = t.grid.groupBy("iy", "ix").agg((F.avg("value") > 0.5).alias("wet"))
    b = t.classes.groupBy("iy", "ix").agg((F.avg("cls") >= 2).alias("wet"))
    return K.agreement(a, b).groupBy("code").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "ag_24_season_by_year",
    "year:i jas_mean:f flood_max:f annual_max:f",
    """SELECT year(month) AS year, avg(mm) FILTER (month(month) BETWEEN 7 AND 9) AS jas_mean, max(mm) FILTER (month(month) BETWEEN 4 AND 12) AS flood_max,
              max(mm) AS annual_max FROM r_rain GROUP BY ALL""",
)
def _(t):
    s = t.rain.withColumnRenamed("month", "date")
    a = K.season_by_year(s, "mm", (7, 8, 9), "mean").withColumnRenamed("mm", "jas_mean")
    b = K.season_by_year(s, "mm", range(4, 13), "max").withColumnRenamed("mm", "flood_max")
    c = K.season_by_year(s, "mm", None, "max").withColumnRenamed("mm", "annual_max")
    return c.join(a, "year", "left").join(b, "year", "left")


@query(
    "ag_25_calendar_month_mean",
    "dataset:s month:i mm:f",
    """SELECT d.dataset, m.month, e.mm FROM (SELECT DISTINCT dataset FROM r_et) d CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
       LEFT JOIN (SELECT dataset, month(month) AS month, avg(mm) AS mm FROM r_et GROUP BY ALL) e ON e.dataset = d.dataset AND e.month = m.month""",
)
def _(t):
    return K.by_calendar_month(t.et, "mm", ["dataset"], "month")


@query(
    "ag_26_period_change",
    "iy:i ix:i early:f late:f change:f",
    """SELECT *, coalesce(late - early, 0) AS change FROM (
         SELECT iy, ix, avg(CASE WHEN cls > 3 THEN 1e0 ELSE 0e0 END) FILTER (year BETWEEN 1995 AND 1996) AS early,
                avg(CASE WHEN cls > 3 THEN 1e0 ELSE 0e0 END) FILTER (year BETWEEN 1999 AND 2001) AS late
         FROM r_grid WHERE month BETWEEN 7 AND 9 GROUP BY iy, ix) WHERE early = 0""",
)
def _(t):
    v = t.classes.withColumn("value", (F.col("cls") > 3).cast("double"))
    return K.period_change(v, (1995, 1996), (1999, 2001))


@query(
    "ag_26b_yearly_difference",
    "year:i iy:i ix:i difference:f",
    """WITH y AS (SELECT year, iy, ix, avg(value) AS v FROM r_grid GROUP BY ALL)
       SELECT y.year, y.iy, y.ix, y.v - b.v AS difference FROM y JOIN y b ON b.year = 1996 AND b.iy = y.iy AND b.ix = y.ix""",
)
def _(t):
    return K.yearly_difference(t.grid.withColumn("year", F.year("time")), 1996)


@query(
    "ag_26c_product_difference",
    "year:i iy:i ix:i difference:f",
    "SELECT year, iy, ix, avg(value) - avg(cls / 4e0) AS difference FROM r_grid GROUP BY ALL",
)
def _(t):
    other = t.classes.withColumn("value", F.col("cls") / 4.0)
    return K.product_difference(t.grid.withColumn("year", F.year("time")), other)


_SCENES = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(l_partkey % 12 AS INTEGER) AS iy, CAST((l_partkey // 12) % 12 AS INTEGER) AS ix,
             (l_discount * 10000 - l_tax * 10000) / nullif(l_discount * 10000 + l_tax * 10000, 0) AS index FROM lineitem
             WHERE (CAST(l_suppkey % 4096 AS INTEGER) & 3072) = 0"""


@query(
    "ag_27_median_composite",
    "month:d iy:i ix:i index:f",
    f"SELECT month, iy, ix, median(index) AS index FROM ({_SCENES}) GROUP BY ALL",
)
def _(t):
    scenes = t.table("lineitem").where(R.clear_sky((F.col("l_suppkey") % 4096).cast("int"), "ten_metre")).select(
        F.trunc("l_shipdate", "MM").alias("month"),
        (F.col("l_partkey") % 12).cast("int").alias("iy"),
        (F.expr("l_partkey div 12") % 12).cast("int").alias("ix"),
        R.normalized_difference(F.col("l_discount") * 10000, F.col("l_tax") * 10000).alias("index"),
    )
    return K.median_composite(scenes, ["month"], ["index"])


@query(
    "ag_28_masked_index_mean",
    "time:d mean:f masked:f",
    """WITH w AS (SELECT iy, ix FROM r_grid GROUP BY ALL HAVING avg(value) > 0.5e0)
       SELECT g.time, avg(value) * 0.0001e0 * 10000 AS mean, avg(value) FILTER (w.iy IS NOT NULL) AS masked
       FROM r_grid g LEFT JOIN w ON w.iy = g.iy AND w.ix = g.ix GROUP BY g.time""",
)
def _(t):
    wet = t.grid.groupBy("iy", "ix").agg(F.avg("value").alias("m")).where("m > 0.5")
    raw = t.grid.withColumn("value", F.col("value") * 10000)
    a = K.masked_means(raw, None, ["time"], 0.0001)
    b = K.masked_means(raw, wet, ["time"], 0.0001).withColumnRenamed("mean", "masked")
    return a.join(b, "time", "left")


@query(
    "ag_29_tile_means",
    "time:d row:i col:i mean:f",
    """SELECT time, CAST(floor((lat + 20.5e0) / 1) AS INTEGER) AS row, CAST(floor((lon - 21.25e0) / 1) AS INTEGER) AS col, avg(value) AS mean
       FROM r_grid GROUP BY ALL""",
)
def _(t):
    return K.tile_means(t.grid, 21.25, -20.5, 1.0, ["time"])


@query(
    "ag_47_fuse_sensors",
    "month:d a:f b:f fused:f",
    """SELECT coalesce(a.month, b.month) AS month, a.mm AS a, b.mm AS b, greatest(coalesce(a.mm, b.mm), coalesce(b.mm, a.mm)) AS fused
       FROM (SELECT * FROM r_et WHERE dataset = '1-URGENT') a
       FULL JOIN (SELECT * FROM r_et WHERE dataset = '2-HIGH') b ON a.month = b.month""",
)
def _(t):
    a = t.et.where("dataset = '1-URGENT'").select("month", F.col("mm").alias("a"))
    b = t.et.where("dataset = '2-HIGH'").select("month", F.col("mm").alias("b"))
    return K.fuse_sensors(a.join(b, "month", "full"), ["a", "b"], "fused")


_PAIR = """SELECT a.iy, a.ix, b.value - a.value AS d FROM r_grid a JOIN r_grid b
           ON a.year = b.year AND a.iy = b.iy AND a.ix = b.ix AND a.month = 3 AND b.month = 8"""


@query(
    "jn_14_month_pair",
    "iy:i ix:i mean:f median:f years:i",
    f"SELECT iy, ix, avg(d) AS mean, median(d) AS median, count(*) AS years FROM ({_PAIR}) GROUP BY ALL",
)
def _(t):
    a = K.month_pair_composite(t.grid, 3, 8).withColumnRenamed("difference", "mean")
    b = K.month_pair_composite(t.grid, 3, 8, "median").select("iy", "ix", F.col("difference").alias("median"))
    return a.join(b, ["iy", "ix"]).where("years > 0")


def _lagged_sql(mean: str, having: str = "") -> str:
    return f"""
WITH p AS (SELECT month(b.time) AS month, b.iy, b.ix, b.value - a.value AS d,
                  CAST(date_diff('day', a.time, b.time) AS DOUBLE) AS dt
           FROM r_grid b JOIN r_grid a ON a.iy = b.iy AND a.ix = b.ix AND CAST(a.time + INTERVAL 2 MONTH AS DATE) = b.time),
g AS (SELECT month, iy, ix, {mean} AS diff_mean, median(d) AS diff_median, count(*) AS pairs FROM p {having} GROUP BY ALL)
SELECT m.month, c.iy, c.ix, diff_mean, diff_median, coalesce(pairs, 0) AS pairs
FROM (SELECT DISTINCT iy, ix FROM r_grid) c CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
LEFT JOIN g ON g.month = m.month AND g.iy = c.iy AND g.ix = c.ix"""


@query("wn_16_lagged_composite", "month:i iy:i ix:i diff_mean:f diff_median:f pairs:i", _lagged_sql("avg(d)"))
def _(t):
    return K.lagged_composite(t.grid, 2)


@query(
    "wn_16b_lagged_weighted", "month:i iy:i ix:i diff_mean:f pairs:i",
    _lagged_sql("sum(d * dt) / sum(dt)", "WHERE dt <= 61"),
)
def _(t):
    return K.lagged_composite(t.grid, 2, max_gap_days=61, weight_by_dt=True)
