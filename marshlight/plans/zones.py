"""Queries for polygons, zonal statistics and basin areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as O
from ..operators import polygons as P
from ..operators import zonal as Z
from ..operators.regions import edge_alignment
from .registry import query


def _tagged(t, *carry):
    return P.cells_in_regions(t.kept_grid, t.kept_mask, carry)


# Depth in mm of a full cell; a power of two, like the fractions it scales.
_MM = 128.0
_AREA = "6371.0088e0 * 6371.0088e0 * radians(0.25e0) * radians(0.25e0) * cos(radians({}lat))"
_BAND = "6371e0 * 6371e0 * radians(0.25e0) * abs(sin(radians({0}lat + 0.125e0)) - sin(radians({0}lat - 0.125e0)))"


@query(
    "jn_10_point_in_polygon",
    "time:d region:i iy:i ix:i value:f",
    "SELECT time, region, g.iy, g.ix, value FROM r_grid g JOIN r_mask m ON g.iy = m.iy AND g.ix = m.ix",
)
def _(t):
    return _tagged(t)


_OVERLAP = """
WITH c AS (SELECT DISTINCT iy * 100 + ix AS rect, lon - 0.125e0 AS west, lon + 0.125e0 AS east, lat - 0.125e0 AS south, lat + 0.125e0 AS north FROM r_grid),
p AS (SELECT rect, region, ring, west, east, south, north, sign(x1 - x2) AS s, greatest(least(x1, x2), west) AS a, least(greatest(x1, x2), east) AS b,
             x1, y1, x2, y2
      FROM c JOIN r_basin_edges ON x1 <> x2 AND least(x1, x2) < east AND greatest(x1, x2) > west AND greatest(y1, y2) > south),
q AS (SELECT *, y1 + (a - x1) / (x2 - x1) * (y2 - y1) AS ya, y1 + (b - x1) / (x2 - x1) * (y2 - y1) AS yb FROM p),
k AS (SELECT *, CASE WHEN abs(yb - ya) < 1e-12 THEN 0e0 ELSE least(greatest((south - ya) / (yb - ya), 0), 1) END AS t1,
             CASE WHEN abs(yb - ya) < 1e-12 THEN 1e0 ELSE least(greatest((north - ya) / (yb - ya), 0), 1) END AS t2 FROM q),
z AS (SELECT *, least(greatest(ya, south), north) - south AS h0, least(greatest(yb, south), north) - south AS h1,
             least(greatest(ya + t1 * (yb - ya), south), north) - south AS g1, least(greatest(ya + t2 * (yb - ya), south), north) - south AS g2,
             least(t1, t2) AS u, greatest(t1, t2) AS v FROM k),
f AS (SELECT rect, region, ring, sum(s * (b - a) * (u * (h0 + CASE WHEN t1 <= t2 THEN g1 ELSE g2 END) / 2 + (v - u) * (g1 + g2) / 2
             + (1 - v) * (h1 + CASE WHEN t1 <= t2 THEN g2 ELSE g1 END) / 2)) AS area FROM z GROUP BY ALL)
SELECT rect, region, sum(abs(area) * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS shared,
       sum(abs(area) * CASE WHEN ring = 0 THEN 1 ELSE -1 END) / 0.0625e0 AS fraction
FROM f GROUP BY ALL HAVING shared > 1e-12"""


def _cell_rects(t):
    c = t.kept_grid.select("iy", "ix", "lat", "lon").distinct()
    return c.select(
        (F.col("iy") * 100 + F.col("ix")).alias("rect"),
        (F.col("lon") - 0.125).alias("west"), (F.col("lon") + 0.125).alias("east"),
        (F.col("lat") - 0.125).alias("south"), (F.col("lat") + 0.125).alias("north"),
    )


@query("jn_11_overlap_fraction", "rect:i region:i shared:f fraction:f", _OVERLAP)
def _(t):
    return P.overlaps(_cell_rects(t), P.edges(t.basins))


@query(
    "jn_11b_overlap_at_least_half",
    "rect:i region:i fraction:f",
    f"SELECT rect, region, fraction FROM ({_OVERLAP}) WHERE fraction >= 0.5e0",
)
def _(t):
    return P.overlaps(_cell_rects(t), P.edges(t.basins)).where(F.col("fraction") >= 0.5)


@query(
    "jn_12_clip_touched",
    "time:d region:i iy:i ix:i value:f",
    f"""WITH o AS ({_OVERLAP})
        SELECT time, region, iy, ix, value FROM r_grid JOIN o ON o.rect = iy * 100 + ix""",
)
def _(t):
    rows, cols = Z.axes(t.kept_grid)
    cells = P.touched_cells(P.edges(t.basins), rows, cols, -20.25, 21.5, 0.25, 0.25)
    return t.kept_grid.join(cells, ["iy", "ix"])


@query(
    "ag_01_weighted_mean",
    "time:d mean:f",
    f"""SELECT time, sum(value * {_MM}e0 * cos(radians(g.lat))) / (SELECT sum(cos(radians(lat))) FROM (SELECT DISTINCT iy, ix, lat FROM r_grid WHERE iy < 6)) AS mean
       FROM r_grid g WHERE iy < 6 GROUP BY time""",
)
def _(t):
    cells = t.kept_grid.where("iy < 6").select("iy", "ix", "lat").distinct()
    return Z.weighted_mean(_depth(t.kept_grid.where("iy < 6")), cells)


@query(
    "ag_02_region_means",
    "time:d region:i mean:f mean_valid:f",
    f"""SELECT g.time, m.region, sum(value * {_MM}e0 * cos(radians(m.lat))) / any_value(w.full_w) AS mean,
              sum(value * {_MM}e0 * cos(radians(m.lat))) / sum(cos(radians(m.lat))) AS mean_valid
       FROM r_grid g JOIN r_mask m ON g.iy = m.iy AND g.ix = m.ix
       JOIN (SELECT region, sum(cos(radians(lat))) AS full_w FROM r_mask GROUP BY region) w ON w.region = m.region
       GROUP BY ALL""",
)
def _(t):
    a = Z.weighted_region_means(_depth(_tagged(t)), t.kept_mask)
    b = Z.weighted_region_means(_depth(_tagged(t)), t.kept_mask, valid_only=True).withColumnRenamed("mean", "mean_valid")
    return a.join(b, ["time", "region"])


@query(
    "ag_03_clip_mean_std",
    "time:d region:i mean:f std:f",
    """SELECT time, region, avg(value) AS mean, stddev_pop(value) AS std
       FROM r_grid g JOIN r_mask m ON g.iy = m.iy AND g.ix = m.ix GROUP BY time, region""",
)
def _(t):
    return Z.plain_stats(_tagged(t), ["time", "region"])


_SPINE = """(SELECT * FROM (SELECT DISTINCT iy, ix FROM r_grid),
       (SELECT CAST(unnest(generate_series((SELECT min(time) FROM r_grid), (SELECT max(time) FROM r_grid), INTERVAL 1 MONTH)) AS DATE) AS month))"""


@query(
    "ag_04_monthly_cell_mean",
    "month:d iy:i ix:i value:f",
    f"SELECT s.month, s.iy, s.ix, value FROM {_SPINE} s LEFT JOIN r_grid g ON g.time = s.month AND g.iy = s.iy AND g.ix = s.ix",
)
def _(t):
    return Z.monthly_mean(t.kept_grid)


@query(
    "ag_07_monthly_cell_sum",
    "month:d station:i value:f",
    """WITH s AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, station, sum(q) AS value FROM r_daily GROUP BY ALL),
       m AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM s)
       SELECT m.month, k.station, coalesce(s.value, 0) AS value FROM m, (SELECT DISTINCT station FROM s) k
       LEFT JOIN s ON s.month = m.month AND s.station = k.station""",
)
def _(t):
    daily = t.daily.select(F.col("d").alias("time"), "station", F.col("q").alias("value"))
    return Z.monthly_sum(daily, ["station"])


@query(
    "ag_08_zonal_mean_median",
    "region:i month:d mean:f median:f",
    """SELECT region, time AS month, avg(value) AS mean, median(value) AS median
       FROM r_grid g JOIN r_mask m ON g.iy = m.iy AND g.ix = m.ix GROUP BY region, time""",
)
def _(t):
    tagged = _tagged(t)
    mean = Z.zonal_monthly(tagged, "mean").withColumnRenamed("value", "mean")
    median = Z.zonal_monthly(tagged, "median").withColumnRenamed("value", "median")
    return mean.join(median, ["region", "month"])


def _depth(df):
    return df.withColumn("value", F.col("value") * _MM)


def _volume_sql(area: str) -> str:
    a = area.format("m.")
    return f"""SELECT g.time, m.region, sum(value * {_MM}e0 / 1e6 * {a}) AS km3, sum(value * {_MM}e0 / 1e6 * {a}) * 1e6 / any_value(w.total) AS mm
       FROM r_grid g JOIN r_mask m ON g.iy = m.iy AND g.ix = m.ix
       JOIN (SELECT region, sum({area.format('')}) AS total FROM r_mask GROUP BY region) w ON w.region = m.region
       GROUP BY ALL"""


@query("ag_09_zonal_volume", "time:d region:i km3:f mm:f", _volume_sql(_AREA))
def _(t):
    return Z.zonal_volume(_depth(_tagged(t, "area_km2")), t.kept_mask)


@query(
    "ag_10_band_area_volume",
    "time:d region:i km3:f mm:f",
    f"SELECT * FROM ({_volume_sql(_BAND)}) WHERE time >= DATE '1996-01-01' AND time < DATE '2000-01-01'",
)
def _(t):
    mask = t.kept_mask.withColumn("area_km2", F.col("band_km2"))
    grid = t.kept_grid.where((F.col("time") >= "1996-01-01") & (F.col("time") < "2000-01-01"))
    return Z.zonal_volume(_depth(P.cells_in_regions(grid, mask, ("area_km2",))), mask)


@query("ag_11_wet_pixels", "time:d wet:i", "SELECT time, sum(CASE WHEN cls > 0 THEN 1 ELSE 0 END) AS wet FROM r_grid GROUP BY time")
def _(t):
    return Z.wet_pixels(t.classes, ["time"])


_HIST = ", ".join(f"count(*) FILTER (cls = {c}) AS class_{c}" for c in range(5))


@query(
    "ag_12_class_histogram",
    "time:d class_0:i class_1:i class_2:i class_3:i class_4:i",
    f"SELECT time, {_HIST} FROM r_grid GROUP BY time",
)
def _(t):
    return Z.class_histogram(t.classes, ["time"])


@query(
    "ag_13_threshold_series",
    "month:d above_0:f above_2:f above_0_roll:f above_2_roll:f",
    f"""WITH h AS (SELECT time AS month, {_HIST} FROM r_grid GROUP BY time),
        s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM h),
        a AS (SELECT s.month, coalesce(class_1 + class_2 + class_3 + class_4, 0) * 0.0009e0 AS above_0,
                     coalesce(class_3 + class_4, 0) * 0.0009e0 AS above_2 FROM s LEFT JOIN h ON h.month = s.month)
        SELECT *, avg(above_0) OVER w AS above_0_roll, avg(above_2) OVER w AS above_2_roll
        FROM a WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    hist = Z.class_histogram(t.classes, ["time"]).withColumnRenamed("time", "month")
    return Z.threshold_series(hist, (0, 2), rolling=12)


@query(
    "ag_22_wet_area",
    "time:d km2:f",
    f"SELECT time, sum(CASE WHEN value >= 0.5e0 THEN {_AREA.format('')} ELSE 0 END) AS km2 FROM r_grid GROUP BY time",
)
def _(t):
    return Z.wet_area(O.with_cell_area(t.kept_grid), ["time"], 0.5)


_BASIN = f"""SELECT g.time, m.region, sum(CASE WHEN value >= 0.5e0 THEN {_AREA.format('g.')} ELSE 0 END) AS km2
       FROM r_grid g JOIN r_mask m ON g.iy = m.iy AND g.ix = m.ix GROUP BY g.time, m.region"""


def _basin_area(t):
    return Z.wet_area(_tagged(t, "area_km2"), ["time", "region"], 0.5)


#: Basins are the rows of ``nation``, a table of fixed length.
N_BASINS = 25


@query("ag_23_basin_area", "time:d region:i km2:f", _BASIN)
def _(t):
    return _basin_area(t)


@query(
    "ag_23b_basin_area_wide",
    "time:d " + " ".join(f"b{i}:f" for i in range(N_BASINS)),
    f"""WITH b AS ({_BASIN}) SELECT time, {', '.join(f'max(CASE WHEN region = {i} THEN km2 END) AS b{i}' for i in range(N_BASINS))} FROM b GROUP BY time""",
)
def _(t):
    """A column for each basin; the columns of a result must be known, so the number of basins is."""
    wide = _basin_area(t).groupBy("time").pivot("region", list(range(N_BASINS))).agg(F.max("km2"))
    return wide.toDF("time", *[f"b{i}" for i in range(N_BASINS)])


@query(
    "sl_02_top_basins",
    "time:d region:i km2:f",
    f"""WITH b AS ({_BASIN}) SELECT * FROM b WHERE region IN (SELECT region FROM b GROUP BY region ORDER BY round(avg(km2), 6) DESC, region LIMIT 5)""",
)
def _(t):
    return Z.top_by_mean(_basin_area(t), "region", "km2", 5)


@query(
    "ag_32_region_totals",
    "region:i covered_deg2:f fraction:f",
    f"""WITH o AS ({_OVERLAP}),
        a AS (SELECT region, sum(abs(s) * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS area
              FROM (SELECT region, ring, sum(x1 * y2 - x2 * y1) / 2 AS s FROM r_basin_edges GROUP BY ALL) GROUP BY region)
        SELECT o.region, sum(shared) AS covered_deg2, sum(shared) / any_value(a.area) AS fraction FROM o JOIN a ON a.region = o.region GROUP BY o.region""",
)
def _(t):
    covered = P.overlaps(_cell_rects(t), P.edges(t.basins)).groupBy("region").agg(F.sum("shared").alias("covered_deg2"))
    whole = P.measures(t.basins).select("region", "area")
    return covered.join(whole, "region").withColumn("fraction", F.col("covered_deg2") / F.col("area"))


@query(
    "ag_32b_east_edges",
    "group:i east:f spread:f aligned:b",
    """SELECT region % 5 AS "group", max(east) AS east, max(east) - min(east) AS spread, max(east) - min(east) <= 0.5e0 AS aligned
       FROM (SELECT region, max(lon) AS east FROM r_lakes GROUP BY region) GROUP BY region % 5""",
)
def _(t):
    boxes = P.measures(t.lakes).select((F.col("region") % 5).alias("group"), "east")
    return edge_alignment(boxes, ["group"], tolerance=0.5)


_MEASURE = """
SELECT region, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north,
       sum(a * turn) AS area, sum(mx * turn) / sum(a * turn) AS cx, sum(my * turn) / sum(a * turn) AS cy
FROM (SELECT region, ring, min(x1) AS west, min(y1) AS south, max(x1) AS east, max(y1) AS north,
             sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS mx,
             sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS my, sign(sum(x1 * y2 - x2 * y1)) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS turn
      FROM {} GROUP BY region, ring) GROUP BY region"""


@query(
    "geo_09_measures",
    "region:i west:f south:f east:f north:f area:f cx:f cy:f",
    _MEASURE.format("r_lake_edges"),
)
def _(t):
    return P.measures(t.lakes)


@query(
    "geo_09b_equal_area_km2",
    "region:i area_km2:f",
    """WITH k AS (SELECT *, sqrt(f * (2 - f)) AS e FROM (SELECT *, 1e0 / 298.257223563e0 AS f FROM r_lakes)),
       s AS (SELECT *, sin(radians(lat)) AS sn, cos(radians(30e0)) / sqrt(1 - e * sin(radians(30e0)) * (e * sin(radians(30e0)))) AS k0 FROM k),
       v AS (SELECT region, ring, seq, 6378.137e0 * k0 * radians(lon) AS x,
                    6378.137e0 / (2 * k0) * (1 - e * e) * (sn / (1 - e * e * sn * sn) + atanh(e * sn) / e) AS y FROM s),
       g AS (SELECT region, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
             FROM v WINDOW w AS (PARTITION BY region, ring ORDER BY seq))
       SELECT region, sum(a * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS area_km2
       FROM (SELECT region, ring, abs(sum(x * y2 - x2 * y)) / 2 AS a FROM g GROUP BY ALL) GROUP BY region""",
)
def _(t):
    return P.area_km2(t.lakes)


def _clip_area_sql(lo: float, hi: float) -> str:
    """Planar area between two longitudes, by the trapezoids below each edge."""
    return f"""
SELECT region, sum(abs(a) * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS area FROM (
  SELECT region, ring, sum(sign(x1 - x2) * (b - a) * (y1 + ((a + b) / 2 - x1) / (x2 - x1) * (y2 - y1) + 30)) AS a
  FROM (SELECT *, greatest(least(x1, x2), {lo}e0) AS a, least(greatest(x1, x2), {hi}e0) AS b FROM r_lake_edges WHERE x1 <> x2) WHERE b > a
  GROUP BY ALL) GROUP BY region"""


@query(
    "geo_08_split_at_longitude",
    "region:i side:s area:f",
    f"""SELECT region, 'west' AS side, area FROM ({_clip_area_sql(-180.0, 22.6875)})
        UNION ALL SELECT region, 'east', area FROM ({_clip_area_sql(22.6875, 180.0)})""",
)
def _(t):
    parts = P.split_at_longitude(t.lakes, 22.6875)
    sided = parts.withColumn("region", F.concat_ws("/", "region", "side")).drop("side")
    m = P.measures(sided).where("area > 1e-12")  # a ring that only touches the cut has no piece there
    return m.select(
        F.split("region", "/")[0].cast("bigint").alias("region"), F.split("region", "/")[1].alias("side"), "area"
    )


@query(
    "geo_08c_split_by_strip",
    "region:i split_i:i area:f",
    f"""WITH w AS ({_clip_area_sql(-180.0, 22.625)}), e AS ({_clip_area_sql(22.75, 180.0)})
        SELECT region, CASE WHEN region IN (SELECT region FROM e) THEN 0 ELSE -1 END AS split_i, area FROM w
        UNION ALL SELECT region, CASE WHEN region IN (SELECT region FROM w) THEN 1 ELSE -1 END, area FROM e""",
)
def _(t):
    parts = P.split_by_strip(t.lakes, 1.0, 0.0, -22.6875, 0.0625)
    key = F.concat_ws("/", F.col("region").cast("string"), F.col("split_i").cast("string"))
    m = P.measures(parts.withColumn("region", key))
    return m.select(F.split("region", "/")[0].cast("bigint").alias("region"), F.split("region", "/")[1].cast("int").alias("split_i"), "area")


@query("geo_08b_clip_strip", "region:i area:f", _clip_area_sql(22.0, 23.0))
def _(t):
    return P.measures(P.clip_box(t.lakes, 22.0, -90.0, 23.0, 90.0)).select("region", "area")


_LABEL = f"""
WITH m AS ({_MEASURE.format('r_lake_edges')}),
x AS (SELECT e.region, m.cx, m.cy, x1 + (cy - y1) / (y2 - y1) * (x2 - x1) AS x0
      FROM r_lake_edges e JOIN m ON m.region = e.region WHERE (y1 > cy) <> (y2 > cy)),
s AS (SELECT *, row_number() OVER w AS k, lead(x0) OVER w AS xe FROM x WINDOW w AS (PARTITION BY region ORDER BY x0)),
p AS (SELECT region, any_value(cx) AS cx, any_value(cy) AS cy, bool_or(cx >= x0 AND cx < xe) AS inside,
             arg_max((x0 + xe) / 2, struct_pack(w := xe - x0, l := -x0)) AS mid FROM s WHERE k % 2 = 1 GROUP BY region)
SELECT region, CASE WHEN inside THEN cx ELSE mid END AS lon, cy AS lat, inside FROM p"""


@query("geo_10_label_points", "region:i lon:f lat:f inside:b", _LABEL)
def _(t):
    return P.label_points(t.lakes)
