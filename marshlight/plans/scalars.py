"""Queries for calendar, text, unit and per-pixel expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import geodesy as G
from ..functions import raster as R
from ..functions import text as T
from ..operators import grid as O
from .registry import query


@query(
    "sc_01_water_year_start",
    "station:i water_year:i days:i total:f",
    """SELECT station, year(d) - CASE WHEN month(d) < 10 THEN 1 ELSE 0 END AS water_year,
              count(*) AS days, sum(q) AS total
       FROM r_daily GROUP BY ALL""",
)
def _(t):
    wy = C.water_year("d", 10).alias("water_year")
    return t.daily.groupBy("station", wy).agg(F.count(F.lit(1)).alias("days"), F.sum("q").alias("total"))


@query(
    "sc_02_water_year_labels",
    "month:d ending:i starting:i calendar:i zero_based:i",
    """SELECT month, year(month) + CASE WHEN month(month) >= 7 THEN 1 ELSE 0 END AS ending,
              year(month) - CASE WHEN month(month) < 7 THEN 1 ELSE 0 END AS starting,
              year(month) AS calendar,
              year(month) + CASE WHEN month(month) >= 7 THEN 1 ELSE 0 END AS zero_based
       FROM r_rain""",
)
def _(t):
    y, m = F.year("month"), F.month("month")
    df = t.rain.select(
        "month", y.alias("year"), (m - 1).alias("month0"),
        C.water_year_of(y, m, 7, "ending").alias("ending"),
        C.water_year_of(y, m, 7, "starting").alias("starting"),
        C.water_year_of(y, m, 1, "ending").alias("calendar"),
    )
    return C.with_water_year(df, 7, "ending", month="month0").withColumnRenamed("water_year", "zero_based")


@query(
    "sc_03_month_bounds",
    "d:d start:d stop:d first:d last:d",
    """SELECT DISTINCT d, date_trunc('month', d) AS start, date_trunc('month', d) + INTERVAL 1 MONTH AS stop,
              (SELECT date_trunc('month', min(d)) FROM r_daily) AS first,
              (SELECT date_trunc('month', max(d)) FROM r_daily) AS last
       FROM r_daily""",
)
def _(t):
    ends = t.daily.agg(F.struct(F.min("d").alias("a"), F.max("d").alias("b"))).scalar()
    return t.daily.select("d").distinct().select(
        "d", C.month_start("d").alias("start"), C.next_month_start("d").alias("stop"),
        C.month_start(ends["a"]).alias("first"), C.month_start(ends["b"]).alias("last"),
    )


@query(
    "sc_04_dekad_days",
    "d:d days:i",
    """SELECT DISTINCT d, date_diff('day', d, least(d + 10, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE))) AS days
       FROM r_daily""",
)
def _(t):
    return t.daily.select("d").distinct().select("d", C.dekad_days("d").alias("days"))


@query(
    "sc_05_seasonality",
    "month:d season_sin:f season_cos:f",
    """SELECT month, sin(2 * pi() * month(month) / 12) AS season_sin, cos(2 * pi() * month(month) / 12) AS season_cos
       FROM r_rain""",
)
def _(t):
    m = F.month("month")
    return t.rain.select("month", C.season_sin(m).alias("season_sin"), C.season_cos(m).alias("season_cos"))


@query(
    "sc_06_log_transforms",
    "month:d log_q:f back:f change_km2:f",
    """SELECT month, ln(1 + q) AS log_q, exp(ln(1 + q)) - 1 AS back, (1 + q) * (exp(0.05e0) - 1) AS change_km2
       FROM r_flow""",
)
def _(t):
    return t.flow.select(
        "month", F.log1p("q").alias("log_q"), F.expm1(F.log1p("q")).alias("back"),
        R.km2_change_from_log_slope("q", F.lit(0.05)).alias("change_km2"),
    )


@query(
    "sc_07_month_number",
    "month:d number:i",
    """SELECT month, (year(month) - (SELECT min(year(month)) FROM r_rain)) * 12 + month(month) AS number FROM r_rain""",
)
def _(t):
    first = t.rain.agg(F.min(F.year("month"))).scalar()
    return t.rain.select("month", C.month_number_from(first, "month").alias("number"))


@query(
    "sc_08_apex_offsets",
    "time:d iy:i ix:i east_m:f north_m:f",
    """SELECT time, iy, ix, (lon - 22.4e0) * 111320e0 * cos(radians(lat)) AS east_m, (lat + 19e0) * 111132e0 AS north_m
       FROM r_cube""",
)
def _(t):
    return t.cube.select(
        "time", "iy", "ix",
        G.east_offset_m("lat", "lon", 22.4).alias("east_m"), G.north_offset_m("lat", -19.0).alias("north_m"),
    )


@query(
    "sc_09_utm_zone",
    "time:d zone:i epsg:i",
    """SELECT time, CAST(floor((avg(lon) + 180) / 6) + 1 AS INTEGER) AS zone,
              CASE WHEN avg(lat) >= 0 THEN 32600 ELSE 32700 END + CAST(floor((avg(lon) + 180) / 6) + 1 AS INTEGER) AS epsg
       FROM r_grid GROUP BY time""",
)
def _(t):
    mean = t.grid.groupBy("time").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return mean.select("time", G.utm_zone("lon").alias("zone"), G.utm_epsg("lat", "lon").alias("epsg"))


_UTM_SQL = """
SELECT time, iy, ix,
  500000e0 + 0.9996e0 * a * (eta0 + a1 * cos(2*xi0) * sinh(2*eta0) + a2 * cos(4*xi0) * sinh(4*eta0) + a3 * cos(6*xi0) * sinh(6*eta0)) AS easting,
  10000000e0 + 0.9996e0 * a * (xi0 + a1 * sin(2*xi0) * cosh(2*eta0) + a2 * sin(4*xi0) * cosh(4*eta0) + a3 * sin(6*xi0) * cosh(6*eta0)) AS northing,
  lat AS lat_back, lon AS lon_back
FROM (SELECT *, atan2(tt, cos(dl)) AS xi0, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta0,
             6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS a,
             n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3
      FROM (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS tt
            FROM (SELECT *, radians(lat) AS phi, radians(lon - (CASE WHEN lon < 24 THEN 21e0 ELSE 27e0 END)) AS dl,
                         f / (2 - f) AS n, sqrt(f * (2 - f)) AS e
                  FROM (SELECT *, 1e0 / 298.257223563e0 AS f FROM r_grid))))"""


@query("sc_10_utm_round_trip", "time:d iy:i ix:i easting:f northing:f lat_back:f lon_back:f", _UTM_SQL)
def _(t):
    zone, south = G.utm_zone("lon"), F.col("lat") < 0
    df = t.grid.select("time", "iy", "ix", zone.alias("zone"), south.alias("south"), *_xy(G.utm_forward("lat", "lon", zone, south)))
    lat, lon = G.utm_inverse("easting", "northing", "zone", "south")
    return df.select("*", lat.alias("lat_back"), lon.alias("lon_back"))


def _xy(pair):
    return pair[0].alias("easting"), pair[1].alias("northing")


@query(
    "sc_11_angle_to_southeast",
    "time:d iy:i ix:i angle:f",
    """SELECT time, iy, ix, degrees(acos(greatest(-1e0, least(1e0,
         (u / sqrt(2e0) - v / sqrt(2e0)) / greatest(sqrt(u*u + v*v), 1e-12))))) AS angle
       FROM (SELECT time, iy, ix, value - 0.5e0 AS u, iy - 2.25e0 AS v FROM r_cube)""",
)
def _(t):
    u, v = F.col("value") - 0.5, F.col("iy") - 2.25
    dot = u / F.sqrt(F.lit(2.0)) - v / F.sqrt(F.lit(2.0))
    return t.cube.select("time", "iy", "ix", G.angle_between_deg(dot, F.hypot(u, v)).alias("angle"))


@query(
    "sc_13_canonical_name",
    "name:s parts:i",
    """SELECT regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]', '', 'g') AS name, count(*) AS parts FROM part GROUP BY ALL""",
)
def _(t):
    name = T.canonical_name(F.concat_ws(" ", "p_name", "p_type")).alias("name")
    return t.table("part").groupBy(name).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "sc_14_tolerant_number",
    "c_custkey:i number:f bad:f",
    """SELECT c_custkey, c_acctbal AS number, CAST(NULL AS DOUBLE) AS bad FROM customer""",
)
def _(t):
    text = F.concat(F.lit("  "), F.regexp_replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), r"\.", ","), F.lit(" "))
    return t.table("customer").select(
        "c_custkey", T.tolerant_number(text).alias("number"), T.tolerant_number("c_name").alias("bad")
    )


@query(
    "sc_15_name_and_code",
    "s_suppkey:i name:s code:s cls:i",
    """SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS code,
              CAST(s_suppkey % 5 AS INTEGER) AS cls FROM supplier""",
)
def _(t):
    key = F.col("s_suppkey").cast("string")
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("  ("), key, F.lit(" ) "))).otherwise(F.col("s_name"))
    return t.table("supplier").select(
        "s_suppkey", T.name_part(raw).alias("name"), T.code_part(raw).alias("code"),
        T.class_code_from_name(F.concat(F.lit("pixels_class_"), (F.col("s_suppkey") % 5).cast("string"))).alias("cls"),
    )


@query(
    "sc_16_split_labels",
    "c_custkey:i label:s",
    """SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_nationkey || '_' || c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS label
       FROM customer""",
)
def _(t):
    return t.table("customer").select("c_custkey", T.split_label("c_nationkey", "c_mktsegment", F.col("c_nationkey") < 5).alias("label"))


@query(
    "prj_01_bbox_crop",
    "time:d iy:i ix:i value:f",
    """SELECT time, iy, ix, value FROM r_grid WHERE lat BETWEEN -19.5e0 AND -18.25e0 AND lon BETWEEN 22e0 AND 23.5e0""",
)
def _(t):
    return O.crop(t.grid, 22.0, -19.5, 23.5, -18.25)


@query(
    "prj_02_signed_longitudes",
    "time:d iy:i ix:i lon:f kept:f",
    """SELECT time, iy, ix, CASE WHEN lon + 170e0 > 180 THEN lon - 190e0 ELSE lon + 170e0 END AS lon, lon AS kept FROM r_grid""",
)
def _(t):
    east = O.signed_longitudes(t.grid.withColumn("kept", F.col("lon")).withColumn("lon", F.col("lon") + 170.0))
    return O.signed_longitudes(east, "kept")


@query(
    "prj_03_vertex_longitudes",
    "s_suppkey:i lon:f",
    """SELECT s_suppkey, ((s_nationkey * 20e0 - 240) + 360) - 360 * floor(((s_nationkey * 20e0 - 240) + 360) / 360) AS lon FROM supplier""",
)
def _(t):
    ring = t.table("supplier").select("s_suppkey", (F.col("s_nationkey") * 20.0 - 240.0).alias("lon"))
    return O.vertices_like(ring, t.grid.withColumn("lon", F.col("lon") + 170.0))


@query("prj_04_dimension_names", "time:d lat:f lon:f value:f", "SELECT time, lat, lon, value FROM r_grid")
def _(t):
    return O.normalise_names(t.grid.withColumnsRenamed({"time": "Date", "lat": "Latitude", "lon": "x"}))


@query(
    "prj_05_infer_wet",
    "time:d iy:i ix:i wet:b wet_class:b",
    """SELECT time, iy, ix, value > 0.5e0 AS wet, cls IN (1, 2, 3, 4) AS wet_class FROM r_grid""",
)
def _(t):
    a = R.infer_wet(t.grid).select("time", "iy", "ix", "wet")
    b = R.infer_wet(t.classes, "cls").select("time", "iy", "ix", F.col("wet").alias("wet_class"))
    return a.join(b, ["time", "iy", "ix"])


@query(
    "prj_06_binary_from_class",
    "asset:s wet:f year:i month:i",
    """SELECT 'prod_' || iy || '_' || ix || '_' || year || '_' || month AS asset, CASE WHEN cls > 0 THEN 1e0 ELSE 0e0 END AS wet, year, month
       FROM r_grid""",
)
def _(t):
    asset = F.concat_ws("_", F.lit("prod"), "iy", "ix", "year", "month")
    return t.classes.select(asset.alias("asset"), "cls").select(
        "asset", R.wet_from_class("cls").alias("wet"),
        R.asset_field("asset", -2).cast("int").alias("year"), R.asset_field("asset", -1).cast("int").alias("month"),
    )


_QA = "CAST(l_partkey % 4096 AS INTEGER)"


@query(
    "prj_07_clear_sky",
    "l_orderkey:i l_linenumber:i clear_a:b clear_b:b",
    f"""SELECT l_orderkey, l_linenumber, ({_QA} & 3072) = 0 AS clear_a, ({_QA} & 30) = 0 AND l_suppkey % 3 = 0 AS clear_b FROM lineitem""",
)
def _(t):
    qa = (F.col("l_partkey") % 4096).cast("int")
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", R.clear_sky(qa, "ten_metre").alias("clear_a"),
        R.clear_sky(qa, "thirty_metre", F.col("l_suppkey") % 3).alias("clear_b"),
    )


@query(
    "prj_08_reflectance",
    "l_orderkey:i l_linenumber:i a:f b:f",
    """SELECT l_orderkey, l_linenumber, l_partkey / 10000e0 AS a, l_partkey * 2.75e-5 - 0.2e0 AS b FROM lineitem""",
)
def _(t):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", R.reflectance("l_partkey", "ten_metre").alias("a"),
        R.reflectance("l_partkey", "thirty_metre").alias("b"),
    )


@query(
    "prj_09_normalized_difference",
    "l_orderkey:i l_linenumber:i index:f",
    """SELECT l_orderkey, l_linenumber, (l_discount - l_tax) / nullif(l_discount + l_tax, 0) AS index FROM lineitem""",
)
def _(t):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", R.normalized_difference("l_discount", "l_tax").alias("index")
    )


@query(
    "prj_10_season_filter",
    "time:d iy:i ix:i value:f",
    """SELECT time, iy, ix, value FROM r_grid WHERE month BETWEEN 7 AND 9 AND year BETWEEN 1996 AND 1999""",
)
def _(t):
    return t.grid.where(C.in_season("time", 7, 9) & F.year("time").between(1996, 1999))


@query(
    "prj_11_mask_algebra",
    "time:d iy:i ix:i kept:f filled:f selfmasked:i",
    """SELECT time, iy, ix, CASE WHEN cls > 1 THEN value END AS kept, coalesce(CASE WHEN cls > 1 THEN value END, 0) AS filled,
              nullif(cls, 0) AS selfmasked FROM r_grid""",
)
def _(t):
    df = t.grid.join(t.classes, ["time", "iy", "ix"]).withColumn("kept", R.mask_where("value", F.col("cls") > 1))
    return df.select("time", "iy", "ix", "kept", R.fill_masked("kept").alias("filled"), R.self_mask("cls").alias("selfmasked"))


_PADDED = """SELECT month AS date, dataset, CASE WHEN dataset = '1-URGENT' AND (month > DATE '2000-06-01' OR month(month) = 2) THEN 0e0 ELSE mm END AS value FROM r_et"""


@query(
    "prj_12_trailing_zeros",
    "date:d dataset:s value:f was_padding:b",
    f"""WITH p AS ({_PADDED}), l AS (SELECT max(date) AS last FROM p WHERE dataset = '1-URGENT' AND value > 1e-6)
        SELECT date, dataset, CASE WHEN dataset = '1-URGENT' AND (value <= 1e-6 OR date > last) THEN NULL ELSE value END AS value,
               dataset = '1-URGENT' AND (value <= 1e-6 OR date > last) AS was_padding FROM p, l""",
)
def _(t):
    pad = (F.col("dataset") == "1-URGENT") & ((F.col("month") > F.lit("2000-06-01").cast("date")) | (F.month("month") == 2))
    df = t.et.select(F.col("month").alias("date"), "dataset", F.when(pad, 0.0).otherwise(F.col("mm")).alias("value"))
    return R.drop_trailing_zeros(df, "1-URGENT")


@query(
    "prj_13_units_to_mm",
    "month:d dataset:s mm_step:f",
    """SELECT month, dataset, CASE dataset
         WHEN '1-URGENT' THEN mm * 0.1e0
         WHEN '2-HIGH' THEN mm * 86400 * date_diff('day', month, CAST(month + INTERVAL 1 MONTH AS DATE))
         WHEN '3-MEDIUM' THEN mm * -1000
         WHEN '4-NOT SPECIFIED' THEN mm * 0.01e0 * 8
         ELSE mm * 0.1e0 * 10 END AS mm_step FROM r_et""",
)
def _(t):
    rules = {"1-URGENT": "tenth_mm", "2-HIGH": "flux_mm_per_s", "3-MEDIUM": "negative_metres",
             "4-NOT SPECIFIED": "hundredth_per_8day"}
    rule = F.lit("tenth_mm_per_dekad")
    for name, r in rules.items():
        rule = F.when(F.col("dataset") == name, r).otherwise(rule)
    return t.et.withColumn("rule", rule).select("month", "dataset", R.to_mm_by_rule("mm", "month", "rule").alias("mm_step"))


@query(
    "prj_14_cell_area",
    "iy:i ix:i cosine:f rounded:f band:f",
    """SELECT DISTINCT iy, ix,
         6371.0088e0 * 6371.0088e0 * radians(0.25e0) * radians(0.25e0) * cos(radians(lat)) AS cosine,
         6371e0 * 6371e0 * radians(0.25e0) * radians(0.25e0) * cos(radians(lat)) AS rounded,
         6371e0 * 6371e0 * radians(0.25e0) * abs(sin(radians(lat + 0.125e0)) - sin(radians(lat - 0.125e0))) AS band
       FROM r_grid""",
)
def _(t):
    cells = t.grid.select("iy", "ix", "lat", "lon").distinct()
    area = lambda form, how: O.with_cell_area(cells, form, how).select("iy", "ix", F.col("area_km2"))
    a = area("cosine", "median").withColumnRenamed("area_km2", "cosine")
    b = area("cosine_round", "mean").withColumnRenamed("area_km2", "rounded")
    c = area("band", "first").withColumnRenamed("area_km2", "band")
    return a.join(b, ["iy", "ix"]).join(c, ["iy", "ix"])


@query(
    "prj_15_pixels_to_km2",
    "time:d wet30:f wet10:f",
    """SELECT time, sum(CASE WHEN cls > 0 THEN 1 ELSE 0 END) * 0.0009e0 AS wet30,
              sum(CASE WHEN cls > 0 THEN 1 ELSE 0 END) / 9e0 * 0.0009e0 AS wet10 FROM r_grid GROUP BY time""",
)
def _(t):
    n = t.classes.groupBy("time").agg(F.count_if(F.col("cls") > 0).alias("n"))
    return n.select("time", R.pixels_to_km2("n").alias("wet30"), R.pixels_to_km2("n", "10m").alias("wet10"))


@query(
    "prj_16_flow_volume",
    "month:d km3:f mm:f",
    """SELECT month, q * date_diff('day', month, CAST(month + INTERVAL 1 MONTH AS DATE)) * 86400 / 1e9 AS km3,
              q * date_diff('day', month, CAST(month + INTERVAL 1 MONTH AS DATE)) * 86400 / 1e9 * 1e9 / (23387e0 * 1e6) * 1000 AS mm FROM r_flow""",
)
def _(t):
    df = t.flow.withColumn("km3", R.flow_to_km3("q", "month"))
    return df.withColumn("mm", R.km3_to_mm("km3", 23387.0))


@query(
    "prj_17_fill_screen",
    "c_custkey:i a:f usable:f",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_acctbal END AS a,
              CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey ELSE c_acctbal END AS usable FROM customer""",
)
def _(t):
    raw = F.when(F.col("c_nationkey") % 6 == 0, -9.9e12).when(F.col("c_nationkey") % 3 == 0, 9.9e30).otherwise(F.col("c_acctbal"))
    return t.table("customer").select("c_custkey", raw.alias("raw"), F.col("c_nationkey").cast("double").alias("alt")).select(
        "c_custkey", R.screen_fill("raw").alias("a"), R.first_usable("raw", "alt").alias("usable")
    )


@query(
    "prj_18_station_filter",
    "s_suppkey:i lat:f lon:f",
    """SELECT s_suppkey, lat, lon FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE -25 + s_nationkey * 0.5e0 END AS lat,
              18 + s_nationkey * 0.5e0 AS lon FROM supplier) WHERE lat IS NOT NULL AND lon BETWEEN 20 AND 26 AND lat BETWEEN -22 AND -16""",
)
def _(t):
    df = t.table("supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, -25 + F.col("s_nationkey") * 0.5).alias("lat"),
        (18 + F.col("s_nationkey") * 0.5).alias("lon"),
    )
    return O.crop(df.dropna(subset=["lat", "lon"]), 20, -22, 26, -16)


@query(
    "prj_19_complete_rows",
    "time:d iy:i ix:i complete:b",
    """SELECT time, iy, ix, value <> 0 AND cls <> 0 AS complete FROM r_grid""",
)
def _(t):
    df = t.grid.join(t.classes, ["time", "iy", "ix"]).withColumns(
        {"a": F.nullif("value", F.lit(0.0)), "b": F.nullif("cls", F.lit(0))}
    )
    return df.select("time", "iy", "ix", R.complete("a", "b").alias("complete"))


@query(
    "prj_20_axes_from_2d",
    "time:d iy:i ix:i lat:f lon:f",
    """SELECT g.time, g.iy, g.ix, a.lat, b.lon FROM r_grid g
       JOIN (SELECT iy, avg(lat + ix * 0.0078125e0) AS lat FROM r_grid GROUP BY iy) a ON g.iy = a.iy
       JOIN (SELECT ix, avg(lon - iy * 0.0078125e0) AS lon FROM r_grid GROUP BY ix) b ON g.ix = b.ix""",
)
def _(t):
    tilted = t.grid.withColumns(
        {"lat": F.col("lat") + F.col("ix") * 0.0078125, "lon": F.col("lon") - F.col("iy") * 0.0078125}
    )
    return O.axes_from_2d(tilted)
