"""Queries for series: calendars, windows, alignment joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import series as S
from ..operators.order import global_rank
from .registry import query


@query(
    "ag_05_month_start",
    "station:i month:d q:f",
    "SELECT station, CAST(date_trunc('month', d) AS DATE) AS month, avg(q) AS q FROM r_daily GROUP BY ALL",
)
def _(t):
    return S.to_month_start(t.daily, ["station"], ["q"], "d")


@query(
    "ag_06_daily_to_monthly",
    "station:i month:d q:f",
    "SELECT station, CAST(date_trunc('month', d) AS DATE) AS month, CASE WHEN count(q) >= 70 THEN avg(q) END AS q FROM r_daily GROUP BY ALL",
)
def _(t):
    return S.daily_to_monthly(t.daily, ["station"], "q", "d", 70)


@query("ag_48_annual_mean", "dataset:s year:i mm:f", "SELECT dataset, year(month) AS year, avg(mm) AS mm FROM r_et GROUP BY ALL")
def _(t):
    return S.annual_mean(t.et, ["dataset"], "mm")


@query(
    "ag_45_profile",
    "user_id:i rows:i missing:i first:t last:t first_valid:t last_valid:t",
    """SELECT user_id, count(*) AS rows, count(*) - count(v) AS missing, min(ts) AS first, max(ts) AS last, min(ts) FILTER (v IS NOT NULL) AS first_valid,
              max(ts) FILTER (v IS NOT NULL) AS last_valid FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY user_id""",
)
def _(t):
    ev = t.table("events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return S.profile(ev, ["user_id"], "v", "ts")


# A month counts when it has nine tenths of the readings that the station's months have on average.
_GAPPY = """(SELECT station, month, CASE WHEN 10 * n * months >= 9 * total THEN q END AS q FROM (
  SELECT *, sum(n) OVER (PARTITION BY station) AS total, count(*) OVER (PARTITION BY station) AS months FROM
  (SELECT s.station, s.month, s.q, d.n FROM r_station s JOIN (SELECT station, CAST(date_trunc('month', d) AS DATE) AS month, count(*) AS n FROM r_daily GROUP BY ALL) d ON d.station = s.station AND d.month = s.month)))"""


def _gappy(t):
    readings = t.daily.groupBy("station", F.trunc("d", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("station")
    enough = 10 * F.col("n") * F.count(F.lit(1)).over(whole) >= 9 * F.sum("n").over(whole)
    return t.station.join(readings, ["station", "month"]).select("station", "month", F.when(enough, F.col("q")).alias("q"))


def _sparse(t):
    return _gappy(t).where("q is not null")


_SPINE = f"""(SELECT s.station, s.month, g.q FROM (SELECT station, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM {_GAPPY} WHERE q IS NOT NULL GROUP BY station) s
             LEFT JOIN {_GAPPY} g ON g.station = s.station AND g.month = s.month)"""


@query("jn_18_month_spine", "station:i month:d q:f", f"SELECT * FROM {_SPINE}")
def _(t):
    return S.on_month_spine(_sparse(t), ["station"])


@query("jn_18b_missing_months", "station:i month:d", f"SELECT station, month FROM {_SPINE} WHERE q IS NULL")
def _(t):
    return S.missing_months(_sparse(t), ["station"])


_LAGS = ", ".join(f"lag(q, {k}) OVER w AS q_lag{k}" for k in S.LAGS)
_ROLLS = ", ".join(
    f"CASE WHEN count(q) OVER (PARTITION BY station ORDER BY month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n // 2} THEN avg(q) OVER (PARTITION BY station ORDER BY month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS q_roll{n}m"
    for n in (3, 6)
)


@query(
    "wn_01_lag_features",
    "station:i month:d " + " ".join(f"q_lag{k}:f" for k in S.LAGS) + " q_roll3m:f q_roll6m:f month_sin:f month_cos:f",
    f"""SELECT station, month, {_LAGS}, {_ROLLS}, sin(2 * pi() * month(month) / 12) AS month_sin, cos(2 * pi() * month(month) / 12) AS month_cos
        FROM {_SPINE} WINDOW w AS (PARTITION BY station ORDER BY month)""",
)
def _(t):
    return S.lag_features(S.on_month_spine(_sparse(t), ["station"]), ["station"], ["q"])


_F3 = "PARTITION BY station ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"


@query(
    "wn_02_centred_smooth",
    "station:i month:d mean:f median:f",
    f"""SELECT station, month, CASE WHEN count(q) OVER ({_F3}) = 3 THEN avg(q) OVER ({_F3}) END AS mean, CASE WHEN count(q) OVER ({_F3}) = 3 THEN median(q) OVER ({_F3}) END AS median FROM {_SPINE}""",
)
def _(t):
    spine = S.on_month_spine(_sparse(t), ["station"])
    a = S.centred_smooth(spine, ["station"], "q").withColumnRenamed("smooth", "mean")
    return S.centred_smooth(a, ["station"], "q", reducer="median").withColumnRenamed("smooth", "median")


@query(
    "wn_03_trailing_mean",
    "station:i month:d trailing:f",
    f"SELECT station, month, avg(q) OVER (PARTITION BY station ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS trailing FROM {_SPINE}",
)
def _(t):
    return S.trailing_mean(S.on_month_spine(_sparse(t), ["station"]), ["station"], "q", 6)


@query(
    "wn_04c_rolling_30_rows",
    "station:i month:d trailing:f",
    """SELECT station, month, CASE WHEN count(q) OVER w >= 10 THEN avg(q) OVER w END AS trailing FROM r_station
       WINDOW w AS (PARTITION BY station ORDER BY month ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    return S.trailing_mean(t.station, ["station"], "q", 30, min_count=10).drop("q")


@query(
    "wn_04_rolling_30_days",
    "event_id:i rolling:f",
    """SELECT event_id, CASE WHEN count(cents) OVER w >= 10 THEN avg(cents) OVER w / 100 END AS rolling FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, epoch(date_trunc('second', ts)) AS s FROM events)
       WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 2591999 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    events = t.table("events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))  # whole numbers add up exactly
    return S.rolling_days(events, ["user_id"], "cents", "ts", days=30).withColumn("rolling", F.col("rolling") / 100)


@query(
    "wn_04b_rolling_30_days_long",
    "station:i d:d rolling:f n:i",
    """WITH w AS (SELECT station, d, CASE WHEN count(q) OVER w >= 10 THEN avg(q) OVER w END AS rolling FROM r_daily WINDOW w AS (PARTITION BY station ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
       SELECT station, d, any_value(rolling) AS rolling, count(*) AS n FROM w GROUP BY ALL""",
)
def _(t):
    r = S.rolling_days(t.daily, ["station"], "q", "d")
    return r.groupBy("station", "d").agg(F.max("rolling").alias("rolling"), F.count(F.lit(1)).alias("n"))


@query(
    "wn_05_step_change",
    "station:i month:d change:f",
    f"""SELECT station, month, CASE WHEN date_diff('day', lag(month) OVER w, month) <= 45 THEN q - lag(q) OVER w END AS change FROM {_GAPPY} WHERE q IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY month)""",
)
def _(t):
    return S.step_change(_sparse(t), ["station"], "q")


_GAPS = f"""(SELECT *, count(*) FILTER (q IS NULL) OVER (PARTITION BY station, gap_id) AS gap_length FROM (SELECT *, count(q) OVER (PARTITION BY station ORDER BY month) AS gap_id FROM {_SPINE}))"""


@query("wn_07_gap_islands", "station:i month:d gap_id:i gap_length:i", f"SELECT * FROM {_GAPS}")
def _(t):
    return S.gap_lengths(S.on_month_spine(_sparse(t), ["station"]), ["station"], "q")


def _breaks_sql(cond: str, at: str) -> str:
    return f"""WITH g AS (SELECT station, CAST(month AS TIMESTAMP) AS time, q, CAST(lag(month) OVER (PARTITION BY station ORDER BY month) AS TIMESTAMP) AS prev FROM {_GAPPY} WHERE q IS NOT NULL)
        SELECT station, time, q, false AS is_break FROM g UNION ALL SELECT station, {at}, NULL, true FROM g WHERE {cond}"""


@query(
    "wn_08_gap_breaks",
    "station:i time:t q:f is_break:b",
    _breaks_sql("date_diff('day', prev, time) > 60", "prev + to_seconds((epoch(time) - epoch(prev)) / 2)"),
)
def _(t):
    return S.gap_breaks(_sparse(t), ["station"], "q", "month", 60)


@query(
    "wn_08b_gap_breaks_day_before",
    "station:i time:t q:f is_break:b",
    _breaks_sql("epoch(time) - epoch(prev) > 93 * 86400", "time - INTERVAL 1 DAY"),
)
def _(t):
    return S.gap_breaks(_sparse(t), ["station"], "q", "month", 93, at="day_before")


@query(
    "wn_08c_year_segments",
    "dataset:s year:i segment:i",
    """WITH y AS (SELECT dataset, year(month) AS year, avg(mm) AS mm FROM r_et GROUP BY ALL), s AS (SELECT *, year - row_number() OVER (PARTITION BY dataset ORDER BY year) AS k FROM y WHERE mm > (SELECT min(mm) FROM y z WHERE z.dataset = y.dataset))
       SELECT dataset, year, dense_rank() OVER (PARTITION BY dataset ORDER BY k) AS segment FROM s""",
)
def _(t):
    y = S.annual_mean(t.et, ["dataset"], "mm").withColumn("mm", F.when(F.col("mm") > F.min("mm").over(Window.partitionBy("dataset")), F.col("mm")))
    return S.year_segments(y, ["dataset"], "mm")


@query(
    "wn_09_anomaly",
    "station:i month:d anomaly:f",
    "SELECT station, month, q - avg(q) OVER (PARTITION BY station, month(month)) AS anomaly FROM r_station",
)
def _(t):
    return S.anomalies(t.station, ["station"], "q")


@query(
    "wn_10_min_max",
    "station:i month:d scaled:f constant:f raw:f",
    """SELECT station, month, (q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w) AS scaled, 0e0 AS constant, CAST(NULL AS DOUBLE) AS raw FROM r_station WINDOW w AS (PARTITION BY station)""",
)
def _(t):
    a = S.min_max_scaled(t.station, ["station"], "q").withColumn("one", F.lit(7.0))
    b = S.min_max_scaled(a.withColumnRenamed("scaled", "s"), ["station"], "one").withColumnRenamed("scaled", "constant")
    return S.min_max_scaled(b, ["station"], "one", constant=None).withColumnRenamed("scaled", "raw").withColumnRenamed("s", "scaled")


@query(
    "wn_11_keep_first",
    "dataset:s year:i month:d mm:f",
    "SELECT dataset, year(month) AS year, min(month) AS month, arg_min(mm, month) AS mm FROM r_et GROUP BY dataset, year(month)",
)
def _(t):
    return S.first_per_key(t.et.withColumn("year", F.year("month")), ["dataset", "year"], ["month"])


@query(
    "wn_12_exp_reservoir",
    "station:i month:d tau:f reservoir:f",
    """WITH o AS (SELECT station, month, q, row_number() OVER (PARTITION BY station ORDER BY month) AS k FROM r_station)
       SELECT o.station, o.month, tau, sum((1 - exp(-1 / tau)) * exp(-(o.k - p.k) / tau) * p.q) AS reservoir
       FROM o JOIN o p ON p.station = o.station AND p.k <= o.k, (SELECT unnest([1e0, 3e0, 6e0]) AS tau) GROUP BY ALL""",
)
def _(t):
    return S.exp_reservoir(t.station, ["station"], "q", [1.0, 3.0, 6.0])


@query(
    "wn_18_train_z_score",
    "station:i month:d z:f",
    """SELECT station, month, (q - avg(q) FILTER (year(month) <= 1998) OVER w) / (stddev_pop(q) FILTER (year(month) <= 1998) OVER w + 1e-9) AS z FROM r_station WINDOW w AS (PARTITION BY station)""",
)
def _(t):
    return S.z_scored(t.station, ["station"], "q", F.year("month") <= 1998)


@query(
    "ag_30_ensemble_median",
    "month:d mm:f",
    "SELECT month, median(mm) AS mm FROM r_et GROUP BY month",
)
def _(t):
    return S.ensemble_median(t.et, "mm")


#: Products of evaporation by the names that their columns get.
_PRODUCTS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
_COLUMNS = [*_PRODUCTS, "rain", "storage", "inflow"]


def _tables(t):
    """Every monthly table, with the months that each has."""
    products = {name: t.et.where(F.col("dataset") == d).select("month", "mm") for name, d in _PRODUCTS.items()}
    return products | {"rain": t.rain, "storage": t.storage.select("month", F.col("cm").alias("mm")), "inflow": t.flow.select("month", F.col("q").alias("mm"))}


_WIDE = f"""(SELECT month, {', '.join(f"max(mm) FILTER (n = '{c}') AS {c}" for c in _COLUMNS)} FROM (
  {' UNION ALL '.join(f"SELECT month, mm, '{n}' AS n FROM r_et WHERE dataset = '{d}'" for n, d in _PRODUCTS.items())}
  UNION ALL SELECT month, mm, 'rain' FROM r_rain UNION ALL SELECT month, cm, 'storage' FROM r_storage UNION ALL SELECT month, q, 'inflow' FROM r_flow) GROUP BY month)"""
_NUMBERS = " ".join(f"{c}:f" for c in _COLUMNS)


@query("jn_01_outer_align", f"month:d {_NUMBERS}", f"SELECT * FROM {_WIDE}")
def _(t):
    return J.align(_tables(t), "month", "mm")


@query(
    "jn_02_outer_merge_years",
    f"year:i {_NUMBERS}",
    f"""SELECT year(month) AS year, {', '.join(f'avg({c}) AS {c}' for c in _COLUMNS)} FROM {_WIDE} GROUP BY ALL""",
)
def _(t):
    return J.align({n: S.annual_mean(d, [], "mm") for n, d in _tables(t).items()}, "year", "mm").orderBy("year")


@query(
    "jn_03_inner_on_date",
    "month:d mm:f cm:f",
    "SELECT r.month, mm, cm FROM r_rain r JOIN r_storage s ON s.month = r.month",
)
def _(t):
    return t.rain.join(t.storage, "month")


@query(
    "jn_04_left_drop_null",
    "station:i month:d q:f mm:f",
    f"SELECT g.station, g.month, q, mm FROM {_GAPPY} g LEFT JOIN r_rain r ON r.month = g.month WHERE q IS NOT NULL AND mm IS NOT NULL",
)
def _(t):
    return _gappy(t).join(t.rain, "month", "left").dropna()


_AB = "(SELECT year(month) AS year, avg(mm) AS v FROM r_et WHERE dataset = '{0}' AND year(month) {1} GROUP BY ALL)"


def _years(t, name, cond):
    rows = t.et.where((F.col("dataset") == name)).withColumn("year", F.year("month")).where(cond)
    return rows.groupBy("year").agg(F.avg("mm").alias("v"))


@query(
    "jn_05_fill_missing_years",
    "year:i v:f",
    f"SELECT * FROM {_AB.format('1-URGENT', 'IN (1995, 1997, 1999)')} UNION ALL SELECT * FROM {_AB.format('2-HIGH', '> 0')} b WHERE year NOT IN (SELECT year FROM {_AB.format('1-URGENT', 'IN (1995, 1997, 1999)')})",
)
def _(t):
    return J.with_missing_from(_years(t, "1-URGENT", "year in (1995, 1997, 1999)"), _years(t, "2-HIGH", "year > 0"), ["year"])


@query("so_02_switch_at_year", "year:i v:f", f"SELECT * FROM {_AB.format('1-URGENT', '<= 1998')} UNION ALL SELECT * FROM {_AB.format('2-HIGH', '> 1998')}")
def _(t):
    return J.switch_at(_years(t, "1-URGENT", "year > 0"), _years(t, "2-HIGH", "year > 0"), "year", 1998)


@query(
    "jn_06_semi_join",
    "station:i month:d q:f",
    "SELECT station, month, q FROM r_station WHERE month IN (SELECT month FROM r_rain WHERE mm > 90) AND station IN (1, 4, 7)",
)
def _(t):
    wet = t.rain.where("mm > 90").select("month")
    return t.station.where(F.col("station").isin(1, 4, 7)).join(wet, "month", "left_semi")


@query(
    "jn_17_dictionary",
    "c_custkey:i label:s unique_name:s",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'BUILDING' THEN 'houses' ELSE c_mktsegment END AS label,
              c_mktsegment || '_' || c_custkey AS unique_name FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY ALL HAVING count(*) > 1)""",
)
def _(t):
    c = T.unique_names(t.table("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")
    return J.relabel(c, "c_mktsegment", {"AUTOMOBILE": "cars", "BUILDING": "houses"}).withColumnRenamed("c_mktsegment", "label")


@query(
    "jn_19_region_difference",
    "time:d difference:f",
    """SELECT time, sum(value * w) FILTER (region = 'NW') / sum(w) FILTER (region = 'NW') - sum(value * w) FILTER (region IN ('NE', 'SE')) / sum(w) FILTER (region IN ('NE', 'SE')) AS difference
       FROM (SELECT time, value, 1e0 + ix AS w, CASE WHEN iy >= 6 THEN 'N' ELSE 'S' END || CASE WHEN ix >= 6 THEN 'E' ELSE 'W' END AS region FROM r_grid) GROUP BY time""",
)
def _(t):
    name = F.concat(F.when(F.col("iy") >= 6, "N").otherwise("S"), F.when(F.col("ix") >= 6, "E").otherwise("W"))
    return J.region_difference(t.grid.withColumns({"region": name, "w": 1.0 + F.col("ix")}), ["NW"], ["NE", "SE"], "w")


@query(
    "ag_33_correlation_matrix",
    "part:s a:s b:s r:f",
    f"""WITH x AS (SELECT 'all' AS part, * FROM {_WIDE} UNION ALL SELECT CASE WHEN month(month) < 9 THEN 'early' ELSE 'late' END, * FROM {_WIDE})
        {' UNION ALL '.join(f"SELECT part, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) AS r FROM x GROUP BY part" for a in _COLUMNS for b in _COLUMNS)}""",
)
def _(t):
    wide = J.align(_tables(t), "month", "mm")
    half = wide.withColumn("part", F.when(F.month("month") < 9, "early").otherwise("late"))
    return S.correlation_matrix(wide.withColumn("part", F.lit("all")).unionByName(half), _COLUMNS, ["part"])


@query(
    "ag_36_product_ranking",
    "dataset:s mean:f per_year:f spread:f",
    "SELECT dataset, avg(mm) AS mean, avg(mm) * 12 AS per_year, max(mm) - min(mm) AS spread FROM r_et GROUP BY dataset",
)
def _(t):
    return S.product_ranking(t.et, "mm")


@query(
    "ag_37_water_year_peak",
    "station:i water_year:i peak:f",
    "SELECT station, year(month) - CASE WHEN month(month) < 10 THEN 1 ELSE 0 END AS water_year, max(q) AS peak FROM r_station GROUP BY ALL",
)
def _(t):
    return S.water_year_peaks(t.station, ["station"], "q")


_WY = "year(month) - CASE WHEN month(month) < 10 THEN 1 ELSE 0 END"


@query(
    "ag_38_arrival_month",
    "station:i water_year:i arrival_month:i",
    f"""SELECT s.station, {_WY} AS water_year, min(month(month)) AS arrival_month FROM r_station s
        JOIN (SELECT station, quantile_cont(q, 0.4) AS level FROM r_station GROUP BY station) l ON l.station = s.station
        WHERE month(month) BETWEEN 3 AND 7 AND q > level GROUP BY ALL""",
)
def _(t):
    return S.arrival_months(t.station, ["station"], "q")


@query(
    "ag_38b_arrival_fraction_of_peak",
    "station:i water_year:i arrival_month:i",
    f"""WITH y AS (SELECT station, month, q, {_WY} AS water_year FROM r_station)
        SELECT y.station, y.water_year, min(month(month)) AS arrival_month FROM y JOIN (SELECT station, water_year, max(q) * 0.97e0 AS level FROM y GROUP BY ALL) l
        ON l.station = y.station AND l.water_year = y.water_year WHERE month(month) BETWEEN 3 AND 7 AND q > level GROUP BY ALL""",
)
def _(t):
    return S.arrival_months(t.station, ["station"], "q", fraction_of_peak=0.97)


@query(
    "ag_39_preseason_features",
    "station:i water_year:i q_mean_pre:f q_max_pre:f",
    f"""SELECT station, y.wy AS water_year, avg(q) AS q_mean_pre, max(q) AS q_max_pre FROM {_GAPPY} g
        JOIN (SELECT unnest(range(1990, 2010)) AS wy) y ON g.month BETWEEN make_date(y.wy - 1, 10, 1) AND make_date(y.wy, 3, 1) WHERE q IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return S.preseason_features(_gappy(t), ["station"], ["q"])


@query(
    "ag_40_month_box",
    "calendar_month:i q1:f median:f q3:f mean:f",
    "SELECT month(month) AS calendar_month, quantile_cont(cm, 0.25) AS q1, median(cm) AS median, quantile_cont(cm, 0.75) AS q3, avg(cm) AS mean FROM r_storage GROUP BY ALL",
)
def _(t):
    return S.by_month_box(t.storage, "cm")


@query(
    "ag_41_most_common",
    "p_brand:s p_type:s",
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM c)
       SELECT p_brand, p_type FROM r WHERE k = 1""",
)
def _(t):
    return S.most_common(t.table("part"), ["p_brand"], "p_type")


def _loop_sql(x: str, y: str) -> str:
    return f"""
WITH p AS (SELECT s.station, year(s.month) AS year, s.month, {x} AS x, {y} AS y FROM r_station s JOIN r_rain r ON r.month = s.month WHERE month(s.month) <> 5),
n AS (SELECT station, year, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY station, year ORDER BY month)),
g AS (SELECT station, year, count(*) AS c, sum(x * ny - nx * y) / 2 AS area, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS per FROM n GROUP BY ALL)
SELECT station, year, CASE WHEN c >= 3 AND area > 0 THEN 'CCW' WHEN c >= 3 AND area < 0 THEN 'CW' ELSE 'NA' END AS direction,
       CASE WHEN c >= 3 AND per > 0 THEN least(1e0, 4 * pi() * abs(area) / (per * per)) END AS circularity FROM g"""


def _loop_points(t):
    return t.station.join(t.rain, "month").withColumn("year", F.year("month")).withColumn("mm", F.when(F.month("month") != 5, F.col("mm")))


@query("ag_44_phase_loop", "station:i year:i direction:s circularity:f", _loop_sql("q", "mm"))
def _(t):
    return S.phase_loops(_loop_points(t), ["station", "year"], "q", "mm", "month")


_NORM = "({0} - min({0}) OVER (PARTITION BY s.station, year(s.month))) / nullif(max({0}) OVER (PARTITION BY s.station, year(s.month)) - min({0}) OVER (PARTITION BY s.station, year(s.month)), 0)"


@query("ag_44b_phase_loop_scaled", "station:i year:i direction:s circularity:f", _loop_sql(_NORM.format("q"), _NORM.format("mm")))
def _(t):
    return S.phase_loops(_loop_points(t), ["station", "year"], "q", "mm", "month", normalize=True)


@query(
    "sl_01_ordered_stations",
    "s_suppkey:i grdc_no:i rank:i",
    """SELECT s_suppkey, grdc_no, row_number() OVER (ORDER BY grdc_no NULLS LAST, s_suppkey) AS rank FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS grdc_no FROM supplier)""",
)
def _(t):
    s = t.table("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("grdc_no"))
    return global_rank(s, [F.asc_nulls_last("grdc_no"), F.asc("s_suppkey")], "rank")


@query(
    "so_01_union_products",
    "dataset:s month:d mm:f extra:f",
    "SELECT dataset, month, mm, CAST(NULL AS DOUBLE) AS extra FROM r_et UNION ALL SELECT 'rain', month, mm, 1e0 FROM r_rain",
)
def _(t):
    return t.et.unionByName(t.rain.withColumns({"dataset": F.lit("rain"), "extra": F.lit(1.0)}), allowMissingColumns=True)


@query(
    "so_03_merge_sensors",
    "year:i n:i total:f",
    "SELECT year, count(*) AS n, sum(value) AS total FROM (SELECT year, value FROM r_grid WHERE month <= 6 UNION ALL SELECT year, value FROM r_grid WHERE month >= 4) GROUP BY year",
)
def _(t):
    g = t.grid.withColumns({"year": F.year("time"), "m": F.month("time")})
    return g.where("m <= 6").unionByName(g.where("m >= 4")).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "so_04_common_keys",
    "month:d",
    "SELECT month FROM r_rain INTERSECT SELECT month FROM r_station WHERE q > 26",
)
def _(t):
    return t.rain.select("month").intersect(t.station.where("q > 26").select("month"))


@query(
    "so_05_keys_without",
    "month:d",
    "SELECT month FROM r_rain EXCEPT SELECT month FROM r_station WHERE station = 3 AND q > 26",
)
def _(t):
    return t.rain.select("month").subtract(t.station.where("station = 3 AND q > 26").select("month"))


@query(
    "so_06_concat_time",
    "time:d n:i",
    "SELECT time, count(*) AS n FROM (SELECT time FROM r_grid WHERE year < 1998 UNION ALL SELECT time FROM r_grid WHERE year >= 1998) GROUP BY time",
)
def _(t):
    early, late = t.grid.where("time < date'1998-01-01'"), t.grid.where("time >= date'1998-01-01'")
    return early.unionByName(late).groupBy("time").agg(F.count(F.lit(1)).alias("n"))
