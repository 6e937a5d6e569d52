"""Queries for the water budget, correlation and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import raster as R
from ..operators import budget as U
from ..operators import gapfill as G
from ..operators import joins as J
from ..operators import regress as M
from ..operators import series as S
from ..operators import stats as T
from ..operators import trees as E
from ..operators.order import global_rank
from .registry import query
from .timeline import _gappy, _sparse, _SPINE

_KM2 = 23387.0


def _quadrants(t):
    name = F.concat(F.when(F.col("iy") >= 6, "N").otherwise("S"), F.when(F.col("ix") >= 6, "E").otherwise("W"))
    return t.grid.withColumns({"region": name, "value": F.col("value") * 20})


def _side(t, left, right):
    d = J.region_difference(_quadrants(t), [left], [right])
    return d.select(F.col("time").alias("month"), F.col("difference").alias("value"))


def _km3(df, value, month="month"):
    return df.select(month, (F.col(value) * _KM2 / 1e6).alias("value"))


def _budget(t):
    stored = t.storage.select("month", (F.col("cm") * 10).alias("mm"))
    return U.assemble_budget(
        {
            "Qin": t.flow.select("month", R.flow_to_km3("q", "month").alias("value")),
            "P": _km3(t.rain, "mm"),
            "ET": _km3(S.ensemble_median(t.et, "mm"), "mm"),
            "storage": _km3(stored, "mm"),
            "x1": _side(t, "NW", "NE"),
            "x2": _side(t, "SW", "SE"),
        },
        "storage", start="1995-03-01",
    )


_BUDGET = f"""
WITH st AS (SELECT month, cm * 10 * {_KM2}e0 / 1e6 AS v FROM r_storage),
ds AS (SELECT month, CASE WHEN date_diff('day', lag(month) OVER w, month) <= 45 THEN v - lag(v) OVER w END AS v FROM st WINDOW w AS (ORDER BY month)),
sd AS (SELECT time AS month, avg(v) FILTER (r = 'NW') - avg(v) FILTER (r = 'NE') AS x1, avg(v) FILTER (r = 'SW') - avg(v) FILTER (r = 'SE') AS x2
       FROM (SELECT time, value * 20 AS v, CASE WHEN iy >= 6 THEN 'N' ELSE 'S' END || CASE WHEN ix >= 6 THEN 'E' ELSE 'W' END AS r FROM r_grid) GROUP BY time),
mo AS (SELECT month FROM r_flow UNION SELECT month FROM r_rain UNION SELECT month FROM r_et UNION SELECT month FROM sd),
bw AS (SELECT mo.month, f.q * date_diff('day', mo.month, CAST(mo.month + INTERVAL 1 MONTH AS DATE)) * 86400 / 1e9 AS qin, r.mm * {_KM2}e0 / 1e6 AS p, e.mm * {_KM2}e0 / 1e6 AS et,
              st.v AS storage, ds.v AS ds, x1, x2
       FROM mo LEFT JOIN r_flow f ON f.month = mo.month LEFT JOIN r_rain r ON r.month = mo.month LEFT JOIN (SELECT month, median(mm) AS mm FROM r_et GROUP BY month) e ON e.month = mo.month
       LEFT JOIN st ON st.month = mo.month LEFT JOIN ds ON ds.month = mo.month LEFT JOIN sd ON sd.month = mo.month WHERE mo.month >= DATE '1995-03-01'),
cu AS (SELECT dataset, e.month, sum(qin + p - e.mm * {_KM2}e0 / 1e6) OVER w AS cf, sum(ds) OVER w AS cd, sum(x1) OVER w AS c1, sum(x2) OVER w AS c2, count(*) OVER (PARTITION BY dataset) AS n
       FROM r_et e JOIN bw ON bw.month = e.month WHERE qin IS NOT NULL AND p IS NOT NULL AND ds IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL WINDOW w AS (PARTITION BY dataset ORDER BY e.month)),
sm AS (SELECT dataset, count(*) AS n, sum((cf - cd) * (cf - cd)) AS rr, sum((cf - cd) * c1) AS r1, sum((cf - cd) * c2) AS r2, sum(c1 * c1) AS x11, sum(c1 * c2) AS x12, sum(c2 * c2) AS x22 FROM cu WHERE n >= 6 GROUP BY dataset)"""


@query(
    "st_05_budget",
    "month:d Qin:f P:f ET:f storage:f dS:f residual:f has_closure:b",
    _BUDGET + """ SELECT month, qin AS "Qin", p AS "P", et AS "ET", storage, ds AS "dS", qin + p - et - ds AS residual, qin IS NOT NULL AND p IS NOT NULL AND et IS NOT NULL AND ds IS NOT NULL AS has_closure FROM bw""",
)
def _(t):
    return _budget(t)


def _products(t):
    return t.et.select("month", "dataset", (F.col("mm") * _KM2 / 1e6).alias("value"))


def _cum(t):
    return U.cumulative_terms(_budget(t), _products(t), ["x1", "x2"])


@query(
    "wn_06_cumulative_terms",
    "dataset:s month:d cum_flux:f cum_ds:f cum_x1:f cum_x2:f",
    _BUDGET + " SELECT dataset, month, cf AS cum_flux, cd AS cum_ds, c1 AS cum_x1, c2 AS cum_x2 FROM cu WHERE n >= 6",
)
def _(t):
    return _cum(t)


_ONE = """ SELECT *, CASE WHEN rmse_base > 0 THEN (1 - rmse_tuned / rmse_base) * 100 ELSE 0 END AS improvement_pct FROM (
  SELECT dataset, -r1 / x11 AS alpha, sqrt(rr / n) AS rmse_base, sqrt((rr + 2 * (-r1 / x11) * r1 + (r1 / x11) * (r1 / x11) * x11) / n) AS rmse_tuned FROM sm)"""


@query("st_06_lateral_flux_one", "dataset:s alpha:f rmse_base:f rmse_tuned:f improvement_pct:f", _BUDGET + _ONE)
def _(t):
    return U.fit_one(U.closure_sums(_cum(t), ["x1", "x2"]))


@query(
    "sl_06_rank_by_improvement",
    "dataset:s rank:i",
    _BUDGET + f" SELECT dataset, row_number() OVER (ORDER BY improvement_pct DESC, dataset) AS rank FROM ({_ONE})",
)
def _(t):
    return global_rank(U.fit_one(U.closure_sums(_cum(t), ["x1", "x2"])), [F.desc("improvement_pct"), F.asc("dataset")])


@query(
    "st_07_lateral_flux_two",
    "dataset:s alpha:f beta:f rmse_base:f rmse_tuned:f improvement_pct:f",
    _BUDGET + """, ab AS (SELECT *, (-r1 * x22 + r2 * x12) / (x11 * x22 - x12 * x12) AS alpha, (-r2 * x11 + r1 * x12) / (x11 * x22 - x12 * x12) AS beta FROM sm),
    e AS (SELECT *, sqrt(rr / n) AS rmse_base, sqrt((rr + 2 * alpha * r1 + 2 * beta * r2 + alpha * alpha * x11 + 2 * alpha * beta * x12 + beta * beta * x22) / n) AS rmse_tuned FROM ab)
    SELECT dataset, alpha, beta, rmse_base, rmse_tuned, (1 - rmse_tuned / rmse_base) * 100 AS improvement_pct FROM e""",
)
def _(t):
    return U.fit_two(U.closure_sums(_cum(t), ["x1", "x2"]))


_CURVE = """ SELECT dataset, -1.5e0 + i * (3e0 / 300) AS alpha, sqrt((rr + 2 * (-1.5e0 + i * (3e0 / 300)) * r1 + (-1.5e0 + i * (3e0 / 300)) * (-1.5e0 + i * (3e0 / 300)) * x11) / n) AS rmse FROM sm, (SELECT unnest(range(301)) AS i)"""


@query("st_08_rmse_curve", "dataset:s alpha:f rmse:f", _BUDGET + _CURVE)
def _(t):
    return U.rmse_curve(U.closure_sums(_cum(t), ["x1", "x2"]))


@query(
    "jn_16_rmse_surface",
    "dataset:s alpha:f beta:f rmse:f",
    _BUDGET + """, g AS (SELECT sm.*, -1.5e0 + i * (3.5e0 / 70) AS a, -1.5e0 + j * (3.5e0 / 70) AS b FROM sm, (SELECT unnest(range(71)) AS i), (SELECT unnest(range(71)) AS j))
    SELECT dataset, a AS alpha, b AS beta, sqrt((rr + 2 * a * r1 + 2 * b * r2 + a * a * x11 + 2 * a * b * x12 + b * b * x22) / n) AS rmse FROM g""",
)
def _(t):
    return U.rmse_surface(U.closure_sums(_cum(t), ["x1", "x2"]))


@query(
    "sl_04_best_parameter",
    "dataset:s alpha:f rmse:f",
    _BUDGET + f", c AS ({_CURVE}) SELECT dataset, arg_min(alpha, struct_pack(a := rmse, b := alpha)) AS alpha, min(rmse) AS rmse FROM c GROUP BY dataset",
)
def _(t):
    return U.best_parameters(U.rmse_curve(U.closure_sums(_cum(t), ["x1", "x2"])), ["alpha"])


@query(
    "ag_36b_negative_share",
    "months:i negative_share:f",
    _BUDGET + " SELECT count(*) AS months, avg(CASE WHEN qin + p - et - ds < 0 THEN 1e0 ELSE 0e0 END) AS negative_share FROM bw WHERE qin + p - et - ds IS NOT NULL",
)
def _(t):
    return U.negative_share(_budget(t))


_HARMONIC = """
WITH z AS (SELECT dataset, month, mm AS y, cos(2 * pi() / 12 * t) AS c, sin(2 * pi() / 12 * t) AS s FROM (SELECT *, (year(month) - min(year(month)) OVER (PARTITION BY dataset)) * 12 + month(month) AS t FROM r_et)),
m AS (SELECT dataset, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy, var_pop(y) AS yy FROM z GROUP BY dataset),
f AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS a, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b FROM m)"""


@query(
    "st_01_annual_harmonic",
    "dataset:s a:f b:f intercept:f r2:f amplitude:f phase:f",
    _HARMONIC + " SELECT dataset, a, b, my - a * mc - b * ms AS intercept, (a * cy + b * sy) / yy AS r2, sqrt(a * a + b * b) AS amplitude, atan2(-b, a) AS phase FROM f",
)
def _(t):
    return T.annual_harmonic(t.et, ["dataset"], "mm")


@query(
    "st_01b_harmonic_fitted",
    "dataset:s month:d fitted:f",
    _HARMONIC + " SELECT z.dataset, z.month, my - a * mc - b * ms + a * c + b * s AS fitted FROM z JOIN f ON f.dataset = z.dataset",
)
def _(t):
    return T.harmonic_fitted(t.et, T.annual_harmonic(t.et, ["dataset"], "mm"), ["dataset"])


@query(
    "st_02_autocorrelation",
    "station:i lag:i acf:f",
    """WITH o AS (SELECT station, q - avg(q) OVER (PARTITION BY station) AS d, row_number() OVER (PARTITION BY station ORDER BY month) AS k FROM r_station),
       v AS (SELECT station, sum(d * d) AS v FROM o GROUP BY station), l AS (SELECT unnest(range(37)) AS lag)
       SELECT v.station, l.lag, coalesce((SELECT sum(a.d * b.d) FROM o a JOIN o b ON b.station = a.station AND b.k = a.k - l.lag WHERE a.station = v.station), 0) / v.v AS acf FROM v, l""",
)
def _(t):
    return T.autocorrelation(t.station, ["station"], "q")


@query(
    "st_03_cross_correlation",
    "station:i lag:i r:f",
    """WITH o AS (SELECT station, q, mm, row_number() OVER (PARTITION BY station ORDER BY s.month) AS k FROM r_station s JOIN r_rain r ON r.month = s.month)
       SELECT a.station, l.lag, corr(a.q, b.mm) AS r FROM o a CROSS JOIN (SELECT unnest(range(-10, 11)) AS lag) l JOIN o b ON b.station = a.station AND b.k = a.k - l.lag GROUP BY ALL""",
)
def _(t):
    return T.cross_correlation(t.station.join(t.rain, "month"), ["station"], "q", "mm")


_LAGGED = f"""
WITH o AS (SELECT g.station, q, mm, row_number() OVER (PARTITION BY station ORDER BY g.month) AS k FROM {_SPINE} g JOIN r_rain r ON r.month = g.month WHERE q IS NOT NULL),
c AS (SELECT a.station, l.lag, count(*) AS pairs, corr(b.mm, a.q) AS r FROM o a CROSS JOIN (SELECT unnest(range(13)) AS lag) l JOIN o b ON b.station = a.station AND b.k = a.k - l.lag GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT *, pairs - 2 AS df, 1 - r * r AS c2 FROM c),
j AS (SELECT d.*, unnest(range(0, 200)) AS j FROM d),
w AS (SELECT *, CASE WHEN j = 0 THEN 0e0 WHEN df % 2 = 0 THEN ln((2e0 * j - 1) / (2 * j) * c2) ELSE ln((2e0 * j) / (2 * j + 1) * c2) END AS lr FROM j WHERE j <= (df - 2 - df % 2) / 2),
x AS (SELECT station, lag, any_value(pairs) AS pairs, any_value(r) AS r, any_value(df) AS df, any_value(c2) AS c2, sum(e) AS e FROM (SELECT *, exp(sum(lr) OVER (PARTITION BY station, lag ORDER BY j)) AS e FROM w) GROUP BY station, lag),
y AS (SELECT station, lag AS lag_months, pairs, r, greatest(0e0, 1 - CASE WHEN df % 2 = 0 THEN abs(r) * e ELSE 2 / pi() * (atan2(abs(r), sqrt(c2)) + abs(r) * sqrt(c2) * e) END) AS p FROM x)"""


def _lag_corr(t):
    return T.lagged_correlation(_gappy(t).join(t.rain, "month"), ["station"], "mm", "q")


@query("st_04_lagged_correlation", "station:i lag_months:i pairs:i r:f p:f", _LAGGED + " SELECT * FROM y")
def _(t):
    return _lag_corr(t)


@query(
    "sl_03_best_lag",
    "station:i best_lag_months:i r:f p:f",
    _LAGGED + " SELECT station, arg_min(lag_months, struct_pack(a := -abs(r), b := lag_months)) AS best_lag_months, round(arg_min(r, struct_pack(a := -abs(r), b := lag_months)), 3) AS r, round(arg_min(p, struct_pack(a := -abs(r), b := lag_months)), 4) AS p FROM y GROUP BY station",
)
def _(t):
    return T.best_lags(_lag_corr(t), ["station"])


def _features(t):
    """Monthly rows per station: target q, predictors from rain, storage and seasonality."""
    x = t.rain.join(t.storage, "month").withColumn("key", F.lit(0))
    lagged = S.lag_features(x, ["key"], ["mm", "cm"], lags=(1, 2, 3), windows=(3,)).drop("key")
    return t.station.join(lagged, "month")


_SETS = {
    "rain": ["month_sin", "month_cos", "mm_lag1", "mm_lag2", "mm_lag3", "mm_roll3m"],
    "storage": ["month_sin", "month_cos", "cm_lag1", "cm_lag2", "cm_lag3", "cm_roll3m"],
    "both": ["month_sin", "month_cos", "mm_lag1", "mm_lag2", "cm_lag1", "cm_lag2"],
}


_LAGS = [1, 2, 3]
_SETS |= {
    "season": ["month_sin", "month_cos"],
    "rain_lags": [f"mm_lag{k}" for k in _LAGS],
    "storage_lags": [f"cm_lag{k}" for k in _LAGS],
    "lags": [f"{v}_lag{k}" for v in ("mm", "cm") for k in _LAGS],
    "rolls": ["month_sin", "month_cos", "mm_roll3m", "cm_roll3m"],
    "all": ["month_sin", "month_cos", *[f"{v}_lag{k}" for v in ("mm", "cm") for k in _LAGS], "mm_roll3m", "cm_roll3m"],
}
_MODELS = ["Ridge", "RF", "GradBoost"]


def _ridge_cv(t):
    """Mean ridge scores of every predictor set that the trees are grown on."""
    return M.mean_scores(M.ridge_cv_sets(_features(t), ["station"], _SETS, "q", "month"), ["station", "predictor_set"])


_SEASON = ["month_sin", "month_cos"]
_LAG_SETS = {
    "rain": ["mm"], "storage": ["cm"], "inflow": ["qin"], "rain+storage": ["mm", "cm"], "rain+inflow": ["mm", "qin"], "storage+inflow": ["cm", "qin"], "all": ["mm", "cm", "qin"],
}


def _lag_columns(v: str) -> list[str]:
    return [*[f"{v}_lag{k}" for k in S.LAGS], f"{v}_roll3m", f"{v}_roll6m"]


_FULL_SETS = {name: [*_SEASON, *[c for v in drivers for c in _lag_columns(v)]] for name, drivers in _LAG_SETS.items()}


def _full_features(t):
    """Monthly rows per station: target q, all lags and rolling means of rain, storage and inflow, seasonality."""
    x = t.rain.join(t.storage, "month").join(t.flow.withColumnRenamed("q", "qin"), "month").withColumn("key", F.lit(0))
    return t.station.join(S.lag_features(x, ["key"], ["mm", "cm", "qin"]).drop("key"), "month")


def _lags_sql(drivers: list[str], lags, windows) -> str:
    made = [f"lag({v}, {k}) OVER w AS {v}_lag{k}" for v in drivers for k in lags]
    made += [
        f"CASE WHEN count({v}) OVER {f} >= {n // 2} THEN avg({v}) OVER {f} END AS {v}_roll{n}m"
        for v in drivers for n in windows for f in [f"(ORDER BY month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"]
    ]
    return ", ".join(made)


def _complete_sql(features: str, sets: dict[str, list[str]]) -> str:
    """Rows complete in each set: station, predictor_set, month, z (features, then the target)."""
    season = "sin(2 * pi() * month(s.month) / 12) AS month_sin, cos(2 * pi() * month(s.month) / 12) AS month_cos"
    parts = [
        f"SELECT station, '{name}' AS predictor_set, month, CAST([{', '.join(cols)}, q] AS DOUBLE[]) AS z FROM rows_ WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}" for name, cols in sets.items()
    ]
    return f"rows_ AS (SELECT s.station, s.q, {season}, x.* FROM r_station s JOIN ({features}) x ON x.month = s.month), whole AS ({' UNION ALL '.join(parts)})"


def ridge_sql(keys: str, folds: int, alphas: list[float], standardise: bool = True) -> str:
    """CTEs from ``whole`` (keys, month, z) to ``scores`` (keys, alpha, fold, n_test, r2, mse): Cholesky factors and substitutions as folds over lists."""
    a, b = (", ".join(f"{s}.{k.strip()}" for k in keys.split(",")) for s in "ab")
    same = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    scale = "CASE WHEN s <= 1e-12 * greatest(1, abs(m)) THEN NULL ELSE s END" if standardise else "1e0"
    return f"""
    placed AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM whole WINDOW w AS (PARTITION BY {keys} ORDER BY month)),
    fold_ AS (SELECT *, n // {folds + 1} AS size, n - ({folds + 1} - fold) * (n // {folds + 1}) AS a FROM placed, (SELECT unnest(range(1, {folds + 1})) AS fold) WHERE n >= {2 * folds}),
    long_ AS (SELECT {keys}, fold, pos, pos < a AS train, len(z) AS p, unnest(range(1, len(z) + 1)) AS i, unnest(z) AS v FROM fold_ WHERE pos < a + size),
    mean_ AS (SELECT {keys}, fold, p, i, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM long_ WHERE train GROUP BY ALL),
    unit_ AS (SELECT {keys}, fold, p, i, m, CASE WHEN i = p THEN 1e0 ELSE {scale} END AS s FROM mean_),
    std_ AS (SELECT {a}, a.fold, a.pos, a.train, a.p, a.i, coalesce((v - m) / s, 0) AS u, v FROM long_ a JOIN unit_ b ON {same} AND b.fold = a.fold AND b.i = a.i),
    cross_ AS (SELECT {a}, a.fold, a.p, a.i, b.i AS j, sum(a.u * b.u) AS c FROM std_ a JOIN std_ b ON {same} AND b.fold = a.fold AND b.pos = a.pos WHERE a.train AND (b.i <= a.i) GROUP BY ALL),
    rows2_ AS (SELECT {keys}, fold, p, i, list(c ORDER BY j) AS row FROM cross_ GROUP BY ALL),
    system_ AS (SELECT {keys}, fold, alpha, max(p) - 1 AS p, list(row ORDER BY i) FILTER (i < p) AS matrix, first(row ORDER BY i DESC) AS target FROM rows2_, (SELECT unnest({alphas!r}) AS alpha) GROUP BY ALL),
    factor_ AS (
      SELECT {keys}, fold, alpha, p, target, list_reduce(matrix, lambda done, wanted: list_append(done, list_reduce(wanted, lambda r, e: list_append(r,
        CASE WHEN len(r) < len(done) THEN (e - coalesce(list_dot_product(r, done[len(r) + 1][1 : len(r)]), 0)) / done[len(r) + 1][len(r) + 1] ELSE sqrt(e + alpha - coalesce(list_dot_product(r, r), 0)) END),
        CAST([] AS DOUBLE[]))), CAST([] AS DOUBLE[][])) AS f FROM system_
    ),
    half_ AS (SELECT *, list_reduce(target[1 : p], lambda y, e: list_append(y, (e - coalesce(list_dot_product(y, f[len(y) + 1][1 : len(y)]), 0)) / f[len(y) + 1][len(y) + 1]), CAST([] AS DOUBLE[])) AS y FROM factor_),
    weight_ AS (SELECT {keys}, fold, alpha, list_reduce(list_reverse(range(1, p + 1)), lambda w, k: list_prepend((y[k] - coalesce(list_dot_product(list_transform(f[k + 1 :], lambda r: r[k]), w), 0)) / f[k][k], w), CAST([] AS DOUBLE[])) AS w FROM half_),
    guess_ AS (
      SELECT {a}, a.fold, alpha, pos, sum(CASE WHEN i < p THEN u * w[i] ELSE -u END) AS e, sum(CASE WHEN i = p THEN v END) AS y
      FROM std_ a JOIN weight_ b ON {same} AND b.fold = a.fold WHERE NOT train GROUP BY ALL
    ),
    scores AS (SELECT {keys}, alpha, fold, count(*) AS n_test, CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) END AS r2, avg(e * e) AS mse FROM guess_ GROUP BY ALL)"""


def _cv(t):
    """Mean scores of three models, every predictor set and station, over five folds."""
    trees = E.tree_cv(_features(t), ["station"], _SETS, "q", "month").withColumn("alpha", F.lit(1.0))
    scores = M.mean_scores(trees, ["station", "predictor_set", "model"])
    ridge = _ridge_cv(t).withColumn("model", F.lit("Ridge"))
    return scores.unionByName(ridge)


_CVOUT = "station:i predictor_set:s cv_r2:f cv_mse:f cv_rmse:f"


_DRIVERS = "SELECT r.month, mm, cm, f.q AS qin FROM r_rain r JOIN r_storage s ON s.month = r.month JOIN r_flow f ON f.month = r.month"


@query(
    "st_09_time_series_cv",
    _CVOUT,
    f"""WITH {_complete_sql(f"SELECT month, {_lags_sql(['mm', 'cm', 'qin'], S.LAGS, (3, 6))} FROM ({_DRIVERS}) WINDOW w AS (ORDER BY month)", _FULL_SETS)},
        {ridge_sql("station, predictor_set", 5, [1.0])}
        SELECT station, predictor_set, round(avg(r2), 3) AS cv_r2, avg(mse) AS cv_mse, avg(sqrt(mse)) AS cv_rmse FROM scores GROUP BY station, predictor_set""",
)
def _(t):
    """Ridge scores of seven predictor sets with seven lags and two rolling means of each driver."""
    return M.mean_scores(M.ridge_cv_sets(_full_features(t), ["station"], _FULL_SETS, "q", "month"), ["station", "predictor_set"])


@query("st_09c_three_models", "model:s " + _CVOUT)
def _(t):
    return _cv(t)


# One predictor: the standardised ridge has a closed form, so the folds can be written out in SQL.
_FOLDS = """
WITH o AS (SELECT station, q AS y, mm AS x, row_number() OVER (PARTITION BY station ORDER BY s.month) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n
           FROM r_station s JOIN r_rain r ON r.month = s.month),
f AS (SELECT *, n - (6 - fold) * (n // 6) AS a FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) WHERE n >= 10),
tr AS (SELECT station, fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS cxy, count(*) AS n FROM f WHERE pos < a GROUP BY ALL),
te AS (SELECT f.station, f.fold, y, my + (n2 * cxy / sx) / (n2 + {0}e0) * (x - mx) / sx AS p FROM f JOIN (SELECT *, n AS n2 FROM tr) tr ON tr.station = f.station AND tr.fold = f.fold WHERE pos >= a AND pos < a + f.n // 6),
sc AS (SELECT station, fold, avg((y - p) * (y - p)) AS mse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, count(*) AS n_test FROM te GROUP BY ALL)"""


@query("st_09b_cv_one_predictor", "station:i fold:i n_test:i r2:f mse:f", _FOLDS.format("1") + " SELECT station, fold, n_test, r2, mse FROM sc")
def _(t):
    return M.ridge_cv(t.station.join(t.rain, "month"), ["station"], ["mm"], "q", "month")


@query(
    "st_10c_strength_one_predictor",
    "station:i alpha:f cv_mse:f",
    "SELECT station, arg_min(alpha, struct_pack(a := mse, b := alpha)) AS alpha, min(mse) AS cv_mse FROM ("
    + " UNION ALL ".join(f"SELECT station, {a}e0 AS alpha, avg(mse) AS mse FROM ({_FOLDS.format(a)} SELECT * FROM sc) GROUP BY station" for a in (0.1, 1, 10, 100))
    + ") GROUP BY station",
)
def _(t):
    return M.best_strength(M.ridge_cv(t.station.join(t.rain, "month"), ["station"], ["mm"], "q", "month", alphas=[0.1, 1, 10, 100]), ["station"])


@query(
    "st_10_ridge_strength",
    "station:i alpha:f cv_mse:f",
    f"""WITH {_complete_sql(f"SELECT month, {_lags_sql(['mm', 'cm'], (1, 2, 3), (3,))} FROM ({_DRIVERS.replace(', f.q AS qin', '').replace(' JOIN r_flow f ON f.month = r.month', '')}) WINDOW w AS (ORDER BY month)", {"both": _SETS["both"]})},
        {ridge_sql("station", 4, [0.1, 0.3, 1, 3, 10, 30, 100], standardise=False)},
        m AS (SELECT station, alpha, avg(mse) AS mse FROM scores GROUP BY station, alpha)
        SELECT station, arg_min(alpha, struct_pack(a := mse, b := alpha)) AS alpha, min(mse) AS cv_mse FROM m GROUP BY station""",
)
def _(t):
    scores = M.ridge_cv(_features(t), ["station"], _SETS["both"], "q", "month", folds=4, alphas=[0.1, 0.3, 1, 3, 10, 30, 100], standardise=False)
    return M.best_strength(scores, ["station"])


@query(
    "st_10b_gram_entries",
    "station:i n:f sx:f sy:f xx:f xy:f yy:f",
    """SELECT station, count(*) AS n, sum(mm) AS sx, sum(q) AS sy, sum(mm * mm) AS xx, sum(mm * q) AS xy, sum(q * q) AS yy FROM r_station s JOIN r_rain r ON r.month = s.month GROUP BY station""",
)
def _(t):
    g = M.cross_products(t.station.join(t.rain, "month"), ["station"], ["mm"], "q")
    return g.select("station", *[F.get("g", i).alias(n) for i, n in enumerate(["n", "sx", "sy", "xx", "xy", "yy"])])


_RIDGE1 = """
WITH s AS (SELECT station, year(s.month) AS year, avg(q) AS q, avg(mm) AS mm FROM r_station s JOIN r_rain r ON r.month = s.month GROUP BY ALL),
z AS (SELECT *, (mm - avg(mm) OVER w) / stddev_pop(mm) OVER w AS x, q - avg(q) OVER w AS yc, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY station)),
b AS (SELECT station, sum(x * yc) / (sum(x * x) + 1) AS beta, sum(x * x) + 1 AS d FROM z GROUP BY station),
l AS (SELECT z.station, year, q, q - (yc - beta * x) / (1 - (1e0 / n + x * x / d)) AS predicted FROM z JOIN b ON b.station = z.station WHERE n >= 4)"""


def _annual(t):
    return t.station.join(t.rain, "month").groupBy("station", F.year("month").alias("year")).agg(F.avg("q").alias("q"), F.avg("mm").alias("mm"))


@query("st_11_leave_one_out", "station:i year:i predicted:f", _RIDGE1 + " SELECT station, year, predicted FROM l")
def _(t):
    return M.leave_one_out(_annual(t), ["station"], ["mm"], "q")


@query(
    "st_16_metrics",
    "station:i rmse:f mae:f r2:f",
    _RIDGE1 + " SELECT station, sqrt(avg((q - predicted) * (q - predicted))) AS rmse, avg(abs(q - predicted)) AS mae, 1 - avg((q - predicted) * (q - predicted)) / var_pop(q) AS r2 FROM l GROUP BY station",
)
def _(t):
    return M.metrics(M.leave_one_out(_annual(t), ["station"], ["mm"], "q"), ["station"], "q", "predicted")


@query(
    "st_16b_metrics_back_transformed",
    "part:s rmse:f mae:f r2:f",
    """WITH p AS (SELECT CASE WHEN year(s.month) <= 1998 THEN 'train' ELSE 'test' END AS part, q AS o, 10 + mm / 10 AS p FROM r_station s JOIN r_rain r ON r.month = s.month)
       SELECT part, sqrt(avg((o - p) * (o - p))) AS rmse, avg(abs(o - p)) AS mae, 1 - avg((o - p) * (o - p)) / var_pop(o) AS r2 FROM p GROUP BY part""",
)
def _(t):
    p = t.station.join(t.rain, "month").select(
        F.when(F.year("month") <= 1998, "train").otherwise("test").alias("part"), F.log1p("q").alias("o"), F.log1p(10 + F.col("mm") / 10).alias("p")
    )
    return M.metrics(p, ["part"], "o", "p", back=True)


@query("st_12_forests", "model:s rmse:f mae:f r2:f")
def _(t):
    return M.forest_scores(_features(t), _SETS["both"], "q", F.year("month") <= 1999)


_RESERVOIR = """SELECT o.month, tau, sum((1 - exp(-1 / tau)) * exp(-(o.k - p.k) / tau) * p.v) AS r FROM ({0}) o JOIN ({0}) p ON p.k <= o.k, (SELECT unnest({1}) AS tau) GROUP BY ALL"""
_TRAINED = "(r - avg(r) FILTER (year(month) <= 1999) OVER (PARTITION BY tau)) / (stddev_pop(r) FILTER (year(month) <= 1999) OVER (PARTITION BY tau) + 1e-9)"


def _driven(v: str) -> str:
    return f"SELECT r.month, {v} AS v, row_number() OVER (ORDER BY r.month) AS k FROM r_rain r JOIN r_storage s ON s.month = r.month"


@query(
    "st_13_reservoir_times",
    "tau_h:f tau_d:f cv_rmse:f",
    f"""WITH h AS (SELECT month, tau, {_TRAINED} AS z FROM (SELECT * FROM ({_RESERVOIR.format(_driven("mm"), [2e0, 3e0, 4e0, 5e0, 6e0])}) WHERE month IN (SELECT month FROM r_flow))),
        d AS (SELECT month, tau, {_TRAINED} AS z FROM (SELECT * FROM ({_RESERVOIR.format(_driven("cm"), [0.5, 1e0, 1.5, 2e0])}) WHERE month IN (SELECT month FROM r_flow))),
        whole AS (SELECT h.tau AS tau_h, d.tau AS tau_d, h.month, [sin(2 * pi() * month(h.month) / 12), cos(2 * pi() * month(h.month) / 12), h.z, d.z, ln(1 + f.q)] AS z
                  FROM h JOIN d ON d.month = h.month JOIN r_flow f ON f.month = h.month WHERE year(h.month) <= 1999),
        {ridge_sql("tau_h, tau_d", 4, [1.0], standardise=False)}
        SELECT tau_h, tau_d, avg(sqrt(mse)) AS cv_rmse FROM scores GROUP BY tau_h, tau_d ORDER BY cv_rmse, tau_h, tau_d LIMIT 1""",
)
def _(t):
    """Time constants with the lowest cross-validated error on the training years."""
    x = t.rain.join(t.storage, "month").withColumn("key", F.lit(0))
    h = S.exp_reservoir(x, ["key"], "mm", [2, 3, 4, 5, 6]).select("month", F.col("tau").alias("tau_h"), F.col("reservoir").alias("rh"))
    d = S.exp_reservoir(x, ["key"], "cm", [0.5, 1, 1.5, 2]).select("month", F.col("tau").alias("tau_d"), F.col("reservoir").alias("rd"))
    rows = h.join(d, "month").join(t.flow.select("month", F.log1p("q").alias("y")), "month")
    train = F.year("month") <= 1999
    rows = S.z_scored(S.z_scored(rows, ["tau_h", "tau_d"], "rh", train).withColumnRenamed("z", "rh_z"), ["tau_h", "tau_d"], "rd", train).withColumnRenamed("z", "rd_z")
    m = F.month("month")
    rows = rows.where(train).withColumns({"s": C.season_sin(m), "c": C.season_cos(m)})
    scores = M.mean_scores(M.ridge_cv(rows, ["tau_h", "tau_d"], ["s", "c", "rh_z", "rd_z"], "y", "month", folds=4, standardise=False), ["tau_h", "tau_d"])
    return scores.orderBy("cv_rmse", "tau_h", "tau_d").limit(1)


_COEF = {"H": (0.21, 0.05, -0.08), "D": (0.12, -0.03, 0.04)}


@query(
    "st_14_month_slopes",
    "month:i slope_H:f effect_H:f share_H:f slope_D:f effect_D:f share_D:f",
    """WITH m AS (SELECT month(month) AS month, median(q) AS base FROM r_flow WHERE year(month) <= 1999 GROUP BY ALL),
       s AS (SELECT month, base, 0.21e0 + 0.05e0 * sin(2 * pi() * month / 12) - 0.08e0 * cos(2 * pi() * month / 12) AS h, 0.12e0 - 0.03e0 * sin(2 * pi() * month / 12) + 0.04e0 * cos(2 * pi() * month / 12) AS d FROM m),
       e AS (SELECT *, (1 + base) * (exp(h) - 1) AS eh, (1 + base) * (exp(d) - 1) AS ed FROM s)
       SELECT month, h AS "slope_H", eh AS "effect_H", abs(eh) / (abs(eh) + abs(ed) + 1e-9) AS "share_H", d AS "slope_D", ed AS "effect_D", abs(ed) / (abs(eh) + abs(ed) + 1e-9) AS "share_D" FROM e""",
)
def _(t):
    med = t.flow.where("year(month) <= 1999").groupBy(F.month("month").alias("month")).agg(F.median("q").alias("base"))
    return M.month_slopes(_COEF, med, "base")


@query(
    "st_15_knock_out",
    "month:i abs_rain:f abs_storage:f share_rain:f share_storage:f",
    """WITH x AS (SELECT month(r.month) AS month, 0.3e0 + 0.01e0 * mm + 0.002e0 * cm AS f, 0.3e0 + 0.002e0 * cm AS nr, 0.3e0 + 0.01e0 * mm AS ns FROM r_rain r JOIN r_storage s ON s.month = r.month),
       g AS (SELECT month, avg(abs(exp(f) - exp(nr))) AS a, avg(abs(exp(f) - exp(ns))) AS b FROM x GROUP BY month)
       SELECT month, a AS abs_rain, b AS abs_storage, a / (a + b + 1e-9) AS share_rain, b / (a + b + 1e-9) AS share_storage FROM g""",
)
def _(t):
    rows = t.rain.join(t.storage, "month")
    return M.knock_out(rows, {"mm": 0.01, "cm": 0.002}, 0.3, {"rain": ["mm"], "storage": ["cm"]})


def _basis_sql(x: str) -> list[str]:
    """Values at x of the three splines between the knots t1 and t2."""
    left, right = "((t2 - t0) * (t2 - t1))", "((t3 - t1) * (t2 - t1))"
    return [f"(t2 - {x}) * (t2 - {x}) / {left}", f"(({x} - t0) * (t2 - {x}) / {left} + (t3 - {x}) * ({x} - t1) / {right})", f"({x} - t1) * ({x} - t1) / {right}"]


_MIDDLE = ["(lag(x, 2) OVER w + lag(x) OVER w) / 2e0", "(lag(x) OVER w + x) / 2e0", "(x + lead(x) OVER w) / 2e0", "(lead(x) OVER w + lead(x, 2) OVER w) / 2e0"]
_KNOTS = ", ".join(f"CASE WHEN i + {k} >= n THEN max(x) OVER v WHEN i + {k} <= 2 THEN min(x) OVER v ELSE {m} END AS t{k}" for k, m in enumerate(_MIDDLE))


@query(
    "st_17_spline_gap_fill",
    "station:i month:d q:f filled:f",
    f"""WITH RECURSIVE s AS (
         SELECT station, month, q, CAST(row_number() OVER w - 1 AS DOUBLE) AS x, count(q) OVER w - 1 AS i, count(q) OVER (PARTITION BY station) AS n
         FROM {_SPINE} WINDOW w AS (PARTITION BY station ORDER BY month)),
       g AS (SELECT *, sum((q IS NULL)::INT) OVER (PARTITION BY station, i) AS gap FROM s),
       p AS (SELECT station, i, n, x, q AS y, {_KNOTS} FROM s WHERE q IS NOT NULL AND n >= 3 WINDOW w AS (PARTITION BY station ORDER BY x), v AS (PARTITION BY station)),
       e AS (SELECT *, {', '.join(f"CASE WHEN i = 0 OR i = n - 1 THEN {end} ELSE {v} END AS {name}" for name, end, v in zip("abc", ("0e0", "1e0", "0e0"), _basis_sql("x")))} FROM p),
       f AS (SELECT station, i, 0e0 AS cp, y AS dp FROM e WHERE i = 0
             UNION ALL SELECT e.station, e.i, c / (b - a * cp), (y - a * dp) / (b - a * cp) FROM f JOIN e ON e.station = f.station AND e.i = f.i + 1),
       r AS (SELECT f.station, f.i, dp AS w FROM f JOIN e ON e.station = f.station AND e.i = f.i AND f.i = n - 1
             UNION ALL SELECT f.station, f.i, dp - cp * w FROM r JOIN f ON f.station = r.station AND f.i = r.i - 1),
       o AS (SELECT p.*, lag(w) OVER (PARTITION BY p.station ORDER BY p.i) AS wl, w, lead(w) OVER (PARTITION BY p.station ORDER BY p.i) AS wr FROM p JOIN r ON r.station = p.station AND r.i = p.i),
       h AS (SELECT g.*, CASE WHEN g.x < (a.x + b.x) / 2 THEN g.i ELSE g.i + 1 END AS near FROM g JOIN p a ON a.station = g.station AND a.i = g.i JOIN p b ON b.station = g.station AND b.i = g.i + 1
             WHERE q IS NULL AND gap <= 2 AND g.n >= 3)
       SELECT g.station, g.month, g.q, coalesce(g.q, {' + '.join(f"{w} * {v}" for w, v in zip(("wl", "w", "wr"), _basis_sql("h.x")))}) AS filled
       FROM g LEFT JOIN h ON h.station = g.station AND h.month = g.month LEFT JOIN o ON o.station = h.station AND o.i = greatest(1, least(h.near, h.n - 2))""",
)
def _(t):
    return G.fill_gaps(S.on_month_spine(_sparse(t), ["station"]), ["station"], "q")


@query("st_18_score_table", "station:i predictor_set:s Ridge:f RF:f GradBoost:f")
def _(t):
    """Sets by models for each station."""
    return M.score_table(_cv(t), ["station", "predictor_set"], "model", _MODELS)


@query("sl_05_best_set", "station:i predictor_set:s cv_r2:f")
def _(t):
    return M.best_set(_cv(t), ["station"])
