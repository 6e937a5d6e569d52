"""Harmonics, correlograms and lagged correlation of monthly series.

Lagged columns of a key come from one window over its months; every statistic is then one
aggregate.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import first_per_key


def annual_harmonic(series: DataFrame, keys: list[str], value: str, month: str = "month", period: int = 12) -> DataFrame:
    """Least squares on cosine and sine of the running month number, from cross-product sums.

    Intercept, coefficients, R^2, amplitude and phase atan2(-b, a) per key.
    """
    first = series.groupBy(*keys).agg(F.min(F.year(month)).alias("_y0"))
    t = (F.year(month) - F.col("_y0")) * 12 + F.month(month)
    rows = series.where(F.col(value).isNotNull()).join(first, keys).select(
        *keys, F.col(value).alias("_y"), F.cos(F.lit(2 * pi / period) * t).alias("_c"), F.sin(F.lit(2 * pi / period) * t).alias("_s")
    )
    cov = lambda a, b: F.covar_pop(a, b)
    m = rows.groupBy(*keys).agg(
        F.avg("_y").alias("my"), F.avg("_c").alias("mc"), F.avg("_s").alias("ms"),
        cov("_c", "_c").alias("cc"), cov("_s", "_s").alias("ss"), cov("_c", "_s").alias("cs"),
        cov("_c", "_y").alias("cy"), cov("_s", "_y").alias("sy"), cov("_y", "_y").alias("yy"),
    )
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    det = F.when(F.abs(det) > 1e-12, det)
    m = m.withColumns(
        {"a": (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det, "b": (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det}
    )
    return m.select(
        *keys, "a", "b", (F.col("my") - F.col("a") * F.col("mc") - F.col("b") * F.col("ms")).alias("intercept"),
        F.try_divide(F.col("a") * F.col("cy") + F.col("b") * F.col("sy"), F.col("yy")).alias("r2"),
        F.hypot("a", "b").alias("amplitude"), F.atan2(-F.col("b"), F.col("a")).alias("phase"),
    )


def harmonic_fitted(series: DataFrame, fit: DataFrame, keys: list[str], month: str = "month", period: int = 12) -> DataFrame:
    first = series.groupBy(*keys).agg(F.min(F.year(month)).alias("_y0"))
    t = F.lit(2 * pi / period) * ((F.year(month) - F.col("_y0")) * 12 + F.month(month))
    joined = series.join(first, keys).join(fit.select(*keys, "a", "b", "intercept"), keys)
    return joined.withColumn("fitted", F.col("intercept") + F.col("a") * F.cos(t) + F.col("b") * F.sin(t)).drop("_y0", "a", "b", "intercept")


def _shifted(rows: DataFrame, keys: list[str], value: str, lags: range, order: str) -> tuple[DataFrame, dict[int, str]]:
    w = Window.partitionBy(*keys).orderBy(order)
    names = {k: f"_lag_{k}".replace("-", "m") for k in lags}
    return rows.withColumns({n: F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w) for k, n in names.items()}), names


def _unstacked(wide: DataFrame, keys: list[str], names: dict[int, list[Column]], fields: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), *[c.alias(f) for c, f in zip(cols, fields)]) for k, cols in names.items()])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def autocorrelation(series: DataFrame, keys: list[str], value: str, lags: int = 36, month: str = "month") -> DataFrame:
    """ACF of the non-null values with the full-sample mean and divisor n."""
    seen = series.where(F.col(value).isNotNull())
    mean = seen.groupBy(*keys).agg(F.avg(value).alias("_m"))
    centred = seen.join(mean, keys).withColumn("_d", F.col(value) - F.col("_m"))
    rows, names = _shifted(centred, keys, "_d", range(0, lags + 1), month)
    wide = rows.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(n)).alias(n) for n in names.values()])
    return _unstacked(wide, keys, {k: [F.try_divide(F.coalesce(F.col(n), F.lit(0.0)), F.col("_v"))] for k, n in names.items()}, ["acf"])


def cross_correlation(pairs: DataFrame, keys: list[str], x: str, y: str, lags: range = range(-10, 11), month: str = "month") -> DataFrame:
    """corr(x, y shifted by lag rows), pairwise-complete."""
    rows, names = _shifted(pairs, keys, y, lags, month)
    wide = rows.groupBy(*keys).agg(*[F.corr(x, n).alias(n) for n in names.values()])
    return _unstacked(wide, keys, {k: [F.col(n)] for k, n in names.items()}, ["r"])


def student_tail(r: Column, pairs: Column) -> Column:
    """Two-sided p-value of a Pearson r: the finite trigonometric sums of Student's t for whole df."""
    df = (pairs - 2).cast("int")
    c2 = F.greatest(1 - r * r, F.lit(0.0))
    s, c = F.abs(r), F.sqrt(c2)
    even = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor((df - 2) / 2), F.lit(1)).cast("int")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("a")),
        lambda acc, j: F.struct(
            (acc["t"] * (2 * j - 1) / (2 * j) * c2).alias("t"),
            (acc["a"] + F.when(j <= (df - 2) / 2, acc["t"] * (2 * j - 1) / (2 * j) * c2).otherwise(0.0)).alias("a"),
        ),
    )["a"]
    odd = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor((df - 3) / 2), F.lit(1)).cast("int")),
        F.struct(c.alias("t"), c.alias("a")),
        lambda acc, j: F.struct(
            (acc["t"] * (2 * j) / (2 * j + 1) * c2).alias("t"),
            (acc["a"] + F.when(j <= (df - 3) / 2, acc["t"] * (2 * j) / (2 * j + 1) * c2).otherwise(0.0)).alias("a"),
        ),
    )["a"]
    theta = F.atan2(s, c)
    inside = F.when(df % 2 == 0, s * even).when(df == 1, 2 * theta / pi).otherwise(2 / pi * (theta + s * odd))
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


def lagged_correlation(pairs: DataFrame, keys: list[str], x: str, y: str, max_lag: int = 12, month: str = "month") -> DataFrame:
    """r and p of the predictor moved 0..max_lag rows back, on rows complete before the shift.

    Lags with fewer than five pairs or a constant side are left out.
    """
    whole = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows, names = _shifted(whole, keys, x, range(0, max_lag + 1), month)
    aggs = []
    for n in names.values():
        used = F.when(F.col(n).isNotNull(), F.col(y))
        aggs += [
            F.count(n).alias(f"{n}_n"), F.corr(n, y).alias(f"{n}_r"),
            ((F.max(n) > F.min(n)) & (F.max(used) > F.min(used))).alias(f"{n}_v"),
        ]
    wide = rows.groupBy(*keys).agg(*aggs)
    fields = {k: [F.col(f"{n}_n"), F.col(f"{n}_r"), F.col(f"{n}_v")] for k, n in names.items()}
    long = _unstacked(wide, keys, fields, ["pairs", "r", "varies"]).where((F.col("pairs") >= 5) & F.col("varies"))
    return long.select(*keys, F.col("lag").alias("lag_months"), "pairs", "r", student_tail(F.col("r"), F.col("pairs")).alias("p"))


def best_lags(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest lag per predictor by |r|, the smaller lag on ties, rounded for the table."""
    size = correlations.withColumn("_a", -F.abs("r"))
    best = first_per_key(size, keys, ["_a", "lag_months"])
    return best.select(*keys, F.col("lag_months").alias("best_lag_months"), F.round("r", 3).alias("r"), F.round("p", 4).alias("p")).orderBy(F.desc(F.abs("r")))
