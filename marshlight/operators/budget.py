"""Monthly water budget, cumulative closure and lateral-flux fits.

All fits work on a handful of sums per product of the cumulative series, so a parameter sweep is
evaluated on the sums: its size is products x parameters, whatever the record length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J
from .series import step_change


def assemble_budget(terms: dict[str, DataFrame], storage: str, start: str | None = None, month: str = "month", max_gap_days: int = 45) -> DataFrame:
    """Outer-aligned budget terms with the storage change and the residual outflow.

    ``terms`` maps column names to ``(month, value)`` series and must hold ``Qin``, ``P``, ``ET``
    and the storage level. residual = Qin + P - ET - dS; complete rows are flagged.
    """
    ds = step_change(terms[storage], [], "value", month, max_gap_days).select(month, F.col("change").alias("value"))
    wide = J.align({**terms, "dS": ds}, month, "value")
    wide = wide.withColumn("residual", F.col("Qin") + F.col("P") - F.col("ET") - F.col("dS"))
    closed = F.col("Qin").isNotNull() & F.col("P").isNotNull() & F.col("ET").isNotNull() & F.col("dS").isNotNull()
    wide = wide.withColumn("has_closure", closed)
    return wide if start is None else wide.where(F.col(month) >= F.lit(start).cast("date"))


def cumulative_terms(budget: DataFrame, products: DataFrame, regressors: list[str], month: str = "month", product: str = "dataset", min_rows: int = 6) -> DataFrame:
    """Cumulative flux, storage change and regressors per product, on its complete months.

    ``products`` holds ``(month, dataset, value)``. Products with fewer than ``min_rows`` months
    are left out. One row per product and month: windows are calendar-long.
    """
    base = budget.select(month, "Qin", "P", "dS", *regressors).dropna()
    rows = products.where(F.col("value").isNotNull()).join(base, month)
    order = Window.partitionBy(product).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    flux = F.col("Qin") + F.col("P") - F.col("value")
    cum = rows.select(
        product, month,
        F.sum(flux).over(order).alias("cum_flux"), F.sum("dS").over(order).alias("cum_ds"),
        *[F.sum(r).over(order).alias(f"cum_{r}") for r in regressors],
        F.count(F.lit(1)).over(Window.partitionBy(product)).alias("_n"),
    )
    return cum.where(F.col("_n") >= min_rows).drop("_n")


def closure_sums(cum: DataFrame, regressors: list[str], product: str = "dataset") -> DataFrame:
    """n, sum R^2, sum R X_i and sum X_i X_j per product, with R the cumulative misclosure."""
    r = F.col("cum_flux") - F.col("cum_ds")
    x = [F.col(f"cum_{c}") for c in regressors]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(r * r).alias("rr")]
    for i, a in enumerate(x, 1):
        aggs.append(F.sum(r * a).alias(f"r{i}"))
        for j, b in enumerate(x[i - 1 :], i):
            aggs.append(F.sum(a * b).alias(f"x{i}{j}"))
    return cum.groupBy(product).agg(*aggs)


def _rmse(square: Column) -> Column:
    return F.sqrt(F.greatest(square, F.lit(0.0)) / F.col("n"))


def _square(a, b=None) -> Column:
    """Sum of squared misclosure for given coefficients, from the sums."""
    s = F.col("rr") + 2 * a * F.col("r1") + a * a * F.col("x11")
    if b is not None:
        s = s + 2 * b * F.col("r2") + 2 * a * b * F.col("x12") + b * b * F.col("x22")
    return s


def _improvement() -> Column:
    return F.when(F.col("rmse_base") > 0, (1 - F.col("rmse_tuned") / F.col("rmse_base")) * 100).otherwise(0.0)


def fit_one(sums: DataFrame, product: str = "dataset") -> DataFrame:
    """alpha = -sum(R X) / sum(X^2), errors before and after, best improvement first."""
    fit = sums.withColumn("alpha", F.try_divide(-F.col("r1"), F.col("x11")))
    fit = fit.withColumns({"rmse_base": _rmse(F.col("rr")), "rmse_tuned": _rmse(_square(F.col("alpha")))})
    return fit.withColumn("improvement_pct", _improvement()).orderBy(F.desc("improvement_pct"), product)


def fit_two(sums: DataFrame, product: str = "dataset") -> DataFrame:
    """Least squares on two regressors by their normal equations; null when they are collinear."""
    det = F.col("x11") * F.col("x22") - F.col("x12") * F.col("x12")
    det = F.when(F.abs(det) > 1e-12 * F.col("x11") * F.col("x22"), det)
    a = (-F.col("r1") * F.col("x22") + F.col("r2") * F.col("x12")) / det
    b = (-F.col("r2") * F.col("x11") + F.col("r1") * F.col("x12")) / det
    fit = sums.withColumns({"alpha": a, "beta": b})
    fit = fit.withColumns({"rmse_base": _rmse(F.col("rr")), "rmse_tuned": _rmse(_square(F.col("alpha"), F.col("beta")))})
    return fit.withColumn("improvement_pct", _improvement()).orderBy(F.desc("improvement_pct"), product)


def parameter_range(low: float, high: float, count: int) -> Column:
    """``count`` equally spaced values, both ends included, as an array."""
    step = (high - low) / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(float(low)) + i * F.lit(step))


def rmse_curve(sums: DataFrame, low: float = -1.5, high: float = 1.5, count: int = 301) -> DataFrame:
    swept = sums.withColumn("alpha", F.explode(parameter_range(low, high, count)))
    return swept.withColumn("rmse", _rmse(_square(F.col("alpha"))))


def rmse_surface(sums: DataFrame, low: float = -1.5, high: float = 2.0, count: int = 71) -> DataFrame:
    swept = sums.withColumn("alpha", F.explode(parameter_range(low, high, count)))
    swept = swept.withColumn("beta", F.explode(parameter_range(low, high, count)))
    return swept.withColumn("rmse", _rmse(_square(F.col("alpha"), F.col("beta"))))


def best_parameters(swept: DataFrame, names: list[str], product: str = "dataset") -> DataFrame:
    best = F.min_by(F.struct(*names, "rmse"), F.struct("rmse", *names))
    return swept.groupBy(product).agg(best.alias("b")).select(product, "b.*")


def negative_share(budget: DataFrame, value: str = "residual") -> DataFrame:
    """Months with a negative residual, as a share of those that have one."""
    seen = budget.where(F.col(value).isNotNull())
    return seen.agg(F.count(F.lit(1)).alias("months"), F.avg((F.col(value) < 0).cast("double")).alias("negative_share"))
