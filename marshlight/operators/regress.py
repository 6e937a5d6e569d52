"""Small regressions from distributed sufficient statistics.

A pass over the rows yields one cross-product table per key and fold block, with map-side combine.
Everything after that, fold scores included, is computed from those tables, in columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import solve as V
from .materialise import materialise
from .series import first_per_key


def with_folds(rows: DataFrame, keys: list[str], order: str, folds: int) -> DataFrame:
    """Time-ordered blocks: block i > 0 is the test part of fold i, all blocks before it train it.

    The test size is n // (folds + 1), test blocks end at the last row. Keys with fewer than two
    rows per fold are left out. Rows are monthly, so a key's window is calendar-long.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    placed = rows.withColumns({"_pos": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    size = F.floor(F.col("_n") / (folds + 1))
    start = F.col("_n") - folds * size
    block = F.when(F.col("_pos") < start, 0).otherwise(1 + F.floor((F.col("_pos") - start) / size))
    return placed.where(F.col("_n") >= 2 * folds).withColumn("block", block.cast("int")).drop("_pos", "_n")


def cross_products(rows: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Upper triangle of Z'Z with Z = [1, features, target], as one array per key."""
    z: list[Column] = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("g"))


def centred_sums(rows: DataFrame, keys: list[str], blocks: list[str], values: str, width: int) -> DataFrame:
    """Per key and block the matrix of the sums of z_i z_j, with z = [1, values less their mean of the key]; and these means.

    ``values`` is an array of ``width`` numbers. Sums of blocks add up; about the mean of the key they lose no digits
    to a mean that is large against the spread, as sums of the values themselves would.
    """
    mean = rows.groupBy(*keys).agg(F.array(*[F.avg(F.get(values, i)) for i in range(width)]).alias("centre"))
    met = rows.join(mean, keys) if keys else rows.crossJoin(mean)
    z = [F.lit(1.0), *[F.get(values, i) - F.get("centre", i) for i in range(width)]]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    # Written: inside a lambda the planner would put the array of all sums in place of its name, once per element.
    sums = materialise(met.groupBy(*keys, "centre", *blocks).agg(F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("_g")))
    size = width + 1
    place = lambda low, high: (low * size - low * (low - 1) / 2 + high - low).cast("int")
    every = F.sequence(F.lit(0), F.lit(width))
    matrix = F.transform(every, lambda i: F.transform(every, lambda j: F.get("_g", place(F.least(i, j), F.greatest(i, j)))))
    return sums.select(*keys, *blocks, "centre", matrix.alias("g"))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u + v))


def solved(sums: DataFrame, features: int, standardise: bool) -> DataFrame:
    """Ridge models of matrices ``g`` as ``centred_sums`` gives them, at strength ``alpha`` above 0; the target is the last value.

    Adds n, scale, factor (of the scaled matrix with the strength on its diagonal), coef, the mean of every value
    (``mean``, about ``centre``) and the intercept, which is not penalised. Features without spread have no weight.
    """
    top = F.get("g", 0)
    out = sums.withColumns({"n": F.get(top, 0), "mean": F.transform(F.slice(top, F.lit(2), F.lit(features + 1)), lambda v: v / F.get(top, 0))})
    about = lambda i, j, v: v - F.col("n") * F.get("mean", i) * F.get("mean", j)
    cut = lambda row: F.slice(row, F.lit(2), F.lit(features + 1))
    out = out.withColumn("_cross", F.transform(cut(F.col("g")), lambda row, i: F.transform(cut(row), lambda v, j: about(i, j, v))))
    spread = F.transform(F.slice("_cross", F.lit(1), F.lit(features)), lambda row, i: F.sqrt(F.greatest(F.get(row, i) / F.col("n"), F.lit(0.0))))
    out = out.withColumn("_spread", spread if standardise else F.array_repeat(F.lit(1.0), features))
    # Null where a feature has no spread: it is left out of the system.
    size = lambda s, i: F.greatest(F.lit(1.0), F.abs(F.get("centre", i) + F.get("mean", i))) * 1e-12
    out = out.withColumn("_by", F.transform("_spread", lambda s, i: F.when(s > size(s, i), s)) if standardise else F.col("_spread"))
    out = out.withColumn("scale", F.transform("_by", lambda s: F.coalesce(s, F.lit(1.0))))
    scaled = lambda v, i, j: F.coalesce(v / F.get("_by", i) / F.get("_by", j), F.lit(0.0)) + F.when(i == j, F.col("alpha")).otherwise(0.0)
    left = lambda rows: F.slice(rows, F.lit(1), F.lit(features))
    out = out.withColumns({
        "_matrix": F.transform(left(F.col("_cross")), lambda row, i: F.transform(left(row), lambda v, j: scaled(v, i, j))),
        "_right": F.transform(left(F.get("_cross", features)), lambda v, i: F.coalesce(v / F.get("_by", i), F.lit(0.0))),
    })
    out = out.withColumn("factor", V.cholesky(F.col("_matrix")))
    out = out.withColumn("_w", V.backward(F.col("factor"), V.forward(F.col("factor"), F.col("_right"))))
    out = out.withColumn("coef", F.zip_with("_w", "scale", lambda w, s: w / s))
    means = F.zip_with("centre", "mean", lambda c, m: c + m)
    intercept = F.get(means, features) - V.dot(F.col("coef"), F.slice(means, F.lit(1), F.lit(features)))
    return out.withColumn("intercept", intercept).drop("_cross", "_spread", "_by", "_matrix", "_right", "_w")


def ridge_cv_sets(
    rows: DataFrame, keys: list[str], sets: dict[str, list[str]], target: str, order: str, folds: int = 5,
    alphas: list[float] = (1.0,), standardise: bool = True,
) -> DataFrame:
    """Scores ``(keys, predictor_set, alpha, fold, n_test, r2, mse)`` of time-series cross-validation of several predictor sets.

    A set uses the rows that are complete in it. All sets are summed in one pass, with narrow ones filled up with
    zeros; folds are trained on the added sums of the blocks before them and scored from the sums of their own.
    """
    width = max(map(len, sets.values()))
    known = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    choices = [F.struct(F.lit(name).alias("predictor_set"), known([*cols]).alias("x")) for name, cols in sets.items()]
    chosen = rows.where(F.col(target).isNotNull()).select(*keys, order, F.col(target).cast("double").alias("_y"), F.explode(F.array(*choices)).alias("_s"))
    whole = chosen.select(*keys, order, "_s.predictor_set", "_s.x", "_y").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x")), F.array("_y"))
    by = [*keys, "predictor_set"]
    placed = with_folds(whole.withColumn("_z", filled), by, order, folds)
    sums = centred_sums(placed, by, ["block"], "_z", width + 1)
    listed = sums.groupBy(*by, "centre").agg(F.sort_array(F.collect_list(F.struct("block", "g"))).alias("_b"))
    tried = listed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    first = F.get("_b", 0)["g"]
    tried = tried.withColumn("g", F.aggregate(F.slice("_b", F.lit(2), F.col("fold") - 1), first, lambda s, b: _added(s, b["g"])))
    tried = tried.withColumn("_t", F.get("_b", F.col("fold"))["g"]).drop("_b")
    fit = solved(tried, width, standardise)
    # Errors about the centre: y - mean_y - coef (x - mean_x) = [shift, -coef, 1] z.
    shift = V.dot(F.col("coef"), F.slice("mean", F.lit(1), F.lit(width))) - F.get("mean", width)
    weights = F.concat(F.array(shift), F.transform("coef", lambda c: -c), F.array(F.lit(1.0)))
    fit = fit.withColumn("_c", weights)
    sse = F.greatest(V.dot(F.col("_c"), F.transform("_t", lambda row: V.dot(row, F.col("_c")))), F.lit(0.0))
    n, last = F.get(F.get("_t", 0), 0), F.get("_t", width + 1)
    sst = F.get(last, width + 1) - F.get(last, 0) * F.get(last, 0) / n
    fit = fit.withColumns({"_sse": sse, "_sst": sst, "n_test": n.cast("int")})
    r2 = F.when((F.col("n_test") >= 2) & (F.col("_sst") > 0), 1 - F.col("_sse") / F.col("_sst"))
    return fit.select(*by, "alpha", "fold", "n_test", r2.alias("r2"), (F.col("_sse") / F.col("n_test")).alias("mse"))


def ridge_cv(
    rows: DataFrame, keys: list[str], features: list[str], target: str, order: str, folds: int = 5,
    alphas: list[float] = (1.0,), standardise: bool = True,
) -> DataFrame:
    """Scores ``(keys, alpha, fold, n_test, r2, mse)`` of time-series cross-validation."""
    return ridge_cv_sets(rows, keys, {"": features}, target, order, folds, alphas, standardise).drop("predictor_set")


def mean_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean R^2 (folds without one ignored), mean MSE and mean RMSE per key and strength."""
    return scores.groupBy(*keys, "alpha").agg(
        F.round(F.avg(F.nanvl("r2", F.lit(None).cast("double"))), 3).alias("cv_r2"), F.avg("mse").alias("cv_mse"), F.avg(F.sqrt("mse")).alias("cv_rmse")
    )


def best_strength(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Strength with the lowest mean squared error; the earlier one on ties."""
    return first_per_key(mean_scores(scores, keys), keys, ["cv_mse", "alpha"]) if keys else mean_scores(scores, []).orderBy("cv_mse", "alpha").limit(1)


def ridge_fit(rows: DataFrame, keys: list[str], features: list[str], target: str, alpha: float = 1.0, standardise: bool = True) -> DataFrame:
    """Model per key: n, intercept, coef, and for hat values the features' means (``centre``), ``scale`` and ``factor``."""
    whole = rows.dropna(subset=[*features, target])
    z = F.array(*[F.col(c).cast("double") for c in (*features, target)])
    sums = centred_sums(whole.withColumn("_z", z), keys, [], "_z", len(features) + 1).withColumn("alpha", F.lit(float(alpha)))
    fit = solved(sums, len(features), standardise)
    means = F.slice(F.zip_with("centre", "mean", lambda c, m: c + m), F.lit(1), F.lit(len(features)))
    return fit.select(*keys, F.col("n").cast("int").alias("n"), "intercept", "coef", means.alias("centre"), "scale", "factor")


def predict(rows: DataFrame, model: DataFrame, keys: list[str], features: list[str], name: str = "predicted") -> DataFrame:
    """Add the prediction; the model is one row per key."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    m = model.select(*keys, "intercept", "coef")
    joined = rows.join(m, keys) if keys else rows.withColumns({c: model.select(c).scalar() for c in ("intercept", "coef")})
    return joined.withColumn(name, F.col("intercept") + V.dot(F.col("coef"), x)).drop("intercept", "coef")


def leave_one_out(rows: DataFrame, keys: list[str], features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Leave-one-out ridge predictions from one fit, by the hat-matrix identity.

    Features with any gap in a key are dropped for it; keys with fewer than four rows are left
    out. The scaler sees all rows of the key.
    """
    seen = rows.where(F.col(target).isNotNull())
    gaps = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f).isNull()).alias(f"_gap_{f}") for f in features]
    )
    usable = seen.join(gaps.where("_rows >= 4"), keys)
    usable = usable.withColumns({f: F.when(F.col(f"_gap_{f}") == 0, F.col(f).cast("double")).otherwise(0.0) for f in features})
    usable = usable.drop("_rows", *[f"_gap_{f}" for f in features])
    model = ridge_fit(usable, keys, features, target, alpha)
    j = usable.join(model, keys)
    off = F.zip_with(F.array(*features), F.col("centre"), lambda a, b: a - b)
    j = j.withColumn("_v", V.forward(F.col("factor"), F.zip_with(off, F.col("scale"), lambda a, b: a / b)))
    hat = 1 / F.col("n") + V.dot(F.col("_v"), F.col("_v"))
    fitted = F.col("intercept") + V.dot(F.col("coef"), F.array(*features))
    left = F.col(target) - (F.col(target) - fitted) / (1 - hat)
    return j.withColumn("predicted", left).drop("n", "intercept", "coef", "centre", "scale", "factor", "_v")


def metrics(df: DataFrame, keys: list[str], observed: str, predicted: str, back: bool = False) -> DataFrame:
    """RMSE, MAE and R^2, on the back-transformed scale when the target is log1p."""
    o, p = (F.expm1(observed), F.expm1(predicted)) if back else (F.col(observed), F.col(predicted))
    d = o - p
    return df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        (1 - F.try_divide(F.avg(d * d), F.var_pop(o))).alias("r2"),
    )


def month_slopes(coef: dict[str, tuple[float, float, float]], medians: DataFrame, base: str) -> DataFrame:
    """Seasonal slope a0 + as sin + ac cos per driver, its effect at the monthly median, and shares.

    ``medians`` has one row per calendar month; each driver gives ``slope_*``, ``effect_*`` and
    ``share_*``.
    """
    angle = F.lit(2 * np.pi) * F.col("month") / 12
    out = medians
    for name, (a0, a_sin, a_cos) in coef.items():
        out = out.withColumn(f"slope_{name}", F.lit(a0) + a_sin * F.sin(angle) + a_cos * F.cos(angle))
        out = out.withColumn(f"effect_{name}", (1 + F.col(base)) * F.expm1(f"slope_{name}"))
    total = sum((F.abs(f"effect_{n}") for n in coef), F.lit(1e-9))
    return out.withColumns({f"share_{n}": F.abs(f"effect_{n}") / total for n in coef})


def knock_out(rows: DataFrame, score: dict[str, float], intercept: float, drivers: dict[str, list[str]], month: str = "month") -> DataFrame:
    """Per calendar month: mean absolute loss on the back-transformed scale when a driver is zeroed."""

    def scored(without: list[str]) -> Column:
        return F.expm1(sum((F.col(f) * c for f, c in score.items() if f not in without), F.lit(float(intercept))))

    parts = {f"abs_{d}": F.avg(F.abs(scored([]) - scored(fs))) for d, fs in drivers.items()}
    out = rows.groupBy(F.month(month).alias("month")).agg(*[c.alias(n) for n, c in parts.items()])
    total = sum((F.col(n) for n in parts), F.lit(1e-9))
    return out.withColumns({f"share_{d}": F.col(f"abs_{d}") / total for d in drivers})


def score_table(scores: DataFrame, rows: list[str], column: str, names: list[str], value: str = "cv_r2") -> DataFrame:
    """Scores with one column per model; a known list keeps it to one pass."""
    return scores.groupBy(*rows).pivot(column, names).agg(F.max(value))


def best_set(scores: DataFrame, keys: list[str], value: str = "cv_r2") -> DataFrame:
    """Predictor set with the highest mean score across models."""
    mean = scores.groupBy(*keys, "predictor_set").agg(F.avg(value).alias(value))
    return first_per_key(mean.where(F.col(value).isNotNull()).withColumn("_o", -F.col(value)), keys, ["_o", "predictor_set"]).drop("_o")


def forest_scores(rows: DataFrame, features: list[str], target: str, train: Column, trees: int = 200, boost_rounds: int = 200) -> DataFrame:
    """Random forest and gradient boosting on a train part, RMSE, MAE and R^2 on the rest."""
    whole = rows.dropna(subset=[*features, target]).withColumn("_train", train)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(whole)
    fit_on = data.where("_train")
    models = {
        "RF": RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=5, minInstancesPerNode=3, seed=42),
        "GradBoost": GBTRegressor(labelCol=target, maxIter=boost_rounds, maxDepth=3, stepSize=0.05, seed=42),
    }
    parts = [
        model.fit(fit_on).transform(data.where(~F.col("_train"))).select(F.lit(name).alias("model"), target, F.col("prediction"))
        for name, model in models.items()
    ]
    return metrics(parts[0].unionByName(parts[1]), ["model"], target, "prediction")
