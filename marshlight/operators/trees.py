"""Cross-validated tree ensembles on one key's months, many keys and predictor sets at a time.

A group is one key with one predictor set, model and fold: its rows are the months of a record up to the
end of the fold's test part, some hundred. Spark deals the groups out; within one, the trees of one ensemble
are grown on presorted columns with numpy. Scores are of the same form as those of the ridge, so both go
into one table.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .regress import with_folds

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, draw=None) -> tuple | float:
    """A regression tree: (feature, threshold, left, right), or the mean of a leaf.

    The split with the lowest squared error, halfway between neighbouring values, leaves at least
    ``least`` rows on either side. ``draw`` picks the features that a split may use.
    """
    n = len(y)
    mean = float(y.mean())
    if depth == 0 or n < 2 * least or np.ptp(y) == 0:
        return mean
    cols = np.arange(x.shape[1]) if draw is None else draw(x.shape[1])
    order = x[:, cols].argsort(axis=0, kind="stable")
    v = x[order, cols]
    sums = (y - mean)[order].cumsum(axis=0)
    sizes = np.arange(least, n - least + 1)  # rows on the left
    gain = sums[sizes - 1] ** 2 * (n / (sizes * (n - sizes)))[:, None]
    gain[v[sizes - 1] >= v[sizes]] = 0.0
    k, c = divmod(int(gain.argmax()), len(cols))
    if gain[k, c] <= 0:
        return mean
    at, feature = sizes[k], int(cols[c])
    threshold = float((v[at - 1, c] + v[at, c]) / 2)
    left = x[:, feature] <= threshold
    return feature, threshold, grow(x[left], y[left], depth - 1, least, draw), grow(x[~left], y[~left], depth - 1, least, draw)


def read_off(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, threshold, left, right = tree
    out = np.empty(len(x))
    low = x[:, feature] <= threshold
    out[low], out[~low] = read_off(left, x[low]), read_off(right, x[~low])
    return out


def forest(x: np.ndarray, y: np.ndarray, ask: np.ndarray, trees: int, depth: int = 5, least: int = 3, seed: int = 42) -> np.ndarray:
    """Mean of trees grown on bootstrap samples, a third of the features at each split."""
    rng = np.random.default_rng(seed)
    some = lambda p: rng.permutation(p)[: max(1, p // 3)]
    out = np.zeros(len(ask))
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out += read_off(grow(x[rows], y[rows], depth, least, some), ask)
    return out / trees


def boosted(x: np.ndarray, y: np.ndarray, ask: np.ndarray, rounds: int, depth: int = 3, step: float = 0.05) -> np.ndarray:
    """Trees fitted one after the other to what is left of the target."""
    fit, out = np.full(len(y), y.mean()), np.full(len(ask), y.mean())
    for _ in range(rounds):
        tree = grow(x, y - fit, depth, 1)
        fit += step * read_off(tree, x)
        out += step * read_off(tree, ask)
    return out


def tree_cv(
    rows: DataFrame, keys: list[str], sets: dict[str, list[str]], target: str, order: str, folds: int = 5, trees: int = 200, rounds: int = 200
) -> DataFrame:
    """Scores ``(keys, predictor_set, model, fold, n_test, r2, mse)`` of both ensembles in time-series cross-validation."""
    features = sorted({f for names in sets.values() for f in names})
    parts = []
    for name, names in sets.items():
        whole = with_folds(rows.dropna(subset=[*names, target]), keys, order, folds)
        values = [F.when(F.lit(f in names), F.col(f).cast("double")).alias(f) for f in features]
        parts.append(whole.select(*keys, F.lit(name).alias("predictor_set"), "block", F.col(order), F.col(target).cast("double").alias("_y"), *values))
    tall = parts[0]
    for more in parts[1:]:
        tall = tall.unionByName(more)
    kinds = [tall.schema[k] for k in keys]
    dealt = tall.withColumn("fold", F.explode(F.sequence(F.greatest("block", F.lit(1)), F.lit(folds))))
    dealt = dealt.withColumn("model", F.explode(F.array(F.lit("RF"), F.lit("GradBoost"))))

    names = [*keys, "predictor_set", "model", "fold", "n_test", "r2", "mse"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        head = {k: pdf[k].iloc[0] for k in [*keys, "predictor_set", "model", "fold"]}
        x, y, block = pdf[sets[head["predictor_set"]]].to_numpy(float), pdf["_y"].to_numpy(float), pdf["block"].to_numpy()
        past, test = block < head["fold"], block == head["fold"]
        if not past.any() or not test.any():
            return pd.DataFrame(columns=names)
        fit = forest(x[past], y[past], x[test], trees) if head["model"] == "RF" else boosted(x[past], y[past], x[test], rounds)
        mse, spread = float(np.mean((y[test] - fit) ** 2)), float(np.var(y[test]))
        return pd.DataFrame([{**head, "n_test": int(test.sum()), "r2": 1 - mse / spread if spread > 0 else None, "mse": mse}], columns=names)

    schema = StructType(
        [*kinds, StructField("predictor_set", StringType()), StructField("model", StringType()), StructField("fold", IntegerType()),
         StructField("n_test", IntegerType()), StructField("r2", DoubleType()), StructField("mse", DoubleType())]
    )
    # A number of partitions is given, because by their bytes the groups would be put together into one task.
    group = [*keys, "predictor_set", "model", "fold"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *group).groupBy(*group).applyInPandas(score, schema)
