"""United areas, exact quantiles of large and small groups, centred regressions, trees, names and plans of zonal queries."""

import math
import random
import re

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from marshlight.functions import calendar as C
from marshlight.functions import raster as R
from marshlight.functions import text as T
from marshlight.operators import regions as A
from marshlight.operators import regress as M
from marshlight.operators import series as S
from marshlight.operators import solve as V
from marshlight.operators import trees as E
from marshlight.operators import zonal as Z
from marshlight.operators.quantiles import exact_quantiles
from marshlight.plans import all_queries
from marshlight.sources import tiles as X


def ring(region, points, label=0, part=0, ring=0):
    return [(label, region, part, ring, k, float(x), float(y)) for k, (x, y) in enumerate(points)]


def square(region, x, y, side, label=0, **kw):
    return ring(region, [(x, y), (x + side, y), (x + side, y + side), (x, y + side)], label, **kw)


def united(spark, rows):
    df = spark.createDataFrame(rows, "label int, region int, part int, ring int, seq int, lon double, lat double")
    return {r.region: r.area for r in A.union_area(df, "label").collect()}


def test_union_counts_overlaps_once(spark):
    rows = square(1, 0, 0, 2) + square(2, 1, 1, 2) + square(3, 10, 10, 1)  # 4 + 4 - 1, and one apart
    rows += square(1, 0, 0, 4, label=1) + square(2, 1, 1, 1, label=1)  # one inside the other
    rows += square(1, 0, 0, 3, label=2) + square(1, 1, 1, 1, label=2, ring=1)  # with a hole
    rows += square(1, 0, 0, 1, label=3) + square(2, 1, 0, 1, label=3)  # side by side
    rows += square(1, 5, 5, 2, label=4) + square(2, 5, 5, 2, label=4)  # the same twice
    got = united(spark, rows)
    assert got == {0: pytest.approx(8), 1: pytest.approx(16), 2: pytest.approx(8), 3: pytest.approx(2), 4: pytest.approx(4)}


def test_union_of_rotated_shapes_against_a_raster(spark):
    rng = random.Random(2)
    rows, shapes = [], []
    for region in range(6):
        cx, cy, size, turn = rng.random() * 2, rng.random() * 2, 0.4 + rng.random(), rng.random()
        points = [(cx + size * math.cos(turn + k * 2 * math.pi / 5), cy + size * math.sin(turn + k * 2 * math.pi / 5)) for k in range(5)]
        rows += ring(region, points)
        shapes.append(np.array(points))
    n = 1200
    xs = np.linspace(-2, 4, n, endpoint=False) + 3 / n
    gx, gy = np.meshgrid(xs, xs)
    inside = np.zeros((n, n), bool)
    for p in shapes:
        odd = np.zeros((n, n), bool)
        for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0)):
            odd ^= ((y1 > gy) != (y2 > gy)) & (gx < x1 + (gy - y1) / (y2 - y1) * (x2 - x1))
        inside |= odd
    assert united(spark, rows)[0] == pytest.approx(inside.sum() * (6 / n) ** 2, rel=2e-3)


@pytest.mark.parametrize("accuracy", [200, 4096])
def test_quantiles_of_all_sizes(spark, accuracy):
    rng = np.random.default_rng(1)
    data = {n: np.round(rng.lognormal(size=n), 4) for n in (1, 2, 3, 4, 5, 6, 9, 17, 64, 257, 1000, 30_000)}
    data[40_000] = np.concatenate([np.full(20_001, 5.0), rng.normal(5, 1e-9, 9_999), rng.normal(5, 1e6, 10_000)])  # crowded and far apart
    rows = spark.createDataFrame([(int(n), float(v)) for n, vs in data.items() for v in vs], "n int, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.1, "c": 0.3, "d": 0.5, "e": 0.95, "f": 1.0}
    for r in exact_quantiles(rows, ["n"], "v", probs, accuracy).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.n], p), rel=1e-12, abs=1e-12), (r.n, name)


def test_a_million_values_are_not_ranked_in_one_task(spark):
    df = spark.range(1_000_000).select((F.xxhash64("id") / 1e12).alias("v"))
    got = exact_quantiles(df, [], "v", {"q": 0.37}).first().q
    values = np.array([r.v for r in df.collect()])
    assert got == pytest.approx(np.quantile(values, 0.37), rel=1e-12)


def test_ridge_with_a_mean_far_above_the_spread(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=400), rng.normal(size=400) * 0.1
    rows = [(0, k, float(1e8 + x[k]), float(1e8 + 2 * x[k] + noise[k])) for k in range(400)]
    df = spark.createDataFrame(rows, "key int, t int, x double, y double").repartition(4)
    far = M.mean_scores(M.ridge_cv(df, ["key"], ["x"], "y", "t"), ["key"]).first()
    near = df.withColumns({"x": F.col("x") - 1e8, "y": F.col("y") - 1e8})
    want = M.mean_scores(M.ridge_cv(near, ["key"], ["x"], "y", "t"), ["key"]).first()
    assert far.cv_mse == pytest.approx(want.cv_mse, rel=1e-5) and far.cv_r2 == pytest.approx(want.cv_r2, abs=1e-3)


def test_systems_solved_in_columns(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, n in enumerate([1, 2, 5, 12]):
        half = rng.normal(size=(n, n))
        m, b = half @ half.T + 0.1 * np.eye(n), rng.normal(size=n)
        rows.append((k, m.tolist(), b.tolist()))
        want[k] = (np.linalg.cholesky(m), np.linalg.solve(m, b))
    df = spark.createDataFrame(rows, "k int, m array<array<double>>, b array<double>").withColumn("f", V.cholesky(F.col("m")))
    for r in df.withColumn("w", V.backward(F.col("f"), V.forward(F.col("f"), F.col("b")))).collect():
        factor, w = want[r.k]
        assert all(np.allclose(row, factor[i, : i + 1]) for i, row in enumerate(r.f)) and np.allclose(r.w, w)


def test_sets_of_predictors_in_one_pass(spark):
    """Each set as by itself: its own complete rows, its own folds."""
    rng = np.random.default_rng(7)
    rows = [(k, t, *(float(v) if rng.random() > 0.1 else None for v in rng.normal(size=3)), float(rng.normal())) for k in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "key int, t int, a double, b double, c double, y double")
    sets = {"a": ["a"], "all": ["a", "b", "c"], "bc": ["b", "c"]}
    got = {(r.key, r.predictor_set, r.fold): (r.n_test, r.r2, r.mse) for r in M.ridge_cv_sets(df, ["key"], sets, "y", "t").collect()}
    assert len(got) == 2 * 3 * 5
    for name, cols in sets.items():
        for r in M.ridge_cv(df, ["key"], cols, "y", "t").collect():
            assert got[r.key, name, r.fold] == pytest.approx((r.n_test, r.r2, r.mse), rel=1e-9)
    assert "Python" not in plan(M.ridge_cv_sets(df, ["key"], sets, "y", "t"))


def test_trees_find_steps_and_respect_leaf_sizes():
    x = np.arange(40.0).reshape(-1, 1)
    y = (x[:, 0] >= 25) * 3.0
    tree = E.grow(x, y, 3, 3)
    assert tree[:2] == (0, 24.5) and np.allclose(E.read_off(tree, x), y)
    assert E.grow(x[:5], y[:5], 3, 3) == 0.0
    assert not isinstance(E.grow(x, np.r_[np.zeros(39), 9.0], 1, 3), tuple) or E.grow(x, np.r_[np.zeros(39), 9.0], 1, 3)[1] <= 36.5
    fit = E.boosted(x, y, x, 150)
    assert np.abs(fit - y).max() < 0.05
    assert np.abs(E.forest(x, y, x, 40) - y).mean() < 0.3


def test_tree_scores_beat_the_mean_where_there_is_a_signal(spark):
    rng = random.Random(5)
    rows = [(k, t, float(rng.random()), float(rng.random())) for k in (1, 2) for t in range(120)]
    df = spark.createDataFrame(rows, "key int, t int, a double, b double").withColumn("y", F.sin(6 * F.col("a")) + 0.1 * F.col("b"))
    scores = E.tree_cv(df, ["key"], {"good": ["a", "b"], "poor": ["b"]}, "y", "t", trees=30, rounds=60).collect()
    assert len(scores) == 2 * 2 * 2 * 5
    assert all((s.r2 > 0.6) == (s.predictor_set == "good") for s in scores)


def test_each_ensemble_is_a_group_of_its_own(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.random((60, 2)), rng.random(60)
    df = spark.createDataFrame([(1, t, *map(float, x[t]), float(y[t])) for t in range(60)], "key int, t int, a double, b double, y double")
    out = E.tree_cv(df, ["key"], {"both": ["a", "b"]}, "y", "t", trees=5, rounds=5)
    groups = re.search(r"FlatMapGroupsInPandas \[([^\]]*)\]", plan(out)).group(1)
    assert [g.split("#")[0] for g in groups.split(", ")] == ["key", "predictor_set", "model", "fold"]
    want = {}
    for fold in range(1, 6):
        past, test = slice(0, 10 * fold), slice(10 * fold, 10 * fold + 10)
        for model, fit in (("RF", E.forest(x[past], y[past], x[test], 5)), ("GradBoost", E.boosted(x[past], y[past], x[test], 5))):
            want[model, fold] = (10, float(np.mean((y[test] - fit) ** 2)))
    assert {(r.model, r.fold): (r.n_test, r.mse) for r in out.collect()} == want
    assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_infinities_and_nan_are_no_values(spark):
    rows = [(v,) for v in (0.7, float("inf"), float("-inf"), float("nan"), None)]
    df = spark.createDataFrame(rows, "value double")
    assert [r.f for r in df.select(R.finite("value").alias("f")).collect()] == [0.7, None, None, None, None]
    cells = df.withColumns({"time": F.lit(1), "area_km2": F.lit(2.0)})
    assert Z.wet_area(cells, ["time"], 0.5).first().km2 == 2.0
    loop = spark.createDataFrame([(1, k, math.cos(k), math.sin(k)) for k in range(6)] + [(1, 7, float("inf"), 0.0)], "key int, o int, x double, y double")
    assert S.phase_loops(loop, ["key"], "x", "y", "o").first().direction == "CCW"


def test_names(spark):
    names = ["a_2001-02-03.nc", "a_20010203.nc", "12345678_2001_02_03.nc", "20019999_x.nc", "none"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(T.day_in_name("s").cast("string").alias("d"))
    assert [r.d for r in df.collect()] == ["2001-02-03", "2001-02-03", "2001-02-03", None, None]
    years = spark.createDataFrame([(2000, 6), (2000, 7), (2001, 1)], "y int, m int")
    got = lambda *a: [r[0] for r in years.select(C.water_year_of("y", "m", *a)).collect()]
    assert got() == [2000, 2001, 2001] and got(7, "starting") == [1999, 2000, 2000] and got(1) == [2000, 2000, 2001]


def test_variable_without_a_request(spark):
    rows = [("f", 0, "lat", ["lat"]), ("f", 1, "depth", ["lat", "lon"]), ("f", 2, "surface_water", ["n"]), ("g", 0, "time", ["time"]), ("g", 1, "q", ["t", "y", "x"])]
    df = spark.createDataFrame(rows, "file string, entry int, var string, dims array<string>")
    assert {r.file: r["var"] for r in X.resolve_name(df).collect()} == {"f": "surface_water", "g": "q"}
    assert {r.file: r["var"] for r in X.resolve_name(df, "Depth").collect()} == {"f": "depth", "g": "q"}


@pytest.mark.parametrize("name, most", [("ag_09_zonal_volume", 25), ("ag_23_basin_area", 12), ("ag_08_zonal_mean_median", 25)])
def test_zonal_plans_are_narrow(spark, tables, name, most):
    text = plan(all_queries()[name].build(tables))
    assert text.count("Exchange hashpartitioning") <= most and "NestedLoop" not in text and "Cartesian" not in text
