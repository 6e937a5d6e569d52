"""Stencils, front motion and quantiles on inputs with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshlight.functions import calendar as C
from marshlight.functions import raster as R
from marshlight.operators import fronts as V
from marshlight.operators import grid as O
from marshlight.operators import zonal as Z
from marshlight.operators.quantiles import exact_quantiles

CELLS = "time date, iy int, ix int, lat double, lon double, value double"


def plane(spark, a=0.3, b=0.002, days=("2001-01-01", "2001-02-10"), ny=9, nx=7):
    import datetime as dt

    d0 = dt.date.fromisoformat(days[0])
    rows = []
    for d in days:
        t = dt.date.fromisoformat(d)
        for iy in range(ny):
            for ix in range(nx):
                lat, lon = -20 + 0.1 * iy, 22 + 0.1 * ix + 0.01 * ix * ix  # uneven columns
                rows.append((t, iy, ix, lat, lon, a * lon + b * (t - d0).days))
    return spark.createDataFrame(rows, CELLS)


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_plane_gradient_is_exact_everywhere(spark, tile):
    for r in O.spatial_gradient(plane(spark), tile=tile).collect():
        assert r.df_dx == pytest.approx(0.3 / (111320 * math.cos(math.radians(r.lat))), rel=1e-9)
        assert abs(r.df_dy) < 1e-15


def test_gradient_matches_numpy_on_uneven_axes(spark):
    rng = np.random.default_rng(1)
    lat, lon = np.sort(rng.uniform(-20, -18, 8)), np.sort(rng.uniform(21, 24, 6))
    field = rng.normal(size=(8, 6))
    rows = [(None, i, j, float(lat[i]), float(lon[j]), float(field[i, j])) for i in range(8) for j in range(6)]
    gy, gx = np.gradient(field, lat, lon, edge_order=2)
    for r in O.spatial_gradient(spark.createDataFrame(rows, CELLS), tile=3).collect():
        assert r.df_dy * 111132 == pytest.approx(gy[r.iy, r.ix], rel=1e-9, abs=1e-9)
        assert r.df_dx * 111320 * math.cos(math.radians(r.lat)) == pytest.approx(gx[r.iy, r.ix], rel=1e-9, abs=1e-9)


def test_plane_velocity(spark):
    g = plane(spark)
    field = V.front_velocity(V.snapshot_pair(g, "2001-01-03", "2001-02-09"), g, front_value=6.6, bandwidth=1e9, tile=4)
    rows = field.collect()
    assert len(rows) == 63 and all(r.mask_front for r in rows)
    for r in rows:
        steep = 0.3 / (111320 * math.cos(math.radians(r.lat)))
        assert r.df_dt == pytest.approx(0.002, rel=1e-9)
        assert r.v_normal == pytest.approx(-0.002 / steep, rel=1e-8)
        assert r.u_perp == pytest.approx(r.v_normal, rel=1e-9) and abs(r.v_perp) < 1e-3
    west = V.classify_direction(field, apex=(-19.6, 23.5)).collect()
    assert all(r.v_SE == pytest.approx(r.u_perp / math.sqrt(2), rel=1e-6) for r in west)


def test_same_snapshot_is_an_error(spark):
    with pytest.raises(Exception, match="nearest to one snapshot"):
        V.nearest_pair(plane(spark), "2001-01-01", "2001-01-02").collect()


def test_nearest_time_tie_takes_the_later(spark):
    rows = V.nearest_pair(plane(spark, days=("2001-01-01", "2001-01-03")), "2001-01-02", "2000-01-01").collect()
    assert (str(rows[0].t1), str(rows[0].t2)) == ("2001-01-03", "2001-01-01")


def test_smoothing_needs_the_whole_window(spark):
    g = plane(spark, days=("2001-01-01",)).withColumn("value", F.when((F.col("iy") != 4) | (F.col("ix") != 3), F.col("value")))
    out = {(r.iy, r.ix): r.value for r in O.smooth(g, 3, tile=2).collect()}
    full = {(r.iy, r.ix): r.value for r in g.collect()}
    for (y, x), v in out.items():
        near = [full.get((y + a, x + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        want = None if any(n is None for n in near) else sum(near) / 9
        assert (v is None) == (want is None)
        assert want is None or v == pytest.approx(want)


def test_null_cell_stays_in_the_weights(spark):
    rows = [(None, 0, 0, -19.0, 22.0, 4.0), (None, 0, 1, -19.0, 22.1, None)]
    g = spark.createDataFrame(rows, CELLS).withColumn("time", F.lit("2001-01-01").cast("date"))
    assert Z.weighted_mean(g, g.select("iy", "ix", "lat")).first()["mean"] == pytest.approx(2.0)
    assert Z.weighted_mean(g, g.select("iy", "ix", "lat"), valid_only=True).first()["mean"] == pytest.approx(4.0)


def test_nan_becomes_null(spark):
    df = R.nan_to_null(spark.createDataFrame([(float("nan"),), (2.0,)], "value double"), "value")
    assert df.agg(F.avg("value")).first()[0] == 2.0


def test_wet_rule_for_other_data(spark):
    g = spark.createDataFrame([(1, 30.0), (1, None), (2, 0.2)], "time int, value double")
    assert [r.wet for r in R.infer_wet(g).orderBy("time", F.desc_nulls_last("value")).collect()] == [True, False, True]


def test_water_years(spark):
    df = spark.createDataFrame([("2015-11-01",), ("2016-03-01",)], "s string").select(F.col("s").cast("date").alias("d"))
    assert [r[0] for r in df.select(C.water_year("d", 10)).collect()] == [2015, 2015]
    with pytest.raises(ValueError):
        C.water_year_of("y", "m", 7, "middle")


@pytest.mark.parametrize("accuracy", [40, 4096])
def test_quantiles_equal_numpy(spark, accuracy):
    rnd = random.Random(4)
    data = {k: [round(rnd.random() ** 5, 3) for _ in range(n)] for k, n in (("a", 4001), ("b", 1), ("c", 7))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("d", None)], "k string, v double")
    probs = {"q90": 0.9, "mid": 0.5, "low": 0.0, "top": 1.0}
    rows = exact_quantiles(df, ["k"], "v", probs, accuracy).collect()
    assert {r.k for r in rows} == {"a", "b", "c"}
    for r in rows:
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.k], p), abs=1e-12)


def test_empty_grid(spark):
    g = spark.createDataFrame([], CELLS)
    assert O.spatial_gradient(g).count() == 0
    assert exact_quantiles(g, ["time"], "value", {"q": 0.5}).count() == 0
