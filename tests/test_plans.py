"""Shapes of physical plans that must hold at any scale."""

import pytest
from conftest import plan

from marshlight.operators import composite as K
from marshlight.operators import grid as O
from marshlight.operators import zonal as Z


def test_stencils_share_one_shuffle(spark, tables):
    stored = spark.createDataFrame([], "time date, iy int, ix int, lat double, lon double, value double")
    tiles = O.box_smooth(O.tiled(stored, 4, ["time"]), ["time"], ["value"], 3)
    text = plan(O.untiled(tiles))
    assert text.count("Exchange hashpartitioning") == 1


def test_crop_reaches_the_scan(spark, tmp_path, tables):
    path = str(tmp_path / "g")
    tables.grid.write.parquet(path)
    text = plan(O.crop(spark.read.parquet(path), 22.0, -19.5, 23.5, -18.25).select("time", "value"))
    assert "LessThanOrEqual(lat,-18.25)" in text.split("PushedFilters")[1]
    assert "iy" not in text.split("ReadSchema")[1]


def test_pair_composite_needs_no_join(spark, tables):
    text = plan(K.month_pair_composite(tables.grid, 3, 8))
    assert "Join" not in text


def test_partition_count_does_not_matter(spark, tables):
    cells = O.with_cell_area(tables.grid)
    want = {r.time: r.km2 for r in Z.wet_area(cells, ["time"], 0.5).collect()}
    got = {r.time: r.km2 for r in Z.wet_area(cells.repartition(37), ["time"], 0.5).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
