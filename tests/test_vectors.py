"""Polygons, lines, sampling and nearest neighbours against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marshlight.operators import blocks as B
from marshlight.operators import channels as H
from marshlight.operators import polygons as P
from marshlight.operators import sequence as Q
from marshlight.sources import tiles as X

L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]


def ring(spark, points, region=1, ring_no=0):
    return spark.createDataFrame([(region, 0, ring_no, i * 3, float(x), float(y)) for i, (x, y) in enumerate(points)],
                                 "region int, part int, ring int, seq int, lon double, lat double")


def inside(points, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
            hit = not hit
    return hit


@pytest.mark.parametrize("points", [L_SHAPE, L_SHAPE[::-1], L_SHAPE + L_SHAPE[:1]])
def test_area_and_centroid(spark, points):
    m = P.measures(ring(spark, points)).first()
    assert m.area == pytest.approx(6.0)
    assert m.cx == pytest.approx((4 * 2 + 2 * 0.5) / 6) and m.cy == pytest.approx((4 * 0.5 + 2 * 2) / 6)


def test_hole_and_overlap(spark):
    both = ring(spark, L_SHAPE).unionByName(ring(spark, [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)], ring_no=1))
    assert P.measures(both).first().area == pytest.approx(5.75)
    rects = spark.createDataFrame([(1, 0.5, 0.5, 2.0, 2.0), (2, 3.0, 2.0, 4.0, 3.0)], "rect int, west double, south double, east double, north double")
    rows = P.overlaps(rects, P.edges(both)).collect()
    assert [(r.rect, round(r.shared, 9)) for r in rows] == [(1, round(0.5 * 1.5 + 1.0 * 0.5 - 0.25 * 0.25, 9))]


def test_split_adds_up(spark):
    sides = {}
    for r in P.split_at_longitude(ring(spark, L_SHAPE), 0.6).select("side").distinct().collect():
        part = P.split_at_longitude(ring(spark, L_SHAPE), 0.6).where(F.col("side") == r.side).drop("side")
        sides[r.side] = P.measures(part).first().area
    assert sides["west"] == pytest.approx(0.6 * 3) and sum(sides.values()) == pytest.approx(6.0)


def test_cells_in_concave_polygon(spark):
    rows = spark.range(12).select(F.col("id").cast("int").alias("iy"), (F.col("id") * 0.25 + 0.1).alias("lat"))
    cols = spark.range(18).select(F.col("id").cast("int").alias("ix"), (F.col("id") * 0.25 + 0.1).alias("lon"))
    got = {(r.iy, r.ix) for r in P.region_mask(P.row_spans(P.edges(ring(spark, L_SHAPE)), rows), cols).collect()}
    assert got == {(y, x) for y in range(12) for x in range(18) if inside(L_SHAPE, x * 0.25 + 0.1, y * 0.25 + 0.1)}


def test_label_point_of_concave_shape(spark):
    arms = [(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5)]
    p = P.label_points(ring(spark, arms)).first()
    assert not p.inside and inside(arms, p.lon, p.lat)


def test_empty_polygons(spark):
    none = ring(spark, L_SHAPE).limit(0)
    assert P.measures(none).count() == 0 and P.edges(none).count() == 0


def test_edges_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(Q.positions, "__defaults__", (4,))
    monkeypatch.setattr(Q.with_next, "__defaults__", (4,))
    circle = [(math.cos(i / 50 * math.tau), math.sin(i / 50 * math.tau)) for i in range(50)]
    e = P.edges(ring(spark, circle)).orderBy("pos").collect()
    assert len(e) == 50
    for k, r in enumerate(e):
        assert (r.x1, r.y1, r.x2, r.y2) == (*circle[k], *circle[(k + 1) % 50])


def test_chunked_windows_equal_plain_ones(spark):
    rnd = random.Random(2)
    seq = sorted(rnd.sample(range(500), 90))
    data = [(k, s, rnd.random()) for k in ("hot", "cold") for s in (seq if k == "hot" else seq[:3])]
    df = spark.createDataFrame(data, "k string, s int, v double")
    near = Q.with_neighbours(Q.positions(df, ["k"], "s", 7), ["k"], ["v"], 4)
    rows = {(r.k, r.s): r for r in Q.running_sums(near, ["k"], "s", {"total": "v"}, {"whole": "v"}, size=7).collect()}
    for key in ("hot", "cold"):
        mine, total = [d for d in data if d[0] == key], 0.0
        for i, (_, s, v) in enumerate(mine):
            total += v
            r = rows[key, s]
            assert r.pos == i and r.n == len(mine) and r.total == pytest.approx(total)
            assert r.whole == pytest.approx(sum(d[2] for d in mine)) and r.is_last == (i == len(mine) - 1)
            assert r.prev_v == (mine[i - 1][2] if i else None)
            assert r.next_v == (mine[i + 1][2] if i + 1 < len(mine) else None)


@pytest.mark.parametrize("chunk", [10, 35, 1000])
def test_trailing_frame(spark, chunk):
    rnd = random.Random(3)
    data = [("x", rnd.randrange(300), float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, s bigint, v double")
    out = Q.trailing_frame(df, ["k"], "s", 10, {"n": F.count("v"), "t": F.sum("v")}, chunk).collect()
    assert len(out) == 200
    for r in out:
        mine = [v for _, s, v in data if r.s - 10 < s <= r.s]
        assert (r.n, r.t) == (len(mine), sum(mine))


def test_nearest_sample_equals_brute_force(spark):
    rnd = random.Random(7)
    samples = [(i, rnd.uniform(0, 90000), rnd.gauss(40000, 500)) for i in range(400)] + [(900, 5.0, 5.0), (901, 5.0, 5.0)]
    points = [(i, rnd.uniform(-60000, 150000), rnd.uniform(-90000, 120000)) for i in range(150)] + [(999, 5.0, 5.0)]
    s = spark.createDataFrame(samples, "sid int, x double, y double")
    p = spark.createDataFrame(points, "pid int, x double, y double")
    for r in H.nearest_sample(p, s, ["pid"], [], 1000.0).collect():
        d, sid = min((math.hypot(r.x - x, r.y - y), i) for i, x, y in samples)
        assert r.distance == pytest.approx(d) and r.sid == sid


def test_bilinear_is_exact_on_a_plane(spark):
    field = spark.createDataFrame([(i, j, -20 + 0.5 * i, 22 + 0.25 * j, (-20 + 0.5 * i) + 2 * (22 + 0.25 * j), j > 2) for i in range(5) for j in range(6)],
                                  "iy int, ix int, lat double, lon double, f double, m boolean")
    pts = spark.createDataFrame([(1, -19.3, 22.4), (2, -20.0, 22.4), (3, -18.0, 23.25), (4, -17.9, 22.4)], "id int, lat double, lon double")
    got = {r.id: r for r in H.sample_field(pts, field, ["id"], ["f"], ["m"]).collect()}
    assert got[1].f == pytest.approx(-19.3 + 44.8) and got[1].m is False
    assert got[2].f is None and got[4].f is None  # the lowest axis value counts as outside
    assert got[3].f == pytest.approx(-18.0 + 46.5) and got[3].m is True


def test_densify(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 30.0, 0.0), (1, 2, 30.0, 0.0), (1, 3, 30.0, 40.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0)],
                                 "line_id int, seq int, x double, y double")
    rows = H.tangents(H.densify(line, 20.0)).orderBy("pos").collect()
    assert [(round(r.s_m, 6), round(r.x, 6), round(r.y, 6)) for r in rows] == [(0, 0, 0), (17.5, 17.5, 0), (35, 30, 5), (52.5, 30, 22.5), (70, 30, 40)]
    assert (rows[0].tx, rows[0].ty) == (1.0, 0.0) and (rows[-1].tx, rows[-1].ty) == (0.0, 1.0)


def test_blocks_group_after_rounding(spark):
    data = []
    for t in ("2001-01-01", "2001-02-01"):
        for iy in range(2):
            for ix in range(3):
                v = 1.25 if ix < 2 else 1.25 + 1e-7 if iy == 0 else 3.0
                data.append((t, iy, ix, float(iy), float(ix), v))
    data += [("2001-01-01", 5, 5, 5.0, 5.0, None), ("2001-01-01", 6, 6, 6.0, 6.0, 1.25)]
    g = spark.createDataFrame(data, "time string, iy int, ix int, lat double, lon double, value double")
    b = B.discover_blocks(g).collect()
    assert sorted(r.cells for r in b) == [1, 1, 5]


def test_feature_text(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 1, 0.5 0.5))"), (2, "POLYGON ((0 0, x 1, 2 2))"),
                                (3, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"), (4, None)], "region int, wkt string")
    areas = {r.region: r.area for r in P.measures(X.polygon_vertices(df)).collect()}
    assert areas == {1: pytest.approx(3.75), 3: pytest.approx(1.0)}


def test_no_front_cell_is_an_error(spark):
    field = spark.createDataFrame([(0, 0, -19.0, 22.0, 1.0, 1.0, False)], "iy int, ix int, lat double, lon double, u_perp double, v_perp double, mask_front boolean")
    line = spark.createDataFrame([(1, 0, 22.0, -19.0), (1, 1, 22.1, -19.0)], "line_id int, seq int, lon double, lat double")
    with pytest.raises(ValueError, match="no cells"):
        H.parallel_to_channel(field, line)


def test_speed_along_an_eastward_channel(spark):
    field = spark.createDataFrame([(i, j, -19.2 + 0.1 * i, 21.9 + 0.1 * j, 7.0, 0.0, True) for i in range(4) for j in range(5)],
                                  "iy int, ix int, lat double, lon double, u_perp double, v_perp double, mask_front boolean")
    line = spark.createDataFrame([(1, 0, 22.2, -19.03), (1, 1, 22.0, -19.03)], "line_id int, seq int, lon double, lat double")
    rows = H.speed_along_channels(field, line, step_m=5000.0).collect()
    assert len(rows) == 6 and all(r.v_along == pytest.approx(-7.0, rel=1e-3) for r in rows)
    away = H.speed_along_channels(field, line, step_m=5000.0, apex=(-19.03, 21.5)).collect()
    assert all(r.flipped and r.v_along == pytest.approx(7.0, rel=1e-3) for r in away)
    assert {round(r.s_m + r.s_oriented_m) for r in away} == {round(max(r.s_m for r in away))}
