"""Outlines against cell counting and strips; lines that cut regions; rings by pointer doubling; ranges by levels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marshlight.operators import levels as L
from marshlight.operators import overlay as O
from marshlight.operators import polygons as P
from marshlight.operators import regions as A

SCHEMA = "region long, part int, ring int, seq int, lon double, lat double"


def table(spark, polygons):
    """{region: [rings]}, the first ring of each the shell."""
    rows = [(region, 0, ring, seq, float(x), float(y)) for region, rings in polygons.items() for ring, points in enumerate(rings) for seq, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def united(spark, polygons):
    """(area, length, corners) of each ring, by shell."""
    chained = O.materialise(O.rings(O.boundary(O.oriented_edges(table(spark, polygons).withColumn("all", F.lit(1)), "all"))))
    found = {}
    for r in O.pieces(chained).collect():
        found.setdefault(r.piece, []).append((round(r.area, 9), round(r.length, 9), r.corners))
    return sorted(sorted(v, reverse=True) for v in found.values())


def test_squares(spark):
    overlap = {1: [box(0, 0, 2, 2)], 2: [box(1, 1, 3, 3)]}
    assert united(spark, overlap) == [[(7.0, 12.0, 8)]]
    side_by_side = {1: [box(0, 0, 1, 1)], 2: [box(1, 0, 2, 1)[::-1]], 3: [box(0, 1, 2, 2)]}
    assert united(spark, side_by_side) == [[(4.0, 8.0, 4)]]
    corner_to_corner = {1: [box(0, 0, 1, 1)], 2: [box(1, 1, 2, 2)]}
    assert united(spark, corner_to_corner) == [[(1.0, 4.0, 4)], [(1.0, 4.0, 4)]]
    frame = {1: [box(0, 0, 3, 1)], 2: [box(0, 2, 3, 3)], 3: [box(0, 0, 1, 3)], 4: [box(2, 0, 3, 3)]}
    assert united(spark, frame) == [[(9.0, 12.0, 4), (-1.0, 4.0, 4)]]
    holed = {1: [box(0, 0, 4, 4), box(1, 1, 3, 3)], 2: [box(0.5, 0.5, 1.5, 1.5)]}
    assert united(spark, holed) == [[(16.0, 16.0, 4), (-3.75, 8.0, 6)]]
    same = {1: [box(0, 0, 1, 1)], 2: [box(0, 0, 1, 1)[::-1]]}
    assert united(spark, same) == [[(1.0, 4.0, 4)]]
    assert united(spark, {1: [[(0, 0), (1, 1), (2, 2)]]}) == []


def flood(cells):
    """Numbers of connected areas by sides, and their sizes."""
    left, sizes = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            x, y = todo.pop()
            n += 1
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("seed", [1])
def test_rectangles_against_cells(spark, seed):
    """Rectangles with whole corners: areas and lengths of pieces follow from the unit cells that they cover."""
    rng = random.Random(seed)
    polygons, cells = {}, set()
    for i in range(40):
        x, y, w, h = rng.randrange(20), rng.randrange(20), rng.randint(1, 4), rng.randint(1, 4)
        polygons[i] = [box(x, y, x + w, y + h)[:: rng.choice([1, -1])]]
        cells |= {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
    got = united(spark, polygons)
    assert sorted(round(sum(r[0] for r in rings)) for rings in got) == flood(cells)
    border = sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert round(sum(r[1] for rings in got for r in rings)) == border
    corners = 0
    for x in range(26):
        for y in range(26):
            around = [(a, b) in cells for a, b in ((x - 1, y - 1), (x, y - 1), (x, y), (x - 1, y))]
            corners += {1: 1, 3: 1}.get(sum(around), 2 * (sum(around) == 2 and around[0] == around[2]))
    assert sum(r[2] for rings in got for r in rings) == corners


def test_triangles_against_strips(spark):
    """Areas of unions as strips give them, and the vertex table measures the same."""
    rng = random.Random(4)
    polygons = {}
    for i in range(60):
        x, y = rng.uniform(0, 8), rng.uniform(0, 8)
        polygons[i] = [[(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for _ in range(3)]]
    df = table(spark, polygons).withColumn("label", F.col("region") % 3)
    want = {r.region: r.area for r in A.union_area(df, "label").collect()}
    outline = O.materialise(O.outline(df, "label"))
    got = {r.region: r.area for r in P.measures(outline).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    again = {r.region: r.area for r in P.measures(O.outline(outline.withColumn("label", F.col("region")), "label")).collect()}
    assert all(abs(got[k] - again[k]) < 1e-8 for k in got)


def test_no_window_over_a_label(spark):
    """Windows are over an edge, a vertex, a row of cells or a piece; none holds all edges of a label."""
    df = table(spark, {i: [box(i, 0, i + 1.5, 1)] for i in range(30)}).withColumn("label", F.lit(1))
    cut, size = O.noded(O.oriented_edges(df, "label"))
    for part in (O._covers(cut, size), O._successors(O.boundary(O.oriented_edges(df, "label")))):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in part._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert "windowspecdefinition(label#" not in line or any(k in line for k in ("iy#", "x#", "y#"))


def test_pairs_stay_linear(spark):
    """Four times as many squares side by side give about four times the pairs of edges that are compared."""

    def pairs(n):
        df = table(spark, {i: [box(i % 40, i // 40, i % 40 + 1.25, i // 40 + 1.25)] for i in range(n)} | {-1: [box(-3, -3, 60, 60)]}).withColumn("label", F.lit(1))
        e = O.materialise(O.oriented_edges(df, "label").withColumn("id", F.monotonically_increasing_id()))
        cells = O.in_cells(e, O._cell_size(e)).groupBy("iy", "ix").count()
        return cells.agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    assert pairs(1600) < 6 * pairs(400)


def test_lines_cut_regions(spark):
    lines = spark.createDataFrame([(1, 0, -1.0, 2.0), (1, 1, 5.0, 2.0), (2, 0, 2.0, -1.0), (2, 1, 2.0, 1.0)], "line_id long, seq int, lon double, lat double")
    regions = table(spark, {1: [box(0, 0, 4, 4)], 2: [box(10, 10, 12, 12)], 3: [box(-1, 1.95, 0, 2.05)], 4: [box(-0.5, -3, 4.5, -2)]})
    got = {}
    for r in O.without_lines(regions, lines, "line_id", 0.1, 64).collect():
        got.setdefault((r.region, r.split_i), []).append(r.area)
    assert set(got) == {(1, 0), (1, 1), (2, -1), (4, -1)}
    # Line 2 ends inside the lower half of region 1: a slot with a round end, not a cut.
    slot = 0.2 * 1 + math.pi * 0.01 / 2
    assert abs(sum(got[1, 0]) - (4 * 1.9 - slot)) < 1e-4 and abs(sum(got[1, 1]) - 4 * 1.9) < 1e-9
    assert got[2, -1] == [4.0] and abs(sum(got[4, -1]) - 5.0) < 1e-9


def test_a_line_inside_leaves_a_hole(spark):
    lines = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 2.0, 1.0), (1, 2, 2.0, 2.0)], "line_id long, seq int, lon double, lat double")
    rows = O.without_lines(table(spark, {7: [box(0, 0, 3, 3)]}), lines, "line_id", 0.25, 64).collect()
    assert [r.split_i for r in rows] == [-1, -1] and sorted(r.area > 0 for r in rows) == [False, True]
    area = 2 * 0.5 + 0.25 * math.pi * 0.25 + 0.25 * 0.25 * (math.pi / 4 - 1)
    assert abs(sum(r.area for r in rows) - (9 - area)) < 2e-3


def test_rings_by_doubling(spark):
    rng = random.Random(5)
    ids = rng.sample(range(1000), 97)
    sizes, links, want, at = [1, 2, 3, 17, 74], [], {}, 0
    for n in sizes:
        ring = ids[at : at + n]
        at += n
        for i, x in enumerate(ring):
            links.append((x, ring[(i + 1) % n]))
            want[x] = (min(ring), (ring.index(min(ring)) - i) % n)
    got = {r.id: (r.ring, r.ahead) for r in O.ranked(spark.createDataFrame(links, "id long, next long")).collect()}
    assert got == want


def test_points_in_ranges_by_level(spark):
    rng = random.Random(6)
    ranges = [(i, a := rng.uniform(-50, 50), a + rng.choice([0, 1e-3, 0.2, 3, 400]) * rng.random()) for i in range(300)]
    points = [(i, rng.uniform(-60, 60)) for i in range(200)] + [(200 + i, r[1]) for i, r in enumerate(ranges[:20])]
    p = spark.createDataFrame(points, "p long, x double")
    placed = L.banded(spark.createDataFrame(ranges, "r long, lo double, hi double"), F.col("lo"), F.col("hi"))
    assert placed.count() <= 9 * len(ranges)
    met = L.at_point(p, "x", placed).where("x >= lo and x <= hi").select("p", "r").collect()
    want = sorted((i, r) for i, x in points for r, a, b in ranges if a <= x <= b)
    assert sorted(map(tuple, met)) == want and len(want) > 100


def test_one_long_range_costs_a_probe(spark):
    """An outlier does not change what the other ranges meet: the rows of the join grow by those of the outlier alone."""
    short = [(i, i * 0.1, i * 0.1 + 0.05) for i in range(500)]
    p = spark.createDataFrame([(i, i * 0.05) for i in range(1000)], "p long, x double")

    def met(ranges):
        return L.at_point(p, "x", L.banded(spark.createDataFrame(ranges, "r long, lo double, hi double"), F.col("lo"), F.col("hi"))).count()

    plain = met(short)
    assert plain < 2 * 1000 and met([*short, (900, -1e6, 1e6)]) <= plain + 1000


def star(rng, x, y, size):
    """A ring around a centre, its corners at random distances."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))
    return [(x + size * rng.uniform(0.4, 1) * math.cos(a), y + size * rng.uniform(0.4, 1) * math.sin(a)) for a in turns]


def clipped_area(rings, w, s, e, n):
    """Area of rings within a box, by cutting one side after the other."""
    total = 0.0
    for k, ring in enumerate(rings):
        for axis, bound, keep in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
            out = []
            for p, q in zip(ring, ring[1:] + ring[:1]):
                a, b = keep * (p[axis] - bound), keep * (q[axis] - bound)
                if a >= 0:
                    out.append(p)
                if (a > 0 > b) or (a < 0 < b):
                    t = a / (a - b)
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            ring = out
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
        total += -area if k else area
    return total


def test_shared_areas(spark):
    """Rectangles from a thousandth to twenty units across, polygons of all sizes with and without holes, each pair by itself."""
    rng = random.Random(11)
    polygons = {}
    for i in range(25):
        x, y, size = rng.uniform(0, 10), rng.uniform(0, 10), rng.choice([0.05, 0.5, 2, 8])
        ring = star(rng, x, y, size)
        polygons[i] = [ring[:: rng.choice([1, -1])]] + ([[(x + 0.1 * (a - x), y + 0.1 * (b - y)) for a, b in ring]] if i % 3 == 0 else [])
    rects = [(0, 0.0, 0.0, 10.0, 10.0), (1, -10.0, 4.0, 20.0, 4.001)]
    for i in range(2, 60):
        x, y, size = rng.uniform(0, 10), rng.uniform(0, 10), rng.choice([0.001, 0.1, 1, 5])
        rects.append((i, x, y, x + size * rng.uniform(0.2, 1), y + size * rng.uniform(0.2, 1)))
    got = P.overlaps(spark.createDataFrame(rects, "rect long, west double, south double, east double, north double"), P.edges(table(spark, polygons)))
    got = {(r.rect, r.region): r.shared for r in got.collect()}
    for rect, *bounds in rects:
        for region, rings in polygons.items():
            assert abs(got.pop((rect, region), 0.0) - clipped_area(rings, *bounds)) < 1e-9, (rect, region)
    assert not got


def test_pairs_of_a_fine_raster_stay_linear(spark):
    """A raster with twice the rows and columns has four times the cells, and twice as many that the border passes through."""

    def pairs(n):
        step = 8.0 / n
        cells = [(i * n + j, j * step, i * step, (j + 1) * step, (i + 1) * step) for i in range(n) for j in range(n)]
        rects = spark.createDataFrame(cells, "rect long, west double, south double, east double, north double")
        polygons = {1: [[(0.3, 0.2), (7.7, 0.9), (7.1, 7.6), (0.9, 7.2)]], 2: [box(-40, 3.01, 40, 3.02)], 3: [box(2.0, 2.0, 2.001, 2.001)]}
        return P.edges_in_rects(rects, P.edges(table(spark, polygons))).count()

    few, many = pairs(32), pairs(64)
    assert many < 2.6 * few and few < 32 * 40


def test_cover_of_points(spark):
    from marshlight.operators import cover as C

    rng = random.Random(12)
    polygons = {i: [star(rng, rng.uniform(0, 6), rng.uniform(0, 6), rng.choice([0.2, 1, 4]))] for i in range(20)}
    points = [(i, rng.uniform(-1, 7), rng.uniform(-1, 7)) for i in range(300)]

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) < x for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    edges = C.inside_left(P.edges(table(spark, polygons)), P.RING)
    got = {(r.point, r.region) for r in C.cover_at(spark.createDataFrame(points, "point long, px double, py double"), edges).collect()}
    assert got == {(i, k) for i, x, y in points for k, rings in polygons.items() if inside(rings[0], x, y)}


def test_copies_meet_once(spark, monkeypatch):
    """Forty copies of polygons and of cutting lines are one edge each before any edges meet, with the results of one copy."""
    seen = []
    split = O._split_points
    monkeypatch.setattr(O, "_split_points", lambda edges, size: seen.append(edges.count()) or split(edges, size))
    rng = random.Random(8)
    few = {i: [star(rng, rng.uniform(0, 4), rng.uniform(0, 4), 1)[:: rng.choice([1, -1])]] for i in range(12)}
    many = {100 * k + i: [rings[0][:: rng.choice([1, -1])]] for k in range(40) for i, rings in few.items()}
    one, forty = united(spark, few), united(spark, many)
    assert [[(pytest.approx(a, abs=1e-8), pytest.approx(n, abs=1e-8), c) for a, n, c in rings] for rings in one] == forty
    assert seen[0] == seen[1]
    lines = [(i, k, float(k), 0.3 * i + 0.2 * (k % 2)) for i in range(5) for k in range(4)]
    lines = [spark.createDataFrame([(100 * c + i, k, x, y) for c in range(n) for i, k, x, y in lines], "line_id long, seq int, lon double, lat double") for n in (1, 40)]
    cut = [sorted((r.region, r.split_i, round(r.area, 8), round(r.length, 8), r.corners) for r in O.without_lines(table(spark, few), x, "line_id", 0.05, 16).collect()) for x in lines]
    assert cut[0] == cut[1] and seen[2] == seen[3]


def test_pairs_follow_the_pieces(spark):
    """Where long edges are cut into short pieces, cells are as small as the pieces."""
    bars = {i: [box(i, 0, i + 0.5, 64)] for i in range(64)} | {100 + i: [box(0, i, 64, i + 0.5)] for i in range(64)}
    cut, size = O.noded(O.oriented_edges(table(spark, bars).withColumn("label", F.lit(1)), "label"))
    pieces = cut.count()
    from marshlight.operators.cover import in_cells

    pairs = in_cells(cut, size, ("ax", "ay", "bx", "by")).groupBy("iy", "ix").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert pieces > 20_000 and pairs < 40 * pieces


def test_area_of_a_union_against_strips(spark):
    """Area of a union from thin strips, each with its covered width at the middle."""
    rng = random.Random(5)
    polygons = {}
    for i in range(20):
        x, y = rng.uniform(0, 3), rng.uniform(0, 3)
        polygons[i] = [[(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for _ in range(3)]]
    polygons |= {100 + i: rings for i, rings in polygons.items()}
    got = A.union_area(table(spark, polygons).withColumn("label", F.lit(1)), "label").first().area
    total, n = 0.0, 4000
    for s in range(n):
        y = -2 + 7 * (s + 0.5) / n
        spans = []
        for (ring,) in polygons.values():
            xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1]) if (a[1] > y) != (b[1] > y))
            spans += zip(xs[::2], xs[1::2])
        reach = -math.inf
        for x0, x1 in sorted(spans):
            total += max(0.0, x1 - max(x0, reach)) * 7 / n
            reach = max(reach, x1)
    assert got == pytest.approx(total, rel=1e-4)
