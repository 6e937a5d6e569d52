"""Projection on lines: the closest place against all segments, and few boxes opened on very long lines."""

import math
import random

from pyspark.sql import functions as F

from marshlight.operators import channels as H

LINES = "line_id long, seq int, x double, y double"
POINTS = "line_id long, p long, px double, py double"


def walk(rng, n):
    """Vertices of a wandering line; some repeat."""
    x = y = a = 0.0
    out = []
    for _ in range(n):
        out.append((x, y))
        if rng.random() > 0.05:
            a += rng.uniform(-0.6, 0.6)
            x, y = x + math.cos(a) * rng.uniform(0.2, 3), y + math.sin(a) * rng.uniform(0.2, 3)
    return out


def closest(points, x, y):
    """(distance, chainage) of the first closest place."""
    best, s = (math.inf, 0.0), 0.0
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        d = math.hypot(bx - ax, by - ay)
        if d:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (d * d)))
            far = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            if far < best[0] - 1e-12:
                best = (far, s + t * d)
            s += d
    return best


def test_closest_places(spark):
    rng = random.Random(3)
    lines = {k: walk(rng, n) for k, n in enumerate([2, 16, 17, 18, 300, 5000])}
    points = []
    for k, line in lines.items():
        for i in range(25):
            x, y = rng.choice(line)
            points.append((k, 100 * k + i, x + rng.gauss(0, 5), y + rng.gauss(0, 5)))
    df = spark.createDataFrame([(k, i, float(x), float(y)) for k, line in lines.items() for i, (x, y) in enumerate(line)], LINES)
    got = {r.p: (r.distance, r.s_m) for r in H.project_on_lines(spark.createDataFrame(points, POINTS), df).collect()}
    for k, p, x, y in points:
        d, s = closest(lines[k], x, y)
        assert abs(got[p][0] - d) < 1e-9 and abs(got[p][1] - s) < 1e-6
    assert len(got) == len(points)


def test_few_boxes_on_a_long_line(spark):
    """A line sixteen times as long does not add boxes to a point in proportion: no product of points and segments."""

    def opened(n):
        line = spark.range(n).select(F.lit(1).cast("long").alias("line_id"), F.col("id").cast("int").alias("seq"), F.col("id").cast("double").alias("x"), (10 * F.sin(F.col("id") / 7)).alias("y"))
        seg = H.segments(line)
        points = spark.range(200).select(F.lit(1).cast("long").alias("line_id"), (F.col("id") * (n / 200.0)).alias("px"), (F.col("id") % 23 - 11.0).alias("py"))
        return H.near_boxes(points, H.materialise(seg), ["line_id"]).count()

    few, many = opened(2_000), opened(32_000)
    assert many < 1.5 * few and many < 200 * 6


def test_points_without_a_line(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0)], LINES)
    points = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 1, 1.0, 1.0), (2, 2, 0.0, 0.0)], POINTS)
    got = H.project_on_lines(points, df).select("p", "distance", "s_m").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 1.0)] * 2
