"""Channels: densified lines, tangents, sampling of fields, nearest channel, motion along it.

Lines are vertex tables ``(line_id, seq, lon, lat)``. Lengths are chunked running sums and samples
are produced by the segment they lie on, so one very long line is spread over many tasks.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from .bands import axis_band
from .materialise import materialise
from .quantiles import exact_quantiles
from .sequence import positions, running_sums, with_neighbours, with_next

LINE = ["line_id"]


def local_zone(df: DataFrame, centre: str = "extent") -> Column:
    """Scalar subquery with the UTM zone and hemisphere of the middle of the data's extent, or of its mean coordinate."""
    middle = {"extent": lambda c: (F.min(c) + F.max(c)) / 2, "mean": F.avg}[centre]
    lat, lon = middle("lat"), middle("lon")
    return df.agg(F.struct(G.utm_zone(lon).alias("zone"), (lat < 0).alias("south"))).scalar()


def to_metres(df: DataFrame, zone: Column) -> DataFrame:
    """Add ``x``, ``y`` in the zone, and the zone itself for the way back."""
    df = df.withColumns({"zone": zone["zone"], "south": zone["south"]})
    x, y = G.utm_forward("lat", "lon", "zone", "south")
    return df.withColumns({"x": x, "y": y})


def to_degrees(df: DataFrame) -> DataFrame:
    lat, lon = G.utm_inverse("x", "y", "zone", "south")
    return df.withColumns({"lat": lat, "lon": lon})


def segments(lines: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Segments of non-zero length with their start and end chainage ``s0``, ``s1`` and ``length``."""
    at = with_next(positions(lines, keys, "seq"), keys, {"x2": "x", "y2": "y"}, wrap=False).where("x2 is not null")
    at = at.withColumn("d", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).where("d > 0")
    run = running_sums(at, keys, "pos", {"s1": "d"}, {"length": "d"})
    return run.withColumn("s0", F.greatest(F.col("s1") - F.col("d"), F.lit(0.0))).drop("n", "seq")


def densify(lines: DataFrame, step_m: float, keys: list[str] = LINE) -> DataFrame:
    """Equally spaced samples of projected lines: ``pos`` 0..n, chainage ``s_m``, ``x``, ``y``.

    n is the length over the step, rounded up. Each segment emits the samples on it, the last one
    also the end point; lines without length emit none.
    """
    seg = segments(lines, keys).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / step_m - 1e-9)))
    seg = seg.withColumn("ds", F.col("length") / F.col("n"))
    # The start index is the end index of the segment before it, from the same running sum.
    first = F.ceil((F.col("s1") - F.col("d")) / F.col("ds") - 1e-9)
    stop = F.when(F.col("is_last"), F.col("n")).otherwise(F.ceil(F.col("s1") / F.col("ds") - 1e-9) - 1)
    first = F.greatest(first, F.lit(0))
    out = seg.withColumn("pos", F.explode(F.when(stop >= first, F.sequence(first, stop)).otherwise(F.array().cast("array<bigint>"))))
    s = F.when(F.col("pos") == F.col("n"), F.col("length")).otherwise(F.col("pos") * F.col("ds"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - F.col("s0")) / F.col("d")))
    return out.withColumn("s_m", s).withColumns(
        {"x": F.col("x") + t * (F.col("x2") - F.col("x")), "y": F.col("y") + t * (F.col("y2") - F.col("y"))}
    ).drop("x2", "y2", "d", "s0", "s1", "ds", "is_last")


def tangents(samples: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Unit tangents: central inside, one-sided at the ends, null where the length vanishes."""
    near = with_neighbours(samples, keys, ["x", "y"])
    dx = F.coalesce("next_x", "x") - F.coalesce("prev_x", "x")
    dy = F.coalesce("next_y", "y") - F.coalesce("prev_y", "y")
    norm = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return near.withColumns({"tx": dx / norm, "ty": dy / norm}).drop("next_x", "next_y", "prev_x", "prev_y")


def orient_outward(samples: DataFrame, apex_lat: float, apex_lon: float, keys: list[str] = LINE) -> DataFrame:
    """Turn lines whose middle tangent points toward the apex.

    Positions and tangents turn; ``s_m`` stays with the position, as an unflipped chainage, while
    ``s_oriented_m`` follows the point.
    """
    ax, ay = G.utm_forward(F.lit(float(apex_lat)), F.lit(float(apex_lon)), "zone", "south")
    out = (F.col("x") - ax) * F.col("tx") + (F.col("y") - ay) * F.col("ty")
    middle = samples.where(F.col("pos") == F.floor((F.col("n") + 1) / 2)).select(*keys, (out < 0).alias("_flip"))
    joined = samples.join(middle, keys, "left").withColumn("_flip", F.coalesce("_flip", F.lit(False)))
    sign = F.when(F.col("_flip"), -1.0).otherwise(1.0)
    pos = F.when(F.col("_flip"), F.col("n") - F.col("pos")).otherwise(F.col("pos"))
    s = F.when(F.col("_flip"), F.col("length") - F.col("s_m")).otherwise(F.col("s_m"))
    return joined.withColumns(
        {"s_oriented_m": F.col("s_m"), "tx": F.col("tx") * sign, "ty": F.col("ty") * sign, "pos": pos, "s_m": s}
    ).withColumnRenamed("_flip", "flipped")


def channel_samples(lines: DataFrame, step_m: float, apex: tuple[float, float] | None = None, zone: Column | None = None) -> DataFrame:
    """Projected samples with tangents, oriented outward when an apex ``(lat, lon)`` is given."""
    metric = to_metres(lines, local_zone(lines) if zone is None else zone)
    samples = materialise(tangents(densify(metric, step_m)))
    return orient_outward(samples, *apex) if apex else samples


def _bracket(points: DataFrame, axis: DataFrame, index: str, coord: str) -> DataFrame:
    """Axis interval ``(c_i, c_i+1]`` that holds each point; points outside get none.

    A point on the lowest coordinate is outside.
    """
    band = axis_band(axis, coord)
    order = Window.orderBy(coord)
    pairs = axis.select(
        F.col(index).alias(f"{index}0"), F.lead(index).over(order).alias(f"{index}1"),
        F.col(coord).alias(f"{coord}0"), F.lead(coord).over(order).alias(f"{coord}1"),
    ).where(F.col(f"{index}1").isNotNull())
    band_of = lambda c: F.floor(c / band)
    pairs = pairs.withColumn("_band", F.explode(F.sequence(band_of(F.col(f"{coord}0")), band_of(F.col(f"{coord}1")))))
    p = points.withColumn("_band", band_of(F.col(coord)))
    return p.join(pairs, "_band").where((F.col(coord) > F.col(f"{coord}0")) & (F.col(coord) <= F.col(f"{coord}1"))).drop("_band")


def sample_field(points: DataFrame, field: DataFrame, ident: list[str], values: list[str], masks: list[str] = ()) -> DataFrame:
    """Bilinear values and nearest masks of a field ``(iy, ix, lat, lon, ...)`` at points.

    Outside the grid, or with any corner missing, a value is null and a mask false. The four
    corners of a point meet the field in one equi-join on the cell index.
    """
    masks = list(masks)
    rows = field.groupBy("iy").agg(F.max("lat").alias("lat"))
    cols = field.groupBy("ix").agg(F.max("lon").alias("lon"))
    at = _bracket(_bracket(points, rows, "iy", "lat"), cols, "ix", "lon")
    wy = (F.col("lat") - F.col("lat0")) / (F.col("lat1") - F.col("lat0"))
    wx = (F.col("lon") - F.col("lon0")) / (F.col("lon1") - F.col("lon0"))
    low_y = F.abs(F.col("lat") - F.col("lat0")) <= F.abs(F.col("lat1") - F.col("lat"))
    low_x = F.abs(F.col("lon") - F.col("lon0")) <= F.abs(F.col("lon1") - F.col("lon"))
    corner = lambda y, x: F.struct(
        F.col(f"iy{y}").alias("iy"), F.col(f"ix{x}").alias("ix"),
        ((wy if y else 1 - wy) * (wx if x else 1 - wx)).alias("w"),
        ((~low_y if y else low_y) & (~low_x if x else low_x)).alias("near"),
    )
    corners = at.select(*ident, F.explode(F.array(*[corner(y, x) for y in (0, 1) for x in (0, 1)])).alias("c"))
    corners = corners.select(*ident, "c.*").join(field.select("iy", "ix", *values, *masks), ["iy", "ix"])
    got = corners.groupBy(*ident).agg(
        *[F.when(F.count(v) == 4, F.sum(F.col(v) * F.col("w"))).alias(v) for v in values],
        *[F.max(F.col(m) & F.col("near")).alias(m) for m in masks],
    )
    out = points.join(got, ident, "left")
    return out.withColumns({m: F.coalesce(m, F.lit(False)) for m in masks}) if masks else out


def speed_along_channels(
    field: DataFrame, lines: DataFrame, *, step_m: float = 250.0, apex: tuple[float, float] | None = None,
    require_front: bool = True, min_speed: float = 0.0,
) -> DataFrame:
    """Front motion projected on the channel tangent at every sample."""
    # Written once: the inverse projection would otherwise be repeated in every derived condition.
    points = materialise(to_degrees(channel_samples(lines, step_m, apex)))
    got = sample_field(points, field, [*LINE, "pos"], ["u_perp", "v_perp"], ["mask_front"])
    along = F.col("u_perp") * F.col("tx") + F.col("v_perp") * F.col("ty")
    speed = F.hypot("u_perp", "v_perp")
    if require_front:
        along, speed = F.when(F.col("mask_front"), along), F.when(F.col("mask_front"), speed)
    if min_speed > 0:
        along = F.when(F.abs(along) >= min_speed, along)
    return got.withColumns({"speed_perp": speed, "v_along": along})


def reach_medians(samples: DataFrame) -> DataFrame:
    """Exact median speed per line."""
    return exact_quantiles(materialise(samples.select(*LINE, "v_along")), LINE, "v_along", {"v_along_median": 0.5})


def nearest_sample(points: DataFrame, samples: DataFrame, ident: list[str], carry: list[str], leaf_m: float) -> DataFrame:
    """Exact nearest sample of every point: adds ``distance`` and the carried sample columns.

    Points are grouped in square blocks, and a tree of occupied squares over the samples is
    descended for blocks, not points: a square stays a candidate only while its least distance is
    within the greatest distance of a better one. Rows compared at the end are those of the few
    remaining squares. Samples at one place count once (the smallest ``sid``). No distance limit
    is needed and none is applied.
    """
    unique = materialise(samples.groupBy("x", "y").agg(F.min_by(F.struct("sid", *carry), "sid").alias("_s")))
    e = unique.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if e[0] is None:
        raise ValueError("no valid channel samples")
    x0, y0, span = e[0], e[1], max(e[2] - e[0], e[3] - e[1], leaf_m)
    depth = max(1, ceil(log(span / leaf_m, 4) + 1e-9))
    square = lambda c, o, size: F.floor((F.col(c) - o) / size)
    leaves = unique.withColumns({"cx": square("x", x0, leaf_m), "cy": square("y", y0, leaf_m)})
    occupied = leaves.select("cx", "cy").distinct()
    placed = points.withColumns({"bx": square("x", x0, leaf_m), "by": square("y", y0, leaf_m)})
    blocks = placed.select("bx", "by").distinct()
    pair = F.explode(F.array(F.lit(0), F.lit(1)))
    near = blocks.withColumn("cx", pair).withColumn("cy", pair)
    best_per = Window.partitionBy("bx", "by")
    for level in range(depth, -1, -1):
        size = 4**level
        cells = occupied.select(
            F.floor(F.col("cx") / size).alias("_x"), F.floor(F.col("cy") / size).alias("_y")
        ).distinct()
        if level == depth:
            near = near.join(cells, (near.cx == cells._x) & (near.cy == cells._y)).select("bx", "by", "_x", "_y")
        else:
            kids = cells.withColumns({"cx": F.floor(F.col("_x") / 4), "cy": F.floor(F.col("_y") / 4)})
            near = near.join(kids, ["cx", "cy"]).select("bx", "by", "_x", "_y")
        # Squares and blocks are compared in units of one leaf.
        lo = lambda b, c: F.greatest(F.lit(0), F.col(c) * size - F.col(b) - 1, F.col(b) - (F.col(c) + 1) * size)
        hi = lambda b, c: F.greatest(F.abs((F.col(c) + 1) * size - F.col(b)), F.abs(F.col(b) + 1 - F.col(c) * size))
        least = lo("bx", "_x") ** 2 + lo("by", "_y") ** 2
        most = hi("bx", "_x") ** 2 + hi("by", "_y") ** 2
        near = near.withColumns({"_least": least, "_bound": F.min(most).over(best_per)}).where("_least <= _bound")
        near = near.select("bx", "by", F.col("_x").alias("cx"), F.col("_y").alias("cy"))
    pairs = placed.select(*ident, "bx", "by", F.col("x").alias("_px"), F.col("y").alias("_py")).join(near, ["bx", "by"]).join(leaves, ["cx", "cy"])
    d2 = (F.col("x") - F.col("_px")) ** 2 + (F.col("y") - F.col("_py")) ** 2
    best = pairs.groupBy(*ident).agg(F.min_by(F.struct(d2.alias("d2"), "_s"), F.struct(d2, F.col("_s.sid"))).alias("b"))
    best = best.select(*ident, F.sqrt("b.d2").alias("distance"), *[F.col(f"b._s.{c}").alias(c) for c in ["sid", *carry]])
    return points.join(best, ident, "left")


def parallel_to_channel(
    field: DataFrame, lines: DataFrame, *, step_m: float = 250.0, apex: tuple[float, float] | None = None,
    require_front: bool = True, max_distance_m: float | None = None,
) -> DataFrame:
    """Component of the front motion along the nearest channel, for every cell of the field."""
    zone = local_zone(field)
    samples = channel_samples(lines, step_m, apex, zone).where("tx is not null")
    samples = samples.withColumn("sid", F.struct("line_id", "pos"))
    ok = F.col("u_perp").isNotNull() & F.col("v_perp").isNotNull()
    ok = ok & F.col("mask_front") if require_front else ok
    cells = to_metres(field.where(ok), zone)
    if cells.isEmpty():
        raise ValueError("no cells to compute: check the front mask and the data")
    hit = nearest_sample(cells, samples, ["iy", "ix"], ["tx", "ty"], 4 * step_m)
    if max_distance_m is not None:
        hit = hit.where(F.col("distance") <= max_distance_m)
    v = F.col("u_perp") * F.col("tx") + F.col("v_perp") * F.col("ty")
    got = hit.select("iy", "ix", v.alias("v_parallel"), F.abs(v).alias("v_parallel_abs"), F.col("distance").alias("dist_to_channel_m"))
    return field.join(got, ["iy", "ix"], "left")


def points_at_fraction(lines: DataFrame, fraction: float, low: float = 0.01, high: float = 0.99, eps: float = 0.01, upright: bool = True, keys: list[str] = LINE) -> DataFrame:
    """Point at a fraction of each projected line, and the local direction in degrees."""
    f1 = max(low, min(high, fraction))
    f2 = min(0.99, f1 + eps)
    seg = segments(lines, keys)

    def at(f: float) -> tuple[Column, Column]:
        s = F.col("length") * f
        here = (s >= F.col("s0")) & (s <= F.col("s1"))
        t = (s - F.col("s0")) / F.col("d")
        pick = lambda a, b: F.min_by(F.when(here, F.col(a) + t * (F.col(b) - F.col(a))), F.when(here, F.col("pos")))
        return pick("x", "x2"), pick("y", "y2")

    (x1, y1), (x2, y2) = at(f1), at(f2)
    got = seg.groupBy(*keys).agg(x1.alias("x"), y1.alias("y"), x2.alias("_x2"), y2.alias("_y2"))
    angle = F.degrees(F.atan2(F.col("_y2") - F.col("y"), F.col("_x2") - F.col("x")))
    if upright:
        angle = F.when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)
    return got.withColumn("angle", angle).drop("_x2", "_y2")


#: Segments, or boxes, in one box of the next level.
FAN = 16


def _boxes(seg: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Boxes around ``FAN ** level`` segments in line, each with one place that is on the line."""
    x, x2, y, y2 = (F.col(c) for c in ("x", "x2", "y", "y2"))
    place = F.min_by(F.struct("x", "y"), "pos")
    return seg.groupBy(*keys, F.floor(F.col("pos") / FAN**level).alias("box")).agg(
        F.min(F.least(x, x2)).alias("w"), F.max(F.greatest(x, x2)).alias("e"), F.min(F.least(y, y2)).alias("s"), F.max(F.greatest(y, y2)).alias("n"), place.alias("on")
    )


def near_boxes(points: DataFrame, seg: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with each ``box`` of ``FAN`` segments of their line that may hold the closest place.

    Branch and bound from the largest boxes down: a box is no farther than the place on the line that it knows, and
    no nearer than its sides; boxes beyond the nearest known place of a point are left out, the others opened.
    """
    most = seg.agg(F.max("pos")).first()[0] or 0
    level = 1
    while FAN ** (level + 1) <= most:
        level += 1
    found = points.withColumn("_p", F.monotonically_increasing_id())
    found = materialise(found)
    px, py = F.col("px"), F.col("py")
    out = F.lit(0.0)
    dx, dy = F.greatest(F.col("w") - px, px - F.col("e"), out), F.greatest(F.col("s") - py, py - F.col("n"), out)
    mine = Window.partitionBy("_p")
    inner = [*points.columns, "_p"]
    for k in range(level, 0, -1):
        boxes = _boxes(seg, keys, k)
        if k == level:
            met = found.join(boxes, keys)
        else:
            boxes = boxes.withColumn("_up", F.floor(F.col("box") / FAN))
            met = found.withColumnRenamed("box", "_up").join(boxes, [*keys, "_up"]).drop("_up")
        met = met.withColumns({"_least": F.hypot(dx, dy), "_known": F.hypot(F.col("on.x") - px, F.col("on.y") - py)})
        met = met.withColumn("_best", F.min("_known").over(mine)).where(F.col("_least") <= F.col("_best") * (1 + 1e-12))
        found = met.select(*inner, "box")
    return found


def project_on_lines(points: DataFrame, lines: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Distance and chainage of the closest place on the line each point ``(keys, px, py)`` names; the first one of equals."""
    seg = materialise(segments(lines, keys))
    found = near_boxes(points, seg, keys)
    j = found.join(seg.withColumn("box", F.floor(F.col("pos") / FAN)), [*keys, "box"])
    ux, uy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x")) * ux + (F.col("py") - F.col("y")) * uy) / (F.col("d") * F.col("d"))))
    dist = F.hypot(F.col("px") - F.col("x") - t * ux, F.col("py") - F.col("y") - t * uy)
    others = [c for c in points.columns if c not in keys]
    best = F.min_by(F.struct(dist.alias("distance"), (F.col("s0") + t * F.col("d")).alias("s_m")), F.struct(dist, F.col("pos")))
    return j.groupBy("_p", *keys, *others).agg(best.alias("b")).select(*keys, *others, "b.*")


def longest_part(lines: DataFrame, key: str, part: str) -> DataFrame:
    """Vertices of the longest part of each multi-part line; equal lengths take the first part."""
    size = segments(lines, [key, part]).groupBy(key, part).agg(F.max("length").alias("length"))
    best = size.groupBy(key).agg(F.min_by(part, F.struct(-F.col("length"), F.col(part))).alias(part))
    return lines.join(best, [key, part])


def part_near_point(lines: DataFrame, points: DataFrame, key: str, part: str) -> DataFrame:
    """Vertices of the part closest to the point ``(key, px, py)`` of each line."""
    parts = lines.select(key, part).distinct().join(points, key)
    near = project_on_lines(parts, lines, [key, part])
    best = near.groupBy(key).agg(F.min_by(part, F.struct("distance", part)).alias(part))
    return lines.join(best, [key, part])
