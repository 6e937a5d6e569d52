"""Motion of a flood front between two snapshots, and its monthly climatology."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions.calendar import days_between
from . import grid as O
from .composite import CELL, on_all_months
from .materialise import materialise
from .quantiles import exact_quantiles


def nearest_time(wanted: Column) -> Column:
    """Aggregate: the snapshot closest to a date; of two equally close ones the later."""
    gap = F.abs(days_between("time", wanted))
    return F.min_by("time", F.struct(gap, -F.unix_date(F.col("time").cast("date"))))


def nearest_pair(grid: DataFrame, t1: str, t2: str) -> DataFrame:
    """One row ``(t1, t2)``: the snapshots two dates resolve to; the same one twice is an error."""
    times = grid.select("time").distinct()
    at = lambda t: nearest_time(F.lit(t).cast("date"))
    pair = times.agg(at(t1).alias("t1"), at(t2).alias("t2"))
    same = F.raise_error(F.lit("both dates are nearest to one snapshot"))
    return pair.select(F.when(F.col("t1") == F.col("t2"), same.cast("date")).otherwise(F.col("t1")).alias("t1"), "t2")


def snapshot_pair(grid: DataFrame, t1: str, t2: str) -> DataFrame:
    """Both snapshots side by side per cell: ``(t1, t2, iy, ix, lat, lon, f1, f2)``."""
    pair = nearest_pair(grid, t1, t2).select(F.struct("t1", "t2").alias("p")).scalar()
    of = lambda n: F.max(F.when(F.col("time") == pair[n], F.col("value")))
    rows = grid.where((F.col("time") == pair["t1"]) | (F.col("time") == pair["t2"]))
    both = rows.groupBy(*CELL).agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"), of("t1").alias("f1"), of("t2").alias("f2"))
    return both.withColumns({"t1": pair["t1"], "t2": pair["t2"]})


def time_steps(grid: DataFrame, max_gap_days: float | None = None) -> DataFrame:
    """Adjacent snapshots ``(t1, t2, delta_days)``. One row per distinct time of the archive."""
    times = grid.select("time").distinct()
    steps = times.select(F.col("time").alias("t1"), F.lead("time").over(Window.orderBy("time")).alias("t2"))
    steps = steps.withColumn("delta_days", days_between("t2", "t1")).where("delta_days > 0")
    return steps if max_gap_days is None else steps.where(F.col("delta_days") <= max_gap_days)


def adjacent_pairs(grid: DataFrame, max_gap_days: float | None = None) -> DataFrame:
    """Every adjacent pair of snapshots side by side per cell.

    A snapshot is the first of one pair and the second of another: it meets both roles in one join
    with the short table of times, and both snapshots of a cell meet in one aggregate.
    """
    steps = time_steps(grid, max_gap_days)
    role = lambda time, k: steps.select(F.col(time).alias("time"), "t1", "t2", F.lit(k).alias("_k"))
    rows = grid.select("time", *CELL, "lat", "lon", "value").join(role("t1", 1).unionByName(role("t2", 2)), "time")
    of = lambda k: F.max(F.when(F.col("_k") == k, F.col("value")))
    return rows.groupBy("t1", "t2", *CELL).agg(
        F.max("lat").alias("lat"), F.max("lon").alias("lon"), of(1).alias("f1"), of(2).alias("f2")
    )


def front_velocity(
    pairs: DataFrame, grid: DataFrame, *, front_value: float | None = None, bandwidth: float = 0.05,
    grad_quantile: float = 0.90, smooth_px: int = 0, grad_eps: float = 1e-12, tile: int = O.TILE,
) -> DataFrame:
    """Front-normal velocity of every pair, in metres per day.

    The mid field's gradient gives the normal; the front is either the band around ``front_value``
    or the cells at or above the pair's exact gradient quantile, with vanishing gradients left out.
    ``grid`` supplies the axis limits. The stencil result is written once, because the quantile
    passes and the final projection all read it.
    """
    keys = ["t1", "t2"]
    tiles = O.tiled(pairs, 2 + smooth_px, keys, tile)
    tiles = O.box_smooth(tiles, keys, ["f1", "f2"], smooth_px)
    tiles = tiles.withColumn("f_mid", 0.5 * (F.col("f1") + F.col("f2")))
    tiles = O.gradients(tiles, keys, "f_mid", O.axis_limits(grid))
    field = O.untiled(tiles).select(
        *keys, *CELL, "lat", "lon", "f_mid", "df_dx", "df_dy",
        days_between("t2", "t1").alias("delta_days"),
        ((F.col("f2") - F.col("f1")) / days_between("t2", "t1")).alias("df_dt"),
        F.hypot("df_dx", "df_dy").alias("grad_mag"),
    )
    field = materialise(field)
    level = exact_quantiles(field, keys, "grad_mag", {"_edge": grad_quantile, "_mid": 0.5})
    scored = field.join(level, keys, "left")
    if front_value is not None:
        band = F.abs(F.col("f_mid") - front_value) <= bandwidth
    else:
        band = F.col("grad_mag") >= F.col("_edge")
    on = F.coalesce(band & (F.col("grad_mag") > F.col("_mid") * 1e-3), F.lit(False))
    steep = F.greatest(F.col("grad_mag"), F.lit(grad_eps))
    n_x, n_y, v = F.col("df_dx") / steep, F.col("df_dy") / steep, -F.col("df_dt") / steep
    only = lambda c: F.when(F.col("mask_front"), c)
    return scored.withColumn("mask_front", on).select(
        *keys, "delta_days", *CELL, "lat", "lon",
        only(v).alias("v_normal"), only(v * n_x).alias("u_perp"), only(v * n_y).alias("v_perp"),
        only(n_x).alias("n_x"), only(n_y).alias("n_y"), "grad_mag", "df_dt", "mask_front",
    )


def classify_direction(
    field: DataFrame, *, angle_tol_deg: float = 30.0, min_speed: float = 0.0, apex: tuple[float, float] | None = None,
) -> DataFrame:
    """Component along south-east and, with an apex ``(lat, lon)``, outward from it."""
    u, v, front = F.col("u_perp"), F.col("v_perp"), F.col("mask_front")
    speed = F.hypot(u, v)

    def against(ex: Column, ey: Column):
        along = u * ex + v * ey
        angle = G.angle_between_deg(along, speed)
        aligned = F.coalesce(front & (speed >= min_speed) & (angle <= angle_tol_deg), F.lit(False))
        return F.when(front, along), F.when(front, angle), aligned

    half = 1 / sqrt(2)
    along, angle, aligned = against(F.lit(half), F.lit(-half))
    out = {"v_SE": along, "angle_to_SE": angle, "aligned_SE": aligned}
    if apex is not None:
        dx, dy = G.east_offset_m("lat", "lon", apex[1]), G.north_offset_m("lat", apex[0])
        r = F.greatest(F.hypot(dx, dy), F.lit(1e-12))
        along, angle, aligned = against(dx / r, dy / r)
        out |= {"v_outward_apex": along, "angle_to_outward": angle, "aligned_outward": aligned}
    return field.withColumns(out)


def front_summary(classified: DataFrame) -> DataFrame:
    """Per pair: front cells, share aligned and the exact median component, per direction."""
    keys = ["t1", "t2"]
    outward = "aligned_outward" in classified.columns
    n = F.count_if("mask_front")
    pct = lambda c: 100.0 * F.count_if(c) / F.greatest(n, F.lit(1))
    aggs = [n.alias("front_pixels"), pct("aligned_SE").alias("pct_aligned_SE")]
    medians = {"v_SE": "median_v_SE"}
    if outward:
        aggs.append(pct("aligned_outward").alias("pct_aligned_outward"))
        medians["v_outward_apex"] = "median_v_outward"
    kept = [c for c in classified.columns if c in (*keys, "mask_front", "aligned_SE", "aligned_outward", *medians)]
    classified = materialise(classified.select(*kept))
    out = classified.groupBy(*keys).agg(*aggs)
    for column, name in medians.items():
        out = out.join(exact_quantiles(classified, keys, column, {name: 0.5}), keys, "left")
    return out


def velocity_climatology(field: DataFrame, cells: DataFrame, weight_by_dt: bool = False) -> DataFrame:
    """Mean front motion per calendar month (of the pair's midpoint) and cell, with pair counts."""
    micros = "unix_micros(cast({} as timestamp))".format
    middle = F.month(F.timestamp_micros(F.expr(f"({micros('t1')} + {micros('t2')}) div 2")))
    w = F.col("delta_days") if weight_by_dt else F.lit(1.0)
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w))
    got = (
        field.where(F.col("v_normal").isNotNull())
        .groupBy(middle.alias("month"), *CELL)
        .agg(
            mean("v_normal").alias("v_normal_mean"), mean("u_perp").alias("u_perp_mean"),
            mean("v_perp").alias("v_perp_mean"), F.count(F.lit(1)).alias("pairs_count"),
        )
    )
    return on_all_months(got, cells.select(*CELL).distinct(), {"pairs_count": 0})


def robust_limit(df: DataFrame, value: str, quantile: float = 0.98) -> DataFrame:
    """Symmetric plot limit: a high quantile of \\|x\\|, or its maximum, or 1 when both vanish."""
    size = df.select(F.abs(F.col(value)).alias("_x"))
    q = exact_quantiles(size, [], "_x", {"q": quantile}).scalar()
    top = size.agg(F.max("_x").alias("top"))
    return top.select(F.coalesce(F.when(q > 0, q), F.when(F.col("top") > 0, F.col("top")), F.lit(1.0)).alias("limit"))


def mean_field(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*CELL).agg(F.avg("value").alias("value"))


def mean_field_limits(grid: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Percentiles of the long-term mean field."""
    return exact_quantiles(mean_field(grid), [], "value", {"low": low, "high": high})
