"""Area-weighted and zonal statistics over masks, regions and basins.

Region sums use partial aggregation, so a region that holds most of the cells costs no more than
any other. Medians of whole regions go through the exact distributed quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions.calendar import month_spine, month_start
from ..functions.raster import finite
from .quantiles import exact_quantiles


def axes(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row axis ``(iy, lat)`` and column axis ``(ix, lon)``."""
    rows = grid.groupBy("iy").agg(F.first("lat").alias("lat"))
    cols = grid.groupBy("ix").agg(F.first("lon").alias("lon"))
    return rows, cols


def weighted_region_means(inside: DataFrame, mask: DataFrame, valid_only: bool = False) -> DataFrame:
    """cos-latitude mean per time and region of tagged cells ``(time, region, lat, value)``.

    Every cell of the mask ``(region, iy, ix, lat)`` stays in the denominator, with or without
    data, unless ``valid_only``. The full weight of a region does not depend on time and is summed
    from the mask once; the cells themselves meet no other table.
    """
    sums = _weighted_sums(inside, ["region"])
    if valid_only:
        return sums.select("time", "region", F.try_divide("_num", "_seen").alias("mean"))
    full = mask.groupBy("region").agg(F.sum(G.coslat("lat")).alias("_all"))
    return sums.join(full, "region").select("time", "region", (F.col("_num") / F.col("_all")).alias("mean"))


def weighted_mean(inside: DataFrame, mask: DataFrame, valid_only: bool = False) -> DataFrame:
    """The same over one unnamed mask ``(iy, ix, lat)``; its weight is a scalar subquery."""
    sums = _weighted_sums(inside, [])
    full = F.col("_seen") if valid_only else mask.agg(F.sum(G.coslat("lat"))).scalar()
    return sums.select("time", F.try_divide("_num", full).alias("mean"))


def _weighted_sums(inside: DataFrame, keys: list[str]) -> DataFrame:
    w = G.coslat("lat")
    return inside.groupBy("time", *keys).agg(
        # A step without one valid cell sums to zero, as a sum that skips nulls does.
        F.coalesce(F.sum(F.col("value") * w), F.lit(0.0)).alias("_num"),
        F.sum(F.when(F.col("value").isNotNull(), w)).alias("_seen"),
    )


def plain_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted mean and population standard deviation."""
    return cells.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def _cell_months(grid: DataFrame, cells: list[str]) -> DataFrame:
    """Every cell in every month between the first and the last of the whole grid."""
    ends = grid.agg(F.struct(F.min(month_start("time")).alias("a"), F.max(month_start("time")).alias("b"))).scalar()
    steps = F.explode(F.sequence(ends["a"], ends["b"], F.expr("interval 1 month")))
    return grid.select(*cells).distinct().withColumn("month", steps)


def monthly_mean(grid: DataFrame, cells: list[str] = ("iy", "ix")) -> DataFrame:
    """Monthly mean per cell; months without data are present as null."""
    cells = list(cells)
    means = grid.groupBy(month_start("time").alias("month"), *cells).agg(F.avg("value").alias("value"))
    return _cell_months(grid, cells).join(means, ["month", *cells], "left")


def monthly_sum(grid: DataFrame, cells: list[str] = ("iy", "ix")) -> DataFrame:
    """Monthly total per cell; months without data are zero."""
    cells = list(cells)
    sums = grid.groupBy(month_start("time").alias("month"), *cells).agg(F.sum("value").alias("value"))
    full = _cell_months(grid, cells).join(sums, ["month", *cells], "left")
    return full.withColumn("value", F.coalesce("value", F.lit(0.0)))


def zonal_monthly(tagged: DataFrame, how: str = "mean") -> DataFrame:
    """Mean or exact median of all cells of a region in a month."""
    df = tagged.select("region", month_start("time").alias("month"), "value")
    if how == "mean":
        return df.groupBy("region", "month").agg(F.avg("value").alias("value"))
    return exact_quantiles(df, ["region", "month"], "value", {"value": 0.5})


def zonal_volume(inside: DataFrame, mask: DataFrame) -> DataFrame:
    """Volume of a depth in mm over region cells, and the depth over the whole region.

    Tagged cells and mask both carry ``area_km2``: cells without data add nothing to the volume
    and stay in the area.
    """
    depth = F.coalesce("value", F.lit(0.0)) / 1e6 * F.col("area_km2")
    volume = inside.groupBy("time", "region").agg(F.sum(depth).alias("km3"))
    area = mask.groupBy("region").agg(F.sum("area_km2").alias("_area"))
    return volume.join(area, "region").select(
        "time", "region", "km3", (F.col("km3") * 1e6 / F.col("_area")).alias("mm")
    )


def wet_pixels(classes: DataFrame, keys: list[str]) -> DataFrame:
    return classes.groupBy(*keys).agg(F.count_if(F.col("cls") > 0).alias("wet"))


def class_histogram(classes: DataFrame, keys: list[str], codes=(0, 1, 2, 3, 4)) -> DataFrame:
    """One count column per class; absent classes are zero."""
    return classes.groupBy(*keys).agg(*[F.count_if(F.col("cls") == c).alias(f"class_{c}") for c in codes])


def threshold_series(
    histogram: DataFrame, thresholds=(0, 1, 2, 3), codes=(0, 1, 2, 3, 4), pixel_km2: float | None = 0.0009,
    rolling: int | None = None, month: str = "month",
) -> DataFrame:
    """Area of classes above each threshold on the complete month range, empty months zero."""
    full = month_spine(histogram, [], month).join(histogram, month, "left")
    scale = 1.0 if pixel_km2 is None else pixel_km2
    above = lambda t: sum((F.coalesce(F.col(f"class_{c}"), F.lit(0)) for c in codes if c > t), F.lit(0))
    out = full.select(month, *[(above(t) * scale).alias(f"above_{t}") for t in thresholds])
    if rolling:
        # One row per calendar month: the window is as long as the record, not as the data.
        back = Window.orderBy(month).rowsBetween(-(rolling - 1), 0)
        out = out.withColumns({f"above_{t}_roll": F.avg(f"above_{t}").over(back) for t in thresholds})
    return out


def wet_area(cells: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Area of the cells at or above the threshold; needs ``area_km2``."""
    hit = F.when(finite("value") >= threshold, F.col("area_km2")).otherwise(0.0)
    return cells.groupBy(*keys).agg(F.sum(hit).alias("km2"))


def top_by_mean(series: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """All rows of the ``n`` keys with the highest mean."""
    best = series.groupBy(key).agg(F.avg(value).alias("_m")).orderBy(F.desc("_m"), key).limit(n)
    return series.join(best.select(key), key, "left_semi")
