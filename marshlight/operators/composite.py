"""Composites over time: transitions, wetness, seasonal maps, lagged differences.

Two dates of one cell are brought together by one conditional aggregate on the cell, not by a
self-join: a single shuffle with map-side combine. Medians and modes are taken per cell over years,
so a group holds at most one value per year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..functions.raster import finite, transition_code

CELL = ["iy", "ix"]


def class_climatology(histogram: DataFrame, codes=(0, 1, 2, 3, 4), pixel_km2: float = 0.0009, time: str = "time") -> DataFrame:
    """Mean and sample standard deviation per calendar month of the area of exactly one class."""
    area = lambda c: F.col(f"class_{c}") * pixel_km2
    return histogram.groupBy(F.month(time).alias("month")).agg(
        *[F.avg(area(c)).alias(f"mean_{c}") for c in codes],
        *[F.stddev_samp(area(c)).alias(f"std_{c}") for c in codes],
    )


def transitions(classes: DataFrame, before: int, after: int) -> DataFrame:
    """Class pair code of two months of one year, for cells seen in both."""
    at = lambda m: F.max(F.when(F.col("month") == m, F.col("cls")))
    pair = (
        classes.where(F.col("month").isin(before, after))
        .groupBy("year", *CELL)
        .agg(at(before).alias("a"), at(after).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    return pair.select("year", *CELL, transition_code("a", "b").alias("code"))


def transition_histogram(codes: DataFrame, classes=(0, 1, 2, 3, 4), pixel_km2: float = 0.0009) -> DataFrame:
    """Pixels and area of every possible transition per year; absent ones are zero."""
    pairs = [a * 10 + b for a in classes for b in classes]
    wide = codes.groupBy("year").agg(*[F.count_if(F.col("code") == c).alias(str(c)) for c in pairs])
    long = wide.unpivot("year", [str(c) for c in pairs], "code", "pixels")
    return long.withColumn("code", F.col("code").cast("int")).withColumn("km2", F.col("pixels") * pixel_km2)


def modal_transition(codes: DataFrame) -> DataFrame:
    """Most frequent transition per cell over the years; ties take the smallest code."""
    return codes.groupBy(*CELL).agg(F.mode("code", True).alias("code"))


def transition_share(codes: DataFrame, code: int) -> DataFrame:
    return codes.groupBy(*CELL).agg(F.avg((F.col("code") == code).cast("double")).alias("share"))


def transition_area(codes: DataFrame, cell_area: DataFrame, code: int) -> DataFrame:
    """Area per year in which a transition holds; ``cell_area`` is ``(iy, ix, area_km2)``."""
    hit = F.when(F.col("code") == code, F.col("area_km2")).otherwise(0.0)
    return codes.join(cell_area, CELL).groupBy("year").agg(F.sum(hit).alias("km2"))


def wetness(grid: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Ever wet, wet count, and wet share of all snapshots (also those a cell is missing from)."""
    steps = grid.agg(F.count_distinct("time")).scalar()
    n = F.count_if(finite("value") >= threshold)
    out = grid.groupBy(*CELL).agg(n.alias("wet_count"))
    return out.withColumns(
        {"ever_wet": F.col("wet_count") > 0, "wet_frac": F.col("wet_count") / steps}
    )


def wet_year_share(values: DataFrame, valid: Column | None = None, wet: Column | None = None) -> DataFrame:
    """Share of valid years that are wet per cell.

    By default a year is wet when its mean is above zero and valid when it has data; a coded
    product passes its own ``valid`` and ``wet`` columns over ``value``.
    """
    yearly = values.groupBy("year", *CELL).agg(F.avg("value").alias("value"))
    ok = F.col("value").isNotNull() if valid is None else valid
    is_wet = (F.col("value") > 0) if wet is None else wet
    both = yearly.where(ok).groupBy(*CELL).agg(F.sum(is_wet.cast("int")).alias("w"), F.count(F.lit(1)).alias("n"))
    return both.select(*CELL, (F.col("w") / F.col("n")).alias("share"))


def share_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of two share maps, missing cells zero; zero differences are masked."""
    joined = a.withColumnRenamed("share", "a").join(b.withColumnRenamed("share", "b"), CELL, "full")
    diff = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return joined.select(*CELL, F.nullif(diff, F.lit(0.0)).alias("difference"))


def wet_months_per_year(values: DataFrame) -> DataFrame:
    """Months with a mean above zero in each year, 0..12."""
    monthly = values.groupBy("year", "month", *CELL).agg(F.avg("value").alias("m"))
    return monthly.groupBy("year", *CELL).agg(F.count_if(F.col("m") > 0).alias("wet_months"))


def mean_wet_months(values: DataFrame) -> DataFrame:
    """Mean number of wet months over all years of the record; years without data count as zero."""
    years = values.agg(F.count_distinct("year")).scalar()
    return wet_months_per_year(values).groupBy(*CELL).agg((F.sum("wet_months")).alias("total")).select(
        *CELL, (F.col("total") / years).alias("wet_months")
    )


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 only the first is wet, 2 both, 3 only the second; dry cells are left out."""
    j = a.select(*CELL, F.col("wet").alias("a")).join(b.select(*CELL, F.col("wet").alias("b")), CELL, "full")
    wa, wb = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    code = F.when(wa & wb, 2).when(wa, 1).when(wb, 3)
    return j.select(*CELL, code.alias("code")).where(F.col("code").isNotNull())


def period_change(values: DataFrame, early: tuple[int, int], late: tuple[int, int], months=(7, 8, 9)) -> DataFrame:
    """Late mean minus early mean per cell, where the early mean is exactly zero."""
    of = lambda p: F.avg(F.when(F.col("year").between(*p), F.col("value")))
    means = values.where(F.col("month").isin(*months)).groupBy(*CELL).agg(of(early).alias("early"), of(late).alias("late"))
    change = F.coalesce(F.col("late") - F.col("early"), F.lit(0.0))
    return means.where("early = 0").select(*CELL, "early", "late", change.alias("change"))


def yearly_difference(values: DataFrame, base_year: int) -> DataFrame:
    """Yearly mean minus the base year's mean, per cell; both come from one pass over the data."""
    yearly = values.groupBy("year", *CELL).agg(F.avg("value").alias("v"))
    base = yearly.where(F.col("year") == base_year).select(*CELL, F.col("v").alias("base"))
    return yearly.join(base, CELL).select("year", *CELL, (F.col("v") - F.col("base")).alias("difference"))


def product_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Yearly mean of one product minus that of another, per cell, where both have data."""
    of = lambda df, name: df.groupBy("year", *CELL).agg(F.avg("value").alias(name))
    both = of(a, "a").join(of(b, "b"), ["year", *CELL])
    return both.select("year", *CELL, (F.col("a") - F.col("b")).alias("difference")).where("difference is not null")


def median_composite(values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per-pixel median of the clear scenes of a period; a pixel sees few scenes per month."""
    return values.groupBy(*keys, *CELL).agg(*[F.median(n).alias(n) for n in names])


def masked_means(values: DataFrame, mask: DataFrame | None, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Mean per step, optionally over the cells of a mask only (``(iy, ix)`` rows)."""
    df = values if mask is None else values.join(mask.select(*CELL), CELL, "left_semi")
    return df.groupBy(*keys).agg((F.avg("value") * scale).alias("mean"))


def tile_means(values: DataFrame, west: float, south: float, step: float, keys: list[str]) -> DataFrame:
    """Mean per square tile counted from the corner of the box."""
    row = F.floor((F.col("lat") - south) / step).cast("int")
    col = F.floor((F.col("lon") - west) / step).cast("int")
    return values.groupBy(*keys, row.alias("row"), col.alias("col")).agg(F.avg("value").alias("mean"))


def _reduce(name: str, how: str) -> Column:
    if how not in ("mean", "median"):
        raise ValueError(f"unknown reducer: {how!r}")
    return F.avg(name) if how == "mean" else F.median(name)


def month_pair_composite(grid: DataFrame, month1: int, month2: int, reducer: str = "mean") -> DataFrame:
    """Mean or median over common years of (month2 - month1), per cell."""
    at = lambda m: F.avg(F.when(F.month("time") == m, F.col("value")))
    yearly = (
        grid.where(F.month("time").isin(month1, month2))
        .groupBy(F.year("time").alias("year"), *CELL)
        .agg(at(month1).alias("a"), at(month2).alias("b"))
    )
    diff = yearly.withColumn("d", F.col("b") - F.col("a"))
    return diff.groupBy(*CELL).agg(_reduce("d", reducer).alias("difference"), F.count("d").alias("years"))


def lagged_composite(grid: DataFrame, lag: int, max_gap_days: float | None = None, weight_by_dt: bool = False) -> DataFrame:
    """value(month) - value(month - lag) by calendar month of the later one, months 1..12 filled.

    Each monthly mean is sent to its own month as the later value and ``lag`` months ahead as the
    earlier one; one aggregate on (month, cell) pairs them.
    """
    monthly = grid.groupBy(month_start("time").alias("m"), *CELL).agg(F.avg("value").alias("v"))
    role = F.explode(
        F.array(
            F.struct(F.col("m").alias("at"), F.lit(1).alias("later")),
            F.struct(F.add_months("m", lag).alias("at"), F.lit(0).alias("later")),
        )
    ).alias("r")
    pick = lambda k: F.max(F.when(F.col("r.later") == k, F.col("v")))
    pairs = (
        monthly.select(*CELL, "v", role)
        .groupBy(F.col("r.at").alias("at"), *CELL)
        .agg(pick(1).alias("b"), pick(0).alias("a"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .withColumn("dt", F.datediff("at", F.add_months("at", -lag)).cast("double"))
    )
    if max_gap_days is not None:
        pairs = pairs.where(F.col("dt") <= max_gap_days)
    d = F.col("b") - F.col("a")
    mean = F.sum(d * F.col("dt")) / F.sum("dt") if weight_by_dt else F.avg(d)
    got = pairs.groupBy(F.month("at").alias("month"), *CELL).agg(
        mean.alias("diff_mean"), F.median(d).alias("diff_median"), F.count(F.lit(1)).alias("pairs")
    )
    return on_all_months(got, grid.select(*CELL).distinct(), {"pairs": 0})


def on_all_months(got: DataFrame, cells: DataFrame, zero: dict[str, int]) -> DataFrame:
    """Twelve rows per cell, with the given fillers."""
    spine = cells.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return spine.join(got, ["month", *CELL], "left").fillna(zero)


def season_by_year(series: DataFrame, value: str, months, how: str, date: str = "date") -> DataFrame:
    """Mean or maximum of the chosen months of each year."""
    agg = {"mean": F.avg, "max": F.max}[how]
    rows = series if months is None else series.where(F.month(date).isin(*months))
    return rows.groupBy(F.year(date).alias("year")).agg(agg(value).alias(value))


def by_calendar_month(series: DataFrame, value: str, keys: list[str] = (), date: str = "date") -> DataFrame:
    """Mean per calendar month over all years, months 1..12 present."""
    keys = list(keys)
    got = series.groupBy(*keys, F.month(date).alias("month")).agg(F.avg(value).alias(value))
    twelve = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    spine = got.select(*keys).distinct().select(*keys, twelve) if keys else got.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return spine.join(got, [*keys, "month"], "left")


def fuse_sensors(table: DataFrame, names: list[str], out: str) -> DataFrame:
    """Largest of several sensors, those without data left out."""
    return table.withColumn(out, F.greatest(*names))
