"""Calendar helpers as Column expressions (month labels, water years, dekads)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    return F.trunc(_col(c), "MM")


def next_month_start(c) -> Column:
    """First day after the month: the exclusive end of a monthly window."""
    return F.add_months(month_start(c), 1)


def days_in_month(c) -> Column:
    return F.dayofmonth(F.last_day(_col(c)))


def seconds_in_month(c) -> Column:
    return days_in_month(c) * F.lit(86400)


def water_year(c, start_month: int = 10) -> Column:
    """Year in which the season began: months before ``start_month`` belong to the previous one."""
    c = _col(c)
    return F.year(c) - (F.month(c) < start_month).cast("int")


def water_year_of(year, month, start_month: int = 7, label: str = "ending") -> Column:
    """Water year from year and 1-based month columns, named by its first or its last year."""
    # A season from January begins and ends in one year; any other ends in the year after it began.
    later = {"starting": 0, "ending": int(start_month != 1)}
    if label not in later:
        raise ValueError(f"no such water-year label: {label!r}")
    begun = _col(year).cast("int") - (_col(month).cast("int") < start_month).cast("int")
    return begun + F.lit(later[label])


def with_water_year(
    df: DataFrame,
    start_month: int = 7,
    label: str = "ending",
    year: str = "year",
    month: str = "month",
) -> DataFrame:
    """Add ``water_year``; months numbered 0..11 are recognised by their minimum and shifted.

    The minimum is an uncorrelated scalar subquery, so the rows themselves are not shuffled.
    """
    first = df.agg(F.min(month)).scalar()
    shifted = F.col(month) + F.when(first == 0, 1).otherwise(0)
    return df.withColumn("water_year", water_year_of(year, shifted, start_month, label))


def in_season(c, first: int, last: int) -> Column:
    """True for months first..last, inclusive, within one calendar year."""
    return F.month(_col(c)).between(first, last)


def dekad_days(c) -> Column:
    """Days of a ten-day period starting at ``c``, cut at the end of its month."""
    c = _col(c)
    return F.datediff(F.least(F.date_add(c, 10), next_month_start(c)), c)


def season_sin(month) -> Column:
    return F.sin(F.lit(2 * pi) * _col(month) / 12)


def season_cos(month) -> Column:
    return F.cos(F.lit(2 * pi) * _col(month) / 12)


def months_since(base: str, offset) -> Column:
    """Decode an integer 'months since base' offset to a date."""
    return F.add_months(F.lit(base).cast("date"), _col(offset).cast("int"))


def month_number_from(first_year, c) -> Column:
    """Running month number counted from January of ``first_year``."""
    c = _col(c)
    return (F.year(c) - _col(first_year)) * 12 + F.month(c)


def days_between(later, earlier) -> Column:
    """Interval in fractional days."""
    sec = lambda x: F.unix_micros(_col(x).cast("timestamp"))
    return (sec(later) - sec(earlier)) / F.lit(86400e6)


def month_spine(df: DataFrame, keys: list[str] = (), month: str = "month") -> DataFrame:
    """Every month between the first and the last one, per key: one row per key is exploded."""
    ends = df.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    return ends.select(
        *keys,
        F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(month),
    )
