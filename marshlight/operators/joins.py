"""Alignment joins of series tables and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(tables: dict[str, DataFrame], on: str, value: str) -> DataFrame:
    """Outer-align many series on one key with a single shuffle.

    The tables are stacked in long form and pivoted with a known list of names, instead of one
    full join per table. Duplicate keys are averaged.
    """
    long = reduce(
        DataFrame.unionByName,
        [d.select(on, F.col(value).cast("double").alias("_v"), F.lit(n).alias("_n")) for n, d in tables.items()],
    )
    return long.groupBy(on).agg(*[F.avg(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in tables])


def with_missing_from(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """All of ``a`` and the rows of ``b`` whose key ``a`` lacks."""
    return a.unionByName(b.join(a.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)


def switch_at(a: DataFrame, b: DataFrame, year: str, last_year_of_a: int) -> DataFrame:
    """``a`` up to and including a year, ``b`` after it."""
    return a.where(F.col(year) <= last_year_of_a).unionByName(b.where(F.col(year) > last_year_of_a), allowMissingColumns=True)


def relabel(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Map a label through a short dictionary, keeping labels it lacks."""
    out: Column = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, new).otherwise(out)
    return df.withColumn(column, out)


def region_difference(series: DataFrame, left: list[str], right: list[str], weight: str | None = None, time: str = "time", region: str = "region", value: str = "value") -> DataFrame:
    """Weighted mean of one group of regions minus another's, per time, in one aggregate."""
    w = F.lit(1.0) if weight is None else F.col(weight)

    def mean(group: list[str]) -> Column:
        here = F.col(region).isin(*group) & F.col(value).isNotNull()
        return F.try_divide(F.sum(F.when(here, F.col(value) * w)), F.sum(F.when(here, w)))

    rows = series.where(F.col(region).isin(*left, *right))
    return rows.groupBy(time).agg(mean(left).alias("left"), mean(right).alias("right")).withColumn("difference", F.col("left") - F.col("right"))
