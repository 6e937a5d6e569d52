"""Ranges that points meet by an equi-join, each range at the level of its own length.

A range of length l lies in nine cells at most, of an eighth of 2^ceil(log2 l); a point lies in one cell of each level
that any range has. One very long range adds a level, hence one probe per point; it does not widen the
cells of the others or cut itself into many. A point meets a range in vain only within an eighth beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are smaller than the range by this power of two.
FINER = 3
#: Level of ranges without length, and the lowest one.
LOWEST = -30


def level_of(length: Column) -> Column:
    return F.greatest(F.coalesce(F.ceil(F.log2(F.nullif(length, F.lit(0.0)))), F.lit(LOWEST)), F.lit(LOWEST)).cast("int")


def cell_at(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def banded(ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each range with its ``level`` and each ``cell`` it lies in."""
    placed = ranges.withColumn("level", level_of(high - low) - FINER)
    level = F.col("level")
    return placed.withColumn("cell", F.explode(F.sequence(cell_at(low, level), cell_at(high, level))))


def at_point(points: DataFrame, at: str, ranges: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Points beside the ranges of the cells around them, which the caller still compares; ``ranges`` are ``banded``.

    A range meets a point at most once. The list of levels, some dozens of them at most, is a scalar subquery.
    """
    levels = ranges.agg(F.sort_array(F.collect_set("level"))).scalar()
    probes = points.withColumn("level", F.explode(levels))
    probes = probes.withColumn("cell", cell_at(F.col(at), F.col("level")))
    return probes.join(ranges, [*(on or []), "level", "cell"]).drop("level", "cell")
