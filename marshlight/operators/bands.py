"""Widths of the bands on which ranges meet points by an equi-join.

Both sides of such a join compute the width for themselves, so it is made of minima, maxima and
counts only: these do not depend on the order in which rows are combined, as sums would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis_band(axis: DataFrame, coord: str) -> Column:
    """Scalar subquery: four mean steps of an axis, so that a band holds about four entries."""
    step = (F.max(coord) - F.min(coord)) / F.nullif(F.count(coord) - 1, F.lit(0))
    return axis.agg(F.coalesce(F.nullif(4 * step, F.lit(0.0)), F.lit(1.0))).scalar()
