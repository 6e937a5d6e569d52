"""Exact quantiles of groups of any size.

``percentile`` keeps all distinct values of a group in one task. Here a mergeable sketch first
brackets each wanted rank; the rows of the bracket are counted in ``CELLS`` equal cells of its range,
those below it as one; and only the values of the cells that hold the rank are put in order. The
result equals linear interpolation between order statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 4096
#: Quantiles that the sketch is asked for, and cells within the bracket between two of them.
GRID, CELLS = 256, 1024


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with a column per entry of ``probs``; nulls and NaN are left out.

    The sketch misses a rank by at most one part in ``accuracy``; the bracket reaches beyond that, and
    by two ranks, to the next of ``GRID`` quantiles on either side. A task orders the values of two
    cells at most, a thousandth of a bracket unless values crowd there. Should a rank fall outside its
    bracket the query fails instead of returning a neighbour.
    """
    gk = list(keys)
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*gk, number.alias("_v")).where(F.col("_v").isNotNull())
    sketch = rows.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("_total"), F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], accuracy).alias("_marks")
    )
    margin = 2 / F.col("_total") + 2.0 / accuracy
    mark = lambda share: F.get("_marks", F.least(F.lit(GRID), F.greatest(F.lit(0), share)).cast("int"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), mark(F.floor((p - margin) * GRID)).alias("lo"), mark(F.ceil((p + margin) * GRID)).alias("hi"),
                ((F.col("_total") - 1) * F.lit(p)).alias("pos"), (F.col("_total") - 1).alias("last"),
            )
            for name, p in probs.items()
        ]
    )
    if gk:
        tagged = rows.join(sketch.select(*gk, F.explode(wanted).alias("_w")), gk)
    else:
        tagged = rows.withColumn("_w", F.explode(sketch.select(wanted).scalar()))
    near = tagged.where(F.col("_v") <= F.col("_w.hi"))
    width = F.col("_w.hi") - F.col("_w.lo")
    share = F.try_divide(F.col("_v") - F.col("_w.lo"), width)
    place = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))) * CELLS)
    celled = near.withColumn("_cell", F.when(F.col("_v") < F.col("_w.lo"), -1).otherwise(place).cast("int"))
    counts = celled.groupBy(*gk, "_w", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*gk, "_w.name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    low = F.floor("_w.pos")
    high = F.least(low + 1, F.col("_w.last"))
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
    cells = counts.withColumn("_upto", F.sum("_n").over(order)).where((F.col("_cell") >= 0) & (holds(low) | holds(high)))
    here = cells.select(*gk, F.col("_w.name").alias("_name"), "_cell", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = celled.withColumn("_name", F.col("_w.name")).join(here, [*gk, "_name", "_cell"])
    values = inside.groupBy(*gk, "_w", "_cell", "_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
    rank = Window.partitionBy(*gk, "_w.name", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(rank))
    found = ranked.groupBy(*gk, F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos")).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b")
    )
    lost = F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")
    exact = F.when(F.col("_a").isNull() | F.col("_b").isNull(), lost).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    )
    return found.withColumn("_q", exact).groupBy(*gk).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs]
    )
