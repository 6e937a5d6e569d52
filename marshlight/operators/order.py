"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import materialise


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank in a total order.

    Rows are range-partitioned by a sort and written once, so that partition numbers hold for both
    passes; ranks inside a partition are shifted by the sizes of the partitions before it.
    """
    placed = df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    placed = materialise(placed)
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(shift, "_p")
        .withColumn(name, F.col("_i") - F.col("_first") + F.col("_before") + 1)
        .drop("_p", "_i", "_first", "_before")
    )
