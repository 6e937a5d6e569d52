"""Naming, splitting and dissolving of region polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlay as O
from . import polygons as P


def name_of(ident: Column, names: dict[int, str]) -> Column:
    """Name by id; ids without one stay null. The dictionary is written in the program."""
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(ident == key, name).otherwise(out)
    return out


def assemble_regions(polygons: DataFrame, names: dict[int, str], split_id: int, split_lon: float, parts: tuple[str, str]) -> DataFrame:
    """Named regions in which one basin is cut at a longitude into its west and east part.

    A basin to split that is not there simply yields no parts.
    """
    whole = polygons.where(F.col("region") != split_id).withColumn("name", name_of(F.col("region"), names))
    cut = P.split_at_longitude(polygons.where(F.col("region") == split_id), split_lon)
    cut = cut.withColumn("name", F.when(F.col("side") == "west", parts[0]).otherwise(parts[1])).drop("side")
    return whole.unionByName(cut)


def dissolve(polygons: DataFrame, label: str) -> DataFrame:
    """Regions with one label become one multi-part region; its area, overlaps once, is ``union_area``."""
    return polygons.select(
        F.col(label).alias("region"), F.struct("region", "part").alias("part"), "ring", "seq", "lon", "lat"
    )


def union_area(polygons: DataFrame, label: str) -> DataFrame:
    """Planar area ``(region, area)`` of the union of all polygons of a label, overlaps counted once.

    The sum over the edges of its outline, which need not be chained into rings for that.
    """
    around = O.boundary(O.oriented_edges(polygons, label))
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return around.groupBy(F.col("label").alias("region")).agg((F.sum(cross) / 2).alias("area"))


def edge_alignment(boxes: DataFrame, keys: list[str], edge: str = "east", tolerance: float = 1e-6) -> DataFrame:
    """Outermost edge of each group of rectangles, the spread of the edges, and whether they line up."""
    spread = F.max(edge) - F.min(edge)
    return boxes.groupBy(*keys).agg(F.max(edge).alias(edge), spread.alias("spread"), (spread <= tolerance).alias("aligned"))
