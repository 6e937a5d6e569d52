"""Tile tables, catalogues, feature tables and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.raster import nan_to_null
from ..functions.text import canonical_name, day_in_name, month_in_name
from ..operators.grid import crop

# Fixed value: no-data marker of written rasters.
FILL = -9999.0


def read_tiles(spark: SparkSession, path: str | list[str], schema: StructType | str, monthly: bool = False) -> DataFrame:
    """Stack long-form tile files; the time of a file is the one in its name."""
    raw = spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    stamp = month_in_name(name) if monthly else day_in_name(name)
    kept = raw.drop("time", "file").select("*", name.alias("file"), stamp.alias("time"))
    return nan_to_null(kept, "value")


def stamp_tiles(tiles: DataFrame, monthly: bool = False) -> DataFrame:
    """The same for a table that already carries ``file``; rows of undated files are dropped."""
    stamp = month_in_name("file") if monthly else day_in_name("file")
    return tiles.withColumn("time", stamp).where(F.col("time").isNotNull())


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """One snapshot per date: of several files with one date, the first by name is kept whole.

    The winning file per date is a small partial aggregate, joined back on (time, file); no window
    over the cells is needed.
    """
    first = tiles.where(F.col("time").isNotNull()).groupBy("time").agg(F.min("file").alias("file"))
    return tiles.join(first, ["time", "file"])


def choose_variable(catalogue: DataFrame) -> DataFrame:
    """Best data variable per file from ``(file, grp, var, dims, is_numeric)``.

    Water and mask in the name count, two dimensions or time plus two count, coordinates lose;
    equal scores prefer the shallower group path, then the earlier entry.

    Only variables that can be chosen are kept, and they are dealt by file before the best is taken: texts are compared in
    sorted order, which a task that reads a large split would otherwise need for all of it.
    """
    canon = canonical_name("var")
    low = F.lower("var")
    n = F.size("dims")
    # What each property of a variable counts.
    points = (
        F.when(canon.contains("water"), 3).otherwise(0)
        + F.when(canon.contains("mask"), 2).otherwise(0)
        + F.when(n == 2, 3).otherwise(0)
        + F.when((n == 3) & F.exists("dims", lambda d: F.lower(d) == "time"), 2).otherwise(0)
        - F.when(low.isin("lat", "latitude", "y", "lon", "longitude", "x", "time"), 4).otherwise(0)
        + F.when(F.col("is_numeric"), 1).otherwise(0)
    )
    scored = catalogue.where(n > 0).withColumn("score", points).where("score >= 0").select("file", "grp", "var", "dims", "score", "entry").repartition("file")
    best = F.max_by(
        F.struct("grp", "var", "dims", "score"), F.struct(F.col("score"), -F.length("grp"), -F.col("entry"))
    )
    return scored.groupBy("file").agg(best.alias("b")).select("file", "b.*")


def resolve_name(names: DataFrame, wanted: str | None = None) -> DataFrame:
    """Variable per file that equals the wanted name, exactly or after normalisation.

    Without one, or with none wanted, a name with water or mask in it, else the first with two or
    three dimensions.
    """
    n = F.size("dims")
    canon = canonical_name("var")
    named = F.lit(False) if wanted is None else F.col("var") == wanted
    alike = F.lit(False) if wanted is None else canon == canonical_name(F.lit(wanted))
    rank = F.when(named, 0).when(alike, 1).when(canon.contains("water") | canon.contains("mask"), 2).when(n.isin(2, 3), 3)
    ranked = names.withColumn("rank", rank).where(F.col("rank").isNotNull()).select("file", "var", "rank", "entry").repartition("file")
    return ranked.groupBy("file").agg(F.min_by("var", F.struct("rank", "entry")).alias("var"))


def read_series_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV series with declared types; dates in ISO form."""
    return spark.read.csv(path, schema=schema, header=True)


def polygon_vertices(features: DataFrame, wkt: str = "wkt", key: str = "region") -> DataFrame:
    """Vertices of ``POLYGON`` and ``MULTIPOLYGON`` texts; undecodable geometries are dropped.

    Each ring and point is a split and a cast; a feature with any bad number yields nothing.
    """
    text = F.upper(F.trim(F.col(wkt).cast("string")))
    body = F.regexp_replace(text, r"^(MULTIPOLYGON|POLYGON)\s*\(+\s*|\s*\)+$", "")
    parts = F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")
    whole = features.where(text.rlike(r"^(MULTI)?POLYGON\s*\(\(.*\)\)$")).select(
        key, F.posexplode(parts).alias("part", "_p")
    )
    rings = whole.select(key, "part", F.posexplode(F.split("_p", r"\)\s*,\s*\(")).alias("ring", "_r"))
    points = rings.select(key, "part", "ring", F.posexplode(F.split("_r", r"\s*,\s*")).alias("seq", "_v"))
    number = lambda i: F.get(F.split(F.trim("_v"), r"\s+"), i).try_cast("double")
    points = points.select(key, "part", "ring", "seq", number(0).alias("lon"), number(1).alias("lat"))
    bad = points.where(F.col("lon").isNull() | F.col("lat").isNull()).select(key).distinct()
    return points.join(bad, key, "left_anti")


def write_series(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Tidy series sink."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_region_table(df: DataFrame, path: str, month: str = "month") -> None:
    """Region-by-month table, one folder per year so that later reads prune; regions of a year are dealt to 16 tasks."""
    out = df.withColumn("year", F.year(month))
    out.repartition("year", F.pmod(F.xxhash64("region"), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)


def write_cropped(grid: DataFrame, path: str, west: float, south: float, east: float, north: float) -> None:
    """Crop and write by year and month, single precision, missing cells as the fill value.

    Rows are clustered by the partition columns and the tile row, so a month is written by several
    tasks and a hot month is not one file.
    """
    out = crop(grid, west, south, east, north).select(
        F.year("time").alias("year"), F.month("time").alias("month"), "time", "iy", "ix", "lat", "lon",
        F.coalesce(F.col("value").cast("float"), F.lit(FILL).cast("float")).alias("value"),
    )
    out.repartition("year", "month", F.floor(F.col("iy") / 256)).sortWithinPartitions("year", "month", "iy", "ix").write.mode(
        "overwrite"
    ).partitionBy("year", "month").parquet(path)


def read_cropped(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("value", F.nullif(F.col("value"), F.lit(FILL).cast("float")).cast("double"))
