"""Cut a long lineage by writing a table to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_LIVE: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a folder in the warehouse.

    Both are places that the driver and all executors share.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_path(spark, path)
    return fs.exists(where)


def fresh_path(spark: SparkSession) -> str:
    """A new folder name below the shared folder, removed when the session's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    _LIVE.add(path)
    return path


def materialise_by(df: DataFrame, key: str) -> DataFrame:
    """The same, dealt into buckets of ``key``: joins on the key then leave these rows where they are.

    There are as many buckets as the session has shuffle partitions. The rows are shuffled once, here.
    """
    spark = df.sparkSession
    n, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"stage_{uuid.uuid4().hex}", fresh_path(spark)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._stage_path = path
    return out


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later passes prune columns and survive lost executors.

    The folder goes when ``release`` is called on the result, or else with the session.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(*stages: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for df in stages:
        release_paths(df.sparkSession, [df._stage_path])


def live_paths() -> set[str]:
    """Folders written by this process and not released yet."""
    return set(_LIVE)


def release_paths(spark: SparkSession, paths) -> None:
    for path in paths:
        fs, where = hadoop_path(spark, path)
        fs.delete(where, True)
        _LIVE.discard(path)
