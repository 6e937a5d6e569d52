"""Incremental form of the tile merge: new tile files are added as they arrive.

The batch merge keeps, for every date, the first file by name. A date that was merged keeps its file; each
micro-batch adds only dates that are new, with the same rule inside the batch. What was merged is one file
name per date in Spark's state store, and the stream is of file names: a batch reads the files that it adds, and
never the merged table or a file that it leaves out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import day_in_name
from ..sources.tiles import read_tiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tile_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """``(time, file, path)`` of new tile files, one row each; files without a date in their name are left out. No contents are read."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(day_in_name(name).alias("time"), name.alias("file"), "path").where("time is not null")


def _first_file(key: tuple, files: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The date's first file by name where the date is new; the state keeps which one it was."""
    if state.exists:
        return
    best = min((row for part in files for row in zip(part["file"], part["path"])), default=None)
    if best is not None:
        state.update((best[0],))
        yield pd.DataFrame({"time": [key[0]], "file": [best[0]], "path": [best[1]]})


def merge_feed(stream: DataFrame, schema: StructType | str, merged: str, checkpoint: str) -> StreamingQuery:
    """Append the new dates of every micro-batch to the merged table and stop when caught up.

    The driver sees the names of a batch's winning files, at most as many as the stream takes per batch. A batch that
    is replayed after a failure finds the state before it and writes to its own folder again, so it adds no
    duplicates.
    """

    def add(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]
        spark = batch.sparkSession
        if paths:
            read_tiles(spark, paths, schema).write.mode("overwrite").parquet(f"{merged}/batch={number}")

    winners = stream.groupBy("time").applyInPandasWithState(_first_file, "time date, file string, path string", "file string", "append", GroupStateTimeout.NoTimeout)
    return winners.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
