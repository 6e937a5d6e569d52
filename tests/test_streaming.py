"""The tile feed gives what the batch merge gives."""

import shutil

from pyspark.sql.types import DoubleType, IntegerType, StructType

from marshlight.sources import tiles as X
from marshlight.streaming import tile_feed as L

SCHEMA = StructType().add("iy", IntegerType()).add("ix", IntegerType())
for axis in ("lat", "lon", "value"):
    SCHEMA.add(axis, DoubleType())


def put(spark, folder, name, value):
    one = spark.createDataFrame([(0, 0, -19.0, 22.0, value), (0, 1, -19.0, 22.1, float("nan"))], SCHEMA)
    part = folder.parent / name
    one.coalesce(1).write.parquet(str(part))
    shutil.copy(next(part.glob("part-*.parquet")), folder / f"{name}.parquet")


def test_feed_equals_batch(spark, tmp_path):
    source, merged, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    put(spark, source, "a_20010105", 1.0)
    put(spark, source, "b_2001-01-05", 2.0)
    put(spark, source, "a_20019999", 3.0)
    L.merge_feed(L.tile_stream(spark, str(source)), SCHEMA, merged, mark).awaitTermination()
    put(spark, source, "c_20010105", 4.0)
    put(spark, source, "c_20010205", 5.0)
    L.merge_feed(L.tile_stream(spark, str(source)), SCHEMA, merged, mark).awaitTermination()
    got = {(str(r.time), r.ix, r.value) for r in spark.read.parquet(merged).collect()}
    want = {(str(r.time), r.ix, r.value) for r in X.merge_tiles(X.read_tiles(spark, str(source), SCHEMA)).collect()}
    assert got == want == {("2001-01-05", 0, 1.0), ("2001-01-05", 1, None), ("2001-02-05", 0, 5.0), ("2001-02-05", 1, None)}


def dates(spark, merged):
    return sorted((str(r.time), r.value) for r in spark.read.parquet(merged).where("ix = 0").collect())


def test_late_tiles_and_replays(spark, tmp_path):
    """A date that was merged keeps its file whatever comes later; a batch that runs again adds nothing twice."""
    source, merged, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    source.mkdir()
    feed = lambda: L.merge_feed(L.tile_stream(spark, str(source), 1), SCHEMA, merged, str(mark)).awaitTermination()
    put(spark, source, "m_20010105", 1.0)
    put(spark, source, "n_20010106", 2.0)
    put(spark, source, "undated", 9.0)
    feed()
    put(spark, source, "a_20010105", 3.0)
    put(spark, source, "b_20010107", 4.0)
    feed()
    want = [("2001-01-05", 1.0), ("2001-01-06", 2.0), ("2001-01-07", 4.0)]
    assert dates(spark, merged) == want
    commits = sorted((mark / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    spare = tmp_path / "spare"
    spare.mkdir()
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        shutil.move(f, spare / f.name)  # as if the driver had died before the last batch was marked done
    feed()
    assert dates(spark, merged) == want


def test_a_batch_reads_its_own_files_only(spark, tmp_path):
    """The merged table may be gone, or hold anything: later batches do not look at it."""
    source, mark = tmp_path / "in", str(tmp_path / "mark")
    source.mkdir()
    put(spark, source, "a_20010105", 1.0)
    L.merge_feed(L.tile_stream(spark, str(source)), SCHEMA, str(tmp_path / "one"), mark).awaitTermination()
    put(spark, source, "b_20010105", 2.0)
    put(spark, source, "b_20010106", 3.0)
    L.merge_feed(L.tile_stream(spark, str(source)), SCHEMA, str(tmp_path / "two"), mark).awaitTermination()
    assert dates(spark, str(tmp_path / "one")) == [("2001-01-05", 1.0)]
    assert dates(spark, str(tmp_path / "two")) == [("2001-01-06", 3.0)]
