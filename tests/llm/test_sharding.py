"""Histogram sort: law, order, slots; hot keys; awkward rows."""

import random
import sys
import zlib
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, documents, empty  # noqa: E402

from marshlight.llm import queries, sharding  # noqa: E402


def check(rows, shards, total_rows, slack):
    """Slots gapless, shards near even, order by (crc, id) kept across shards."""
    assert len(rows) == total_rows
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]
    even = sum(sizes) / shards
    assert all(abs(s - even) <= slack for s in sizes), (even, sizes)
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["text_crc32"], r["doc_id"] or 0) for r in ordered]
    assert keys == sorted(keys)


def test_even_shards_of_documents(spark):
    rng = random.Random(1)
    docs = documents(spark, [(k, "w" * rng.randrange(400)) for k in range(4000)])
    rows = sharding.shard_documents(docs, 7).collect()
    check(rows, 7, 4000, 500)
    for r in rows:
        text = r["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))


def test_one_text_in_a_third_of_the_rows_is_split(spark):
    docs = documents(spark, [(k, "hot text" if k % 3 == 0 else f"text {k}") for k in range(6000)])
    rows = sharding.shard_documents(docs, 10).collect()
    check(rows, 10, 6000, 120)
    assert len({r["shard"] for r in rows if r["text"] == "hot text"}) <= 5


def test_parts_within_shards_keep_slots_gapless(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(3000)])
    rows = sharding.shard_documents(docs, 4, rows_per_part=100).collect()
    check(rows, 4, 3000, 200)


def test_awkward_and_empty(spark):
    rows = sharding.shard_documents(awkward(spark), 3).collect()
    assert len(rows) == len(awkward_rows())
    assert {"rid", "part", "cell", "hi"} <= set(rows[0].asDict())
    assert all(r["size"] == 16 and r["text_crc32"] == 0 for r in rows if not r["text"])
    none = sharding.shard_documents(empty(spark), 3)
    assert none.count() == 0 and none.columns[-2:] == ["shard", "slot"]


def test_query(spark):
    df = queries.QUERIES["op10_histogram_shards"](spark, "/root/testdata/sf0.01")
    rows = df.collect()
    check(rows, 40, 1000, 34_000)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert df.where(F.col("law") != "bytes").count() == 0
