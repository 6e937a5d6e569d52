"""Radix groups against a dictionary."""

import random
import re
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, documents, empty  # noqa: E402

from marshlight.llm import exact_dedup, queries  # noqa: E402


def groups(rows):
    by = defaultdict(list)
    for i, text in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    return by


def check(found, rows):
    assert len(found) == len(rows)
    by = groups(rows)
    stay = defaultdict(int)
    for r in found:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        ids = [i for i in by[body] if i is not None]
        assert r["group_size"] == len(by[body])
        assert r["keep_id"] == (min(ids) if ids else None)
        if r["kept"]:
            stay[body] += 1
            assert r["doc_id"] == r["keep_id"]
    assert stay == {b: 1 for b in by}


def test_against_a_dictionary(spark):
    rng = random.Random(3)
    stems = ["p" * n for n in (0, 1, 63, 64, 65, 255, 256, 320, 321, 1400)]
    rows = [(k, rng.choice(stems) + rng.choice(["", "a", "a ", "a\n", "b" * 70, "é"])) for k in range(400)]
    check(exact_dedup.exact_duplicates(documents(spark, rows)).collect(), rows)


def test_one_text_in_many_copies(spark):
    rows = [(k, "hot " * 500 if k % 3 else f"{k}") for k in range(3000)]
    check(exact_dedup.exact_duplicates(documents(spark, rows)).collect(), rows)


def test_awkward_and_empty(spark):
    found = exact_dedup.exact_duplicates(awkward(spark)).collect()
    check(found, [r[:2] for r in awkward_rows()])
    assert all(r["rid"] == "x" for r in found)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_query_equals_its_sql(spark, con):
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = queries.QUERIES["op6_exact_dedup"](spark, "/root/testdata/sf0.001").select(names).collect()
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op6_exact_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
