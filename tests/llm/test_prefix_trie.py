"""The burst trie against plain counting of all prefixes, with containers of all sizes, and on awkward rows."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from marshlight.llm import prefix_trie, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def counted(conversations):
    """Node rows of {conv_id: [(role, text)]} by listing every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(held), len(p), min(members[p[:-1]]) if p else -1, len(held), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, held in members.items()
    )


def rows_of(df):
    assert df.columns == prefix_trie.NODE
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def table(spark, conversations):
    rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nodes(spark, conversations, limit):
    """Through the operator; conversations without turns come in as empty lists."""
    lists = prefix_trie.turn_lists(table(spark, conversations))
    bare = [c for c, turns in conversations.items() if not turns]
    if bare:
        lists = lists.unionByName(spark.createDataFrame([(c, []) for c in bare], lists.schema))
    return rows_of(prefix_trie.trie_nodes(lists, limit))


def branching(n=120):
    rng = random.Random(7)
    out = {}
    for c in range(n):
        out[c * 3 - 50] = [("user" if i % 2 == 0 else "assistant", rng.choice(["yes", "no", "é" * i, "why not"])) for i in range(rng.choice([0, 1, 2, 3, 6]))]
    return out


def combs():
    """Long shared openings, ends along them, a large group of equal conversations, and one long conversation alone."""
    long = [("user", f"turn {i}") for i in range(70)]
    out = {c: long[: 40 + c % 25] + [("assistant", str(c))] * (c % 3) for c in range(40)}
    out |= {100 + c: long[:8] for c in range(50)} | {200 + c: long for c in range(30)}
    return out | {300: [("user", "alone")] * 90}


@pytest.mark.parametrize("limit", [1, 30, 400, 10**6])
def test_containers_of_all_sizes(spark, limit):
    conversations = branching()
    assert nodes(spark, conversations, limit) == counted(conversations)


@pytest.mark.parametrize("limit", [1, 300])
def test_long_shared_openings(spark, limit):
    conversations = combs()
    assert nodes(spark, conversations, limit) == counted(conversations)


def test_lists_of_more_than_one_chunk(spark):
    conversations = {c: [("user", "same")] for c in range(0, 5000, 2)} | {c: [] for c in range(1, 40, 2)}
    assert nodes(spark, conversations, 10) == counted(conversations)


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_query_on_given_tables(spark):
    held = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        held[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    conversations = {c: [(role, text) for _, role, text in sorted(turns)] for c, turns in held.items()}
    assert rows_of(queries.QUERIES["op12_prefix_trie"](spark, SMALL)) == counted(rebuilt(conversations))


def test_openings(spark):
    rng = random.Random(3)
    conversations = {c: [("user", f"{c} {i}") for i in range(rng.randint(1, 9))] for c in [*range(0, 30), *range(100, 130)]} | {c: [("user", "lone")] for c in range(250, 260)}
    lists = prefix_trie.with_shared_openings(prefix_trie.turn_lists(table(spark, conversations)))
    want = rebuilt(conversations)
    assert {c: len(t) for c, t in lists.collect()} == {c: len(t) for c, t in want.items()} and any(not t for t in want.values())
    assert rows_of(prefix_trie.trie_nodes(lists, 20)) == counted(want)


def test_awkward_rows(spark):
    """Null turns come first, null role and text are empty, rows without conv_id are left out, repeated turns stay, other columns do no harm."""
    rows = [
        (1, 2, "user", None), (1, None, None, "first"), (1, 2, "user", None), (2, 5, "", "first"), (2, 9, "user", ""), (None, 1, "user", "nobody"),
        (3, 0, "user", "x" * 100_000), (-7, 0, "user", "x" * 100_000), (-7, 1, "us", "er1:"), (4, 0, "user", "us"), (4, 1, "use", "r"),
    ]
    extra = ", box string, up string, above string, path string, chars string, n string, first string, ends string, turns string, salt string, depth string"
    df = spark.createDataFrame([(*r, *["?"] * 11) for r in rows], SCHEMA + extra)
    want = counted({1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first"), ("user", "")], 3: [("user", "x" * 100_000)], -7: [("user", "x" * 100_000), ("us", "er1:")], 4: [("user", "us"), ("use", "r")]})
    for limit in (1, 1000):
        assert rows_of(prefix_trie.trie_nodes(prefix_trie.turn_lists(df), limit)) == want
    none = prefix_trie.turn_lists(df.where("false"))
    assert prefix_trie.trie_nodes(prefix_trie.with_shared_openings(none)).count() == 0
