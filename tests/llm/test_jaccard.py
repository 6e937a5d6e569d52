"""The similarity join against all pairs."""

import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, documents, empty, sentence, words_of  # noqa: E402

from marshlight.llm import components, jaccard  # noqa: E402


def grams(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    """(class id, links, linked rows, copies) for each row, by comparing all pairs of sets."""
    members = defaultdict(list)
    for i, text in rows:
        members[grams(text)].append(i)
    sets = list(members)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = defaultdict(list)
    for k, a in enumerate(sets):
        for b in sets[:k]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[a].append(b)
                links[b].append(a)
                root[find(a)] = find(b)
    lowest = defaultdict(list)
    for s, ids in members.items():
        lowest[find(s)] += ids
    out = {}
    for s, ids in members.items():
        known = [i for i in lowest[find(s)] if i is not None]
        out[s] = (min(known) if known else None, len(links[s]), sum(len(members[b]) for b in links[s]), len(ids))
    return out


def check(found, rows, unclear=()):
    want = brute(rows)
    assert len(found) == len(rows)
    stay = defaultdict(int)
    for r in found:
        assert (r["class_id"], r["n_links"], r["n_linked"], r["n_copies"]) == want[grams(r["text"])], r["doc_id"]
        stay[r["class_id"], r["class_id"] in unclear and grams(r["text"])] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["class_id"]
    assert set(stay.values()) == {1}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(k, sentence(rng, rng.randrange(1, 90))) for k in range(150)]
    rows += [(1000 + k, edited(rng, rows[rng.randrange(100)][1], rng.randrange(4))) for k in range(150)]
    check(jaccard.similar_documents(documents(spark, rows)).collect(), rows)


def test_large_group_of_near_copies_over_several_blocks(spark, monkeypatch):
    rng = random.Random(6)
    stem = " ".join(f"w{k}" for k in range(120))
    rows = [(k, edited(rng, stem, 1 + k % 3)) for k in range(700)] + [(9000 + k, stem) for k in range(300)]
    check(jaccard.similar_documents(documents(spark, rows)).collect(), rows)


def test_awkward_and_empty(spark):
    found = jaccard.similar_documents(awkward(spark)).collect()
    check(found, [r[:2] for r in awkward_rows()], unclear=(None, 11))  # ids of more than one class
    assert jaccard.similar_documents(empty(spark)).count() == 0


def test_bands_reach_the_recall():
    rows, bands = jaccard.plan_bands(0.8)
    assert (1 - 0.8**rows) ** bands < 1e-5 and bands <= 40
    with pytest.raises(ValueError):
        jaccard.plan_bands(0.01, 1e-9, 3)


def test_linked_counts_in_pieces(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(30)]
    got = jaccard._linked(sets, np.zeros(30), False, (1, 2))
    for i in range(30):
        for j in range(30):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (i != j and 2 * len(a & b) >= len(a | b))


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(5, 5), (3, 1), (1, 3), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 60)} | {1: 1, 2: 1, 3: 1}
