"""Repeated strings: sorting against sorted(), whole removal against a set of windows."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, documents, empty, sentence  # noqa: E402

from marshlight.llm import queries  # noqa: E402
from marshlight.llm import suffix_dedup as S  # noqa: E402


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=80).map(lambda b: b"ab" * 28 + b if len(b) % 3 else b), min_size=1, max_size=40))
def test_deep_shallow_order_and_prefixes(strings):
    strings = [s[:100] for s in strings]
    rows = np.zeros((len(strings), 100), np.uint8)
    for k, s in enumerate(strings):
        rows[k, :len(s)] = np.frombuffer(s, np.uint8)
    order, shared = S.deep_shallow(rows, np.array([len(s) for s in strings]))
    got = [strings[k] for k in order]
    assert got == sorted(strings)
    assert shared.tolist() == [0] + [prefix(a, b) for a, b in zip(got, got[1:])]


def brute(texts):
    """(bytes, removed, runs, what stays) of texts in order."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - S.LENGTH + 1):
            w = b[q:q + S.LENGTH]
            if w in seen:
                gone[q:q + S.LENGTH] = b"\x01" * S.LENGTH
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def check(spark, rows):
    got = {r["doc_id"]: r for r in S.remove_repeats(documents(spark, rows)).collect()}
    rows = sorted(rows)
    for (k, _), want in zip(rows, brute([t for _, t in rows])):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want, k
    assert len(got) == len(rows)


def test_copies_shared_passages_and_periodic_texts(spark):
    rng = random.Random(11)
    shared = [sentence(rng, 40) for _ in range(5)] + ["=" * 300, "ab" * 90, "é日本" * 40]
    rows = []
    for k in range(250):
        parts = [sentence(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a:a + rng.randrange(60, 400)], sentence(rng, rng.randrange(6))]
        rows.append((k, " ".join(parts)))
    rows += [(1000 + k, rows[k % 9][1]) for k in range(60)]
    check(spark, rows)


def test_frequent_strings_change_the_order_of_anchors_only(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "OFTEN", 2)
    rng = random.Random(12)
    passage = sentence(rng, 60)
    check(spark, [(k, sentence(rng, 20) + " " + passage + " " + sentence(rng, 20)) for k in range(120)])


def test_awkward_and_empty(spark):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = [(str(r[0]), r[1], *w) for r, w in zip(rows, brute([r[1] for r in rows]))]
    got = S.remove_repeats(awkward(spark)).collect()
    key = lambda r: (r[0], r[1] or "", r[2:])
    have = sorted(((str(r["doc_id"]), r["text"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=key)
    assert have == sorted(want, key=key)
    assert all(r["rid"] == "x" for r in got)
    assert S.remove_repeats(empty(spark)).count() == 0


def test_query(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    for (k, _), (size, gone, runs, stays) in zip(rows, brute([t for _, t in rows])):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, gone, runs, hashlib.sha256(stays).hexdigest())
