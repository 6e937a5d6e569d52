"""The hidden Markov model: recursions against enumeration, whole query against dictionaries, probabilities adding up to one."""

import itertools
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, documents, empty, sentence, words_of  # noqa: E402

from marshlight.llm import hmm, queries  # noqa: E402
from marshlight.llm.common import Powers  # noqa: E402


def some_parameters(classes=5, states=3):
    rng = np.random.default_rng(2)
    one = lambda *shape: rng.random(shape) + 0.05
    start, step, emit = one(states), one(states, states), one(classes, states)
    return hmm.Parameters(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def by_paths(seq, p):
    """(likelihood, starts, transitions, classes) by going through all paths of states."""
    states = len(p.start)
    total, first, moves, seen = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros(p.emit.shape)
    for path in itertools.product(range(states), repeat=len(seq)):
        prob = p.start[path[0]] * np.prod([p.emit[c, s] for c, s in zip(seq, path)]) * np.prod([p.step[a, b] for a, b in zip(path, path[1:])])
        total += prob
        first[path[0]] += prob
        for a, b in zip(path, path[1:]):
            moves[a, b] += prob
        for c, s in zip(seq, path):
            seen[c, s] += prob
    return total, first / total, moves / total, seen / total


def test_recursions_against_all_paths():
    p = some_parameters()
    seqs = [[0], [1, 4, 2], [3, 3, 0, 1, 2, 4], [2, 2], [4, 0, 1, 3, 3]]
    flat, at = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    first, moves, seen, fit = hmm.expected_counts(flat, at, p)
    want = [by_paths(s, p) for s in seqs]
    assert np.allclose(first, sum(w[1] for w in want), atol=1e-4)
    assert np.allclose(moves, sum(w[2] for w in want), atol=1e-4)
    assert np.allclose(seen, sum(w[3] for w in want), atol=1e-4)
    assert fit == pytest.approx(sum(np.log(w[0]) for w in want), rel=1e-5)
    packed = hmm.Packed(flat, at)
    _, scale = hmm.forward(packed, p, p.emit[packed.classes])
    got = np.bincount(packed.order[packed.seq], np.log(scale))
    assert np.allclose(got, [np.log(w[0]) for w in want], rtol=1e-12)


def test_training_raises_the_likelihood(spark):
    rng = random.Random(1)
    docs = documents(spark, [(k, sentence(rng, 40) if k % 2 else " ".join(rng.choice("ab cd ef gh".split()) for _ in range(40))) for k in range(200)])
    words = hmm.count_words(docs)
    rows = hmm.F.struct("doc_id").alias("row"), hmm.F.col("doc_id").alias("rid"), hmm.F.lit(False).alias("held_out"), "text"
    kind = "row struct<doc_id:bigint>, rid long, held_out boolean, n_tokens long, classes array<int>, words array<long>, slots array<int>, times array<int>"
    seqs = docs.select(*rows).mapInArrow(hmm._encoder(spark.sparkContext.broadcast(words.frequent)), kind)
    params, fits = hmm.baum_welch(seqs, words, states=3, iterations=5)
    assert fits[-1] > fits[0] and all(b > a - 1e-3 * abs(a) for a, b in zip(fits, fits[1:]))
    assert np.allclose(params.emit.sum(axis=0), 1) and np.allclose(params.step.sum(axis=1), 1)


def base_of(texts, held):
    tokens = [[*words_of(t), "\n"] for t in texts]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return n, [(len(t), sum(count[w] > 0 for w in t), sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) for t in tokens]


@pytest.mark.parametrize("limit", [4, 1 << 18])
def test_base_and_counts_against_dictionaries(spark, limit):
    rng = random.Random(3)
    rows = [(k, sentence(rng, rng.randrange(60)) + f" rare{k % 90}") for k in range(400)]
    got = hmm.score_documents(documents(spark, rows), queries.id_remainder("doc_id", 7) == 2, iterations=2, limit=limit).collect()
    got = {r["doc_id"]: r for r in got}
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    n, want = base_of([t for _, t in rows], held)
    for (k, _), h, (size, known, base) in zip(rows, held, want):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, size, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-12) and r["score"] < 0


def test_word_probabilities_add_up_to_one(spark, monkeypatch):
    """Of all words of the training texts, the unknown word of every class, and the end, in a model of one state."""
    monkeypatch.setattr(hmm, "SLOTS", 16)
    rng = random.Random(5)
    rows = [(k, sentence(rng, 12)) for k in range(60)]
    vocabulary = sorted({w for _, t in rows for w in words_of(t)})
    spread: dict[int, str] = {}
    for k in range(5000):
        w = f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}?{chr(97 + k // 676 % 26)}q"
        spread.setdefault(int(hmm.read_words(pa.array([w]), Powers())[1][0]), w)
    assert len(spread) == 16
    asked = [*vocabulary, *spread.values(), ""]
    docs = documents(spark, rows + [(1000 + k, w) for k, w in enumerate(asked)])
    got = hmm.score_documents(docs, hmm.F.col("doc_id") >= 1000, states=1, iterations=1, limit=30).where("held_out").collect()
    assert {r["n_known"] for r in got} == {1, 2}
    end = next(10 ** r["score"] for r in got if r["n_tokens"] == 1)
    assert sum(10 ** r["score"] for r in got if r["n_tokens"] == 2) / end + end == pytest.approx(1, abs=1e-9)


def test_held_out_text_is_likelier_than_by_single_words(spark):
    rows = queries.QUERIES["op1_hidden_markov"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)


def test_awkward_and_empty(spark):
    got = hmm.score_documents(awkward(spark), queries.id_remainder("doc_id", 7) == 2, iterations=1).collect()
    rows = awkward_rows()
    assert len(got) == len(rows)
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    n, want = base_of([r[1] for r in rows], held)
    left = Counter((r[0], r[1], size, known, round(base, 6)) for r, (size, known, base) in zip(rows, want))
    assert left == Counter((r["doc_id"], r["text"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert all(np.isfinite(r["score"]) and r["train_tokens"] == n and r["rid"] == "x" for r in got)
    assert hmm.score_documents(empty(spark), hmm.F.lit(False)).count() == 0
    unseen = hmm.score_documents(documents(spark, [(1, "all is held out")]), hmm.F.lit(True), iterations=1).first()
    assert unseen["train_tokens"] == 0 and unseen["n_known"] == 0 and np.isfinite(unseen["score"])


def test_words_are_those_of_the_pattern():
    texts = ["Ab cd  ab\tx", None, "", " q", "É É \x1c", "a\vb\fc"]
    h, _, rows = hmm.read_words(pa.array(texts), Powers())
    assert np.diff(rows).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert h[0] == h[2] != h[1]
