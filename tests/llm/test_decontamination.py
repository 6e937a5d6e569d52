"""Decontamination: alignment against a plain table, planted copies, awkward rows."""

import random
import re
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from cases import CLASHES, awkward, documents, empty, sentence  # noqa: E402

from marshlight.llm import decontamination as D  # noqa: E402


def plain(a, b):
    """Best score of a local alignment, from the whole table."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, last[j] + (D.MATCH if x == y else D.MISS), last[j + 1] + D.GAP, now[j] + D.GAP))
        best, last = max(best, *now), now
    return best


def test_alignment_against_the_whole_table():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 5, rng.integers(1, 14)).astype(np.uint32) for _ in range(200)]
    cuts = [rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint32) for _ in range(200)]
    score, start, end = D.align(items, cuts)
    for k, (a, b) in enumerate(zip(items, cuts)):
        assert score[k] == plain(a.tolist(), b.tolist())
        if score[k]:
            assert plain(a.tolist(), b[start[k]:end[k]].tolist()) == score[k]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def planted(rng):
    """Items, and documents that hold an item whole, edited, or not at all."""
    items = [(k, " ".join(f"{w}{rng.randrange(300)}" for w in sentence(rng, 30).split())) for k in range(12)]
    docs, truth = [], {}
    for k in range(300):
        fill = sentence(rng, rng.randrange(5, 200)).split()
        if k % 3 == 0:
            i, text = items[rng.randrange(len(items))]
            w = text.split()
            for _ in range(0 if k % 2 else 5):  # a paraphrase: some words changed, one lost, one added
                w[rng.randrange(len(w))] = "changed"
            if k % 2 == 0:
                del w[rng.randrange(len(w))]
                w.insert(rng.randrange(len(w)), "added")
            at = rng.randrange(len(fill))
            fill[at:at] = w
            truth[k] = i
        docs.append((k, " ".join(fill)))
    return items, docs, truth


def test_planted_and_paraphrased_items_are_found(spark):
    items, docs, truth = planted(random.Random(8))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(documents(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(truth.items())
    texts, by = dict(docs), dict(items)
    for r in got:
        a, b = words(by[r["item_id"]]), words(texts[r["doc_id"]])
        assert r["score"] == plain(a, b) / (D.MATCH * len(a))
        assert plain(a, b[r["word_start"]:r["word_end"]]) == plain(a, b)
    kept = {r["doc_id"] for r in D.clean(documents(spark, docs), bench).collect()}
    assert kept == {k for k, _ in docs} - set(truth)


def test_lone_edited_copies_against_the_whole_table_of_all_pairs(spark):
    """Every fourth to sixth word changed, alone in the corpus or beside a whole copy."""
    rng = random.Random(10)
    items, docs = [], []
    for k, size in enumerate(range(15, 60, 4)):
        for every in (4, 5, 6):
            i = len(items)
            w = [f"w{i}x{j}" for j in range(size)]
            items.append((i, " ".join(w)))
            edited = [f"new{i}x{j}" if j % every == every - 1 else x for j, x in enumerate(w)]
            docs.append((2 * i, " ".join([sentence(rng, 12), *edited, sentence(rng, 12)])))
            if k % 2:
                docs.append((2 * i + 1, f"{sentence(rng, 12)} {items[i][1]}"))
    want = {}
    for d, text in docs:
        for i, item in items:
            score = plain(words(item), words(text)) / (D.MATCH * len(words(item)))
            if score >= D.THRESHOLD:
                want[d, i] = score
    assert len(want) == len(docs)
    got = D.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_an_item_in_a_third_of_all_documents(spark):
    items, docs, _ = planted(random.Random(9))
    docs = [(k, items[0][1] + " " + t if k % 3 == 1 else t) for k, t in docs]
    got = D.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).where("item_id = 0").collect()
    assert {r["doc_id"] for r in got} >= {k for k, _ in docs if k % 3 == 1}


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    base = docs.where("doc_id = 1").first()["text"]
    items = [(1, base), (1, "other words of one id here"), (2, base), (3, None), (4, ""), (5, "two words"), (None, base)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = D.contaminated(docs, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert {(1, 1), (1, 2), (2, 1), (None, 1), (14, 2), (15, 1), (3, 1)} <= pairs
    assert not {i for _, i in pairs} - {1, 2} and not {d for d, _ in pairs} & {4, 5, 6, 7, 9, 12, 13}
    assert len(got) == len({(r["doc_id"], r["text_key"], r["item_id"]) for r in got})
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    assert {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 7, 9, 10, 11, 12, 13}
    assert kept.where("doc_id is null").count() == 2
    assert D.contaminated(empty(spark), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == docs.count()
