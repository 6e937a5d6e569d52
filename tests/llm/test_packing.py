"""Packing: ids against the library, differencing against all partitions, every id in one piece, awkward rows."""

import itertools
import json
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, empty  # noqa: E402

from marshlight.llm import packing, queries  # noqa: E402
from marshlight.llm.byte_tokens import ByteTokens  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
CODER = ByteTokens(Path(PATH).read_text(encoding="utf-8"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_library():
    rng = random.Random(3)
    stock = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'l", "'v", "'VE", "s", "t", "re", "don't", "é", "ß", "1", "²", "!", "''", " '", "\xa0", "\x1c", "<|endoftext|>", "漢字", "👍", "́", "ⅷ", "ſ", "\r\n", "　", "\x85", "​"]
    texts = ["".join(rng.choice(stock) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(9)) for _ in range(3000)]
    texts += [None, "x" * 5000, " " * 3000]
    got = CODER.encode(pa.array(texts, pa.string()))
    assert all(list(g) == ids_of(t)[:-1] for g, t in zip(got, texts))


def test_every_token_is_its_own_encoding():
    """Merging by rank alone equals merging by rules where each token of the vocabulary encodes to itself."""
    assert CODER.ranked is not None
    texts = {i: t for t, i in LIBRARY.get_vocab().items() if t != "<|endoftext|>"}
    decoded = {i: LIBRARY.decoder.decode([t]) for i, t in texts.items()}
    whole = {i: t for i, t in decoded.items() if "\ufffd" not in t}
    assert len(whole) > 49_000
    coded = LIBRARY.encode_batch_fast(list(whole.values()), add_special_tokens=False)
    own = [CODER.ranked.encode_ordinary(t) for t in whole.values()]
    assert own == [[i] for i in whole]
    assert sum(e.ids != [i] for i, e in zip(whole, coded)) == sum(len(LIBRARY.pre_tokenizer.pre_tokenize_str(t)) > 1 for t in whole.values())


def test_files_without_ranks():
    """A vocabulary whose merges are not in the order of their ids is left to the library."""
    spec = json.loads(Path(PATH).read_text(encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    coder = ByteTokens(json.dumps(spec))
    assert coder.ranked is None
    library = tokenizers.Tokenizer.from_str(json.dumps(spec))
    texts = ["the other heron's reed", " 12  wörds\n"]
    assert [list(x) for x in coder.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 9))
def test_every_item_in_one_window(sizes, windows):
    dealt = packing.differenced(sizes, windows)
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes))) and len(dealt) <= windows


def test_differencing_is_near_the_best_partition():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(8)]
        best = min(
            max(loads) for deal in itertools.product(range(3), repeat=8) if (loads := [sum(s for s, d in zip(sizes, deal) if d == k) for k in range(3)])
        )
        assert max(sum(sizes[i] for i in w) for w in packing.differenced(sizes, 3)) <= best * 7 / 6 + 1
    sizes = [rng.randint(1, 1023) for _ in range(400)]
    loads = [sum(sizes[i] for i in w) for w in packing.differenced(sizes, 40)]
    assert max(loads) - min(loads) < 40


def test_two_windows_by_hand():
    # 8 and 7 differ by 1, 6 and 5 by 1, then 4: the classic example ends at 16 and 14.
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differenced([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_windows_rise():
    dealt = packing.near_equal([6, 6, 6], 10)
    assert len(dealt) == 3 and all(len(w) == 1 for w in dealt)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=60))
def test_full_windows_and_powers(sizes):
    full, last = packing.packed(sizes, 32)
    left = sum(n for _, _, n in last)
    assert len(full) == sum(sizes) // 32 and left < 32
    tail = list(packing.by_powers(last, left))
    loads = [sum(n for _, _, n in w) for w in full + tail]
    assert all(n == 32 for n in loads[: len(full)]) and all(n & (n - 1) == 0 for n in loads)
    covered = sorted((i, s, n) for w in full + tail for i, s, n in w)
    ends = dict.fromkeys(range(len(sizes)), 0)
    for i, start, length in covered:
        assert start == ends[i] and length > 0
        ends[i] += length
    assert ends == dict(enumerate(sizes))


def check(rows, texts):
    """Pieces cover each document once, sequences are gapless and need no padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc, held in by_doc.items():
        ids, at = np.array(ids_of(texts[doc]), "<u4"), 0
        for r in sorted(held, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    loads = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        loads.append(at)
    assert all(n <= 1024 and n & (n - 1) == 0 for n in loads)
    return loads


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    df = queries.QUERIES["op11_packing"](spark, SMALL)
    assert set(df.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    loads = check(df.collect(), texts)
    assert sum(n < 1024 for n in loads) <= 10


def test_awkward_rows(spark):
    out = packing.pack_documents(awkward(spark), PATH).collect()
    want = {}
    for row in awkward_rows():
        want.setdefault(row[0], []).append(len(ids_of(row[1])))
    got = {}
    for r in out:
        assert r["text_sha256"] == "x" and len(r["ids"]) == 4 * r["length"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {k: sum(v) for k, v in want.items()}
    assert packing.pack_documents(empty(spark), PATH).count() == 0
    plain = packing.pack_documents(awkward(spark), PATH, capacity=64, end_id=None, keep=["doc_id"])
    assert plain.where("doc_id in (4, 5)").count() == 0 and plain.agg({"length": "max"}).first()[0] == 64


def test_pools_of_a_task(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["river", "delta", "reed"]) for _ in range(rng.choice([5, 300, 2000]))) for i in range(400)}
    out = packing.pack_documents(spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1), PATH, keep=["doc_id"])
    loads = check(out.selectExpr("*", "crc32(ids) as ids_crc32").collect(), texts)
    assert len(loads) > 2 * packing.POOL and sum(n < 1024 for n in loads) <= 10
