"""Byte-pair encoding against the tokenizers library, and the round trip of its parts."""

import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, empty  # noqa: E402

from marshlight.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(bpe.Vocabulary.load(PATH))
TEXTS = [
    "", "  ", "<|startoftext|>Hello <|endoftext|>", "It's DON'T we'LL", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ﬁ ß", "a b c\x1cd\x85e", "x²½Ⅷ①", "日本語テキスト", "é Å ẛ̣",
    "👍🏽👨‍👩‍👧", "<|endoftext|", "\x00 \x01", "a<|endoftext|>b<|startoftext|><|endoftext|> c", "ab" * 5000, "🚀" * 300,
]


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), len(ids), LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    assert CODEC.encode(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cn", "Cs"]), max_size=60))
def test_as_the_library_on_any_latin_text(text):
    assert CODEC.encode(text) == library(text)


def test_cache_in_generations_changes_nothing():
    small = bpe.Codec(bpe.Vocabulary.load(PATH))
    small.chunks.size = small.words.size = 3
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    assert small.encode(text) == library(text) and len(small.chunks.new) <= 3


def test_stale_entries_are_skipped():
    # a b c: (b, c) merges first, so the queued (a, b) is stale.
    assert bpe.merge([0, 1, 2], {(0, 1): (5, 3), (1, 2): (1, 4)}) == [0, 4]
    assert bpe.merge([0, 0, 0], {(0, 0): (0, 1), (1, 0): (1, 2)}) == [2]
    assert bpe.merge([], {}) == []


def test_awkward_and_empty(spark):
    rows = bpe.encode_documents(awkward(spark), PATH).collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        assert (r["ids"], r["n_tokens"], r["decoded"]) == library(r["text"] or "") and r["rid"] == "x"
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
