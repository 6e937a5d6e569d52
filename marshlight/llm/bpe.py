"""Byte-pair encoding and decoding with a public vocabulary file.

A text is split at special tokens, normalised (NFC, white space to one space, lower case by character)
and cut into words; each word's bytes are written as vocabulary characters, the last one with the word-end
mark. Merging keeps the symbols in a doubly linked list and the pairs that can merge in a priority queue
by rank and place: the best entry is taken, skipped when its symbols have changed since (stale), else the
two symbols become one and the two new neighbours enter the queue. Decoding concatenates the strings of the
vocabulary, with one space between tokens, as the file's empty decoder does.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, mapped, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries of each of a worker's caches; as many again are kept from before, so that frequent words stay.
CACHE_WORDS = 100_000


#: Separators that str.split takes for white space and the vocabulary's pattern may not.
_ODD = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Vocabulary:
    """What an encoder needs from a tokenizer file."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, merged id)
    special: dict[str, int]
    suffix: str
    split: str
    space: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        space = next(n["pattern"]["Regex"] for n in spec["normalizer"]["normalizers"] if n["type"] == "Replace")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return Vocabulary(ids, merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, model["end_of_word_suffix"] or "", split, space)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(rest.get(b, b)) for b in range(256)]


def merge(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbouring symbols by rank, the leftmost first among equals, until none can."""
    n = len(symbols)
    sym = list(symbols)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        if (hit := merges.get((sym[i], sym[i + 1]))) is not None:
            queue.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
    heapq.heapify(queue)
    while queue:
        _, i, a, b, new = heapq.heappop(queue)
        if sym[i] != a or (j := right[i]) >= n or sym[j] != b:
            continue  # stale
        sym[i], sym[j] = new, -1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            if (hit := merges.get((new, sym[after]))) is not None:
                heapq.heappush(queue, (hit[0], i, new, sym[after], hit[1]))
        if (before := left[i]) >= 0 and (hit := merges.get((sym[before], new))) is not None:
            heapq.heappush(queue, (hit[0], before, sym[before], new, hit[1]))
    return [s for s in sym if s >= 0]


def _joined(parts: list[tuple[str, int, str]]) -> tuple[str, int, str]:
    return " ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts])


class Kept:
    """A bounded cache in two generations: when the new one is full, it becomes the old one."""

    def __init__(self, make: Callable, size: int = CACHE_WORDS):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def get(self, key):
        if (hit := self.new.get(key)) is None:
            hit = self.old.get(key)
            if hit is None:
                hit = self.make(key)
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[key] = hit
        return hit


class Codec:
    """Encodes and decodes whole texts; runs of non-space characters and their words are kept once encoded."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        letters = byte_letters()
        self.inner = [v.ids.get(c) for c in letters]
        self.last = [v.ids.get(c + v.suffix) for c in letters]
        self.strings = {i: s for s, i in v.ids.items()} | {i: s for s, i in v.special.items()}
        self.split = regex.compile(v.split)
        self.space = regex.compile(v.space)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.chunks, self.words = Kept(self._chunk), Kept(self._word)

    def _word(self, word: str) -> tuple[str, int, str]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = merge([s for s in symbols if s is not None], self.vocabulary.merges)
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        words = self.split.findall(chunk)
        if len(words) == 1:
            return self.words.get(words[0])
        return _joined([self.words.get(w) for w in words])

    def chunks_of(self, text: str) -> list[str]:
        """The runs between white space of the text in NFC, lower-cased one character at a time (no final-letter rules)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        if _ODD.search(low):
            return self.space.sub(" ", low).split(" ")
        return low.split()

    def encode(self, text: str) -> tuple[str, int, str]:
        """(ids joined by a space, their number, the decoded text)."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append((str(self.vocabulary.special[part]), 1, part))
            else:
                held, get = self.chunks.new.get, self.chunks.get
                found += [hit for c in self.chunks_of(part) if (hit := held(c) or get(c))[1]]
        return _joined(found)

    def decode(self, ids: list[int]) -> str:
        """Strings of the vocabulary one after the other, a space between; an id that it lacks is left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


def _coder(path: str, shared: Shared):
    def make():
        held = worker_cache("bpe")
        if held.get("path") != path:
            held.clear()
            held.update(path=path, codec=Codec(shared.value))
        codec = held["codec"]

        def code(texts: pa.Array) -> list[pa.Array]:
            rows = [codec.encode(t) for t in texts.to_pylist()]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]

        return code

    return make


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Documents with ids (decimal, joined by one space), n_tokens and decoded (their text decoded again).

    The driver reads the vocabulary file and broadcasts it; its size does not depend on the documents. A
    null or empty text has no tokens. Repeated rows are encoded each. The ids are text, so that a row stays
    as compact as its document.
    """
    shared = Shared(docs.sparkSession, Vocabulary.load(path))
    return mapped(docs, _coder(path, shared), "ids string, n_tokens long, decoded string", keep)


def digests(encoded: DataFrame) -> DataFrame:
    """``encoded`` with SHA-256 of the ids and of the decoded text in place of both."""
    return encoded.withColumns(
        {"ids_sha256": F.sha2(F.col("ids").cast("binary"), 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}
    ).drop("ids", "decoded")
