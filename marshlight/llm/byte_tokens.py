"""Ids of whole texts by a byte-level tokenizer file, word by word.

The words of a slice are found in numpy, as the pattern of byte-level files cuts them (contractions, letters,
numbers, other characters, white space, the middle three kinds with one space before them), and looked up in a
cache. New ones are merged by rank where the file's merges come in the order of the ids they make, as a rank then
says all that a merge does; otherwise by the file's own library. Texts that hold a special token, or a
character whose class may differ between Unicode tables, go to that library as they are.
"""

from __future__ import annotations

import array
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import tokenizers
from pyspark import cloudpickle

from .common import joined_bytes, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that a worker remembers, and the longest one of them in bytes.
CACHE_WORDS, CACHE_BYTES = 400_000, 64

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)


def _classes() -> np.ndarray:
    """The table of ``_class_table``, made once in a worker."""
    held = worker_cache("byte_classes")
    if "table" not in held:
        held["table"] = _class_table()
    return held["table"]


def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane; those beyond it, and those that tables disagree on, are unsure."""
    out = np.full(0x110000, _UNSURE, np.int8)
    out[:0xD800] = out[0xE000:0x10000] = _OTHER
    old = unicodedata.ucd_3_2_0
    plane = [*range(0xD800), *range(0xE000, 0x10000)]
    text = "".join(map(chr, plane))
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\p{White_Space}", _SPACE)):
        out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    first = {"L": _LETTER, "N": _NUMBER}
    for c in plane:
        category = old.category(chr(c))
        if category == "Cn" or (out[c] != _SPACE and first.get(category[0], _OTHER) != out[c]):
            out[c] = _UNSURE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B, 0x2028, 0x2029]] = _UNSURE
    return out


def word_starts(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; ``fresh`` marks the first one of each text."""
    n = len(points)
    kind = _classes()[points]
    run = fresh.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    inside = np.zeros(n, bool)  # the next code point belongs to the same text
    inside[:-1] = ~fresh[1:]
    turn = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & inside[:-1])
    start[turn] = True  # the last one of a run of white space stands alone, or with what follows
    start[turn[points[turn] == 0x20] + 1] = False
    # An apostrophe of its own with s, t, m, d, re, ve or ll behind it.
    quote = np.flatnonzero((points[:-1] == 0x27) & run[:-1] & run[1:] & inside[:-1] & start[:-1])
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & inside[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)], 0)
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        single = np.isin(one, [ord(c) for c in "stmd"])
        for hit, size in ((quote[single], 1), (quote[pair & ~single], 2)):
            start[hit + 1] = False
            after = hit + 1 + size
            start[after[after < n]] = True
    return start


def _ranked(model: dict) -> tiktoken.Encoding | None:
    """An encoder of single words by the ranks of their merges; None where these do not come in the order of the ids."""
    vocab, plain = model.get("vocab"), ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in plain):
        return None
    made = [vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    singles = {vocab.get(c) for c in byte_of}
    if any(a >= b for a, b in zip(made, made[1:])) or None in singles or singles | set(made) != set(vocab.values()):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def _as_bytes(words: pa.LargeStringArray) -> list[bytes]:
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    held = data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in zip(at, at[1:])]


class ByteTokens:
    """Encoder of texts by the contents of a tokenizer file, without its truncation, padding and added tokens."""

    def __init__(self, spec: str):
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        read = json.loads(spec)
        before = read.get("pre_tokenizer") or {}
        self.by_word = (
            read.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        self.ranked = _ranked(read["model"]) if self.by_word else None
        self.special = [t["content"] for t in read.get("added_tokens", [])]
        self.words: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        raw, offsets = joined_bytes(texts)
        if not self.by_word:
            return self._whole([t or "" for t in texts.to_pylist()])
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each code point
        bounds = np.searchsorted(at, offsets)
        odd = np.zeros(len(texts), bool)
        unsure = np.flatnonzero(_classes()[points] == _UNSURE)
        odd[np.searchsorted(bounds, unsure, "right") - 1] = True
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        fresh = np.zeros(len(points) + 1, bool)
        fresh[bounds] = True
        starts = np.flatnonzero(word_starts(points, fresh[:-1]))
        flat, ends = self._by_words(raw, np.append(at[starts], len(raw)), np.searchsorted(starts, bounds))
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        rest = np.flatnonzero(odd)
        if len(rest):
            for i, ids in zip(rest, self._whole(texts.take(pa.array(rest)).to_pylist())):
                out[i] = ids
        return out

    def _by_words(self, raw: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words between ``edges``, and the offsets in them of rows that hold words ``rows[i]`` to ``rows[i + 1]``."""
        words = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        distinct = _as_bytes(coded.dictionary)
        known = list(map(self.words.get, distinct))
        new = [i for i, ids in enumerate(known) if ids is None]
        fresh = [distinct[i].decode() for i in new]
        if self.ranked is not None:
            found = map(self.ranked.encode_ordinary, fresh)
        else:
            found = (e.ids for e in self.library.encode_batch_fast(fresh, add_special_tokens=False))
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
        for i, ids in zip(new, found):
            known[i] = array.array("I", ids).tobytes()
            if len(distinct[i]) <= CACHE_BYTES:
                self.words[distinct[i]] = known[i]
        flat = np.frombuffer(b"".join(known), np.uint32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        firsts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat[np.repeat(firsts[which] - ends[:-1], counts) + np.arange(ends[-1])], ends[rows]
