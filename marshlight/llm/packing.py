"""Documents packed into token sequences of one length.

Whole windows of a document are sequences of their own; what is left of it joins a pool. A full pool is
dealt to windows by multiway differencing (Karmarkar and Karp): each piece starts as a partial partition with one
filled window, the two partitions with the largest spread are merged, the fullest window of one with the
emptiest of the other, until one is left. Where a window then exceeds the capacity, the number of windows
rises and the pool is dealt again. The windows are near equal, each with a small gap; as documents may be cut,
whole windows' worth of gaps are filled with the pieces of the emptiest windows. The one window that stays
unfilled goes back to the pool, and at the end of a task it is cut into sequences whose lengths are powers of
two, which need no padding.

A task packs the rows that it reads, so nothing is shuffled, and holds one pool and one document.
"""

from __future__ import annotations

import bisect
import heapq
import sys
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_tokens import ByteTokens
from .common import Shared, pieces, text_or_empty, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Windows of a pool.
POOL = 128


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` by window, by multiway differencing; windows without any are left out."""
    # A partition: (load, members) of its filled windows, emptiest first; members are indices or pairs of members.
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count, load = len(heap), itemgetter(0)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = len(one) + len(two) - windows  # so many windows are filled in both
        if meet > 0:
            both = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(one[:meet], reversed(two[:meet]))]
            one = sorted(one[meet:] + two[meet:] + both, key=load)
        elif len(two) == 1:
            bisect.insort(one, two[0], key=load)
        else:
            one = sorted(one + two, key=load)
        spread = one[-1][0] - (one[0][0] if len(one) == windows else 0)
        heapq.heappush(heap, (-spread, count, one))
        count += 1
    return [_members(w[1]) for w in heap[0][2]] if heap else []


def _members(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        else:
            out.append(x)
    return out


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the sum needs, and more whenever one is exceeded."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differenced(sizes, windows)
        beyond = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in dealt)
        if not beyond:
            return dealt
        windows += max(1, beyond // capacity)


Piece = tuple[int, int, int]  # item, start in the item, length


def packed(sizes: list[int], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the one that is not full."""
    dealt = near_equal(sizes, capacity)
    loads = [sum(sizes[i] for i in w) for w in dealt]
    order = sorted(range(len(dealt)), key=lambda w: (-loads[w], w))
    full = [[(i, 0, sizes[i]) for i in dealt[w]] for w in order]
    loads = [loads[w] for w in order]
    keep = sum(sizes) // capacity
    spare = [p for w in full[keep:] for p in w][::-1]
    for window, load in zip(full[:keep], loads):
        gap = capacity - load
        while gap:
            i, start, length = spare.pop()
            window.append((i, start, min(gap, length)))
            if length > gap:
                spare.append((i, start + gap, length - gap))
            gap -= min(gap, length)
    return full[:keep], spare[::-1]


def by_powers(last: list[Piece], total: int) -> Iterator[list[Piece]]:
    """Pieces of ``total`` tokens as sequences whose lengths are the powers of two that add up to it."""
    left = last[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, out = total & (1 << bit), []
        while need:
            i, start, length = left.pop()
            out.append((i, start, min(need, length)))
            if length > need:
                left.append((i, start + need, length - need))
            need -= min(need, length)
        if out:
            yield out


class Packer:
    """Turns documents into pieces; ``take`` gives those that are ready."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: list[tuple] = []  # (row, ids, start of ids in the document, its tokens)
        self.pooled = 0
        self.out: list[tuple] = []  # (row, start, ids, tokens, sequence, offset)
        self.ready = 0

    def add(self, row: pa.Array, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(row, ids[start : start + self.capacity], start, len(ids))])
        if whole < len(ids):
            self.pool.append((row, ids[whole:], whole, len(ids)))
            self.pooled += len(ids) - whole
            if self.pooled >= POOL * self.capacity:
                self._pack()

    def _cut(self, part: Piece) -> tuple:
        row, ids, start, tokens = self.pool[part[0]]
        return row, ids[part[1] : part[1] + part[2]], start + part[1], tokens

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for row, ids, start, tokens in window:
            self.out.append((row, start, ids, tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.ready += offset

    def _pack(self) -> list[Piece]:
        full, last = packed([len(p[1]) for p in self.pool], self.capacity)
        for window in full:
            self._emit([self._cut(p) for p in window])
        self.pool = [self._cut(p) for p in last]
        self.pooled = sum(len(p[1]) for p in self.pool)

    def finish(self) -> None:
        self._pack()
        for window in by_powers([(i, 0, len(p[1])) for i, p in enumerate(self.pool)], self.pooled):
            self._emit([self._cut(p) for p in window])
        self.pool, self.pooled = [], 0

    def take(self, names: list[str]) -> pa.RecordBatch:
        rows, starts, ids, tokens, sequences, offsets = zip(*self.out)
        self.out, self.ready = [], 0
        whole = [starts, [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], tokens, sequences, offsets]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *(pa.array(v, k) for v, k in zip(whole, kinds))], names=names)


def _packing(shared: Shared, version: int, capacity: int, end_id: int | None, names: list[str]):
    def run(batches):
        held = worker_cache("byte_tokens")
        if held.get("version") != version:
            held.clear()
            held.update(version=version, tokens=ByteTokens(shared.value))
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for piece in pieces(batches):
            rows = piece.column("row")
            for i, ids in enumerate(held["tokens"].encode(piece.column("text"))):
                packer.add(rows.take(pa.array([i])), np.concatenate([ids, tail]))
            if packer.ready >= POOL * capacity:
                yield packer.take(names)
        packer.finish()
        if packer.out:
            yield packer.take(names)

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int | None = 0, keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the document's columns (``keep``), start, length, ids (little-endian, 4 bytes each), doc_tokens, sequence_id, offset.

    ``path`` is a file of the tokenizers library, read on the driver. A document's ids are those of its whole
    text and ``end_id``, which may be None. A null text is empty; an empty document is a piece of its end id, or
    no row without one. Repeated rows are packed each, with the same ids. A long text is encoded whole; its
    full windows leave at once. An empty table gives no rows. Input columns named like added ones are replaced.

    Sequences are numbered by task, so ``docs`` should be read from files or a written table, whose parts have the
    same rows in the same order whenever a task is run again. Every sequence is full, but for at most ten at
    the end of a task, whose lengths are powers of two.
    """
    added = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    fields = T.StructType.fromDDL(added)
    names = [c for c in (docs.columns if keep is None else keep) if c not in fields.names]
    inner = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row"), text_or_empty().alias("text"))
    schema = T.StructType([inner.schema["row"], *fields])
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared = Shared(docs.sparkSession, spec)
    out = inner.mapInArrow(_packing(shared, hash(spec), capacity, end_id, schema.names), schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *fields.names)
