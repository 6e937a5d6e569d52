"""Test items found in training documents: n-gram seeds, then Smith-Waterman alignment.

1. Items and documents are read as words without punctuation, in lower case; ``n`` words make an n-gram.
2. All n-grams of an item are its seeds, rare or frequent: which of them an edited copy keeps is not known.
3. Documents are scanned for seeds. A filter of fixed size decides what a scan puts out: for each hash slot
   the reach of its seeds to both ends of their items. Around a hit the document's words are cut out as
   far as that reach, neighbouring cuts as one.
4. Hits join the seeds on their hash; each document cut and item that share a seed are aligned by words:
   a match gives 2, a mismatch or a gap takes 1. The score is the best local alignment over that of a full
   copy. It is no more than the part of the item's words that the cut holds too, so pairs whose part is below
   the threshold are left out before they are aligned.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise
from .common import PUNCTUATION, U64, Powers, mixed, pieces, shingle_hashes, text_or_empty, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N = 3
THRESHOLD = 0.5
MATCH, MISS, GAP = 2, -1, -1
#: Slots of the scan filter: its size does not depend on the number of items.
SLOTS = 1 << 20
#: Words beyond an item's ends that insertions may push it, as a part of its length and at least.
SLACK, LEAST_SLACK = 0.25, 8
#: Cells of alignment tables that one numpy step holds.
CELLS = 1 << 20


def _words(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, powers, PUNCTUATION)


def _slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams & U64(SLOTS - 1)).astype(np.int64), (mixed(grams, 3) & U64(SLOTS - 1)).astype(np.int64)


def _item_grams(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in pieces(batches):
            words, rows = _words(batch.column("text"), powers)
            counts = np.diff(rows)
            enough = counts >= n
            grams, at = shingle_hashes(words, rows, n)
            many = np.diff(at) * enough
            take = np.repeat(enough, np.diff(at))
            grams = grams[take]
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(many) - many, many)
            a, b = _slots(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("item_id").to_numpy(zero_copy_only=False), many), pa.int64()), pa.array(grams.view(np.int64)),
                 pa.array(pos, pa.int32()), pa.array(np.repeat(counts, many), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                names=["item_id", "gram", "pos", "length", "slot_a", "slot_b"],
            )

    return run


def _filter(grams: DataFrame, spark):
    """Broadcast reach of the grams' slots: two arrays (left, right) for each of two slot hashes; 0 where none is."""
    slack = F.greatest(F.ceil(F.col("length") * SLACK), F.lit(LEAST_SLACK))
    left, right = F.col("pos") + slack, F.col("length") - F.col("pos") + slack
    out = np.zeros((2, 2, SLOTS), np.int32)
    for k, slot in enumerate(("slot_a", "slot_b")):
        for r in grams.groupBy(slot).agg(F.max(left).alias("l"), F.max(right).alias("r")).toLocalIterator():
            out[k, 0, r[slot]], out[k, 1, r[slot]] = r["l"], r["r"]
    return spark.sparkContext.broadcast(out)


def _hits(grams: np.ndarray, reach: np.ndarray) -> np.ndarray:
    a, b = _slots(grams)
    some = np.flatnonzero(reach[0, 0][a])
    return some[reach[1, 0][b[some]] > 0]


def _cutter(n: int, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, reach = Powers(), shared.value
        for batch in pieces(batches):
            words, rows = _words(batch.column("text"), powers)
            grams, at = shingle_hashes(words, rows, n)
            hit = _hits(grams, reach)
            if not len(hit):
                continue
            row = np.searchsorted(at, hit, "right") - 1
            first = rows[row] + hit - at[row]  # the gram's first word
            a, b = _slots(grams[hit])
            left = np.minimum(reach[0, 0][a], reach[1, 0][b])
            right = np.minimum(reach[0, 1][a], reach[1, 1][b])
            start, end = np.maximum(rows[row], first - left), np.minimum(rows[row + 1], first + right)
            order = np.argsort(start, kind="stable")
            start, end, hit, first, row = start[order], end[order], hit[order], first[order], row[order]
            reached = np.maximum.accumulate(end)
            new = np.ones(len(hit), bool)
            new[1:] = (start[1:] >= reached[:-1]) | (row[1:] != row[:-1])
            cut = np.flatnonzero(new)
            stops = np.append(cut[1:], len(hit))
            low, high = start[cut], reached[stops - 1]
            small = words.astype(np.uint32)
            ids = batch.column("doc_id").take(pa.array(row[cut]))
            keys = batch.column("text_key").take(pa.array(row[cut]))
            at_hits = np.append(cut, len(hit)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, keys, pa.array(low - rows[row[cut]], pa.int64()), pa.array([small[x:y].tobytes() for x, y in zip(low, high)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at_hits), pa.array(grams[hit].view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(at_hits), pa.array((first - np.repeat(low, stops - cut)).astype(np.int32)))],
                names=["doc_id", "text_key", "cut", "words", "grams", "places"],
            )

    return run


def align(items: list[np.ndarray], cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair of word arrays: its score, and the aligned part of the cut (start, end).

    All pairs advance together, one anti-diagonal of their tables at a time. Of equal scores the one that
    is met first stays.
    """
    count, m = len(items), max(map(len, items))
    w = max(map(len, cuts))
    a, b = np.full((count, m), -1, np.int64), np.full((count, w), -2, np.int64)
    for k, (x, y) in enumerate(zip(items, cuts)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    # Cell (i, j) ends with word i of the item and j of the cut; by diagonals i + j, indexed by i + 1.
    zero = np.zeros((count, m + 1), np.int32)
    before, last = zero.copy(), zero.copy()
    before_at, last_at = zero.copy(), zero.copy()
    best = np.zeros(count, np.int32)
    from_, to = np.zeros(count, np.int32), np.zeros(count, np.int32)
    each = np.arange(count)
    for d in range(m + w - 1):
        lo, hi = max(0, d - w + 1), min(m, d + 1)
        i = np.arange(lo, hi)
        j = d - i
        now, now_at = zero.copy(), zero.copy()
        same = a[:, lo:hi] == b[:, j]
        free = before[:, lo:hi] == 0
        diagonal = before[:, lo:hi] + np.where(same, MATCH, MISS)
        diagonal_at = np.where(free, j, before_at[:, lo:hi])
        up, up_at = last[:, lo:hi] + GAP, last_at[:, lo:hi]  # a word of the item is missing
        side, side_at = last[:, lo + 1 : hi + 1] + GAP, last_at[:, lo + 1 : hi + 1]
        value, where = diagonal, diagonal_at
        where = np.where(up > value, up_at, where)
        value = np.maximum(value, up)
        where = np.where(side > value, side_at, where)
        value = np.maximum(np.maximum(value, side), 0)
        now[:, lo + 1 : hi + 1], now_at[:, lo + 1 : hi + 1] = value, where
        top = value.argmax(axis=1)
        high = value[each, top]
        better = high > best
        best = np.where(better, high, best)
        from_ = np.where(better, where[each, top], from_)
        to = np.where(better, j[top] + 1, to)
        before, before_at, last, last_at = last, last_at, now, now_at
    return best, from_, to


def _aligner(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("item_words")]
            cuts = [np.frombuffer(x.as_buffer(), np.uint32)[lo:hi] for x, lo, hi in zip(
                batch.column("words"), batch.column("low").to_pylist(), batch.column("high").to_pylist())]
            able = [k for k, (x, y) in enumerate(zip(items, cuts)) if np.isin(x, y).mean() >= threshold]
            order = sorted(able, key=lambda k: (len(items[k]), len(cuts[k])))
            got = np.zeros((3, len(items)), np.int64)
            start = 0
            while start < len(order):
                stop, wide = start, 0
                while stop < len(order):
                    wide = max(wide, len(items[order[stop]]) + len(cuts[order[stop]]))
                    if stop > start and wide * (stop - start + 1) > CELLS:
                        break
                    stop += 1
                part = order[start:stop]
                got[:, part] = align([items[k] for k in part], [cuts[k] for k in part])
                start = stop
            cut = batch.column("cut").to_numpy() + batch.column("low").to_numpy()
            size = np.array([len(x) for x in items])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), batch.column("item_id"), pa.array(got[0] / (MATCH * size)),
                 pa.array(cut + got[1]), pa.array(cut + got[2])],
                names=["doc_id", "text_key", "item_id", "score", "word_start", "word_end"],
            )

    return run


def _item_words() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in pieces(batches):
            words, rows = _words(batch.column("text"), powers)
            small = words.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([small[x:y].tobytes() for x, y in zip(rows, rows[1:])], pa.binary())], names=["item_id", "item_words"]
            )

    return run


def text_key(col: str = "text"):
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(text_or_empty(col))


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, text_key, item_id) with score, word_start and word_end of the best alignment, where score >= threshold.

    From ``docs`` (doc_id, text) and ``items`` (item_id, text). Word positions count words without
    punctuation, the end exclusive. Null texts are empty. Items of fewer than ``n`` words have no seeds and
    match nothing, nor does an item without id; an id given to several items stands for each of them, the best
    counts. Repeated rows of a document give one pair. A null doc_id stays a null in its pairs.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    # One id may have several texts: the pair's own number keeps them apart until the end.
    items = materialise(items.distinct().select(F.xxhash64("item_id", "text").alias("item_no"), "item_id", "text"))
    named = items.select(F.col("item_no").alias("item_id"), "text")
    seeds = materialise(named.mapInArrow(_item_grams(n), "item_id long, gram long, pos int, length int, slot_a int, slot_b int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cutting = _cutter(n, _filter(seeds, spark))
    keyed = texts.select("doc_id", text_key().alias("text_key"), "text")
    cuts = materialise(
        keyed.mapInArrow(cutting, "doc_id long, text_key long, cut long, words binary, grams array<long>, places array<int>").dropDuplicates(["doc_id", "text_key", "cut"])
    )
    hits = cuts.select("doc_id", "text_key", "cut", F.explode(F.arrays_zip("grams", "places")).alias("h"))
    hits = hits.select("doc_id", "text_key", "cut", F.col("h.grams").alias("gram"), F.col("h.places").alias("place"))
    slack = F.greatest(F.ceil(F.col("length") * SLACK), F.lit(LEAST_SLACK))
    lined = hits.join(seeds.select("gram", "item_id", "pos", "length"), "gram").withColumn("line", F.col("place") - F.col("pos"))
    pairs = lined.groupBy("doc_id", "text_key", "cut", "item_id").agg(
        F.greatest(F.min(F.col("line") - slack), F.lit(0)).cast("int").alias("low"), F.max(F.col("line") + F.col("length") + slack).cast("int").alias("high")
    )
    words = named.mapInArrow(_item_words(), "item_id long, item_words binary")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "text_key", "cut")]
    ready = pairs.alias("p").join(cuts.alias("c"), same).join(words.alias("w"), F.col("p.item_id") == F.col("w.item_id"))
    ready = ready.select("p.doc_id", "p.text_key", "p.cut", "p.item_id", "low", "high", "words", "item_words")
    scored = ready.mapInArrow(_aligner(threshold), "doc_id long, text_key long, item_id long, score double, word_start long, word_end long")
    best = scored.where(F.col("score") >= threshold).withColumnRenamed("item_id", "item_no").join(items.select("item_no", "item_id"), "item_no")
    top = F.max(F.struct("score", (-F.col("word_start")).alias("s"), F.col("word_end").alias("e")))
    found = best.groupBy("doc_id", "text_key", "item_id").agg(top.alias("top"))
    return found.select("doc_id", "text_key", "item_id", F.col("top.score").alias("score"), (-F.col("top.s")).alias("word_start"), F.col("top.e").alias("word_end"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, as they are."""
    found = materialise(contaminated(docs, items, **options).select("doc_id", "text_key").distinct())
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (text_key("d.text") == F.col("f.text_key"))
    return docs.alias("d").join(found.alias("f"), same, "left_anti")
