"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood by scaled forward recursion.

Tokens are words (runs other than space and 0x09 to 0x0D, A-Z in lower case) and one end per document.
A latent state emits a class, the class emits the word:

    p(word | state) = p(class | state) * p(word | class).

Frequent words, each at least one part in ``limit`` of all training tokens, are a class of their own: at
most ``limit`` of them, whatever the corpus. The others share ``SLOTS`` classes by a hash of their first and
last two bytes. Tying rare words bounds the model that every task holds; p(word | class) comes from
the counts of all words, discounted in favour of words not met in training, and is added from a shuffle
on the words. Probabilities of all words of a class and of "an unknown word of this class" add up to 1.

Steps: (1) words counted over the training documents; (2) documents written as class sequences and,
for rare words, (word, number) pairs; (3) ``iterations`` of Baum-Welch: each partition runs the scaled
forward and backward recursions over its documents and gives expected counts of a size that depends on
the model only; they are added up across partitions and the parameters are estimated from all of
them; (4) rare pairs are shuffled by word in buckets of bounded size, where their counts meet; (5) forward
recursion over every document.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise, release
from .common import LOWER, U64, Powers, Rolling, Shared, joined_bytes, mixed, pieces, text_or_empty, word_bounds
from .jaccard import _groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES = 8
ITERATIONS = 5
#: Parts of all training tokens; a word of one part or more is a class of its own.
LIMIT = 1 << 18
#: Classes of the other words.
SLOTS = 1 << 13
#: Class of the end; slots follow, then frequent words.
END = 0
#: Tokens whose recursions are held at a time.
TOKENS = 1 << 20
#: Rare pairs that one shuffle bucket is meant to hold, and the least number of buckets.
PAIRS, LEAST_BUCKETS = 1 << 21, 16
#: Pseudo-count of a class in a state, spread like the class overall; and of a transition.
PRIOR, STAY = 20.0, 1.0


def read_words(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, slot) of each word, and the rows' offsets."""
    raw, offsets = joined_bytes(texts)
    raw = LOWER[raw]
    start, end, rows = word_bounds(raw, offsets)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int32), rows
    second, before = np.minimum(start + 1, end - 1), np.maximum(start, end - 2)
    sign = (raw[start].astype(U64) << U64(24)) | (raw[second].astype(U64) << U64(16)) | (raw[before].astype(U64) << U64(8)) | raw[end - 1]
    return Rolling(raw, powers).of(start, end), (mixed(sign) % U64(SLOTS)).astype(np.int32), rows


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words; folded together whenever those held have doubled."""
    powers = Powers()
    held = (np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    wait: list[tuple] = []
    size = 0

    def fold():
        h = np.concatenate([held[0], *[w[0] for w in wait]])
        s = np.concatenate([held[1], *[w[1] for w in wait]])
        n = np.concatenate([held[2], *[w[2] for w in wait]])
        values, first, back = np.unique(h, return_index=True, return_inverse=True)
        return values, s[first], np.bincount(back, n, len(values)).astype(np.int64)

    for batch in pieces(batches):
        h, s, _ = read_words(batch.column("text"), powers)
        values, first, times = np.unique(h, return_index=True, return_counts=True)
        wait.append((values, s[first], times))
        size += len(values)
        if size > 500_000 + len(held[0]):
            held, wait, size = fold(), [], 0
    held = fold()
    for a in range(0, len(held[0]), 100_000):
        part = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held[0][part].view(np.int64)), pa.array(held[1][part]), pa.array(held[2][part])], names=["word", "slot", "n"]
        )


@dataclass(frozen=True)
class Words:
    """Counts of the training words. ``frequent``: their hashes in order, with ``counts``; slots: tokens and kinds of the others."""

    tokens: int
    kinds: int
    ends: int
    frequent: np.ndarray
    counts: np.ndarray
    slot_tokens: np.ndarray
    slot_kinds: np.ndarray
    discount: float

    @property
    def classes(self) -> int:
        return 1 + SLOTS + len(self.frequent)


def count_words(training: DataFrame, limit: int = LIMIT) -> Words:
    """From (text). At most ``limit`` frequent words and the slots' sums reach the driver."""
    ends = training.count()
    counted = materialise(training.select("text").mapInArrow(_counter, "word long, slot int, n long").groupBy("word").agg(F.min("slot").alias("slot"), F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens = (total["n"] or 0) + ends
    least = max(1, -(-tokens // limit))
    top = counted.where(F.col("n") >= least).select("word", "n").collect()
    frequent = np.array([r["word"] for r in top], np.int64).view(U64)
    order = np.argsort(frequent)
    slots = counted.where(F.col("n") < least).groupBy("slot").agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")
    ).collect()
    slot_tokens, slot_kinds = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for r in slots:
        slot_tokens[r["slot"]], slot_kinds[r["slot"]] = r["n"], r["v"]
    once, twice = sum(r["once"] for r in slots), sum(r["twice"] for r in slots)
    release(counted)
    return Words(
        tokens, total["v"] + (1 if ends else 0), ends, frequent[order], np.array([r["n"] for r in top], np.int64)[order],
        slot_tokens, slot_kinds, min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5,
    )


def _encoder(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, frequent = Powers(), shared.value
        for batch in pieces(batches):
            h, slot, rows = read_words(batch.column("text"), powers)
            place = np.searchsorted(frequent, h)
            known = np.zeros(len(h), bool)
            if len(frequent):
                known = frequent[np.minimum(place, len(frequent) - 1)] == h
            word_class = np.where(known, 1 + SLOTS + place, 1 + slot).astype(np.int32)
            n = np.diff(rows)
            at = rows + np.arange(len(rows))  # with one end in each row
            classes = np.full(at[-1], END, np.int32)
            row = np.repeat(np.arange(len(n)), n)
            classes[np.arange(len(h)) + row] = word_class
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((h[rare], row[rare]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            pairs = order[first]
            ends = pa.array(np.searchsorted(row[pairs], np.arange(len(rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("rid"), batch.column("held_out"), pa.array(n + 1, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(classes)),
                 pa.ListArray.from_arrays(ends, pa.array(h[pairs].view(np.int64))),
                 pa.ListArray.from_arrays(ends, pa.array(slot[pairs])),
                 pa.ListArray.from_arrays(ends, pa.array(times))],
                names=["row", "rid", "held_out", "n_tokens", "classes", "words", "slots", "times"],
            )

    return run


@dataclass(frozen=True)
class Parameters:
    """Probabilities of the first state, of the next state, and of the class in a state (classes x states)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_guess(overall: np.ndarray, states: int) -> Parameters:
    """Classes as overall, tilted for each state by a fixed pseudo-random factor; states that rather stay."""
    c = len(overall)
    draws = mixed(np.arange(c * states, dtype=U64), 11).reshape(c, states) / 2.0**64
    emit = overall[:, None] * np.exp(2.0 * (draws - 0.5))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Parameters(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


class Packed:
    """Sequences by time: those that are still running at a step stand side by side, the longest first."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        sizes = np.diff(at)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-sizes, -np.arange(steps), "left")  # running at step t: size > t
        self.from_ = np.concatenate([[0], np.cumsum(self.live)])
        seq = np.arange(self.from_[-1]) - np.repeat(self.from_[:-1], self.live)
        time = np.repeat(np.arange(steps), self.live)
        self.classes = flat[at[:-1][self.order][seq] + time]
        self.seq = seq


def forward(p: Packed, params: Parameters, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and their scales, packed. ``emit``: of each packed token, by state."""
    alpha = np.empty_like(emit)
    scale = np.empty(len(emit), emit.dtype)
    step = params.step.astype(emit.dtype)
    last = None
    for t, n in enumerate(p.live):
        a, b = p.from_[t], p.from_[t + 1]
        now = alpha[a:b]
        if last is None:
            np.multiply(emit[a:b], params.start.astype(emit.dtype), out=now)
        else:
            np.matmul(last[:n], step, out=now)
            now *= emit[a:b]
        s = scale[a:b]
        now.sum(axis=1, out=s)
        now /= s[:, None]
        last = now
    return alpha, scale


def expected_counts(flat: np.ndarray, at: np.ndarray, params: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, transitions and classes (classes x states) of the sequences, and their log-likelihood."""
    p = Packed(flat, at)
    classes, states = params.emit.shape
    emit = params.emit.astype(np.float32)[p.classes]
    alpha, scale = forward(p, params, emit)
    moves = np.zeros((states, states))
    back_step = np.ascontiguousarray(params.step.T, np.float32)
    emit /= scale[:, None]
    beta = np.ones_like(alpha)
    for t in range(len(p.live) - 1, 0, -1):
        a, b = p.from_[t], p.from_[t + 1]
        n, c = p.live[t], p.from_[t - 1]
        after = emit[a:b]
        after *= beta[a:b]
        np.matmul(after, back_step, out=beta[c : c + n])
        moves += alpha[c : c + n].T @ after
    moves *= params.step
    gamma = alpha
    gamma *= beta
    first = gamma[: p.live[0]].sum(axis=0, dtype=float) if len(p.live) else np.zeros(states)
    seen = np.stack([np.bincount(p.classes, gamma[:, k], classes) for k in range(states)], axis=1)
    return first, moves, seen, float(np.log(scale.astype(float)).sum())


def _parts(at: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """Rows in order of length, cut where their tokens exceed ``limit``."""
    order = np.argsort(np.diff(at), kind="stable")
    ends = np.cumsum(np.diff(at)[order])
    start = 0
    while start < len(order):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield order[start:stop]
        start = stop


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, flat classes, offsets) of parts of a batch of bounded size."""
    col = batch.column("classes")
    at = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy()
    for rows in _parts(at, TOKENS):
        sizes = at[rows + 1] - at[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(offsets[-1]) + np.repeat(at[rows] - offsets[:-1], sizes)
        yield rows, flat[take], offsets


#: Classes that one row of a task's counts holds.
BLOCK = 1 << 9


def _learner(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = shared.value
        classes, states = params.emit.shape
        first, moves, seen, fit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0
        for batch in batches:
            for _, flat, at in _sequences(batch):
                got = expected_counts(flat, at, params)
                first += got[0]
                moves += got[1]
                seen += got[2]
                fit += got[3]
        rows = [(-1, np.concatenate([first, moves.ravel(), [fit]]))]
        rows += [(a // BLOCK, part.ravel()) for a in range(0, classes, BLOCK) if (part := seen[a : a + BLOCK]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["block", "sums"])

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums")):
            part = np.frombuffer(raw.as_buffer(), np.float64)
            sums[block] = sums[block] + part if block in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "sums"])


def estimate(first: np.ndarray, moves: np.ndarray, seen: np.ndarray, overall: np.ndarray) -> Parameters:
    """Probabilities from expected counts, each with its pseudo-counts."""
    start = first + STAY
    step = moves + STAY
    emit = seen + PRIOR * overall[:, None]
    return Parameters(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def overall_classes(words: Words) -> np.ndarray:
    """Share of each class among the training tokens, with half a token for each."""
    counts = np.concatenate([[words.ends], words.slot_tokens, words.counts]) + 0.5
    return counts / counts.sum()


def baum_welch(sequences: DataFrame, words: Words, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Parameters, list[float]]:
    """Parameters after ``iterations`` over all of ``sequences`` (classes), and the log-likelihood before each."""
    overall = overall_classes(words)
    params, fits = first_guess(overall, states), []
    for _ in range(iterations):
        shared = Shared(sequences.sparkSession, params)
        counted = sequences.select("classes").mapInArrow(_learner(shared), "block int, sums binary")
        added = counted.repartition("block").mapInArrow(_adder, "block int, sums binary").collect()
        first, moves, fit = np.zeros(states), np.zeros((states, states)), 0.0
        seen = np.zeros((words.classes, states))
        for r in added:
            sums = np.frombuffer(r["sums"], np.float64)
            if r["block"] < 0:
                first, moves, fit = sums[:states], sums[states:-1].reshape(states, states), float(sums[-1])
            else:
                part = sums.reshape(-1, states)
                seen[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
        params = estimate(first, moves, seen, overall)
        fits.append(fit)
        shared.unpersist()
    return params, fits


def _dealer(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("words")
            at = col.offsets.to_numpy().astype(np.int64)
            part = slice(at[0], at[-1])
            h = col.values.to_numpy()[part].view(U64)
            if not len(h):
                continue
            slot = batch.column("slots").values.to_numpy()[part].astype(np.uint16)
            times = batch.column("times").values.to_numpy()[part].astype(np.int32)
            rid = np.repeat(batch.column("rid").to_numpy(), np.diff(at))
            held = np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(at))
            signed = np.where(held, -times, times).astype(np.int32)
            bucket = (mixed(h, 5) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            raw = lambda x: pa.array([x[order[cuts[b] : cuts[b + 1]]].tobytes() for b in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), raw(h), raw(slot), raw(signed), raw(rid)], names=["bucket", "words", "slots", "times", "rids"])

    return run


def _rater(shared) -> Callable:
    """Of each document the sums over its rare words in this bucket: for the base, known ones, and p(word | class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        discount, kinds = shared.value
        for group in _groups(batches, ["bucket"]):
            col = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group[name]])  # noqa: E731, B023
            h, slot, signed, rid = col("words", U64), col("slots", np.uint16), col("times", np.int32), col("rids", np.int64)
            _, back = np.unique(h, return_inverse=True)
            count = np.bincount(back, np.maximum(signed, 0))[back]
            times = np.abs(signed)
            known = count > 0
            base = times * np.log10(count + 1)
            # An unknown word takes the discounted mass of its class; a class never met has only unknown words.
            unknown = np.log10(np.where(kinds[slot] > 0, discount * kinds[slot], 1.0))
            within = times * np.where(known, np.log10(np.where(known, count - discount, 1.0)), unknown)
            rids, doc = np.unique(rid, return_inverse=True)
            sums = [np.bincount(doc, x, len(rids)) for x in (base, times * known, within)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], names=["rid", "base", "known", "within"]
            )

    return run


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, words = shared.value
        # Tokens of a slot are spread over its words: the counts are in "within", the slot's size is here.
        emit = params.emit.copy()
        emit[1 : 1 + SLOTS] /= np.maximum(words.slot_tokens, 1)[:, None]
        plain = np.concatenate([[np.log10(words.ends + 1)], np.zeros(SLOTS), np.log10(words.counts + 1)])
        counted = np.concatenate([[words.ends > 0], np.zeros(SLOTS, bool), np.ones(len(words.counts), bool)])
        for batch in batches:
            n = batch.num_rows
            score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for rows, flat, at in _sequences(batch):
                p = Packed(flat, at)
                _, scale = forward(p, params, emit[p.classes])
                row = rows[p.order][p.seq]
                score += np.bincount(row, np.log10(scale), n)
                base += np.bincount(row, plain[p.classes], n)
                known += np.bincount(row, counted[p.classes], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("rid"), batch.column("held_out"), batch.column("n_tokens"), pa.array(known), pa.array(base), pa.array(score)],
                names=["row", "rid", "held_out", "n_tokens", "known", "base", "forward"],
            )

    return run


def score_documents(
    docs: DataFrame, held_out: Column, states: int = STATES, iterations: int = ITERATIONS, limit: int = LIMIT, keep: list[str] | None = None
) -> DataFrame:
    """Documents with held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    The model learns from the rows that are not ``held_out``. ``base_score`` is that of single words with one
    added to each count. A null or empty text is its end alone. Repeated rows count and are scored each. With
    nothing to learn from, every class is as likely and every word unknown. Words are told apart by
    64-bit hashes. Columns named like those added are replaced.
    """
    spark = docs.sparkSession
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("rid"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty().alias("text"),
    )
    words = count_words(rows.where("not held_out"), limit)
    kind = f"row {rows.schema['row'].dataType.simpleString()}, rid long, held_out boolean"
    encoded = materialise(rows.mapInArrow(
        _encoder(spark.sparkContext.broadcast(words.frequent)),
        f"{kind}, n_tokens long, classes array<int>, words array<long>, slots array<int>, times array<int>",
    ))
    params, _ = baum_welch(encoded.where("not held_out"), words, states, iterations)
    pairs = encoded.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-pairs // PAIRS))
    dealt = encoded.select("rid", "held_out", "words", "slots", "times").mapInArrow(_dealer(buckets), "bucket int, words binary, slots binary, times binary, rids binary")
    met = dealt.repartition("bucket").sortWithinPartitions("bucket")
    rated = met.mapInArrow(_rater(spark.sparkContext.broadcast((words.discount, words.slot_kinds))), "rid long, base double, known long, within double")
    rare = rated.groupBy("rid").agg(F.sum("base").alias("rare_base"), F.sum("known").alias("rare_known"), F.sum("within").alias("within"))
    scored = encoded.select("row", "rid", "held_out", "n_tokens", "classes").mapInArrow(
        _scorer(Shared(spark, (params, words))), f"{kind}, n_tokens long, known long, base double, forward double"
    )
    both = scored.join(rare, "rid", "left")
    of = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    base = of("base", "rare_base") - F.col("n_tokens") * F.lit(float(np.log10(words.tokens + words.kinds + 1)))
    return both.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], "held_out", "n_tokens", of("known", "rare_known").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), of("forward", "within").alias("score"),
    )
