"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Runs of 4 to 8 characters of the lower-cased text (white space as one space, a space at both ends)
are hashed to ``SLOTS`` features; a feature is present or absent in a text. Over all labelled training rows
the documents of each class that hold a feature are counted; with ``p`` and ``q`` the smoothed counts,
each divided by its class's size, the feature's ratio is ``r = ln(p / q)``. All features that are twice as common among
toxic documents, beyond chance (log-likelihood ratio test above ``LEAST_TEST``), make up the model, however many they
are, so that a rare language keeps its own. It is a logistic regression with an L2 penalty on the inputs
r / sqrt(m) where present, m the features of the model that a text holds, 0 elsewhere: a long text does not add
up hundreds of weak signs. Both classes weigh the same.

Counting uses all labelled rows. The regression is fitted in one task on about ``sample`` rows drawn by a
hash of id and text, or fewer where these would hold more than ``PAIRS`` features of the model: documented bounds. Scoring is a map over whole texts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise, release
from .common import U64, Shared, mapped, pieces, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTHS = (4, 5, 6, 7, 8)
SLOTS = 1 << 20
#: Of the test for a feature to enter the model: a chance of one in 600 for a single one.
LEAST_TEST = 10.0
#: And it has to be twice as common among toxic documents, as a logarithm.
LEAST_RATIO = float(np.log(2))
#: Bounds of the fitted sample: labelled rows, and their features that are in the model.
SAMPLE = 20_000
PAIRS = 4_000_000
THRESHOLD = 0.7
PENALTY = 1e-4
STEPS = 400
#: Present features that a fitting step holds at a time.
CHUNK = 1 << 21
#: Slots that one row of a task's counts holds.
BLOCK = 1 << 12

_SPACES = re.compile(r"\s+")


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased and each between two spaces, and the rows' offsets."""
    clean = [" " + " ".join(t.lower().split()) + " " for t in texts.to_pylist()]
    raw = "".join(clean).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in clean])]).astype(np.int64)


#: Odd multipliers of the characters of an n-gram, by place.
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length the slot of the n-gram that starts at each character, and the rows' offsets; some cross rows."""
    codes, at = _codes(texts)
    wide = codes.astype(U64) + U64(1)
    total, out = np.zeros(len(wide), U64), []
    for k in range(max(LENGTHS)):
        total = total[: len(wide) - k] + wide[k:] * U64(_FACTORS[k]) if len(wide) > k else total[:0]
        if (n := k + 1) in LENGTHS:
            h = total ^ (total >> U64(29))
            h *= U64(0xBF58476D1CE4E5B9 + 2 * n)
            out.append((h >> U64(44)).astype(np.int32))
    return out, at


def _present(grams: list[np.ndarray], start: int, end: int, mark: np.ndarray) -> np.ndarray:
    """The distinct slots of the row from ``start`` to ``end``; ``mark`` is a table of all slots to write on."""
    s = np.concatenate([g[start : max(start, end - n + 1)] for g, n in zip(grams, LENGTHS)])
    place = np.arange(len(s), dtype=np.int32)
    mark[s] = place
    return s[mark[s] == place]


def _features(texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each feature present, once; of the ``wanted`` slots (a table of flags) only."""
    grams, at = _grams(texts)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    found = [np.zeros(0, np.int64)]
    for g, n in zip(grams, LENGTHS):
        where = np.flatnonzero(wanted[g])
        where = where[row[where] == row[where + n - 1]]
        found.append(row[where] * SLOTS + g[where])
    keys = np.unique(np.concatenate(found))
    return keys // SLOTS, keys % SLOTS


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SLOTS), np.int64)
    size = np.zeros(2, np.int64)
    mark = np.zeros(SLOTS, np.int32)
    for batch in pieces(batches):
        grams, at = _grams(batch.column("text"))
        for k, y in enumerate(batch.column("toxic").to_pylist()):
            counts[y][_present(grams, at[k], at[k + 1], mark)] += 1
            size[y] += 1
    for block in range(-1, SLOTS // BLOCK):
        part = size[:, None] if block < 0 else counts[:, block * BLOCK : (block + 1) * BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part[1].tobytes()]), pa.array([part[0].tobytes()])], names=["block", "toxic", "clean"])


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' counts, by slot; a task holds the sums of its own blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, t, c in zip(*(batch.column(k) for k in ("block", "toxic", "clean"))):
            part = np.stack([np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int64)])
            k = block.as_py()
            sums[k] = sums[k] + part if k in sums else part
    for block, part in sums.items():
        some = np.flatnonzero(part.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(block < 0, -1, block * BLOCK + some), pa.int32()), pa.array(part[0][some]), pa.array(part[1][some])], names=["slot", "toxic", "clean"]
        )


@dataclass(frozen=True)
class Model:
    """``weights[k]`` is added for slot ``slots[k]`` where present; ``bias`` always."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def ratios(counts: DataFrame, features: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The chosen slots and their log-count ratios; at most ``SLOTS`` rows reach the driver.

    All that pass the test, or only the ``features`` with the highest values of it; ties go to the smaller slot.
    """
    sizes = counts.where("slot < 0").first()
    if sizes is None:
        return np.zeros(0, np.int64), np.zeros(0)
    pos, neg = sizes["toxic"] or 0, sizes["clean"] or 0
    n = pos + neg
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d, seen = F.lit(float(pos)) - a, F.lit(float(neg)) - b, a + b
    part = lambda x, row, col: F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)
    test = part(a, seen, F.lit(pos)) + part(b, seen, F.lit(neg)) + part(c, n - seen, F.lit(pos)) + part(d, n - seen, F.lit(neg))
    ratio = F.log(((a + 1) / (pos + 1)) / ((b + 1) / (neg + 1)))
    top = counts.where("slot >= 0").select("slot", (2 * test).alias("test"), ratio.alias("r")).where((F.col("test") > LEAST_TEST) & (F.col("r") > LEAST_RATIO))
    top = (top if features is None else top.orderBy(F.desc("test"), "slot").limit(features)).toArrow().sort_by("slot")
    return top["slot"].to_numpy().astype(np.int64), top["r"].to_numpy()


def _fitter(slots: np.ndarray, ratio: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(SLOTS, bool)
        wanted[slots] = True
        place = np.zeros(SLOTS, np.int32)
        place[slots] = np.arange(len(slots))
        rows, cols, labels, seen = [], [], [], 0
        for batch in pieces(batches):
            row, slot = _features(batch.column("text"), wanted)
            rows.append((row + seen).astype(np.int32))
            cols.append(place[slot])
            labels.append(batch.column("toxic").to_numpy(zero_copy_only=False).astype(float))
            seen += batch.num_rows
        if not seen:
            return
        weights, bias = fit(np.concatenate(rows), np.concatenate(cols), np.concatenate(labels), ratio)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(weights, bias))], names=["weight"])

    return run


def _size(rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows one over the root of the number of its features."""
    return 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))


def fit(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (times the ratios) and bias of the penalised logistic regression, by Adam steps over all rows.

    ``rows`` and ``cols`` are the places of the present features, by row; a step takes ``CHUNK`` of them at a time.
    """
    n, m = len(labels), len(ratio)
    theta, mean, square = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    toxic = labels.sum()
    share = np.where(labels == 1, n / 2 / max(toxic, 1), n / 2 / max(n - toxic, 1)) / n if 0 < toxic < n else np.full(n, 1 / n)
    size = _size(rows, n)
    parts = [slice(a, a + CHUNK) for a in range(0, len(rows), CHUNK)]
    for t in range(1, STEPS + 1):
        scaled = ratio * theta[:m]
        z = np.full(n, theta[m])
        for p in parts:
            z += np.bincount(rows[p], scaled[cols[p]], n) * size
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * share
        pulled = error * size
        slope = np.zeros(m)
        for p in parts:
            slope += np.bincount(cols[p], pulled[rows[p]], m)
        grad = np.append(slope * ratio + PENALTY * theta[:m], error.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        theta -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return theta[:m] * ratio, float(theta[m])


def train(labelled: DataFrame, features: int | None = None, sample: int = SAMPLE) -> Model:
    """From rows of (text, toxic: 0 or 1) and perhaps _id, which the draw of the sample uses. Without rows every text scores one half."""
    drawn_by = F.xxhash64(*[c for c in ("_id", "text") if c in labelled.columns])
    rows = labelled.select(drawn_by.alias("draw"), text_or_empty().alias("text"), F.col("toxic").cast("int").alias("toxic"))
    staged = materialise(rows.where("toxic in (0, 1)"))
    partial = staged.select("text", "toxic").mapInArrow(_counter, "block int, toxic binary, clean binary")
    counts = materialise(partial.repartition("block").mapInArrow(_adder, "slot int, toxic long, clean long"))
    slots, ratio = ratios(counts, features)
    held = counts.where("slot >= 0").join(staged.sparkSession.createDataFrame(pa.table({"slot": pa.array(slots, pa.int32())})), "slot") if len(slots) else None
    pairs = held.agg(F.sum(F.col("toxic") + F.col("clean"))).first()[0] or 0 if held is not None else 0
    share = min(1.0, sample / max(1, staged.count()), PAIRS / max(1, pairs))
    drawn = staged.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text", "toxic")
    got = drawn.repartition(1).mapInArrow(_fitter(slots, ratio), "weight double").collect() if len(slots) else []
    release(staged, counts)
    if not got:
        return Model(slots, np.zeros(len(slots)), 0.0)
    weights = np.array([r["weight"] for r in got])
    return Model(slots, weights[:-1], float(weights[-1]))


def _scorer(shared) -> Callable:
    def make():
        model = shared.value
        wanted = np.zeros(SLOTS, bool)
        wanted[model.slots] = True
        weight = np.zeros(SLOTS)
        weight[model.slots] = model.weights

        def score(texts: pa.Array) -> list[pa.Array]:
            row, slot = _features(texts, wanted)
            z = np.bincount(row, weight[slot], len(texts)) * _size(row, len(texts)) + model.bias
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]

        return score

    return make


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Documents with ``score``, the probability that the text is toxic.

    Null and empty texts have no features and score by the bias alone. Repeated rows score alike. A text is read
    whole, however long; only its number of features in the model counts, not its length.
    """
    shared = Shared(docs.sparkSession, model)
    return mapped(docs, _scorer(shared), "score double", keep)


def labelled_texts(docs: DataFrame, labels: DataFrame, usable) -> DataFrame:
    """(_id, text, toxic) of the documents whose id is ``usable`` and labelled.

    An id labelled more than once is toxic if any label says so; null labels and ids are left out. The join
    is by sorting at any size of the labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = known.agg(F.max("toxic").alias("toxic")).where(usable("_id"))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(usable("_id")).join(known.hint("merge"), "_id").select("_id", "text", "toxic")
