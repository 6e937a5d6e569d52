"""Repeated byte strings removed across documents, by sorting anchored suffixes deep and shallow.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier, in the order of (doc_id,
row, start). Sorting the suffixes of all positions would move a hundred times the text, so only suffixes
at anchors are sorted: of the ``K``-byte strings in each window of ``LENGTH`` bytes the one of smallest hash
is its anchor. Equal windows have equal anchors at the same place, so they always meet.

1. Documents are written once, bucketed by id, so that later joins on the id do not move texts.
2. Each anchor carries its windows: those it serves start at most ``high`` and at least ``low`` bytes
   before it; the bytes they cover are its span. Strings that a hundredth of the documents shows to be
   frequent come last in the order of anchors, so windows that reach beyond a common passage are anchored
   outside of it, and the spans of common anchors are alike.
3. Anchors meet by their hash in buckets of bounded size. Of equal spans the first stays, all windows of
   the others are repeats; a task drops its own later copies before the shuffle, which hence carries one
   row of a span per task. Anchors whose spans differ go on, one row per span, with their bytes.
4. Their suffixes (to the right of the anchor's start) and reversed prefixes (to its left) are put in
   order: multikey quicksort by eight bytes at a time down to a shallow depth, then a blind trie for each
   group that still agrees. From the lengths of common prefixes, two windows at the same distance are equal
   when both sides agree far enough; all but the first are repeats.
5. Repeats are joined to the documents and cut out.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialise import materialise, release
from .common import U64, Powers, Rolling, joined_bytes, mixed, pieces, text_or_empty
from .jaccard import _groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
K = 24
SHALLOW = 48
#: Frequent strings that the order of anchors knows of, at most; seen this often in the sample.
COMMON, OFTEN = 1 << 16, 16
SAMPLE = 100
#: Slots of the table that tells frequent strings; its size is fixed.
SLOTS = 1 << 22
#: Text bytes whose anchors one bucket holds; anchors that a task holds before it sends them.
BUCKET_BYTES, HELD = 64 << 20, 2_000_000
LEAST_BUCKETS = 12
_LAST = (1 << 63) - 1


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each run of ``width`` neighbours."""
    n, size, now = len(x) - width + 1, 1, x
    while size * 2 <= width:
        now = op(now[:-size], now[size:])
        size *= 2
    return op(now[:n], now[width - size : width - size + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, powers: Powers, common: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, hash of the anchor, hash of the span) of all anchors, by place.

    Windows are given by their starts; all lie within one row. ``common`` flags the slots of frequent strings.
    """
    width = LENGTH - K + 1
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.view(U64), none.view(U64)
    rolling = Rolling(raw, powers)
    grams = rolling.all_of(K) >> U64(1)
    if common is not None:
        grams |= common[(grams & U64(SLOTS - 1)).astype(np.int64)].astype(U64) << U64(63)
    low = _slide(grams, width, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    # Windows beyond the end of their row serve none: 0 is below every anchor but the rarest hash.
    low = np.where(np.arange(len(low)) + LENGTH <= ends, np.maximum(low, U64(1)), U64(0))
    np.maximum(grams, U64(1), out=grams)
    around = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(len(grams) - len(low), U64)])
    place = np.flatnonzero(_slide(around, width, np.maximum) == grams)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(low)) - 1
    run = np.cumsum(new)[np.minimum(place, len(low) - 1)] - 1
    value = low[starts]
    wrong = np.flatnonzero(value[run] != grams[place])
    while len(wrong):
        run[wrong] -= 1
        wrong = wrong[value[run[wrong]] != grams[place[wrong]]]
    first = np.maximum(starts[run], place - width + 1)
    last = np.minimum(stops[run], place)
    span = rolling.of(first, last + LENGTH) ^ mixed((place - first).astype(U64), 9)
    return place, first, last, mixed(grams[place], 4), span


def _common_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in pieces(batches):
        place, _, _, _, _ = anchors(*(b := joined_bytes(batch.column("text"))), powers, None)
        if not len(place):
            continue
        grams = Rolling(b[0], powers).of(place, place + K) >> U64(1)
        values, times = np.unique(grams, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["gram", "n"])


def _common_slots(staged: DataFrame) -> np.ndarray:
    """Flags of the slots of strings that are often anchors in the sample; at most ``COMMON`` of them."""
    drawn = staged.where(F.pmod(F.xxhash64("key", "no"), F.lit(SAMPLE)) == 0).select("text")
    counted = drawn.mapInArrow(_common_counter, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    flags = np.zeros(SLOTS, bool)
    flags[np.array([r["gram"] & (SLOTS - 1) for r in top], np.int64)] = True
    return flags


#: One anchor on its way: hashes, document, and its windows as distances before the anchor.
RECORD = np.dtype([("anchor", "<u8"), ("span", "<u8"), ("key", "<i8"), ("no", "<i4"), ("place", "<i4"), ("low", "u1"), ("high", "u1"), ("later", "u1")])
REPEAT = np.dtype([("no", "<i4"), ("start", "<i4"), ("end", "<i4")])
WANTED = np.dtype([("no", "<i4"), ("place", "<i4"), ("low", "u1"), ("high", "u1"), ("anchor", "<u8")])


def _mark_later(r: np.ndarray) -> np.ndarray:
    """Records in order of span and document, ``later`` set on all but the first of each span."""
    r = r[np.lexsort((r["place"], r["no"], r["key"], r["span"], r["anchor"]))]
    same = np.zeros(len(r), bool)
    same[1:] = (r["anchor"][1:] == r["anchor"][:-1]) & (r["span"][1:] == r["span"][:-1])
    r["later"] |= same
    return r


def _sent(r: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records by bucket: first copies by anchor, so that they meet; later ones, already settled, by document."""
    r = _mark_later(r)
    by = np.where(r["later"] > 0, mixed(r["key"].view(U64), 6), r["anchor"])
    bucket = (by % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    r, bucket = r[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array([r[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "records"]
    )


def _anchoring(buckets: int, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, common = Powers(), shared.value
        held, size = [], 0
        for batch in pieces(batches):
            raw, offsets = joined_bytes(batch.column("text"))
            place, first, last, anchor, span = anchors(raw, offsets, powers, common)
            row = np.searchsorted(offsets, place, "right") - 1
            r = np.zeros(len(place), RECORD)
            r["anchor"], r["span"] = anchor, span
            r["key"], r["no"] = batch.column("key").to_numpy()[row], batch.column("no").to_numpy()[row]
            r["place"], r["low"], r["high"] = place - offsets[row], place - last, place - first
            held.append(r)
            size += len(r)
            if size >= HELD:
                yield _sent(np.concatenate(held), buckets)
                held, size = [], 0
        if size:
            yield _sent(np.concatenate(held), buckets)

    return run


def _by_document(keys: np.ndarray, parts: np.ndarray) -> tuple[list, list]:
    """(document keys, bytes of their records), records grouped by document."""
    order = np.argsort(keys, kind="stable")
    keys, parts = keys[order], parts[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    stops = np.append(cuts[1:], len(keys))
    return keys[cuts] if len(keys) else keys, [parts[a:b].tobytes() for a, b in zip(cuts, stops)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats known from equal spans, and the spans whose bytes are wanted, by document."""
    for group in _groups(batches, ["bucket"]):
        r = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in group["records"].combine_chunks()), RECORD).copy()
        settled, r = r[r["later"] > 0], r[r["later"] == 0]
        r = _mark_later(r)
        one = r[r["later"] == 0]
        other = np.zeros(len(one), bool)
        other[1:] = one["anchor"][1:] == one["anchor"][:-1]
        other[:-1] |= other[1:].copy()
        late = np.concatenate([settled, r[r["later"] > 0]])
        repeat = np.zeros(len(late), REPEAT)
        repeat["no"], repeat["start"], repeat["end"] = late["no"], late["place"] - late["high"], late["place"] - late["low"] + LENGTH
        some = one[other]
        want = np.zeros(len(some), WANTED)
        for name in WANTED.names:
            want[name] = some[name]
        for kind, keys, parts in (("repeats", late["key"], repeat), ("wanted", some["key"], want)):
            ids, blobs = _by_document(keys, parts)
            if len(ids):
                empty = pa.nulls(len(ids), pa.binary())
                cols = [pa.array(blobs, pa.binary()), empty] if kind == "repeats" else [empty, pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *cols], names=["key", "repeats", "wanted"])


#: A span with its bytes: those right of the anchor's start, and those left of it backwards.
SPAN = np.dtype([("key", "<i8"), ("no", "<i4"), ("place", "<i4"), ("low", "u1"), ("high", "u1"), ("right", "u1", LENGTH), ("left", "u1", LENGTH - K)])


def _fetching(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw, offsets = joined_bytes(batch.column("text"))
            nos, keys = batch.column("no").to_numpy(), batch.column("key").to_numpy()
            found, at, owner = [], [], []
            for k, blobs in enumerate(batch.column("wanted")):
                want = np.frombuffer(b"".join(x.as_py() for x in blobs.values), WANTED)
                want = want[want["no"] == nos[k]]
                found.append(want)
                at.append(want["place"] + offsets[k])
                owner.append(np.full(len(want), keys[k]))
            want, at, owner = np.concatenate(found), np.concatenate(at), np.concatenate(owner)
            if not len(want):
                continue
            s = np.zeros(len(want), SPAN)
            for name in ("no", "place", "low", "high"):
                s[name] = want[name]
            s["key"] = owner
            steps = np.arange(LENGTH)
            far = at[:, None] + steps
            s["right"] = np.where(steps < LENGTH - want["low"][:, None], raw[np.minimum(far, len(raw) - 1)], 0)
            steps = np.arange(LENGTH - K)
            back = at[:, None] - 1 - steps
            s["left"] = np.where(steps < want["high"][:, None], raw[np.maximum(back, 0)], 0)
            bucket = (want["anchor"] % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            s, bucket = s[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([s[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "spans"]
            )

    return run


def _common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings in order, from a trie that keeps of each branch only its depth and the bytes that differ there."""

    def __init__(self, strings: list[bytes]):
        # A branch is [depth, {byte or -1 for the end: child}]; a leaf is the list of equal strings' numbers.
        self.strings = strings
        self.root = [0]
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        new, node = self.strings[k], self.root
        size = len(new)
        while type(node[-1]) is dict:  # blind descent: any leaf below has the longest common prefix
            depth, branches = node
            node = branches.get(new[depth] if depth < size else -1) or next(iter(branches.values()))
        leaf = node
        old = self.strings[leaf[0]]
        depth = _common_prefix(new, old)
        if depth == size == len(old):
            leaf.append(k)
            return
        above, at, node = None, None, self.root
        while type(node[-1]) is dict and node[0] < depth:
            above, at = node, new[node[0]] if node[0] < size else -1
            node = node[1][at]
        byte = new[depth] if depth < size else -1
        if type(node[-1]) is dict and node[0] == depth:
            node[1][byte] = [k]
            return
        branch = [depth, {old[depth] if depth < len(old) else -1: node, byte: [k]}]
        if above is None:
            self.root = branch
        else:
            above[1][at] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and the common prefix of each with the one before (the first has 0)."""
        order, shared = [], []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if type(node[-1]) is dict:
                depth, branches = node
                keys = sorted(branches, reverse=True)
                stack += [(branches[b], depth) for b in keys[:-1]]
                stack.append((branches[keys[-1]], before))
            else:
                order += node
                shared += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, shared


def deep_shallow(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte strings ``rows[i, :sizes[i]]`` (zeros beyond), and each one's common prefix with the one before.

    All open groups are split at once by their next eight bytes, the equal ones go on, to ``SHALLOW`` bytes;
    groups that still agree are ordered by blind tries. Of strings that begin alike the shorter is first.
    """
    m, d = rows.shape
    wide = np.zeros((m, -(-d // 8) * 8), np.uint8)
    wide[:, :d] = rows
    words = wide.view(">u8").astype(U64)
    order, group = np.arange(m), np.zeros(m, np.int64)
    depth = 0
    while depth < min(SHALLOW, d):
        key = words[order, depth // 8]
        sort = np.lexsort((key, group))
        order, key, before = order[sort], key[sort], group[sort]
        new = np.ones(m, bool)
        new[1:] = (before[1:] != before[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        depth += 8
        if new.all():
            break
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if m else np.zeros(0, np.int64)
    stops = np.append(cuts[1:], m)
    deep = np.zeros(m, np.int64)
    inside = np.zeros(m, bool)
    for a, b in zip(cuts[stops - cuts > 1].tolist(), stops[stops - cuts > 1].tolist()):
        members = order[a:b]
        strings = [rows[k, : sizes[k]].tobytes() for k in members.tolist()]
        ranked, shared = BlindTrie(strings).walk()
        order[a:b] = members[ranked]
        deep[a:b] = shared
        inside[a + 1 : b] = True
    shared = np.zeros(m, np.int64)
    edge = np.flatnonzero(~inside)
    edge = edge[edge > 0]
    one, two = order[edge - 1], order[edge]
    differ = wide[one] != wide[two]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), d)
    shared[edge] = np.minimum(first, np.minimum(sizes[one], sizes[two]))
    shared[inside] = deep[inside]
    return order, shared


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among spans whose bytes differ, by document."""
    for group in _groups(batches, ["bucket"]):
        s = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in group["spans"].combine_chunks()), SPAN)
        s = s[np.lexsort((s["place"], s["no"], s["key"]))]  # so the first of equals is the earliest
        sides = []
        for side, sizes in (("right", LENGTH - s["low"].astype(np.int64)), ("left", s["high"].astype(np.int64))):
            order, shared = deep_shallow(s[side], sizes)
            back = np.empty(len(s), np.int64)
            back[order] = np.arange(len(s))
            sides.append((shared, back))
        repeat = np.zeros((len(s), LENGTH - K + 3), bool)  # by distance, a column free at each end
        for r in range(LENGTH - K + 1):
            some = np.flatnonzero((s["low"] <= r) & (s["high"] >= r))
            if len(some) < 2:
                continue
            (right, right_at), (left, left_at) = sides
            a = np.cumsum(right < LENGTH - r)[right_at[some]]
            b = np.cumsum(left < r)[left_at[some]]
            _, first = np.unique(a * (len(s) + 1) + b, return_index=True)
            repeat[some, r + 1] = True
            repeat[some[first], r + 1] = False
        step = np.diff(repeat.astype(np.int8), axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)  # runs low..high - 1 of distances, in the same order
        out = np.zeros(len(row), REPEAT)
        out["no"], out["start"], out["end"] = s["no"][row], s["place"][row] - (high - 1), s["place"][row] - low + LENGTH
        ids, blobs = _by_document(s["key"][row], out)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], names=["key", "repeats"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        raw, offsets = joined_bytes(batch.column("text"))
        nos = batch.column("no").to_numpy()
        removed, spans, kept = [], [], []
        for k, blobs in enumerate(batch.column("repeats")):
            a, b = offsets[k], offsets[k + 1]
            r = np.frombuffer(b"".join(x.as_py() for x in blobs.values) if blobs.is_valid else b"", REPEAT)
            r = r[r["no"] == nos[k]]
            change = np.zeros(b - a + 1, np.int64)
            np.add.at(change, r["start"], 1)
            np.add.at(change, r["end"], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(raw[a:b][~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["row", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents with n_bytes, n_removed, n_spans and kept (the bytes that stay, in order).

    Order is by doc_id, a null one last; rows of one id stand in the order of their texts. Matches never cross
    documents, overlaps count, and a null text is empty. Texts below ``LENGTH`` bytes stay whole. ``keep``
    names the columns that stay (all); columns named like those added are replaced.
    """
    spark = docs.sparkSession
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), text_or_empty().alias("text")
    )
    order = F.row_number().over(Window.partitionBy("key").orderBy("text")) - 1
    name = f"repeats_{uuid.uuid4().hex}"
    keyed.repartition(n, "key").withColumn("no", order).write.bucketBy(n, "key").format("parquet").saveAsTable(name)
    staged = spark.table(name)

    size = staged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    common = spark.sparkContext.broadcast(_common_slots(staged))
    sent = staged.select("key", "no", "text").mapInArrow(_anchoring(buckets, common), "bucket int, records binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "key long, repeats binary, wanted binary")
    met = materialise(met.groupBy("key").agg(F.collect_list("repeats").alias("repeats"), F.collect_list("wanted").alias("wanted")))
    asked = staged.select("key", "no", "text").join(met.where(F.size("wanted") > 0).select("key", "wanted"), "key")
    spans = asked.mapInArrow(_fetching(buckets), "bucket int, spans binary")
    settled = spans.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle, "key long, repeats binary")
    known = met.select("key", F.explode("repeats").alias("repeats"))
    repeats = known.union(settled).groupBy("key").agg(F.collect_list("repeats").alias("repeats"))
    kind = staged.schema["row"].dataType.simpleString()
    cut = staged.join(repeats, "key", "left").select("row", "no", "text", "repeats")
    out = materialise(cut.mapInArrow(_cut, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
    spark.sql(f"DROP TABLE {name}")
    release(met)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *added)
