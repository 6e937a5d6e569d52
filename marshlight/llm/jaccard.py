"""Similarity join on word n-grams by MinHash banding, verified on the full n-gram sets.

1. Each document gives its set of n-gram hashes (64 bits), a signature of ``rows x bands`` minima and a
   128-bit digest of the set. Documents with equal sets are one class; only its first member goes on.
2. Rows per band are as many as ``most_bands`` bands allow at the target recall: pairs at the threshold
   miss all bands with a probability below ``miss``.
3. Shuffled on their band hashes, members of a bucket are linked to its smallest member. The connected
   clusters of these links hold every pair that shares a bucket, and most pairs that do not resemble
   each other are apart.
4. Clusters are cut into blocks of about ``BLOCK`` members. Each two blocks meet in one task, where all
   pairs are verified by counting common n-grams exactly; a task gives each member its number of links and
   a star of the linked, so no table of pairs is ever made, however many near copies a text has.
5. Classes of the result are the connected components of the verified links.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise, materialise_by, release
from .common import U64, Powers, mapped, mixed, pieces, shingle_hashes, text_or_empty, word_hashes
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, THRESHOLD = 5, (4, 5)  # n-grams of five words, similarity 4/5 or more
BLOCK = 256
COLUMNS = 4096


def plan_bands(threshold: float, miss: float = 1e-5, most_bands: int = 40) -> tuple[int, int]:
    """(rows, bands): the most rows for which ``bands <= most_bands`` keeps the miss of a pair at the threshold below ``miss``."""
    best = None
    for rows in range(1, 65):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands > most_bands:
            break
        best = rows, bands
    if best is None:
        raise ValueError("no banding reaches this recall with so few bands")
    return best


def _sets(texts: pa.Array, words: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted within each row, and the rows' offsets."""
    hashes, rows = word_hashes(texts, powers)
    grams, at = shingle_hashes(hashes, rows, words)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[fresh], row[fresh]
    return grams, np.searchsorted(row, np.arange(len(at)))


def _minima(values: np.ndarray, at: np.ndarray, have: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One row of minima for each seed, over the rows of ``values`` that have any."""
    starts = at[:-1][have]
    short = (values >> U64(32)).astype(np.uint32)
    out = np.empty((len(seeds), len(starts)), np.uint32)
    for k, (a, b) in enumerate(seeds):
        out[k] = np.minimum.reduceat((short ^ b) * a, starts)
    return out


def _sketcher(words: int, rows: int, bands: int) -> Callable:
    def make():
        powers = Powers()
        drawn = mixed(np.arange(2 * rows * bands, dtype=U64), 7).astype(np.uint32).reshape(-1, 2)
        drawn[:, 0] |= np.uint32(1)

        def sketch(texts: pa.Array) -> list[pa.Array]:
            grams, at = _sets(texts, words, powers)
            counts = np.diff(at)
            have = counts > 0
            total = np.concatenate([[U64(0)], np.cumsum(mixed(grams, 1))])
            other = np.concatenate([[U64(0)], np.cumsum(mixed(grams, 2))])
            d1 = (total[at[1:]] - total[at[:-1]]).view(np.int64)
            d2 = (other[at[1:]] - other[at[:-1]]).view(np.int64)
            hashes = np.zeros((0, bands), U64)
            if have.any():
                low = _minima(grams, at, have, drawn).reshape(bands, rows, -1)
                hashes = np.zeros((low.shape[2], bands), U64)
                for b in range(bands):
                    h = np.full(low.shape[2], U64(b + 1))
                    for r in range(rows):
                        h = mixed(h * U64(5) + low[b, r])
                    hashes[:, b] = h
            ends = np.concatenate([[0], np.cumsum(have * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.reshape(-1).view(np.int64)))
            return [pa.array(d1), pa.array(d2), lists]

        return sketch

    return make


def _linked(sets: list[np.ndarray], sides: np.ndarray, split: bool, threshold: tuple[int, int]) -> np.ndarray:
    """Whether each two members are similar enough; across the two sides only when ``split``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    member, column = member[shared], column[shared]
    column = (np.cumsum(times > 1) - 1)[column]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common = np.zeros((m, m), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((m, min(COLUMNS, width - start)), np.float32)
        part[member[a:b], column[a:b] - start] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common
    up, down = threshold
    linked = common * down >= up * both
    np.fill_diagonal(linked, False)
    if split:
        linked &= sides[:, None] != sides[None, :]
    return linked


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that it reaches."""
    root = ids.copy()
    while True:
        reach = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(root, reach)
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _verifier(threshold: tuple[int, int]) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["cluster", "a", "b"]):
            ids = group["rep"].to_numpy()
            weights = group["copies"].to_numpy()
            sides = group["block"].to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["grams"]]
            linked = _linked(sets, sides, bool(group["a"][0].as_py() != group["b"][0].as_py()), threshold)
            has = linked.any(axis=1)
            if has.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[has]) for x in (ids, linked.sum(axis=1).astype(np.int64), linked @ weights, _roots(linked, ids))],
                    names=["rep", "n_links", "n_linked", "star"],
                )

    return verify


def _gram_sets(words: int) -> Callable:
    def make():
        powers = Powers()

        def sets(texts: pa.Array) -> list[pa.Array]:
            grams, at = _sets(texts, words, powers)
            return [pa.array([grams[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())]

        return sets

    return make


def similar_documents(
    docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, miss: float = 1e-5, keep: list[str] | None = None
) -> DataFrame:
    """Documents with class_id, n_links, n_linked, n_copies and kept, one row for each.

    ``n_copies``: rows with the same set of n-grams (itself counted). ``n_links``: other sets, each a class
    of copies, at a similarity of ``threshold`` (up, down) or more; ``n_linked``: the rows behind them.
    ``class_id``: the smallest doc_id among all rows reached by links and copies; ``kept`` marks its row, one
    row where the id repeats. Words are runs other than space and 0x09 to 0x0D, A-Z in lower case; a text of
    fewer words than an n-gram has one n-gram, of all of them; null, empty and blank texts have none and are
    one class. A null doc_id counts as the largest. Columns named like those added are replaced.
    """
    added = ["class_id", "n_links", "n_linked", "n_copies", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows, bands = plan_bands(threshold[0] / threshold[1], miss)
    staged = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
    )
    # Texts move here and then stay: both later joins are on the key of the buckets. The text is written
    # once, in the row where that keeps it.
    if "text" in names:
        staged = materialise_by(staged.drop("text"), "rid").withColumn("text", text_or_empty("row.text"))
    else:
        staged = materialise_by(staged, "rid")
    sketched = materialise(mapped(staged, _sketcher(words, rows, bands), "d1 long, d2 long, bands array<long>", ["rid", "doc_id"]))
    classes = materialise(sketched.groupBy("d1", "d2").agg(
        F.min("rid").alias("rep"), F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id"),
        F.min_by("rid", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first_rid"),
    ))
    reps = sketched.select(F.col("rid").alias("rep"), "bands").join(classes.select("rep").hint("merge"), "rep", "left_semi")
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    # Written, and joined by sorting at any size, so that Spark can split a bucket that many share.
    shared = materialise(buckets.groupBy("band").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w").select("band", "v"))
    links = buckets.join(shared.hint("merge"), "band").select(F.col("rep").alias("u"), "v").where("u <> v")
    clusters = materialise(components(links).select(F.col("node").alias("rep"), F.col("root").alias("cluster")))

    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = clusters.join(sizes, "cluster").join(classes.select("rep", F.col("n_copies").alias("copies")), "rep")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = staged.select("rid", "text").join(members.withColumnRenamed("rep", "rid"), "rid").withColumnRenamed("rid", "rep")
    sets = mapped(texts, _gram_sets(words), "grams binary", ["cluster", "rep", "copies", "block", "blocks"])
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "rep", "copies", "block", "grams"
    )
    dealt = met.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    verified = materialise(dealt.mapInArrow(_verifier(threshold), "rep long, n_links long, n_linked long, star long"))

    counts = verified.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked").alias("n_linked"))
    roots = components(verified.select(F.col("rep").alias("u"), F.col("star").alias("v"))).select(F.col("node").alias("rep"), "root")
    rooted = classes.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialise(rooted)
    tops = rooted.groupBy("root").agg(
        F.min("first_id").alias("class_id"), F.min_by("first_rid", F.coalesce("first_id", F.lit((1 << 63) - 1))).alias("keep_rid")
    )
    known = rooted.join(tops, "root").select("d1", "d2", "class_id", "keep_rid", "n_links", "n_linked", "n_copies")
    found = sketched.select("rid", "d1", "d2").join(known, ["d1", "d2"]).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    # With kept as a column of its own, a filter on it adds no key to the join below, which would move the texts.
    found = materialise(found.drop("d1", "d2", "keep_rid"))
    release(sketched, classes, shared, clusters, verified, rooted)
    out = staged.select("rid", "row").join(found, "rid")
    zero = F.lit(0).cast("long")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], "class_id", F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_linked", zero).alias("n_linked"), "n_copies", "kept",
    )
