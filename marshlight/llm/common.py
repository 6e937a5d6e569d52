"""What several operators share: text columns, slices of Arrow batches, hashing of bytes in numpy."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that one numpy step works on; its arrays are a few dozen times as large.
PIECE_BYTES = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts hold ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column in one array, and the n + 1 offsets of its rows; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
        column = pc.fill_null(column, "")
    else:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lists_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Each 64-bit value well mixed (a splitmix64 step after adding the seed)."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed; one object serves a task."""

    def __init__(self):
        self.up = self.down = np.zeros(0, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of any substrings of a byte array, from one running polynomial sum modulo 2**64."""

    def __init__(self, raw: np.ndarray, powers: Powers):
        up, self.down = powers.to(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U64)
        step = raw.astype(U64)
        step += U64(1)
        step *= up[:-1]
        np.cumsum(step, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def all_of(self, length: int) -> np.ndarray:
        """Of every substring of one length, by start."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.down[: len(out)]
        return mixed(out)


#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A to Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Every ASCII byte but letters and digits: words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_bounds(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of each row, and the n + 1 offsets of the rows in the list of words."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~gap[raw]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True  # a row starts or ends here
    word = inside[1:]
    before = inside[:-1]
    starts = np.flatnonzero(word & (~before | fresh))
    ends = np.flatnonzero(before & (~word | fresh))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, powers: Powers, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows (bytes of ``gap`` apart, A-Z in lower case), and the rows' offsets."""
    raw, offsets = joined_bytes(column)
    raw = LOWER[raw]
    starts, ends, rows = word_bounds(raw, offsets, gap)
    return Rolling(raw, powers).of(starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, by row; a row of 1 to n - 1 words has one, of all its words."""
    counts = np.diff(rows)
    m = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(m)])
    first = np.repeat(rows[:-1], m) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], m)
    size = np.repeat(np.minimum(counts, n), m)
    out = mixed(size.astype(U64))
    for k in range(n):
        have = size > k
        if have.all():
            out = mixed(out * U64(3) + words[first + k])
        else:
            out[have] = mixed(out[have] * U64(3) + words[first[have] + k])
    return out, offsets


class Shared:
    """A broadcast value whose classes travel with it: workers need not be able to import this package."""

    def __init__(self, spark: SparkSession, value):
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._held.value)

    def unpersist(self) -> None:
        self._held.unpersist()


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, across its tasks. Whoever fills it bounds it."""
    held = sys.modules.setdefault("marshlight_worker_cache", types.ModuleType("marshlight_worker_cache"))
    return held.__dict__.setdefault(name, {})


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], added: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``df`` with columns computed from whole texts in Arrow slices; null is an empty text.

    ``make`` is called once in a task and gives a function of a text column that returns the ``added``
    columns (DDL). ``keep`` names the columns that stay (all); those named like added ones are replaced.
    """
    fields = T.StructType.fromDDL(added)
    names = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_or_empty(text).alias("text"))
    schema = T.StructType([inner.schema["row"], *fields])

    def run(batches):
        f = make()
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("row"), *f(piece.column("text"))], names=schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *fields.names)
