"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a key of two numbers: ``hi``, 32 bits (the CRC of the text, so copies stand
together) and ``lo``, 64 bits (the id). Exact bytes are counted below candidate boundaries, 256 of them
within each interval that still holds an unsettled splitter; a splitter is settled when a candidate lies
within the tolerance of its target, else the one interval around it is probed again, 8 bits of the key
deeper. Intervals never overlap, so a round reads the narrow key table once and sends 256 counts for
each unsettled splitter to the driver: bounded by the number of parts, not by the rows. One very
frequent ``hi`` is split by ``lo`` in the rounds that follow. At the end rows are exchanged once, by part.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialise import materialise, release

HI_BITS, LO_BITS, STEP = 32, 64, 8
BITS = HI_BITS + LO_BITS
_SIGN = 1 << 63


@dataclass(frozen=True)
class Splitters:
    """``keys[i]`` is the first key of part ``i + 1``; ``below[i]`` the exact bytes before it."""

    keys: list[int]
    below: list[int]
    total: int
    rounds: int


def _unsigned(lo: Column) -> Column:
    """Same order as the signed ``lo`` when its bits are read as an unsigned number."""
    return lo.bitwiseXOR(F.lit(-_SIGN))


def _digits(level: int) -> tuple[Column, Column, Column]:
    """Bits of the key before the level's digit, as (hi part, lo part), and the digit."""
    done = level * STEP
    if done < HI_BITS:
        left = HI_BITS - done
        return F.shiftright("hi", left), F.lit(0).cast("long"), F.shiftright("hi", left - STEP).bitwiseAND(F.lit(255))
    left = LO_BITS - (done - HI_BITS)
    lo = _unsigned(F.col("lo"))
    before = F.lit(0).cast("long") if left == LO_BITS else F.shiftrightunsigned(lo, left)
    return F.col("hi"), before, F.shiftrightunsigned(lo, left - STEP).bitwiseAND(F.lit(255))


def _split(prefix: int, level: int) -> tuple[int, int]:
    """A prefix of ``level`` digits as the two numbers that ``_digits`` gives rows."""
    done = level * STEP
    return (prefix, 0) if done <= HI_BITS else (prefix >> (done - HI_BITS), prefix & ((1 << (done - HI_BITS)) - 1))


def local(spark, rows: list[dict], fields: str) -> DataFrame:
    """A small table from literal values; ``fields`` as within ``struct<...>``."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _counts(keys: DataFrame, level: int, active: set[int]) -> dict[int, dict[int, int]]:
    """Exact bytes for each digit value inside each active prefix."""
    a, b, digit = _digits(level)
    rows = keys.select(a.alias("a"), b.alias("b"), digit.alias("digit"), "size")
    if level:
        rows = rows.join(F.broadcast(local(keys.sparkSession, [dict(zip("ab", _split(p, level))) for p in sorted(active)], "a:bigint,b:bigint")), ["a", "b"])
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("a", "b", "digit").agg(F.sum("size").alias("size")).collect():
        done = max(0, level * STEP - HI_BITS)
        out.setdefault((r["a"] << done) | r["b"], {})[r["digit"]] = r["size"]
    return out


def find_splitters(keys: DataFrame, parts: int, tolerance: float) -> Splitters:
    """``parts - 1`` boundaries of the rows (hi, lo, size), each within ``tolerance`` of a part's even size.

    Where no boundary is that near, because one row or repeated rows of one key are larger, it is the
    nearest there is.
    """
    found: dict[int, tuple[int, int]] = {}
    best: dict[int, tuple[int, int]] = {}
    open_: dict[int, list[int]] = {0: list(range(1, parts))}
    base, total, level = {0: 0}, 0, 0
    while open_ and level * STEP < BITS:
        counts = _counts(keys, level, set(open_))
        if level == 0:
            total = sum(counts.get(0, {}).values())
            best = {i: (0, 0) for i in range(1, parts)}
        slack = tolerance * total / parts
        deeper: dict[int, list[int]] = {}
        shift, nexts = BITS - (level + 1) * STEP, {}
        for prefix, targets in open_.items():
            at, below, sums = [], [], base[prefix]
            for digit in range(256):
                at.append(((prefix << STEP) | digit) << shift)
                below.append(sums)
                sums += counts.get(prefix, {}).get(digit, 0)
            at.append(((prefix << STEP) + 256) << shift)
            below.append(sums)
            for i in targets:
                want = total * i / parts
                j = bisect_left(below, want)
                for k in (j - 1, j):
                    if 0 <= k <= 256 and abs(below[k] - want) < abs(best[i][1] - want):
                        best[i] = (at[k], below[k])
                if abs(best[i][1] - want) <= slack:
                    found[i] = best[i]
                elif j:
                    inner = (prefix << STEP) | (j - 1)
                    deeper.setdefault(inner, []).append(i)
                    nexts[inner] = below[j - 1]
        open_, base, level = deeper, nexts, level + 1
    best |= found
    order = [best[i] for i in range(1, parts)]
    return Splitters([k for k, _ in order], [b for _, b in order], total, level)


def _part(spark, splitters: Splitters) -> tuple[DataFrame, Column]:
    """A table of the first key byte with the splitters inside it, and the part of a row joined to it.

    The table has 256 rows and as many splitters in all as there are parts.
    """
    first = BITS - STEP
    cells = []
    for cell in range(256):
        low, high = cell << first, (cell + 1) << first
        inside = [k for k in splitters.keys if low < k < high]
        start = sum(k <= low for k in splitters.keys)
        pairs = [{"h": k >> LO_BITS, "l": (k & ((1 << LO_BITS) - 1)) - _SIGN} for k in inside]
        cells.append({"cell": cell, "start": start, "inside": pairs})
    grid = local(spark, cells, "cell:int,start:int,inside:array<struct<h:bigint,l:bigint>>")
    reached = F.filter("inside", lambda s: (s["h"] < F.col("hi")) | ((s["h"] == F.col("hi")) & (s["l"] <= F.col("lo"))))
    return grid, F.col("start") + F.size(reached)


def histogram_shards(
    rows: DataFrame, hi: Column, lo: Column, size: Column, shards: int, tolerance: float = 0.001, rows_per_part: int = 100_000
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1, near-equal sums of ``size``) and ``slot`` (0, 1, ... in the shard).

    ``hi`` is a number of 32 bits, ``lo`` any long; null counts as 0, as does a null size. Shards are runs
    of the order by (hi, lo), so rows of one ``hi`` share a shard, or two neighbours where a boundary falls
    among them, or more where they exceed one shard. Each shard is dealt in as many parts as keep a part
    near ``rows_per_part`` rows, so no task holds a shard. Rows equal in (hi, lo) are taken in order of
    their size and stay in one part. An empty table gives an empty result. Columns of ``rows`` named
    like those added are replaced.
    """
    spark = rows.sparkSession
    named = F.struct(
        F.coalesce(hi.cast("long"), F.lit(0)).alias("hi"), F.coalesce(lo.cast("long"), F.lit(0)).alias("lo"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
    )
    keys = materialise(rows.select(named.alias("k")).select("k.*"))
    n = keys.count()
    per_shard = max(1, -(-n // (shards * rows_per_part)))
    splitters = find_splitters(keys, shards * per_shard, tolerance)
    grid, part = _part(spark, splitters)

    def placed(df: DataFrame) -> DataFrame:
        cell = F.shiftright("hi", HI_BITS - STEP).cast("int")
        return df.withColumn("cell", cell).join(F.broadcast(grid), "cell").withColumn("part", part)

    filled = {r["part"]: r["n"] for r in placed(keys).groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, seen = [], 0
    for p in range(shards * per_shard):
        seen = 0 if p % per_shard == 0 else seen
        first.append({"part": p, "shard": p // per_shard, "before": seen})
        seen += filled.get(p, 0)
    release(keys)
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = placed(rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), named.alias("k")).select("row", "k.hi", "k.lo", "k.size"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("hi", "lo", "size"))
    ranked = keyed.select("row", "part", "hi", "lo", "size").withColumn("rank", rank)
    places = local(spark, first, "part:int,shard:int,before:bigint")
    done = ranked.join(F.broadcast(places), "part").select("row", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """Documents with size, text_crc32, shard and slot; texts that are equal stand side by side.

    A null text has no bytes. Rows that repeat an id are rows like any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.drop("size", "text_crc32").withColumns(
        {"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary"))}
    )
    return histogram_shards(sized, F.col("text_crc32"), F.col("doc_id"), F.col("size"), shards, **options)
