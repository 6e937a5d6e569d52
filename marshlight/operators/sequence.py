"""Order-dependent operators that never put a whole key into one task.

A long sequence is cut into chunks of its order column. Ranks and running sums are taken inside
each chunk and shifted by the totals of the earlier chunks (one small row per chunk); the first row
of a chunk is lent to the chunk before it, and time-range frames copy a halo into the next chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def positions(df: DataFrame, keys: list[str], order: str, size: int = CHUNK) -> DataFrame:
    """Add the contiguous 0-based ``pos`` and the length ``n`` per key; the order column may have gaps."""
    cut = df.withColumn("_chunk", F.floor(F.col(order) / size))
    per = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n"),
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        cut.withColumn("_rn", F.row_number().over(within) - 1)
        .join(shift, [*keys, "_chunk"])
        .withColumn("pos", (F.col("_rn") + F.col("_start")).cast("long"))
        .drop("_rn", "_start", "_chunk")
    )


def with_next(df: DataFrame, keys: list[str], columns: dict[str, str], wrap: bool, size: int = CHUNK) -> DataFrame:
    """Add ``{new: column}`` values of the next position (needs ``pos`` and ``n``).

    The first row of every chunk is also copied to the end of the chunk before it; with ``wrap``
    the first row of the key follows its last one.
    """
    pos, n = F.col("pos"), F.col("n")
    own = F.struct(F.floor(pos / size).alias("chunk"), pos.alias("at"), F.lit(True).alias("own"))
    guest = F.struct(
        F.floor(F.when(pos == 0, n - 1).otherwise(pos - 1) / size).alias("chunk"),
        F.when(pos == 0, n).otherwise(pos).alias("at"), F.lit(False).alias("own"),
    )
    lends = (pos % size == 0) & (F.lit(wrap) | (pos > 0))
    copies = df.withColumn("_c", F.explode(F.when(lends, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy(*keys, "_c.chunk").orderBy("_c.at")
    return copies.withColumns({new: F.lead(c).over(order) for new, c in columns.items()}).where("_c.own").drop("_c")


def with_neighbours(df: DataFrame, keys: list[str], columns: list[str], size: int = CHUNK) -> DataFrame:
    """Add ``prev_*`` and ``next_*`` of the columns by ``pos``; null at the two ends of a key."""
    pos = F.col("pos")
    place = lambda chunk, own: F.struct(chunk.alias("chunk"), F.lit(own).alias("own"))
    home = F.floor(pos / size)
    spots = F.filter(
        F.array(
            place(home, True),
            F.when((pos % size == 0) & (pos > 0), place(home - 1, False)),
            F.when(pos % size == size - 1, place(home + 1, False)),
        ),
        lambda x: x.isNotNull(),
    )
    order = Window.partitionBy(*keys, "_c.chunk").orderBy("pos")
    made = {f"prev_{c}": F.lag(c).over(order) for c in columns} | {f"next_{c}": F.lead(c).over(order) for c in columns}
    return df.withColumn("_c", F.explode(spots)).withColumns(made).where("_c.own").drop("_c")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], totals: dict[str, str] = {}, size: int = CHUNK) -> DataFrame:
    """Add inclusive running sums ``{new: column}`` per key, by an integer order column.

    ``totals`` adds ``{new: column}`` sums over the whole key, and ``is_last`` marks the key's last
    row; the chunk table gives both for free.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / size))
    parts = {f"_o_{n}": c for n, c in sums.items()} | {f"_w_{n}": c for n, c in totals.items()}
    per = cut.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(n) for n, c in parts.items()], F.max(order).alias("_end"))
    whole = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_w_{n}").over(whole).alias(n) for n in totals],
        F.max("_end").over(whole).alias("_end"),
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    out = out.join(shift, [*keys, "_chunk"]).withColumn("is_last", F.col(order) == F.col("_end"))
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_chunk", "_end", *[f"_o_{n}" for n in sums])


def trailing_frame(
    df: DataFrame, keys: list[str], seconds: str, width: int, aggs: dict[str, Column], chunk: int | None = None,
) -> DataFrame:
    """Aggregates over ``(t - width, t]`` per key, with whole-second times.

    Chunks are ``chunk`` seconds long (default ten widths); every row is also copied, as halo, to
    the next chunk when it is within one width of it.
    """
    chunk = chunk or 10 * width
    at = F.col(seconds)
    spread = F.explode(F.sequence(F.floor(at / chunk), F.floor((at + width - 1) / chunk)))
    copies = df.withColumn("_chunk", spread).withColumn("_own", F.col("_chunk") == F.floor(at / chunk))
    frame = Window.partitionBy(*keys, "_chunk").orderBy(seconds).rangeBetween(-(width - 1), 0)
    return copies.withColumns({n: c.over(frame) for n, c in aggs.items()}).where("_own").drop("_own", "_chunk")
