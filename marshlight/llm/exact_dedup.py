"""Exact duplicates by radix partitioning from the most significant byte.

All documents start as one group. A round splits every group by the next run of bytes of its members;
groups of one are done, groups whose members have ended are copies, the others go on with the bytes that
are left. The runs grow fourfold, so a text of n bytes takes about log4(n / 64) rounds, and a round carries
only documents that still share all bytes so far. Equality is of the bytes themselves; the digest of
the result is only reported.

A round counts its groups with partial sums on each partition and joins the counts back; a run shared
by a third of all rows is a skewed side of an inner join, which Spark splits at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise, release
from .common import text_or_empty

FIRST_RUN, GROWTH = 64, 4
LAST = (1 << 63) - 1


def normalised(col: str = "text"):
    """The text with each run of space and 0x09 to 0x0D as one space; null is empty."""
    return F.regexp_replace(text_or_empty(col), r"[\x20\x09-\x0D]+", " ")


def radix_groups(rows: DataFrame) -> DataFrame | None:
    """Groups of two or more equal ``body`` (binary) among rows of (rid, doc_id, body), rid unique.

    Gives (rid, keep_id, keep_rid, group_size) for members only; ``keep_rid`` is the row with the smallest
    doc_id (a null one counts as the largest). None when there are no rows.
    """
    alive = rows.select("rid", "doc_id", F.lit(0).cast("long").alias("grp"), F.col("body").alias("rest"))
    run, done = FIRST_RUN, None
    while True:
        ended = F.length("rest") <= run
        keyed = alive.withColumns({"chunk": F.substr("rest", F.lit(1), F.lit(run)), "ended": ended})
        # Written, and joined by sorting at any size, so that Spark can split a frequent run among tasks.
        groups = materialise(keyed.groupBy("grp", "chunk", "ended").agg(
            F.count("*").alias("group_size"), F.min("rid").alias("next"), F.min("doc_id").alias("keep_id"),
            F.min_by("rid", F.coalesce("doc_id", F.lit(LAST))).alias("keep_rid"),
        ).where("group_size > 1"))
        rest = F.when(~F.col("ended"), F.substr("rest", F.lit(run + 1), F.length("rest")))
        split = materialise(
            keyed.join(groups.hint("merge"), ["grp", "chunk", "ended"])
            .select("rid", "doc_id", F.col("next").alias("grp"), rest.alias("rest"), "ended", "group_size", "keep_id", "keep_rid")
        )
        found = split.where("ended").select("rid", "keep_id", "keep_rid", "group_size")
        done = found if done is None else done.union(found)
        alive = split.where("not ended").select("rid", "doc_id", "grp", "rest")
        release(groups)
        if alive.isEmpty():
            return done
        run *= GROWTH


def exact_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents with keep_id, group_size, kept and text_sha256 (of the normalised text, lowercase hex).

    Of equal texts the row with the smallest doc_id is kept, of rows that repeat this id one. A null text
    equals an empty one. A null doc_id counts as the largest; ``keep_id`` is null where all are null. An
    empty table gives an empty result. ``keep`` names the columns that stay (all); columns named like
    those added are replaced.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    body = normalised().cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"),
    )
    rows = rows.withColumn("text_sha256", F.sha2("body", 256))
    # The text is written once: normalised, or as it is in the row where that keeps it.
    if "text" in names:
        staged = materialise(rows.drop("body")).withColumn("body", normalised("row.text").cast("binary"))
    else:
        staged = materialise(rows)
    groups = radix_groups(staged.select("rid", "doc_id", "body"))
    out = staged.drop("body").join(groups, "rid", "left")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
