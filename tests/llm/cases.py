"""Tables of awkward rows that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame

#: Names that operators use inside or add; as input columns they must do no harm.
CLASHES = (
    "row rid body rest grp chunk ended keep_id group_size kept text_sha256 rep band cluster class_id n_links n_copies d1 d2 root "
    "score held_out n_tokens n_known base_score ids decoded size text_crc32 shard slot part cell hi lo key no n_bytes n_removed "
    "n_spans spans base_spans n_assign n_access n_hex text_key item_id word_start gram words host path rule verdict chars _id toxic"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def sentence(rng: random.Random, words: int) -> str:
    stock = ["river", "delta", "the", "of", "Stone", "heron", "reed", "and", "lake", "mud,", "fish.", "swamp", "otter", "to"]
    return " ".join(rng.choice(stock) + rng.choice(["", "", "er", "ing"]) for _ in range(words))


def awkward_rows() -> list[tuple]:
    rng = random.Random(4)
    base = sentence(rng, 60)
    long = " ".join(sentence(rng, 30) + f" n{k}" for k in range(1200))
    texts = [
        (1, base), (2, base), (2, base), (3, base.replace("river", "creek", 1)), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "One"),
        (9, long), (10, long + " more"), (None, base), (None, None), (None, "only words here"), (11, "same id one way"), (11, "same id another way of it"),
        (12, "x" * 250), (13, "ΑΣ ﬁ é 👍🏽 \u00a0 日本語 " * 9), (14, base + " " + sentence(rng, 60)), (15, base.upper()), (16, "a b c d e"), (17, "a b c d"),
        (-3, "a  b\tc\nd e"), (1 << 40, base + "\n"),
    ]
    return [(i, t, None, "s", None, *["x"] * len(CLASHES)) for i, t in texts]


def awkward(spark) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows over three partitions."""
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def words_of(text: str | None) -> list[str]:
    """Words apart by space and 0x09 to 0x0D, A-Z in lower case."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)
