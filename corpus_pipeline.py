"""From documents to training tokens, in stages that each use one operator of ``marshlight.llm``.

A stage takes what its predecessor kept and returns the columns of ``documents`` (the last one tokens).
Null texts count as empty and are not toxic, equal to other empty texts, and without tokens.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm import bpe, decontamination, exact_dedup, jaccard, toxicity
from marshlight.llm.common import table
from marshlight.llm.queries import toxicity_model
from marshlight.operators.materialise import live_paths, materialise, release_paths

_left: set[str] = set()


def stage(function):
    """A stage that first removes what the stage before left: its result has been written by then."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(spark, _left & live_paths())
        _left.clear()
        before = live_paths()
        out = function(spark, docs, sf_dir)
        _left.update(live_paths() - before)
        return out

    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic."""
    scored = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(docs.columns)


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space apart, the one with the smallest doc_id."""
    return exact_dedup.exact_duplicates(docs).where("kept").select(docs.columns)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word runs, directly or in steps, the one with the smallest doc_id."""
    return jaccard.similar_documents(docs).where("kept").select(docs.columns)


@stage
def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (decimal, joined by one space) and the digest of the text decoded from them."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])
    return coded.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


#: (name, function of (spark, documents, sf_dir)), in order.
STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("BPE encoding and decoding", tokens),
]

#: Trained scores, alignments and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
