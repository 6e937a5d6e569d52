"""The pipeline: each stage's decisions take effect, on awkward rows too."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as pipeline  # noqa: E402
from cases import awkward  # noqa: E402

from marshlight.llm import decontamination, queries  # noqa: E402
from marshlight.operators.materialise import materialise  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in queries.QUERIES["op4_toxicity"](spark, SF).where("predicted = 1").collect()}
    before = ids(docs)
    for (name, stage), drops in zip(pipeline.STAGES, (toxic, None, None, None, set())):
        after = materialise(stage(spark, docs, SF))
        left = ids(after)
        assert left <= before
        if drops is not None:
            assert before - left == drops, name
        if name == "exact dedup":
            assert after.selectExpr("regexp_replace(text, '[\\\\x20\\\\x09-\\\\x0D]+', ' ') t").distinct().count() == after.count()
        if name == "benchmark decontamination":
            bad = decontamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert before - left == ids(bad)
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs, before = after, left
    assert docs.where("n_tokens is null or ids is null").count() == 0


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert after.where("doc_id = 4 or doc_id = 5").count() >= 1
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_is_the_last_stage(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"] and out.count() > 50
