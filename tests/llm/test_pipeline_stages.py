"""The corpus pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from textmill.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= left
        if name in ("secret_scans", "best_fit_packing"):
            assert now == left
        if name != "best_fit_packing":
            assert docs.columns == columns
        left = now
    assert len(corpus_pipeline.STAGES) == 5 and 100 < len(left) < len(texts)
    kept = [" ".join(texts[i].lower().split()) for i in left]
    assert len(set(kept)) == len(kept)
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
