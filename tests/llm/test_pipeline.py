"""The pipeline against its stages said plainly."""

import re

from helpers import empty_documents, odd_documents
from pyspark.sql import functions as F
from test_near_jaccard import slow_groups, slow_set

import corpus_pipeline
from strandmill.llm import mixing, quality

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "simhash", "mixing", "byte_bpe"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    rejected = {r.doc_id for r in quality.op9_quality(spark, SF).filter("predicted = 0").collect()}
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected and rejected
    exact = stages["exact_dedup"](spark, good, SF).cache()
    least = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(least.values())
    near = stages["simhash"](spark, exact, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in exact.collect())
    groups, kept = slow_groups([t for _, t in rows]), {}
    for i, t in rows:
        kept.setdefault(groups[slow_set(t)], i)
    assert len(kept) < len(rows)
    assert sorted(r.doc_id for r in near.collect()) == sorted(kept.values())
    mixed = stages["mixing"](spark, near, SF).cache()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix(near).filter("mixing.sampled").collect())
    for stage in (good, exact, near, mixed):
        assert stage.columns == docs.columns
    last = stages["byte_bpe"](spark, mixed, SF)
    assert last.count() == mixed.count() and last.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, run.collect())) == sorted(map(str, last.collect()))


def test_edges(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name not in ("mixing", "byte_bpe"):
                assert docs.columns == columns
        docs.collect()
