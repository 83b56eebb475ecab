"""Every stage of the pipeline on the small tables."""

import pytest

pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [k for k, _ in p.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources"]
    for n, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, d).cache()
        now = [r[0] for r in out.select("doc_id").collect()]
        assert set(now) <= ids and len(now) == len(set(now)) and now
        if n < len(p.STAGES) - 1:
            assert out.columns == columns
        docs, ids = out, set(now)
    assert docs.where("taken < size").count() == 0


def test_empty_documents(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, d).count() == 0
