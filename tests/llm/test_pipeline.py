"""The pipeline: each stage returns the columns of its input, and the whole equals the operators one after another."""

from pyspark.sql import functions as F

import corpus_pipeline
from hearken.llm import simhash
from hearken.llm.queries import QUERIES, SQL


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out.checkpoint()
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    key = lambda d: sorted((r.doc_id, r.n_ids) for r in d.select("doc_id", "n_ids").collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert docs.join(labels.filter("quality = 0"), "doc_id").count() == 0
    assert docs.dropDuplicates(["doc_id"]).groupBy("text").count().filter("count > 1").count() == 0
    fps = simhash.fingerprints(docs.dropDuplicates(["doc_id"]))
    assert fps.select("fp").distinct().count() == fps.count()


def test_registered_queries(spark, sf_dir):
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == 10
    for name in ("op3_warc", "op6_exact_dedup", "op7_mixing"):
        assert QUERIES[name](spark, sf_dir).agg(F.count(F.lit(1))).first()[0] > 0
