"""The pipeline: each stage's decisions against its operator and brute force, whole tables in and out."""

import corpus_pipeline
from helpers import documents, edge_rows
from test_pairs import brute_links
from test_texts import check_packing
from vekta.llm import language_id, quality_rules


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, sf).cache()
    rejected = language_id.identify(docs, language_id.learn(docs)).where("rejected")
    assert known.columns == docs.columns and known.count() == docs.count() - rejected.count()
    good = stage["quality"](spark, known, sf).cache()
    ratios = quality_rules.fit_ratios(known, quality_rules.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet")))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality_rules.judge(known, ratios).where("kept").collect())
    one = stage["near_duplicates"](spark, good, sf).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c, _ in brute_links(rows)})
    packed = stage["pack"](spark, one, sf).collect()
    check_packing([(r.doc_id, r.text) for r in one.collect()], packed)
    assert sorted(r.length for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.length for r in packed)


def test_edge_rows_go_through(spark, sf):
    docs = documents(spark, edge_rows())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        docs.count()
    assert {r.doc_id for r in docs.collect()} <= {5, 9}


def test_no_rows_stay_no_rows(spark, sf):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_other_columns_pass_through(spark, sf):
    names = ["letters", "rid", "comp", "n", "sig", "t_id", "row"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *[f"doc_id * 2 AS {n}" for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() and not docs.where(" OR ".join(f"{n} != doc_id * 2" for n in names)).count()
