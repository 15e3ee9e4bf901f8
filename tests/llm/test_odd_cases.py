"""Every operator on odd rows and on empty tables: no crash, one row per document where that is the contract."""

import pytest
from llm.conftest import frame

import corpus_pipeline
from cohortlens.llm.context_tree import context_tree_scores
from cohortlens.llm.cotraining import cotrained_scores
from cohortlens.llm.decontamination import contaminated
from cohortlens.llm.jaccard_join import jaccard_components
from cohortlens.llm.license_scan import license_scan
from cohortlens.llm.mixing import mix_to_targets, quality_domains
from cohortlens.llm.quality_rules import quality_rules
from cohortlens.llm.sharding import kd_shards
from cohortlens.llm.suffix_dedup import suffix_dedup
from cohortlens.llm.wrapper_induction import extract_pages

LABELS = "doc_id bigint, quality int, toxic int, score string"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def run_all(spark, docs, labels, benchmark):
    return {
        "cotraining": cotrained_scores(docs, labels),
        "license": license_scan(docs),
        "jaccard": jaccard_components(docs),
        "mixing": mix_to_targets(docs, quality_domains(labels), {"high": 0.7, "low": 0.3}),
        "sharding": kd_shards(docs),
        "context_tree": context_tree_scores(docs),
        "suffix": suffix_dedup(docs),
        "quality": quality_rules(docs),
    }


def test_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    labels = labels_of(spark, [(1, 1, 0, ""), (1, 0, 0, ""), (7, 0, 1, ""), (None, 1, 1, ""), (9, None, None, ""), (99, 1, 0, "")])
    benchmark = spark.createDataFrame(
        [(1, odd_rows[0][1], 0.5), (1, odd_rows[0][1], 0.5), (2, None, 0.1), (3, "one", 0.1), (None, "a b", 1.0)],
        "item_id bigint, text string, coverage double",
    )
    for name, out in run_all(spark, docs, labels, benchmark).items():
        assert out.count() == len(odd_rows), name
    hits = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()}
    assert hits == {(1, 1), (2, 1), (3, 1), (7, 3)}


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x")]).filter("doc_id < 0")
    labels = labels_of(spark, [(1, 1, 0, "")]).filter("doc_id < 0")
    benchmark = spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    for name, out in run_all(spark, docs, labels, benchmark).items():
        assert out.count() == 0, name
    assert contaminated(docs, benchmark).count() == 0
    some = frame(spark, [(1, "a b c d e f"), (2, None)])
    assert contaminated(some, benchmark.filter("item_id < 0")).count() == 0
    assert {r["score"] for r in cotrained_scores(some, labels).collect()} == {0.5}
    pages = spark.createDataFrame([(1, "u", "h")], "page_id bigint, url string, html string")
    assert extract_pages(pages.filter("page_id < 0")).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a.example/x", ""), (2, "http://a.example/x", ""), (None, "x", "<p>t"), (3, "//h/", "<<p <b>x</q>")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = extract_pages(pages).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["text"] for r in got if r["page_id"] is None] == ["t"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd_rows, name, stage, tmp_path):
    docs = frame(spark, odd_rows)
    labels_of(spark, [(1, 1, 0, ""), (7, 0, 0, "")]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "p q r s t u v w")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() <= len(odd_rows)
    assert stage(spark, docs.filter("n_chars < 0"), str(tmp_path)).count() == 0
