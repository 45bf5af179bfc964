"""The registered queries of the operators and the pipeline on the small tables."""

import os

import pytest

import corpus_pipeline
from reconcile.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op2_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"}, "op4_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op6_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_centroid_clustering": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    assert found.count() and COLUMNS.get(name, set()) <= set(found.columns)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            if name != "mixing":
                assert after.exceptAll(docs).isEmpty()
            docs = spark.createDataFrame(after.collect(), after.schema)
    assert after.count() == docs.count()
