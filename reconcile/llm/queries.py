"""The queries of the operators: thin calls over whole tables, with the columns that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.llm import (
    clusters, decontaminate, language, lines, mixing, neighbours, ngram_join, page_text, quality, secret_scan, sharding, spelling, sql, urls,
)
from reconcile.llm.storage import table

QUERIES = {}
ORACLES: dict[str, str] = {
    "op11_spelling_variants": sql.SPELLING,
    "op12_centroid_clustering": sql.CLUSTERS,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


def may_learn():
    """Rows that language identification may learn from; the others are held out."""
    return remainder() != 1


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "documents"))


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    return language.with_language(docs, may_learn()).select("doc_id", held_out, "language.lang_pred", "language.score")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))
