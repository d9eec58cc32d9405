"""The registered queries of this package: thin, over whole tables, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, binary_search, centroids, fingerprints, language_id, mixing, ngram_join, packing, pii, quality, simhash, suffix_dedup, url_filters
from ._shared import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return binary_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


_QUERIES = (
    op1_url_filters, op2_ngram_join, op3_fingerprints, op4_suffix_dedup, op5_quality, op6_language_id, op7_pii, op8_packing, op9_mixing,
    op10_binary_search, op11_alignment, op12_simhash, op13_centroids,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {
        "op1_url_filters": url_filters.ORACLE_SQL, "op2_ngram_join": ngram_join.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL,
        "op10_binary_search": binary_search.ORACLE_SQL, "op13_centroids": centroids.ORACLE_SQL,
    }
