"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, clusters, hmm, licenses, mixing, quality_pu, quality_rules, sharding, simhash, syncmers, toxicity, vector_codes, warc
from marlstone.llm.common import documents, labels


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digest(documents(spark, sf_dir))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_hmm, op2_bpe, op3_quality_pu, op4_warc, op5_simhash, op6_syncmers, op7_toxicity, op8_licenses, op9_quality_rules, op10_mixing, op11_sharding, op12_vector_codes, op13_clusters)}

ORACLE_SQL = {"op8_licenses": licenses.oracle_sql(), "op12_vector_codes": vector_codes.oracle_sql(), "op13_clusters": clusters.oracle_sql()}
