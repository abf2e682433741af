"""Registered queries of the numbered operators, and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.centroids import cluster_report, cluster_vectors
from creditloom.llm.decontaminate import find_contamination
from creditloom.llm.language import identify
from creditloom.llm.mixing import mix_sources
from creditloom.llm.near_duplicates import group_near_duplicates
from creditloom.llm.periodic_runs import find_runs, run_digests
from creditloom.llm.pii import find_personal_data
from creditloom.llm.quality import judge_quality
from creditloom.llm.secret_links import find_secrets
from creditloom.llm.shared import Steps, documents
from creditloom.llm.sql import SQL  # noqa: F401
from creditloom.llm.token_counts import count_tokens
from creditloom.llm.token_files import read_token_files, write_token_files
from creditloom.llm.toxicity import score_toxicity
from creditloom.llm.warc import read_captures, write_archives


def fold(n: int, of: int) -> Column:
    """Rows that a model is not to learn from: crc32 of the id's text leaves `of` when divided by `n`."""
    return F.crc32(F.col("doc_id").cast("string")) % n == of


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(documents(spark, folder))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(documents(spark, folder), fold(4, 2))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return group_near_duplicates(documents(spark, folder))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(documents(spark, folder), documents(spark, folder, "labels"), fold(5, 0))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(documents(spark, folder))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(documents(spark, folder))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = Steps(spark, "token-files").folder
    write_token_files(documents(spark, folder), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, target)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(documents(spark, folder), documents(spark, folder, "benchmark")).drop("items")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(documents(spark, folder)).withColumn("failed", F.concat_ws(",", "failed"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    return run_digests(find_runs(documents(spark, folder), repeat_column=F.when(h % 10 == 0, F.floor(h / 10))))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    members, centroids, _ = cluster_vectors(documents(spark, folder, "embeddings"), clusters=40, rounds=5)
    return cluster_report(members, centroids)


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    target = Steps(spark, "archives").folder
    # `pages` has no capture time; a year's second drawn from the id stands in for it.
    write_archives(documents(spark, folder, "pages"), target, captured=1704067200 + F.crc32(F.col("page_id").cast("string")) % 31536000)
    return read_captures(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroids": op12_centroids,
    "op13_warc": op13_warc,
}

