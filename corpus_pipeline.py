"""The corpus pipeline: five stages over `documents`, each one of the numbered operators, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns it was given; the last returns the documents as its token files hold
them. Null texts, empty tables and further columns are treated as the operators say; a row repeated in the input, or by the mix, stays a row of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from creditloom.llm.decontaminate import remove_contaminated
from creditloom.llm.mixing import mixed_documents
from creditloom.llm.near_duplicates import keep_representatives
from creditloom.llm.queries import fold
from creditloom.llm.shared import Steps, documents
from creditloom.llm.token_files import read_token_files, write_token_files
from creditloom.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return remove_toxic(docs, documents(spark, sf_dir, "labels"), fold(5, 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return remove_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of what is left, and what they hold per document."""
    target = Steps(spark, "pipeline-ids").folder
    write_token_files(docs, target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, target)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token-files", token_files)]

#: A trained classifier and a tokenizer stand in the chain, so SQL can't express it; tests/llm compares every stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = steps.write(f"{k}-{name}", stage(spark, docs, sf_dir))
        if k:
            steps.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
