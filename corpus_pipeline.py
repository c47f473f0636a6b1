"""A training-data pipeline over `documents`; each stage is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.bpe import encoded
from tideline.llm.common import discard, table, written
from tideline.llm.mixing import mixed
from tideline.llm.pii import pseudonymised
from tideline.llm.simhash import kept_documents
from tideline.llm.toxicity import clean_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, predicts toxic go."""
    return clean_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return kept_documents(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms within its format."""
    return pseudonymised(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated, at most twice, to tempered weights; every document stays at least once."""
    return mixed(docs).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of their decoding."""
    return encoded(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The fitted classifier, XXH64 with a seed and the merges aren't expressible in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents through the stages; a stage's table is removed once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return docs
