"""From raw documents to a training mixture, one stage per operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldkin.llm import exact, language, mixing, simhash, winnowing
from fieldkin.llm.common import table
from fieldkin.session import shared_directory


#: Words of a shingle and most differing bits of a link, as op10_simhash_near_dedup has them.
SHINGLE, BITS = 3, 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter are in no language and go."""
    return language.with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact.without_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHashes (3-word shingles) linked at 2 or fewer bits the smallest doc_id stays."""
    return simhash.without_near_copies(docs, shingle=SHINGLE, errors=BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words, or more, in benchmark windows go."""
    return winnowing.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once for each epoch they are read in."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", source_mixing),
]

#: Learned languages and SimHash can't be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_directory(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
