"""Corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents the stage
before it kept; between stages the documents are a Parquet table in the shared
folder.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartflow.llm import mixing, packing, pii, quality, simhash
from cartflow.llm.common import table
from cartflow.session import shared_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the line field rejects; it learns from labels whose ids aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(quality.in_training()))
    return quality.good_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group within the bit distance."""
    return simhash.one_of_each(docs)


def with_lengths(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows."""
    return with_lengths(pii.redact(docs, pii.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents up to the target of their source; a part of a document has its own ``n_chars``."""
    return with_lengths(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs the mix: one row per piece with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, fingerprints and the fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{uuid.uuid4().hex}", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
