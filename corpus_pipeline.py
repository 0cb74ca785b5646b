"""The corpus pipeline: whole documents through the operators of `tracesieve.llm`, stage by stage.

Each stage works on all that its predecessor kept. `run` writes what a stage returns to the shared checkpoint folder and reads it again for
the next one, so a lost executor never sends the work back behind a finished stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracesieve.llm import near_dedup, packing, pii, quality_classifier, quality_rules
from tracesieve.llm.frames import read
from tracesieve.session import checkpoint_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and those whose cutoffs the labels certify; the others go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.3; it learns from those of the documents left that are labelled and not held out."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return near_dedup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars is that of the new text."""
    return pii.redacted(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicate removal", dedup), ("personal data", personal_data),
          ("best-fit packing", best_fit)]
#: No SQL twin: learned scores and tokenizers are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole `documents` table."""
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
