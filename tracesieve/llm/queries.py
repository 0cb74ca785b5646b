"""Queries of this subpackage over the `documents` table, each whole; ``ORACLES`` where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracesieve.llm import (bpe, filter_audit, fingerprints, masked_lm, near_dedup, packing, pii, quality_classifier, quality_rules, secret_scan,
                             token_counts, toxicity, whitening)
from tracesieve.llm.audit_sql import filter_audit_sql
from tracesieve.llm.frames import read
from tracesieve.llm.rules_sql import quality_rules_sql


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rules and the verdict of the certified rules for every document."""
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 512 tokens."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.report(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.compare_neighbours(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.report(read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a model of all documents."""
    return masked_lm.score(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and prediction for every document."""
    return quality_classifier.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and its group of near duplicates."""
    return near_dedup.near_groups(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, step by step, for every source."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's whitened coordinates on the first four components, and its exact deviation."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score, prediction and nearest labelled examples of every document."""
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_token_counts, op4_secret_scan, op5_best_fit_packing, op6_document_fingerprints, op7_pii,
                           op8_lm_scoring, op9_quality_classifier, op10_simhash_dedup, op11_filter_audit, op12_embedding_whitening, op13_toxicity)
}
ORACLES: dict[str, str] = {"op1_quality_rules": quality_rules_sql(), "op11_filter_audit": filter_audit_sql()}
