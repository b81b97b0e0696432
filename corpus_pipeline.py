"""The corpus pipeline: stages over the documents table, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.llm.decontaminate import decontaminate
from rootcause.llm.jaccard_join import first_of_each
from rootcause.llm.packing import pack
from rootcause.llm.quality_lm import trusted_documents
from rootcause.llm.queries import WORD_VOCABULARY, vocabulary
from rootcause.llm.secret_scan import redact
from rootcause.llm.tables import load, stage_table


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is under the fence of their language."""
    return trusted_documents(docs, load(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that shares 80 % of its five-word shingles."""
    return first_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return recounted(decontaminate(docs, load(spark, sf_dir, "benchmark")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a placeholder."""
    return recounted(redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, with their places in training sequences."""
    return pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can express neither the language model, the forest nor the tokenizer.
ORACLE_SQL = None
