"""The corpus operators as registered queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.llm import licenses, oracle
from rootcause.llm.tables import load

#: Vocabulary files by operator; a path for each is a parameter of its operator.
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.decontaminate import contamination_report
    return contamination_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("longest")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.packing import pack
    return pack(load(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.jaccard_join import near_duplicates
    return near_duplicates(load(spark, sf_dir, "documents"), n=3, percent=90)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.vector_neardup import near_duplicate_vectors
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.fm_dedup import repeated_words
    return repeated_words(load(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.secret_scan import scan
    return scan(load(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.quality_lm import classify
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.suffix_dedup import repeated_bytes
    return repeated_bytes(load(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.token_counts import token_counts
    return token_counts(load(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.line_dedup import dedup_lines
    return dedup_lines(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.prefix_trie import prefix_trie
    return prefix_trie(load(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootcause.llm.whitening import whiten
    return whiten(load(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long")).drop("eigenvalue")


REGISTRY = {
    "op1_benchmark_decontamination": (op1_benchmark_decontamination, oracle.OP1),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_ngram_jaccard_join": (op3_ngram_jaccard_join, oracle.OP3),
    "op4_embedding_near_dedup": (op4_embedding_near_dedup, oracle.OP4),
    "op5_license_scans": (op5_license_scans, licenses.oracle_sql()),
    "op6_substring_dedup": (op6_substring_dedup, oracle.OP6),
    "op7_secret_scans": (op7_secret_scans, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_suffix_array_dedup": (op9_suffix_array_dedup, oracle.OP9),
    "op10_token_counts": (op10_token_counts, None),
    "op11_line_dedup": (op11_line_dedup, oracle.OP11),
    "op12_conversation_prefix_trie": (op12_conversation_prefix_trie, oracle.OP12),
    "op13_embedding_whitening": (op13_embedding_whitening, None),
}
