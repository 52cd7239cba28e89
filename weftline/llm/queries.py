"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import public_path

    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), with_ids=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import duplicate_passages

    return duplicate_passages(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests
    from .tokens import public_path

    return encode_digests(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.tiktoken"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every fiftieth embedding, itself included."""
    from .topk import search_embeddings

    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_digests

    return span_digests(table(spark, sf_dir, "documents"))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfile import read_ids, write_ids
    from .tokens import public_path

    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")), with_ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the cleaned text."""
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op12_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sessions import session_digests

    return session_digests(table(spark, sf_dir, "clicks"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_embeddings

    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_top_k": op4_top_k,
    "op5_personal_data": op5_personal_data,
    "op6_id_files": op6_id_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_language_id": op11_language_id,
    "op12_gap_sessions": op12_gap_sessions,
    "op13_embedding_whitening": op13_embedding_whitening,
}
