"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents
from .jaccard_sql import OP8_SQL
from .lines import OP4_SQL, dedup_lines
from .quality import OP7_SQL, quality_rules
from .substring import OP2_SQL


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    out = dedup_substrings(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_op import encode_decode

    return encode_decode(read_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import token_files

    return token_files(read_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, stored_media

    return media_features(stored_media(read_documents(spark, sf_dir)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read_documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(read_documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_bpe_codec, op4_line_dedup, op5_token_files, op6_media_columns, op7_quality_rules, op8_jaccard_join, op9_lm_scoring, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_quality_rules": OP7_SQL, "op8_jaccard_join": OP8_SQL}
