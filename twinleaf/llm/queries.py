"""The operators as queries over whole tables, and DuckDB SQL where that can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, gru_lm, hilbert_ann, jaccard_join, line_dedup, packing, quality, quote_threads, token_files, toxicity
from .shared import split_key, table


def tokenizer_path() -> str:
    """The vocabulary file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), split_key("doc_id", 4) == 2
    return toxicity.digest(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)


def op2_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"), split_key("doc_id", 10) == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), split_key("doc_id", 5) == 0
    return quality.digest(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)


def op7_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.reply_ordered(table(spark, sf_dir, "conversations"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_gru_lm": op2_gru_lm,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_hilbert_ann": op5_hilbert_ann,
    "op6_quality": op6_quality,
    "op7_quote_threads": op7_quote_threads,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
}
