"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; `n_chars` follows a
changed text. run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinleaf.llm import decontamination, jaccard_join, line_dedup, packing, quality
from twinleaf.llm.queries import tokenizer_path
from twinleaf.llm.shared import materialise, split_key, table

#: Documents whose quality score is below this go.
LEAST_QUALITY = quality.CUT


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of its texts, if it has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op6) keeps. It learns from the labelled rows that op6 learns from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), split_key("doc_id", 5) != 0)
    return quality.keep(docs, model, LEAST_QUALITY)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur in ten documents or more (op10)."""
    return _measured(line_dedup.rewrite(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (op8)."""
    return jaccard_join.deduplicate(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go (op9)."""
    return _measured(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 1024 (op3)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Training, components and packing are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
