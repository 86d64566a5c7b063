"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes what the one before it kept and returns a table with the columns of
documents, but for the last, which returns the packed pieces. Every stage's result is
written as Parquet in the shared folder and read again for the next; a stage's own tables
are deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequery.llm.common import discard_others, free_name, read_table, saved, standing
from scenequery.llm.line_dedup import dedup_lines
from scenequery.llm.mixing import mixed_documents
from scenequery.llm.near_dedup import deduplicated
from scenequery.llm.packing import pack
from scenequery.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest don't reject."""
    return kept_documents(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one that is left without words goes. n_chars, where there is one, follows the text."""
    removed = free_name(docs, "lines_removed")
    clean = dedup_lines(docs, count_name=removed)
    left = clean.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts, and rows without an id as they are."""
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each document and epoch."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed token sequences."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The forest, the registers and the packing are not expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), standing()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{i + 1}")
            discard_others(before, docs)
    return docs
