"""A corpus pipeline of training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. What one stage drops or repeats, the next never sees or sees repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, entries, mixing, quality, similar, tokenfile
from palimpsest.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail a rule."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints link through pivot tables, the shingle sets check the links and find those beyond the fingerprints' radius.
    """
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as the mix takes it."""
    return mixing.curriculum(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token-id files in the order of the rows, which is training order; a row for each document in them."""
    return entries.encoded(*tokenfile.in_row_order(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mix_sources),
    ("token_output", token_output),
]

#: The tokenizer of the last stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; between stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
