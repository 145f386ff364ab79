"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, html, lengths, mixing, negatives, ngrams, pii, simhash, sql, substrings, tokenfile, topk
from .quality import quality
from .shared import new_path, only, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; nulls, empty texts, repeats, empty tables: as ``simhash.near_duplicates`` says."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms under the key of the setting palimpsest.pii.key; a session without one draws its own, so nobody can invert them.

    Nulls, repeated rows and empty tables: as ``pii.pseudonymize`` says.
    """
    key = spark.conf.get("palimpsest.pii.key", None)
    if not key:
        spark.conf.set("palimpsest.pii.key", key := secrets.token_hex(32))
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_replaced")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mixing.mix`` says for nulls, ties and empty tables: a row for each document, in training order."""
    return mixing.by_position(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "positions")


def encoded(docs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Writes the ids of ``docs`` to files in the shared folder, by ``order`` or doc_id, and reads them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, order=order)
    return tokenfile.crc32s(spark, path)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, null text too: its end id alone; ties and empty tables as ``tokenfile.write_tokens`` says."""
    return encoded(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; nulls, rare languages, ties, empty tables: as ``quality.quality`` says."""
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; nulls, short texts, equal doc_ids: as ``substrings.repeated`` says."""
    return substrings.digest(substrings.repeated(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of each language, and of all (lang "*"), with its suffix sums."""
    counts = lengths.token_counts(table(spark, sf_dir, "documents").select("lang", "text"), public_tokenizers.path("word_bpe_49k.json"))
    both = counts.select(F.explode(F.array("lang", F.lit("*"))).alias("lang"), "n_tokens")
    return lengths.histogram(both, ["lang"])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; nulls, repeats, empty tables: as ``ngrams.scores`` says."""
    return ngrams.scores(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; null, empty and broken html: as ``html.extract`` says."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; nulls, items without words or id, repeats: as ``decontaminate.hits`` says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.hits(docs, table(spark, sf_dir, "benchmark")))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose vec_id is divisible by 20; nulls, ties, repeats, empty tables: as ``topk.top_k`` says."""
    rows = only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, "embedding", F.col("vec_id") % 20 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conv_id of the damaged table; nulls, ties, empty conversations and tables: as ``conversations.report`` says."""
    rows = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return conversations.report(*conversations.damaged(rows))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every anchor, a vec_id divisible by 100; nulls, ties, repeats, empty tables: as ``negatives.hard_negatives`` says."""
    rows = only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, "embedding", label, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_pii": op2_pii,
        "op3_mixing": op3_mixing,
        "op4_token_output": op4_token_output,
        "op5_quality_rules": op5_quality_rules,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_html_extraction": op9_html_extraction,
        "op10_decontamination": op10_decontamination,
        "op11_topk_search": op11_topk_search,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": sql.QUALITY,
        "op6_substring_dedup": sql.SUBSTRINGS,
        "op10_decontamination": sql.LEAKS,
        "op11_topk_search": sql.TOP_K,
        "op12_conversation_repair": sql.REPAIR,
        "op13_hard_negatives": sql.NEGATIVES,
    }
