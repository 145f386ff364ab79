"""Exact length histogram: documents counted by encoded length, and sums over its tail.

The histogram has a row for each length that occurs. Its suffix sums answer for every context limit
how many documents and tokens there are, how many are longer, and how many tokens are left if each
document is cut at the limit; quantiles of length follow from the running counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free, written
from .tokens import words_of

#: Lengths in a block: suffix sums run inside blocks, and over the blocks' totals.
BLOCK = 4096


def token_counts(docs: DataFrame, tokenizer: str, extra: int = 0) -> DataFrame:
    """``docs`` with n_tokens (long) in place of the text: ids of the whole text, and ``extra``; null text: no ids."""
    keep = [c for c in docs.columns if c not in ("text", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = words_of(tokenizer).encode
        for b in batches:
            n = [len(encode(t.as_py() or b"")) // 4 + extra for t in b.column(name)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    (name,) = free(docs, "text_bytes")
    rows = docs.select(*keep, F.col("text").cast("binary").alias(name))
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(run, schema)


def histogram(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group and length, with sums over all documents at least that long.

    n_docs, docs_from, tokens_from: documents of this length, and documents and tokens of this length
    or more. docs_total, tokens_total: of the group. tokens_cut: tokens left if every document is cut
    at this length. quantile: share of documents of this length or less. Empty input: no rows.
    """
    hist = written(counts.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)), "length-histogram")
    sums = [F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens")]
    blocks = hist.groupBy(*by, "_block").agg(*sums)
    later = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    tails = blocks.select(
        *by,
        "_block",
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(whole).alias("docs_total"),
        F.sum("_tokens").over(whole).alias("tokens_total"),
    )
    keys = [*by, "_block"]
    a, b = hist.alias("a"), tails.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    inside = Window.partitionBy(*[F.col(f"a.{k}") for k in keys]).orderBy(F.desc("a.n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_from = F.sum("a.n_docs").over(inside) + F.col("b._docs_after")
    tokens_from = F.sum(F.col("a.n_docs") * F.col("a.n_tokens")).over(inside) + F.col("b._tokens_after")
    out = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in by], "a.n_tokens", "a.n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "b.docs_total", "b.tokens_total")
    return out.withColumn("tokens_cut", F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).withColumn("quantile", (F.col("docs_total") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_total"))


def at_limits(hist: DataFrame, by: list[str], limits: list[int]) -> DataFrame:
    """For each group and context limit: documents and tokens longer, and tokens left if cut there.

    The first length beyond the limit holds the sums of the tail; tokens_cut follows from them.
    """
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    tail = hist.select("*", asked).groupBy(*by, "context_limit").agg(
        F.first("docs_total").alias("docs_total"),
        F.first("tokens_total").alias("tokens_total"),
        F.min(F.when(F.col("n_tokens") > F.col("context_limit"), F.struct("n_tokens", "docs_from", "tokens_from"))).alias("_tail"),
    )
    over, beyond = F.coalesce("_tail.docs_from", F.lit(0)), F.coalesce("_tail.tokens_from", F.lit(0))
    return tail.select(*by, "context_limit", "docs_total", "tokens_total", over.alias("docs_over"), (F.col("tokens_total") - beyond + over * F.col("context_limit")).alias("tokens_cut"))
