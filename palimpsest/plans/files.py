"""Queries that write documents of the ledger to files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plans as P
from ..operators import ledger as L
from ..operators import quality as Q
from ..operators import translate as R
from ..sources import fixtures as X
from ..sources import heads as H
from ..sources import pages as G
from ..sources.scratch import new_path
from .catalog import Catalog
from .translation import PAGES, WARNINGS

catalog = Catalog()
add = catalog.add


def stored_pages(spark: SparkSession, d: str) -> str:
    """Page documents of every document, in files; a document is a task."""
    pages = R.page_results(X.quality_pairs(spark, d), ["doc_id", "page_num"], "block_index")
    path = new_path(spark, "pages")
    G.write_page_results(pages.select(F.col("doc_id").cast("string").alias("task_id"), (F.col("page_num") + 1).alias("pageNum"), "original", "translated", "textBlocks"), path)
    return path


@add("SELECT doc_id::VARCHAR AS task_id, page_num + 1 AS page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY block_index) - 1 AS seq, text, translated FROM quality_pairs", "quality_pairs")
def s3_s5_page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Page documents written and read: every block of every page."""
    blocks = G.blocks_of(G.read_page_results(spark, stored_pages(spark, d)))
    return blocks.select("task_id", "page_num", "seq", "text", "translated")


@add("SELECT doc_id::VARCHAR AS task_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE count(DISTINCT page_num) END AS pages, doc_id % 3 = 0 AS again FROM quality_pairs GROUP BY doc_id", "quality_pairs")
def s5_rewritten_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every third task is written again, with its first page only: it replaces its pages and no others."""
    path = stored_pages(spark, d)
    first = X.table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("task_id")).distinct()
    G.write_page_results(first.select("task_id", F.lit(1).alias("pageNum"), F.lit("").alias("original"), F.lit("again").alias("translated"), F.array().cast(f"array<{G.BLOCK}>").alias("textBlocks")), path)
    pages = G.read_page_results(spark, path)
    return pages.groupBy("task_id").agg(F.count("*").alias("pages"), F.bool_or(F.col("translated") == "again").alias("again"))


@add("SELECT id::VARCHAR AS task_id, file_id AS \"fileId\", user_id AS \"userId\", (id % 9)::INT AS \"totalPages\", id % 3 <> 0 OR status = 'recoverable' AS \"isPartial\" FROM tasks", "tasks")
def s4_s6_task_results(spark: SparkSession, d: str) -> DataFrame:
    """Partial results of all tasks, then those of every third task again; the newest of each is read."""
    t = X.tasks(spark, d)
    rows = t.select("id", F.col("id").cast("string").alias("task_id"), F.col("file_id").alias("fileId"), F.col("user_id").alias("userId"), (F.col("id") % 9).cast("int").alias("totalPages"), (F.col("status") == "recoverable").alias("isPartial"))
    path = new_path(spark, "task-results")
    G.write_task_results(rows.withColumn("isPartial", F.lit(True)).drop("id"), path, 0)
    G.write_task_results(rows.filter("id % 3 = 0").drop("id"), path, 1)
    return G.read_task_results(spark, path).select("task_id", "fileId", "userId", "totalPages", "isPartial")


@add("SELECT id AS task_id, output_type FROM (SELECT id, unnest(['translated', 'bilingual']) AS output_type FROM tasks) WHERE id % 3 <> 0", "tasks")
def s6_fresh_exports(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d).select(F.col("id").alias("task_id"))
    exports = t.select("task_id", F.explode(F.array(F.lit("translated"), F.lit("bilingual"))).alias("output_type"))
    return G.without_stale_exports(exports, t.filter(F.col("task_id") % 3 == 0))


@add("SELECT id::VARCHAR AS task_id, unnest(['translated', 'bilingual']) AS output_type, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS version FROM tasks WHERE id % 3 <> 0 OR id % 2 = 0", "tasks")
def s6_exports_of_newest_results(spark: SparkSession, d: str) -> DataFrame:
    """All tasks get results and exports, every third a new result, every sixth new exports of it: those that stand, after the stale ones are removed."""
    t = X.tasks(spark, d).select("id", F.col("id").cast("string").alias("task_id"), F.col("file_id").alias("fileId"))
    results, exports = new_path(spark, "task-results"), new_path(spark, "exports")
    made = lambda df: df.select("task_id", F.explode(F.array(F.lit("translated"), F.lit("bilingual"))).alias("output_type"))
    G.write_task_results(t.drop("id"), results, 0)
    G.write_exports(made(t), exports, 0)
    G.write_task_results(t.filter("id % 3 = 0").drop("id"), results, 1)
    G.write_exports(made(t.filter("id % 6 = 0")), exports, 1)
    G.drop_stale_exports(spark, exports, results)
    return G.fresh_exports(spark, exports, results).select("task_id", "output_type", "version")


@add(
    f"""SELECT doc_id, pages, total AS warnings, CASE WHEN total > 0 THEN 'warn' ELSE 'ok' END AS status, code, n FROM (SELECT doc_id, count(*) AS pages, sum(warnings)::BIGINT AS total FROM ({PAGES}) GROUP BY doc_id)
 LEFT JOIN (SELECT doc_id, w.code AS code, count(*) AS n FROM ({WARNINGS}) GROUP BY ALL UNION ALL SELECT doc_id, 'blank_translated_page', count(*) FROM ({PAGES}) WHERE blank_page GROUP BY doc_id) USING (doc_id)""",
    "quality_pairs",
)
def s7_quality_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON and read back, a row for each code."""
    path = new_path(spark, "reports")
    G.write_report(Q.report(X.quality_pairs(spark, d), ["doc_id"], ["page_num"]), path)
    return G.read_report(spark, path, "doc_id long").select("doc_id", "pages", "warnings", "status", F.explode_outer("warning_counts").alias("code", "n"))


@add("SELECT 'stored' AS what, count(DISTINCT doc_id % 16) AS n FROM documents UNION ALL SELECT 'missing', 16 - count(DISTINCT doc_id % 16) + 1 FROM documents")
def s11_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Expected folders against the files that are there."""
    path = new_path(spark, "inventory")
    X.table(spark, d, "documents").select((F.col("doc_id") % 16).alias("k"), "doc_id").repartition("k").write.partitionBy("k").json(path)
    stored = G.inventory(spark, path).select(F.regexp_extract("key", "^(k=\\d+)/", 1).alias("key")).filter("key <> ''").distinct()
    expected = spark.range(17).select(F.concat(F.lit("k="), F.col("id").cast("string")).alias("key"))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(stored, "stored").unionByName(count(G.missing(expected, stored), "missing"))


#: A file is counted so many times its bytes, so that some pass a plan's limit.
SWOLLEN = 8192
NAME = "concat(doc_id, CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.pdf' END)"
FILE = "concat(CASE WHEN doc_id % 7 = 0 THEN 'PK..' WHEN doc_id % 13 = 0 THEN '%P' ELSE '%PDF-1.7' END, CASE WHEN doc_id % 13 = 0 AND doc_id % 7 <> 0 THEN '' ELSE coalesce(text, '') END)"


def stored_uploads(spark: SparkSession, d: str) -> str:
    """Every document as a file of its own: some by another name, some of another kind, some cut off after two bytes."""
    path = new_path(spark, "uploads")
    docs = X.table(spark, d, "documents").dropDuplicates(["doc_id"])
    H.put_files(docs.select(F.expr(NAME).alias("name"), F.encode(F.expr(FILE), "UTF-8").alias("content")), path)
    return path


@add(
    f"""SELECT name, size, CASE WHEN name LIKE '%.txt' THEN 'not_pdf_name' WHEN head <> '%PDF' THEN 'not_pdf_content' WHEN size * {SWOLLEN} > {P.LIMITS["free"][1]}::BIGINT * 1024 * 1024 THEN 'too_large' END AS reason
 FROM (SELECT {NAME} AS name, left({FILE}, 4) AS head, strlen({FILE})::BIGINT AS size FROM documents)"""
)
def s2_scanned_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploads listed and judged by name, first bytes and size, on the free plan; no more of a file than its head is read."""
    found = H.uploads(spark, stored_uploads(spark, d)).withColumn("size", F.col("size") * SWOLLEN)
    return L.validate_uploads(found, F.lit("free")).select("name", (F.col("size") / SWOLLEN).cast("long").alias("size"), "reason")


@add("SELECT concat(doc_id, '.pdf') AS key, doc_id % 11 <> 0 AS stored FROM documents")
def s11_stored_keys(spark: SparkSession, d: str) -> DataFrame:
    """For every document, whether the key of its upload is in storage."""
    stored = G.inventory(spark, stored_uploads(spark, d)).select("key")
    expected = X.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("key")).distinct()
    gone = G.missing(expected, stored).withColumn("stored", F.lit(False))
    return gone.unionByName(expected.join(stored, "key", "left_semi").withColumn("stored", F.lit(True)))
