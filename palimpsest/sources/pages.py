"""Page and task documents, quality reports, exports: scans and sinks on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .heads import listed
from .scratch import _hadoop, packed, written

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE = f"struct<text:string,bbox:{RECT},font_size:double>"
BLOCK = f"struct<type:string,bbox:{RECT},text:string,translatedText:string,font_size:double,layout_role:string,is_header_footer_metadata:boolean,is_formula:boolean,is_chart_text:boolean,is_table_text:boolean,block_index:int,lines:array<{LINE}>>"
PAGE_RESULT = f"pageNum int, original string, translated string, textBlocks array<{BLOCK}>"
TASK_RESULT = "fileId string, userId string, totalPages int, translatedPages int, isPartial boolean, plan string, pageLimit int, usageMonth string, monthlyPageQuota int"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Folders of a page store; a task's pages are in the one of its hash.
BUCKETS = 64


def task_bucket(task: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(task.cast("string")), F.lit(buckets)).cast("int")


def write_page_results(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Pages of some tasks into the store at ``path``, in place of those tasks' former pages; other tasks keep theirs.

    Tasks share ``buckets`` folders, however many they are. Only folders of the written tasks are read and
    replaced, each at the commit of the job; where there is something to replace, the rows are in the shared
    folder before, so that a run that breaks off can be made again. A bucket's rows are dealt to several files
    where they are many; files are gzip, as a page's JSON says each text up to three times.
    """
    spark = pages.sparkSession
    new = pages.withColumn("bucket", task_bucket(F.col("task_id"), buckets))
    old = stored_pages(spark, path)
    if old is not None:
        new = written(new, "pages-new")
        touched = new.select("bucket").distinct()
        if touched.isEmpty():
            return
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select("task_id").distinct(), "task_id", "left_anti")
        new = new.unionByName(packed(kept.select(*new.columns), "pages-kept"), allowMissingColumns=True)
    dealt = new.repartition("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets * 8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path, compression="gzip")


def stored_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """All pages of the store with their bucket; None if there is no store."""
    files, root = _hadoop(spark, path)
    if not files.exists(root):
        return None
    return spark.read.schema(schema(PAGE_RESULT).add("task_id", "string").add("bucket", "integer")).json(path)


def read_page_results(spark: SparkSession, path: str, task: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Pages with their task_id; for a ``task`` only the folder of its hash is read."""
    pages = spark.read.schema(schema(PAGE_RESULT).add("task_id", "string").add("bucket", "integer")).json(path)
    found = pages if task is None else pages.filter((F.col("bucket") == task_bucket(task, buckets)) & (F.col("task_id") == task.cast("string")))
    return found.drop("bucket")


def blocks_of(pages: DataFrame) -> DataFrame:
    """A row for each block of page documents, in the shape the operators take."""
    rows = pages.select("task_id", F.col("pageNum").alias("page_num"), F.posexplode("textBlocks").alias("seq", "b"))
    return rows.select("task_id", "page_num", "seq", "b.type", "b.text", F.col("b.translatedText").alias("translated"), *[F.col(f"b.bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")], "b.font_size", "b.layout_role", "b.is_header_footer_metadata", "b.is_formula", "b.is_chart_text", "b.is_table_text")


def write_task_results(results: DataFrame, path: str, version: int) -> None:
    """Results of some tasks as one version of the data set; writing a version again, as after a failure, replaces it."""
    results.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").json(path)


def read_task_results(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of each task."""
    fields = schema(TASK_RESULT)
    rows = spark.read.schema(schema(TASK_RESULT).add("task_id", "string").add("version", "integer")).json(path)
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*fields.names), "version").alias("r")).select("task_id", "r.*")


def without_stale_exports(exports: DataFrame, results: DataFrame) -> DataFrame:
    """Exports of tasks that got no new result: the others have to be made again."""
    return exports.join(results.select("task_id").distinct(), "task_id", "left_anti")


def write_exports(exports: DataFrame, path: str, version: int) -> None:
    """Exports made from the results of ``version``, as one version of the data set; writing a version again replaces it."""
    exports.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").json(path)


def newest_versions(spark: SparkSession, path: str) -> DataFrame:
    """task_id and version of each task's newest result: what its exports have to be made from."""
    rows = spark.read.schema("task_id string, version int").json(path)
    return rows.groupBy("task_id").agg(F.max("version").alias("version"))


def fresh_exports(spark: SparkSession, exports: str, results: str, schema: str = "task_id string, output_type string") -> DataFrame:
    """The exports at ``exports`` that stand for the newest result of their task.

    Writing a result is what invalidates: at the commit of a version of ``results`` all exports of older ones are
    stale, whatever happens after it. Those of tasks without a result are too.
    """
    rows = spark.read.schema(f"{schema}, version int").json(exports)
    return rows.join(newest_versions(spark, results), ["task_id", "version"], "left_semi")


def drop_stale_exports(spark: SparkSession, exports: str, results: str, schema: str = "task_id string, output_type string") -> None:
    """Removes from storage what ``fresh_exports`` does not show; versions that keep nothing lose their folder."""
    fresh = written(fresh_exports(spark, exports, results, schema), "exports-fresh")
    files, root = _hadoop(spark, exports)
    if not fresh.isEmpty():
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").json(exports)
    # a folder for each run that wrote
    held = {f"version={r['version']}" for r in fresh.select("version").distinct().collect()}
    for p in files.listStatus(root):
        if p.isDirectory() and p.getPath().getName().startswith("version=") and p.getPath().getName() not in held:
            files.delete(p.getPath(), True)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, task: str = "task_id string") -> DataFrame:
    return spark.read.schema(f"{task}, pages long, warnings long, warning_counts map<string,long>, status string").json(path)


def write_export(texts: DataFrame, path: str) -> None:
    """Text exports (task_id, batch, pages, text), many tasks to a file."""
    texts.write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("task_id string, batch long, pages long, text string").json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """key, length of every file below ``path``; contents are not read."""
    root = path.rstrip("/").split("/")[-1]
    return listed(spark, path).select(F.regexp_replace("path", f"^.*?/\\Q{root}\\E/", "").alias("key"), "length")


def missing(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Expected keys that are not stored."""
    return expected.join(stored, "key", "left_anti")
