"""The usage ledger: keyed lookups, upserts, quotas and progress, as DataFrame operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.plans import effective_plan, limit
from ..sources.keyed import KeyedTable
from ..sources.scratch import new_path

STATUSES = ["pending", "processing", "completed", "failed"]


def latest(df: DataFrame, keys: list[str], order: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key; ties go to the greater ``tie``. A partial aggregate, so a hot key shuffles once a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(order, tie))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def by_key(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``wanted``, each once; a null key is not found. A semi join, so repeated keys cost nothing."""
    return df.join(wanted.select(*keys), keys, "left_semi")


def file_history(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files with their latest task, or nulls."""
    newest = latest(tasks, ["file_id"]).select("file_id", F.col("id").alias("task_id"), F.col("status").alias("task_status"), F.col("created_at").alias("task_created_at"))
    return files.join(newest, files["id"] == newest["file_id"], "left").drop("file_id")


def resumable(tasks: DataFrame, requests: DataFrame, statuses: list[str]) -> DataFrame:
    """For each request (file, user, languages): the newest task still open for it."""
    keys = ["file_id", "user_id", "source_lang", "target_lang"]
    return requests.join(latest(tasks.filter(F.col("status").isin(statuses)), keys), keys)


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: the rows of ``new`` whose key the table lacks, one a key."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have the key, new values win unless null."""
    rest = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in rest])


def patched(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse update: only non-null fields of the patch overwrite."""
    fields = [c for c in patch.columns if c not in keys]
    joined = old.alias("o").join(patch.alias("p"), keys, "left")
    return joined.select(*keys, *[F.coalesce(f"p.{c}", f"o.{c}").alias(c) if c in fields else F.col(f"o.{c}").alias(c) for c in old.columns if c not in keys])


def seeded_pages(tasks: DataFrame, existing: DataFrame, total: str) -> DataFrame:
    """Page rows 1..n of each task that do not exist yet, pending."""
    pages = tasks.filter(F.col(total) > 0).select(F.col("id").alias("task_id"), F.explode(F.sequence(F.lit(1), total)).alias("page_number"))
    return pages.join(existing, ["task_id", "page_number"], "left_anti").withColumn("status", F.lit("pending"))


def reset_stuck(pages: DataFrame) -> DataFrame:
    return pages.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def pending_pages(tasks: DataFrame, pages: DataFrame, requested: str) -> DataFrame:
    """Requested pages minus completed ones."""
    asked = tasks.filter(F.col(requested) > 0).select(F.col("id").alias("task_id"), F.explode(F.sequence(F.lit(1), requested)).alias("page_number"))
    return asked.join(pages.filter("status = 'completed'"), ["task_id", "page_number"], "left_anti")


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages of each task by status, zero where it has none."""
    return pages.groupBy("task_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def progress(counts: DataFrame, requested: Column) -> DataFrame:
    return counts.select("task_id", F.col("completed").alias("translated_pages"), (F.col("completed") + F.col("failed")).alias("processed_pages"), (F.col("completed") / F.greatest(requested, F.lit(1)) * 100).alias("progress"))


def usage_units(task_events: DataFrame, page_events: DataFrame) -> DataFrame:
    """Both kinds of usage as (user, plan, time, month, units)."""
    keep = ["user_id", "plan", "created_at", "usage_month"]
    return task_events.select(*keep, F.col("pages").cast("long").alias("units")).unionByName(page_events.select(*keep, F.lit(1).cast("long").alias("units")))


def usage_summary(users: DataFrame, units: DataFrame, month: str) -> DataFrame:
    """used, quota, remaining of each user: a free plan counts its month, a paid one all since its period began."""
    u = users.withColumn("effective_plan", effective_plan(F.col("plan"), F.col("subscription_status"))).select(F.col("id").alias("user_id"), "effective_plan", F.when(F.col("effective_plan") != "free", F.col("period_start")).alias("since"))
    free = (F.col("effective_plan") == "free") & (F.col("plan") == "free") & (F.col("usage_month") == month)
    paid = (F.col("effective_plan") != "free") & F.when(F.col("since").isNull(), F.col("usage_month") == month).otherwise(F.col("created_at") >= F.col("since"))
    used = u.join(units, "user_id", "left").groupBy("user_id", "effective_plan").agg(F.coalesce(F.sum(F.when(free | paid, F.col("units"))), F.lit(0)).alias("used_pages"))
    quota = limit(F.col("effective_plan"), 2)
    return used.select("user_id", "effective_plan", "used_pages", quota.alias("quota"), F.greatest(quota - F.col("used_pages"), F.lit(0)).alias("remaining_pages"))


def admissions(requests: DataFrame, keys: list[str], user: str, order: list[str], quota: Column, base: Column) -> DataFrame:
    """Quota admission in order: a key seen before is admitted free, a new one while quota lasts.

    Every admission costs one, so without releases the n-th new key of a user is admitted if base + n is
    within quota (null or not positive: no limit). Only each key's first request is ranked; a later one repeats its answer.
    """
    first = requests.groupBy(user, *keys).agg(F.min(F.struct(*order)).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy("_at", *keys))
    allowed = quota.isNull() | (quota <= 0) | (base + rank <= quota)
    return requests.join(first.withColumn("admitted", allowed).drop("_at"), [user, *keys])


def page_outcomes(attempts: DataFrame, limit: int = 2) -> DataFrame:
    """Last of at most ``limit`` + 1 attempts of each page; a failed page is not billed."""
    counted = attempts.filter(F.col("attempt") <= limit + 1)
    last = counted.groupBy("task_id", "page_number").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempts"))
    return last.withColumn("is_billed", F.col("status") != "failed")


def running_progress(polls: DataFrame) -> DataFrame:
    """Progress never goes back over the polls of a task."""
    w = Window.partitionBy("task_id").orderBy("ts", "poll").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return polls.withColumn("shown", F.max("progress").over(w))


def cascade(deleted: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Each table without the rows whose key is among the deleted ones."""
    return {k: df.join(deleted.select(*on), on, "left_anti") for k, (df, on) in tables.items()}


#: How the tables that depend on a file name it: by the file itself, or by its tasks.
DEPENDENTS = {"tasks": "file_id", "usage_events": "file_id", "usage_page_events": "file_id", "task_pages": "task_id", "exports": "task_id"}


def delete_files(gone: DataFrame, files: DataFrame, tables: dict[str, DataFrame], pages: str = "pages") -> tuple[dict[str, DataFrame], DataFrame]:
    """Files ``gone`` (file_id) leave ``files`` and all five dependent ``tables``, which have the names of DEPENDENTS.

    Returns what each table keeps, and (key, removed): the storage keys that go with the files, and those of
    exports, which no list of a file names: they stay in storage without a row (removed is false). Tables whose key is null keep the row.
    """
    tasks = tables["tasks"]
    lost = tasks.join(gone.select("file_id"), "file_id", "left_semi")
    by = {"file_id": gone.select("file_id"), "task_id": lost.select(F.col("id").alias("task_id"))}
    kept = {k: tables[k].join(by[on], on, "left_anti").select(*tables[k].columns) for k, on in DEPENDENTS.items()}
    kept["files"] = files.join(gone.select(F.col("file_id").alias("id")), "id", "left_anti").select(*files.columns)
    removed = storage_keys(files.join(gone.select(F.col("file_id").alias("id")), "id", "left_semi"), lost, pages).select("key", F.lit(True).alias("removed"))
    orphans = tables["exports"].join(by["task_id"], "task_id", "left_semi").select(export_key().alias("key"), F.lit(False).alias("removed"))
    return kept, removed.unionByName(orphans)


def export_key() -> Column:
    return F.concat(F.lit("exports/"), F.col("task_id").cast("string"), F.lit("/"), F.col("output_type"), F.lit(".pdf"))


TASK_ROW = "id long, file_id string, user_id string, source_lang string, target_lang string, status string, progress double, processed_pages int, total_pages int, translated_pages int, is_partial boolean, created_at timestamp"
FILE_ROW = "id string, user_id string, original_filename string, storage_key string, file_size long, total_pages int, created_at timestamp"
DEFAULTS: dict[str, Column | str | float | bool] = {"status": "processing", "progress": 0.0, "processed_pages": 0, "total_pages": 0, "translated_pages": 0, "is_partial": False}


def ledger_table(spark: SparkSession, path: str, row: str) -> KeyedTable:
    """A table of rows TASK_ROW or FILE_ROW that lives between runs, one row an id."""
    return KeyedTable(spark, path, row, ("id",))


def append_tasks(table: KeyedTable, requests: DataFrame, batch: str) -> DataFrame:
    """New tasks with the state they begin in; an id that the table has stays as it is, and a batch made again replaces itself.

    A column of ``requests`` counts before the default, but for status and progress, with which every task begins. Returns what the batch added.
    """
    given = [c for c in requests.columns if c not in ("status", "progress")]
    rows = requests.select(*given, *[F.lit(v).alias(c) for c, v in DEFAULTS.items() if c not in given])
    return table.add(rows.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(TASK_ROW).fields]), batch)


def append_files(table: KeyedTable, files: DataFrame, batch: str) -> DataFrame:
    """New files with their storage key, as ``append_tasks`` adds tasks."""
    rows = files.withColumn("storage_key", F.concat(F.lit("uploads/"), F.col("id"), F.lit(".pdf")))
    return table.add(rows.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(FILE_ROW).fields]), batch)


def storage_keys(files: DataFrame, tasks: DataFrame, pages: str = "pages") -> DataFrame:
    """Keys of what a file left in storage: the upload, each task's result, each page's."""
    source = files.select(F.col("id").alias("file_id"), F.concat(F.lit("uploads/"), F.col("id"), F.lit(".pdf")).alias("key"))
    task = tasks.select("file_id", F.concat(F.lit("results/"), F.col("id").cast("string"), F.lit("/result.json")).alias("key"))
    page = tasks.filter(F.col(pages) > 0).select("file_id", F.explode(F.sequence(F.lit(1), pages)).alias("n"), "id")
    page = page.select("file_id", F.concat(F.lit("results/"), F.col("id").cast("string"), F.lit("/pages/"), F.col("n").cast("string"), F.lit(".json")).alias("key"))
    return reduce(DataFrame.unionByName, [source, task, page])


def validate_uploads(uploads: DataFrame, plan: Column) -> DataFrame:
    """(name, head, size) rows with a rejection reason, or null: by name, by magic bytes, by the plan's size."""
    reason = F.when(~F.lower("name").endswith(".pdf"), "not_pdf_name").when(F.coalesce("head", F.lit("")) != "%PDF", "not_pdf_content").when(F.col("size") > limit(plan, 1).cast("long") * 1024 * 1024, "too_large")
    return uploads.withColumn("reason", reason)


@dataclass(frozen=True)
class Listing:
    """Rows in range partitions of an order, as a table of a folder each, and how many each holds: any page is read from its own partitions."""

    rows: DataFrame
    order: list[Column]
    counts: list[tuple[int, int]]

    @classmethod
    def of(cls, df: DataFrame, order: list[Column], parts: int | None = None) -> Listing:
        """``order`` should leave no ties: tied rows may change places from listing to listing."""
        spark = df.sparkSession
        n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = new_path(spark, "listing")
        df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
        rows = spark.read.schema(df.schema.add("_part", "integer")).parquet(path)
        # a number for each partition, as many as the listing was asked to have
        return cls(rows, order, sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()))

    def page(self, number: int, size: int = 10) -> DataFrame:
        """The rows of one page with their rank in the whole; a page past the end shows the last."""
        total = sum(n for _, n in self.counts)
        at = max(1, min(number, -(-total // size)))
        first, last = (at - 1) * size, at * size
        before = dict(zip((p for p, _ in self.counts), accumulate((n for _, n in self.counts), initial=0), strict=False))
        there = {p: before[p] for p, n in self.counts if before[p] < last and before[p] + n > first}
        offset = reduce(lambda c, x: F.when(F.col("_part") == x[0], F.lit(x[1])).otherwise(c), there.items(), F.lit(0))
        ranked = self.rows.filter(F.col("_part").isin(list(there))).withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*self.order)) + offset)
        return ranked.filter((F.col("rank") > first) & (F.col("rank") <= last)).drop("_part")


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """One page of an ordered listing; a page past the end shows the last."""
    return Listing.of(df, order).page(page, size)
