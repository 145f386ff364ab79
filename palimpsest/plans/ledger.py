"""Queries over the usage ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import plans as P
from ..operators import ledger as L
from ..sources import fixtures as X
from ..sources.scratch import new_path
from .catalog import Catalog

catalog = Catalog()
add = catalog.add

EFFECTIVE = """CASE WHEN lower(trim(plan)) IN ('starter','pro','power') AND lower(trim(subscription_status)) IN ('active','trialing') THEN lower(trim(plan)) ELSE 'free' END"""


def sql_limit(plan: str, which: int) -> str:
    return f"CASE {plan} " + " ".join(f"WHEN '{k}' THEN {v[which]}" for k, v in P.LIMITS.items()) + " END"


@add("SELECT id, plan, subscription_status, period_start FROM users WHERE id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')", "users")
def s1_user_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The users who have an urgent order, looked up by key."""
    urgent = X.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return L.by_key(X.users(spark, d), urgent.select(F.col("o_custkey").cast("string").alias("id")), ["id"])


@add(
    f"""SELECT f.id, f.file_size, CASE WHEN f.id LIKE '%:5' THEN 'not_pdf_name' WHEN f.total_pages % 7 = 0 THEN 'not_pdf_content'
 WHEN f.file_size > CAST({sql_limit("u.ep", 1)} AS BIGINT) * 1024 * 1024 THEN 'too_large' END AS reason
 FROM files f JOIN (SELECT id, {EFFECTIVE} AS ep FROM users) u ON u.id = f.user_id""",
    "users files",
)
def s2_upload_validation(spark: SparkSession, d: str) -> DataFrame:
    plans = X.users(spark, d).select(F.col("id").alias("user_id"), P.effective_plan(F.col("plan"), F.col("subscription_status")).alias("ep"))
    name = F.when(F.col("id").endswith(":5"), F.lit("notes.txt")).otherwise(F.col("original_filename"))
    head = F.when(F.col("total_pages") % 7 == 0, "PK..").otherwise("%PDF")
    uploads = X.files(spark, d).join(plans, "user_id").select("id", name.alias("name"), head.alias("head"), F.col("file_size").alias("size"), "ep")
    return L.validate_uploads(uploads, F.col("ep")).select("id", F.col("size").alias("file_size"), "reason")


@add("SELECT id, file_id, user_id, source_lang, target_lang, 'processing' AS status, CAST(0 AS DOUBLE) AS progress, 0 AS processed_pages, 0 AS translated_pages, FALSE AS is_partial FROM tasks", "tasks")
def s12_new_task_rows(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d)
    return t.select("id", "file_id", "user_id", "source_lang", "target_lang", F.lit("processing").alias("status"), F.lit(0.0).alias("progress"), F.lit(0).alias("processed_pages"), F.lit(0).alias("translated_pages"), F.lit(False).alias("is_partial"))


@add(
    """SELECT 'task' AS kind, id::VARCHAR AS id, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS batch, 'processing' AS status, (id % 4)::INT AS total_pages, 0 AS translated_pages, NULL AS storage_key FROM tasks
 UNION ALL SELECT 'file', id, 'a', NULL, total_pages, NULL, concat('uploads/', id, '.pdf') FROM files""",
    "tasks files",
)
def s12_appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every third task is appended, then all of them, then the same batch again; files in one batch, twice: what the tables hold."""
    asked = X.tasks(spark, d).withColumn("total_pages", F.col("id") % 4)
    tasks, files = L.ledger_table(spark, new_path(spark, "tasks"), L.TASK_ROW), L.ledger_table(spark, new_path(spark, "files"), L.FILE_ROW)
    for batch, rows in (("a", asked.filter("id % 3 = 0")), ("b", asked), ("b", asked)):
        L.append_tasks(tasks, rows, batch)
    for _ in range(2):
        L.append_files(files, X.files(spark, d), "a")
    null = lambda kind: F.lit(None).cast(kind)
    task = [tasks.batch(b).select(F.lit("task").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(b).alias("batch"), "status", "total_pages", "translated_pages", null("string").alias("storage_key")) for b in "ab"]
    file = files.batch("a").select(F.lit("file").alias("kind"), "id", F.lit("a").alias("batch"), null("string").alias("status"), "total_pages", null("int").alias("translated_pages"), "storage_key")
    return task[0].unionByName(task[1]).unionByName(file)


LANGUAGES = "en zh ja ko es fr it pt de nl pl ru uk fi tr vi id ms".split()


@add(f"SELECT doc_id, lower(trim(lang)) AS lang FROM documents WHERE doc_id % 5 <> 0 AND lower(trim(lang)) IN {tuple(LANGUAGES)}")
def p18_supported_language(spark: SparkSession, d: str) -> DataFrame:
    """Languages of all documents, written in capitals and spaces; every fifth asks for a dialect, which is not supported."""
    asked = F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("doc_id") % 5 == 0, "-X").otherwise(""), F.lit(" "))
    docs = X.table(spark, d, "documents").select("doc_id", asked.alias("lang"))
    return docs.select("doc_id", F.lower(F.trim("lang")).alias("lang")).filter(F.col("lang").isin(LANGUAGES))


@add(f"SELECT id, ep AS plan, {sql_limit('ep', 0)} AS max_pages_per_file, {sql_limit('ep', 1)} AS max_file_size_mb, {sql_limit('ep', 2)} AS period_quota, {sql_limit('ep', 3)} AS preview_pages FROM (SELECT id, {EFFECTIVE} AS ep FROM users)", "users")
def p19_entitlements(spark: SparkSession, d: str) -> DataFrame:
    u = X.users(spark, d).select("id", P.effective_plan(F.col("plan"), F.col("subscription_status")).alias("plan"))
    return u.join(F.broadcast(P.plan_table(spark)), "plan").select("id", "plan", "max_pages_per_file", "max_file_size_mb", "period_quota", "preview_pages")


FILE_PLAN = f"SELECT f.id, f.user_id, f.total_pages, u.ep FROM files f JOIN (SELECT id, {EFFECTIVE} AS ep FROM users) u ON u.id = f.user_id"


def file_plans(spark: SparkSession, d: str) -> DataFrame:
    u = X.users(spark, d).select(F.col("id").alias("user_id"), P.effective_plan(F.col("plan"), F.col("subscription_status")).alias("ep"))
    return X.files(spark, d).join(u, "user_id").select("id", "user_id", "total_pages", "ep")


@add(f"SELECT id, CASE WHEN total_pages <= 0 THEN 0 WHEN ep = 'free' THEN least(total_pages, 3) ELSE least(total_pages, {sql_limit('ep', 0)}) END AS pages FROM ({FILE_PLAN})", "users files")
def p20_translatable_pages(spark: SparkSession, d: str) -> DataFrame:
    return file_plans(spark, d).select("id", P.translatable_pages(F.col("ep"), F.col("total_pages")).alias("pages"))


MONTH = "1995-06"
UNITS = "SELECT user_id, plan, created_at, usage_month, 1 AS units FROM usage_page_events UNION ALL SELECT user_id, 'free', created_at, strftime(created_at, '%Y-%m'), 2 FROM tasks WHERE status = 'recoverable'"
SUMMARY = f"""SELECT u.id AS user_id, ep AS effective_plan, CAST(coalesce(sum(CASE WHEN ep = 'free' THEN CASE WHEN x.plan = 'free' AND usage_month = '{MONTH}' THEN units END
   WHEN period_start IS NULL THEN CASE WHEN usage_month = '{MONTH}' THEN units END WHEN x.created_at >= period_start THEN units END), 0) AS BIGINT) AS used_pages
 FROM (SELECT *, {EFFECTIVE} AS ep FROM users) u LEFT JOIN ({UNITS}) x ON x.user_id = u.id GROUP BY u.id, ep"""


def units(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d).filter("status = 'recoverable'")
    task_events = t.select("user_id", F.lit("free").alias("plan"), "created_at", F.date_format("created_at", "yyyy-MM").alias("usage_month"), F.lit(2).alias("pages"))
    return L.usage_units(task_events, X.usage_page_events(spark, d))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return L.usage_summary(X.users(spark, d), units(spark, d), MONTH)


@add(f"SELECT *, {sql_limit('effective_plan', 2)} AS quota, greatest({sql_limit('effective_plan', 2)} - used_pages, 0) AS remaining_pages FROM ({SUMMARY})", "users tasks usage_page_events")
def a5_usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d)


@add(f"SELECT user_id, plan, usage_month, CAST(sum(units) AS BIGINT) AS used_pages FROM ({UNITS}) GROUP BY ALL", "users tasks usage_page_events")
def a3_monthly_usage(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).groupBy("user_id", "plan", "usage_month").agg(F.sum("units").alias("used_pages"))


@add(f"SELECT effective_plan, count(*) AS users, CAST(sum(used_pages) AS BIGINT) AS used_pages FROM ({SUMMARY}) GROUP BY effective_plan", "users tasks usage_page_events")
def a4_usage_by_plan(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d).groupBy("effective_plan").agg(F.count("*").alias("users"), F.sum("used_pages").alias("used_pages"))


REMAIN = f"SELECT user_id, effective_plan, greatest({sql_limit('effective_plan', 2)} - used_pages, 0) AS rem FROM ({SUMMARY})"


@add(
    f"""SELECT id, CASE WHEN reason IS NULL THEN CASE WHEN ep = 'free' THEN least(preview, rem) ELSE total_pages END END AS granted_pages, reason FROM (
 SELECT *, CASE WHEN rem <= 0 OR (ep = 'free' AND least(preview, rem) <= 0) THEN '402' WHEN ep <> 'free' AND total_pages > {sql_limit("ep", 0)} THEN '413' WHEN ep <> 'free' AND total_pages > rem THEN '402' END AS reason
 FROM (SELECT f.id, f.total_pages * 12 AS total_pages, r.effective_plan AS ep, r.rem, least(f.total_pages * 12, {sql_limit("r.effective_plan", 3)}) AS preview FROM files f JOIN ({REMAIN}) r ON r.user_id = f.user_id))""",
    "users files tasks usage_page_events",
)
def p21_authorise(spark: SparkSession, d: str) -> DataFrame:
    asked = X.files(spark, d).select("id", "user_id", (F.col("total_pages") * 12).alias("total_pages")).join(summary(spark, d), "user_id")
    granted, reason = P.authorised(F.col("effective_plan"), F.col("total_pages"), F.col("remaining_pages"))
    return asked.select("id", granted.alias("granted_pages"), reason.alias("reason"))


HISTORY = """SELECT f.id, f.user_id, f.original_filename, f.created_at, t.id AS task_id, t.status AS task_status, t.created_at AS task_created_at
 FROM files f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS rn FROM tasks WHERE status <> 'recoverable') t ON t.file_id = f.id AND t.rn = 1"""


def history(spark: SparkSession, d: str) -> DataFrame:
    return L.file_history(X.files(spark, d), X.tasks(spark, d).filter("status <> 'recoverable'"))


@add(HISTORY, "files tasks")
def j1_file_history(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("id", "user_id", "original_filename", "created_at", "task_id", "task_status", "task_created_at")


@add(f"SELECT id, contains(lower(concat_ws(' ', original_filename, coalesce(task_status, ''))), 'file_3.pdf comp') AS found FROM ({HISTORY})", "files tasks")
def p22_dashboard_search(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "original_filename", F.coalesce("task_status", F.lit(""))))
    return history(spark, d).select("id", text.contains("file_3.pdf comp").alias("found"))


@add(
    f"""SELECT user_id, least(used_pages * 100.0 / {sql_limit("effective_plan", 2)}, 100)::DOUBLE AS percentage, {sql_limit("effective_plan", 2)} - used_pages <= 0 AS out_of_quota,
 CASE WHEN effective_plan = 'free' THEN 'Preview only' WHEN {sql_limit("effective_plan", 2)} - used_pages <= 0 THEN 'Quota reached' ELSE 'Active' END AS label FROM ({SUMMARY})""",
    "users tasks usage_page_events",
)
def p23_usage_card(spark: SparkSession, d: str) -> DataFrame:
    out = F.col("remaining_pages") <= 0
    label = F.when(F.col("effective_plan") == "free", "Preview only").when(out, "Quota reached").otherwise("Active")
    return summary(spark, d).select("user_id", F.least(F.col("used_pages") * 100.0 / F.col("quota"), F.lit(100.0)).alias("percentage"), out.alias("out_of_quota"), label.alias("label"))


NOW = "1998-09-01 00:00:00"


@add(
    f"""SELECT id, CASE WHEN m < 60 THEN CASE WHEN m = 1 THEN 'Just now' ELSE concat(m, ' minutes ago') END WHEN m // 60 < 24 THEN CASE WHEN m // 60 = 1 THEN '1 hour ago' ELSE concat(m // 60, ' hours ago') END
 WHEN m // 1440 < 7 THEN CASE WHEN m // 1440 = 1 THEN 'Yesterday' ELSE concat(m // 1440, ' days ago') END WHEN m // 10080 = 1 THEN '1 week ago' ELSE concat(m // 10080, ' weeks ago') END AS age,
 CASE WHEN file_size < 1024 THEN concat(file_size, ' B') WHEN file_size < 1048576 THEN concat(file_size // 1024, ' KB') ELSE concat(file_size // 1048576, ' MB') END AS size
 FROM (SELECT id, file_size, greatest(1, CAST(epoch(TIMESTAMP '{NOW}') - epoch(created_at) AS BIGINT) // 60) AS m FROM files)""",
    "files",
)
def p24_display_columns(spark: SparkSession, d: str) -> DataFrame:
    m = F.greatest(F.lit(1), F.floor((F.unix_timestamp(F.lit(NOW)) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 60))
    ago = lambda n, one, many: F.when(n == 1, one).otherwise(F.concat(n.cast("string"), F.lit(f" {many} ago")))
    hours, days, weeks = (F.floor(m / n) for n in (60, 1440, 10080))
    age = F.when(m < 60, ago(m, "Just now", "minutes")).when(hours < 24, ago(hours, "1 hour ago", "hours")).when(days < 7, ago(days, "Yesterday", "days")).otherwise(ago(weeks, "1 week ago", "weeks"))
    n = F.col("file_size")
    unit = lambda by, name: F.concat(F.floor(n / by).cast("string"), F.lit(name))
    size = F.when(n < 1024, unit(1, " B")).when(n < 1048576, unit(1024, " KB")).otherwise(unit(1048576, " MB"))
    return X.files(spark, d).select("id", age.alias("age"), size.alias("size"))


PRICE = ("CASE ep " + " ".join(f"WHEN '{k}' THEN {v[0]:.0f}" for k, v in P.PRICES.items()) + " END", "CASE ep " + " ".join(f"WHEN '{k}' THEN {v[1]:.0f}" for k, v in P.PRICES.items()) + " END")


@add(f"SELECT ep AS plan, count(*) AS users, max({PRICE[0]} / {sql_limit('ep', 2)}::DOUBLE) AS price_per_page, max(round({PRICE[1]} / 12::DOUBLE)) AS monthly_when_yearly, CAST(sum({PRICE[0]}) AS DOUBLE) AS monthly_revenue FROM (SELECT {EFFECTIVE} AS ep FROM users) GROUP BY ep", "users")
def p25_prices(spark: SparkSession, d: str) -> DataFrame:
    u = X.users(spark, d).select(P.effective_plan(F.col("plan"), F.col("subscription_status")).alias("plan"))
    month, year = (X.cases(F.col("plan"), {k: v[i] for k, v in P.PRICES.items()}) for i in (0, 1))
    per = month / P.limit(F.col("plan"), 2)
    return u.groupBy("plan").agg(F.count("*").alias("users"), F.max(per).alias("price_per_page"), F.max(F.round(year / 12)).alias("monthly_when_yearly"), F.sum(month).alias("monthly_revenue"))


@add("SELECT t.id, CASE WHEN i.id IS NOT NULL THEN 'ready' WHEN j.id IS NOT NULL THEN coalesce(j.status, 'queued') ELSE 'missing' END AS export_status FROM tasks t LEFT JOIN (SELECT id FROM tasks WHERE id % 5 = 0) i ON i.id = t.id LEFT JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN 'running' END AS status FROM tasks WHERE id % 2 = 0) j ON j.id = t.id", "tasks")
def p26_export_state(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d).select("id")
    cached = t.filter(F.col("id") % 5 == 0).withColumn("cached", F.lit(True))
    jobs = t.filter(F.col("id") % 2 == 0).select("id", F.when(F.col("id") % 4 == 0, "running").alias("job_status"), F.lit(True).alias("job"))
    state = F.when(F.col("cached"), "ready").when(F.col("job"), F.coalesce("job_status", F.lit("queued"))).otherwise("missing")
    return t.join(cached, "id", "left").join(jobs, "id", "left").select("id", state.alias("export_status"))


@add("SELECT t.id, CASE WHEN t.status = 'processing' AND l.id IS NULL THEN 'recoverable' ELSE t.status END AS status FROM tasks t LEFT JOIN (SELECT id FROM tasks WHERE id % 3 = 0) l ON l.id = t.id", "tasks")
def p27_progress_state(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d).select("id", "status")
    live = t.filter(F.col("id") % 3 == 0).select("id", F.lit(True).alias("live"))
    return t.join(live, "id", "left").select("id", F.when((F.col("status") == "processing") & F.col("live").isNull(), "recoverable").otherwise(F.col("status")).alias("status"))


@add(f"SELECT id, CASE WHEN {EFFECTIVE} = 'free' THEN 'basic' ELSE 'advanced' END AS model FROM users", "users")
def p28_model_by_plan(spark: SparkSession, d: str) -> DataFrame:
    u = X.users(spark, d).select("id", P.effective_plan(F.col("plan"), F.col("subscription_status")).alias("p"))
    return u.select("id", X.cases(F.col("p"), P.MODELS, "basic").alias("model"))


@add(
    """SELECT r.event_id, t.id AS task_id FROM (SELECT event_id, user_id::VARCHAR AS user_id, concat(user_id, ':', event_id % 5 + 1) AS file_id, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS source_lang, 'zh' AS target_lang FROM events) r
 JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, user_id, source_lang, target_lang ORDER BY created_at DESC, id DESC) AS rn FROM tasks WHERE status IN ('processing', 'recoverable')) t USING (file_id, user_id, source_lang, target_lang) WHERE rn = 1""",
    "tasks",
)
def j2_resumable_task(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    lang = X.cases(F.col("event_id") % 3, {0: "en", 1: "fr"}, "de")
    asked = e.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 5 + 1).cast("string")).alias("file_id"), lang.alias("source_lang"), F.lit("zh").alias("target_lang"))
    return L.resumable(X.tasks(spark, d), asked, ["processing", "recoverable"]).select("event_id", F.col("id").alias("task_id"))


@add("SELECT event_id, user_id, event_type FROM webhooks WHERE delivery = 0 AND event_id % 7 <> 0", "webhooks")
def j5_new_webhooks(spark: SparkSession, d: str) -> DataFrame:
    seen = X.table(spark, d, "events").filter(F.col("event_id") % 7 == 0).select("event_id")
    w = X.webhooks(spark, d).join(seen, "event_id", "left_anti")
    return L.latest(w.withColumn("first", -F.col("delivery")), ["event_id"], "ts", "first").select("event_id", "user_id", "event_type")


@add("SELECT DISTINCT task_id, page_number FROM page_requests WHERE task_id % 4 <> 0", "page_requests")
def j6_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    r = X.page_requests(spark, d).select("task_id", "page_number")
    return L.absent(r, r.filter(F.col("task_id") % 4 == 0), ["task_id", "page_number"])


@add("SELECT coalesce(u.id, n.id) AS id, coalesce(n.plan, u.plan) AS plan, coalesce(n.subscription_status, u.subscription_status) AS subscription_status, u.period_start FROM users u FULL OUTER JOIN (SELECT CAST(s_suppkey * 9 AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'pro' END AS plan, 'active' AS subscription_status FROM supplier) n ON n.id = u.id", "users")
def j7_upsert_users(spark: SparkSession, d: str) -> DataFrame:
    new = X.table(spark, d, "supplier").select((F.col("s_suppkey") * 9).cast("string").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "pro").alias("plan"), F.lit("active").alias("subscription_status"))
    return L.upsert(X.users(spark, d), new, "id")


@add("SELECT t.id AS task_id, n AS page_number FROM (SELECT id, unnest(range(1, CAST(id % 6 + 1 AS BIGINT))) AS n FROM tasks) t WHERE NOT EXISTS (SELECT 1 FROM task_pages p WHERE p.task_id = t.id AND p.page_number = t.n AND p.status = 'completed')", "tasks task_pages")
def j8_pending_pages(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d).withColumn("requested", F.col("id") % 6)
    return L.pending_pages(t, X.task_pages(spark, d), "requested")


@add("SELECT f.id FROM files f SEMI JOIN (SELECT file_id, user_id FROM tasks WHERE status = 'completed') t ON t.file_id = f.id AND t.user_id = f.user_id", "files tasks")
def j9_owned_files(spark: SparkSession, d: str) -> DataFrame:
    own = X.tasks(spark, d).filter("status = 'completed'").select(F.col("file_id").alias("id"), "user_id")
    return X.files(spark, d).join(own, ["id", "user_id"], "left_semi").select("id")


@add(
    """SELECT 'files' AS kept, count(*) AS n FROM files WHERE total_pages % 2 = 0 UNION ALL SELECT 'tasks', count(*) FROM tasks t JOIN files f ON f.id = t.file_id WHERE total_pages % 2 = 0
 UNION ALL SELECT 'pages', count(*) FROM task_pages p JOIN tasks t ON t.id = p.task_id JOIN files f ON f.id = t.file_id WHERE total_pages % 2 = 0 UNION ALL SELECT 'usage', count(*) FROM usage_page_events t JOIN files f ON f.id = t.file_id WHERE total_pages % 2 = 0""",
    "files tasks task_pages usage_page_events",
)
def j10_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    f, t = X.files(spark, d), X.tasks(spark, d)
    gone = f.filter(F.col("total_pages") % 2 == 1).select(F.col("id").alias("file_id"))
    gone_tasks = t.join(gone, "file_id", "left_semi").select(F.col("id").alias("task_id"))
    kept = L.cascade(gone, {"files": (f.withColumnRenamed("id", "file_id"), ["file_id"]), "tasks": (t, ["file_id"]), "usage": (X.usage_page_events(spark, d), ["file_id"])}) | L.cascade(gone_tasks, {"pages": (X.task_pages(spark, d), ["task_id"])})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kept"), "n") for k, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


GONE = "(SELECT id FROM files WHERE total_pages % 2 = 1)"
GONE_TASKS = f"(SELECT * FROM tasks WHERE file_id IN {GONE})"


@add(
    f"""SELECT 'files' AS part, id AS key FROM files WHERE id NOT IN {GONE} UNION ALL SELECT 'tasks', id::VARCHAR FROM tasks WHERE file_id NOT IN {GONE}
 UNION ALL SELECT 'usage_events', id::VARCHAR FROM tasks WHERE status = 'recoverable' AND file_id NOT IN {GONE}
 UNION ALL SELECT 'usage_page_events', concat(task_id, '/', page_number) FROM usage_page_events WHERE file_id NOT IN {GONE}
 UNION ALL SELECT 'task_pages', concat(task_id, '/', page_number) FROM task_pages WHERE task_id NOT IN (SELECT id FROM {GONE_TASKS})
 UNION ALL SELECT 'exports', concat(id, '/', unnest(['translated', 'bilingual'])) FROM tasks WHERE status = 'completed' AND file_id NOT IN {GONE}
 UNION ALL SELECT 'removed', concat('uploads/', id, '.pdf') FROM files WHERE id IN {GONE} UNION ALL SELECT 'removed', concat('results/', id, '/result.json') FROM {GONE_TASKS}
 UNION ALL SELECT 'removed', concat('results/', id, '/pages/', unnest(range(1, CAST(id % 4 + 1 AS BIGINT))), '.json') FROM {GONE_TASKS}
 UNION ALL SELECT 'orphan', concat('exports/', id, '/', unnest(['translated', 'bilingual']), '.pdf') FROM {GONE_TASKS} WHERE status = 'completed'""",
    "files tasks task_pages usage_page_events page_requests users",
)
def j10_cascade_rows(spark: SparkSession, d: str) -> DataFrame:
    """Files of an odd number of pages are deleted: what all five dependent tables keep, the storage keys that go, the exports that are left without a row."""
    f, t = X.files(spark, d), X.tasks(spark, d).withColumn("pages", F.col("id") % 4)
    exports = t.filter("status = 'completed'").select(F.col("id").alias("task_id"), F.explode(F.array(F.lit("translated"), F.lit("bilingual"))).alias("output_type"))
    events = t.filter("status = 'recoverable'").select(F.col("id").alias("task_id"), "file_id")
    tables = {"tasks": t, "task_pages": X.task_pages(spark, d), "usage_events": events, "usage_page_events": X.usage_page_events(spark, d), "exports": exports}
    kept, keys = L.delete_files(f.filter("total_pages % 2 = 1").select(F.col("id").alias("file_id")), f, tables)
    own = {"files": F.col("id"), "tasks": F.col("id").cast("string"), "usage_events": F.col("task_id").cast("string"), "exports": F.concat_ws("/", "task_id", "output_type")}
    page = F.concat_ws("/", "task_id", "page_number")
    parts = [df.select(F.lit(k).alias("part"), own.get(k, page).alias("key")) for k, df in kept.items()]
    return reduce(DataFrame.unionByName, parts, keys.select(F.when(F.col("removed"), "removed").otherwise("orphan").alias("part"), "key"))


@add(
    """SELECT id AS file_id, concat('uploads/', id, '.pdf') AS key FROM files UNION ALL SELECT file_id, concat('results/', id, '/result.json') FROM tasks
 UNION ALL SELECT file_id, concat('results/', id, '/pages/', unnest(range(1, CAST(id % 4 + 1 AS BIGINT))), '.json') FROM tasks""",
    "files tasks",
)
def u4_storage_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.storage_keys(X.files(spark, d), X.tasks(spark, d).withColumn("pages", F.col("id") % 4))


COUNTS = "SELECT task_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM task_pages GROUP BY task_id"


@add(COUNTS, "task_pages")
def a1_page_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.page_counts(X.task_pages(spark, d))


@add(f"SELECT task_id, completed AS translated_pages, completed + failed AS processed_pages, completed / greatest(task_id % 8, 1)::DOUBLE * 100 AS progress FROM ({COUNTS})", "task_pages")
def a2_task_progress(spark: SparkSession, d: str) -> DataFrame:
    return L.progress(L.page_counts(X.task_pages(spark, d)), F.col("task_id") % 8)


@add(f"SELECT user_id, count(*) AS total, count(*) FILTER (task_status = 'completed') AS completed, count(*) FILTER (task_status = 'processing') AS in_progress FROM ({HISTORY}) GROUP BY user_id", "files tasks")
def a6_dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("task_status")
    return history(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "processing").alias("in_progress"))


@add("SELECT user_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM tasks) WHERE rn = 1", "tasks")
def w1_latest_task(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(X.tasks(spark, d), ["user_id"]).select("user_id", "id", "created_at")


@add(
    """SELECT r.event_id, f.rank + f.user_id % 3 <= 20 AS admitted FROM quota_requests r JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM
 (SELECT user_id, task_id, page_number, min(ts) AS ts, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM quota_requests GROUP BY ALL) q) f USING (user_id, task_id, page_number)""".replace("GROUP BY ALL", "GROUP BY user_id, task_id, page_number"),
    "quota_requests",
)
def w2_quota_admission(spark: SparkSession, d: str) -> DataFrame:
    return L.admissions(X.quota_requests(spark, d), ["task_id", "page_number"], "user_id", ["ts", "event_id"], F.lit(20), F.col("user_id") % 3).select("event_id", "admitted")


@add(
    """SELECT task_id, page_number, arg_max(status, attempt) AS status, max(attempt) AS attempts, arg_max(status, attempt) <> 'failed' AS is_billed
 FROM (SELECT *, row_number() OVER (PARTITION BY task_id, page_number ORDER BY ts, l_partkey, l_suppkey, l_extendedprice) AS attempt FROM page_requests) WHERE attempt <= 3 GROUP BY task_id, page_number""",
    "page_requests",
)
def w12_page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("task_id", "page_number").orderBy("ts", "l_partkey", "l_suppkey", "l_extendedprice"))
    return L.page_outcomes(X.page_requests(spark, d).withColumn("attempt", n))


@add("SELECT event_id AS poll, user_id AS task_id, max(event_id % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events")
def w13_monotone_progress(spark: SparkSession, d: str) -> DataFrame:
    polls = X.table(spark, d, "events").select(F.col("event_id").alias("poll"), F.col("user_id").alias("task_id"), "ts", (F.col("event_id") % 100).alias("progress"))
    return L.running_progress(polls).select("poll", "task_id", "shown")


@add(UNITS.replace("SELECT user_id, 'free', created_at", "SELECT user_id, 'free' AS plan, created_at"), "users tasks usage_page_events")
def u1_usage_union(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).withColumn("units", F.col("units").cast("int"))


@add("SELECT DISTINCT x.lang AS source_lang, y.lang AS target_lang FROM documents x, (SELECT unnest(['en','fr','de','es','zh']) AS lang) y WHERE x.lang <> y.lang")
def u5_target_languages(spark: SparkSession, d: str) -> DataFrame:
    source = X.table(spark, d, "documents").select(F.col("lang").alias("source_lang")).distinct()
    targets = source.select("source_lang", F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "zh")])).alias("target_lang"))
    return targets.exceptAll(source.select("source_lang", F.col("source_lang").alias("target_lang")))


@add("SELECT id, user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM files ORDER BY created_at DESC, id DESC", "files")
def t1_files_newest_first(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    return X.files(spark, d).select("id", "user_id", "created_at", place.alias("place")).orderBy(F.desc("created_at"), F.desc("id"))


@add("SELECT task_id, page_number, status FROM task_pages ORDER BY task_id, page_number", "task_pages")
def t2_pages_in_order(spark: SparkSession, d: str) -> DataFrame:
    return X.task_pages(spark, d).select("task_id", "page_number", "status").orderBy("task_id", "page_number")


@add("SELECT id, created_at FROM files ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 20", "files")
def t3_third_page(spark: SparkSession, d: str) -> DataFrame:
    return L.page_of(X.files(spark, d).select("id", "created_at"), [F.desc("created_at"), F.desc("id")], 3).select("id", "created_at")


@add("SELECT t.id AS task_id, CAST(n AS INT) AS page_number, 'pending' AS status FROM (SELECT id, unnest(range(1, CAST(id % 6 + 1 AS BIGINT))) AS n FROM tasks) t WHERE NOT EXISTS (SELECT 1 FROM task_pages p WHERE p.task_id = t.id AND p.page_number = t.n) UNION ALL SELECT task_id, page_number, CASE WHEN status = 'processing' THEN 'pending' ELSE status END FROM task_pages", "tasks task_pages")
def b7_seed_and_reset_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = X.task_pages(spark, d).select("task_id", "page_number", "status")
    t = X.tasks(spark, d).withColumn("total", (F.col("id") % 6).cast("int"))
    return L.seeded_pages(t, pages, "total").unionByName(L.reset_stuck(pages))


@add("SELECT t.id, coalesce(p.status, t.status) AS status, t.user_id FROM tasks t LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 'failed' END AS status FROM tasks WHERE id % 3 = 0) p ON p.id = t.id", "tasks")
def b8_sparse_update(spark: SparkSession, d: str) -> DataFrame:
    t = X.tasks(spark, d)
    patch = t.filter(F.col("id") % 3 == 0).select("id", F.when(F.col("id") % 2 == 0, "failed").alias("status"))
    return L.patched(t.select("id", "status", "user_id"), patch, ["id"])


BODY = """SELECT event_id, '{"data":{' || CASE event_id % 3 WHEN 0 THEN '"items":[{"price":{"id":"pri_' || event_id || '"}}],' WHEN 1 THEN '"items":[{"price_id":"alt_' || event_id || '"}],' ELSE '"price_id":"top_' || event_id || '",' END
 || '"custom_data":{"plan":" Pro ","' || CASE event_id % 2 WHEN 0 THEN 'userId' ELSE 'user_id' END || '":"' || user_id || '"},"' || CASE event_id % 2 WHEN 0 THEN 'current_billing_period' ELSE 'billing_period' END || '":{"starts_at":"2024-01-0' || (event_id % 9 + 1) || 'T00:00:00Z"}}}' AS body FROM events"""


@add(
    f"""SELECT event_id, coalesce(json_extract_string(body, '$.data.items[0].price.id'), json_extract_string(body, '$.data.items[0].price_id'), json_extract_string(body, '$.data.price_id')) AS price_id,
 CASE WHEN lower(trim(json_extract_string(body, '$.data.custom_data.plan'))) IN ('starter','pro','power') THEN lower(trim(json_extract_string(body, '$.data.custom_data.plan'))) ELSE 'free' END AS plan,
 coalesce(json_extract_string(body, '$.data.custom_data.userId'), json_extract_string(body, '$.data.custom_data.user_id')) AS user_id,
 coalesce(json_extract_string(body, '$.data.current_billing_period.starts_at'), json_extract_string(body, '$.data.billing_period.starts_at')) AS starts_at FROM ({BODY})"""
)
def f14_webhook_fields(spark: SparkSession, d: str) -> DataFrame:
    X.table(spark, d, "events").createOrReplaceTempView("f14_events")
    bodies = spark.sql(BODY.replace("FROM events", "FROM f14_events"))
    get = lambda *paths: F.coalesce(*[F.get_json_object("body", f"$.data.{p}") for p in paths])
    plan = F.lower(F.trim(get("custom_data.plan")))
    return bodies.select(
        "event_id",
        get("items[0].price.id", "items[0].price_id", "price_id", "price.id").alias("price_id"),
        F.when(plan.isin("starter", "pro", "power"), plan).otherwise("free").alias("plan"),
        get("custom_data.userId", "custom_data.user_id").alias("user_id"),
        get("current_billing_period.starts_at", "billing_period.starts_at", "current_period.starts_at").alias("starts_at"),
    )


@add(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 2 HOUR ELSE ts END AS at, strftime(CASE event_id % 4 WHEN 0 THEN NULL WHEN 2 THEN ts - INTERVAL 2 HOUR ELSE ts END, '%Y-%m') AS usage_month
 FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)"""
)
def f15_f16_instants(spark: SparkSession, d: str) -> DataFrame:
    """ISO texts to instants in UTC: Z, an offset, none (UTC), or no date at all."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = X.cases(F.col("event_id") % 4, {0: "soon", 1: F.concat(stamp, F.lit("Z")), 2: F.concat(stamp, F.lit("+02:00"))}, stamp)
    at = F.try_to_timestamp(F.trim(text))
    return X.table(spark, d, "events").select("event_id", F.to_timestamp_ntz(at.cast("string")).alias("at"), F.date_format(at, "yyyy-MM").alias("usage_month"))
