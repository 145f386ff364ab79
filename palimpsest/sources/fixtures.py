"""Ledger, block and event tables derived from the given star-schema tables.

``VIEWS`` says the same in SQL for the oracle, in the order in which one builds on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cases(key: Column, values: dict, other=None) -> Column:
    """``values`` by key; ``other`` for any other key."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, v if isinstance(v, Column) else F.lit(v))
    return out.otherwise(other if isinstance(other, Column) else F.lit(other))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    plan = cases(F.col("c_mktsegment"), {"BUILDING": "free", "AUTOMOBILE": " Starter ", "MACHINERY": "pro", "HOUSEHOLD": "power"}, "legacy")
    status = cases(F.col("c_custkey") % 4, {0: "active", 1: "trialing", 2: "past_due"})
    start = F.when(F.col("c_custkey") % 3 != 0, ntz("1998-06-15 00:00:00"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), plan.alias("plan"), status.alias("subscription_status"), start.alias("period_start"))


def file_id() -> Column:
    return F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.substring("o_orderpriority", 1, 1))


def files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    out = o.groupBy("o_custkey", "o_orderpriority").agg((F.sum(F.floor("o_totalprice").cast("long")) * 100).alias("file_size"), (F.count("*") * 3 + 1).cast("int").alias("total_pages"), F.min("o_orderdate").alias("created_at"))
    name = F.concat(F.lit("file_"), F.substring("o_orderpriority", 1, 1), F.lit(".pdf"))
    return out.select(file_id().alias("id"), F.col("o_custkey").cast("string").alias("user_id"), name.alias("original_filename"), "file_size", "total_pages", "created_at")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    lang = cases(F.col("o_orderkey") % 3, {0: "en", 1: "fr"}, "de")
    status = cases(F.col("o_orderstatus"), {"F": "completed", "O": "processing"}, "recoverable")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), file_id().alias("file_id"), F.col("o_custkey").cast("string").alias("user_id"), lang.alias("source_lang"), F.lit("zh").alias("target_lang"), status.alias("status"), F.col("o_orderdate").alias("created_at")
    )


def page_requests(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    status = F.when(done & (F.col("l_returnflag") == "A"), "completed").when(done & (F.col("l_returnflag") == "R"), "failed").when(done, "processing").otherwise("pending")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("page_number"), F.col("l_shipdate").alias("ts"), "l_partkey", "l_suppkey", "l_extendedprice", status.alias("status"))


def task_pages(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("task_id", "page_number").orderBy("ts", "l_partkey", "l_suppkey", "l_extendedprice"))
    return page_requests(spark, d).withColumn("rn", first).filter("rn = 1").select("task_id", "page_number", "ts", "status")


def usage_page_events(spark: SparkSession, d: str) -> DataFrame:
    p, t, u = task_pages(spark, d), tasks(spark, d), users(spark, d).select(F.col("id").alias("user_id"), "plan")
    joined = p.filter(F.col("status").isin("completed", "processing")).join(t.select(F.col("id").alias("task_id"), "file_id", "user_id"), "task_id").join(u, "user_id")
    return joined.select("task_id", "page_number", "file_id", "user_id", "plan", F.col("ts").alias("created_at"), F.date_format("ts", "yyyy-MM").alias("usage_month"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document is a block; 40 lines are a page in two columns."""
    lines = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("ln", "t"))
    ln, n = F.col("ln"), F.length("t")
    x0, y0 = 72 + 250 * (ln % 2), 20 + 18 * (ln % 40)
    box = {"x0": x0, "y0": y0, "x1": x0 + F.least(F.lit(220), 4 * n), "y1": y0 + 10, "font_size": F.when(n < 60, 14).otherwise(10)}
    return lines.select("doc_id", F.floor(ln / 40).cast("int").alias("page_num"), ln.alias("block_index"), F.col("t").alias("text"), "lang", *[v.cast("double").alias(k) for k, v in box.items()])


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text in two raw blocks a page, close enough to be joined or cut by the layout rules."""
    b, n = blocks(spark, d), F.col("block_index")
    x0 = (72 + 250 * (n % 2) + F.when(n % 5 == 0, 9).otherwise(0)).cast("double")
    y0 = 20.0 + 6.5 * (n % 40)
    font = F.when(n % 7 == 0, 11.0).otherwise(10.0)
    return b.select("doc_id", "page_num", (n % 2).alias("raw"), n.alias("line"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.lit(220), 4 * F.length("text"))).alias("x1"), (y0 + 10.0).alias("y1"), font.alias("font_size"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


def spans(spark: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The words of each line as spans, with fonts, flags and colours; ``by``: what they are grouped by, so that lines are dealt and not their spans, which are larger."""
    lines = layout_lines(spark, d)
    return spans_of(lines.repartition(*by) if by else lines)


def spans_of(lines: DataFrame) -> DataFrame:
    words = lines.select("doc_id", "page_num", "raw", "line", "x0", "y0", "y1", "font_size", F.posexplode(F.split("text", " ")).alias("span", "text"))
    x0, w = F.col("x0") + 30.0 * F.col("span"), 4.0 * F.length("text")
    return words.select(
        "doc_id", "page_num", "raw", "line", "span", "text", x0.alias("x0"), "y0", (x0 + w).alias("x1"), "y1", (F.col("font_size") + F.col("span") % 3).alias("font_size"),
        F.when(F.col("span") % 4 == 0, "Serif-Bold").otherwise("Serif").alias("font"), F.when(F.col("span") % 5 == 0, 16).otherwise(0).alias("flags"), F.when(F.col("span") % 3 == 0, 0x336699).otherwise(0x111111).alias("color"),
    )


def quality_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with a mock translation that is damaged in some blocks."""
    t = F.col("text")
    wrap = lambda x: F.concat(F.lit("[zh: "), x, F.lit("]"))
    damaged = cases(F.col("block_index") % 7, {0: "", 1: wrap(F.concat(t, F.lit(" ??????"))), 2: wrap(F.regexp_replace(t, "[0-9]", ""))}, wrap(t))
    return blocks(spark, d).withColumn("translated", damaged)


def quota_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    asked = table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase")).withColumn("k", k)
    return asked.select("event_id", "ts", "user_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("k") % 10).cast("string")).alias("task_id"), (F.col("k") % 7 + 1).alias("page_number"))


def webhook_rows(e: DataFrame) -> DataFrame:
    """Subscription events of ``e`` (events); every tenth is delivered again with another body."""
    kind = cases(F.col("event_type"), {"signup": "subscription.created", "purchase": "subscription.updated", "error": "subscription.canceled"}, "transaction.completed")
    plan = cases(F.col("event_id") % 4, {0: "starter", 1: "pro", 2: "power"})
    status = F.when(F.col("event_type") == "error", "canceled").when(F.col("event_id") % 3 == 0, "trialing").otherwise("active")
    start = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    both = e.withColumn("delivery", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    first = F.col("delivery") == 0
    return both.select(
        "event_id", "ts", "user_id", "delivery", F.when(first, kind).otherwise("transaction.completed").alias("event_type"), F.when(first, plan).alias("plan"), F.when(first, status).otherwise("active").alias("status"), F.when(first, start).alias("period_start")
    )


def webhooks(spark: SparkSession, d: str) -> DataFrame:
    return webhook_rows(table(spark, d, "events"))


VIEWS = {
    "users": """SELECT CAST(c_custkey AS VARCHAR) AS id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'AUTOMOBILE' THEN ' Starter ' WHEN 'MACHINERY' THEN 'pro'
            WHEN 'HOUSEHOLD' THEN 'power' ELSE 'legacy' END AS plan,
       CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' ELSE NULL END AS subscription_status,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1998-06-15 00:00:00' END AS period_start FROM customer""",
    "files": """SELECT concat(CAST(o_custkey AS VARCHAR), ':', substr(o_orderpriority, 1, 1)) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
       concat('file_', substr(o_orderpriority, 1, 1), '.pdf') AS original_filename,
       CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) * 100 AS BIGINT) AS file_size, CAST(1 + count(*) * 3 AS INT) AS total_pages, min(o_orderdate) AS created_at
FROM orders GROUP BY o_custkey, o_orderpriority""",
    "tasks": """SELECT o_orderkey AS id, concat(CAST(o_custkey AS VARCHAR), ':', substr(o_orderpriority, 1, 1)) AS file_id, CAST(o_custkey AS VARCHAR) AS user_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS source_lang, 'zh' AS target_lang,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'recoverable' END AS status, o_orderdate AS created_at FROM orders""",
    "page_requests": """SELECT l_orderkey AS task_id, l_linenumber AS page_number, l_shipdate AS ts, l_partkey, l_suppkey, l_extendedprice,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'completed' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'failed'
            WHEN l_linestatus = 'F' THEN 'processing' ELSE 'pending' END AS status FROM lineitem""",
    "task_pages": """SELECT task_id, page_number, ts, status FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, page_number ORDER BY ts, l_partkey, l_suppkey, l_extendedprice) AS rn FROM page_requests) q WHERE rn = 1""",
    "usage_page_events": """SELECT p.task_id, p.page_number, t.file_id, t.user_id, u.plan, p.ts AS created_at, substr(CAST(p.ts AS VARCHAR), 1, 7) AS usage_month
FROM task_pages p JOIN tasks t ON t.id = p.task_id JOIN users u ON u.id = t.user_id WHERE p.status IN ('completed', 'processing')""",
    "blocks": """SELECT doc_id, CAST(ln // 40 AS INT) AS page_num, CAST(ln AS INT) AS block_index, t AS text, lang,
       CAST(72+250*(ln%2) AS DOUBLE) AS x0, CAST(20+18*(ln%40) AS DOUBLE) AS y0,
       CAST(72+250*(ln%2)+least(220,4*length(t)) AS DOUBLE) AS x1, CAST(30+18*(ln%40) AS DOUBLE) AS y1,
       CAST(CASE WHEN length(t)<60 THEN 14 ELSE 10 END AS DOUBLE) AS font_size
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)""",
    "layout_lines": """SELECT doc_id, page_num, block_index % 2 AS raw, block_index AS line, text, x0, y0, x0 + least(220, 4 * length(text)) AS x1, y0 + 10 AS y1, font_size, 612::DOUBLE AS page_width, 792::DOUBLE AS page_height FROM
 (SELECT doc_id, page_num, block_index, text, (72 + 250 * (block_index % 2) + CASE WHEN block_index % 5 = 0 THEN 9 ELSE 0 END)::DOUBLE AS x0, 20 + 6.5::DOUBLE * (block_index % 40) AS y0, CASE WHEN block_index % 7 = 0 THEN 11 ELSE 10 END::DOUBLE AS font_size FROM blocks)""",
    "spans": """SELECT doc_id, page_num, raw, line, span, text, x0 + 30 * span AS x0, y0, x0 + 30 * span + 4 * length(text) AS x1, y1, font_size + span % 3 AS font_size, CASE WHEN span % 4 = 0 THEN 'Serif-Bold' ELSE 'Serif' END AS font,
 CASE WHEN span % 5 = 0 THEN 16 ELSE 0 END AS flags, CASE WHEN span % 3 = 0 THEN 3368601 ELSE 1118481 END AS color FROM (SELECT * EXCLUDE (text), unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS span FROM layout_lines)""",
    "quality_pairs": """SELECT *, CASE block_index % 7 WHEN 0 THEN '' WHEN 1 THEN concat('[zh: ', text, ' ??????]') WHEN 2 THEN concat('[zh: ', regexp_replace(text, '[0-9]', '', 'g'), ']')
ELSE concat('[zh: ', text, ']') END AS translated FROM blocks""",
    "quota_requests": """SELECT event_id, ts, user_id, concat(CAST(user_id AS VARCHAR), ':', CAST(k % 10 AS VARCHAR)) AS task_id, k % 7 + 1 AS page_number
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('view','click','purchase')) q""",
    "webhooks": """SELECT event_id, ts, user_id, 0 AS delivery,
       CASE event_type WHEN 'signup' THEN 'subscription.created' WHEN 'purchase' THEN 'subscription.updated' WHEN 'error' THEN 'subscription.canceled' ELSE 'transaction.completed' END AS event_type,
       CASE event_id % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' WHEN 2 THEN 'power' ELSE NULL END AS plan,
       CASE WHEN event_type='error' THEN 'canceled' WHEN event_id % 3 = 0 THEN 'trialing' ELSE 'active' END AS status,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS period_start FROM events
UNION ALL SELECT event_id, ts, user_id, 1, 'transaction.completed', NULL, 'active', NULL FROM events WHERE event_id % 10 = 0""",
}
NEEDS = {"task_pages": "page_requests", "usage_page_events": "page_requests task_pages tasks users", "quality_pairs": "blocks", "layout_lines": "blocks", "spans": "blocks layout_lines"}


def with_views(names: list[str]) -> str:
    """A WITH clause that defines the named views and what they build on."""
    wanted = {x for n in names for x in (*NEEDS.get(n, "").split(), n)}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted) + "\n" if wanted else ""
