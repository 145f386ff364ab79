"""Queries that run a stream over what is there; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources import fixtures as X
from ..sources.keyed import KeyedTable
from ..sources.scratch import new_path
from ..streaming import ledger as S
from .catalog import Catalog

catalog = Catalog()
add = catalog.add


def webhooks(spark: SparkSession, d: str) -> DataFrame:
    return X.webhook_rows(S.read_stream(spark, d))


@add("SELECT event_id, user_id FROM events")
def st1_deduplicated_webhooks(spark: SparkSession, d: str) -> DataFrame:
    return S.run(S.deduplicated(webhooks(spark, d)).select("event_id", "user_id"), "append", "st1").select("event_id", "user_id")


@add("SELECT event_id, user_id, event_type FROM webhooks WHERE delivery = 0", "webhooks")
def st1_exact_webhooks(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each event against a table of all ids ever processed."""
    known, out = KeyedTable(spark, new_path(spark, "webhook-ids"), "event_id long, user_id long, event_type string", ("event_id",)), new_path(spark, "webhooks")
    S.first_deliveries(webhooks(spark, d), known, ["ts", "delivery"], out, new_path(spark, "st1-state"))
    return known.rows().select("event_id", "user_id", "event_type")


SUBSCRIPTIONS = """SELECT user_id, plan, status, CASE WHEN paid THEN start END AS period_start FROM (SELECT *, last_value(CASE WHEN paid AND NOT (period_start IS NULL AND coalesce(pp AND pplan = plan, FALSE)) THEN coalesce(period_start, ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS start,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, lag(paid) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pp, lag(plan) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pplan FROM (
   SELECT *, plan <> 'free' AND status IN ('active', 'trialing') AS paid FROM (SELECT event_id, ts, user_id, period_start, CASE WHEN status = 'canceled' OR plan IS NULL THEN 'free' ELSE plan END AS plan, CASE WHEN status = 'canceled' THEN 'inactive' ELSE status END AS status FROM webhooks WHERE delivery = 0 AND event_type LIKE 'subscription.%')))) WHERE rn = 1"""


def ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@add(SUBSCRIPTIONS, "webhooks")
def st2_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    return ntz(S.subscriptions(X.webhooks(spark, d).filter("delivery = 0")))


@add(SUBSCRIPTIONS, "webhooks")
def st2_subscription_stream(spark: SparkSession, d: str) -> DataFrame:
    states = S.run(S.subscription_stream(webhooks(spark, d).filter("delivery = 0")), "update", "st2")
    return ntz(S.newest(states, ["user_id"]))


@add()
def st3_quota_with_releases(spark: SparkSession, d: str) -> DataFrame:
    """Views, clicks and purchases reserve pages, errors release them; every third user has no limit, every second used a page before."""
    e = S.read_stream(spark, d).filter(F.col("event_type").isin("view", "click", "purchase", "error"))
    k = F.get_json_object("props", "$.k").cast("int") % 10
    action = F.when(F.col("event_type") == "error", "release").otherwise("reserve")
    asked = e.select("event_id", "ts", "user_id", F.concat_ws(":", "user_id", k).alias("key"), action.alias("action"), F.date_format("ts", "yyyy-MM").alias("period"), F.when(F.col("user_id") % 3 != 0, 5).alias("quota"), (F.col("user_id") % 2).cast("int").alias("base"))
    return S.run(S.quota_stream(asked), "append", "st3", S.ROCKS).select("event_id", "user_id", "admitted")


@add("SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS units FROM events GROUP BY ALL")
def st4_running_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = S.run(S.running_usage(S.read_stream(spark, d)), "update", "st4")
    return S.newest(rows, ["user_id", "month"]).withColumn("month", F.col("month").cast("timestamp_ntz"))


@add("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS units FROM events GROUP BY ALL")
def st4_daily_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = S.run(S.daily_usage(S.read_stream(spark, d)), "update", "st4-daily")
    return S.newest(rows, ["user_id", "day"]).withColumn("day", F.col("day").cast("timestamp_ntz"))


@add("SELECT user_id AS task_id, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS processing, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL")
def st5_live_progress(spark: SparkSession, d: str) -> DataFrame:
    status = X.cases(F.col("event_type"), {"view": "pending", "click": "processing", "purchase": "completed", "error": "failed"})
    pages = S.read_stream(spark, d).select(F.col("user_id").alias("task_id"), status.alias("status"))
    return S.newest(S.run(S.live_progress(pages), "update", "st5"), ["task_id"])


@add("SELECT event_id, abs(event_id % 900 - 400) <= 300 AS accepted FROM events")
def st6_timely_events(spark: SparkSession, d: str) -> DataFrame:
    arrived = F.timestamp_seconds(F.unix_timestamp("ts") + F.col("event_id") % 900 - 400)
    accepted, rejected = S.timely(S.read_stream(spark, d).withColumn("arrived", arrived))
    ids = lambda df, ok: S.run(df.select("event_id"), "append", "st6").select("event_id", F.lit(ok).alias("accepted"))
    return ids(accepted, True).unionByName(ids(rejected, False))


@add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'not_pdf_name' WHEN o_orderkey % 7 = 0 THEN 'not_pdf_content' WHEN CAST(floor(o_totalprice) AS BIGINT) * 200 > CASE o_custkey % 2 WHEN 0 THEN 25 ELSE 50 END::BIGINT * 1048576 THEN 'too_large' END AS reason FROM orders")
def st7_upload_stream(spark: SparkSession, d: str) -> DataFrame:
    """Uploads as they arrive, against the static plans."""
    o = S.read_stream(spark, d, "orders")
    plans = X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "free").otherwise("starter").alias("plan"))
    name = F.when(F.col("o_orderkey") % 5 == 0, "a.txt").otherwise("a.PDF")
    head = F.when(F.col("o_orderkey") % 7 == 0, "GIF8").otherwise("%PDF")
    uploads = o.join(plans, "o_custkey").select(F.col("o_orderkey").alias("id"), name.alias("name"), head.alias("head"), (F.floor("o_totalprice").cast("long") * 200).alias("size"), "plan")
    return S.run(L.validate_uploads(uploads, F.col("plan")).select("id", "reason"), "append", "st7").select("id", "reason")
