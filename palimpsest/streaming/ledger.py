"""The ledger driven by streams of events, in Structured Streaming.

Sinks write each micro-batch to a folder of its own number, so a batch that is run again after a
failure replaces itself; readers take the union, or the latest row of a key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.ledger import STATUSES
from ..sources import fixtures as X
from ..sources.keyed import KeyedTable
from ..sources.scratch import new_path

CANCELLED = ["canceled", "cancelled", "paused", "deleted"]
TOLERANCE_SECONDS = 300


def read_stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    """The table as a file stream, with ts as an instant."""
    schema = X.table(spark, d, name).schema
    # a pattern, as a file stream takes a folder or a pattern, and a table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


#: The state store that keeps entries on the executors' disks, and changes them one by one.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def run(stream: DataFrame, mode: str, name: str, store: str | None = None) -> DataFrame:
    """Runs a query over all that is there and returns what it wrote, with the batch number; ``store``: its state store's class."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    out = new_path(spark, name)
    empty = spark.createDataFrame([], stream.schema.add("batch", "long"))
    empty.write.parquet(f"{out}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/part={number}")

    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if store:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(empty.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch for each key: what an update-mode sink holds."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def deduplicated(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """First delivery of each event; ids are forgotten once the watermark is past them."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def first_deliveries(events: DataFrame, known: KeyedTable, order: list[str], out: str, checkpoint: str, compact_after: int = 50) -> None:
    """Exact de-duplication, forever: the first delivery of each event_id, over all that is there.

    ``known`` is the table of processed ids (event_id and what of the event is kept). A batch's first row
    of an id, by ``order``, passes if no earlier batch has the id; it is written to ``out`` under the batch's
    number. Both sinks replace a batch that is run again, so that a replay, after a failure at any
    point, leaves what one run leaves. Rows without id or type are refused, as the ledger does. Lookups read
    the buckets of a batch's ids; from ``compact_after`` batches on, all but the present one are merged.
    """
    fields = T.StructType.fromDDL(known.schema).names

    def write(batch: DataFrame, number: int) -> None:
        valid = batch.filter((F.col("event_id").cast("string") != "") & (F.col("event_type") != ""))
        first = valid.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in fields if c != "event_id"]), F.struct(*order)).alias("_r")).select("event_id", "_r.*")
        passed = known.add(first.select(*fields), str(number))
        passed.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part={number}")
        if len(known.batches()) > compact_after:
            known.compact(but=str(number))

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def timely(events: DataFrame, seconds: int = TOLERANCE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): events whose arrival and own time are no further apart than the tolerance, either way."""
    off = F.abs(F.unix_timestamp("arrived") - F.unix_timestamp("ts"))
    return events.filter(off <= seconds).withWatermark("ts", f"{seconds} seconds"), events.filter((off > seconds) | off.isNull())


def subscription_inputs(events: DataFrame) -> DataFrame:
    """Subscription events with plan and status as they count: cancelled ones are free and inactive."""
    status = F.lower(F.trim(F.coalesce("status", F.lit("inactive"))))
    gone = status.isin(CANCELLED)
    plan = F.lower(F.trim(F.coalesce("plan", F.lit("free"))))
    plan = F.when(gone | ~plan.isin("starter", "pro", "power"), "free").otherwise(plan)
    return events.filter(F.startswith("event_type", F.lit("subscription."))).withColumns({"plan": plan, "status": F.when(gone, "inactive").otherwise(status)})


def subscriptions(events: DataFrame) -> DataFrame:
    """State of each user after all events, in order of (ts, event_id).

    A paid, active plan keeps its period's start through events that give none; a new plan, or one
    that was inactive, starts at the event. So each state's start is that of the last event that set one.
    """
    e = subscription_inputs(events)
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    paid = (F.col("plan") != "free") & F.col("status").isin("active", "trialing")
    e = e.withColumn("_paid", paid).withColumns({"_pp": F.lag("_paid").over(by), "_plan": F.lag("plan").over(by)})
    carries = F.col("period_start").isNull() & F.coalesce(F.col("_pp") & (F.col("_plan") == F.col("plan")), F.lit(False))
    e = e.withColumn("_set", F.when(F.col("_paid") & ~carries, F.coalesce("period_start", "ts")))
    e = e.withColumn("_start", F.when(F.col("_paid"), F.last("_set", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    last = F.max_by(F.struct("plan", "status", F.col("_start").alias("period_start")), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(last.alias("s")).select("user_id", "s.*")


SUBSCRIPTION = "user_id long, plan string, status string, period_start timestamp"


def subscription_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: a row for each user that a batch touched, its state kept between batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plan, status, start = json.loads(state.get[0]) if state.exists else (None, None, None)
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples(index=False):
            paid = r.plan != "free" and r.status in ("active", "trialing")
            kept = plan == r.plan and status in ("active", "trialing") and start
            given = None if pd.isna(r.period_start) else r.period_start.isoformat()
            start = (given or (kept and start) or r.ts.isoformat()) if paid else None
            plan, status = r.plan, r.status
        state.update((json.dumps([plan, status, start]),))
        yield pd.DataFrame({"user_id": [key[0]], "plan": [plan], "status": [status], "period_start": [pd.Timestamp(start) if start else pd.NaT]})

    rows = subscription_inputs(events).select("user_id", "ts", "event_id", "plan", "status", "period_start")
    return rows.groupBy("user_id").applyInPandasWithState(update, SUBSCRIPTION, "state string", "update", GroupStateTimeout.NoTimeout)


QUOTA = "event_id long, user_id long, admitted boolean"


class Quota(StatefulProcessor):
    """Keys held of each user, an entry each, and how many of each period, so that a row changes one entry and no other.

    ``keep``: days after a period's end, by the watermark, when its keys and count are forgotten; None: never.
    """

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "key string", "period string")
        self.used = handle.getMapState("used", "period string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # an entry is asked for once a batch and written once, however many rows touch it: each access is a message to the JVM
        found: dict[str, str | None] = {}
        counted: dict[str, int] = {}
        held, used = {}, {}

        def count(period: str) -> int:
            if period not in counted:
                counted[period] = used[period] = self.used.getValue((period,))[0] if self.used.containsKey((period,)) else 0
            return used[period]

        told = []
        ordered = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        needed = zip(*(ordered[c].tolist() for c in ("event_id", "key", "action", "period", "quota", "base")), strict=True)
        for event, name, action, period, quota, base in needed:
            if name not in found:
                found[name] = held[name] = self.held.getValue((name,))[0] if self.held.containsKey((name,)) else None
            mine = held[name]
            if action == "release":
                if mine is not None:
                    held[name] = None
                    used[mine] = max(count(mine) - 1, 0)
                continue
            admitted = mine is not None or pd.isna(quota) or quota <= 0 or count(period) + (0 if pd.isna(base) else base) < quota
            if admitted and mine is None:
                held[name] = period
                used[period] = count(period) + 1
                if self.keep is not None:
                    end = pd.Timestamp(f"{period}-01", tz="UTC") + pd.DateOffset(months=1, days=self.keep)
                    self.handle.registerTimer(int(end.timestamp() * 1000))
            told.append((event, key[0], bool(admitted)))
        for state, before, now in ((self.held, found, held), (self.used, counted, used)):
            for k, v in now.items():
                if v and v != before[k]:
                    state.updateValue((k,), (v,))
                elif before[k] and not v:
                    state.removeKey((k,))
        yield pd.DataFrame(told, columns=["event_id", "user_id", "admitted"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms", tz="UTC")
        ended = lambda p: pd.Timestamp(f"{p}-01", tz="UTC") + pd.DateOffset(months=1, days=self.keep) <= now
        for (k,), (period,) in list(self.held.iterator()):
            if ended(period):
                self.held.removeKey((k,))
        for (period,), _ in list(self.used.iterator()):
            if ended(period):
                self.used.removeKey((period,))
        return iter(())

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, keep: int | None = None) -> DataFrame:
    """Reservations of (task, page) keys with releases; ``requests``: event_id, ts, user_id, key, action, period (yyyy-MM), quota, base.

    A key held already is admitted free, in whatever period it was reserved; a new one while the keys held
    of its period and ``base``, what was used before the stream began, are fewer than ``quota`` (null or not
    positive: no limit). A release gives one back. Run it with ``run(..., store=ROCKS)``. With ``keep``, and
    a watermark on ts, a period's keys are forgotten that many days after its end: reserved again, they count again.
    """
    return requests.groupBy("user_id").transformWithStateInPandas(Quota(keep), QUOTA, "append", "none" if keep is None else "eventtime")


def running_usage(events: DataFrame) -> DataFrame:
    """Units of each user and month so far (update or complete mode)."""
    return events.groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("units"))


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Units of each user and day; a day is final, and its state dropped, once the watermark is past it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.count("*").alias("units")).select("user_id", F.col("day.start").alias("day"), "units")


def live_progress(pages: DataFrame) -> DataFrame:
    """Pages of each task by status so far (update mode)."""
    return pages.groupBy("task_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
