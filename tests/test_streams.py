"""Streams over several micro-batches, with repeated and late rows, against the batch result or plain Python."""

from __future__ import annotations

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.sources import fixtures
from palimpsest.sources.keyed import KeyedTable
from palimpsest.sources.scratch import new_path
from palimpsest.streaming import ledger as S

from .conftest import SF


def stream_of(spark, path, parts):
    """A stream that takes each of ``parts`` as a micro-batch of its own."""
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def parts(spark):
    """The events in three parts by time; the second and third repeat the tenth of the part before them."""
    e = fixtures.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = (r.timestamp() for r in e.select(F.percentile_approx(F.unix_timestamp("ts"), [0.33, 0.66]).alias("p")).select(F.timestamp_seconds(F.col("p")[0]), F.timestamp_seconds(F.col("p")[1])).first())
    t = F.unix_timestamp("ts")
    cut = [e.filter(t < a), e.filter((t >= a) & (t < b)), e.filter(t >= b)]
    again = [None, *[c.filter("event_id % 10 = 0") for c in cut[:2]]]
    return [c if x is None else c.unionByName(x) for c, x in zip(cut, again, strict=True)]


def plain(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_dedup_across_batches(spark, parts, tmp_path):
    out = S.run(S.deduplicated(stream_of(spark, str(tmp_path / "in"), parts)).select("event_id"), "append", "dedup")
    ids = [r["event_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and out.select("batch").distinct().count() == 3
    assert set(ids) == {r["event_id"] for p in parts for r in p.select("event_id").collect()}


def test_counts_across_batches(spark, parts, tmp_path):
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    months = S.newest(S.run(S.running_usage(stream_of(spark, str(tmp_path / "a"), parts)), "update", "months"), ["user_id", "month"])
    assert plain(months, ["user_id", "month", "units"]) == plain(S.running_usage(whole), ["user_id", "month", "units"])
    status = lambda e: e.select(F.col("user_id").alias("task_id"), fixtures.cases(F.col("event_type"), {"view": "pending", "click": "processing", "purchase": "completed", "error": "failed"}).alias("status"))
    columns = ["task_id", "pending", "processing", "completed", "failed"]
    live = S.newest(S.run(S.live_progress(status(stream_of(spark, str(tmp_path / "b"), parts))), "update", "live"), ["task_id"])
    assert plain(live, columns) == plain(S.live_progress(status(whole)), columns)


def test_subscriptions_across_batches(spark, parts, tmp_path):
    first = lambda e: fixtures.webhook_rows(e).filter("delivery = 0")
    once = [p.dropDuplicates(["event_id"]) for p in (parts[0], parts[1].filter(F.col("ts") > parts[0].agg(F.max("ts")).first()[0]), parts[2].filter(F.col("ts") > parts[1].agg(F.max("ts")).first()[0]))]
    states = S.newest(S.run(S.subscription_stream(first(stream_of(spark, str(tmp_path / "in"), once))), "update", "subscriptions"), ["user_id"])
    columns = ["user_id", "plan", "status", "period_start"]
    want = S.subscriptions(first(once[0].unionByName(once[1]).unionByName(once[2])))
    assert [tuple(map(str, r)) for r in plain(states, columns[:3])] == [tuple(map(str, r)) for r in plain(want, columns[:3])]
    assert {(r["user_id"], r["period_start"]) for r in states.collect()} == {(r["user_id"], r["period_start"]) for r in want.collect()}


def test_late_rows_are_dropped_once_a_day_is_final(spark, tmp_path):
    day = lambda d, h=12: datetime.datetime(2024, 3, d, h)
    schema = "event_id long, ts timestamp, user_id long"
    rows = [[(1, day(1), 7), (2, day(2), 7)], [(3, day(6), 7), (4, day(1), 7)], [(5, day(6, 15), 7)], [(6, day(1), 7), (7, day(12), 7)]]
    stream = stream_of(spark, str(tmp_path / "in"), [spark.createDataFrame(r, schema) for r in rows])
    out = S.run(S.daily_usage(stream), "append", "days").collect()
    # the row of 1 March in the second batch is within the watermark of the first; that in the last is behind that of the second
    assert {(r["day"].day, r["units"]) for r in out} == {(1, 2), (2, 1), (6, 2)}


def by_hand(rows):
    """Answers by event_id: the ledger's rule, row by row."""
    held, told = {}, {}
    for event, _, user, key, action, period, quota, base in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = held.setdefault(user, {})
        if action == "release":
            mine.pop(key, None)
            continue
        used = (base or 0) + sum(p == period for p in mine.values())
        told[event] = key in mine or quota is None or quota <= 0 or used < quota
        if told[event]:
            mine.setdefault(key, period)
    return told


def test_quota_across_batches(spark, tmp_path):
    """Users with a quota, none, and zero; two periods; pages used before; releases in later batches."""
    start = datetime.datetime(2024, 1, 1)
    quotas = {0: 3, 1: None, 2: 0, 3: 2}
    rows = [(i, start + datetime.timedelta(hours=i), i % 4, f"k{i * 7 % 11}", "release" if i % 9 == 8 else "reserve", "2024-01" if i < 50 else "2024-02", quotas[i % 4], 1 if i % 4 == 3 else None) for i in range(100)]
    schema = "event_id long, ts timestamp, user_id long, key string, action string, period string, quota int, base int"
    stream = stream_of(spark, str(tmp_path / "in"), [spark.createDataFrame(rows[k : k + 25], schema) for k in range(0, 100, 25)])
    out = S.run(S.quota_stream(stream), "append", "quota", S.ROCKS)
    want = by_hand(rows)
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == want
    assert {False, True} == {v for k, v in want.items() if k % 4 == 0} and all(v for k, v in want.items() if k % 4 in (1, 2))


def test_closed_periods_are_forgotten(spark, tmp_path):
    """A key of January still counts as held in February; once January ended a week before the watermark it is asked for anew."""
    at = lambda m, d: datetime.datetime(2024, m, d)
    row = lambda i, ts, key, period: (i, ts, 1, key, "reserve", period, 1, None)
    parts = [[row(1, at(1, 5), "a", "2024-01")], [row(2, at(2, 2), "a", "2024-02"), row(3, at(2, 3), "b", "2024-02")], [row(4, at(2, 20), "c", "2024-02")], [row(7, at(2, 20), "d", "2024-02")], [row(5, at(2, 21), "a", "2024-02")], [row(6, at(3, 1), "a", "2024-03")]]
    schema = "event_id long, ts timestamp, user_id long, key string, action string, period string, quota int, base int"
    frames = [spark.createDataFrame(r, schema) for r in parts]
    want = {True: {1: True, 2: True, 3: True, 4: False, 7: False, 5: False, 6: True}, False: {1: True, 2: True, 3: True, 4: False, 7: False, 5: True, 6: True}}
    for forgets in (True, False):
        stream = stream_of(spark, str(tmp_path / f"in{forgets}"), frames).withWatermark("ts", "1 day")
        out = S.run(S.quota_stream(stream, keep=7 if forgets else None), "append", "quota", S.ROCKS)
        assert {r["event_id"]: r["admitted"] for r in out.collect()} == want[forgets]


SEEN = "event_id long, user_id long, event_type string"


def deliveries(spark):
    """Three batches: ids repeated within one, in the next, and a year later, past any watermark; rows without id or type."""
    ts = lambda y, h: datetime.datetime(y, 1, 1, h)
    rows = [
        [(1, ts(2023, 1), 7, "subscription.created"), (1, ts(2023, 0), 8, "transaction.completed"), (2, ts(2023, 2), 7, "a")],
        [(2, ts(2023, 3), 9, "late"), (3, ts(2023, 4), 7, "b"), (None, ts(2023, 4), 7, "b"), (4, ts(2023, 4), 7, ""), (5, ts(2023, 4), 7, None)],
        [(1, ts(2024, 1), 9, "late"), (3, ts(2024, 1), 9, "late"), (4, ts(2024, 1), 7, "c")],
    ]
    return [spark.createDataFrame(r, "event_id long, ts timestamp, user_id long, event_type string") for r in rows]


WANT = {0: {(1, 8, "transaction.completed"), (2, 7, "a")}, 1: {(3, 7, "b")}, 2: {(4, 7, "c")}}


def passed(spark, out):
    found = {}
    for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect():
        found.setdefault(r["batch"], set()).add((r["event_id"], r["user_id"], r["event_type"]))
    return found


@pytest.mark.parametrize("compact_after", [1, 50])
def test_ids_are_known_forever(spark, tmp_path, compact_after):
    known = KeyedTable(spark, new_path(spark, "ids"), SEEN, ("event_id",))
    S.first_deliveries(stream_of(spark, str(tmp_path / "in"), deliveries(spark)), known, ["ts"], str(tmp_path / "out"), str(tmp_path / "state"), compact_after)
    assert passed(spark, str(tmp_path / "out")) == WANT
    assert known.rows().count() == 4


def test_a_replayed_batch_passes_the_same_rows(spark, tmp_path):
    """The stream breaks off after the ids are kept and before the batch is done; run again, it takes the batch anew."""
    known = KeyedTable(spark, new_path(spark, "ids"), SEEN, ("event_id",))
    stream = lambda: spark.readStream.schema(deliveries(spark)[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: S.first_deliveries(stream(), known, ["ts"], str(tmp_path / "out"), str(tmp_path / "state"))
    parts = deliveries(spark)
    stream_of(spark, str(tmp_path / "in"), parts[:1])
    run()
    # the second batch's ids are there already, as if its run had ended just after keeping them
    known.add(parts[1].filter("event_type = 'b' and event_id = 3").select("event_id", "user_id", "event_type"), "1")
    stream_of(spark, str(tmp_path / "in"), parts[1:])
    run()
    assert passed(spark, str(tmp_path / "out")) == WANT and known.rows().count() == 4


class Entries(dict):
    """A map state that counts its messages."""

    def __init__(self):
        self.messages = 0

    def told(self, out=None):
        self.messages += 1
        return out

    def containsKey(self, k):  # noqa: N802
        return self.told(k in self)

    def getValue(self, k):  # noqa: N802
        return self.told(self[k])

    def updateValue(self, k, v):  # noqa: N802
        self.told(self.__setitem__(k, v))

    def removeKey(self, k):  # noqa: N802
        self.told(self.pop(k))


def test_quota_asks_its_state_once_a_key_and_batch():
    """Thousands of rows of one user on ten keys, in two batches: right answers, right state, few messages."""
    start, quota = datetime.datetime(2024, 1, 1), S.Quota()
    quota.held, quota.used = Entries(), Entries()
    rows = [(i, start + datetime.timedelta(minutes=i), 1, f"k{i * 7 % 10}", "release" if i % 9 >= 7 else "reserve", "2024-01" if i < 3000 else "2024-02", 5, 1) for i in range(4000)]
    told = {}
    for part in (rows[:2000], rows[2000:]):
        frame = pd.DataFrame(part, columns=["event_id", "ts", "user_id", "key", "action", "period", "quota", "base"])
        told |= {r.event_id: r.admitted for out in quota.handleInputRows((1,), iter([frame]), None) for r in out.itertuples()}
    assert told == by_hand(rows) and {True, False} == set(told.values())
    periods = [p for p, in quota.held.values()]
    assert {p: n for (p,), (n,) in quota.used.items()} == {p: periods.count(p) for p in periods}
    assert quota.held.messages + quota.used.messages <= 2 * 3 * 12
