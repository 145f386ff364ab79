"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a piecewise linear schedule over training time 0..1. Its integral is the
source's share of the token budget; inverted, it tells when the source's next token is due. A
source's documents stand in a fixed pseudo-random order; a document's place among its source's
tokens gives its position in training, and the mix is range-sorted by position.

Everything is DataFrame functions. Running totals are taken in two steps, over hash buckets of a
source and then inside each bucket, so that a source with a third of all rows is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

Schedule = list[tuple[float, float]]

#: (time, weight) knots. Sources in order of their names take these in turn: prose that opens
#: training and fades, a level one, and one kept for the end. Their integrals are 5, 2 and 1.
SCHEDULES: list[Schedule] = [[(0.0, 7.5), (1.0, 2.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)]]
BUDGET = 1.5
MOST = 2
BUCKET_BITS = 12
SEED = 7


def area(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))


def due(u: Column, schedule: Schedule) -> Column:
    """The time by which the share ``u`` of the schedule's tokens is used: its integral, inverted."""
    out, before, total = F.lit(schedule[-1][0]), area(schedule), area(schedule)
    for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:], strict=False))):
        before -= (t1 - t0) * (w0 + w1) / 2
        d, slope = F.greatest(u * total - before, F.lit(0.0)), (w1 - w0) / (t1 - t0)
        x = F.try_divide(2 * d, w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * d, F.lit(0.0))))
        out = F.when(u * total <= before + (t1 - t0) * (w0 + w1) / 2, t0 + F.coalesce(F.least(x, F.lit(t1 - t0)), F.lit(0.0))).otherwise(out)
    return out


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x09-\\x0D\\x20]+")).cast("long")


def targets(sizes: DataFrame, schedules: list[Schedule], budget: float, most: int) -> DataFrame:
    """key, source_size, target and rank's schedule for each row (key, source_size): one row a source.

    The budget goes out by weight; a source that would pass ``most`` times its size stops there
    and the rest is shared again. Sources stop in order of ``most * size / weight``, so running
    sums in that order give the level at which the sharing ends.
    """
    weight = F.element_at(F.array(*[F.lit(area(s)) for s in schedules]), F.col("schedule") + 1)
    ranked = sizes.withColumn("schedule", ((F.row_number().over(Window.orderBy(F.col("key").asc())) - 1) % len(schedules)).cast("int")).withColumn("weight", weight)
    cap = (most * F.col("source_size")).cast("double")
    order = Window.orderBy(F.col("stop"), F.col("key"))
    everywhere = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (budget * F.sum("source_size").over(everywhere) - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    levels = ranked.withColumn("stop", cap / F.col("weight")).withColumn("level", level)
    # the first source in this order that does not stop sets the level for all after it
    ends = levels.withColumn("end", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "key", "level"))).over(everywhere))
    stops = F.col("end").isNull() | (F.struct("stop", "key") < F.struct(F.col("end.stop").alias("stop"), F.col("end.key").alias("key")))
    return ends.select("key", "source_size", "schedule", F.when(stops, cap).otherwise(F.least(F.col("end.level") * F.col("weight"), cap)).alias("target"))


def mix(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` with size, source_size (long), target (double), copies, taken (long) and positions.

    A source's mix goes through all its documents as often as they fit in its target and ends at
    the document that comes nearest to it; ``copies`` is how often a document is taken, at most
    ``most``, and ``positions`` when (array of double, 0..1). The same rows give the same mix.

    * null text: size 0. Null source: a source of its own, last in the order of sources.
    * a source of size 0 has target 0; its documents are not taken.
    * repeated rows are taken each by itself. Empty table: empty result.
    * columns of ``docs`` that have these names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    return _mixed(docs, keep, schedules, budget, most).select("row.*", *ADDED)


ADDED = ["size", "source_size", "target", "copies", "taken", "positions"]


def _mixed(docs: DataFrame, keep: list[str], schedules: list[Schedule] = SCHEDULES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``mix`` with the columns ``keep`` of ``docs`` in a struct, row, so that none clashes, and sort, id, order: training order."""
    order = F.xxhash64(F.lit(SEED), "doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col("doc_id").alias("id"),
        size_of(F.col("text")).alias("size"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), "source")).alias("key"),
        order.alias("order"),
        F.shiftrightunsigned(order, 64 - BUCKET_BITS).alias("bucket"),
    )
    sums = written(rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = targets(sums.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), schedules, budget, most)
    before = F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    plan = written(sums.withColumn("bucket_start", F.coalesce(before, F.lit(0))).join(sources, "key").drop("bucket_size"), "mix-plan")
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("end", inside).join(plan, ["key", "bucket"])
    total, goal, size = F.col("source_size"), F.col("target"), F.col("size")
    middle = F.col("bucket_start") + F.col("end") - size / 2
    full = F.coalesce(F.floor(F.try_divide(goal, total)), F.lit(0))
    copies = F.when(size > 0, F.least(full + F.when(middle < goal - full * total, F.lit(1)).otherwise(F.lit(0)), F.lit(most))).otherwise(F.lit(0)).cast("long")
    share = lambda k: F.least(F.try_divide(k * total + middle, goal), F.lit(1.0))
    at = lambda k: F.coalesce(*[F.when(F.col("schedule") == i, due(share(k), s)) for i, s in enumerate(schedules)])
    placed = placed.withColumn("copies", copies)
    positions = F.filter(F.array(*[F.when(F.col("copies") > k, at(k)) for k in range(most)]), lambda x: x.isNotNull())
    # what is not taken still sorts by its place, so that no range holds it all
    rest = F.lit(1.0) + F.coalesce(F.try_divide(middle, total), F.lit(0.0))
    placed = placed.withColumn("positions", positions).withColumn("taken", F.col("copies") * size)
    return placed.withColumn("sort", F.coalesce(F.try_element_at("positions", F.lit(1)), rest)).select("row", "id", "order", *ADDED, "sort")


def by_position(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``mix``, of the columns ``keep`` of ``docs``, in order of each document's first position; what is not taken comes last."""
    return _mixed(docs, keep).orderBy("sort", "id", "order").select("row.*", *ADDED)


def curriculum(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as it is taken.

    * documents without words, and sources without any, are not taken; ties of position go by doc_id, then text.
    * null text, null source, repeated rows: as in ``mix``. Empty table: empty result. Columns of any name pass through.
    """
    taken = _mixed(docs, docs.columns).select("row", "id", "order", F.explode("positions").alias("position"))
    return taken.orderBy("position", "id", "order").select("row.*")
