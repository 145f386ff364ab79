"""Repair of the turn structure of conversations: cheapest edits by dynamic programming over scalar weights.

A weight is one whole number: its high digits are the cost, its low digits the audit letters of the
edits from here on, a fixed number of three-bit places, the first letter highest, unused places zero at
the end. The least weight is therefore the cheapest edit list and, of those, the ASCII-least audit. The
graph has a node for each row and automaton state (``START``, ``SYSTEM``, ``USER``, ``ASSISTANT``); its
edges keep, rerole, delete or insert; an integer minimum over it decides everything.

Rows are range-partitioned by conversation and turn, so that one hot conversation fills many tasks, and cut
into segments of at most ``SEGMENT`` rows. A segment's graph is solved for every pair of states at its ends.
Every audit of a segment ends with a row's letter, so of two that leave the same state none begins the
other; a conversation's segments are then chosen by their costs and the order of their audits alone,
a few numbers each, and no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .shared import scope, written

#: Rows, and characters of text, of a segment (it has one row at least).
SEGMENT, SEGMENT_CHARS = 128, 1 << 20

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where a kept row's role initial leads; a role that is inserted or given is the one that leads to NEXT.
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
#: Letters in ASCII order are digits from 1.
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: What the end of a conversation still inserts in each state.
TAIL = ("", "II", "I", "")
#: Faults of a row, the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
NO_WAY = -1


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(DataType.fromDDL(schema))


def role_name(state: int) -> str:
    """The role that leads to ``state`` when inserted or given."""
    return "assistant" if state == ASSISTANT else "user"


def weights(rows: list[tuple[int, str]], end: int) -> tuple[list[int | None], int]:
    """The least weight from each state before ``rows`` (fault, role initial) to state ``end`` after them, and the bits of its letters."""
    bits = 3 * 3 * len(rows)
    letters = (1 << bits) - 1

    def ahead(edit: int, cost: int, rest: int | None) -> int | None:
        return None if rest is None else ((rest >> bits) + cost << bits) | edit << bits - 3 | (rest & letters) >> 3

    least = lambda *ways: min((w for w in ways if w is not None), default=None)
    now: list[int | None] = [0 if s == end else None for s in STATES]
    for fault, initial in reversed(rows):
        must_go, extra = fault in (BLANK, DUPLICATE), int(fault == TRUNCATED)
        by_row = []
        for s in STATES:
            ways = [ahead(DELETE, COSTS[DELETE], now[s])]
            if not must_go:
                if initial in MOVES[s]:
                    ways.append(ahead(KEEP, COSTS[KEEP] + extra, now[MOVES[s][initial]]))
                ways.append(ahead(REROLE, COSTS[REROLE] + extra, now[NEXT[s]]))
            by_row.append(least(*ways))
        # two insertions in a row reach every state that more of them do
        once = [ahead(INSERT, COSTS[INSERT], by_row[NEXT[s]]) for s in STATES]
        now = [least(by_row[s], once[s], ahead(INSERT, COSTS[INSERT], once[NEXT[s]])) for s in STATES]
    return now, bits


def spelled(weight: int, bits: int) -> str:
    """The audit letters of a weight."""
    digits = (weight >> at & 7 for at in range(bits - 3, -1, -3))
    return "".join(LETTERS[d] for d in digits if d)


def solved(rows: list[tuple[int, str]]) -> tuple[list[int], list[int], list[str]]:
    """Cost (-1: no way), rank of the audit among those from the same state, and audit, of each pair of states, the first varying slowest."""
    by_end = [weights(rows, end) for end in STATES]
    costs, ranks, audits = [], [], []
    for s in STATES:
        found = [by_end[e][0][s] for e in STATES]
        bits = by_end[0][1]
        low = [None if w is None else w & (1 << bits) - 1 for w in found]
        order = sorted(x for x in low if x is not None)
        costs += [NO_WAY if w is None else w >> bits for w in found]
        ranks += [0 if x is None else order.index(x) for x in low]
        audits += ["" if w is None else spelled(w, bits) for w in found]
    return costs, ranks, audits


def edited(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each edit of ``rows`` (role, text) from ``state``; a deleted row comes as it was."""
    left = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter in "IR":
            state = NEXT[state]
            role = role_name(state)
        elif letter == "K":
            state = MOVES[state][role[:1]]
        yield letter, role, text


SEGMENTS = """part int, seq long, roles array<string>, texts array<string>, costs array<int>, ranks array<int>, audits array<string>,
blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, initials string"""
SUMMARY = ["costs", "ranks", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "initials"]


def marked(rows: DataFrame, copies: Column | None) -> DataFrame:
    """conv_id, turn, role, text, copies, fault (without repeats of the same turn) and later: role and text stand at an earlier turn of the conversation."""
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    space = "\t\n\x0b\x0c\r "
    last = F.substring(F.rtrim("text", F.lit(space)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    own = own.withColumn("fault", fault).withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    seen = own.filter("copies > 0").groupBy("conv_id", "same").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    seen = seen.filter("none and low is not null or low < high").select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "none", "low")
    met = own.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("low"))), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", "copies", "fault", later.alias("later"))


def in_segments(rows: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """The rows of ``marked`` in order, cut into solved segments; a conversation without rows has an empty one."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {id_type}, {SEGMENTS}"
    kinds = arrow(schema)
    names = kinds.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def segment(conv, held: list[tuple]) -> dict:
            costs, ranks, audits = solved([(fault, role[:1] or " ") for fault, role, _, _ in held])
            initials = [role[:1] or " " for _, role, _, _ in held]
            turns = [t for *_, t in held if t is not None]
            faults = [x[0] for x in held]
            pairs = zip(initials, initials[1:], strict=False)
            row = [conv, part, seq, [x[1] for x in held], [x[2] for x in held], costs, ranks, audits, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED)]
            row += [sum(a + b not in LEGAL for a, b in pairs), min(turns, default=None), max(turns, default=None), len(set(turns)), "".join(initials[:1] + initials[-1:])]
            return dict(zip(names, row, strict=True))

        stream = (r for b in batches for r in b.to_pylist())
        for conv, own in groupby(stream, key=itemgetter("conv_id")):
            held: list[tuple] = []
            chars, before, begun = 0, None, False
            for r in own:
                now = (r["turn"], r["role"], r["text"])
                for copy in range(r["copies"]):
                    fault = r["fault"] if r["fault"] == BLANK or not (r["later"] or copy or now == before) else DUPLICATE
                    if held and (len(held) == longest or chars + len(r["text"]) > SEGMENT_CHARS):
                        yield segment(conv, held)
                        held, chars, seq, begun = [], 0, seq + 1, True
                    held.append((fault, r["role"], r["text"], r["turn"]))
                    chars += len(r["text"])
                if r["copies"]:
                    before = now
            if held or not begun:
                yield segment(conv, held)
                seq += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        chars = 0
        for row in cut(batches):
            out.append(row)
            chars += sum(map(len, row["texts"]))
            if len(out) >= 1000 or chars > SEGMENT_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return written(ordered.mapInArrow(run, schema), "conversation-segments")


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
CHOSEN = "part int, seq long, place long, entered int, audit int, tail string, " + ", ".join(f"{c} long" for c in TOTALS)


def chosen(segments: DataFrame) -> DataFrame:
    """Of each segment its place in the conversation, the state it begins in and which of its audits holds; the first has the conversation's totals."""
    schema = arrow(CHOSEN)
    names = schema.names
    summary = segments.select("conv_id", "part", "seq", *SUMMARY).repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").desc(), F.col("seq").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, own in groupby((r for b in batches for r in b.to_pylist()), key=itemgetter("conv_id")):
            left = [2 * len(t) for t in TAIL]
            ways: list[tuple[int, int, list[int]]] = []
            total = dict.fromkeys(TOTALS, 0)
            low = high = after = None
            turns, follows = 0, ""
            for r in own:  # from the last segment to the first
                costs, ranks = r["costs"], r["ranks"]
                options = [[(costs[4 * s + e] + left[e], ranks[4 * s + e], e) for e in STATES if costs[4 * s + e] != NO_WAY and left[e] is not None] for s in STATES]
                best = [min(o, default=(None, 0, 0)) for o in options]
                left = [b[0] for b in best]
                ways.append((r["part"], r["seq"], [b[2] for b in best]))
                for c in TOTALS[1:5]:
                    total[c] += r[c]
                if r["initials"]:
                    total["illegal"] += bool(follows) and r["initials"][-1] + follows not in LEGAL
                    follows = r["initials"][0]
                if r["low"] is not None:
                    turns += r["turns"] - (r["high"] == after)
                    after = low = r["low"]
                    high = r["high"] if high is None else high
            total["gaps"] = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
            total["cost"] = left[START]
            state = START
            for place, (part, seq, to) in enumerate(reversed(ways)):
                end = to[state]
                out.append((part, seq, place, state, 4 * state + end, TAIL[end] if place == len(ways) - 1 else "", *(total[c] if place == 0 else None for c in TOTALS)))
                state = end
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)

    return written(summary.mapInArrow(run, CHOSEN), "conversation-choices")


def plans(conversations: DataFrame, copies: Column | None = None, longest: int = SEGMENT) -> DataFrame:
    """The segments of all conversations with their places, the texts of their rows and the edits that hold."""
    segments = in_segments(marked(conversations, copies), longest)
    picked = chosen(segments)
    texts = segments.select("conv_id", "part", "seq", "roles", "texts", "audits")
    return texts.join(picked, ["part", "seq"]).withColumn("audit", F.concat(F.col("audits")[F.col("audit")], "tail")).drop("audits", "tail")


def repaired(conversations: DataFrame, copies: Column | None = None, longest: int = SEGMENT) -> DataFrame:
    """conv_id, place, number, edit, role and text: a row for each edit of each conversation, in the order of place and number.

    As ``report`` says for nulls, ties, empty conversations and the order of rows. A deleted row comes with edit D, as it was.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = list(edited(zip(r["roles"], r["texts"], strict=True), r["audit"], r["entered"]))
                if rows:
                    columns = [[r["conv_id"]] * len(rows), [r["place"]] * len(rows), list(range(len(rows))), *map(list, zip(*rows, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [b.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()], strict=True)], ["conv_id", "place", "number", "edit", "role", "text"])

    with scope(conversations.sparkSession):
        edits = plans(conversations, copies, longest).select("conv_id", "place", "entered", "audit", "roles", "texts").mapInArrow(run, f"conv_id {id_type}, place long, number int, edit string, role string, text string")
        return written(edits, "conversations-repaired", lasting=True)


def report(conversations: DataFrame, copies: Column | None = None, longest: int = SEGMENT) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``copies``: how often each row stands, next to itself; a conversation whose rows all stand zero times has zeros,
    an empty audit and the hash of nothing.

    * rows go by turn, nulls first, then by role and text: equal turns are ordered whatever the table's order.
    * a null role or text is one space; a null conv_id is a conversation of its own.
    * an empty role has the initial " ", which no rule allows, so that the row is reroled or deleted.
    * gaps beyond the range of a long count as its end. Empty table: empty result. Other columns are not read.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {id_type}, {', '.join(f'{c} long' for c in TOTALS)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for conv, own in groupby((r for b in batches for r in b.to_pylist()), key=itemgetter("conv_id")):
            digest, begun, audits, totals = hashlib.sha256(), False, [], {}
            for r in own:
                if r["place"] == 0:
                    totals = {c: r[c] for c in TOTALS}
                audits.append(r["audit"])
                for letter, role, text in edited(zip(r["roles"], r["texts"], strict=True), r["audit"], r["entered"]):
                    if letter != "D":
                        digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        begun = True
            rows.append({"conv_id": conv, **totals, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()})
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = arrow(out)
    with scope(conversations.sparkSession):
        ordered = plans(conversations, copies, longest).drop("part", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "place")
        return written(ordered.mapInArrow(run, out), "conversation-report", lasting=True)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with faults by crc32(`conv_id:turn`) % 20, null as one space, and how often each then stands.

    0 drops the row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 sets the role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")
