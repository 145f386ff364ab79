"""Conversation repair against a search over all edit lists, in one segment and in many."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import conversations, entries, sql
from tests import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE, BEGUN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"(s?(ua)*u?)?\Z")


def cheapest(initials: list[str], faults: list[str]) -> tuple[int, str, str]:
    """Cost, audit and role initials of the first complete edit list, by cost and audit."""
    heap, done, best = [(0, "", 0, "")], set(), None
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(initials) and WHOLE.match(roles):
            best = min(best or (cost, audit, roles), (cost, audit, roles))
        if (i, roles[-1:], cost, audit) in done:
            continue
        done.add((i, roles[-1:], cost, audit))
        steps = [(2, "I", i, roles + z) for z in "ua"] if not audit.endswith("III") else []
        if i < len(initials):
            steps.append((3, "D", i + 1, roles))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                steps += [(extra, "K", i + 1, roles + initials[i]), *((2 + extra, "R", i + 1, roles + z) for z in "ua")]
        for more, letter, at, now in steps:
            if BEGUN.match(now):
                heapq.heappush(heap, (cost + more, audit + letter, at, now))
    return best


def brute(rows: list[tuple]) -> list[tuple]:
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        convs[conv] += [(turn, "user" if key == 4 else role, text)] * {0: 0, 3: 2}.get(key, 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            left = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "" if left[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] or " " for _, role, _ in own]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, roles = cheapest(initials, faults)
        left, names, lines = iter(own), iter(roles), []
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter != "D":
                name = next(names)
                lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[name]}:{text}")
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def odd_rows(seed: int, convs: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = [None, "", "user", "assistant", "system", "tool", "user", "assistant", "user", "assistant"]
    texts = [None, "", " ", "a.", "a.", "b", "b! ", "c?\n", "d.\x85", "é"]
    return [(c or None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(convs) for _ in range(rng.randrange(most))]


def report(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(str, map(tuple, conversations.report(*conversations.damaged(df), **how).collect())))


@pytest.mark.parametrize("longest", [1, 3, conversations.SEGMENT])
def test_odd_rows(spark, longest):
    rows = odd_rows(longest, 90, 8)
    assert report(spark, rows, longest=longest) == sorted(map(str, brute(rows)))


def test_a_long_conversation_in_segments(spark):
    """A conversation over many tasks and segments is edited as it is in one."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", f"{t}.", f"{t}", ""])) for t in range(300)]
    whole = report(spark, rows, longest=1000)
    assert report(spark, rows, longest=20) == report(spark, rows, longest=7) == whole


def test_edits_are_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b"), (1, 2, "assistant", "c.")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in conversations.repaired(df).orderBy("place", "number").collect()]
    # an insertion between the user's rows costs as much, with the truncated row: D comes before I
    assert found == [(1, 0, 0, "K", "user", "a."), (1, 0, 1, "D", "user", "b"), (1, 0, 2, "K", "assistant", "c.")]
    assert "".join(x[3] for x in found) == cheapest(["u", "u", "a"], ["", "truncated", ""])[1]


def test_none_and_dropped(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert [tuple(r) for r in conversations.report(df, F.lit(0)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert conversations.report(df.filter(F.lit(False))).collect() == []
    assert conversations.repaired(df, F.lit(0)).collect() == []


def test_very_long_texts(spark):
    text = "word. " * 400_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", text)]
    (found,) = conversations.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (found["audit"], found["duplicate"], found["cost"]) == ("KKD", 1, 3)
    assert found["repaired_sha256"] == hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()


def test_clashing_names(spark, tmp_path):
    rows = odd_rows(2, 20, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    names = [*df.columns, "part", "seq", "copies", "TEXT", "a.b", "place", "fault"]
    more = df.withColumns({f"x{i}": F.lit("mine") for i in range(7)}).toDF(*names)
    own = entries.only(more, "conv_id", "turn", "role", "text")
    assert sorted(map(str, map(tuple, conversations.report(*conversations.damaged(own)).collect()))) == sorted(map(str, brute(rows)))


def test_matches_sql(spark, tmp_path):
    assert compare.differences(entries.op12_conversation_repair(spark, SF), sql.REPAIR, SF) == ""
    spark.createDataFrame(odd_rows(5, 60, 7), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert compare.differences(entries.op12_conversation_repair(spark, str(tmp_path)), sql.REPAIR, str(tmp_path)) == ""
