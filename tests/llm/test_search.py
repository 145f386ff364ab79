"""Exact top-k search and hard-negative mining against brute force, with ties, repeats and odd vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import entries, negatives, topk, vectors
from palimpsest.llm.shared import table
from tests import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale):
    """(row, whole-number vector) of the rows that take part."""
    return [(r, [math.floor(scale * float(x)) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def by_score(rows):
    return sorted(rows, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def brute_top_k(rows, k):
    own = brute(rows, 64)
    out = []
    for i, (q, a) in enumerate(own):
        if q[0] is not None and q[0] % 20 == 0:
            found = by_score([(product(a, b), c[0]) for j, (c, b) in enumerate(own) if i != j])[:k]
            out += [(q[0], rank + 1, vec_id, score) for rank, (score, vec_id) in enumerate(found)]
    return out


def brute_negatives(rows):
    own = [(r, v, (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]) for r, v in brute(rows, 256) if r[2] is not None]
    out = []
    for i, (q, a, label) in enumerate(own):
        if q[0] is None or q[0] % 100:
            continue
        scored = by_score([(product(a, b), c[0], other) for j, (c, b, other) in enumerate(own) if i != j])
        for ps, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 30 * ps <= 100 * x[0] <= 90 * ps][:10]
            out += [(q[0], positive, rank + 1, x[1], ps, x[0]) for rank, x in enumerate(fits)]
    return out


def odd_rows(seed: int, dims: int, n: int = 400):
    """Few distinct values, so that ties are many; nulls, repeats, bad and short vectors."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.5]) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    rows += [rows[20], rows[20], rows[100], rows[100], (40, rows[7][1], 1), (None, rows[20][1], 2), (None, None, 1)]
    rows += [(60, None, 1), (80, [None, 1.0], 1), (120, [float("nan"), 1.0], 1), (200, [float("inf")], 1), (140, [], 2), (300, [0.0] * dims, 0), (160, rows[3][1][:2], 0), (700, rows[5][1], None)]
    return rows


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("seed", "dims"), [(1, 3), (2, 16)])
def test_odd_rows(spark, seed, dims):
    rows = odd_rows(seed, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = topk.top_k(df, "embedding", F.col("vec_id") % 20 == 0).collect()
    assert ordered(map(tuple, found)) == ordered(brute_top_k(rows, 20))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = negatives.hard_negatives(df, "embedding", label, F.col("vec_id") % 100 == 0).collect()
    assert ordered(map(tuple, mined)) == ordered(brute_negatives(rows)) and mined


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [0.5, -1.0], 1), (2, [1.0, 1.0], 2)], SCHEMA)
    asks = F.col("vec_id") % 20 == 0
    assert [tuple(r) for r in topk.top_k(df, "embedding", asks).orderBy("rank").collect()] == [(0, 1, 2, 12288), (0, 2, 1, -6144)]
    for none in (df.filter("vec_id > 5"), df.filter("vec_id = 1")):
        assert topk.top_k(none, "embedding", asks).collect() == []
        assert negatives.hard_negatives(none, "embedding", F.col("label"), asks).collect() == []


def test_components_without_bound(spark):
    """Scores beyond what floats hold exactly are added up in whole numbers."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-(2**40), 2**40)) for _ in range(3)], i % 2) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    limit = lambda s: max(min(s, 2**63 - 1), -(2**63) + 1)
    want = [(q, v, limit(s)) for q, _, v, s in brute_top_k(rows, 20)]
    found = [(r[0], r[2], r[3]) for r in topk.top_k(df, "embedding", F.col("vec_id") % 20 == 0, k=44).collect()]
    assert set(want) <= set(found)


def test_clashing_names(spark):
    rows = table(spark, SF, "embeddings")
    names = ["block", "pos", "id", "score", "rank", "VEC_ID", "a.b", "Label", "turn", "query"]
    more = rows.withColumns({f"x{i}": F.lit("mine") for i in range(len(names))}).toDF(*rows.columns, *names)
    asks, own = F.col("vec_id") % 20 == 0, entries.only(more, "vec_id", "embedding")
    assert sorted(topk.top_k(own, "embedding", asks).collect()) == sorted(topk.top_k(rows, "embedding", asks).collect())


@pytest.mark.parametrize("name", ["op11_topk_search", "op13_hard_negatives"])
def test_matches_sql(spark, name):
    assert compare.differences(entries.queries()[name](spark, SF), entries.oracle_sql()[name], SF) == ""


def test_segments_come_by_impact():
    rows = np.random.default_rng(5).integers(-200, 200, (300, 7))
    postings, plan = topk.segments(rows)
    plan = plan.reshape(-1, 3)
    assert (np.diff(plan[:, 0]) <= 0).all() and plan[-1, 2] == len(postings) == np.count_nonzero(rows)
    assert plan[0, 0] <= topk.LEVELS


def test_reading_stops_early_and_misses_nobody():
    """The proof leaves few possible members, all of the best among them, before all postings are read."""
    rng = np.random.default_rng(6)
    rows = np.floor(64 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    asked = rows[:40]
    postings, plan = topk.segments(rows)
    body = {"postings": postings.tobytes(), "segments": plan.tobytes()}
    r, q = topk.possible(body, rows, asked, np.arange(40), np.full(40, -np.inf), 20)
    assert len(r) < 0.1 * len(rows) * 40
    for i in range(40):
        scores = rows @ asked[i]
        scores[i] = -(10**9)
        assert set(np.argsort(-scores, kind="stable")[:20]) <= set(r[q == i])


def test_the_threshold_stops_reading():
    """One clear winner in every list: reading ends long before all rows are met."""
    rng = np.random.default_rng(7)
    rows = rng.integers(-3, 4, (4000, 4))
    rows[:10] = 100
    lists, _ = negatives.sorted_lists(rows)
    best, met = negatives.Best(5), []

    def see(new, scores):
        met.extend(new.tolist())
        best.add(scores, new, np.zeros(len(new), bool), 0, new)

    negatives.read_lists(np.array([2, 1, 1, 3]), rows, lists, see, best.settled)
    assert best.rows[1].tolist() == [0, 1, 2, 3, 4] and len(met) < 400


def test_blocks_and_cells(spark, monkeypatch):
    """Several blocks, parts and groups give what one gives."""
    rows = odd_rows(9, 5, 260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(vectors.grid, "__defaults__", (4, 2))
    monkeypatch.setattr(vectors, "ROWS", 50)
    found = topk.top_k(df, "embedding", F.col("vec_id") % 20 == 0).collect()
    assert ordered(map(tuple, found)) == ordered(brute_top_k(rows, 20))
