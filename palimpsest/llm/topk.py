"""Exact top-k search by inner product with an impact-ordered index, score at a time.

A block's index holds, for every dimension and sign, its rows by quantised impact (the component's
magnitude): a posting segment is (impact, dimension, sign) and its rows. All segments are stored by
descending impact. A group of queries adds segment after segment to its accumulators. What a row can
still gain is at most the length of its unread components times the query's length (Cauchy-Schwarz),
so reading stops once all but few rows are proven out of a query's k best; the few possible members
are scored anew, exactly. A search never stops without that proof: at the last segment accumulators
are the scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .shared import scope, written

#: Impact levels of a block at most; shares of the postings after which the proof is tried; possible members, as a share of all rows, that end the reading.
LEVELS, TRIED, FEW = 63, (0.4, 0.55, 0.7, 0.85, 1.0), 1 / 64

#: Pairs that are scored anew at once.
SLICE = 1 << 17


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings (row numbers) by descending impact, dimension and sign, and the segments (impact, dimension, end)."""
    n, dims = vectors.shape
    flat = vectors.T.ravel()
    step = -(-int(np.abs(flat).max(initial=0)) // LEVELS) or 1
    impact = -(-np.abs(flat) // step)
    at = np.flatnonzero(impact)
    key = (LEVELS + 1 - impact[at]) * (2 * dims) + at // n * 2 + (flat[at] < 0)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
    last = ends - 1
    return (at % n).astype("<u2"), np.stack([impact[at[last]], at[last] // n, ends], axis=1).astype("<i4")


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column."""
    return -np.partition(-scores, k - 1, axis=0)[k - 1]


def possible(body: dict, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, query), all that may be among the k best of a query: others have a score below ``least`` or below k other rows'.

    ``own``: the query's own row in this block, or -1. ``least``: a score that k rows of other blocks reach, or minus infinity.
    """
    kind = V.exact_type(rows, queries)
    n, m = len(rows), len(queries)
    if kind is object or n <= k:
        return tuple(x.ravel() for x in np.indices((n, m)))
    by_row, by_query = rows.astype(kind), queries.astype(kind)
    postings, plan = np.frombuffer(body["postings"], "<u2"), np.frombuffer(body["segments"], "<i4").reshape(-1, 3)
    length = np.sqrt((by_query.astype(np.float64) ** 2).sum(axis=1)).astype(kind) * kind(1.00001)
    size = np.abs(rows)
    step = -(-int(size.max(initial=0)) // LEVELS) or 1
    found = np.zeros((n, m), kind)
    begin, tries = 0, list(TRIED)
    ends = [x for x in range(1, len(plan)) if plan[x, 0] != plan[x - 1, 0]] + [len(plan)]
    maybe = np.ones((n, m), bool)
    first = 0
    for end in ends:
        for _, dim, stop in plan[first:end].tolist():
            ids = postings[begin:stop]
            more = found[ids]
            more += np.multiply.outer(by_row[ids, dim], by_query[:, dim])
            found[ids] = more
            begin = stop
        first, level = end, int(plan[end - 1, 0])
        if begin < tries[0] * len(postings):
            continue
        while tries and begin >= tries[0] * len(postings):
            tries.pop(0)
        tries = tries or [2.0]
        floor = least
        if np.isneginf(least).any():
            # exact scores of the best so far: k rows reach the k-th of them
            top = np.argpartition(-found, min(k + 1, n) - 1, axis=0)[: k + 1]
            scores = np.einsum("kqd,qd->kq", by_row[top], by_query)
            scores[top == own] = -np.inf
            floor = np.maximum(least, kth_best(scores, min(k, len(top))))
        unread = np.where(size <= (level - 1) * step, by_row, 0).astype(np.float64)
        gain = np.sqrt((unread**2).sum(axis=1)).astype(kind) * kind(1.00001)
        maybe = found + np.multiply.outer(gain, length) >= (floor - 0.5).astype(kind)
        if np.count_nonzero(maybe) <= max(FEW * n * m, 2 * k * m):
            break
    return np.nonzero(maybe)


def rescored(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs."""
    kind = V.exact_type(rows, queries)
    if kind is object:
        return V.as_long(np.array([sum(int(a) * int(b) for a, b in zip(rows[i], queries[j], strict=True)) for i, j in zip(r, q, strict=True)] or [0], object)[: len(r)])
    a, b = rows.astype(kind), queries.astype(kind)
    parts = [np.einsum("ij,ij->i", a[r[i : i + SLICE]], b[q[i : i + SLICE]]) for i in range(0, len(r), SLICE)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def best(queries: list[dict], bodies: Iterable[dict], k: int) -> tuple[np.ndarray, ...]:
    """query (its number), score, id and null flag of each query's k best rows of ``bodies`` (all, if fewer)."""
    vectors = [V.unpacked(q) for q in queries]
    dims = max(x.shape[1] for x in vectors)
    asked = np.concatenate([V.wide(x, dims) for x in vectors])
    block, pos = np.array([q["block"] for q in queries]), np.array([q["pos"] for q in queries])
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    least = np.full(len(queries), -np.inf)
    for body in bodies:
        rows = V.unpacked(body)
        dims = max(rows.shape[1], asked.shape[1])
        rows, asked = V.wide(rows, dims), V.wide(asked, dims)
        own = np.where(block == body["block"], pos, -1)
        r, q = possible(body, rows, asked, own, least, k)
        other = r != own[q]
        r, q = r[other], q[other]
        ids, none = V.ids_of(body)
        q, score, ids, none = (np.concatenate(x) for x in zip(kept, (q, rescored(rows, asked, r, q), ids[r], none[r]), strict=True))
        order = np.lexsort((ids, none, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[rank < k]
        kept = (q[rank < k], score[order], ids[order], none[order])
        full = np.bincount(kept[0], minlength=len(queries)) == k
        last = np.searchsorted(kept[0], np.arange(len(queries)), side="right") - 1
        least = np.where(full, kept[1][last].astype(np.float64) if len(last) and len(kept[1]) else -np.inf, -np.inf)
    return kept


def top_k(rows: DataFrame, vector: str, asks: Column, k: int = 20, scale: int = 64, id: str = "vec_id") -> DataFrame:  # noqa: A002
    """query_id, rank (from 1), vec_id and score of the k highest inner products of floor(scale * x) of each row for which ``asks`` holds, against every other row.

    * ties go to the smaller id, null ids last; fewer than k other rows: all.
    * a vector that is null or holds a null or non-finite component takes no part, neither asks nor answers; nor does one whose scaled component overflows.
    * a repeated row, or another of the same id, is another row: it answers its twin, and asks by itself.
    * vectors of unlike length: the shorter counts as filled up with zeros. An empty one scores 0 with all.
    * components beyond 2**62 count as that, scores beyond the range of a long as its end.
    * empty table, or nobody asks: empty result. Other columns are not read.
    """
    with scope(rows.sparkSession):
        blocks = V.in_blocks(rows, vector, scale, segments, asks, id=id)
        queries = written(V.flagged(blocks), "topk-queries")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for asked, bodies in V.cells(batches):
                q, score, ids, none = best(asked, bodies, k)
                column = lambda name, kind: pa.array([asked[i][name] for i in q], kind)
                yield pa.RecordBatch.from_arrays([column("block", pa.int64()), column("pos", pa.int32()), column("id", pa.int64()), pa.array(ids, mask=none), pa.array(score)], ["block", "pos", "query_id", "vec_id", "score"])

        found = V.grid(queries, blocks).mapInArrow(run, "block long, pos int, query_id long, vec_id long, score long")
        order = Window.partitionBy("block", "pos").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return written(ranked.select("query_id", "rank", "vec_id", "score"), "topk", lasting=True)
