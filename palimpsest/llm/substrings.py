"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes counted in Spark.

A window of WINDOW words is removed if the same words also start in a document with a smaller
doc_id; overlapping windows merge into maximal intervals. The hash of every window of every text
is counted through ``exchange``: a bucket's owner sees which chunks hold a hash, and in which
document of each it comes first, and tells every chunk but the one with the first document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .exchange import deal, opened, pack_sorted, packed_rows, unpack_sorted

WINDOW = 13


class Windows:
    """The windows of some documents, in ascending doc_id: equal windows are runs, whose first document is known.

    Equal doc_ids share a rank, as neither is smaller.
    """

    def __init__(self, docs: pa.Table, window: int) -> None:
        ids = docs.column("doc_id").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.copies = ids[self.order], docs.column("copies").to_numpy()[self.order]
        texts = docs.column("text").to_pylist()
        self.texts = [texts[i] or b"" for i in self.order.tolist()]
        rank = np.cumsum(np.concatenate(([0], self.ids[1:] != self.ids[:-1])).astype(np.int64)) if len(ids) else self.order
        flat, self.sizes = hashing.word_hashes(self.texts)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        left = self.begins[doc + 1] - np.arange(len(flat))
        self.at = np.flatnonzero(left >= window)
        hashes = hashing.rolling(flat, window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.sorted, ordered = hashing.stable_sort(hashes)  # equal hashes stay in the order of documents
        owner = doc[self.at[self.sorted]]
        starts = hashing.runs(ordered)
        self.distinct, self.first = ordered[starts], owner[starts]
        self.times = hashing.lengths(starts, len(ordered))
        self.late = rank[owner] > np.repeat(rank[self.first], self.times)

    def flagged(self, told: np.ndarray) -> np.ndarray:
        """First words of the windows that also start in a smaller document: ``told`` of their distinct windows, or here."""
        return self.at[self.sorted[np.repeat(told, self.times) | self.late]]


def send(number: int, docs: pa.Table, window: int, buckets: int) -> pa.Table:
    """A chunk's distinct windows and the first document of each, a row a bucket."""
    own = Windows(docs, window)
    bucket, bounds = packed_rows(own.distinct, buckets)
    rows: dict[str, list] = {"hashes": [], "docs": [], "first": []}
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        docs_here, index = np.unique(own.first[x:y], return_inverse=True)
        rows["hashes"].append(pack_sorted(own.distinct[x:y]))
        rows["docs"].append(own.ids[docs_here].tobytes())
        rows["first"].append(index.astype(np.uint16 if len(docs_here) < 1 << 16 else np.uint32).tobytes())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([number] * len(bucket), pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in rows.items()}})


def owned(rows: pa.Table) -> pa.Table:
    """Replies of one bucket: for each chunk, its hashes that also start in a smaller document of another chunk."""
    hashes, ids, owner = [], [], []
    for k, (h, d, i) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("hashes", "docs", "first")), strict=True)):
        hashes.append(unpack_sorted(h))
        index = np.frombuffer(i, np.uint16 if 2 * len(hashes[-1]) == len(i) else np.uint32)
        ids.append(np.frombuffer(d, np.int64)[index])
        owner.append(np.full(len(index), k, np.int32))
    every, ids, owner = np.concatenate(hashes), np.concatenate(ids), np.concatenate(owner)
    order, every = hashing.stable_sort(every)
    times = hashing.lengths(hashing.runs(every), len(every))
    shared = np.flatnonzero(np.repeat(times, times) > 1)
    every, ids, owner = every[shared], ids[order[shared]], owner[order[shared]]
    if len(every):
        starts = hashing.runs(every)
        least = np.repeat(np.minimum.reduceat(ids, starts), hashing.lengths(starts, len(ids)))
        late = ids > least
        every, owner = every[late], owner[late]
    chunks = np.array(rows.column("chunk").to_pylist(), np.int32)
    order = np.argsort(owner, kind="stable")
    every, owner = every[order], owner[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    bounds = np.concatenate(([0], cuts, [len(owner)])) if len(owner) else np.zeros(1, np.int64)
    return pa.table({"chunk": pa.array(chunks[owner[bounds[:-1]]], pa.int32()), "hashes": pa.array([pack_sorted(every[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())})


def covered(at: np.ndarray, window: int, n: int) -> np.ndarray:
    """Words inside the windows that start ``at``, of ``n`` words."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def cleaned(own: Windows, told: np.ndarray, window: int) -> pa.Table:
    """The result's rows for one chunk."""
    n = int(own.begins[-1])
    gone = covered(own.flagged(told), window, n)
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[own.begins])
    spans, kept = [], []
    for k, text in enumerate(own.texts):
        words = text.split()
        intervals = []
        if removed[k]:
            here = gone[own.begins[k] : own.begins[k + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], here, [False])).astype(np.int8))).reshape(-1, 2).tolist()
            intervals = [{"begin": x, "end": y} for x, y in edges]
            words = [w for w, g in zip(words, here.tolist(), strict=True) if not g]
        spans.append(intervals)
        kept.append(b" ".join(words).decode())
    columns = [own.ids, own.sizes, removed.astype(np.int64), spans, kept]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
    out = pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])
    return out if (own.copies == 1).all() else out.take(pa.array(np.repeat(np.arange(len(own.copies)), own.copies)))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed (long), spans (word intervals removed, end excluded) and kept_text of every row.

    * null or empty text, or one shorter than a window: nothing is removed.
    * of texts with the same doc_id neither is smaller, so they remove nothing from each other;
      a null doc_id counts as smaller than any.
    * empty table: empty result. Only doc_id and text are read.
    * windows are told apart by 64-bit hashes.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    dealt, buckets = deal(rows, rows.agg(F.sum(F.length("text"))).first()[0] or 0)

    def sending(table: pa.Table) -> pa.Table:
        return send(table.column("chunk")[0].as_py(), opened(table), window, buckets)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = Windows(opened(table), window)
        told = np.zeros(len(own.distinct), bool)
        for h in replies.column("hashes").to_pylist():
            told[np.searchsorted(own.distinct, unpack_sorted(h))] = True
        return cleaned(own, told, window)

    packed = dealt.groupBy("chunk").applyInArrow(sending, "bucket int, chunk int, hashes binary, docs binary, first binary")
    replies = packed.groupBy("bucket").applyInArrow(owned, "chunk int, hashes binary")
    found = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, spans array<struct<begin:bigint,end:bigint>>, kept_text string")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
