"""Hard negatives by Fagin's threshold algorithm over sorted lists of a vector index.

A block's index holds, for every dimension, its rows sorted by component. An anchor reads all lists in
step, each from its anchor-signed end: from the largest component where the anchor's is positive, from
the smallest where it is negative. Every row met is looked up and scored in whole numbers; the sum of
anchor times component at the reading places is the threshold, which no row unmet can pass. Reading
stops once the threshold falls strictly below the k-th score found (of each window, where an anchor has
several), or below a window's lower end.

Two sweeps: positives of each anchor first, then for all its positives' windows at once the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .shared import scope, written

#: Rows read of each list in the first step; each further step reads twice as many.
STEP = 8


def sorted_lists(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each dimension by ascending component; no segments."""
    return np.argsort(vectors, axis=0, kind="stable").T.astype("<u2"), np.zeros(0, "<i4")


class Best:
    """The k best of the scores within [low, high] that were added: highest first, ties to the smaller id, null last."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(5)]

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray, block: int, pos: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= max(self.low, self.least())) & (scores <= self.high))
        if not len(fits):
            return
        new = (scores[fits], ids[fits], none[fits].astype(np.int64), np.full(len(fits), block), pos[fits])
        self.rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
        order = np.lexsort((self.rows[1], self.rows[2], -self.rows[0]))[: self.k]
        self.rows = [x[order] for x in self.rows]

    def least(self) -> float:
        """The k-th score, minus infinity while there are fewer."""
        return self.rows[0][-1] if len(self.rows[0]) == self.k else -np.inf

    def settled(self, threshold: float) -> bool:
        """True if no row of a score up to ``threshold`` can come in."""
        return threshold < self.least() or threshold < self.low


def read_lists(anchor: np.ndarray, rows: np.ndarray, lists: np.ndarray, met: Callable[[np.ndarray, np.ndarray], None], settled: Callable[[float], bool]) -> None:
    """Sorted access to ``lists`` by the anchor's signs; ``met`` gets rows new to it with their scores, until ``settled`` by the threshold."""
    kind = V.exact_type(anchor[None], rows)
    n, values, weights = len(rows), rows.astype(kind), anchor.astype(kind)
    ups, downs = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = np.zeros(n, bool)
    at, step = 0, STEP
    if not len(ups) + len(downs):  # all scores are 0
        met(np.arange(n), np.zeros(n, np.int64))
        return
    while at < n:
        end = min(n, at + step)
        fresh = np.zeros(n, bool)
        fresh[lists[ups, n - end : n - at].ravel()] = True
        fresh[lists[downs, at:end].ravel()] = True
        fresh &= ~seen
        seen |= fresh
        if (new := np.flatnonzero(fresh)).size:
            met(new, V.as_long(values[new] @ weights))
        if seen.all():
            return
        threshold = weights[ups] @ values[lists[ups, n - end], ups] + weights[downs] @ values[lists[downs, end - 1], downs]
        if settled(float(threshold)):
            return
        at, step = end, 2 * step


def opened(body: dict, dims: int) -> tuple[np.ndarray, ...]:
    """Vectors, lists, labels, ids and null flags of a block, with lists for ``dims`` dimensions."""
    rows = V.unpacked(body)
    lists = np.frombuffer(body["postings"], "<u2").reshape(rows.shape[1], -1)
    if dims > rows.shape[1]:
        lists = np.concatenate([lists, np.tile(np.arange(len(rows), dtype="<u2"), (dims - rows.shape[1], 1))])
    return V.wide(rows, dims), lists, np.array(body["labels"], np.int64), *V.ids_of(body)


def swept(anchors: DataFrame, blocks: DataFrame, wanted: Callable[[dict], list[Best]], same: bool) -> DataFrame:
    """Rows (block, pos, turn, id, found_block, found_pos, score): what each ``Best`` of an anchor holds after each cell of the grid.

    ``wanted`` gives an anchor's, in the order of ``turn``; only rows of the ``same`` label as the anchor's are looked at, or only of others.
    """
    names = ["block", "pos", "turn", "id", "found_block", "found_pos", "score"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, bodies in V.cells(batches):
            vectors, all_best = [V.unpacked(a)[0] for a in asked], [wanted(a) for a in asked]
            most = max(map(len, vectors))
            for body in bodies:
                rows, lists, labels, ids, none = opened(body, max(most, body["dims"]))
                for a, vector, bests in zip(asked, vectors, all_best, strict=True):
                    fits = (labels == a["label"]) == same
                    if a["block"] == body["block"]:
                        fits[a["pos"]] = False

                    def met(new: np.ndarray, scores: np.ndarray, fits=fits, bests=bests, ids=ids, none=none, block=body["block"]) -> None:
                        ok = fits[new]
                        new, scores = new[ok], scores[ok]
                        for b in bests:
                            b.add(scores, ids[new], none[new], block, new)

                    if bests and fits.any():
                        read_lists(np.pad(vector, (0, rows.shape[1] - len(vector))), rows, lists, met, lambda t, bests=bests: all(b.settled(t) for b in bests))
            out = [(a["block"], a["pos"], turn, None if gone else i, block, pos, score) for a, bests in zip(asked, all_best, strict=True) for turn, b in enumerate(bests) for score, i, gone, block, pos in zip(*(x.tolist() for x in b.rows), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    rows = V.grid(anchors, blocks, GROUP).mapInArrow(run, "block long, pos int, turn int, id long, found_block long, found_pos int, score long")
    return rows


#: Anchors of a cell of the grid.
GROUP = 128


def first(found: DataFrame, k: int) -> DataFrame:
    """``found`` with the rank of its k best of each anchor and turn."""
    order = Window.partitionBy("block", "pos", "turn").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "found_block", "found_pos")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, vector: str, label: Column, asks: Column, n_positives: int = 5, n_negatives: int = 10, shares: tuple[int, int] = (30, 90), scale: int = 256, id: str = "vec_id"  # noqa: A002
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows for which ``asks`` holds; an anchor's positives are its first ``n_positives`` other rows
    of the same label, by inner product of floor(scale * x), highest first, ties to the smaller id, null ids last.
    A positive's negatives are the first ``n_negatives`` rows of another label whose score is between
    ``shares`` hundredths of the positive's (both included; a negative score leaves none).

    * a null label, a null vector, one with a null or non-finite component: the row takes no part.
    * a repeated row, or another of the same id, is another row; as an anchor it is mined by itself.
    * vectors of unlike length: the shorter counts as filled up with zeros. An empty one scores 0 with all.
    * components beyond 2**62 count as that, scores beyond the range of a long as its end.
    * one label only, an empty table or no anchors: empty result. Other columns are not read.
    """
    low, high = shares

    def windows(anchor: dict) -> list[Best]:
        return [Best(n_negatives, -((-low * s) // 100), high * s // 100) if low * s <= high * s else Best(n_negatives, np.inf) for s in anchor["scores"]]

    with scope(rows.sparkSession):
        blocks = V.in_blocks(rows.filter(label.isNotNull()), vector, scale, sorted_lists, asks, label, id)
        anchors = written(V.flagged(blocks), "negatives-anchors")
        found = first(swept(anchors, blocks, lambda a: [Best(n_positives)], same=True), n_positives)
        positives = written(found.select("block", "pos", (F.col("rank") - 1).alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        # at most n_positives scores an anchor
        scores = positives.groupBy("block", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
        negatives = first(swept(anchors.join(scores, ["block", "pos"]), blocks, windows, same=False), n_negatives)
        named = anchors.select("block", "pos", F.col("id").alias("anchor_id"))
        out = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["block", "pos", "turn"]).join(named, ["block", "pos"])
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", lasting=True)
