"""Stupid-backoff scores of documents, from n-gram counts over the whole corpus.

Counts of every n-gram of every document are gathered in tables partitioned by the n-gram's hash;
each document's n-grams are joined to them there, and the logarithms sum per document. A document's
own occurrences do not count for it: it is scored by what the rest of the corpus says, so that
back-off happens where the rest has not seen its n-gram.

The tables travel through ``exchange``: chunks of documents send each distinct n-gram's count once,
bucket owners add the counts up, and reply with what is new to the chunk. ``joined_scores`` says the
same with a row for each n-gram of each document; it is what the tests compare with, as it shuffles
many times the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing
from .exchange import deal, opened, pack_sorted, packed_rows, unpack_sorted
from .shared import words

ORDER = 3
ALPHA = 0.4
#: Larger chunks than elsewhere: an n-gram's count travels once a chunk.
CHUNK_CHARS = 8_000_000


class Grams:
    """The n-grams of some texts, of all lengths up to ``order``, and their distinct hashes.

    ``ends``: for each length, the word at which each n-gram ends; ``at``: the n-grams, by length and place,
    in the order of their hashes; ``starts``: where the runs of equal hashes begin in that order;
    ``owner``: the text of each n-gram in that order.
    """

    def __init__(self, texts: list[bytes | None], order: int) -> None:
        flat, self.sizes = hashing.word_hashes([t or b"" for t in texts])
        begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        place = np.arange(len(flat)) - begins[self.doc]
        self.ends, found = [], []
        for k in range(order):
            ends = np.flatnonzero(place >= k).astype(np.int32)
            self.ends.append(ends)
            # the length is part of the hash, as tables of all lengths share one hash space
            found.append(hashing.rolling(flat, k + 1)[ends - k] + np.uint64(k) if len(ends) else np.zeros(0, np.uint64))
        del flat, place
        hashes = np.concatenate(found)
        del found
        self.at, ordered = hashing.stable_sort(hashes)
        del hashes
        self.starts = hashing.runs(ordered)
        self.distinct = ordered[self.starts]
        del ordered
        self.owner = np.concatenate([self.doc[e] for e in self.ends])[self.at]

    def counts(self, copies: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct n-gram, of each text as often as it has copies."""
        return np.add.reduceat(copies[self.owner], self.starts) if len(self.starts) else np.zeros(0, np.int64)

    def others(self, totals: np.ndarray) -> list[np.ndarray]:
        """For each length and word, how often other texts have the n-gram that ends there; 0 where the text is too short."""
        n = len(self.at)
        begin = np.zeros(n, bool)
        begin[self.starts] = True
        begin[1:] |= self.owner[1:] != self.owner[:-1]
        sizes = hashing.lengths(np.flatnonzero(begin), n)
        left = np.repeat(totals, hashing.lengths(self.starts, n))
        left -= np.repeat(sizes, sizes)
        rest = np.empty(n, np.int64)
        rest[self.at] = left
        del left
        out, done = [], 0
        for ends in self.ends:
            own = np.zeros(len(self.doc), np.int64)
            own[ends] = rest[done : done + len(ends)]
            done += len(ends)
            out.append(own)
        return out


def small(n: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow in eight bytes each. Nearly all are 1, which compresses well."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def large(data: bytes, count: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, count).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<u8", offset=count)
    return n


def owned(rows: pa.Table) -> pa.Table:
    """One bucket's table, and its replies: how often others have each n-gram that a chunk sent, in the order sent."""
    hashes = [unpack_sorted(h) for h in rows.column("hashes").to_pylist()]
    sizes = [len(h) for h in hashes]
    counts = np.concatenate([large(c, n) for c, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)])
    every = np.concatenate(hashes)
    order, ordered = hashing.stable_sort(every)
    starts = hashing.runs(ordered)
    others = np.empty(len(every), np.int64)
    others[order] = np.repeat(np.add.reduceat(counts[order], starts), hashing.lengths(starts, len(every)))
    others -= counts
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    masks, told = [], []
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        some = others[x:y] > 0
        masks.append(np.packbits(some).tobytes())
        told.append(small(others[x:y][some]))
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "mask": pa.array(masks, pa.binary()), "counts": pa.array(told, pa.binary())})


def log_scores(rest: list[np.ndarray], corpus: np.ndarray, alpha: float) -> np.ndarray:
    """Each word's log score, from the counts in the rest of the corpus and the rest's number of words."""
    log = np.where(rest[0] > 0, np.log(np.maximum(rest[0], 1) / np.maximum(corpus, 1)), np.log(alpha / np.maximum(corpus, 1)))
    for shorter, own in zip(rest, rest[1:], strict=False):
        context = np.concatenate(([0], shorter[:-1])) if len(own) else shorter
        log = np.where(own > 0, np.log(np.maximum(own, 1) / np.maximum(context, np.maximum(own, 1))), np.log(alpha) + log)
    return log


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words (long), n_seen (long: words whose longest n-gram the rest of the corpus has), log_score and mean_log_score (double).

    The score of a word after its context: count of the n-gram over count of the context if the
    rest of the corpus has the n-gram, else ``alpha`` times the score with one context word less;
    a word that the rest lacks counts as alpha / (words of the corpus).

    * null or empty text: no words, log_score 0, mean_log_score null.
    * repeated rows are documents of their own: each is part of the others' corpus.
    * empty table: empty result. Only doc_id and text are read.
    * n-grams are told apart by 64-bit hashes.
    """
    sizes = docs.agg(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit("[^\\x09-\\x0D\\x20]+")).cast("long"))).first()
    total = sizes[1] or 0
    dealt, buckets = deal(docs.select("doc_id", "text"), sizes[0] or 0, CHUNK_CHARS)

    def sending(table: pa.Table) -> pa.Table:
        own = opened(table)
        grams = Grams(own.column("text").to_pylist(), order)
        n, distinct = grams.counts(own.column("copies").to_numpy()), grams.distinct
        bucket, bounds = packed_rows(distinct, buckets)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        chunk = table.column("chunk")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(bucket, pa.int32()),
                "chunk": pa.array([chunk] * len(bucket), pa.int32()),
                "hashes": pa.array([pack_sorted(distinct[x:y]) for x, y in spans], pa.binary()),
                "counts": pa.array([small(n[x:y]) for x, y in spans], pa.binary()),
            }
        )

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = opened(table)
        copies = own.column("copies").to_numpy()
        grams = Grams(own.column("text").to_pylist(), order)
        n = grams.counts(copies)
        bucket, bounds = packed_rows(grams.distinct, buckets)
        at = dict(zip(bucket.tolist(), zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), strict=True))
        for b, mask, c in zip(*(replies.column(k).to_pylist() for k in ("bucket", "mask", "counts")), strict=True):
            x, y = at[b]
            some = np.unpackbits(np.frombuffer(mask, np.uint8), count=y - x).astype(bool)
            n[x:y][some] += large(c, int(some.sum()))
        rest, sizes = grams.others(n), grams.sizes
        log = log_scores(rest, total - np.repeat(sizes, sizes), alpha)
        per_doc = lambda x: np.bincount(grams.doc, x, len(sizes)).astype(float)
        sums = per_doc(log)
        mean = pa.array(np.divide(sums, sizes, where=sizes > 0, out=np.zeros(len(sizes))), mask=sizes == 0)
        out = pa.table([own.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(per_doc(rest[-1] > 0).astype(np.int64)), pa.array(sums), mean], ["doc_id", "n_words", "n_seen", "log_score", "mean_log_score"])
        return out if (copies == 1).all() else out.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    tables = dealt.groupBy("chunk").applyInArrow(sending, "bucket int, chunk int, hashes binary, counts binary").groupBy("bucket").applyInArrow(owned, "chunk int, bucket int, mask binary, counts binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(tables.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_words long, n_seen long, log_score double, mean_log_score double")


def joined_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``scores`` of rows of distinct doc_id, as joins: count tables by n-gram, exploded n-grams, sums per document."""
    own = docs.select("doc_id", words(F.col("text")).alias("w"))
    total = own.agg(F.sum(F.size("w").cast("long"))).first()[0] or 0
    word = own.select("doc_id", F.size("w").alias("size"), F.posexplode("w").alias("i", "x"))
    by = Window.partitionBy("doc_id").orderBy("i")
    for k in range(order):
        gram = F.array_join(F.array(*[F.lag("x", j).over(by) if j else F.col("x") for j in range(k, -1, -1)]), " ")
        word = word.withColumn(f"g{k}", F.when(F.col("i") >= k, gram))
    for k in range(order):
        inside = word.groupBy("doc_id", f"g{k}").agg(F.count("*").alias("own"))
        counts = inside.groupBy(f"g{k}").agg(F.sum("own").alias("all"))
        rest = inside.join(counts, f"g{k}").select("doc_id", f"g{k}", (F.col("all") - F.col("own")).alias(f"n{k}"))
        word = word.join(rest, ["doc_id", f"g{k}"], "left").withColumn(f"n{k}", F.coalesce(f"n{k}", F.lit(0)))
    corpus = F.greatest(F.lit(total) - F.col("size"), F.lit(1))
    log = F.when(F.col("n0") > 0, F.log(F.col("n0") / corpus)).otherwise(F.log(F.lit(alpha) / corpus))
    for k in range(1, order):
        n, context = F.col(f"n{k}"), F.coalesce(F.lag(f"n{k - 1}").over(by), F.lit(0))
        log = F.when(n > 0, F.log(n / F.greatest(context, n))).otherwise(F.log(F.lit(alpha)) + log)
    sums = word.withColumn("log", log).groupBy("doc_id").agg(F.sum((F.col(f"n{order - 1}") > 0).cast("long")).alias("n_seen"), F.sum("log").alias("log_score"))
    out = own.join(sums, "doc_id", "left").select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("n_seen", F.lit(0)).alias("n_seen"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))
