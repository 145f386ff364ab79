"""SimHash near-duplicates: fingerprints, linked through tables of distances to pivots.

1. ``fingerprints``: one 64-bit SimHash a document, from its word shingles.
2. ``distances``: a table of each distinct fingerprint's Hamming distances to 89 reference fingerprints:
   the base pivot, FAMILY (64 pivots one bit from the base, in blocks of 16) and FAR (24 spread out).
3. ``links``: candidates come from that table alone. A change of one bit moves one distance of the
   family, measured from the base's, so two fingerprints at most two bits apart have equal distances,
   so measured, to the pivots of two blocks of four: they meet in one of six equi-joins. Of the pairs
   that meet, those with a pivot in FAR whose two distances differ by more than MAX_BITS are discarded
   (triangle inequality), and an XOR verifies the survivors.
4. ``components``: classes of linked fingerprints by hooking and pointer jumping.

No step forms all pairs of a group: fingerprints whose entries more than PAIRED share get pivots of
their own in ``close_links``, all points within one bit of them. Two fingerprints at most two bits
apart share such a pivot, any two that share one have distances that add up to two at most, and no
pivot has more than 65, so chaining each to the least one is exact. Exact copies count once
throughout: everything after step 1 works on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mixed
from .shared import scope, written

MAX_BITS = 2
SHINGLE = 3
SEED = 42
BLOCKS, BLOCK = 4, 16
#: Table entries shared by more fingerprints than this are joined by one-bit neighbours.
PAIRED = 64
SLICE = 1 << 17


#: The reference fingerprints: the base, those one bit from it, and the spread-out ones.
BASE_PIVOT = mixed(24)
FAMILY = [BASE_PIVOT ^ 1 << i for i in range(64)]
FAR = [mixed(i) for i in range(24)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words of one text; 0 if it has none."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    cuts = (slice(at, at + SLICE) for at in range(0, len(starts), SLICE))
    return majority(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[c].tolist(), ends[c].tolist(), strict=True)], "<u8") for c in cuts)


def majority(slices: Iterable[np.ndarray]) -> int:
    """The SimHash of shingles by their 64-bit hashes: each bit that over half of them have."""
    ones, n = np.zeros(64, np.int64), 0
    for h in slices:
        ones += np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and fp (long, the fingerprint's bits) for every row of ``docs``; null text has no words."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text")
            fps = np.fromiter((simhash(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fps.view(np.int64))], [*names, "fp"])

    rows = docs.select(*names, F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, docs.select(*names, F.lit(0).cast("long").alias("fp")).schema)


def to_pivots(fp: Column, pivots: list[int]) -> Column:
    """Hamming distances to the pivots, as an array."""
    return F.transform(F.array(*[F.lit(signed(p)) for p in pivots]), lambda p: F.bit_count(fp.bitwiseXOR(p)).cast("byte"))


def distances(fps: DataFrame) -> DataFrame:
    """The pivot distance table: fp, family (distances to FAMILY less the distance to the base) and far (to FAR)."""
    base = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(BASE_PIVOT))))
    family = F.transform(to_pivots(F.col("fp"), FAMILY), lambda d: (d - F.col("base")).cast("byte"))
    return fps.withColumn("base", base).select("fp", family.alias("family"), to_pivots(F.col("fp"), FAR).alias("far"))


def table_entries(table: DataFrame) -> DataFrame:
    """Six rows (key, fp, far) of the distance table for each fingerprint: its distances to the pivots of two blocks, as a key."""
    block = lambda i: F.slice("family", BLOCK * i + 1, BLOCK)
    keys = [F.xxhash64(F.lit(n), block(i), block(j)) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    return table.select(F.explode(F.array(*keys)).alias("key"), "fp", "far")


def told_apart(a: Column, b: Column) -> Column:
    """True if the distances to some pivot differ by more than two near fingerprints' can."""
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > MAX_BITS)


def close_links(fps: DataFrame) -> DataFrame:
    """Links that connect all of ``fps`` at most two bits apart, through pivots at most one bit from them."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    table = fps.select("fp", F.explode(near).alias("pivot")).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))))
    beside = table.filter(F.col("distance") * 2 <= MAX_BITS).groupBy("pivot").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return beside.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints ``fps`` that link, chained where many lie together."""
    entries = table_entries(written(distances(fps), "simhash-distances"))
    shared = written(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-entries")
    met = written(entries.join(shared, "key"), "simhash-met")
    few = met.filter(F.col("n") <= PAIRED)
    x, y = (few.select("key", F.col("fp").alias(s), F.col("far").alias(f"far_{s}")) for s in "ab")
    left = x.join(y, "key").filter("a < b").filter(~told_apart(F.col("far_a"), F.col("far_b")))
    pairs = left.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    many = met.filter(F.col("n") > PAIRED).select("fp").distinct()
    return pairs.unionByName(close_links(many)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (its component's least node) of every node of ``edges`` (a, b: long).

    Each round gives every node the least label beside it, hangs the old label's tree below the
    new one, and points each node at its label's label. Trees at least halve in number where
    they touch, so rounds grow with the logarithm of the longest chain. Every round is a table
    in the shared folder. A node's neighbours are at most the 2,080 fingerprints within two bits.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "simhash-edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "simhash-labels")
    while True:
        beside = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("best"))
        step = now.join(beside, now["node"] == beside["a"]).select("node", "label", F.least("label", "best").alias("best"))
        hung = step.filter("best < label").select(F.col("label").alias("node"), "best")
        hooked = written(step.select("node", "best").union(hung).groupBy("node").agg(F.min("best").alias("label")), "simhash-hooked")
        if hooked.join(now, ["node", "label"], "left_anti").isEmpty():
            return now
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        now = written(hooked.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "simhash-labels")


def classed(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, fp, label (a fingerprint that names the class) and component_id for every row of ``docs``."""
    with scope(docs.sparkSession):
        own = written(fingerprints(docs, shingle, keep), "simhash-fps", lasting=True)
        least = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
        linked = components(links(least.select("fp")))
        labels = written(least.join(linked, least["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-classes")
        tops = written(labels.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-tops")
        by_fp = written(labels.join(tops, "label").select("fp", "label", "component_id"), "simhash-by-fp", lasting=True)
    return own.join(by_fp, "fp").select("doc_id", *keep, "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) and component_id (least doc_id of its class) for every row of ``docs``.

    * null and empty texts have fingerprint 0 and so are copies of each other.
    * a text of fewer words than a shingle counts as one shingle.
    * a repeated doc_id keeps its rows, each with its own fingerprint; component_id is null only in a
      class whose doc_ids are all null.
    * empty table: empty result. Other columns of ``docs`` are not read.
    """
    return classed(docs, shingle).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, hash (of the text) and row: all columns of ``docs`` in a struct, so that none clashes."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: that of the least doc_id, null last; of several texts under it, the one of least hash.

    Rows that repeat the kept row, doc_id and text, count once. Empty table: empty result.
    """
    hashed = packed(docs)
    with scope(docs.sparkSession):
        kept = first_ids(classed(hashed, keep=("hash",)))
    return first_rows(hashed, kept)


def first_ids(labelled: DataFrame) -> DataFrame:
    """kept_id and kept_hash of the rows that ``one_of_each`` keeps of the classes (doc_id, hash, label) of ``labelled``, as a lasting table."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    firsts = labelled.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.hash").alias("kept_hash"))
    return written(firsts, "simhash-kept", lasting=True)


def first_rows(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows in ``hashed`` (from ``packed``) that ``kept`` (from ``first_ids``) names."""
    rows = hashed.drop("text").join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    return rows.dropDuplicates(["doc_id", "hash"]).select("row.*")
