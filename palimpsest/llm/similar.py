"""Near copies by their sets of word shingles: every pair whose Jaccard similarity is 4/5 or more.

1. ``sketched``: each text's set of shingle hashes as a row: its SimHash, its size, its prefix and its
   parity map. The prefix is so many of the shingles, in an order that holds for the whole table, that
   two sets of similarity 4/5 must share one of them (with n shingles, n - ceil(4n/5) + 1). No radius of
   64-bit fingerprints promises that: texts this similar differ in some 10 of 64 bits on average, and in
   more without limit.
2. ``alike``: first the SimHash operator's tables of pivot distances (``simhash.links``) give pairs, which
   the sets verify. What its radius cannot reach follows: candidates share a prefix shingle and are of
   different classes so far. The order puts shingles that many texts share last, which decides the number
   of candidates and never the result. Candidates are the members of a prefix shingle with its least one;
   then those of a shingle that many have with some leaders, and of one that a crowd has with the square
   root of it; then all pairs that are left, each by the first shingle that it shares. Shingles with the
   same members give the same pairs, so one of them stands for all.
3. ``possible``: the parity map is a fingerprint of about a bit a shingle, each bit the parity of the
   shingles that fall on it. Two maps differ in at most as many bits as their sets in shingles, and
   similar sets in at most a ninth of their sizes' sum: most candidates end here, none of them similar.
4. ``verified``: the sets themselves decide, from the texts.
5. ``simhash.components``: classes of linked sets.

Exact copies count once: everything after step 1 works on distinct sets, which 64-bit hashes of
their shingles' 64-bit hashes tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, simhash
from .shared import batches_of, scope, written

SHINGLE = 5
#: Sets link if their Jaccard similarity is at least OF_SHARED / OF_ALL.
OF_SHARED, OF_ALL = 4, 5
#: Shingles in more prefixes than this go last in the order; so many of the most common at most.
COMMON, MOST_COMMON = 32, 500_000
#: Pairs that one copy of a text serves.
SERVED = 64
#: Leaders of a group of more than COMMON members.
LEADERS = 12
#: A group of more members draws further leaders, so that pairs grow less than with its square.
CROWD = 1024
#: Numbers of 64 bits of a parity map that the join of pairs compares at most, and its bits for each shingle up to there.
WIDE, SPREAD = 64, 16
#: So many of a set's least groups tell in which of them a pair is joined.
FIRST = 64
#: So many distinct keys are broadcast at most; more are joined by a shuffle.
SENT = 500_000
#: Rows, with a text or two each, that Python gets at once: their copies, not Spark's heap, are what executors run out of.
ROWS = 1000


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text's lower-cased words; a text of fewer words is one shingle."""
    for s in hashing.slices([t.lower() for t in texts]):
        y = 0
        for count in s.per_text:
            x, y = y, y + count
            if not count:
                yield np.zeros(0, np.uint64)
                continue
            k = min(shingle, count)
            h = np.sort(s.hashes(s.begins[x : y - k + 1], s.ends[x + k - 1 : y]))
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets([text], shingle))


def prefix_size(n: int) -> int:
    return n - -(-OF_SHARED * n // OF_ALL) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF_ALL * both >= OF_SHARED * (len(a) + len(b) - both)


def of_like_size(a: Column, b: Column) -> Column:
    """False for sizes that no similar sets have."""
    return (OF_ALL * a >= OF_SHARED * b) & (OF_ALL * b >= OF_SHARED * a)


def parity_map(own: np.ndarray, size: int | None = None) -> bytes:
    """For each bit of the least power of two from ``size`` (the set's, if not given) on, and from 256: whether an odd number of the set falls on it."""
    size = len(own) if size is None else size
    bits = max(256, 1 << (size - 1).bit_length()) if size else 256
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(parity: bytes, most: int = 4) -> np.ndarray:
    """A parity map folded to 256 bits, as four numbers, or to ``most`` numbers."""
    x = np.frombuffer(parity, "<i8")
    while len(x) > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def wide_map(own: np.ndarray) -> np.ndarray:
    """The parity map that the join of pairs compares: SPREAD bits for each shingle, so that hardly two fall on one bit, or WIDE numbers if those are fewer."""
    return folded(parity_map(own, min(SPREAD * len(own), 64 * WIDE)), WIDE)


def differ(a: bytes, b: bytes) -> int:
    """In how many bits two parity maps differ, the larger folded to the smaller's size: at most the sets' difference."""
    x, y = (np.frombuffer(m, "<u8") for m in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def texts_in(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def sketched(hashed: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """doc_id, hash, sid (long, names the set), fp (its SimHash), n (its size), prefix (array of long), parity (binary), p0 .. p3 (folded) and wide (its ``wide_map``) of every row."""
    sent = hashed.sparkSession.sparkContext.broadcast(common)
    added = {"sid": "long", "fp": "long", "n": "long", "prefix": "array<long>", "parity": "binary", "p0": "long", "p1": "long", "p2": "long", "p3": "long", "wide": "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        for b in batches:
            sids, fps, sizes, prefixes, maps, wide = [], [], [], [], [], []
            for own in shingle_sets(texts_in(b), shingle):
                sids.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                fps.append(simhash.majority(np.split(own, range(simhash.SLICE, len(own), simhash.SLICE))))
                sizes.append(len(own))
                maps.append(parity_map(own))
                wide.append(wide_map(own))
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                    own = np.concatenate((own[~late], own[late]))
                prefixes.append(own[: prefix_size(len(own))].view(np.int64))
            columns = [b.column("doc_id"), b.column("hash"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, fps)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
            small = np.array([folded(m) for m in maps], np.int64).reshape(-1, 4)
            columns += [pa.array(np.ascontiguousarray(small[:, i])) for i in range(4)] + [pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", *added])

    rows = hashed.select("doc_id", "hash", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, hashed.select("doc_id", "hash", *[F.lit(None).cast(k).alias(c) for c, k in added.items()]).schema)


def common_shingles(hashed: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many prefixes of different sets, sorted.

    Prefixes are taken half as long again, as what the common ones make room for comes from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = {}
            for own in shingle_sets(texts_in(b), shingle):
                size = prefix_size(len(own))
                held[xxhash.xxh3_64_intdigest(own.tobytes())] = own[: size + size // 2]
            every = np.concatenate([np.zeros(0, np.uint64), *held.values()])
            sids = np.repeat(np.array(list(held), np.uint64), [len(x) for x in held.values()])
            order = np.argsort(every)
            every, sids = every[order], sids[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            low, high = (np.minimum.reduceat(sids, starts), np.maximum.reduceat(sids, starts)) if len(every) else (sids, sids)
            columns = [every[starts].view(np.int64), np.diff(np.concatenate((starts, [len(every)]))).astype(np.int64), low.view(np.int64), high.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "n", "low", "high"])

    own = hashed.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, n long, low long, high long")
    counts = own.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("low").alias("low2"), F.max("high").alias("high"))
    shared = (F.col("low") < F.col("high")) | (F.col("low") < F.col("low2"))
    found = counts.filter((F.col("n") > COMMON) & shared).orderBy(F.col("n").desc(), "key").limit(MOST_COMMON).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: sid) that sizes and parity maps leave open; ``sets`` has sid, n and parity."""
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"map_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "map_a", "map_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "map_a", "map_b")), strict=True)
            keep = [(OF_SHARED + OF_ALL) * differ(x, y) <= (OF_ALL - OF_SHARED) * (i + j) for i, j, x, y in n]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def texts_of(hashed: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """sid and text (binary) of the sets in the pairs, each once."""
    needed = written(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct().join(sets.select("sid", "hash"), "sid"), "similar-needed")
    few = needed.count() <= SENT
    found = hashed.select("hash", F.col("text").cast("binary").alias("text")).join(F.broadcast(needed) if few else needed, "hash")
    return written(found.dropDuplicates(["sid"]).select("sid", "text"), "similar-texts")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b: sid) whose sets are similar; ``texts`` has sid and text (binary)."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / SERVED).alias("copies"))
    salted = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies"))
    served = texts.join(copies, texts["sid"] == copies["a"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("text").alias("left"))
    rows = salted.join(served, ["a", "copy"]).join(texts.select(F.col("sid").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*shingle_sets([x.as_py(), y.as_py()], shingle)) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def decided(pairs: DataFrame, hashed: DataFrame, sets: DataFrame, shingle: int, name: str) -> DataFrame:
    """The similar ones of the pairs (a, b: sid)."""
    left = written(possible(pairs, sets), f"similar-{name}")
    return written(verified(left, texts_of(hashed, sets, left), shingle), f"similar-{name}-links")


def open_pair(a: str, b: str) -> Column:
    """Whether members with prefixes ``a`` and ``b`` of their columns are of different classes, and sizes and folded maps leave them open."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))) for i in range(4)), F.lit(0))
    return (F.col(f"{a}label") != F.col(f"{b}label")) & of_like_size(n, m) & ((OF_SHARED + OF_ALL) * apart <= (OF_ALL - OF_SHARED) * (n + m))


def close_maps(a: Column, b: Column, n: Column) -> Column:
    """Whether two ``wide`` maps leave open that sets of ``n`` shingles together are similar; the larger is folded to the smaller's size, which is half of it."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), xor)
    x, y = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda s, v: s + F.bit_count(v))
    return (OF_SHARED + OF_ALL) * apart <= (OF_ALL - OF_SHARED) * n


def first_met(key: str, a: str, b: str) -> Column:
    """Whether members with the least groups ``a`` and ``b`` meet in ``key`` first; if they share none of those, they may meet in several."""
    return F.coalesce(F.array_min(F.array_intersect(a, b)), F.col(key)) == F.col(key)


def by_simhash(sets: DataFrame) -> DataFrame:
    """Pairs (a, b: sid) that chain the sets whose SimHash fingerprints link, as the operator's tables of pivot distances tell."""
    firsts = written(sets.groupBy("fp").agg(F.min("sid").alias("first")), "similar-fps")
    copies = sets.join(firsts, "fp").filter("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    end = lambda s: firsts.select(F.col("fp").alias(s), F.col("first").alias(f"{s}_sid"))
    across = simhash.links(firsts.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return written(copies.unionByName(across), "similar-simhash")


def undecided(met: DataFrame, sets: DataFrame, linked: DataFrame, name: str) -> DataFrame:
    """The members (key, members, sid, n, label, p0 .. p3) of the shingles whose members the links leave in several classes.

    Of shingles with the same members, told by their number and two 64-bit sums of hashes, one is taken.
    """
    labels = simhash.components(linked)
    named = written(met.join(labels, met["sid"] == labels["node"], "left").select("key", "sid", "n", F.coalesce("label", "sid").alias("label")), f"similar-{name}")
    sums = [F.bit_xor(F.xxhash64(F.lit(r), "sid")).alias(f"sum{r}") for r in range(2)]
    groups = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), *sums).filter("low < high")
    split = groups.groupBy("members", "sum0", "sum1").agg(F.min("key").alias("key")).select("key", "members")
    return written(named.join(split, "key").join(sets.select("sid", *[f"p{i}" for i in range(4)]), "sid"), f"similar-{name}-open")


#: What a member of a group is compared by.
MEMBER = ["sid", "n", "label", *[f"p{i}" for i in range(4)]]


def with_drawn(members: DataFrame, draws: list[Column]) -> DataFrame:
    """Open pairs (a, b: sid) of each member of a group with those of the group that ``draws`` pick."""
    drawn = members.groupBy("key").agg(F.array_distinct(F.array(*draws)).alias("l")).select("key", F.explode("l").alias("l")).select("key", *[F.col(f"l.{c}").alias(f"l_{c}") for c in MEMBER])
    return members.join(drawn, "key").filter(open_pair("", "l_")).select(F.least("l_sid", "sid").alias("a"), F.greatest("l_sid", "sid").alias("b")).distinct()


def with_leaders(members: DataFrame) -> DataFrame:
    """Open pairs (a, b: sid) of each member of a large group with LEADERS of the group, drawn by hashes that are the same in all groups."""
    return with_drawn(members.filter(F.col("members") > COMMON), [F.min_by(F.struct(*MEMBER), F.xxhash64(F.lit(r), "sid")) for r in range(LEADERS)])


def marked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` of groups with wide, firsts (the FIRST least of a set's groups) and crowd (the members of its largest)."""
    own = members.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("firsts"), F.max("members").alias("crowd"))
    return members.join(sets.select("sid", "wide"), "sid").join(own, "sid")


def close_pairs(some: DataFrame, others: DataFrame, which: Column) -> DataFrame:
    """Open pairs (a, b: sid) of ``some`` with ``others`` of their group (both from ``marked``) that ``which`` admits and wide maps leave open.

    A pair meets in as many groups as it shares prefix shingles. It is a row of the first of them, so that no group's pairs are told again by another.
    """
    side = lambda rows, s: rows.select("key", *[F.col(c).alias(f"{s}{c}") for c in (*MEMBER, "wide", "firsts")])
    close = open_pair("a_", "b_") & close_maps(F.col("a_wide"), F.col("b_wide"), F.col("a_n") + F.col("b_n")) & first_met("key", "a_firsts", "b_firsts")
    return side(some, "a_").join(side(others, "b_"), "key").filter(which & close).select(F.least("a_sid", "b_sid").alias("a"), F.greatest("a_sid", "b_sid").alias("b"))


def with_crowd(members: DataFrame) -> DataFrame:
    """Open pairs (a, b: sid) of each member of a crowd with as many others as the square root of its members, drawn by a hash that is the same in all groups."""
    drawn = F.pmod(F.xxhash64(F.lit(LEADERS), "sid"), F.lit(1 << 30)) * F.sqrt("crowd") < 1 << 30
    return close_pairs(members, members.filter(drawn), F.col("a_sid") != F.col("b_sid")).distinct()


def alike(hashed: DataFrame, own: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b: sid) of similar sets that connect all of them; ``own`` comes from ``sketched``."""
    sets = written(own.drop("doc_id").dropDuplicates(["sid"]), "similar-sets")
    linked = decided(by_simhash(sets), hashed, sets, shingle, "near-simhash")
    entries = sets.select("sid", "n", F.explode("prefix").alias("key"))
    keys = written(entries.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1").select("key"), "similar-keys")
    met = written(entries.join(keys, "key"), "similar-met")
    rest = undecided(met, sets, linked, "first")
    asked = written(with_drawn(rest, [F.min(F.struct(*MEMBER))]), "similar-star")
    linked = written(linked.unionByName(decided(asked, hashed, sets, shingle, "near-first")), "similar-linked")
    rest = undecided(met, sets, linked, "second")
    led = written(with_leaders(rest), "similar-leaders")
    if not led.isEmpty():
        linked = written(linked.unionByName(decided(led, hashed, sets, shingle, "near-leaders")), "similar-linked")
        rest = undecided(met, sets, linked, "third")
        asked = asked.unionByName(led)
    crowds = written(marked(rest.filter(F.col("members") > CROWD), sets), "similar-crowds")
    if not crowds.isEmpty():
        drawn = written(with_crowd(crowds).join(asked, ["a", "b"], "left_anti"), "similar-crowd-pairs")
        linked = written(linked.unionByName(decided(drawn, hashed, sets, shingle, "near-crowds")), "similar-linked")
        rest = undecided(met, sets, linked, "fourth")
        asked = asked.unionByName(drawn)
    rest = written(marked(rest, sets), "similar-wide")
    pairs = close_pairs(rest, rest, F.col("a_sid") < F.col("b_sid")).distinct()
    more = written(pairs.join(asked, ["a", "b"], "left_anti"), "similar-pairs")
    return linked.unionByName(decided(more, hashed, sets, shingle, "near-pairs"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class of near copies, as ``simhash.one_of_each`` picks it, with the columns of ``docs``.

    * null texts and those without words are copies of each other.
    * a text of fewer words than a shingle is one shingle; whole texts of any length count.
    * ties: of rows with one doc_id, the text of least hash stays; rows that repeat doc_id and text count once.
    * empty table: empty result. Columns of any name pass through.
    """
    hashed = simhash.packed(docs)
    with scope(docs.sparkSession), batches_of(docs.sparkSession, ROWS):
        own = written(sketched(hashed, shingle, common_shingles(hashed, shingle)), "similar-sketches")
        labels = simhash.components(alike(hashed, own, shingle))
        kept = simhash.first_ids(own.join(labels, own["sid"] == labels["node"], "left").select("doc_id", "hash", F.coalesce("label", "sid").alias("label")))
    return simhash.first_rows(hashed, kept)
