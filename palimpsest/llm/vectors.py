"""Integer vectors in blocks of rows, with the lists that search reads, and the grid of queries by blocks.

A block is one row of a stored table: ids, labels, flags and whole-number vectors of at most ``ROWS``
rows, and beside them a permutation of its postings. Queries, a stated set that grows with the table,
meet the blocks in a grid: ``GROUP`` queries by ``PART`` blocks are one group of bounded size, in which
the queries stay and the blocks stream by. Nothing is broadcast or collected but two counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rows of a block (their numbers must fit 16 bits), blocks of a part, queries of a group.
ROWS, PART, GROUP = 4096, 8, 512

#: A component's largest value; what is beyond counts as it.
LARGEST = 2**62

#: Whole numbers up to here add up exactly in these types; beyond, Python's integers do the work.
EXACT = ((2**23, np.float32), (2**52, np.float64))

BLOCKS = "block long, n int, n_flagged int, ids array<long>, labels array<long>, flags array<boolean>, dims int, kind string, vectors binary, postings binary, segments binary"

Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def whole_numbers(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each row's components, shorter rows filled up with zeros, and which rows are whole: not null, all finite."""
    good = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    fine = np.isfinite(flat)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[fine], at[fine]] = np.clip(flat[fine], -float(LARGEST), float(LARGEST)).astype(np.int64)
    return out, good


def wide(x: np.ndarray, dims: int) -> np.ndarray:
    """``x`` with zeros up to ``dims`` columns."""
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds them, and their bytes."""
    most = int(np.abs(vectors).max(initial=0))
    kind = next(k for k, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2**bits)
    return kind, np.ascontiguousarray(vectors.astype(kind)).tobytes()


def unpacked(row: dict) -> np.ndarray:
    """The vectors of a block or a query as 64-bit integers."""
    return np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["dims"]).astype(np.int64)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which all inner products of the rows of ``a`` and ``b``, and their parts, are exact."""
    most = a.shape[1] * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    return next((kind for limit, kind in EXACT if most < limit), object)


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what is beyond their range counts as its end."""
    if scores.dtype == object:
        return np.array([min(max(int(s), -(2**63) + 1), 2**63 - 1) for s in scores], np.int64)
    return scores.astype(np.int64)


def in_blocks(rows: DataFrame, vector: str, scale: int, lists: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], flag: Column, label: Column | None = None, id: str = "vec_id") -> DataFrame:  # noqa: A002
    """A stored table of blocks of the whole-number vectors of ``rows``; ``lists`` gives postings and segments of a block.

    Rows whose vector is null or holds a null or non-finite component take no part.
    """
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            dims = max(x[3].shape[1] for x in held)
            vectors = np.concatenate([wide(x[3], dims) for x in held])
            kind, data = packed(vectors)
            postings, segments = lists(vectors)
            flags = pa.concat_arrays([x[2] for x in held])
            row = [part << 32 | at, len(vectors), sum(flags.to_pylist()), pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), flags, dims, kind, data, postings.tobytes(), segments.tobytes()]
            return pa.RecordBatch.from_pylist([{f.name: v.to_pylist() if isinstance(v, pa.Array) else v for f, v in zip(SCHEMA, row, strict=True)}], schema=SCHEMA)

        for b in batches:
            vectors, good = whole_numbers(b.column(3), scale)
            chosen = np.flatnonzero(good)
            while len(chosen):
                room = ROWS - sum(len(x[0]) for x in held)
                now, chosen = chosen[:room], chosen[room:]
                held.append((*(b.column(i).take(pa.array(now)) for i in range(3)), vectors[now]))
                if len(now) == room:
                    yield block()
                    held, at = [], at + 1
        if held:
            yield block()

    flagged = rows.select(F.col(f"`{id}`").cast("long").alias("id"), (F.lit(None) if label is None else label).cast("long").alias("label"), F.coalesce(flag, F.lit(False)).alias("flag"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return written(flagged.repartition(max(1, -(-n // ROWS))).mapInArrow(run, BLOCKS), "vector-blocks")


SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("n_flagged", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("dims", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("postings", pa.binary()), ("segments", pa.binary())])

QUERIES = "block long, pos int, id long, label long, dims int, kind string, vectors binary"


def flagged(blocks: DataFrame) -> DataFrame:
    """A row for each flagged row of the blocks: block and pos, which name it, id, label and its vector."""
    names = [x.split()[0] for x in QUERIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                vectors = unpacked(row)
                at = np.flatnonzero(np.array(row["flags"], bool))
                data = [packed(vectors[i : i + 1]) for i in at]
                rows = [(row["block"], int(i), row["ids"][i], row["labels"][i], row["dims"], k, d) for i, (k, d) in zip(at, data, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary())]))

    return blocks.mapInArrow(run, QUERIES)


def grid(queries: DataFrame, blocks: DataFrame, group: int = GROUP, part: int = PART) -> DataFrame:
    """Rows (query or body, the other null) in order: of each cell of the grid its queries, then its blocks one by one."""
    n_queries, n_blocks = queries.count(), blocks.count()
    groups, parts = max(1, -(-n_queries // group)), max(1, -(-n_blocks // part))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = queries.select(dealt(groups, "block", "pos").alias("g"), F.struct(*queries.columns).alias("query")).select("g", each(parts).alias("part"), F.lit(0).alias("turn"), "query")
    bodies = blocks.select(dealt(parts, "block").alias("part"), F.struct(*blocks.columns).alias("body")).select(each(groups).alias("g"), "part", F.lit(1).alias("turn"), "body")
    both = rows.unionByName(bodies, allowMissingColumns=True)
    return both.repartition(min(groups * parts, 10_000), "g", "part").sortWithinPartitions("g", "part", "turn").select("g", "part", "query", "body")


def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[dict], Iterator[dict]]]:
    """Of each cell of a ``grid`` its queries, and its blocks as they stream by."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, cell in groupby(rows, key=itemgetter("g", "part")):
        queries: list[dict] = []
        first = None
        for r in cell:
            if r["body"] is not None:
                first = r["body"]
                break
            queries.append(r["query"])
        if queries and first is not None:
            yield queries, (b for x in ([first], (r["body"] for r in cell)) for b in x)


def ids_of(body: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's rows (0 for null), and which are null."""
    none = np.array([x is None for x in body["ids"]], bool)
    return np.array([0 if x is None else x for x in body["ids"]], np.int64), none
