"""Token-id files: documents' ids in order, in Simple-8b, with offsets to read any block.

A data set is a Parquet folder of segments, so that Spark's committer and any of its stores serve
and a lost executor leaves no half-written file. A segment is one self-contained byte string:

    magic "PS8B", version u32, documents u64, ids u64, ids in a block u64, words u64
    doc_id i64[documents], has_id u8[documents], n_tokens u64[documents]
    block offsets u64[blocks + 1]   words before each block
    words u64[words]                Simple-8b, all little-endian

Beside it stand its range of documents (part), its place there (seq), and how many ids the part has
before it; the totals of the parts, one row each, give every document's place in the whole stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .shared import free
from .tokens import packed, words_of

SEGMENT_IDS = 1 << 18
#: Bytes of text in one part of the data set, so that parts grow in number and not in size.
PART_BYTES = 128 << 20
HEAD = struct.Struct("<4sIQQQQ")
SEGMENTS = "part int, seq int, ids_before long, n_docs long, n_ids long, payload binary"


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    return b"".join(
        [
            HEAD.pack(b"PS8B", 1, len(doc_ids), len(ids), simple8b.BLOCK, len(words)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is not None for x in doc_ids], "u1").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            offsets.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of one segment."""
    magic, version, docs, n, block, words = HEAD.unpack_from(data)
    if (magic, version) != (b"PS8B", 1):
        raise ValueError("not a token segment")
    at, out = HEAD.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", -(-n // block) + 1), ("<u8", words)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    doc_ids = [x if ok else None for x, ok in zip(out[0].tolist(), out[1].tolist(), strict=True)]
    return doc_ids, out[2].astype(np.int64), simple8b.decode(out[4], n)


def in_row_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that sort it as its rows stand, and their names.

    A table that Spark wrote keeps the order of what was written: by the number of the file, the file's
    count within its task, and the row's place in the file. Tasks read the files in another order.
    Rows that come from no single table are numbered as they come.
    """
    names = free(docs, "file", "count", "row")
    try:
        name, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
        number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("long")
        return docs.withColumns(dict(zip(names, (number("^part-(\\d+)"), number("-c(\\d+)"), row), strict=True))), names
    except AnalysisException:
        return docs.withColumn(names[2], F.monotonically_increasing_id()), names[2:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, order: Sequence[str] = ()) -> None:
    """Encodes every text of ``docs`` with the tokenizer file, ends it with ``end_id``, writes it to ``path``.

    Documents come in ascending ``order`` if given, else in ascending doc_id (null first; repeated ids
    by their texts' hash), dealt to parts by ranges. A null or empty text is its end id alone. Only
    doc_id, text and ``order`` are read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    end = packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = words_of(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, n = [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [part, seq, before, len(doc_ids), len(ids), pack(doc_ids, lengths, ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or b"") + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
                if n >= SEGMENT_IDS:
                    yield segment()
                    doc_ids, lengths, held, before, seq, n = [], [], [], before + n, seq + 1, 0
        if held:
            yield segment()

    doc_id, by = F.col("doc_id").cast("long"), [f"_by{i}" for i in range(len(order) or 2)]
    keys = [F.col(c) for c in order] or [doc_id, F.xxhash64("text")]
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"), *[k.alias(b) for k, b in zip(keys, by, strict=True)])
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "text")
    dealt.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_documents(spark: SparkSession, path: str, what: Callable[[np.ndarray], object], kind: str, arrow: pa.DataType) -> DataFrame:
    """doc_id, start, n_tokens and ``what(ids)`` as column value for every document in the files."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    begins = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, lengths, ids = unpack(data.as_py())
                at = np.concatenate(([0], np.cumsum(lengths)))
                values = [what(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, arrow)], ["doc_id", "start", "n_tokens", "value"])

    # one row a part is small beside its segments, which a join by shuffle would move whole
    placed = segments.join(F.broadcast(begins), "part").select((F.col("begin") + F.col("ids_before")).alias("start"), "payload")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, value {kind}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files."""
    return read_documents(spark, path, lambda ids: ids.astype(np.int64), "array<bigint>", pa.list_(pa.int64())).withColumnRenamed("value", "ids")


def crc32s(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return read_documents(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint", pa.int64()).withColumnRenamed("value", "ids_crc32")
