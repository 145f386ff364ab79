"""Counting what documents share, by hash, without a row for each occurrence.

Documents are dealt into chunks. A chunk sends each distinct hash once, packed into one row for each
bucket of the hash space; the task that owns a bucket sees each hash at most once a chunk, however
often a hot passage is repeated, and replies to the chunks. Chunk and replies then meet again in a
cogroup. Only packed rows are shuffled, and no group grows with how often one hash occurs.

Chunks and buckets grow with the input, so a row packs fewer hashes the larger it is: some
chunk hashes x bucket hashes / all hashes. At worst that is one a row, as many rows as a plain
exploded table has, never more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a chunk, and of what one bucket's hashes stand for.
CHUNK_CHARS, BUCKET_CHARS = 3_000_000, 12_000_000


def deal(docs: DataFrame, chars: int, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> tuple[DataFrame, int]:
    """(chunk, docs) rows, and the number of buckets; both numbers follow ``chars``, the size of the table.

    ``docs`` holds the documents (doc_id, text as bytes, copies: rows alike) that one batch has for a
    chunk, as a compressed Arrow stream: texts are shuffled for both readers, so they had better be
    small. Documents are dealt by doc_id and text, so that rows without a doc_id, or with one in
    common, are spread; rows alike in both travel as one with their number.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, buckets = max(least, -(-chars // chunk_chars)), max(least, -(-chars // bucket_chars))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_batches([b]).group_by(["chunk", "doc_id", "text"], use_threads=False).aggregate([([], "count_all")])
            chunk = rows.column("chunk").to_numpy()
            rows = rows.select(["doc_id", "text", "count_all"]).rename_columns(["doc_id", "text", "copies"])
            order = np.argsort(chunk, kind="stable")
            found, starts = np.unique(chunk[order], return_index=True)
            for c, at in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "docs"])

    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.col("text").cast("binary").alias("text"))
    return dealt.mapInArrow(pack, "chunk int, docs binary"), buckets


def opened(chunk: pa.Table) -> pa.Table:
    """(doc_id, text, copies) of all documents of one chunk."""
    return pa.concat_tables([pa.ipc.open_stream(d.as_py()).read_all() for d in chunk.column("docs")])


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, in the hashes' order: sorted hashes give sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed_rows(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bounds) of the runs of the sorted ``hashes`` that fall in one bucket."""
    bucket = buckets_of(hashes, buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = np.concatenate(([0], cuts, [len(hashes)])) if len(hashes) else np.zeros(1, np.int64)
    return bucket[bounds[:-1]], bounds


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, each in as few bytes as the largest needs.

    The first byte says how many, eight hold the first hash; the low bytes follow as they are, and the
    highest byte of each, which varies little, compressed.
    """
    steps = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max()).bit_length() // 8)) if len(steps) > 1 else 1
    planes = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)
    low, high = np.ascontiguousarray(planes[:, : width - 1]).tobytes(), np.ascontiguousarray(planes[:, width - 1]).tobytes()
    return bytes([width]) + hashes[:1].astype("<u8").tobytes() + low + (pa.compress(high, codec="zstd", asbytes=True) if high else b"") + len(high).to_bytes(4, "little")


def unpack_sorted(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    width, first, n = data[0], np.frombuffer(data, "<u8", 1, 1), int.from_bytes(data[-4:], "little")
    end = 9 + n * (width - 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : width - 1] = np.frombuffer(data, np.uint8, n * (width - 1), 9).reshape(n, width - 1)
    if n:
        steps[:, width - 1] = np.frombuffer(pa.decompress(data[end:-4], n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.concatenate((first, steps.view("<u8").reshape(-1))), dtype=np.uint64)
