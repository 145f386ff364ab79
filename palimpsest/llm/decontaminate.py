"""Benchmark decontamination: word windows of test items looked up in training texts.

The normalised windows of the benchmark form a hash set that is broadcast; tasks scan the windows
of whole texts against it, verify each hit word by word, and report or remove what was hit. The set
is only broadcast in blocks of at most BLOCK_CHARS characters of items: a larger benchmark is
scanned block after block, with the texts and what was found so far stored between.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

WINDOW = 10
#: Characters of benchmark text in one broadcast: at most some 700,000 windows, 250 MB in a worker.
BLOCK_CHARS = 4_000_000
#: Bytes that separate words: all of ASCII but letters and digits.
APART = bytes(b for b in range(128) if not chr(b).isalnum())
#: A word of lower-cased text.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_SPACE = bytes.maketrans(APART, b" " * len(APART))
BASE = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """Numbers of the benchmark's words; any other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def split(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


def rolled(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of the windows of ``size`` ids that start at ``at``."""
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total = total * BASE + ids[at + j].astype(np.uint64)
    return total


class Windows:
    """The windows of some benchmark items: a hash set, and the words behind each hash."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.ids, self.items = Ids(), {}
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in split((text or "").encode())]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                self.items.setdefault(tuple(own[i : i + size]), set()).add(item)
        self.hashes = {}
        for size in {len(w) for w in self.items}:
            rows = np.array([w for w in self.items if len(w) == size], np.int64)
            self.hashes[size] = np.unique(rolled(rows.reshape(-1), np.arange(len(rows)) * size, size))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans of words that windows cover, merged, and the items they come from."""
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        found, items = [], set()
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            if len(at):
                h = rolled(ids, at, size)
                at = at[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h]
            for i in at.tolist():
                if own := self.items.get(tuple(ids[i : i + size].tolist())):
                    found.append((i, i + size))
                    items |= own
        return merged(found), items


_index: dict[str, Windows] = {}


def index_of(key: str, items: list[tuple[str | None, str]], window: int) -> Windows:
    """The windows of a block, built once in a Python worker; only the last block is kept."""
    if key not in _index:
        _index.clear()
        _index[key] = Windows(items, window)
    return _index[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in runs of at most about ``limit`` characters; only one run is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // limit) or 1
    for k in range(n):
        yield [tuple(r) for r in (items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items).collect()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words (long), hit_spans (array of word positions, end excluded) and hit_items (array of item_id as string, sorted).

    * null text has no words and no hits; an item without words matches nothing, one of fewer words
      than a window is one window of its own length; items whose item_id is null hit as others do and
      are one null in hit_items, last, as SQL counts them; the items' hash leaves it out.
    * repeated rows are each scanned; empty tables give no rows, or no hits.
    * columns of ``docs`` that have these names are replaced.
    """
    added = {"n_words": "bigint", "hit_spans": "array<struct<begin:bigint,end:bigint>>", "hit_items": "array<string>"}
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*keep, F.lit(0).cast("bigint").alias("n_words"), *[F.array().cast(kind).alias(c) for c, kind in list(added.items())[1:]])
    schema = rows.schema
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    first = True
    for items in blocks(benchmark, block_chars):
        sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = index_of(key, sent.value, window)
            for b in batches:
                n, spans, found = [], [], []
                for text, s, i in zip(b.column("text").cast(pa.binary()), b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist(), strict=True):
                    words = split(text.as_py() or b"")
                    own, items = index.scan(words)
                    n.append(len(words))
                    spans.append([{"begin": x, "end": y} for x, y in merged([*((x["begin"], x["end"]) for x in s or ()), *own])])
                    found.append(sorted({*(i or ()), *items}, key=lambda x: (x is None, x)))
                columns = [b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

        # a table between blocks: tasks hold one block's index at a time
        rows = rows.mapInArrow(run, schema) if first else written(rows, "hits").mapInArrow(run, schema)
        first = False
    return rows


def cut(docs: DataFrame) -> DataFrame:
    """The texts of ``hits`` without their hit spans: from the first word's first byte to the last word's last; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column("text").cast(pa.binary()), b.column("hit_spans").to_pylist(), strict=True):
                data = text.as_py()
                if spans:
                    at = [m.span() for m in WORD.finditer(data.lower())]
                    for s in reversed(spans):
                        data = data[: at[s["begin"]][0]] + data[at[s["end"] - 1][1] :]
                texts.append(None if data is None else data.decode())
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without the documents, or without the spans, that hold a window of the benchmark; nulls, repeats, empty tables as in ``hits``.

    Columns of any name pass through as they are.
    """
    found = hits(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), benchmark)
    if remove == "documents":
        return found.filter(F.size("hit_spans") == 0).select("row.*")
    return cut(found).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts and the items' hash for each row of ``hits``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
