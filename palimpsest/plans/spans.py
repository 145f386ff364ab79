"""Queries over spans and their characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators import spans as P
from ..sources import fixtures as X
from .catalog import Catalog

catalog = Catalog()
add = catalog.add
KEYS = ["doc_id", "page_num", "raw", "line"]


def chars(text: pa.Array, x0: pa.Array) -> pa.ListArray:
    """Characters of texts four points wide each; a gap of two points after every seventh."""
    flat = pa.concat_arrays([text.fill_null("")])
    data, bounds = np.frombuffer(flat.buffers()[2] or b"", np.uint8), np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    # the bytes that begin a character
    begins = bounds[0] + np.flatnonzero(data[bounds[0] : bounds[-1]] & 0xC0 != 0x80)
    c = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, bounds[-1]).astype(np.int32)), flat.buffers()[2])
    ends = np.searchsorted(begins, bounds)
    i = np.arange(len(begins)) - np.repeat(ends[:-1], np.diff(ends))
    left = np.repeat(x0.to_numpy(zero_copy_only=False), np.diff(ends)) + i * 4.0 + np.floor(i / 7) * 2.0
    level = lambda y: pa.array(np.full(len(begins), y))
    made = pa.StructArray.from_arrays([c, pa.array(left), pa.array(left + 4.0), level(10.0), level(20.0)], ["c", "x0", "x1", "y0", "y1"])
    return P.to_lines(np.repeat(np.arange(len(flat)), np.diff(ends)), made, text)


@F.arrow_udf(StringType())
def spaced(text: pa.Array, x0: pa.Array, size: pa.Array) -> pa.Array:
    parts = [P.raw_texts(chars(text[s], x0[s]), size[s]) for s in P.lines_at_once(pc.utf8_length(text))]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StructType().add("pictures", IntegerType()).add("letters", IntegerType()))
def box_counts(text: pa.Array, x0: pa.Array) -> pa.Array:
    count = lambda boxes: pc.list_value_length(boxes)
    both = [(count(P.picture_boxes(cs)), count(P.text_boxes(cs))) for s in P.lines_at_once(pc.utf8_length(text)) for cs in [chars(text[s], x0[s])]]
    pictures, letters = (pa.concat_arrays([pa.array([], pa.int32()), *x]) for x in (zip(*both, strict=True) if both else ((), ())))
    return pa.StructArray.from_arrays([pictures, letters], ["pictures", "letters"])


#: What a line holds of its spans.
BOX = ["x0", "y0", "x1", "y1"]


def nested(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    """The spans of each line in order, with the named fields only."""
    s = X.spans(spark, d, tuple(KEYS))
    # every fourth span is a small raised number
    number = F.col("span") % 4 == 3
    made = {
        "text": F.when(number, (F.col("span") % 10).cast("string")).otherwise(F.col("text")),
        "y1": F.when(number, F.col("y1") - 4).otherwise(F.col("y1")),
        "font_size": F.when(number, 5.0).otherwise(F.col("font_size")),
        "font": F.when(F.col("span") % 2 == 0, "Symbol").otherwise("Serif"),
    }
    one = F.struct("span", *[made.get(k, F.col(k)).alias(k) for k in fields])
    return s.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("spans"))


@add()
def w7_reference_markers(spark: SparkSession, d: str) -> DataFrame:
    found = P.markers("spans")
    return nested(spark, d, ["text", *BOX, "font_size"]).select(*KEYS, F.explode(found).alias("s")).select(*KEYS, "s.text", "s.is_marker")


@add(
    "SELECT doc_id, page_num, raw, line, array_to_string(list_transform(parts, lambda p, i: CASE WHEN i > 1 AND regexp_matches(p, '^[\\p{L}\\p{N}''’]') AND regexp_matches(parts[i - 1], '[\\p{L}\\p{N}''’]$') THEN concat(' ', p) ELSE p END), '') AS text FROM (SELECT *, regexp_extract_all(text, '(?s).{1,7}') AS parts FROM layout_lines)",
    "layout_lines",
)
def w8_missing_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Every line, its characters set apart after each seventh: a space where two word characters meet there."""
    rows = X.layout_lines(spark, d)
    return rows.select(*KEYS, spaced("text", "x0", "font_size").alias("text"))


@add()
def w9_repaired_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A symbol font's 5 before a number, in every line."""
    more = [F.struct(F.lit(at).alias("span"), F.lit(text).alias("text"), F.lit(font).alias("font")) for at, text, font in ((9998, "5", "Symbol"), (9999, "7", "Serif"))]
    return nested(spark, d, ["text", "font"]).select(*KEYS, P.repaired(F.concat(F.col("spans"), F.array(*more))).alias("parts"))


@add()
def w10_cover_strips(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d, BOX).select(*KEYS, F.explode(P.covers(F.col("spans"), F.lit(792.0))).alias("b")).select(*KEYS, "b.*")


@add("SELECT doc_id, page_num, raw, line, CASE WHEN line % 3 = 0 THEN 1 ELSE 0 END AS pictures, length(text) AS letters FROM layout_lines", "layout_lines")
def p33_symbol_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of text and of pictures, with a picture added to every third line."""
    t = F.concat("text", F.when(F.col("line") % 3 == 0, "☀").otherwise(""))
    return X.layout_lines(spark, d).select(*KEYS, box_counts(t, F.col("x0")).alias("n")).select(*KEYS, "n.pictures", "n.letters")
