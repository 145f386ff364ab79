"""Text and boxes of spans: missing spaces, reference markers, symbol repair, covers, symbol boxes.

Array expressions over the spans of one line, folded in order where a step needs what the one before
it decided. What looks at single characters takes Arrow arrays of many lines at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

MATH = "<>=≤≥≈∼~×÷±"
#: Fonts that draw symbols on ordinary characters, and words before a comparison.
SYMBOL_FONT = "(?i)(symbol|advp|math|mt|cmsy|cmex|glyph)"
COMPARED = "\\b(frequency|rate|ratio|proportion|percent|percentage)\\s*$"


#: Characters of the lines that are worked on together.
AT_ONCE = 1 << 20


def lines_at_once(lengths: pa.Array) -> Iterator[slice]:
    """Runs of lines of about AT_ONCE characters, or of one line that has more."""
    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right"))
        yield slice(at, past := max(past, at + 1))
        at = past


def asked(c: pa.Array, test: Callable[[str], bool]) -> np.ndarray:
    """``test`` of every string, once for each distinct one; null: False."""
    d = c.dictionary_encode()
    told = np.array([v is not None and test(v) for v in d.dictionary.to_pylist()] + [False], bool)
    return told[d.indices.fill_null(len(told) - 1).to_numpy(zero_copy_only=False)]


def is_word(c: str) -> bool:
    return len(c) == 1 and (c in "'’" or unicodedata.category(c)[0] in "LN")


def is_picture(c: str) -> bool:
    return c[:1] != "" and c[0] not in T.BULLETS and (c[0] >= "\U00010000" or unicodedata.category(c[0]) == "So")


def of_lines(chars: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The line of each character, and the characters of all lines."""
    lengths = pc.list_value_length(chars).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(chars)), lengths), chars.flatten()


def to_lines(rows: np.ndarray, values: pa.Array, chars: pa.ListArray) -> pa.ListArray:
    """``values`` as lists by line; a line that is null stays null."""
    ends = np.cumsum(np.bincount(rows, minlength=len(chars)))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)
    return pc.if_else(chars.is_valid(), lists, pa.scalar(None, lists.type)) if chars.null_count else lists


def more(a: pa.Array, b: pa.Array) -> np.ndarray:
    return pc.greater(a, b).fill_null(False).to_numpy(zero_copy_only=False)


def raw_texts(chars: pa.ListArray, size: pa.Array) -> pa.Array:
    """Texts of spans from their characters (c, x0, x1): spaces where word characters stand apart.

    If close to half of all gaps would become spaces, the span is letter-spaced and gets none.
    """
    rows, flat = of_lines(chars)
    c = pc.struct_field(flat, "c")
    kept = pc.not_equal(c, "").fill_null(False)
    rows, c = rows[kept.to_numpy(zero_copy_only=False)], c.filter(kept)
    x0, x1 = (pc.struct_field(flat, k).filter(kept) for k in ("x0", "x1"))
    limit = np.fmax(size.cast(pa.float64()).to_numpy(zero_copy_only=False) * 0.105, 0.75)
    word, n = asked(c, is_word), max(len(c) - 1, 0)
    gap = pc.subtract(x0.slice(1), x1.slice(0, n))
    apart = pc.greater_equal(gap, pa.array(limit[rows[1:]])).fill_null(False).to_numpy(zero_copy_only=False)
    apart = apart & word[1:] & word[:-1] & (rows[1:] == rows[:-1])
    gaps = np.maximum(np.bincount(rows, minlength=len(chars)) - 1, 1)
    few = np.bincount(rows[1:][apart], minlength=len(chars)) / gaps <= 0.45
    before = np.concatenate((np.zeros(min(len(c), 1), bool), apart & few[rows[1:]]))
    spaced = pc.if_else(pa.array(before), pc.binary_join_element_wise(" ", c, ""), c)
    return pc.binary_join(to_lines(rows, spaced, chars), "")


@F.arrow_udf(StringType())
def _raw_text(chars: pa.Array, size: pa.Array) -> pa.Array:
    parts = [raw_texts(chars[s], size[s]) for s in lines_at_once(pc.list_value_length(chars))]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def raw_text(chars: Column, size: Column) -> Column:
    """``raw_texts`` of a column."""
    return _raw_text(chars, size)


def is_marker_text(text: Column, size: Column) -> Column:
    """Up to six small digits and separators."""
    return (F.length(text) <= 6) & (size <= 7.2) & text.rlike("^[\\d,.\\-–—]+$") & text.rlike("\\d")


def superscript(text: Column) -> Column:
    return F.translate(text, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def markers(spans: Column) -> Column:
    """``spans`` (text, x0, y0, x1, y1, font_size) of a line with is_marker; markers in superscripts.

    A small raised number after a base span is a marker; a small number with nothing before it is dropped.
    """
    kind = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,is_marker:boolean>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0.0).alias("base"), F.lit(0.0).alias("foot"))

    def step(s: Column, x: Column) -> Column:
        small, size, base = x["small"], x["font_size"], s["base"]
        raised = s["foot"] - x["y1"] >= F.greatest(base * 0.16, F.lit(1.1))
        marker = small & (base > 0) & (size > 0) & (size <= F.greatest(F.lit(4.8), base * 0.88)) & (raised | (size <= base * 0.72))
        row = F.struct(F.when(marker, superscript(x["text"])).otherwise(x["text"]).alias("text"), *[x[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1", "font_size")], marker.alias("is_marker")).cast(kind)
        carried = ~marker & ~x["blank"]
        added = F.struct(F.concat(s["out"], F.array(row)).alias("out"), F.when(carried, size).otherwise(base).cast("double").alias("base"), F.when(carried, x["y1"]).otherwise(s["foot"]).cast("double").alias("foot"))
        return F.when(small & (F.size(s["out"]) == 0), s).otherwise(added)

    # what needs patterns is told once a span; in the step it would be for each use
    told = F.transform(spans, lambda x: F.struct(*[x[k].alias(k) for k in ("text", "x0", "y0", "x1", "y1", "font_size")], is_marker_text(x["text"], x["font_size"]).alias("small"), T.is_blank(x["text"]).alias("blank")))
    return F.aggregate(told, start, step, lambda s: s["out"])


def repaired(spans: Column) -> Column:
    """Texts of ``spans`` (text, font) of a line, symbols that a font drew on digits and stops put right.

    The look-back is the last two parts as already repaired; the look-ahead the next span with text.
    """
    start = F.array().cast("array<string>")

    def fold(cs: Column) -> Column:
        nexts = F.transform(cs, lambda x, i: F.try_element_at(cs, i + 2))

        def step(out: Column, p: Column) -> Column:
            x, ahead = p["x"], p["n"]
            clean, then = x["clean"], F.coalesce(ahead["clean"], F.lit(""))
            before = F.lower(T.normalized(F.array_join(F.slice(out, -2, 2), " ")))
            before = F.when(F.size(out) >= 2, before).otherwise(F.lower(F.array_join(out, " ")))
            number = then.rlike("^\\d")
            able = x["symbol"] & (then != "") & ~F.coalesce(x["font"] == ahead["font"], F.lit(False))
            new = (
                F.when((clean == "5") & number, "=")
                .when((clean == "3") & before.rlike("\\d\\s*$"), "×")
                .when((clean == ".") & number, ">")
                .when((clean == ",") & number & before.rlike(COMPARED), "<")
                .when((clean == ",") & number, "~")
                .otherwise(x["text"])
            )
            return F.concat(out, F.array(F.when(F.coalesce(able, F.lit(False)), new).otherwise(x["text"])))

        return F.aggregate(F.zip_with(cs, nexts, lambda x, n: F.struct(x.alias("x"), n.alias("n"))), start, step)

    # what needs patterns is told once a span; in the step it would be for each use
    symbol = lambda x: (F.coalesce(x["font"], F.lit("")) != "") & x["font"].rlike(SYMBOL_FONT)
    told = F.transform(F.filter(spans, lambda x: F.trim(x["text"]) != ""), lambda x: F.struct(x["text"].alias("text"), x["font"].alias("font"), T.normalized(x["text"]).alias("clean"), symbol(x).alias("symbol")))
    return F.transform(F.array(told), fold)[0]


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def covers(boxes: Column, page_height: Column) -> Column:
    """Cover strips of a line's text boxes: neighbours on a level united, then drawn in a little.

    The test is against the union so far, so this is a fold and no lag.
    """
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1"))))
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).cast(BOX)

    def step(out: Column, b: Column) -> Column:
        last = F.element_at(out, -1)
        low = F.least(last["y1"] - last["y0"], b["y1"] - b["y0"])
        level = F.least(last["y1"], b["y1"]) - F.greatest(last["y0"], b["y0"]) >= F.greatest(low, F.lit(1.0)) * 0.55
        gap = b["x0"] - last["x1"]
        close = level & (gap >= -1.0) & (gap <= F.greatest(F.lit(2.0), low * 0.25))
        one = box(F.least(last["x0"], b["x0"]), F.least(last["y0"], b["y0"]), F.greatest(last["x1"], b["x1"]), F.greatest(last["y1"], b["y1"]))
        new = box(b["x0"], b["y0"], b["x1"], b["y1"])
        return F.when(F.size(out) == 0, F.array(new)).when(close, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(new)))

    def inset(b: Column) -> Column:
        w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
        x = F.least(F.lit(1.0), w * 0.03)
        y = F.least(F.lit(1.8), h * 0.12)
        y = F.when((page_height > 0) & (b["y0"] <= page_height * 0.10), F.greatest(y, F.least(F.lit(3.0), h * 0.20))).otherwise(y)
        return F.when((h > y * 2) & (w > x * 2), box(b["x0"] + x, b["y0"] + y, b["x1"] - x, b["y1"] - y)).otherwise(b)

    # element_at of an empty array is asked for only inside a branch that is not taken
    safe = F.aggregate(ordered, F.array().cast(f"array<{BOX}>"), lambda out, b: F.when(F.size(out) == 0, F.array(box(b["x0"], b["y0"], b["x1"], b["y1"]))).otherwise(step(out, b)))
    return F.transform(safe, inset)


def boxes(chars: pa.ListArray, test: Callable[[str], bool]) -> pa.ListArray:
    """The characters (c, x0, y0, x1, y1) that have some area and pass ``test``."""
    rows, flat = of_lines(chars)
    x0, y0, x1, y1, c = (pc.struct_field(flat, k) for k in ("x0", "y0", "x1", "y1", "c"))
    kept = asked(c, test) & more(x1, x0) & more(y1, y0)
    return to_lines(rows[kept], flat.filter(pa.array(kept)), chars)


def text_boxes(chars: pa.ListArray) -> pa.ListArray:
    """Boxes of characters that are no symbols or pictures."""
    return boxes(chars, lambda c: c != "" and c[0] not in "\ufe0f\u200d" and not is_picture(c))


def picture_boxes(chars: pa.ListArray) -> pa.ListArray:
    """Boxes of symbols and pictures, which are kept when text is replaced."""
    return boxes(chars, is_picture)
