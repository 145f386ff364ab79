"""Lines and pages far longer than usual: results as on short ones, in time that goes with their length."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from palimpsest import registry
from palimpsest.functions import text as T
from palimpsest.operators import layout as L
from palimpsest.operators import page_geometry as PG
from palimpsest.plans import spans as plans

from .conftest import SF

WORDS = 60_000


def spans_of(spark, words: int):
    """One line of ``words`` spans."""
    s = F.col("id").cast("int")
    text = F.when(s % 7 == 3, ", ").when(s % 11 == 5, "(").when(s % 5 == 0, " ").otherwise(F.concat(F.lit("w"), s.cast("string")))
    rows = spark.range(words).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_num"), F.lit(0).alias("line"), s.alias("span"), text.alias("text"))
    x0 = F.col("span") * 30.0
    return rows.withColumns({"x0": x0, "y0": F.lit(20.0), "x1": x0 + 4.0 * F.length("text"), "y1": F.lit(30.0), "font_size": F.lit(10.0)})


def test_text_of_a_line_of_many_spans(spark):
    def text(words):
        start = time.time()
        found = L.lines_from_spans(spans_of(spark, words), ["doc_id", "page_num", "line"], "span").select("text").first()[0]
        return found, time.time() - start

    want = ""
    for s in range(WORDS):
        t = "," if s % 7 == 3 else "(" if s % 11 == 5 else "" if s % 5 == 0 else f"w{s}"
        want += t if not want or t == "," or want.endswith("(") or not t else f" {t}"
    text(10)
    found, took = text(WORDS)
    assert found == want
    # a fold over the text so far took minutes
    assert took < 20


def fused_plainly(boxes, gap):
    out = sorted(boxes, key=lambda b: (b[1], b[0], b[3], b[2]))
    while True:
        kept = []
        for b in out:
            at = next((i for i, k in enumerate(kept) if PG.touch(PG.grown(k, gap), b)), None)
            if at is None:
                kept.append(b)
            else:
                kept[at] = PG.union(kept[at], b)
        if len(kept) == len(out):
            return kept
        out = kept


def test_fused_boxes_of_a_crowded_page():
    some = random.Random(7)
    for _ in range(300):
        size = some.choice([20, 100, 400])
        corners = [(some.randint(0, size), some.randint(0, size)) for _ in range(some.randint(0, 30))]
        boxes = [(float(x), float(y), float(x + some.choice([1, 20, size])), float(y + some.choice([1, 20]))) for x, y in corners]
        assert PG.fused(boxes, 6) == fused_plainly(boxes, 6)
    boxes = [(90.0 * i, 20 + 6.5 * (i % 3), 90.0 * i + 24, 30 + 6.5 * (i % 3)) for i in range(20_000)]
    start = time.time()
    assert len(PG.fused(boxes, 6)) == 20_000
    # each box against all before it took minutes
    assert time.time() - start < 10


def test_lines_hold_only_the_fields_of_spans_that_are_read(spark):
    line = plans.nested(spark, SF, plans.BOX).schema["spans"].dataType.elementType
    assert line.names == ["span", *plans.BOX]


def test_first_spans_of_lines_short_and_empty(spark, tmp_path):
    texts = ["", "a\n\n b  c\nd e f g h i", "one two three four five six seven", "x\ny\nz\n\n\n\nw"]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.line, r.span, r.text) for r in registry.queries()["t5_first_spans"](spark, str(tmp_path)).collect())
    want = [[(i, n, k, w) for n, line in enumerate(t.split("\n")) for k, w in enumerate(line.split(" "))][:5] for i, t in enumerate(texts)]
    assert found == [x for one in want for x in one]


def test_joined_lines_of_a_block_of_many_lines(spark):
    line = F.when(F.col("i") % 5 == 0, "").when(F.col("i") % 3 == 1, F.concat(F.lit("w"), F.col("i").cast("string"), F.lit("-"))).otherwise(F.concat(F.lit("v"), F.col("i").cast("string")))

    def joined(n):
        rows = spark.range(n).withColumnRenamed("id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]).alias("l"))
        return rows.select(T.joined_lines(F.col("l"))).first()[0]

    texts = ["" if i % 5 == 0 else f"w{i}-" if i % 3 == 1 else f"v{i}" for i in range(40_000)]
    want = ""
    for t in texts:
        want += t if not want or not t or want.endswith("-") else f" {t}"
    joined(10)
    start = time.time()
    assert joined(len(texts)) == want
    # a fold over the text so far took far longer
    assert time.time() - start < 15
