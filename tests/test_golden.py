"""Hand-made rows with the results that the rules give."""

from __future__ import annotations

import datetime
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import plans as P
from palimpsest.functions import text as T
from palimpsest.operators import layout as L
from palimpsest.operators import ledger as G
from palimpsest.operators import page_geometry as PG
from palimpsest.operators import quality as Q
from palimpsest.operators import spans as S
from palimpsest.operators import translate as R
from palimpsest.streaming import ledger as ST


def value(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.normalized, "a ​ b\n c", "a b c"),
        (T.sanitized, "“Hi” — x…�\U0001f600•", '"Hi" - x...•'),
        (T.sanitized, "é ﬁ", "é fi"),
        (T.suspicious_glyphs, "�?", 2),
        (T.scripts, "Ab é ё Ω 中 1!", ["cjk", "cyrillic", "greek", "latin"]),
        (T.leading_marker, "• item", "• "),
        (T.leading_marker, "(iv) text", "(iv) "),
        (T.leading_marker, "Results. Text", "Results. "),
        (T.leading_marker, "plain text", ""),
        (R.protected, "as shown²,³ and⁴.", "as shown[[REF0]] and[[REF1]]."),
        (T.number_value, "1,234", "1234"),
        (T.number_value, "0,123", "0.123"),
        (T.number_value, "1.234.567", "1234567"),
        (T.number_value, "1,2,34", "12.34"),
        (T.number_value, "12,5", "12.5"),
        (T.ends_sentence, 'Done.")', True),
        (T.ends_sentence, "Not done", False),
        (T.is_formula, "x = 1 + 2", True),
        (T.is_formula, "A plain sentence of words", False),
        (T.is_emoji_only, "\U0001f600 ☀️", True),
        (T.is_emoji_only, "•", False),
        (T.suspicious_count, "?" * 6 + "a" * 94, 6),
        (T.suspicious_count, "?" * 6 + "a" * 294, 0),
    ],
)
def test_text(spark, f, text, want):
    assert value(spark, f(F.col("t")), t=text) == want


def test_restore(spark):
    source = "as shown²,³ and⁴."
    assert value(spark, R.restored(F.col("t"), F.lit(source)), t="wie gezeigt[[ref 0]] und.") == "wie gezeigt²,³ und⁴."
    assert value(spark, R.restored(R.protected(F.col("t")), F.col("t")), t=source) == source
    assert value(spark, R.normalized_translation(F.col("t"), F.lit("1. A")), t=" x\ny ") == "1. x y"


def test_lines_and_hyphens(spark):
    assert value(spark, T.joined_lines(F.array(F.lit("trans-"), F.lit("lation"), F.col("t"))), t="A") == "trans-lation A"
    assert value(spark, T.joined_lines(F.array(F.lit("A-"), F.col("t"))), t="Beta") == "A- Beta"


@pytest.mark.parametrize(
    ("source", "reply", "lost"),
    [("≥ 5 %", "at least five", [">=5%", "5%"]), ("5 %", "5%", []), ("10-20 mm", "10 to 20 mm", []), ("10-20 mm", "10 mm", ["10-20"]), ("< 0,5", "below 0.5", []), ("12%", "１２％", []), ("１２％", "twelve", ["12%"]), ("１０－２０", "10 to 20", []), ("＞５", "over 5", []), ("5 ٪ ٣%", "٣%", []), ("⑫%", "12%", []), ("½%", "none", ["2%"]), ("1 234%", "1234 %", ["234%"]), ("𝟏𝟐%", "12%", []), ("<\u03385", "", [])],
)
def test_lost_numbers(spark, source, reply, lost):
    """Through the audit's own warnings, full-width and other compatibility forms on either side."""
    df = spark.createDataFrame([(source, reply or "none")], "text string, translated string")
    found = [w["tokens"] for w in df.select(Q.warnings_of(df).alias("w")).first()["w"] if w["code"] == "missing_numeric_symbol"]
    assert found == ([lost] if lost else [])


def test_numeric_text_is_nfkc_as_far_as_numbers_go(spark):
    """Every character's numeric form against the whole normalisation, as the rules read it."""
    chars = [chr(c) for c in (*range(0x20, 0xD800), *range(0xF900, 0x20000)) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc")]
    df = spark.createDataFrame([(f"1{c}2",) for c in chars], "t string")
    seen = lambda t: re.sub(r"[^\d%<>=.,+\-\s]", "", re.sub("[\u2010-\u2015\u2212]", "-", t.replace("≤", "<=").replace("≥", ">=")))
    for r in df.select("t", T.numeric_text(F.col("t")).alias("n")).collect():
        assert seen(r["n"]) == seen(unicodedata.normalize("NFKC", r["t"])), r


@pytest.mark.parametrize(("plan", "status", "want"), [(" Pro ", "active", "pro"), ("pro", "past_due", "free"), ("gold", "active", "free"), (None, None, "free")])
def test_plans(spark, plan, status, want):
    df = spark.createDataFrame([(plan, status)], "p string, s string")
    assert df.select(P.effective_plan(F.col("p"), F.col("s"))).first()[0] == want


def test_pages_and_grants(spark):
    pages = [("free", 10, 3), ("starter", 80, 50), ("power", 0, 0)]
    df = spark.createDataFrame(pages, "p string, n int, want int")
    assert all(r[0] == r[1] for r in df.select(P.translatable_pages(F.col("p"), F.col("n")), "want").collect())
    asked = spark.createDataFrame([("free", 10, 2), ("starter", 60, 100), ("pro", 200, 150)], "p string, n int, left int")
    granted, reason = P.authorised(F.col("p"), F.col("n"), F.col("left"))
    assert [tuple(r) for r in asked.select(granted, reason).collect()] == [(2, None), (None, "413"), (None, "402")]


def test_admission(spark):
    rows = [(i, 1, k) for i, k in enumerate(["k1", "k1", "k2", "k3", "k1"])]
    out = G.admissions(spark.createDataFrame(rows, "i int, user int, key string"), ["key"], "user", ["i"], F.lit(2), F.lit(0)).orderBy("i")
    assert [r["admitted"] for r in out.collect()] == [True, True, True, False, True]


def test_batches(spark):
    rows = [(1, i, "x" * 3000) for i in range(7)] + [(2, 0, "x" * 9000)]
    out = R.batches(spark.createDataFrame(rows, "page int, i int, text string"), ["page"], "i").orderBy("page", "i")
    assert [r["batch"] for r in out.collect()] == [0, 0, 1, 1, 2, 2, 3, 0]


def test_replies(spark):
    fence = '```json\n[{"id":1,"text":"b"},{"id":0,"text":"a"}]\n```'
    rows = [(fence, 2), ('[{"id":0,"text":"a"}]', 2), ("sorry", 1), ('[{"id":5,"text":"a"}]', 1)]
    out = R.parsed_replies(spark.createDataFrame(rows, "reply string, n_items int")).collect()
    assert [r["texts"] for r in out] == [["a", "b"], None, None, None]


def test_export_size(spark):
    out = Q.with_size_warning(spark.createDataFrame([(100, 221), (100, 220)], "source_bytes long, export_bytes long")).collect()
    assert [r["size_warning"] for r in out] == [True, False]


LINE = "doc_id long, page_num int, raw int, line int, text string, x0 double, y0 double, x1 double, y1 double, font_size double"


@pytest.mark.parametrize(("gap", "segments"), [(5.0, [0, 1]), (3.0, [0, 0])])
def test_segment_gap(spark, gap, segments):
    rows = [(1, 0, 0, 0, "words that fill the whole of this line and more", 10.0, 10.0, 210.0, 20.0, 10.0), (1, 0, 0, 1, "and words that go on in the next line of it all", 10.0, 20.0 + gap, 210.0, 30.0 + gap, 10.0)]
    out = L.segments(spark.createDataFrame(rows, LINE), ["doc_id", "page_num", "raw"], "line").orderBy("line")
    assert [r["segment"] for r in out.collect()] == segments


def block(seq, text, x0, y0, x1, y1, font=10.0, page=1):
    return (1, page, seq, text, x0, y0, x1, y1, font, 612.0, 792.0, 0.0, [(0, text, x0, y0, x1, y1, font)])


BLOCK = "doc_id long, page_num int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, page_width double, page_height double, first_line_indent double, lines array<struct<n:int,text:string,x0:double,y0:double,x1:double,y1:double,font_size:double>>"


def flagged(spark, rows):
    return L.flagged(spark.createDataFrame(rows, BLOCK))


def test_vertical_text(spark):
    assert flagged(spark, [block(0, "twenty plain letters", 5.0, 300.0, 15.0, 420.0)]).first()["layout_role"] == "vertical_text"


def test_page_number_and_imprint(spark):
    rows = [block(0, "Page 12", 300.0, 770.0, 330.0, 780.0), block(1, "Copyright 2020 by us", 100.0, 760.0, 300.0, 770.0), block(2, "A paragraph of body text in the middle of the page", 100.0, 300.0, 500.0, 312.0)]
    out = {r["seq"]: r for r in flagged(spark, rows).collect()}
    assert out[0]["is_header_footer"] and out[1]["layout_role"] == "metadata" and out[2]["layout_role"] == "body" and not out[2]["is_header_footer"]


def two_columns(spark):
    text = "Words in a column of text that is narrow"
    rows = [block(k, f"{text} {k}", x, y, x + 180.0, y + 10.0) for k, (x, y) in enumerate([(60.0, 200.0), (60.0, 400.0), (360.0, 200.0), (360.0, 400.0)])]
    return L.columns(flagged(spark, rows))


def test_columns(spark):
    assert {r["seq"]: r["layout_column"] for r in two_columns(spark).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert [r["seq"] for r in L.reading_order(two_columns(spark)).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_alignment(spark):
    lines = [(0, "short", 250.0, 300.0, 362.0, 310.0, 10.0), (1, "also short", 246.0, 312.0, 366.0, 322.0, 10.0)]
    centred = (*block(0, "short also short", 246.0, 300.0, 366.0, 322.0)[:-1], lines)
    left = (*block(1, "one two", 60.0, 300.0, 160.0, 322.0)[:-1], [(0, "one", 60.0, 300.0, 90.0, 310.0, 10.0), (1, "two", 60.0, 312.0, 160.0, 322.0, 10.0)])
    right = block(2, "12", 540.0, 400.0, 600.0, 410.0)
    rows = flagged(spark, [centred, left, right, block(3, "a body line", 246.0, 500.0, 366.0, 510.0)]).withColumn("layout_role", F.when(F.col("seq") == 2, "marginalia").otherwise("body"))
    assert {r["seq"]: r["a"] for r in rows.select("seq", L.alignment().alias("a")).collect()} == {0: "center", 1: "left", 2: "right", 3: "left"}


def test_attribution_and_compact_heading(spark):
    rows = [block(0, "Designed by Ada + Grace + Edsger", 200.0, 600.0, 400.0, 612.0, page=0), block(1, "Designed by Ada + Grace + Edsger", 200.0, 600.0, 400.0, 612.0), block(2, "A Large Heading", 100.0, 300.0, 300.0, 320.0, 18.0), block(3, "A large sentence that stops.", 100.0, 340.0, 300.0, 360.0, 18.0)]
    out = {r["seq"]: r for r in flagged(spark, rows).withColumn("compact", L.compact_heading()).collect()}
    assert {k: r["is_attribution"] for k, r in out.items()} == {0: True, 1: False, 2: False, 3: False}
    assert out[0]["layout_role"] == "metadata" and (out[2]["compact"], out[3]["compact"]) == (True, False)


def test_rescued_headers(spark):
    """The heading right above the text is one; the one far above, and the page number elsewhere, are not."""
    rows = [
        block(0, "Results overview", 72.0, 8.0, 172.0, 18.0), block(1, "A paragraph of text that is below the heading", 72.0, 22.0, 540.0, 32.0),
        block(2, "Page 2", 500.0, 8.0, 540.0, 18.0), block(3, "Other matters", 72.0, 8.0, 172.0, 18.0, page=2), block(4, "A paragraph that is far below the line above it", 72.0, 60.0, 540.0, 70.0, page=2),
    ]
    heads = flagged(spark, rows)
    assert {r["seq"] for r in heads.filter("is_header_footer").collect()} == {0, 2, 3}
    assert [r["seq"] for r in L.rescued_headers(heads).collect()] == [0]


def test_chart_seeds(spark):
    graphic = spark.createDataFrame([(1, 1, 100.0, 100.0, 400.0, 300.0, 612.0), (1, 2, 100.0, 100.0, 150.0, 300.0, 612.0)], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, page_width double")
    rows = [block(0, "20", 120.0, 120.0, 130.0, 126.0, 6.0), block(1, "Words of a body text that lie on the chart but are large", 120.0, 140.0, 380.0, 150.0, 11.0), block(2, "20", 500.0, 120.0, 510.0, 126.0, 6.0), block(3, "20", 120.0, 120.0, 130.0, 126.0, 6.0, page=2)]
    plain = flagged(spark, rows).withColumns({"is_header_footer": F.lit(False), "is_formula": F.lit(False)})
    assert [r["seq"] for r in L.chart_seeds(plain, graphic).collect()] == [0]


def test_inline_graphics(spark):
    """An image of a line's size at a first line is inline; a large one, and one at the second line, are not."""
    lines = [(0, "first line", 100.0, 200.0, 300.0, 210.0, 10.0), (1, "second line", 100.0, 230.0, 300.0, 240.0, 10.0)]
    text = (*block(0, "first line second line", 100.0, 200.0, 300.0, 240.0)[:-1], lines)
    boxes = [("inline", 90.0, 200.0, 100.0, 210.0), ("large", 90.0, 200.0, 190.0, 300.0), ("below", 120.0, 230.0, 130.0, 240.0)]
    images = spark.createDataFrame([(1, 1, *b) for b in boxes], "doc_id long, page_num int, image string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["image"], r["seq"]) for r in L.inline_graphics(images, flagged(spark, [text])).collect()] == [("inline", 0)]


def test_table_overlap(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 10.0), (1, 1, 1, 0.0, 20.0, 100.0, 30.0)], "doc_id long, page_num int, seq int, x0 double, y0 double, x1 double, y1 double")
    region = spark.createDataFrame([(1, 1, 30.0, 0.0, 70.0, 12.0), (1, 1, 35.0, 20.0, 65.0, 31.0)], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert [r["seq"] for r in L.in_tables(boxes, region).collect()] == [0]


def test_merge(spark):
    rows = [
        block(0, "A sentence that goes on from this line", 100.0, 100.0, 400.0, 110.0),
        block(1, "to the next one, and then it stops there.", 100.0, 113.0, 400.0, 123.0),
        block(2, "a third that stands too far below", 100.0, 160.0, 400.0, 170.0),
        block(3, "in other letters, right below it all", 100.0, 172.0, 400.0, 182.0, 16.0),
    ]
    out = PG.merged_blocks(L.reading_order(L.columns(flagged(spark, rows)))).orderBy("seq").collect()
    assert [(r["seq"], r["merged_blocks"]) for r in out] == [(0, 2), (2, 1), (3, 1)]
    assert out[0]["text"].startswith("A sentence") and out[0]["y1"] == 123.0


def test_regions():
    assert PG.fused([(0, 0, 10, 10), (14, 0, 20, 10), (100, 100, 110, 110)], 6) == [(0, 0, 20, 10), (100, 100, 110, 110)]
    rules = [(50.0, y, 550.0, y + 1.0) for y in (100.0, 150.0, 200.0)]
    import pandas as pd

    f = pd.DataFrame(rules, columns=["x0", "y0", "x1", "y1"]).assign(page_width=612.0, page_height=792.0)
    assert PG.rule_tables(f) == [(46.0, 82.0, 554.0, 227.0)]
    assert PG.rule_tables(f[:2]) == []


def test_aligned_table(spark):
    cells = [block(10 * r + c, f"cell {chr(97 + r)}{chr(97 + c)}", 60.0 + 180 * c, 200.0 + 20 * r, 160.0 + 180 * c, 209.0 + 20 * r) for r in range(4) for c in range(3)]
    out = PG.alignment_regions(flagged(spark, cells)).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in out] == [(54.0, 192.0, 526.0, 279.0)]


def test_chart_labels(spark):
    rows = [block(k, f"{k}0", 100.0 + 12 * k, 300.0, 110.0 + 12 * k, 306.0, 6.0) for k in range(4)] + [block(9, "far", 500.0, 600.0, 520.0, 606.0, 6.0)]
    none = spark.createDataFrame([], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, page_width double")
    out = PG.chart_text(flagged(spark, rows).withColumn("is_header_footer", F.lit(False)).withColumn("is_formula", F.lit(False)), none)
    assert {r["seq"]: r["is_chart_text"] for r in out.collect()} == {0: True, 1: True, 2: True, 3: True, 9: False}


def test_spans(spark):
    chars = [("a", 0.0, 4.0), ("b", 4.0, 8.0), ("c", 11.0, 15.0), ("d", 15.0, 19.0), ("e", 19.0, 23.0)]
    df = spark.createDataFrame([(chars,)], "cs array<struct<c:string,x0:double,x1:double>>")
    assert df.select(S.raw_text(F.col("cs"), F.lit(10.0))).first()[0] == "ab cde"
    spans = [("word", 0.0, 0.0, 20.0, 12.0, 10.0), ("12", 20.0, 0.0, 24.0, 6.0, 5.0), ("next", 26.0, 0.0, 40.0, 12.0, 10.0)]
    df = spark.createDataFrame([(spans,)], "s array<struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double>>")
    out = df.select(S.markers(F.col("s")).alias("m")).first()["m"]
    assert [(m["text"], m["is_marker"]) for m in out] == [("word", False), ("¹²", True), ("next", False)]
    parts = spark.createDataFrame([([("p", "Serif"), ("5", "Symbol"), ("7", "Serif")],)], "s array<struct<text:string,font:string>>")
    assert parts.select(S.repaired(F.col("s"))).first()[0] == ["p", "=", "7"]
    boxes = spark.createDataFrame([([(0.0, 100.0, 10.0, 110.0), (11.0, 100.0, 20.0, 110.0), (40.0, 100.0, 50.0, 110.0)],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    out = boxes.select(S.covers(F.col("b"), F.lit(792.0))).first()[0]
    assert [(round(b["x0"], 2), round(b["x1"], 2)) for b in out] == [(0.6, 19.4), (40.3, 49.7)]


def test_subscription_rules(spark):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 5)]
    rows = [
        (1, t[0], 1, "subscription.created", "pro", "active", t[0]), (2, t[1], 1, "subscription.updated", "pro", "active", None),
        (3, t[0], 2, "subscription.created", "pro", "active", t[0]), (4, t[1], 2, "subscription.updated", "power", "active", None),
        (5, t[0], 3, "subscription.created", "pro", "active", t[0]), (6, t[2], 3, "subscription.updated", "pro", "paused", t[2]),
    ]
    out = {r["user_id"]: (r["plan"], r["status"], r["period_start"]) for r in ST.subscriptions(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, plan string, status string, period_start timestamp")).collect()}
    assert out == {1: ("pro", "active", t[0]), 2: ("power", "active", t[1]), 3: ("free", "inactive", None)}


def test_quota_release(spark, tmp_path):
    t = [datetime.datetime(2024, 1, 1, i) for i in range(4)]
    rows = [(i, t[i - 1], 1, key, action, "2024-01", 1, 0) for i, key, action in [(1, "k1", "reserve"), (2, "k2", "reserve"), (3, "k1", "release"), (4, "k2", "reserve")]]
    schema = "event_id long, ts timestamp, user_id long, key string, action string, period string, quota int, base int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ST.run(ST.quota_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "append", "quota", ST.ROCKS)
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == {1: True, 2: False, 4: True}


def test_failing_translator(spark):
    items = spark.createDataFrame([("en", "zh", t) for t in ("good", "bad", "fine")], "s string, t string, text string")

    def fails(texts, source, target):
        if "bad" in texts:
            raise ValueError(texts)
        return [x.upper() for x in texts]

    out = {r["text"]: r["translated"] for r in R.translated(items.coalesce(1), "s", "t", fails).collect()}
    assert out == {"good": "GOOD", "bad": None, "fine": "FINE"}


def test_blocks_without_language_are_translated(spark):
    """A null language is a language of its own, in the batch and in the memory."""
    rows = [(1, None, "A text that is to be translated here."), (2, "de", "A text that is to be translated here."), (3, None, "12 + 3 = 15"), (4, "en", "A text that is to be translated here.")]
    blocks = spark.createDataFrame(rows, "id long, lang string, text string")
    out = {r["id"]: r["translated"] for r in R.translate_once(blocks, "en").collect()}
    text = rows[0][2]
    assert out == {1: f"[en: {text}]", 2: f"[en: {text}]", 3: "", 4: text}
    memory = spark.createDataFrame([(None, text, "known")], "lang string, text string, translated string")
    told = {r["id"]: (r["hit"], r["translated"]) for r in R.memory_lookup(blocks, memory, ["lang", "text"]).collect()}
    assert told == {1: (True, "known"), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_pages_of_a_long_listing(spark):
    """Any page comes from its own partitions; a page past the end is the last; an empty listing has none."""
    df = spark.range(100_003).select(F.col("id"), (F.col("id") * 7919 % 100_003).alias("at"))
    listing = G.Listing.of(df, [F.desc("at"), "id"], parts=7)
    page = listing.page(5_000)
    assert [(r["at"], r["rank"]) for r in page.orderBy("rank").collect()] == [(100_002 - k, k + 1) for k in range(49_990, 50_000)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_part" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r["at"] for r in listing.page(99_999).orderBy("rank").collect()] == [2, 1, 0]
    # a page that lies in two partitions
    border = listing.counts[0][1] // 10 + 1
    assert [r["rank"] for r in listing.page(border).orderBy("rank").collect()] == list(range(10 * border - 9, 10 * border + 1))
    assert G.page_of(df.filter("id < 0"), [F.desc("at")], 3).collect() == []
