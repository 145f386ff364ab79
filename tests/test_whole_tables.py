"""Queries over whole tables whose SQL twins see few rows, against the rules in plain Python."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from palimpsest import registry
from palimpsest.operators import layout as L
from palimpsest.operators import page_geometry as PG
from palimpsest.operators.translate import REFERENCE
from palimpsest.plans.layout import stored
from palimpsest.plans.translation import blocks
from palimpsest.sources import fixtures

from . import compare
from .conftest import SF


def test_merged_blocks(spark):
    """The merge of whole pages against a plain fold over their blocks, with every rule and no runs; batches of a few rows."""
    ordered = L.reading_order(L.columns(stored(spark, SF)))
    pages: dict = {}
    for r in PG.merge_facts(ordered).orderBy(*L.PAGE, "rank").collect():
        now = r.asDict(True) | {"role": r["layout_role"], "indent": r["first_line_indent"], "column": r["layout_column"]}
        done = pages.setdefault((r["doc_id"], r["page_num"]), [])
        if done and not any(keeps(PG.Pair.of(done[-1][0], now)) for keeps in PG.APART.values()):
            done[-1] = (PG.follow(done[-1][0], now), [*done[-1][1], now])
        else:
            done.append((now, [now]))
    want = {(*page, own[0]["seq"]): (len(own), " ".join(x["text"] for x in own if x["text"]), a["x0"], a["y0"], a["x1"], a["y1"], a["font"], a["column"], sum(len(x["lines"]) for x in own)) for page, done in pages.items() for a, own in done}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["doc_id"], r["page_num"], r["seq"]): (r["merged_blocks"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["font_size"], r["layout_column"], len(r["lines"])) for r in PG.merged_blocks(ordered).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and sum(v[0] > 1 for v in got.values()) > 50


def test_sql_finds_rows():
    assert not {k for k, sql in registry.oracle_sql().items() if not compare.oracle(f"SELECT * FROM ({sql}) LIMIT 1", SF)[1]}


def test_number_keys(spark):
    number = r"\d+(?:[.,]\d+)?"
    some = re.compile(rf"[<>]=?\s*\d|{number}\s*%|%\s*{number}|{number}\s*-\s*{number}", re.ASCII)
    want = sorted((r["doc_id"], r["block_index"], bool(some.search(r["text"])), r["block_index"] % 2 == 0 or not some.search(r["text"])) for r in blocks(spark, SF).collect())
    got = sorted(tuple(r) for r in registry.queries()["u3_number_keys_all"](spark, SF).select("doc_id", "block_index", "has_percent", "kept").collect())
    assert got == want and {x[2:] for x in got} >= {(True, True), (True, False), (False, True)}


def test_references(spark):
    rows = blocks(spark, SF).filter(~F.col("text").rlike(REFERENCE)).collect()
    got = {(r["doc_id"], r["block_index"]): r for r in registry.queries()["f9_references_all"](spark, SF).collect()}
    assert len(got) == blocks(spark, SF).count() and len(rows) > 500
    for r in rows:
        text, found = r["text"], got[(r["doc_id"], r["block_index"])]
        tail = re.search(r"[,.;:!?，。；：！？、\s]*\Z", text)[0]
        assert found["protected"] == f"a[[REF0]] {text}[[REF1]]."
        assert found["restored"] == f"a² {text}³-⁴."
        assert found["appended"] == f"a {text[: len(text) - len(tail)]}²³-⁴{tail}"


def test_every_role_occurs(spark):
    sql = registry.oracle_sql()["p4_p8_p29_every_role"]
    columns, rows = compare.oracle(sql, SF)
    seen = {k: {r[i] for r in rows} for i, k in enumerate(columns)}
    assert seen["own_role"] == seen["layout_role"] == {"body", "metadata", "dense_reference", "vertical_text", "marginalia"} and seen["align"] == {"left", "center", "right"}
    assert all(seen[k] == {True, False} for k in ("is_formula", "is_header_footer", "is_attribution"))
    assert any(r[columns.index("own_role")] != r[columns.index("layout_role")] for r in rows)
