"""Queries over blocks where some blocks, pages and documents have no text at all."""

from __future__ import annotations

import pytest

from palimpsest import registry

from . import compare

TEXTS = ["A first line of text.\nSecond line here\n\nwell well", "", "   ", " \n\n \n", None, "One line only", "\n".join(["word after word"] * 41 + [""]), "\n".join(["word after word"] * 40 + ["", "x yy zzz"])]


@pytest.fixture(scope="module")
def blank(spark, tmp_path_factory) -> str:
    d = str(tmp_path_factory.mktemp("blank"))
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang")
    rows.coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["j16_inline_graphics", "p4_p8_roles", "w5_w6_reading_order"])
def test_blocks_without_text_are_left_out(spark, blank, name):
    assert compare.differences(registry.queries()[name](spark, blank), registry.oracle_sql()[name], blank) == ""
