"""The audit's rule for numbers against its SQL, on texts that the given tables hardly have."""

from __future__ import annotations

import pytest

from palimpsest import registry

from . import compare

TEXTS = [
    "1 2 3 4 5 6 7 8 long words that stand side by side without any number",
    "1 2 3 4 5 6 7 8 four long words here",
    "1é 2é 3é 4é 5é 6é 7é 8é ab cd",
    "1 2 3 4 5 6 7 8 élan forté naïve cœur dans",
    "١٢٣٤٥ ab", "12 34 ab", "12,5 3.5 7% 8kg 1 2 3 4 abcd",
]


@pytest.mark.parametrize("name", ["p3_p13_formulas", "p12_expected", "f13_block_warnings", "a13_a14_page_report", "a13_task_report", "translation_quality_by_language", "s7_quality_reports"])
def test_numeric_like_texts(spark, tmp_path, name):
    rows = [(7 * i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert compare.differences(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], str(tmp_path)) == ""
