"""What is shuffled and written on the way: lines, not their spans; a first write of pages, once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from palimpsest.operators import page_geometry as PG
from palimpsest.plans import geometry, layout, spans
from palimpsest.sources import pages as G
from palimpsest.sources.scratch import new_path

from .conftest import SF


def test_lines_are_dealt_before_they_are_split(spark):
    for df in (layout.s10_span_scan(spark, SF), spans.w10_cover_strips(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate"), plan


def test_first_pages_are_written_without_a_copy(spark, monkeypatch):
    copies = []
    real = G.written
    monkeypatch.setattr(G, "written", lambda df, name: copies.append(name) or real(df, name))
    page = lambda ids, text: spark.createDataFrame([(str(i),) for i in ids], "task_id string").select("task_id", F.lit(1).alias("pageNum"), F.lit("").alias("original"), F.lit(text).alias("translated"), F.array().cast(f"array<{G.BLOCK}>").alias("textBlocks"))
    path = new_path(spark, "pages")
    G.write_page_results(page(range(20), "a"), path)
    assert copies == []
    G.write_page_results(page([3, 4], "b"), path)
    G.write_page_results(page([], "c"), path)
    assert {r["task_id"]: r["translated"] for r in G.read_page_results(spark, path).collect()} == {str(i): "b" if i in (3, 4) else "a" for i in range(20)}


def whole_blocks_dealt(df) -> int:
    """Shuffles of a plan whose rows hold the lines of blocks."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum(" lines#" in rows for rows in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan))


def test_blocks_are_dealt_once_to_be_merged(spark):
    assert whole_blocks_dealt(geometry.t4_merged_blocks(spark, SF)) <= 1
    assert whole_blocks_dealt(layout.built(spark, SF)) == 0


def test_blocks_are_chosen_for_output_before_they_are_stored(spark):
    df = geometry.p15_output_blocks(spark, SF)
    assert whole_blocks_dealt(df) <= 1
    assert "RLIKE(text" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]


def test_layout_steps_go_by_tables_without_texts(spark, monkeypatch):
    kept = {}
    real = PG.written
    monkeypatch.setattr(PG, "written", lambda df, name, **more: kept.setdefault(name, real(df, name, **more)))
    df = geometry.g6_page_layout(spark, SF)
    assert [name for name, t in kept.items() if {"text", "lines"} & set(t.columns)] == ["merged-blocks"]
    # the last join may deal whole blocks; no other step does
    assert whole_blocks_dealt(PG.L.dense_pages(kept["merged-blocks"]).select("doc_id", "layout_role")) == 0 and whole_blocks_dealt(df) <= 1


def test_chart_text_builds_its_blocks_once(spark):
    plan = geometry.g5_u6_chart_text(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(n" not in plan, plan


def test_stored_pages_take_few_bytes(spark, tmp_path):
    text = F.concat_ws(" ", F.sequence(F.lit(1), F.lit(500)).cast("array<string>"))
    page = lambda ids: spark.createDataFrame([(str(i),) for i in ids], "task_id string").select("task_id", F.lit(1).alias("pageNum"), text.alias("original"), text.alias("translated"), F.array().cast(f"array<{G.BLOCK}>").alias("textBlocks"))
    read = lambda: sorted((int(r["task_id"]), len(r["original"])) for r in G.read_page_results(spark, path).collect())
    path, size = f"file://{tmp_path}/pages", 1891
    # a store of plain files, as one was, is read and replaced too
    page(range(40)).withColumn("bucket", G.task_bucket(F.col("task_id"))).write.partitionBy("bucket").json(path)
    plain = sum(f.stat().st_size for f in tmp_path.rglob("*.json"))
    assert read() == [(i, size) for i in range(40)] and plain > 40 * 2 * size
    G.write_page_results(page(range(40)), path)
    assert read() == [(i, size) for i in range(40)] and not list(tmp_path.rglob("*.json"))
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.json.gz")) < plain / 2
