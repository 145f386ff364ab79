"""Queries over whole pages, whose steps depend on order; tests compare them with hand-made pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import page_geometry as G
from ..operators import translate as R
from ..sources import fixtures as X
from ..sources.scratch import written
from .catalog import Catalog
from .layout import built, stored

catalog = Catalog()
add = catalog.add


def graphics(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of every third span as graphics, two neighbours close enough to be one."""
    return X.spans(spark, d).filter((F.col("span") % 3 == 0) & (F.length("text") > 0)).select("doc_id", "page_num", "x0", "y0", "x1", F.col("y1").alias("y1"), F.lit(612.0).alias("page_width"))


def drawings(spark: SparkSession, d: str) -> DataFrame:
    """A rule under every line of text that ends in a full stop."""
    lines = X.layout_lines(spark, d).filter(F.col("text").endswith("."))
    return lines.select("doc_id", "page_num", "x0", F.col("y1").alias("y0"), (F.col("x0") + 260).alias("x1"), (F.col("y1") + 1).alias("y1"), "page_width", "page_height")


@add()
def t4_merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    return G.merged_blocks(L.reading_order(L.columns(stored(spark, d)))).drop("lines")


@add()
def g1_g2_graphic_regions(spark: SparkSession, d: str) -> DataFrame:
    return G.graphic_regions(graphics(spark, d))


@add()
def g3_rule_tables(spark: SparkSession, d: str) -> DataFrame:
    return G.table_rule_regions(drawings(spark, d))


@add()
def g4_aligned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables told by the alignment of their texts: the first letters of every line as a cell of a grid three cells wide."""
    at = F.col("line") % 40
    x0, y0 = 60.0 + 180.0 * (at % 3), 200.0 + 20.0 * F.floor(at / 3)
    cells = X.layout_lines(spark, d).filter(F.trim("text") != "").withColumns({"text": F.substring("text", 1, 12), "x0": x0, "y0": y0, "x1": x0 + 100.0, "y1": y0 + 9.0, "font_size": F.lit(10.0)})
    one = F.struct("text", "x0", "y0", "x1", "y1", "font_size")
    return G.alignment_regions(L.flagged(cells.withColumn("lines", F.array(one)).withColumnRenamed("line", "seq")))


@add()
def g5_u6_chart_text(spark: SparkSession, d: str) -> DataFrame:
    small = built(spark, d).withColumn("font_size", F.lit(6.5))
    return G.chart_text(small, G.graphic_regions(graphics(spark, d)).withColumn("page_width", F.lit(612.0)))


@add()
def g6_page_layout(spark: SparkSession, d: str) -> DataFrame:
    return G.page_layout(stored(spark, d), graphics(spark, d), drawings(spark, d)).drop("lines")


@add()
def p15_output_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Translated blocks chosen for output and merged again."""
    b = built(spark, d)
    # chosen once, before the blocks are stored: columns, order and merging read them again and again
    kept = written(b.filter(~F.col("is_formula") & ~F.col("is_header_footer")).filter(R.translatable(b)), "blocks", codec="zstd")
    kept = kept.withColumn("translated", F.concat(F.lit("[zh: "), "text", F.lit("]")))
    return G.merged_blocks(L.reading_order(L.columns(kept))).drop("lines")
