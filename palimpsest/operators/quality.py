"""Audit of translated blocks: expectations, warnings, page and task reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE_RATIO = 2.2
INFO = ["unexpected_line_break", "length_ratio_high"]
UNTRANSLATED_ROLES = ["metadata", "dense_reference", "vertical_text"]
WARNING = "struct<code:string,severity:string,count:int,marker:string,tokens:array<string>,ratio:double>"


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def expected(df: DataFrame) -> Column:
    """Blocks the audit expects to be translated. Columns that ``df`` lacks count as false or body."""
    out = (F.col("type") == "text") if "type" in df.columns else F.lit(True)
    for name in ("is_header_footer_metadata", "is_formula", "is_chart_text", "is_table_text"):
        out = out & ~flag(df, name)
    if "layout_role" in df.columns:
        out = out & ~F.coalesce(F.col("layout_role").isin(UNTRANSLATED_ROLES), F.lit(False))
    source = T.stripped(F.coalesce("text", F.lit("")))
    return out & (source != "") & ~T.is_numeric_like(source)


def warnings_of(df: DataFrame) -> Column:
    """Array of a block's warnings from columns text and translated, in the order glyphs, marker, numbers, line break, length."""
    source, out = F.coalesce("text", F.lit("")), F.coalesce("translated", F.lit(""))
    blank = T.stripped(out) == ""
    null = lambda kind: F.lit(None).cast(kind)

    def warning(code: str, count=None, marker=None, tokens=None, ratio=None) -> Column:
        severity = "info" if code in INFO else "warning"
        fields = [F.lit(code), F.lit(severity), null("int") if count is None else count, null("string") if marker is None else marker, null("array<string>") if tokens is None else tokens, null("double") if ratio is None else ratio]
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("code", "severity", "count", "marker", "tokens", "ratio"), strict=True)]).cast(WARNING)

    glyphs, marker = T.suspicious_count(out), T.leading_marker(source)
    a, b = F.length(T.compact(source)), F.length(T.compact(out))
    found = [
        F.when(glyphs > 0, warning("suspicious_glyphs", count=glyphs.cast("int"))),
        F.when((marker != "") & ~F.startswith(F.regexp_replace(out, "(?U)^\\s+", ""), marker), warning("missing_marker", marker=marker)),
    ]
    lost = T.let(T.lost_numbers(source, out), lambda tokens: F.when(F.size(tokens) > 0, warning("missing_numeric_symbol", tokens=tokens)))
    found += [
        lost,
        F.when(T.stripped(out).contains("\n"), warning("unexpected_line_break")),
        F.when((a >= 30) & (b > a * 4.0) & ~T.ends_with_stop(source), warning("length_ratio_high", ratio=F.round(b / F.greatest(a, F.lit(1)), 2))),
    ]
    none = F.array().cast(f"array<{WARNING}>")
    missing = F.when(expected(df), F.array(warning("missing_translation"))).otherwise(none)
    return F.when(blank, missing).otherwise(F.array_compact(F.array(*found)))


#: Every code that ``warnings_of`` gives; a block has each once at most.
CODES = ["missing_translation", "suspicious_glyphs", "missing_marker", "missing_numeric_symbol", "unexpected_line_break", "length_ratio_high"]


def page_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each page, with one for each code, from one look at each block; a page that expects translations and has none is blank."""
    w = df.withColumns({"_w": warnings_of(df), "_expected": expected(df), "_done": T.stripped(F.coalesce("translated", F.lit(""))) != ""})
    glyphs = F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["count"], F.lit(0)))
    codes = [F.count_if(F.array_contains("_codes", c)).alias(c) for c in CODES]
    out = w.withColumn("_codes", F.col("_w.code")).groupBy(*keys).agg(F.count("*").alias("blocks"), F.count_if("_expected").alias("expected_blocks"), F.count_if("_done").alias("translated_blocks"), F.sum(glyphs).alias("suspicious_count"), *codes)
    return out.withColumn("blank_page", (F.col("expected_blocks") > 0) & (F.col("translated_blocks") == 0))


def page_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and status of each page; a page that expects translations and has none gets a warning more."""
    counts = page_counts(df, keys)
    total = sum((F.col(c) for c in CODES), F.col("blank_page").cast("long"))
    rows = counts.select(*keys, "blocks", "expected_blocks", "translated_blocks", F.col("suspicious_count").alias("suspicious_glyphs"), "blank_page", total.alias("warnings"))
    return rows.withColumn("status", F.when(F.col("warnings") > 0, "warn").otherwise("ok"))


def warning_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each warning of each block."""
    # an outer explode: for an inner one Spark evaluates the array once more, in a filter
    return df.withColumn("_w", F.explode_outer(warnings_of(df))).filter("_w IS NOT NULL").select(*keys, F.col("_w.*"))


def report(df: DataFrame, task: list[str], page: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """One row a task: pages, warnings, counts by code as a map, status; ``sizes``: task, source_bytes, export_bytes."""
    pages = page_counts(df, task + page)
    out = pages.groupBy(*task).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in CODES], F.count_if("blank_page").alias("blank_translated_page"))
    over = F.lit(False)
    if sizes is not None:
        out = out.join(sizes, task, "left").withColumn("size_ratio", size_ratio())
        over = F.coalesce(F.col("size_ratio") > SIZE_RATIO, F.lit(False))
    found = {c: F.col(c) for c in sorted([*CODES, "blank_translated_page"])} | {"export_size_ratio_high": over.cast("long")}
    counts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("code"), n.alias("n")) for c, n in found.items()]), lambda x: x["n"] > 0))
    warnings = sum(found.values(), F.lit(0).cast("long"))
    return out.select(*task, "pages", warnings.alias("warnings"), counts.alias("warning_counts"), F.when(warnings > 0, "warn").otherwise("ok").alias("status"))


def size_ratio() -> Column:
    return F.round(F.col("export_bytes") / F.greatest("source_bytes", F.lit(1)), 3)


def with_size_warning(df: DataFrame) -> DataFrame:
    return df.withColumn("size_ratio", size_ratio()).withColumn("size_warning", F.col("export_bytes") / F.greatest("source_bytes", F.lit(1)) > SIZE_RATIO)


def missing_tokens(required: DataFrame, pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Required (page, token) pairs against page texts: rows for missing pages and missing tokens."""
    there = pages.select(*keys, F.col(text).alias("_text"), F.lit(True).alias("_page"))
    problem = F.when(F.col("_page").isNull(), "missing_page").when(~F.col("_text").contains(F.col("token")), "missing_token")
    return required.join(there, keys, "left").withColumn("problem", problem).filter("problem IS NOT NULL").drop("_text", "_page")
