"""Queries over page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources import fixtures as X
from ..sources.scratch import written
from .catalog import Catalog
from .layout_sql import ALIGN, BUILT, COLUMNS, HEADINGS, LABEL, RANK, SEGMENTS, SETTLED, blocks_of, d, ends, flags_of, heading, lum, n, norm, words

catalog = Catalog()
add = catalog.add
RAW = ["doc_id", "page_num", "raw"]


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return L.segments(X.layout_lines(spark, d), RAW, "line")


def built(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Blocks with flags and roles, of ``lines`` or of all lines."""
    given = X.layout_lines(spark, d) if lines is None else lines
    # lines are dealt by page once, for segments, blocks and what asks for whole pages; the number keeps partitions as even as they are
    dealt = given.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *L.PAGE)
    b = L.blocks_from_lines(L.segments(dealt, RAW, "line"), [*RAW, "segment"], "line")
    b = b.withColumns({"seq": F.element_at("lines", 1)["n"], "page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    return L.dense_pages(L.flagged(b))


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The same as a table, for what reads them several times: columns, order and merging."""
    return written(built(spark, d), "blocks", codec="zstd")


@add(SEGMENTS, "layout_lines")
def w3_segments(spark: SparkSession, d: str) -> DataFrame:
    return segmented(spark, d).select(*RAW, "line", "segment")


@add(
    f"SELECT l.doc_id, l.page_num, l.raw, segment, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(font_size) AS font_size FROM layout_lines l JOIN ({SEGMENTS}) s USING (doc_id, page_num, raw, line) GROUP BY ALL HAVING bool_or({norm('text')} <> '')",
    "layout_lines",
)
def a8_blocks_from_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.blocks_from_lines(segmented(spark, d), [*RAW, "segment"], "line").select(*RAW, "segment", "x0", "y0", "x1", "y1", "font_size")


@add("SELECT doc_id, page_num, raw, line, min(x0) AS x0, max(x1) AS x1, max(font_size) AS font_size, count(*) AS n_spans FROM spans WHERE NOT regexp_matches(trim(text), '^[/\\-–—•·|]?$') GROUP BY ALL", "spans")
def a7_lines_from_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every line again from its spans; p31 drops the decorative ones first."""
    s = X.spans(spark, d).filter(~L.is_decorative(F.col("text")))
    counts = s.groupBy(*RAW, "line").agg(F.count("*").alias("n_spans"))
    return L.lines_from_spans(s, [*RAW, "line"], "span").join(counts, [*RAW, "line"]).select(*RAW, "line", "x0", "x1", "font_size", "n_spans")


@add("SELECT doc_id, page_num, count(DISTINCT raw) AS raws, count(DISTINCT line) AS lines, count(*) AS spans FROM spans GROUP BY ALL", "spans")
def a21_structure_census(spark: SparkSession, d: str) -> DataFrame:
    return X.spans(spark, d).groupBy("doc_id", "page_num").agg(F.countDistinct("raw").alias("raws"), F.countDistinct("line").alias("lines"), F.count("*").alias("spans"))


@add("SELECT doc_id, line, span, text, x0, font, flags FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line, span) <= 5", "spans")
def t5_first_spans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    # a line has a span at least, so the first five spans are among the first five of the first five lines
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    lines = X.layout_lines(spark, d).withColumns({"text": F.substring_index("text", " ", 5), "rn": first}).filter("rn <= 5").drop("rn")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "span"))
    return X.spans_of(lines).withColumn("rn", rank).filter("rn <= 5").select("doc_id", "line", "span", "text", "x0", "font", "flags")


@add("SELECT doc_id, page_num, line, list_transform(string_split(text, ' '), lambda w: w) AS words FROM layout_lines", "layout_lines")
def s10_span_scan(spark: SparkSession, d: str) -> DataFrame:
    """Spans nested in lines, exploded to rows and put together again."""
    s = X.spans(spark, d, ("doc_id", "page_num", "line")).groupBy("doc_id", "page_num", "line").agg(F.array_sort(F.collect_list(F.struct("span", "text"))).alias("spans"))
    rows = s.select("doc_id", "page_num", "line", F.posexplode("spans").alias("at", "s")).select("doc_id", "page_num", "line", "at", "s.text")
    back = rows.groupBy("doc_id", "page_num", "line").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("w"))
    return back.select("doc_id", "page_num", "line", F.transform("w", lambda x: x["text"]).alias("words"))


@add(f"SELECT doc_id, page_num, line, {heading('text', 'x1 - x0', 'font_size', '220')} AS heading FROM layout_lines", "layout_lines")
def p2_heading_like(spark: SparkSession, d: str) -> DataFrame:
    return X.layout_lines(spark, d).select("doc_id", "page_num", "line", L.heading_like(F.col("text"), F.col("x1") - F.col("x0"), F.col("font_size"), F.lit(220.0)).alias("heading"))


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every line a block of its own, in several font sizes."""
    lines = X.layout_lines(spark, d).withColumn("font_size", 5.0 + F.col("line") % 5)
    one = F.struct("text", "x0", "y0", "x1", "y1", "font_size")
    return lines.withColumn("lines", F.array(one)).withColumnRenamed("line", "seq")


@add(
    f"""SELECT doc_id, page_num, seq, {LABEL} AS label
 FROM (SELECT *, {words("t")} AS w, {n("[0-9]")} AS g, {n("\\p{L}")} AS l, {n("\\p{Lu}")} AS u FROM (SELECT doc_id, page_num, line AS seq, {norm("text")} AS t, regexp_replace(text, '\\s', '', 'g') AS c, 5 + line % 5 AS f, y1 - y0 AS h, x0, x1 FROM layout_lines))""",
    "layout_lines",
)
def p9_chart_labels(spark: SparkSession, d: str) -> DataFrame:
    return line_blocks(spark, d).select("doc_id", "page_num", "seq", L.chart_label(False).alias("label"))


@add("SELECT doc_id, page_num, line, span, flags & 16 <> 0 OR contains(lower(font), 'bold') AS bold FROM spans", "spans")
def p30_bold_spans(spark: SparkSession, d: str) -> DataFrame:
    return X.spans(spark, d).select("doc_id", "page_num", "line", "span", L.is_bold(F.col("font"), F.col("flags")).alias("bold"))


@add("SELECT doc_id, page_num, line, span FROM spans WHERE NOT regexp_matches(trim(text), '^[/\\-–—•·|]?$')", "spans")
def p31_real_spans(spark: SparkSession, d: str) -> DataFrame:
    return X.spans(spark, d).filter(~L.is_decorative(F.col("text"))).select("doc_id", "page_num", "line", "span")


@add(
    f"""SELECT p_partkey, ratio, CASE WHEN ratio >= {d(1.6)} THEN a WHEN (0.05::DOUBLE + lb) / 0.05::DOUBLE >= 1.05::DOUBLE / (lb + 0.05::DOUBLE) THEN 0 ELSE 16777215 END AS readable
 FROM (SELECT *, (greatest(la, lb) + {d(0.05)}) / (least(la, lb) + {d(0.05)}) AS ratio FROM (SELECT *, {lum("a")} AS la, {lum("b")} AS lb FROM (SELECT p_partkey, CAST(p_partkey * 7919 % 16777216 AS INT) AS a, CAST(p_partkey * 7907 % 16777216 AS INT) AS b FROM part)))"""
)
def p32_contrast(spark: SparkSession, d: str) -> DataFrame:
    a, b = ((F.col("p_partkey") * k % 16777216).cast("int") for k in (7919, 7907))
    return X.table(spark, d, "part").select("p_partkey", L.contrast(a, b).alias("ratio"), L.readable(a, b).alias("readable"))


@add(
    """WITH k AS (SELECT * FROM spans WHERE trim(text) <> ''), col AS (SELECT doc_id, page_num, raw, color, sum(length(trim(text))) AS w, min(line * 10000 + span) AS place FROM k GROUP BY ALL),
 lead AS (SELECT doc_id, page_num, raw, arg_max(color, {'w': w, 'a': -place}) AS lead, arg_min(color, place) AS first, max(w)::DOUBLE / sum(w) AS share, count(*) AS n FROM col GROUP BY ALL)
 SELECT doc_id, page_num, raw, greatest(s[len(s) // 2 + 1], 6) AS font_size, bold AS is_bold, CASE WHEN n > 1 AND share < 0.75::DOUBLE THEN first ELSE lead END AS color FROM (SELECT doc_id, page_num, raw, list(font_size ORDER BY font_size) AS s, sum(CASE WHEN flags & 16 <> 0 OR contains(lower(font), 'bold') THEN length(trim(text)) ELSE 0 END)::DOUBLE / sum(length(trim(text))) >= 0.45::DOUBLE AS bold FROM k GROUP BY ALL) JOIN lead USING (doc_id, page_num, raw)""".replace(
        "WITH k AS", ", k AS", 1
    ),
    "spans",
)
def a9_block_styles(spark: SparkSession, d: str) -> DataFrame:
    s = X.spans(spark, d).withColumn("at", F.col("line") * 10000 + F.col("span"))
    return L.styles(s, RAW, "at")


@add(
    """SELECT doc_id, page_num, raw, coalesce(min(x0) FILTER (p1 IS NOT NULL AND length(pt) <= 8 AND p1 - p0 <= font_size * 3 AND x0 - p1 >= font_size * 0.9::DOUBLE), min(x0)) AS start_x FROM (
 SELECT *, lag(trim(text)) OVER w AS pt, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1 FROM (SELECT *, min(y0) OVER (PARTITION BY doc_id, page_num, raw) AS top FROM spans) q WHERE trim(text) <> '' AND y0 <= top + font_size * 0.35::DOUBLE WINDOW w AS (PARTITION BY doc_id, page_num, raw ORDER BY x0, x1)) GROUP BY ALL""",
    "spans",
)
def w11_label_starts(spark: SparkSession, d: str) -> DataFrame:
    return L.label_starts(X.spans(spark, d), RAW)


INDENT = """SELECT doc_id, page_num, raw, CASE WHEN n >= 2 AND ind >= greatest(f * 0.45::DOUBLE, 4) AND ind <= greatest(w, 1) * 0.22::DOUBLE THEN ind ELSE 0 END AS indent FROM (
 SELECT doc_id, page_num, raw, count(*) AS n, max(font_size) AS f, max(x1) - min(x0) AS w, min(x0) FILTER (rn = 1) - min(x0) FILTER (rn > 1) AS ind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, raw ORDER BY line) AS rn FROM layout_lines WHERE trim(text) <> '') GROUP BY ALL)"""


@add(INDENT, "layout_lines")
def w4_first_indent(spark: SparkSession, d: str) -> DataFrame:
    b = L.blocks_from_lines(X.layout_lines(spark, d), RAW, "line")
    return b.select(*RAW, F.col("first_line_indent").alias("indent"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """A made-up region on every page: the part of the first column from its fifth line to its fifteenth."""
    pages = X.layout_lines(spark, d).select("doc_id", "page_num").distinct()
    return pages.select("doc_id", "page_num", F.lit(60.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(190.0).alias("x1"), F.lit(121.0).alias("y1"), F.lit(612.0).alias("page_width"))


INSIDE = "greatest(least(x1, 190) - greatest(x0, 60), 0) * greatest(least(y1, 121) - greatest(y0, 50), 0)"


@add(
    f"SELECT doc_id, page_num, line AS seq FROM layout_lines WHERE x0 < 190 AND x1 > 60 AND y0 < 121 AND y1 > 50 AND ({INSIDE} / greatest((x1 - x0) * (y1 - y0), 1) >= {d(0.35)} OR (x0 >= 60 AND x0 < 190 AND y0 >= 50 AND y0 < 121) OR (x1 >= 60 AND x1 < 190 AND y1 >= 50 AND y1 < 121))",
    "layout_lines",
)
def j11_in_tables(spark: SparkSession, d: str) -> DataFrame:
    lines = X.layout_lines(spark, d).withColumnRenamed("line", "seq")
    return L.in_tables(lines, regions(spark, d))


@add(f"SELECT doc_id, page_num, line AS seq, {INSIDE} / greatest((x1 - x0) * (y1 - y0), 1) AS share FROM layout_lines WHERE {INSIDE} / greatest((x1 - x0) * (y1 - y0), 1) >= {d(0.2)}", "layout_lines")
def j14_overlaps(spark: SparkSession, d: str) -> DataFrame:
    lines = X.layout_lines(spark, d).withColumnRenamed("line", "seq")
    share = L.overlap_share("b", "r")
    joined = lines.alias("b").join(regions(spark, d).alias("r"), L.same_page("b", "r") & (share >= 0.2))
    return joined.select("b.doc_id", "b.page_num", "b.seq", share.alias("share"))


@add(
    """SELECT b.doc_id, b.page_num, b.line AS seq, least(774, coalesce(min_by(n.y0, n.line) - 4, 792)) AS bottom_limit FROM layout_lines b LEFT JOIN layout_lines n ON n.doc_id = b.doc_id AND n.page_num = b.page_num AND n.line > b.line AND n.y0 > b.y0 + 1
 AND ((n.x1 >= b.x0 - 12 AND n.x0 <= b.x1 + 12) OR abs(n.x0 - b.x0) < 80) GROUP BY b.doc_id, b.page_num, b.line""",
    "layout_lines",
)
def j15_room_below(spark: SparkSession, d: str) -> DataFrame:
    return L.room_below(X.layout_lines(spark, d).withColumnRenamed("line", "seq"))


@add(f"{BUILT} SELECT doc_id, page_num, seq, is_formula, is_header_footer, is_attribution, layout_role FROM built", "layout_lines")
def p4_p8_roles(spark: SparkSession, d: str) -> DataFrame:
    """Flags and roles of the blocks that the segments make."""
    return built(spark, d).select("doc_id", "page_num", "seq", "is_formula", "is_header_footer", "is_attribution", "layout_role")


@add(f"{BUILT} SELECT doc_id, page_num, seq, {ALIGN} AS align FROM built", "layout_lines")
def p29_alignment(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).select("doc_id", "page_num", "seq", L.alignment().alias("align"))


@add(
    f"{BUILT} SELECT doc_id, page_num, seq, {HEADINGS} FROM (SELECT doc_id, page_num, seq, n, layout_role, font_size + CASE WHEN seq % 3 = 0 THEN 6 ELSE 0 END AS font_size, concat(CASE WHEN seq % 4 = 0 THEN '☀ ■ ' ELSE '' END, t) AS t FROM built)",
    "layout_lines",
)
def p10_p17_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth block behind symbols, every third in larger type."""
    b = built(spark, d).withColumns({"text": F.concat(F.when(F.col("seq") % 4 == 0, "☀ ■ ").otherwise(""), "text"), "font_size": F.col("font_size") + F.when(F.col("seq") % 3 == 0, 6.0).otherwise(0.0)})
    return b.select("doc_id", "page_num", "seq", L.marker_heading().alias("marker_heading"), L.compact_heading().alias("compact_heading"))


#: By seq % 12: a word before the line's text, left and right edge, top, height, font. No edge: the line's own.
KINDS = [
    ("", 300, 312, 770, 12, 9), ("", 40, 200, 10, 10, 9), ("© 2020 doi:10.1/x ", 72, 292, 765, 10, 8), ("Contact a@b.org ", 72, 292, 600, 10, 8), ("Designed by ", 226, 386, 600, 12, 11), ("via Ada + Bob + Cyd ", 226, 386, 560, 12, 11),
    ("A., B; ", 72, 292, 100, 200, 7), ("", 20, 30, 300, 40, 9), ("", 590, 600, 300, 120, 9), ("", 10, 80, 300, 20, 9), ("", 500, 590, 40, 10, 12), ("x = 1+", 400, 590, 300, 20, 7),
]


def varied(spark: SparkSession, d: str) -> DataFrame:
    """Every line a block of up to twenty like lines, placed and worded so that each flag, role and alignment occurs."""
    k, seq = F.col("line") % 12, F.col("line")
    rows = X.layout_lines(spark, d).filter(F.trim("text") != "").withColumn("kind", F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("word", "x0", "x1", "y0", "h", "font"), one, strict=True)]) for one in KINDS]), (k + 1).cast("int")))
    text = F.when(k == 0, seq.cast("string")).when(k == 7, "ab c").when(k.isin(8, 9), F.substring("text", 1, 40)).when(k == 10, F.upper(F.substring("text", 1, 12))).otherwise(F.concat("kind.word", "text"))
    box = {"x0": "kind.x0", "x1": "kind.x1", "y0": "kind.y0", "font_size": "kind.font"}
    rows = rows.select("doc_id", "page_num", seq.alias("seq"), text.alias("text"), "page_width", "page_height", *[F.col(v).cast("double").alias(n) for n, v in box.items()], (F.col("kind.y0") + F.col("kind.h")).cast("double").alias("y1"), k.alias("k"))
    lines = F.when(F.col("k") == 6, 20).when(F.col("k") == 7, 4).when(F.col("k") == 8, 1).otherwise(1 + F.col("seq") % 3)
    # lines move to the right, or on every second block shrink from both sides
    step = (F.col("seq") % 4 * 3).cast("double")
    one = lambda i: F.struct(F.when(F.col("k") == 7, "ab").otherwise(F.col("text")).alias("text"), (F.col("x0") + i * step).alias("x0"), "y0", (F.col("x1") + i * F.when(F.col("seq") % 2 == 0, step).otherwise(-step)).alias("x1"), "y1", "font_size")
    return rows.withColumn("lines", F.transform(F.sequence(F.lit(0), (lines - 1).cast("int")), one))


VARIED = f"""SELECT *, CASE WHEN length({norm("own")}) <= 95 THEN n ELSE 0 END AS short95, CASE WHEN length(regexp_replace(own, '\\s', '', 'g')) <= 3 THEN n ELSE 0 END AS short3, left_spread * CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS mid_spread, list_value(font_size) AS sizes FROM (
 SELECT *, CASE WHEN k = 7 THEN 'ab' ELSE text END AS own, (n - 1) * (seq % 4 * 3) AS left_spread FROM (SELECT doc_id, page_num, line AS seq, line % 12 AS k, CASE line % 12 WHEN 6 THEN 20 WHEN 7 THEN 4 WHEN 8 THEN 1 ELSE 1 + line % 3 END AS n, b.x0::DOUBLE AS x0, b.x1::DOUBLE AS x1, b.y0::DOUBLE AS y0, (b.y0 + b.h)::DOUBLE AS y1, b.font::DOUBLE AS font_size,
  CASE line % 12 WHEN 0 THEN CAST(line AS VARCHAR) WHEN 7 THEN 'ab c' WHEN 8 THEN substr(text, 1, 40) WHEN 9 THEN substr(text, 1, 40) WHEN 10 THEN upper(substr(text, 1, 12)) ELSE concat(b.word, text) END AS text
  FROM layout_lines JOIN (VALUES {", ".join(f"({i}, '{w}', {x0}, {x1}, {y0}, {h}, {f})" for i, (w, x0, x1, y0, h, f) in enumerate(KINDS))}) b(kind, word, x0, x1, y0, h, font) ON b.kind = line % 12 WHERE trim(layout_lines.text) <> ''))"""


@add(f", own AS ({VARIED}), flagged AS ({flags_of('own')}), built AS ({SETTLED}) SELECT doc_id, page_num, seq, is_formula, is_header_footer, is_attribution, own_role, layout_role, {ALIGN} AS align FROM built", "layout_lines")
def p4_p8_p29_every_role(spark: SparkSession, d: str) -> DataFrame:
    """Flags, roles before and after a page is found to be bibliography, and alignment, where all of them occur."""
    own = L.flagged(varied(spark, d)).withColumn("own_role", F.col("layout_role"))
    return L.dense_pages(own).select("doc_id", "page_num", "seq", "is_formula", "is_header_footer", "is_attribution", "own_role", "layout_role", L.alignment().alias("align"))


@add(f"{BUILT}, columned AS ({COLUMNS}) SELECT doc_id, page_num, seq, layout_column, {RANK} AS rank FROM columned", "layout_lines")
def w5_w6_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(L.columns(stored(spark, d))).select("doc_id", "page_num", "seq", "layout_column", "rank")


@add(
    f""", own AS (SELECT doc_id, page_num, line AS seq, text, x0, y0, x1, y1, (5 + line % 5)::DOUBLE AS font_size, CASE WHEN {norm("text")} <> '' THEN 1 ELSE 0 END AS n, 1 AS short95, 0 AS short3 FROM layout_lines), flagged AS ({flags_of("own")})
 SELECT doc_id, page_num, seq FROM (SELECT * EXCLUDE (l), font_size AS f, digits AS g, letters AS l, uppers AS u, y1 - y0 AS h, {words("t")} AS w FROM flagged) WHERE NOT is_formula AND NOT is_header_footer AND NOT empty AND x0 < 196 AND x1 > 54 AND y0 < 206 AND y1 > 44 AND (({LABEL}) OR (font_size <= {d(7.2)} AND y0 >= {d(117.5)} AND length(t) <= 220))""",
    "layout_lines",
)
def j12_chart_seeds(spark: SparkSession, d: str) -> DataFrame:
    graphics = regions(spark, d).withColumn("y1", F.lit(200.0))
    return L.chart_seeds(L.flagged(line_blocks(spark, d)), graphics)


@add(
    f""", headed AS (SELECT doc_id, page_num, raw, line, text, x0, y0, x1, y1, font_size FROM layout_lines UNION ALL SELECT DISTINCT doc_id, page_num, 2, 9998, CASE WHEN page_num = 0 THEN 'Page 1' ELSE 'Results overview' END, 72, 8, 172, 18, 10 FROM layout_lines), own AS ({blocks_of("headed")}), flagged AS ({flags_of("own")})
 SELECT doc_id, page_num, seq FROM flagged h WHERE is_header_footer AND NOT is_formula AND n = 1 AND length(t) <= 90 AND {words("t")} <= 12 AND NOT {ends("t")} AND font_size > 0 AND EXISTS (SELECT 1 FROM flagged o WHERE o.doc_id = h.doc_id AND o.page_num = h.page_num AND o.seq <> h.seq AND NOT o.is_formula AND NOT o.empty
  AND abs(o.x0 - h.x0) <= greatest(h.font_size * {d(0.8)}, 10) AND least(h.x1, o.x1) - greatest(h.x0, o.x0) >= greatest(h.x1 - h.x0, 1) * {d(0.45)} AND o.y0 - h.y1 BETWEEN -1 AND greatest(h.font_size * {d(1.2)}, 16))""",
    "layout_lines",
)
def j13_rescued_headers(spark: SparkSession, d: str) -> DataFrame:
    """Heads of pages that are headings of what is right below; every page gets a short line above its first column."""
    lines = X.layout_lines(spark, d)
    head = F.when(F.col("page_num") == 0, "Page 1").otherwise("Results overview")
    added = lines.dropDuplicates(["doc_id", "page_num"]).withColumns({"raw": F.lit(2), "line": F.lit(9998), "text": head, "x0": F.lit(72.0), "x1": F.lit(172.0), "y0": F.lit(8.0), "y1": F.lit(18.0), "font_size": F.lit(10.0)})
    return L.rescued_headers(written(built(spark, d, lines.unionByName(added)), "blocks"))


@add(
    f""", b AS (SELECT l.doc_id, l.page_num, l.raw, segment, min(line) AS seq, min(x0) AS b0, max(x1) AS b1, min(y0) AS t0, max(y1) AS t1, max(font_size) AS f, arg_min(y0, line) FILTER ({norm("text")} <> '') AS l0, arg_min(y1, line) FILTER ({norm("text")} <> '') AS l1
  FROM layout_lines l JOIN ({SEGMENTS}) s USING (doc_id, page_num, raw, line) GROUP BY l.doc_id, l.page_num, l.raw, segment HAVING bool_or({norm("text")} <> ''))
 SELECT i.doc_id, i.page_num, concat(i.line, ':', i.span) AS image, b.seq FROM spans i JOIN b ON i.doc_id = b.doc_id AND i.page_num = b.page_num AND b1 > b0 AND t1 > t0 AND l1 > l0
  AND b0 - greatest(f * {d(1.2)}, 8) < i.x1 AND i.x0 < b1 + greatest(f * {d(1.2)}, 8) AND l0 - greatest(f * {d(0.45)}, 4) < i.y1 AND i.y0 < l1 + greatest(f * {d(0.45)}, 4)
  AND least(i.x1 - i.x0, i.y1 - i.y0) >= greatest(f * {d(0.35)}, 5) AND greatest(i.x1 - i.x0, i.y1 - i.y0) <= greatest(f * {d(3.8)}, 54) AND (i.x0 + i.x1) / 2 BETWEEN b0 - greatest(f, 8) AND b1 + greatest(f, 8) WHERE i.span % 9 = 0 AND length(i.text) > 1""",
    "spans",
)
def j16_inline_graphics(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth span's box as a small image, against the blocks' first lines."""
    images = X.spans(spark, d).filter((F.col("span") % 9 == 0) & (F.length("text") > 1)).select("doc_id", "page_num", F.concat_ws(":", "line", "span").alias("image"), "x0", "y0", "x1", "y1")
    return L.inline_graphics(images, built(spark, d))


@add(
    f""", credited AS (SELECT doc_id, page_num, raw, line, text, x0, y0, x1, y1, font_size FROM layout_lines UNION ALL SELECT doc_id, page_num, 2, 9999, 'Designed by Ada + Grace + Edsger', 200, 600, 400, 612, font_size FROM layout_lines WHERE line = 0 AND doc_id % 4 = 0), own AS ({blocks_of("credited")}), flagged AS ({flags_of("own")})
 SELECT doc_id, seq, text, own_role AS layout_role FROM flagged WHERE is_attribution AND page_num = 0""",
    "layout_lines",
)
def p16_attribution_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Credits on first pages, kept as they are; a credit line is added to the foot of every fourth document."""
    lines = X.layout_lines(spark, d)
    credit = lines.filter((F.col("line") == 0) & (F.col("doc_id") % 4 == 0)).withColumns({"raw": F.lit(2), "line": F.lit(9999), "text": F.lit("Designed by Ada + Grace + Edsger"), "x0": F.lit(200.0), "x1": F.lit(400.0), "y0": F.lit(600.0), "y1": F.lit(612.0)})
    b = L.blocks_from_lines(L.segments(lines.unionByName(credit), RAW, "line"), [*RAW, "segment"], "line")
    b = L.flagged(b.withColumns({"seq": F.element_at("lines", 1)["n"], "page_width": F.lit(612.0), "page_height": F.lit(792.0)}))
    return b.filter(F.col("is_attribution") & (F.col("page_num") == 0)).select("doc_id", "seq", "text", "layout_role")


@add(
    """SELECT doc_id, page_num, raw, line, string_agg(CASE WHEN pt IS NULL OR regexp_matches(t, '^[,.;:!?%)\\]}、。，；：！？）］｝]') OR regexp_matches(pt, '[(\\[{（［｛<>=≤≥≈∼~×÷±]$') OR (regexp_matches(pt, '[-‐‑‒–]$') AND regexp_matches(t, '^[\\p{L}\\p{N}]'))
  OR (regexp_matches(t, '^[<>=≤≥≈∼~×÷±]') AND (NOT regexp_matches(pt, '[\\p{L}\\p{N}]$') OR x0 - px1 <= greatest(greatest(pf, font_size, 1) * 0.35::DOUBLE, 2.5::DOUBLE))) THEN '' ELSE ' ' END || t, '' ORDER BY span) AS text
 FROM (SELECT *, lag(t) OVER w AS pt, lag(x1) OVER w AS px1, lag(font_size) OVER w AS pf FROM (SELECT *, trim(text) AS t FROM spans WHERE NOT regexp_matches(trim(text), '^[/\\-–—•·|]?$')) WINDOW w AS (PARTITION BY doc_id, page_num, raw, line ORDER BY span)) GROUP BY ALL""",
    "spans",
)
def f6_line_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of every line, put together again from its spans."""
    return L.lines_from_spans(X.spans(spark, d), [*RAW, "line"], "span").select(*RAW, "line", "text")


@add("SELECT doc_id, page_num, line AS seq, CASE WHEN sum(CASE WHEN line % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num) * 4 >= 40 AND line % 3 <> 0 AND line % 2 = 0 AND trim(text) <> '' AND length(text) > 0 THEN 'dense_reference' WHEN line % 3 = 0 THEN 'dense_reference' ELSE 'body' END AS role FROM layout_lines WHERE length(text) > 0", "layout_lines")
def a10_dense_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every third line counts as a dense reference of four lines; small lines of full pages follow them."""
    lines = line_blocks(spark, d).filter(F.length("text") > 0).withColumn("font_size", F.when(F.col("seq") % 2 == 0, 7.0).otherwise(9.0))
    dense = F.col("seq") % 3 == 0
    four = F.array_repeat(F.struct(F.lit("x").alias("text"), *[F.col(k) for k in ("x0", "y0", "x1", "y1", "font_size")]), 4)
    rows = lines.withColumn("lines", F.when(dense, four).otherwise(F.col("lines"))).withColumn("layout_role", F.when(dense, "dense_reference").otherwise("body"))
    # boxes too small for their area to count
    rows = rows.withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})
    return L.dense_pages(rows).select("doc_id", "page_num", "seq", F.col("layout_role").alias("role"))
