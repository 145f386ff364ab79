"""The layout rules in the oracle's dialect: segments, blocks, flags, roles, columns."""

from __future__ import annotations

import re

from .translation import ENDS, FORMULA, STOP, n


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def ends(x: str) -> str:
    return f"regexp_matches(regexp_replace({norm(x)}, '[)\\]}}）】》”’\"'']+$', ''), '{ENDS}$')"


def words(x: str) -> str:
    return n("[A-Za-z0-9]+(?:[./:-][A-Za-z0-9]+)*", x)


def heading(x: str, width: str, font: str, block: str) -> str:
    return f"({norm(x)} <> '' AND {font} > 0 AND length({norm(x)}) <= 90 AND {words(norm(x))} <= 12 AND {width} <= {block} * 0.92::DOUBLE AND NOT {ends(x)})"


def d(x: float) -> str:
    return f"{x}::DOUBLE"


SEGMENTS = f"""SELECT doc_id, page_num, raw, line, sum(CASE WHEN pt IS NOT NULL AND pt <> '' AND t <> '' AND (
   y0 - py1 > greatest(greatest(pf, font_size) * {d(0.35)}, {d(3.2)}) OR (cin >= greatest(font_size * {d(0.7)}, {d(7.5)}) AND cin > pin + greatest(pf * {d(0.35)}, 3) AND pe)
   OR (pe AND pw <= bw * {d(0.76)} AND cin <= greatest(font_size * {d(0.3)}, 3)) OR ({words("pt")} <= 4 AND length(pt) <= 42 AND NOT pe AND x1 - x0 >= pw * {d(1.6)} AND cin <= pin + greatest(font_size * {d(0.35)}, 3))
   OR (pf >= font_size * {d(1.06)} AND {heading("pt", "pw", "pf", "bw")}) OR (regexp_matches(t, '^[A-Za-z]') AND NOT regexp_matches(t, '[0-9]') AND {heading("t", "x1 - x0", "font_size", "bw")} AND pw <= bw * {d(0.72)} AND NOT pe)
  ) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, raw ORDER BY line) AS segment FROM (SELECT *, {ends("pt")} AS pe, px1 - px0 AS pw, greatest(px0 - lft, 0) AS pin, greatest(x0 - lft, 0) AS cin FROM (
  SELECT *, {norm("text")} AS t, lag({norm("text")}) OVER w AS pt, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(font_size) OVER w AS pf, min(x0) OVER (PARTITION BY doc_id, page_num, raw) AS lft,
   greatest(max(x1) OVER (PARTITION BY doc_id, page_num, raw) - min(x0) OVER (PARTITION BY doc_id, page_num, raw), 1) AS bw FROM layout_lines WINDOW w AS (PARTITION BY doc_id, page_num, raw ORDER BY line)))"""


def lum(x: str) -> str:
    ch = lambda s: f"(CASE WHEN (({x} >> {s}) & 255) / 255::DOUBLE <= {d(0.03928)} THEN (({x} >> {s}) & 255) / 255::DOUBLE / {d(12.92)} ELSE pow(((({x} >> {s}) & 255) / 255::DOUBLE + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END)"
    return f"({ch(16)} * {d(0.2126)} + {ch(8)} * {d(0.7152)} + {ch(0)} * {d(0.0722)})"


def doubles(sql: str) -> str:
    """Decimal numbers of the rules as doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w:.])", r"\1::DOUBLE", sql)


def dense(text: str) -> str:
    return f"regexp_replace({text}, '\\s', '', 'g')"


def blocks_of(lines: str = "layout_lines") -> str:
    """Blocks of the segments of a table of lines, with what the rules ask of a block's lines."""
    t = norm("text")
    return f"""SELECT doc_id, page_num, raw, segment, min(line) AS seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(font_size) AS font_size, string_agg(glue || t, '' ORDER BY line) AS text, count(*) FILTER (t <> '') AS n,
  count(*) FILTER (t <> '' AND length(t) <= 95) AS short95, count(*) FILTER (t <> '' AND length({dense("t")}) <= 3) AS short3, max((x0 + x1) / 2) FILTER (t <> '') - min((x0 + x1) / 2) FILTER (t <> '') AS mid_spread,
  max(x0) FILTER (t <> '') - min(x0) FILTER (t <> '') AS left_spread, list(font_size ORDER BY font_size) FILTER (t <> '' AND font_size > 0) AS sizes
 FROM (SELECT *, CASE WHEN t = '' OR pt IS NULL OR (regexp_matches(pt, '[A-Za-z0-9][-‐‑‒–]$') AND regexp_matches(t, '^[a-z0-9]')) THEN '' ELSE ' ' END AS glue FROM (
  SELECT *, lag(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, page_num, raw, segment ORDER BY line) AS pt FROM (
   SELECT l.*, {t} AS t, segment FROM {lines} l JOIN ({SEGMENTS.replace("layout_lines", lines)}) s USING (doc_id, page_num, raw, line)))) GROUP BY doc_id, page_num, raw, segment HAVING bool_or(t <> '')"""


URL = "regexp_matches(l, 'www\\.|http://|https://|\\.org|\\.com|\\.edu')"
EMAIL = "(contains(t, '@') AND contains(t, '.'))"
IMPRINT = "regexp_matches(l, '\\b(?:issn|doi|vol\\.?|volume|issue|copyright)\\b')"
CONTACT = "regexp_matches(l, '\\b(?:corresponding author|e-?mail|email)\\b')"
MIDWAY = "regexp_matches(t, '[.!?;:]\\s+[A-Z]')"


def low_small(extra: str) -> str:
    return f"(y0 >= 792 * 0.72 AND font_size <= 8.5 AND n <= 5 AND length(t) <= 320 AND ({URL} OR {EMAIL} OR contains(l, 'open access') OR contains(l, 'article is online') OR {extra}))"


TOP, BOTTOM = "(y0 <= greatest(792 * 0.08, 36))", "(y1 >= 792 - greatest(792 * 0.08, 42))"
PAGE_LABEL = "regexp_matches(trim(l), '^(page\\s*)?\\d{1,4}$')"
SENTENCE = f"({MIDWAY} OR (regexp_matches(t, '[.?!]$') AND length(t) > 70))"
PLACES = "(abs((x0 + x1) / 2 - 612 / 2) <= 612 * 0.12 OR x0 <= 612 * 0.16 OR x1 >= 612 * 0.84"
HEADER_FOOTER = f"""(NOT is_formula AND NOT empty AND t <> '' AND (
  ({BOTTOM} AND (contains(l, 'published by') OR contains(t, '©') OR contains(l, '(c)') OR {IMPRINT} OR ({URL} AND regexp_matches(t, '\\b\\d{{1,3}}\\s*:\\s*\\d{{2,6}}(?:\\s*[-–—]\\s*\\d{{2,6}})?\\b'))))
  OR {low_small(f"{CONTACT} OR {IMPRINT}")}
  OR (({TOP} OR {BOTTOM}) AND n BETWEEN 1 AND 4 AND length(t) <= 120 AND font_size <= 14 AND NOT ({TOP} AND page_num = 0 AND NOT {PAGE_LABEL}) AND (
   {URL} OR {EMAIL} OR {IMPRINT} OR regexp_matches(c, '^\\p{{Nd}}{{1,6}}$')
   OR ({BOTTOM} AND ((n <= 3 AND tokens <= 10 AND c <> '' AND digits >= greatest(3, length(c) // 3)) OR ({PLACES} OR (x1 - x0) / 612 <= 0.55) AND n <= 3 AND tokens <= 8 AND NOT {SENTENCE})))
   OR ({TOP} AND ({PAGE_LABEL} OR ({PLACES}) AND (x1 - x0) / 612 <= 0.42 AND font_size <= 11.5 AND n <= 2 AND tokens <= 10 AND length(t) <= 70 AND NOT {SENTENCE})))))))"""
ATTRIBUTION = f"""(page_num = 0 AND t <> '' AND NOT empty AND y0 >= 792 * 0.68 AND n BETWEEN 1 AND 4 AND font_size <= 30 AND names <= 24 AND length(t) <= 180
  AND ((x1 - x0) / 612 <= 0.70 OR abs((x0 + x1) / 2 - 612 / 2) <= 612 * 0.28) AND NOT {ends("t")} AND NOT {MIDWAY} AND (
   regexp_matches(t, '(?:^|[^\\w.])@[A-Za-z0-9_]{{2,30}}\\b') OR regexp_matches(t, '(?i)^(?:by|from|via)\\s+(?:@|[A-Z0-9])') OR (len(string_split(t, '+')) > 2 AND names <= 18)
   OR regexp_matches(l, '\\b(?:author|creator|maker|founder|co[- ]?founder|designer|illustrator|editor)\\b') OR regexp_matches(l, '\\b(?:made|built|written|created|designed)\\s+by\\b')))"""
SHORT = "(length(c) <= 32 AND n <= 2 AND (x1 - x0) / 612 <= 0.28)"
PUBLICATION = f"""(t <> '' AND NOT empty AND (regexp_matches(l, 'doi:|copyright|all rights reserved|macmillan publishers|©|^\\(c\\)') OR (y1 >= 792 * 0.94 AND font_size <= 7.5 AND n <= 4)
  OR (y1 >= 792 * 0.94 AND regexp_matches(l, '\\b(?:nature|science|cell|volume|vol)\\b') AND length(t) <= 120)
  OR {low_small(f"regexp_matches(l, '\\b(?:issn|doi|vol\\.?|volume|issue|copyright|published|publisher|license)\\b') OR {CONTACT}")}
  OR (y0 <= 792 * 0.09 AND {SHORT} AND letters > 0 AND uppers / greatest(letters, 1) >= 0.72) OR (y0 <= 792 * 0.09 AND (x0 <= 612 * 0.12 OR x1 >= 612 * 0.86) AND {SHORT} AND font_size <= 16)))"""
DENSE = f"""(t <> '' AND NOT empty AND n >= 12 AND font_size <= 7.4 AND (((y1 - y0) / 792 >= 0.22 AND n >= 20)
  OR (short95 >= n * 0.75 AND seps / greatest({n("[A-Za-z][A-Za-z.\\''-]*", "t")}, 1) >= 0.18) OR (n >= 16 AND {n("\\p{Nd}", "t")} >= n AND seps >= n // 2)))"""
SIDE = "((x0 + x1) / 2 <= 612 * 0.14 OR (x0 + x1) / 2 >= 612 * 0.86)"
VERTICAL = f"""(y1 - y0 >= greatest((x1 - x0) * 2.2, 28) AND (x1 - x0) / 612 <= 0.16 AND ((n >= 2 AND short3 >= greatest(2, n // 2) AND length(c) <= greatest(24, n * 4))
  OR ({SIDE} AND n = 1 AND length(c) <= 80 AND y1 - y0 >= greatest((x1 - x0) * 6, 80))))"""


def flags_of(blocks: str) -> str:
    """Flags and role of each of the blocks."""
    counts = f"""SELECT *, {norm("text")} AS t, lower({norm("text")}) AS l, {dense("text")} AS c, x1 <= x0 OR y1 <= y0 AS empty, {FORMULA} AS is_formula FROM {blocks}"""
    counts = f"""SELECT *, {n("\\p{Nd}")} AS digits, {n("\\p{L}")} AS letters, {n("\\p{Lu}")} AS uppers, {n("[,;|]", "t")} AS seps, {n("[A-Za-z0-9][A-Za-z0-9./:@_-]*", "t")} AS tokens, {n("[A-Za-z0-9][A-Za-z0-9.''@_-]*", "t")} AS names FROM ({counts})"""
    return doubles(f"""SELECT *, CASE WHEN empty THEN 'body' WHEN {PUBLICATION} OR is_attribution THEN 'metadata' WHEN {DENSE} THEN 'dense_reference' WHEN {VERTICAL} THEN 'vertical_text'
  WHEN {SIDE} AND (x1 - x0) / 612 <= 0.18 AND (y1 - y0) / 792 >= 0.015 THEN 'marginalia' ELSE 'body' END AS own_role FROM (SELECT *, {HEADER_FOOTER} AS is_header_footer, {ATTRIBUTION} AS is_attribution FROM ({counts}))""")


#: Roles once pages that are mostly bibliography have taken their small blocks.
SETTLED = doubles("""SELECT *, CASE WHEN (coalesce(area / (612 * 792) >= 0.18, FALSE) OR coalesce(many >= 40, FALSE)) AND own_role NOT IN ('metadata', 'dense_reference') AND t <> '' AND NOT empty AND font_size <= 7.4 AND (n <= 8 OR (y1 - y0) / 792 <= 0.16)
  THEN 'dense_reference' ELSE own_role END AS layout_role FROM (SELECT *, sum((x1 - x0) * (y1 - y0)) FILTER (own_role = 'dense_reference' AND NOT empty) OVER p AS area, sum(n) FILTER (own_role = 'dense_reference') OVER p AS many FROM flagged WINDOW p AS (PARTITION BY doc_id, page_num))""")
BUILT = f", own AS ({blocks_of()}), flagged AS ({flags_of('own')}), built AS ({SETTLED})"
ALIGN = doubles("""CASE WHEN x1 <= x0 THEN 'left' WHEN layout_role = 'body' AND n = 1 THEN 'left' WHEN n > 1 AND length(t) > 80 THEN 'left' WHEN n > 1 AND mid_spread <= sizes[len(sizes) // 2 + 1] * 0.8 AND abs((x0 + x1) / 2 - 612 / 2) <= 612 * 0.1 THEN 'center'
 WHEN n > 1 AND left_spread <= sizes[len(sizes) // 2 + 1] * 0.8 THEN 'left' WHEN abs((x0 + x1) / 2 - 612 / 2) <= 612 * 0.08 AND abs(greatest(x0, 0) - greatest(612 - x1, 0)) <= 612 * 0.18 AND x1 - x0 <= 612 * 0.85 THEN 'center'
 WHEN greatest(612 - x1, 0) <= 612 * 0.08 AND greatest(x0, 0) > greatest(612 - x1, 0) * 2.5 AND x1 - x0 <= 612 * 0.75 THEN 'right' ELSE 'left' END""")
SYMBOLS = "regexp_extract(t, '^((?:[\\p{So}\\x{10000}-\\x{10FFFF}•·●◆■]\\x{FE0F}?\\s*)+)(.*)$', 1)"
REST = f"substr(t, 1 + length({SYMBOLS}))"
HEADINGS = doubles(f"""{SYMBOLS} <> '' AND n <= 2 AND length({REST}) <= 60 AND NOT (regexp_matches({REST}, '[.。!?！？:：;；]') AND length({REST}) > 20) AND font_size >= 10 AS marker_heading,
 layout_role = 'body' AND t <> '' AND n <= 2 AND font_size >= 14 AND length({dense("t")}) <= 90 AND (regexp_matches(regexp_replace(t, '[•·●◆■]', '', 'g'), '[\\p{{So}}\\x{{10000}}-\\x{{10FFFF}}]') OR (font_size >= 16 AND {n("[\\p{L}\\p{N}_]+", "t")} <= 10 AND NOT {STOP.replace("text", "t")})) AS compact_heading""")
#: Columns of the built blocks.
COLUMNS = doubles("""SELECT b.*, CASE WHEN is_body AND splits IS NOT NULL THEN CASE WHEN x1 - x0 >= 612 * 0.68 OR len(list_filter(splits, lambda p: x0 < p AND p < x1)) > 0 THEN -1 ELSE len(list_filter(splits, lambda p: (x0 + x1) / 2 > p)) END END AS layout_column
 FROM (SELECT *, layout_role = 'body' AND NOT is_header_footer AND NOT is_formula AND NOT empty AS is_body FROM built) b LEFT JOIN (
  SELECT doc_id, page_num, list((b1 + nxt) / 2 ORDER BY b0) FILTER (nxt IS NOT NULL) AS splits FROM (
   SELECT *, lead(b0) OVER (PARTITION BY doc_id, page_num ORDER BY b0, cluster) AS nxt FROM (
    SELECT doc_id, page_num, cluster, min(x0) AS b0, max(x1) AS b1 FROM (SELECT *, sum(CASE WHEN mid - before > gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num ORDER BY mid, seq) AS cluster FROM (
     SELECT *, lag(mid) OVER (PARTITION BY doc_id, page_num ORDER BY mid, seq) AS before FROM (SELECT *, (x0 + x1) / 2 AS mid FROM built WHERE layout_role = 'body' AND NOT is_header_footer AND NOT is_formula AND NOT empty AND x1 - x0 < 612 * 0.68)
     JOIN (SELECT doc_id, page_num, greatest(612 * 0.10, list_sort(list(greatest(x1 - x0, 1)))[count(*) // 2 + 1] * 0.45, 28) AS gap FROM built WHERE layout_role = 'body' AND NOT is_header_footer AND NOT is_formula AND NOT empty AND x1 - x0 < 612 * 0.68 GROUP BY ALL HAVING count(*) >= 4) USING (doc_id, page_num)))
    GROUP BY ALL HAVING count(*) >= 2)) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4 AND NOT coalesce(bool_or(b1 > nxt + 612 * 0.08), FALSE)) s ON s.doc_id = b.doc_id AND s.page_num = b.page_num""")
KIND = "CASE WHEN is_header_footer THEN 4 WHEN layout_role = 'vertical_text' THEN 2 WHEN layout_role = 'marginalia' THEN 3 WHEN layout_role <> 'body' THEN 5 WHEN coalesce(layout_column, -1) = -1 THEN 0 ELSE 1 END"
RANK = f"row_number() OVER (PARTITION BY doc_id, page_num ORDER BY {KIND}, CASE WHEN {KIND} = 1 THEN layout_column ELSE 0 END, y0, x0, seq)"
#: A chart's label, of a block with width and height, ``t``, ``c``, its font ``f`` and counts of words, digits, letters and capitals.
LABEL = doubles("""t <> '' AND ((f <= 9 AND regexp_matches(c, '^[A-Za-z]$')) OR (f <= 6.1 AND length(t) <= 8 AND g >= 1) OR (f <= 6.3 AND w >= 10 AND h <= 28) OR (f <= 6.8 AND w <= 8)
  OR (f <= 6.8 AND g >= greatest(2, l // 2)) OR (f <= 6.8 AND u::DOUBLE / greatest(l, 1) >= 0.55 AND w <= 10) OR (f <= 7.2 AND h > (x1 - x0) * 1.8 AND length(t) <= 90))""")
