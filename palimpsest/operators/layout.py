"""Layout of pages: lines to segments to blocks, roles and flags, columns and reading order.

Blocks have doc_id, page_num, seq, text, x0, y0, x1, y1, font_size, page_width, page_height and
lines (array of struct text, x0, y0, x1, y1, font_size); flags that a table lacks count as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import written

PAGE = ["doc_id", "page_num"]
WORD = "[A-Za-z0-9]+(?:[./:-][A-Za-z0-9]+)*"
URLS = "www\\.|http://|https://|\\.org|\\.com|\\.edu"


def most(*xs) -> Column:
    return F.greatest(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def least(*xs) -> Column:
    return F.least(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def c(name: str) -> Column:
    return F.col(name)


def is_empty() -> Column:
    """A rectangle without area."""
    return (c("x1") <= c("x0")) | (c("y1") <= c("y0"))


def words_in(text: Column) -> Column:
    return T.count_of(text, WORD)


def heading_like(text: Column, width: Column, font: Column, block_width: Column) -> Column:
    """A short line that leaves room and does not end a sentence."""
    t = T.normalized(text)
    return (t != "") & few_words(t) & ~T.ends_sentence(t) & leaves_room(width, font, block_width)


def few_words(t: Column) -> Column:
    """Whether ``normalized`` text is as short as a heading; words are only counted where the text is."""
    return F.when(F.length(t) <= 90, words_in(t) <= 12).otherwise(False)


def leaves_room(width: Column, font: Column, block_width: Column) -> Column:
    return (font > 0) & (block_width > 0) & (width <= block_width * 0.92)


def line_count() -> Column:
    return F.size(F.filter("lines", lambda x: ~T.is_blank(x["text"])))


# Spans to lines, lines to segments, segments to blocks


def is_bold(font: Column, flags: Column) -> Column:
    return (F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(16)) != 0) | F.lower(F.coalesce(font, F.lit(""))).rlike("bold|black|heavy")


def is_decorative(text: Column) -> Column:
    """One rule, dash, bullet or bar, or nothing."""
    return F.trim(text).rlike("^[/\\-–—•·|]?$")


def lines_from_spans(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union box, largest font and text of each line; ``spans`` in ``order``."""
    kept = spans.filter(~is_decorative(c("text")))
    parts = F.array_sort(F.collect_list(F.struct(order, "text", "x0", "x1", "font_size", F.coalesce("is_marker", F.lit(False)).alias("is_marker") if "is_marker" in spans.columns else F.lit(False).alias("is_marker"))))
    out = kept.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), parts.alias("_s"))
    return out.withColumn("text", composed_line(c("_s"))).drop("_s")


def composed_line(spans: Column) -> Column:
    """Text of a line from its spans: a space between two unless punctuation, an operator, a hyphen or a marker sits tight."""
    math = "<>=≤≥≈∼~×÷±"

    def glued(p: Column, x: Column) -> Column:
        t, prev = x["t"], p["t"]
        gap, font = x["x0"] - p["x1"], most(p["font"], x["font"], 1.0)
        return (
            x["is_marker"]
            | t.rlike("^[,.;:!?%)\\]}、。，；：！？）］｝]")
            | prev.rlike(f"[(\\[{{（［｛{math}]$")
            | (t.rlike(f"^[{math}]") & (~prev.rlike("[\\p{L}\\p{N}]$") | (gap <= most(font * 0.35, 2.5))))
            | (prev.rlike("[-‐‑‒–]$") & t.rlike("^[\\p{L}\\p{N}]"))
        )

    # a span with text looks at the one before it only, so a line costs as much as it is long
    told = F.transform(spans, lambda x: F.struct(T.normalized(x["text"]).alias("t"), x["x0"].alias("x0"), x["x1"].cast("double").alias("x1"), x["font_size"].cast("double").alias("font"), x["is_marker"].alias("is_marker")))
    spaced = lambda p, x: F.when(p.isNull() | glued(p, x), x["t"]).otherwise(F.concat(F.lit(" "), x["t"]))
    parts = T.let(F.filter(told, lambda x: x["t"] != ""), lambda xs: F.transform(xs, lambda x, i: spaced(F.get(xs, i - 1), x)))
    return T.stripped(F.array_join(parts, ""))


def segments(lines: DataFrame, block: list[str], order: str) -> DataFrame:
    """``segment`` of each line: a block's lines cut where gap, indent, width, font or heading say so.

    Every rule looks at a line and the one before it only, so a lag and a running sum do.
    """
    whole, by = Window.partitionBy(*block), Window.partitionBy(*block).orderBy(order)
    left, width = F.min("x0").over(whole), most(F.max("x1").over(whole) - F.min("x0").over(whole), 1.0)
    # what the rules ask of a text, once for each line and before lines are dealt: the next line looks at it too
    asked = {
        "_size": F.length("_t"),
        "_ends": T.ends_sentence(c("_t")),
        "_few": few_words(c("_t")),
        "_label": F.when(F.length("_t") <= 42, words_in(c("_t")) <= 4).otherwise(False),
        "_word": c("_t").rlike("^[A-Za-z]") & ~c("_t").rlike("\\p{Nd}"),
    }
    rows = lines.withColumn("_t", T.normalized(c("text"))).withColumns(asked).drop("_t").withColumns({"_left": left, "_bw": width})
    for name in ("_size", "_ends", "_few", "_label", "x0", "x1", "y1", "font_size"):
        rows = rows.withColumn(f"_p{name}", F.lag(name).over(by))
    pf, f = c("_pfont_size"), c("font_size")
    pin, cin = most(c("_px0") - c("_left"), 0.0), most(c("x0") - c("_left"), 0.0)
    pw, w, bw, ends = c("_px1") - c("_px0"), c("x1") - c("x0"), c("_bw"), c("_p_ends")
    heads = lambda few, ends, width, font: few & ~ends & leaves_room(width, font, bw)
    rules = [
        c("y0") - c("_py1") > most(F.greatest(pf, f) * 0.35, 3.2),
        (cin >= most(f * 0.7, 7.5)) & (cin > pin + most(pf * 0.35, 3.0)) & ends,
        ends & (pw <= bw * 0.76) & (cin <= most(f * 0.3, 3.0)),
        c("_p_label") & (w >= pw * 1.6) & (cin <= pin + most(f * 0.35, 3.0)) & ~ends,
        (pf > 0) & (f > 0) & (pf >= f * 1.06) & heads(c("_p_few"), ends, pw, pf),
        c("_word") & (f > 0) & heads(c("_few"), c("_ends"), w, f) & (pw <= bw * 0.72) & ~ends,
    ]
    cut = (c("_p_size") > 0) & (c("_size") > 0) & reduce(lambda a, b: a | b, rules)
    rows = rows.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select(*lines.columns, c("segment"))


def first_indent(lines: Column, font: Column) -> Column:
    """How far the first line of text stands in from the others; 0 if too little, or too much to be an indent."""
    kept = F.filter(lines, lambda x: (x["x1"] > x["x0"]) & (x["y1"] > x["y0"]) & ~T.is_blank(x["text"]))
    rest = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(1)))
    indent = kept[0]["x0"] - F.array_min(F.transform(rest, lambda x: x["x0"]))
    width = most(F.array_max(F.transform(kept, lambda x: x["x1"])) - F.array_min(F.transform(kept, lambda x: x["x0"])), 1.0)
    return F.when((F.size(kept) >= 2) & (indent >= most(font * 0.45, 4.0)) & (indent <= width * 0.22), indent).otherwise(0.0)


def blocks_from_lines(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One block for each key: union box, largest font, joined text, the lines themselves, first indent."""
    line = F.struct(c(order).alias("n"), "text", "x0", "y0", "x1", "y1", "font_size")
    out = lines.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), F.array_sort(F.collect_list(line)).alias("lines"))
    # blocks without text are told by their lines, as a filter on the joined text would have it joined twice
    out = out.filter(F.exists("lines", lambda x: ~T.is_blank(x["text"]))).withColumn("text", T.joined_lines(F.transform("lines", lambda x: x["text"])))
    return out.withColumn("first_line_indent", first_indent(c("lines"), c("font_size")))


# Flags and roles


def flagged(blocks: DataFrame) -> DataFrame:
    """is_formula, is_header_footer, is_attribution and layout_role of each block."""
    out = blocks.withColumns({"_t": T.normalized(c("text")), "_n": line_count()}).withColumn("_l", F.lower("_t"))
    out = out.withColumn("is_formula", T.is_formula(c("text")))
    out = out.withColumns({"is_header_footer": F.coalesce(header_footer(), F.lit(False)), "is_attribution": F.coalesce(attribution(), F.lit(False))})
    return out.withColumn("layout_role", role()).drop("_t", "_n", "_l")


def _has(pattern: str) -> Column:
    return c("_l").rlike(pattern)


def _email() -> Column:
    return c("_t").contains("@") & c("_t").contains(".")


def _metadata_words() -> Column:
    return _has("\\b(?:issn|doi|vol\\.?|volume|issue|copyright)\\b")


def _low_small(extra: Column) -> Column:
    """Small print in the lower part of a page with a sign of metadata."""
    signs = _has(URLS) | _email() | _has("open access") | _has("article is online") | extra
    return (c("y0") >= c("page_height") * 0.72) & (c("font_size") <= 8.5) & (c("_n") <= 5) & (F.length("_t") <= 320) & signs


def header_footer() -> Column:
    """Running heads and feet, page numbers, imprints."""
    h, w, n, size = c("page_height"), most(c("page_width"), 1.0), c("_n"), F.length("_t")
    top = c("y0") <= most(h * 0.08, 36.0)
    bottom = c("y1") >= h - most(h * 0.08, 42.0)
    dense = T.compact(c("_t"))
    number = dense.rlike("^\\p{Nd}{1,6}$")
    url, email = _has(URLS), _email()
    volume = c("_t").rlike("\\b\\d{1,3}\\s*:\\s*\\d{2,6}(?:\\s*[-–—]\\s*\\d{2,6})?\\b")
    strong = bottom & (_has("published by") | c("_t").contains("©") | _has("\\(c\\)") | _metadata_words() | (url & volume))
    lower = _low_small(_has("\\b(?:corresponding author|e-?mail|email)\\b") | _metadata_words())
    middle = F.abs((c("x0") + c("x1")) / 2 - w / 2) <= w * 0.12
    edge = (c("x0") <= w * 0.16) | (c("x1") >= w * 0.84)
    ratio, count = (c("x1") - c("x0")) / w, T.count_of(c("_t"), "[A-Za-z0-9][A-Za-z0-9./:@_-]*")
    digits = (dense != "") & (T.chars_in(dense, "\\p{Nd}") >= F.greatest(F.lit(3), F.floor(F.length(dense) / 3).cast("int")))
    sentence = c("_t").rlike("[.!?;:]\\s+[A-Z]") | (c("_t").rlike("[.?!]$") & (size > 70))
    label = F.trim("_l").rlike("^(page\\s*)?\\d{1,4}$")
    possible = (top | bottom) & n.between(1, 4) & (size <= 120) & (c("font_size") <= 14) & ~(top & (c("page_num") == 0) & ~label)
    any_sign = url | email | _metadata_words() | number
    foot = bottom & (((n <= 3) & (count <= 10) & digits) | ((middle | edge | (ratio <= 0.55)) & (n <= 3) & (count <= 8) & ~sentence))
    head = top & (label | ((edge | middle) & (ratio <= 0.42) & (c("font_size") <= 11.5) & (n <= 2) & (count <= 10) & (size <= 70) & ~sentence))
    # what each rule asks first: texts are only looked through where one of these holds
    small = (c("y0") >= h * 0.72) & (c("font_size") <= 8.5)
    maybe = ~c("is_formula") & ~is_empty() & (h > 0) & (c("_t") != "") & (bottom | small | (top & n.between(1, 4) & (size <= 120)))
    return F.when(maybe, strong | lower | (possible & (any_sign | foot | head))).otherwise(False)


def publication_metadata() -> Column:
    h, w = most(c("page_height"), 1.0), most(c("page_width"), 1.0)
    bottom, top = c("y1") >= h * 0.94, c("y0") <= h * 0.09
    dense = T.compact(c("_t"))
    letters, upper = T.chars_in(dense, "\\p{L}"), T.chars_in(dense, "\\p{Lu}")
    slim = top & (c("_n") <= 2) & ((c("x1") - c("x0")) / w <= 0.28)
    edge = ((c("x0") <= w * 0.12) | (c("x1") >= w * 0.86)) & (c("font_size") <= 16)
    capitals = (letters > 0) & (upper / most(letters.cast("double"), 1.0) >= 0.72)
    signs = ["doi:", "copyright", "all rights reserved", "macmillan publishers", "©"]
    words = _has("\\b(?:issn|doi|vol\\.?|volume|issue|copyright|published|publisher|license)\\b") | _has("\\b(?:corresponding author|e-?mail|email|doi)\\b")
    return (c("_t") != "") & ~is_empty() & (
        reduce(lambda a, b: a | b, [c("_l").contains(sign) for sign in signs])
        | c("_l").startswith("(c)")
        | (bottom & (c("font_size") <= 7.5) & (c("_n") <= 4))
        | (bottom & _has("\\b(?:nature|science|cell|volume|vol)\\b") & (F.length("_t") <= 120))
        | _low_small(words)
        | F.when(slim, (F.length(dense) <= 32) & (edge | capitals)).otherwise(False)
    )


def attribution() -> Column:
    """Bylines and credits at the foot of a first page."""
    h, w = most(c("page_height"), 1.0), most(c("page_width"), 1.0)
    count = T.count_of(c("_t"), "[A-Za-z0-9][A-Za-z0-9.'@_-]*")
    placed = ((c("x1") - c("x0")) / w <= 0.70) | (F.abs((c("x0") + c("x1")) / 2 - w / 2) <= w * 0.28)
    plus = T.count_of(c("_t"), "\\+")
    signs = (
        c("_t").rlike("(?<![\\w.])@[A-Za-z0-9_]{2,30}\\b")
        | c("_t").rlike("(?i)^(?:by|from|via)\\s+(?:@|[A-Z0-9])")
        | _has("\\b(?:author|creator|maker|founder|co[- ]?founder|designer|illustrator|editor)\\b")
        | _has("\\b(?:made|built|written|created|designed)\\s+by\\b")
        | ((plus >= 2) & (count <= 18))
    )
    fits = (c("page_num") == 0) & (c("_t") != "") & ~is_empty() & (c("y0") >= h * 0.68) & c("_n").between(1, 4) & (c("font_size") <= 30) & (F.length("_t") <= 180)
    return F.when(fits & placed, (count <= 24) & ~T.ends_sentence(c("_t")) & ~c("_t").rlike("[.!?;:]\\s+[A-Z]") & signs).otherwise(False)


def dense_reference() -> Column:
    """Many small lines: a bibliography."""
    n, h = c("_n"), most(c("page_height"), 1.0)
    seps, digits = T.chars_in(c("_t"), "[,;|]"), T.chars_in(c("_t"), "\\p{Nd}")
    short = F.size(F.filter("lines", lambda x: (T.normalized(x["text"]) != "") & (F.length(T.normalized(x["text"])) <= 95)))
    ratio = seps / most(T.count_of(c("_t"), "[A-Za-z][A-Za-z.'-]*").cast("double"), 1.0)
    rules = (((c("y1") - c("y0")) / h >= 0.22) & (n >= 20)) | ((short >= n * 0.75) & (ratio >= 0.18)) | ((n >= 16) & (digits >= n) & (seps >= F.floor(n / 2)))
    return (c("_t") != "") & ~is_empty() & (n >= 12) & (c("font_size") <= 7.4) & rules


def role() -> Column:
    """metadata, dense_reference, vertical_text, marginalia or body, the first that fits."""
    h, w, n = most(c("page_height"), 1.0), most(c("page_width"), 1.0), c("_n")
    bw, bh = c("x1") - c("x0"), c("y1") - c("y0")
    side = ((c("x0") + c("x1")) / 2 <= w * 0.14) | ((c("x0") + c("x1")) / 2 >= w * 0.86)
    dense = F.length(T.compact(c("_t")))
    short = F.size(F.filter("lines", lambda x: (T.normalized(x["text"]) != "") & (F.length(T.compact(x["text"])) <= 3)))
    stacked = (n >= 2) & (short >= F.greatest(F.lit(2), F.floor(n / 2).cast("int"))) & (dense <= F.greatest(F.lit(24), n * 4))
    turned = side & (n == 1) & (dense <= 80) & (bh >= most(bw * 6.0, 80.0))
    vertical = (bh >= most(bw * 2.2, 28.0)) & (bw / w <= 0.16) & (stacked | turned)
    return (
        F.when(is_empty(), "body")
        .when(publication_metadata() | c("is_attribution"), "metadata")
        .when(dense_reference(), "dense_reference")
        .when(vertical, "vertical_text")
        .when(side & (bw / w <= 0.18) & (bh / h >= 0.015), "marginalia")
        .otherwise("body")
    )


def dense_pages(blocks: DataFrame) -> DataFrame:
    """On pages that are mostly bibliography, small blocks become part of it."""
    page = Window.partitionBy(*PAGE)
    dense = c("layout_role") == "dense_reference"
    # texts and lines are not looked at after pages are dealt, so that they need not be where nobody reads them
    rows = blocks.withColumns({"_rows": line_count(), "_said": ~T.is_blank(c("text"))})
    area = F.sum(F.when(dense & ~is_empty(), (c("x1") - c("x0")) * (c("y1") - c("y0")))).over(page)
    count = F.sum(F.when(dense, c("_rows"))).over(page)
    whole = (area / most(c("page_width") * c("page_height"), 1.0) >= 0.18) | (count >= 40)
    small = (c("font_size") <= 7.4) & ((c("_rows") <= 8) | ((c("y1") - c("y0")) / most(c("page_height"), 1.0) <= 0.16))
    takes = F.coalesce(whole, F.lit(False)) & ~c("layout_role").isin("metadata", "dense_reference") & c("_said") & ~is_empty() & small
    return rows.withColumn("layout_role", F.when(takes, "dense_reference").otherwise(c("layout_role"))).drop("_rows", "_said")


def chart_label(multiline: bool) -> Column:
    """Text that may label a chart: tiny, short, numeric or upright."""
    t, n, f = T.normalized(c("text")), line_count(), c("font_size")
    dense = T.compact(t)
    count, digits, letters, upper = words_in(t), T.chars_in(dense, "\\p{Nd}"), T.chars_in(dense, "\\p{L}"), T.chars_in(dense, "\\p{Lu}")
    numbers, long_words = T.count_of(t, "(?U)\\b\\d+(?:[.,]\\d+)?[A-Za-z%]*\\b"), T.count_of(t, "(?U)\\b[a-z]{4,}\\b")
    bw, bh = c("x1") - c("x0"), c("y1") - c("y0")
    rules = [
        (f <= 9.0) & dense.rlike("^[A-Za-z]$"),
        (f <= 6.1) & (F.length(t) <= 8) & (digits >= 1),
        (f <= 6.3) & (count >= 10) & (bh <= 28),
        (f <= 6.8) & (count <= 8),
        (f <= 6.8) & (digits >= F.greatest(F.lit(2), F.floor(letters / 2).cast("int"))),
        (f <= 6.8) & (upper / most(letters.cast("double"), 1.0) >= 0.55) & (count <= 10),
        (f <= 7.2) & (bh > bw * 1.8) & (F.length(t) <= 90),
    ]
    if multiline:
        rules.append((f <= 7.4) & (n >= 6) & (numbers >= F.greatest(F.lit(8), n)) & (long_words <= count * 0.35))
    found = (t != "") & reduce(lambda a, b: a | b, rules)
    return found if multiline else found & (n <= 4)


def marker_heading() -> Column:
    head, rest = T.symbol_prefix(c("text"))
    return (head != "") & (line_count() <= 2) & (F.length(rest) <= 60) & ~(rest.rlike("[.。!?！？:：;；]") & (F.length(rest) > 20)) & (c("font_size") >= 10)


def compact_heading() -> Column:
    """A body block that is rendered as a compact heading."""
    t = T.normalized(c("text"))
    symbols = t.rlike(f"[[\\p{{So}}\\x{{10000}}-\\x{{10FFFF}}]&&[^{T.BULLETS}]]")
    words = T.count_of(t, "[\\p{L}\\p{N}_]+")
    return (c("layout_role") == "body") & (t != "") & (line_count() <= 2) & (c("font_size") >= 14) & (F.length(T.compact(t)) <= 90) & (symbols | ((c("font_size") >= 16) & (words <= 10) & ~T.ends_with_stop(t)))


def alignment() -> Column:
    """left, center or right, from a block's lines and margins."""
    kept = F.filter("lines", lambda x: T.normalized(x["text"]) != "")
    n, w, bw = F.size(kept), c("page_width"), c("x1") - c("x0")
    spread = lambda f: F.array_max(F.transform(kept, f)) - F.array_min(F.transform(kept, f))
    sizes = F.sort_array(F.filter(F.transform(kept, lambda x: x["font_size"]), lambda s: s > 0))
    median = F.coalesce(F.try_element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1), most(c("y1") - c("y0"), 10.0))
    off = F.abs((c("x0") + c("x1")) / 2 - w / 2)
    long = F.length(T.normalized(c("text"))) > 80
    right = most(w - c("x1"), 0.0)
    left = most(c("x0"), 0.0)
    return (
        F.when((w <= 0) | (bw <= 0), "left")
        .when((c("layout_role") == "body") & (n == 1), "left")
        .when((n > 1) & long, "left")
        .when((n > 1) & (spread(lambda x: (x["x0"] + x["x1"]) / 2) <= median * 0.8) & (off <= w * 0.1), "center")
        .when((n > 1) & (spread(lambda x: x["x0"]) <= median * 0.8), "left")
        .when((off <= w * 0.08) & (F.abs(left - right) <= w * 0.18) & (bw <= w * 0.85), "center")
        .when((right <= w * 0.08) & (left > right * 2.5) & (bw <= w * 0.75), "right")
        .otherwise("left")
    )


def styles(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Colour (the first if none leads clearly), upper-median size and boldness of each block, weighted by text length."""
    kept = spans.filter(F.trim("text") != "").withColumn("_w", F.length(F.trim("text")))
    colors = kept.groupBy(*keys, "color").agg(F.sum("_w").alias("w"), F.min(order).alias("at"))
    lead = colors.groupBy(*keys).agg(F.max_by("color", F.struct("w", -c("at"))).alias("lead"), F.min_by("color", "at").alias("first"), (F.max("w") / F.sum("w")).alias("share"), F.count("*").alias("n"))
    # the upper median is the first half's last from the top: a count for each size, no list of spans
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY font_size DESC)")
    rest = kept.groupBy(*keys).agg(middle.alias("_s"), (F.sum(F.when(is_bold(c("font"), c("flags")), c("_w")).otherwise(0)) / F.sum("_w") >= 0.45).alias("is_bold"))
    size = most(c("_s"), 6.0)
    color = F.when((c("n") > 1) & (c("share") < 0.75), c("first")).otherwise(c("lead"))
    return rest.join(lead, keys).select(*keys, size.alias("font_size"), "is_bold", color.alias("color"))


def luminance(color: Column) -> Column:
    """WCAG relative luminance of a 24-bit colour."""

    def channel(shift: int) -> Column:
        v = F.shiftright(color, shift).bitwiseAND(F.lit(255)) / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return channel(16) * 0.2126 + channel(8) * 0.7152 + channel(0) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def readable(color: Column, background: Column) -> Column:
    """The colour, or black or white where it can hardly be read on the background."""
    black, white = F.lit(0), F.lit(0xFFFFFF)
    return F.when(contrast(color, background) >= 1.6, color).when(contrast(black, background) >= contrast(white, background), black).otherwise(white)


# Columns and order


def columns(blocks: DataFrame) -> DataFrame:
    """``layout_column``: number of a block's column, -1 across columns, null where a page has none."""
    page = Window.partitionBy(*PAGE)
    w = c("page_width")
    body = (c("layout_role") == "body") & ~c("is_header_footer") & ~c("is_formula") & ~is_empty()
    narrow = blocks.filter(body & (c("x1") - c("x0") < w * 0.68)).withColumn("_c", (c("x0") + c("x1")) / 2)
    widths = narrow.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(most(c("x1") - c("x0"), 1.0))).alias("_w"), F.max("page_width").alias("w"))
    widths = widths.filter("n >= 4").select(*PAGE, "w", most(c("w") * 0.10, F.element_at("_w", F.floor(F.size("_w") / 2).cast("int") + 1) * 0.45, 28.0).alias("gap"))
    by = Window.partitionBy(*PAGE).orderBy("_c", "seq")
    cut = F.coalesce((c("_c") - F.lag("_c").over(by) > c("gap")).cast("int"), F.lit(0))
    placed = narrow.join(widths, PAGE).withColumn("_cut", cut).withColumn("cluster", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bands = placed.groupBy(*PAGE, "cluster").agg(F.min("x0").alias("b0"), F.max("x1").alias("b1"), F.count("*").alias("n"), F.max("w").alias("w")).filter("n >= 2")
    order = Window.partitionBy(*PAGE).orderBy("b0", "cluster")
    bands = bands.withColumns({"next": F.lead("b0").over(order), "k": F.count("*").over(page)})
    points = bands.groupBy(*PAGE).agg(F.max("k").alias("k"), F.bool_or(c("b1") > c("next") + c("w") * 0.08).alias("clash"), F.array_sort(F.array_compact(F.collect_list((c("b1") + c("next")) / 2))).alias("_splits"))
    points = points.filter(c("k").between(2, 4) & ~F.coalesce("clash", F.lit(False))).select(*PAGE, "_splits")
    across = (c("x1") - c("x0") >= w * 0.68) | F.exists("_splits", lambda p: (c("x0") < p) & (p < c("x1")))
    number = F.size(F.filter("_splits", lambda p: (c("x0") + c("x1")) / 2 > p))
    column = F.when(body & c("_splits").isNotNull(), F.when(across, -1).otherwise(number))
    return blocks.join(points, PAGE, "left").withColumn("layout_column", column).drop("_splits")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``rank`` on the page: blocks across columns, then column by column, then upright text, margins, heads and feet, the rest."""
    kind = F.when(c("is_header_footer"), 4).when(c("layout_role") == "vertical_text", 2).when(c("layout_role") == "marginalia", 3).when(c("layout_role") != "body", 5).when(F.coalesce("layout_column", F.lit(-1)) == -1, 0).otherwise(1)
    column = F.when(kind == 1, c("layout_column")).otherwise(0)
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(kind, column, "y0", "x0", "seq")))


# Spatial joins: equal page, then rectangles


def touching(a: str, b: str, by: float = 0.0) -> Column:
    """Rectangles of aliases ``a`` (grown by ``by``) and ``b`` share some area."""
    return (c(f"{a}.x0") - by < c(f"{b}.x1")) & (c(f"{b}.x0") < c(f"{a}.x1") + by) & (c(f"{a}.y0") - by < c(f"{b}.y1")) & (c(f"{b}.y0") < c(f"{a}.y1") + by)


def overlap_share(inner: str, outer: str) -> Column:
    """Share of ``inner``'s area inside ``outer``."""
    side = lambda lo, hi: F.greatest(F.least(c(f"{inner}.{hi}"), c(f"{outer}.{hi}")) - F.greatest(c(f"{inner}.{lo}"), c(f"{outer}.{lo}")), F.lit(0.0))
    area = (c(f"{inner}.x1") - c(f"{inner}.x0")) * (c(f"{inner}.y1") - c(f"{inner}.y0"))
    return side("x0", "x1") * side("y0", "y1") / most(area, 1.0)


def same_page(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [c(f"{a}.{k}") == c(f"{b}.{k}") for k in PAGE])


def holds(outer: str, x: Column, y: Column) -> Column:
    return (c(f"{outer}.x0") <= x) & (x < c(f"{outer}.x1")) & (c(f"{outer}.y0") <= y) & (y < c(f"{outer}.y1"))


def in_tables(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Keys of blocks with a fair share, or a corner, inside a table region."""
    corner = holds("r", c("b.x0"), c("b.y0")) | holds("r", c("b.x1"), c("b.y1"))
    on = same_page("b", "r") & touching("r", "b") & ((overlap_share("b", "r") >= 0.35) | corner)
    return blocks.alias("b").join(regions.alias("r"), on, "left_semi").select(*PAGE, "seq")


def chart_rules() -> list[Column]:
    """What chart rules ask of a block's text: label (may label a chart), single (may without many lines), small (type and text)."""
    small = (c("font_size") <= 7.2) & (F.length(T.normalized(c("text"))) <= 220)
    return [chart_label(True).alias("label"), chart_label(False).alias("single"), small.alias("small")]


def able_facts(blocks: DataFrame) -> DataFrame:
    """Keys, boxes and ``chart_rules`` of blocks, all false where one cannot be chart text by its flags."""
    able = ~c("is_formula") & ~c("is_header_footer") & ~is_empty()
    return blocks.select(*PAGE, "seq", "x0", "y0", "x1", "y1", *[(able & c(k)).alias(k) for k in ("label", "single", "small")])


def chart_facts(blocks: DataFrame) -> DataFrame:
    """``able_facts`` of whole blocks."""
    return able_facts(blocks.select(*PAGE, "seq", "x0", "y0", "x1", "y1", "is_formula", "is_header_footer", *chart_rules()))


def seeds_of(facts: DataFrame, graphics: DataFrame) -> DataFrame:
    """Keys of blocks (``chart_facts``) that touch a large graphic and look like its labels, or small text in its lower part."""
    large = graphics.filter((c("x1") - c("x0") >= c("page_width") * 0.18) & (c("y1") - c("y0") >= 60))
    low = c("g.y0") + least(F.lit(140.0), (c("g.y1") - c("g.y0")) * 0.45)
    b = facts.filter("label OR small")
    return b.alias("b").join(large.alias("g"), same_page("b", "g") & touching("g", "b", 6.0) & (c("b.label") | (c("b.small") & (c("b.y0") >= low))), "left_semi").select(*PAGE, "seq")


def chart_seeds(blocks: DataFrame, graphics: DataFrame) -> DataFrame:
    """``seeds_of`` whole blocks."""
    return seeds_of(chart_facts(blocks), graphics)


def rescued_headers(blocks: DataFrame) -> DataFrame:
    """Keys of head or foot blocks that are headings of the text right below them."""
    t = T.normalized(c("text"))
    heads = blocks.filter(c("is_header_footer") & ~c("is_formula") & (line_count() == 1) & (F.length(t) <= 90) & (words_in(t) <= 12) & ~T.ends_sentence(t) & (c("font_size") > 0))
    others = blocks.filter(~c("is_formula") & ~is_empty())
    width = most(c("h.x1") - c("h.x0"), 1.0)
    column = (F.abs(c("o.x0") - c("h.x0")) <= most(c("h.font_size") * 0.8, 10.0)) & (F.least("h.x1", "o.x1") - F.greatest("h.x0", "o.x0") >= width * 0.45)
    gap = c("o.y0") - c("h.y1")
    on = same_page("h", "o") & (c("h.seq") != c("o.seq")) & column & (gap >= -1.0) & (gap <= most(c("h.font_size") * 1.2, 16.0))
    return heads.alias("h").join(others.alias("o"), on, "left_semi").select(*PAGE, "seq")


#: So many blocks after one are looked at by a window; joins look further.
NEXT = 16


def is_below(b: dict[str, Column], n: dict[str, Column]) -> Column:
    """Block ``n`` begins below ``b`` and shares its column: they overlap sideways, or begin at about one x."""
    aside = (n["x1"] >= b["x0"] - 12) & (n["x0"] <= b["x1"] + 12)
    return (n["y0"] > b["y0"] + 1) & (aside | (F.abs(n["x0"] - b["x0"]) < 80))


def room_below(blocks: DataFrame, margin: float = 18.0) -> DataFrame:
    """``bottom_limit`` of each block: just above the next later block below it in its column, else the page's margin.

    Most blocks have their next among the few that follow, which a window over the page sees; those that nothing later on
    the page is below have none. The rest look on in rounds, each sixteen times as far as the last, by a join on runs of ranks:
    work goes with how far the next block lies, and no page is ever held whole. ``seq`` names a block of its page.
    """
    sides = ["x0", "y0", "x1"]
    key = [*PAGE, "seq"]
    onward, back = Window.partitionBy(*PAGE).orderBy("seq"), Window.partitionBy(*PAGE).orderBy(c("seq").desc())
    # from the end of the page, a frame only grows: linear in the page's blocks
    seen = blocks.select(*key, *sides, "page_height").withColumns(
        {
            "_near": F.collect_list(F.struct("seq", *sides)).over(onward.rowsBetween(1, NEXT)),
            "rank": F.row_number().over(onward),
            "_lowest": F.max("y0").over(back.rowsBetween(Window.unboundedPreceding, -NEXT - 1)),
            "after": F.row_number().over(back) - 1,
        }
    )
    own = {k: c(k) for k in sides}
    first = F.filter("_near", lambda x: is_below(own, {k: x[k] for k in sides}))
    seen = seen.withColumn("next_y0", F.try_element_at(first, F.lit(1))["y0"])
    seen = written(seen.withColumn("_open", c("next_y0").isNull() & F.coalesce(c("_lowest") > c("y0") + 1, F.lit(False))).drop("_near", "_lowest"), "room-below")
    left, width, far = seen.filter("_open").select(*key, *sides, "rank", "after"), NEXT, []
    while not left.isEmpty():
        width *= 16
        run = F.floor(c("rank") / width)
        looks = left.withColumn("run", F.explode(F.array(run, run + 1))).alias("b")
        on = same_page("b", "n") & (c("b.run") == c("n.run")) & (c("n.rank") > c("b.rank")) & is_below({k: c(f"b.{k}") for k in sides}, {k: c(f"n.{k}") for k in sides})
        met = looks.join(seen.withColumn("run", run).alias("n"), on)
        far.append(written(met.groupBy(*[c(f"b.{k}").alias(k) for k in key]).agg(F.min_by(c("n.y0"), c("n.seq")).alias("far_y0")), "room-far"))
        left = written(left.filter(c("after") > width).join(far[-1], key, "left_anti"), "room-left")
    found = seen.join(reduce(DataFrame.unionByName, far), key, "left") if far else seen.withColumn("far_y0", F.lit(None).cast("double"))
    return found.select(*key, F.least(c("page_height") - margin, F.coalesce(F.coalesce("next_y0", "far_y0") - 4, c("page_height"))).alias("bottom_limit"))


def inline_graphics(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(image, block seq) pairs: images of a few lines' size that stand at a block's first line."""
    # null where a block has none: Spark may look before blank blocks are left out
    first = F.get(F.filter("lines", lambda x: T.normalized(x["text"]) != ""), F.lit(0))
    b = blocks.filter(~is_empty()).select(*PAGE, "seq", "font_size", c("x0").alias("b0"), c("x1").alias("b1"), first["y0"].alias("l0"), first["y1"].alias("l1"))
    b = b.filter("l1 > l0").withColumns({"x0": c("b0") - most(c("font_size") * 1.2, 8.0), "x1": c("b1") + most(c("font_size") * 1.2, 8.0), "y0": c("l0") - most(c("font_size") * 0.45, 4.0), "y1": c("l1") + most(c("font_size") * 0.45, 4.0)})
    w, h, f = c("i.x1") - c("i.x0"), c("i.y1") - c("i.y0"), c("b.font_size")
    fits = (F.least(w, h) >= most(f * 0.35, 5.0)) & (F.greatest(w, h) <= most(f * 3.8, 54.0))
    middle = (c("i.x0") + c("i.x1")) / 2
    near = (middle >= c("b.b0") - most(f, 8.0)) & (middle <= c("b.b1") + most(f, 8.0))
    joined = images.alias("i").join(b.alias("b"), same_page("i", "b") & touching("b", "i") & fits & near)
    return joined.select(*[c(f"i.{k}").alias(k) for k in (*PAGE, "image")], c("b.seq").alias("seq"))


def label_starts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Where the text starts after a short label on a block's top line: the first wide gap after it, else the block's left."""
    top = Window.partitionBy(*keys)
    first = spans.withColumn("_top", F.min("y0").over(top)).filter((T.normalized(c("text")) != "") & (c("y0") <= c("_top") + c("font_size") * 0.35))
    by = Window.partitionBy(*keys).orderBy("x0", "x1")
    after = first.withColumns({"_t": F.lag(T.normalized(c("text"))).over(by), "_p0": F.lag("x0").over(by), "_p1": F.lag("x1").over(by)})
    start = (F.length("_t") <= 8) & (c("_p1") - c("_p0") <= c("font_size") * 3) & (c("x0") - c("_p1") >= c("font_size") * 0.9)
    return after.groupBy(*keys).agg(F.coalesce(F.min(F.when(start, c("x0"))), F.min("x0")).alias("start_x"))
