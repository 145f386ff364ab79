"""Queries over blocks: text, translation, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger as L
from ..operators import quality as Q
from ..operators import translate as R
from ..sources import fixtures as X
from ..sources import pages as G
from ..sources.scratch import new_path, written
from .catalog import Catalog

catalog = Catalog()
add = catalog.add

# The same rules in the oracle's dialect.
NORMAL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
ENDS = "[.!?;:。！？；：]"
ENDS_SENTENCE = f"regexp_matches(regexp_replace({NORMAL}, '[)\\]}}）】》”’\"'']+$', ''), '{ENDS}$')"
STOP = f"regexp_matches(rtrim(text), '{ENDS}$')"
MARKER = "regexp_extract(ltrim(text), '^((?:[*•·\\-–—]\\s+)|(?:\\(?[A-Za-z0-9]{1,8}[).]\\s+))', 1)"
WORDS = "len(regexp_extract_all(trim(text), '[\\p{L}\\p{N}_]+(?:[-/][\\p{L}\\p{N}_]+)*'))"
ROLE = f"""CASE WHEN {MARKER} <> '' THEN 'list_item' WHEN regexp_matches(trim(text), '(?i)^(figure|fig\\.?|table)\\s+[\\p{{L}}\\p{{N}}_]+') THEN 'caption'
 WHEN trim(text) <> '' AND length(trim(text)) <= 140 AND {WORDS} <= 16 AND NOT {STOP} THEN 'heading' ELSE 'body' END"""


def n(pattern: str, of: str = "c") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


COMPACT = "regexp_replace(text, '\\s', '', 'g')"
MATHS = "[=<>+/*^_{}\\[\\]|±×÷≈≠≤≥√∑∫∞∂∆∇→←↔\\-Ͱ-Ͽἀ-῿]"
FORMULA = f"""(SELECT length(c) >= 2 AND ((regexp_matches(c, '[∑∫√∞≈≠≤≥±×÷]') AND l <= length(c) * 0.65::DOUBLE) OR (contains(c, '=') AND o >= 1 AND r >= 0.28::DOUBLE) OR (m >= 2 AND r >= 0.25::DOUBLE)
 OR (length(c) <= 28 AND r >= 0.45::DOUBLE AND l <= g + m + o)) FROM (SELECT *, (m + g + o)::DOUBLE / greatest(length(c), 1) AS r FROM (SELECT c, {n(MATHS)} AS m, {n("\\p{Nd}")} AS g, {n("\\p{L}")} AS l, {n("[+\\-*/=<>^_]")} AS o FROM (SELECT {COMPACT} AS c))))"""
# Unicode's word boundaries by ASCII's: digits as 0, other word characters beyond ASCII as an underscore, which no rule counts.
BOUNDED = "regexp_replace(regexp_replace(text, '\\p{Nd}', '0', 'g'), '[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{M}]|[^\\x00-\\x7F\\P{Nl}]|[^\\x00-\\x7F\\P{Pc}]', '_', 'g')"
NUMERIC = f"""(SELECT length(c) >= 2 AND (((g + o)::DOUBLE / greatest(length(c), 1) >= 0.45::DOUBLE AND l <= g + o) OR (t >= 8 AND s <= greatest(w * 0.35::DOUBLE, 3))) FROM (SELECT c, {n("\\p{Nd}")} AS g, {n("[+\\-*/=<>^_%]")} AS o, {n("\\p{L}")} AS l,
 {n("[A-Za-z]+", "text")} AS w, {n("\\b[0-9]+(?:[.,][0-9]+)?[A-Za-z%]*\\b", "b")} AS t, {n("\\b[a-z]{4,}\\b", "b")} AS s FROM (SELECT regexp_replace(text, '[\\s\\x0B\\x{{85}}\\p{{Z}}]', '', 'g') AS c, {BOUNDED} AS b)))"""
GO = f"trim(text) <> '' AND NOT {FORMULA}"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(spark, d)


KEYS = ["doc_id", "block_index"]


@add(f"SELECT doc_id, block_index, {NORMAL} AS clean, {ENDS_SENTENCE} AS ends FROM blocks", "blocks")
def f1_p1_normalized(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select(*KEYS, T.normalized(F.col("text")).alias("clean"), T.ends_sentence(F.col("text")).alias("ends"))


DIRTY = "concat('“', text, '” — x… �•', chr(57344), chr(9), '‘ﬁ’')"


@add(f"SELECT doc_id, block_index, concat('\"', trim(regexp_replace(text, '\\s+', ' ', 'g')), '\" - x... • ''fi''') AS clean, 2 AS suspicious FROM blocks WHERE text = trim(text)", "blocks")
def f2_f3_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Punctuation, tofu, private-use and control characters added to every block, and taken out again."""
    dirty = F.concat(F.lit("“"), F.col("text"), F.lit("” — x… �•\t‘ﬁ’"))
    return blocks(spark, d).filter(F.col("text") == F.trim("text")).select(*KEYS, T.sanitized(dirty).alias("clean"), T.suspicious_glyphs(dirty).alias("suspicious"))


@add(
    """SELECT doc_id, block_index, list_sort(list_filter([CASE WHEN regexp_matches(t, '[a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ]') THEN 'latin' END, CASE WHEN regexp_matches(t, '[Ā-ɏ]') THEN 'latin_extended' END, CASE WHEN regexp_matches(t, '[а-яА-Я]') THEN 'cyrillic' END,
 CASE WHEN regexp_matches(t, '[一-鿿]') THEN 'cjk' END], x -> x IS NOT NULL)) AS scripts FROM (SELECT *, CASE block_index % 3 WHEN 0 THEN concat(text, ' щ') WHEN 1 THEN concat(text, ' 中1!') ELSE text END AS t FROM blocks)""".replace("x -> x IS NOT NULL", "lambda x: x IS NOT NULL"),
    "blocks",
)
def f4_scripts(spark: SparkSession, d: str) -> DataFrame:
    text = X.cases(F.col("block_index") % 3, {0: F.concat("text", F.lit(" щ")), 1: F.concat("text", F.lit(" 中1!"))}, F.col("text"))
    return blocks(spark, d).select(*KEYS, T.scripts(text).alias("scripts"))


@add("SELECT doc_id, block_index, block_index % 2 = 0 AS cjk, block_index % 3 = 0 AS emoji, block_index % 6 = 0 AND trim(text) = '' AS emoji_only FROM blocks", "blocks")
def f5_emoji_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("block_index") % 2 == 0, "中").otherwise(""), F.when(F.col("block_index") % 3 == 0, "\U0001f600").otherwise(""))
    only = F.when(F.col("block_index") % 6 == 0, F.concat("text", F.lit("\U0001f600☀"))).otherwise(F.col("text"))
    return blocks(spark, d).select(*KEYS, T.has_cjk(t).alias("cjk"), T.has_emoji(t).alias("emoji"), T.is_emoji_only(only).alias("emoji_only"))


@add(
    """SELECT doc_id, page_num, string_agg(CASE WHEN rn > 1 AND regexp_matches(prev, '[A-Za-z0-9]-$') AND regexp_matches(t, '^[a-z0-9]') THEN '' WHEN rn > 1 THEN ' ' ELSE '' END || t, '' ORDER BY block_index) AS joined
 FROM (SELECT *, lag(t) OVER w AS prev, row_number() OVER w AS rn FROM (SELECT doc_id, page_num, block_index, CASE WHEN block_index % 4 = 0 THEN concat(trim(text), 'x-') ELSE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS t FROM blocks WHERE trim(text) <> '') WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY block_index)) GROUP BY doc_id, page_num""",
    "blocks",
)
def f7_joined_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("block_index") % 4 == 0, F.concat(F.trim("text"), F.lit("x-"))).otherwise(F.lower(T.normalized(F.col("text"))))
    rows = blocks(spark, d).filter(F.trim("text") != "").groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_index", t.alias("t")))).alias("l"))
    return rows.select("doc_id", "page_num", T.joined_lines(F.transform("l", lambda x: x["t"])).alias("joined"))


@add(f"SELECT doc_id, block_index, {MARKER} AS marker FROM blocks", "blocks")
def f8_leading_marker(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select(*KEYS, T.leading_marker(F.col("text")).alias("marker"))


@add("SELECT doc_id, block_index, CASE block_index % 2 WHEN 0 THEN '■ ☀' ELSE '' END AS symbols, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest FROM blocks", "blocks")
def f10_symbol_prefix(spark: SparkSession, d: str) -> DataFrame:
    head, rest = T.symbol_prefix(F.when(F.col("block_index") % 2 == 0, F.concat(F.lit("■ ☀ "), F.col("text"))).otherwise(F.col("text")))
    return blocks(spark, d).select(*KEYS, head.alias("symbols"), rest.alias("rest"))


def references_of(b: DataFrame) -> DataFrame:
    source = F.concat(F.lit("a² "), F.col("text"), F.lit("³-⁴."))
    lost = F.concat(F.lit("a "), F.col("text"))
    reply = F.concat(F.lit("a[[ ref 0 ]] "), F.col("text"), F.lit("[[REF1]]."))
    return b.select(*KEYS, R.protected(source).alias("protected"), R.restored(reply, source).alias("restored"), R.restored(lost, source).alias("appended"))


@add("SELECT doc_id, block_index, concat('a[[REF0]] ', text, '[[REF1]].') AS protected, concat('a² ', text, '³⁻⁴.') AS restored, concat('a ', text, '²³⁻⁴') AS appended FROM blocks WHERE text NOT LIKE '%²%' AND regexp_matches(text, '[a-z]$')".replace("³⁻⁴", "³-⁴"), "blocks")
def f9_references(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).filter(~F.col("text").contains("²") & F.col("text").rlike("[a-z]$"))
    return references_of(b)


@add()
def f9_references_all(spark: SparkSession, d: str) -> DataFrame:
    """As f9_references, over all blocks."""
    return references_of(blocks(spark, d))


@add(f"SELECT doc_id, block_index, {FORMULA} AS formula, {NUMERIC} AS numeric_like FROM blocks", "blocks")
def p3_p13_formulas(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select(*KEYS, T.is_formula(F.col("text")).alias("formula"), T.is_numeric_like(F.col("text")).alias("numeric_like"))


@add(f"SELECT doc_id, block_index, text FROM blocks WHERE {GO}", "blocks")
def p11_translatable(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.filter(R.translatable(b)).select(*KEYS, "text")


@add(f"SELECT doc_id, block_index FROM blocks WHERE trim(text) <> '' AND NOT {NUMERIC}", "blocks")
def p12_expected(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.filter(Q.expected(b)).select(*KEYS)


@add(f"SELECT doc_id, block_index, {ROLE} AS role FROM blocks", "blocks")
def p14_translation_role(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.select(*KEYS, R.role(b).alias("role"))


@add(f"SELECT lang, {ROLE} AS role, text, count(*) AS places, min(doc_id) AS first_doc FROM blocks WHERE {GO} GROUP BY ALL", "blocks")
def u2_distinct_items(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    rows = b.filter(R.translatable(b)).withColumn("role", R.role(b))
    return rows.groupBy("lang", "role", "text").agg(F.count("*").alias("places"), F.min("doc_id").alias("first_doc"))


ITEMS = f"SELECT DISTINCT doc_id, lang, {ROLE} AS role, text FROM blocks WHERE {GO}"


@add(f"SELECT b.lang, b.role, count(*) AS items, count(m.text) AS hits, count(*) - count(m.text) AS misses FROM (SELECT DISTINCT lang, role, text FROM ({ITEMS})) b LEFT JOIN (SELECT DISTINCT lang, role, text FROM ({ITEMS}) WHERE doc_id % 3 = 0) m ON m.lang = b.lang AND m.role = b.role AND m.text = b.text GROUP BY ALL", "blocks")
def j3_translation_memory(spark: SparkSession, d: str) -> DataFrame:
    """Every third document is translated into a memory, then all items are looked up in it by source, target, role and text."""
    b = blocks(spark, d)
    known = R.memory(spark, new_path(spark, "memory"))
    R.remember(b.filter(F.col("doc_id") % 3 == 0), "zh", known, "first")
    items = b.filter(R.translatable(b)).select("lang", F.lit("zh").alias("target"), R.role(b).alias("role"), R.protected(F.col("text")).alias("text")).distinct()
    return R.from_memory(items, known).groupBy("lang", "role").agg(F.count("*").alias("items"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@add(f"""SELECT run, lang, count(*) AS added FROM (SELECT lang, role, text, CASE WHEN min(doc_id % 3) = 0 THEN 'a' ELSE 'b' END AS run FROM ({ITEMS}) GROUP BY ALL) GROUP BY ALL""", "blocks")
def j3_j4_memory_between_runs(spark: SparkSession, d: str) -> DataFrame:
    """What each of three runs adds to a memory: every third document, all documents, all documents again (nothing)."""
    b = blocks(spark, d)
    known = R.memory(spark, new_path(spark, "memory"))
    for name, rows in (("a", b.filter(F.col("doc_id") % 3 == 0)), ("b", b), ("c", b)):
        R.remember(rows, "zh", known, name)
    added = [known.batch(name).groupBy("lang").agg(F.count("*").alias("added")).select(F.lit(name).alias("run"), "lang", "added") for name in "abc"]
    return added[0].unionByName(added[1]).unionByName(added[2])


ONCE = f"SELECT doc_id, block_index, {ROLE} AS role, CASE WHEN {GO} THEN CASE WHEN lang = 'en' THEN text ELSE concat('[en: ', text, ']') END ELSE '' END AS translated FROM blocks"


@add(ONCE, "blocks")
def j4_b6_translate_once(spark: SparkSession, d: str) -> DataFrame:
    return R.translate_once(blocks(spark, d), "en").select(*KEYS, "role", "translated")


@add(ONCE, "blocks")
def b2_batch_translate(spark: SparkSession, d: str) -> DataFrame:
    """The same through the pluggable translator in Python, batch by batch."""
    translate = lambda items: R.translated(items, "lang", "target", R.TRANSLATORS["mock"])
    return R.translate_once(blocks(spark, d), "en", translate).select(*KEYS, "role", "translated")


@add(ONCE, "blocks")
def b3_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A translator that fails on batches: every text is tried again alone."""

    def flaky(texts: list[str], source: str, target: str) -> list[str]:
        if len(texts) > 1:
            raise RuntimeError("no batches today")
        return R.TRANSLATORS["mock"](texts, source, target)

    return R.translate_once(blocks(spark, d), "en", lambda items: R.translated(items, "lang", "target", flaky)).select(*KEYS, "role", "translated")


@add(
    f"SELECT doc_id AS task_id, page_num AS page_number, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 2 END AS attempts, NOT bad AS is_billed FROM (SELECT doc_id, page_num, bool_or(length(text) % 97 = 0) AS bad FROM blocks WHERE {GO} GROUP BY ALL)",
    "blocks",
)
def b3_w12_page_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Pages after a translator that never takes some texts, nor a batch that holds one: what the log of its attempts says of them."""

    def choosy(texts: list[str], source: str, target: str) -> list[str]:
        if any(len(t) % 97 == 0 for t in texts):
            raise ValueError("not this one")
        return R.TRANSLATORS["mock"](texts, source, target)

    b = blocks(spark, d)
    keys = ["lang", "target", "role", "text"]
    items = written(b.filter(R.translatable(b)).select(F.col("doc_id").alias("task_id"), F.col("page_num").alias("page_number"), "lang", F.lit("en").alias("target"), R.role(b).alias("role"), R.protected(F.col("text")).alias("text")), "items")
    _, log = R.with_fallback(items.select(*keys).distinct(), "lang", "target", choosy)
    pages = L.page_outcomes(R.page_attempts(items, log, ["task_id", "page_number"], keys))
    # how often a page without such a text was tried depends on what shared its batches
    return pages.withColumn("attempts", F.when(F.col("status") == "failed", F.col("attempts")))


@add(f"SELECT doc_id, block_index, CASE WHEN lang = 'fr' THEN text ELSE concat('[fr: ', text, ']') END AS translated FROM blocks", "blocks")
def b4_mock_translator(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select(*KEYS, R.mock(F.col("text"), F.col("lang"), F.lit("fr")).alias("translated"))


@add(
    f"""SELECT doc_id, page_num, it.block_index AS block_index, it.n AS n_chars, batch FROM (SELECT doc_id, page_num, unnest(f.ids) AS batch, unnest(items) AS it FROM (
 SELECT doc_id, page_num, items, list_reduce(list_transform(items, lambda i: {{'batch': 0, 'blocks': 0, 'chars': i.n, 'ids': [0]}}), lambda a, x: {{
   'batch': a.batch + CASE WHEN a.blocks + 1 > 0 AND (a.blocks >= 4 OR a.chars + x.chars > 800) THEN 1 ELSE 0 END,
   'blocks': CASE WHEN a.blocks >= 4 OR a.chars + x.chars > 800 THEN 1 ELSE a.blocks + 1 END,
   'chars': CASE WHEN a.blocks >= 4 OR a.chars + x.chars > 800 THEN x.chars ELSE a.chars + x.chars END,
   'ids': a.ids || [a.batch + CASE WHEN a.blocks >= 4 OR a.chars + x.chars > 800 THEN 1 ELSE 0 END]}},
   {{'batch': 0, 'blocks': 0, 'chars': 0, 'ids': []::INT[]}}) AS f
 FROM (SELECT doc_id, page_num, list({{'block_index': block_index, 'n': length(text)}} ORDER BY block_index) AS items FROM blocks WHERE {GO} GROUP BY doc_id, page_num)))""".replace("a.blocks + 1 > 0 AND (a.blocks >= 4 OR a.chars + x.chars > 800)", "a.blocks > 0 AND (a.blocks >= 4 OR a.chars + x.chars > 800)").replace("CASE WHEN a.blocks >= 4 OR a.chars + x.chars > 800", "CASE WHEN a.blocks > 0 AND (a.blocks >= 4 OR a.chars + x.chars > 800)"),
    "blocks",
)
def b1_batches(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return R.batches(b.filter(R.translatable(b)), ["doc_id", "page_num"], "block_index", most_blocks=4, most_chars=800)


@add(
    f"""SELECT doc_id, page_num, count(*) AS blocks, count(DISTINCT text) AS unique_blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks WHERE {GO} GROUP BY doc_id, page_num""",
    "blocks",
)
def a20_batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.filter(R.translatable(b)).groupBy("doc_id", "page_num").agg(F.count("*").alias("blocks"), F.countDistinct("text").alias("unique_blocks"), F.sum(F.length("text")).alias("chars"))


@add("SELECT doc_id, page_num, string_agg(trim(translated), chr(10) ORDER BY block_index) AS translated FROM quality_pairs WHERE trim(translated) <> '' GROUP BY doc_id, page_num", "quality_pairs")
def a11_page_text(spark: SparkSession, d: str) -> DataFrame:
    return R.page_texts(X.quality_pairs(spark, d), ["doc_id", "page_num"], "block_index")


@add(f"SELECT doc_id, page_num, string_agg(format('=== {{}} ===\nOriginal: {{}}\nTranslation: {{}}', block_index, text, translated), chr(10) ORDER BY block_index) AS export FROM quality_pairs GROUP BY doc_id, page_num", "quality_pairs")
def s8_bilingual_text(spark: SparkSession, d: str) -> DataFrame:
    entry = F.format_string("=== %d ===\nOriginal: %s\nTranslation: %s", "block_index", "text", "translated")
    rows = X.quality_pairs(spark, d).groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_index", entry.alias("e")))).alias("l"))
    return rows.select("doc_id", "page_num", F.array_join(F.transform("l", lambda x: x["e"]), "\n").alias("export"))


@add("SELECT task_id, page_number, (row_number() OVER (PARTITION BY task_id ORDER BY page_number) - 1) // 2 AS batch FROM task_pages", "task_pages")
def s9_export_batches(spark: SparkSession, d: str) -> DataFrame:
    return R.export_batches(X.task_pages(spark, d), ["task_id"], "page_number", 2).select("task_id", "page_number", "batch")


@add(
    """SELECT doc_id::VARCHAR AS task_id, batch, count(*) AS pages, string_agg(translated, chr(10) ORDER BY page_num) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) // 2 AS batch FROM (
 SELECT doc_id, page_num, string_agg(trim(translated), chr(10) ORDER BY block_index) AS translated FROM quality_pairs WHERE trim(translated) <> '' GROUP BY doc_id, page_num)) GROUP BY doc_id, batch""",
    "quality_pairs",
)
def s9_written_exports(spark: SparkSession, d: str) -> DataFrame:
    """Page texts of every document in batches of two pages, written as exports and read back."""
    pages = R.page_texts(X.quality_pairs(spark, d), ["doc_id", "page_num"], "block_index").withColumn("task_id", F.col("doc_id").cast("string"))
    path = new_path(spark, "exports")
    G.write_export(R.export_texts(R.export_batches(pages, ["task_id"], "page_num", 2), ["task_id"], "page_num"), path)
    return G.read_export(spark, path)


GLYPHS = "len(regexp_extract_all(translated, '\\?'))"
SUSPICIOUS = f"CASE WHEN {GLYPHS} >= 6 AND {GLYPHS}::DOUBLE / greatest(length(translated), 1) >= 0.03::DOUBLE THEN {GLYPHS} ELSE 0 END"
LENGTHS = "length(regexp_replace({0}, '\\s', '', 'g'))"
# The number rules: characters as read, tokens, and the spellings under which a number counts as kept.
READ = T.compatible()[0]
DIGITS = f"replace(replace(translate({{0}}, '{"".join(READ)}', '{"".join(READ.values())}'), '≤', '<='), '≥', '>=')"
NUMBER = "\\d+(?:\\s?\\d{3})*(?:[.,]\\d+)?"
TOKEN_PATTERNS = [f"(?:<=|>=|[<>])\\s*{NUMBER}\\s*%?", "\\d+(?:[.,]\\d+)?\\s*%", "%\\s*\\d+(?:[.,]\\d+)?", "\\d+(?:[.,]\\d+)?\\s*-\\s*\\d+(?:[.,]\\d+)?\\s*%?"]
SPELLED = f"(?:{NUMBER}|\\d+(?:[.,]\\d+)*)"
VALUE = """CASE WHEN len(p) = 1 THEN p[1] WHEN len(p) > 2 THEN CASE WHEN len(list_filter(p[2:], lambda y: length(y) <> 3)) = 0 THEN array_to_string(p, '') ELSE array_to_string(p[:-2], '') || '.' || p[-1] END
 WHEN length(p[2]) = 3 AND p[1] NOT IN ('', '0') THEN p[1] || p[2] ELSE p[1] || '.' || p[2] END"""


def number_keys_sql(text: str) -> str:
    """A list of the spellings of the numbers in ``text``, an expression in the form of DIGITS."""
    compact = f"regexp_replace({text}, '\\s', '', 'g')"
    whole = f"regexp_replace(regexp_replace({compact}, '(\\d),(\\d)', '\\1.\\2', 'g'), '(\\d),(\\d)', '\\1.\\2', 'g')"
    found = f"list_concat(regexp_extract_all({text}, '(?:<=|>=|[<>])?\\s*{SPELLED}\\s*%?'), regexp_extract_all({text}, '(?:<=|>=|[<>])?\\s*%\\s*{SPELLED}'))"
    value = f"list_transform([regexp_split_to_array(regexp_replace(m, '[^\\d.,]', '', 'g'), '[.,]')], lambda p: {VALUE})"
    sign = "regexp_extract(m, '^(<=|>=|[<>])', 1)"
    spelled = f"[v, CASE WHEN contains(m, '%') THEN v || '%' END, CASE WHEN contains(m, '%') THEN '%' || v END, {sign} || v, CASE WHEN contains(m, '%') THEN {sign} || v || '%' END, CASE WHEN contains(m, '%') THEN {sign} || '%' || v END]"
    keys = f"flatten(list_transform({found}, lambda m: flatten(list_transform({value}, lambda v: CASE WHEN v = '' THEN [] ELSE {spelled} END))))"
    return f"list_filter(list_concat([{whole}], {keys}), lambda k: k <> '')"


#: Lost tokens of each block, least first.
LOST = f"""SELECT doc_id, page_num, block_index, list_sort(list(token)) AS tokens FROM (
 SELECT *, list_filter(string_split(token, '-'), lambda y: trim(y) <> '') AS ends FROM (
  SELECT doc_id, page_num, block_index, there, unnest(list_distinct(list_transform(list_concat({", ".join(f"regexp_extract_all(s, '{p}')" for p in TOKEN_PATTERNS)}), lambda y: regexp_replace(y, '\\s', '', 'g')))) AS token FROM (
   SELECT doc_id, page_num, block_index, s, {number_keys_sql("t")} AS there FROM (SELECT doc_id, page_num, block_index, {DIGITS.format("text")} AS s, {DIGITS.format("translated")} AS t FROM quality_pairs WHERE trim(translated) <> '') WHERE regexp_matches(s, '[<>%]|\\d\\s*-\\s*\\d'))))
 WHERE CASE WHEN contains(token, '-') AND len(ends) = 2 THEN NOT (list_has_any({number_keys_sql("ends[1]")}, there) AND list_has_any({number_keys_sql("ends[2]")}, there)) ELSE NOT list_has_any({number_keys_sql("token")}, there) END GROUP BY ALL"""
WARNINGS = f"""SELECT doc_id, page_num, block_index, lang, unnest(CASE WHEN trim(translated) = '' THEN CASE WHEN trim(text) <> '' AND NOT {NUMERIC} THEN [{{'code': 'missing_translation', 'n': 0}}] ELSE [] END
 ELSE list_filter([CASE WHEN {SUSPICIOUS} > 0 THEN {{'code': 'suspicious_glyphs', 'n': {SUSPICIOUS}}} END, CASE WHEN {MARKER} <> '' AND NOT starts_with(ltrim(translated), {MARKER}) THEN {{'code': 'missing_marker', 'n': 0}} END, CASE WHEN tokens IS NOT NULL THEN {{'code': 'missing_numeric_symbol', 'n': 0}} END,
 CASE WHEN {LENGTHS.format("text")} >= 30 AND {LENGTHS.format("translated")} > {LENGTHS.format("text")} * 4 AND NOT {STOP} THEN {{'code': 'length_ratio_high', 'n': 0}} END], lambda w: w IS NOT NULL) END) AS w FROM quality_pairs LEFT JOIN ({LOST}) USING (doc_id, page_num, block_index)"""


@add(f"SELECT doc_id, page_num, block_index, w.code AS code, CAST(w.n AS INT) AS n FROM ({WARNINGS})", "quality_pairs")
def f13_block_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.warning_rows(X.quality_pairs(spark, d), ["doc_id", "page_num", "block_index"])
    return rows.select("doc_id", "page_num", "block_index", "code", F.coalesce("count", F.lit(0)).alias("n"))


PAGES = f"""SELECT p.*, coalesce(g, 0) AS suspicious_glyphs, expected_blocks > 0 AND translated_blocks = 0 AS blank_page, coalesce(w, 0) + CASE WHEN expected_blocks > 0 AND translated_blocks = 0 THEN 1 ELSE 0 END AS warnings FROM
 (SELECT doc_id, page_num, count(*) AS blocks, count(*) FILTER (trim(text) <> '' AND NOT {NUMERIC}) AS expected_blocks, count(*) FILTER (trim(translated) <> '') AS translated_blocks FROM quality_pairs GROUP BY doc_id, page_num) p
 LEFT JOIN (SELECT doc_id, page_num, CAST(sum(w.n) AS BIGINT) AS g, count(*) AS w FROM ({WARNINGS}) GROUP BY doc_id, page_num) x USING (doc_id, page_num)"""


@add(f"SELECT *, CASE WHEN warnings > 0 THEN 'warn' ELSE 'ok' END AS status FROM ({PAGES})", "quality_pairs")
def a13_a14_page_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.page_report(X.quality_pairs(spark, d), ["doc_id", "page_num"])


@add(f"SELECT doc_id, block_index, tokens FROM ({LOST})", "quality_pairs")
def f12_lost_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose translation lost a number, percentage, range or comparison."""
    rows = Q.warning_rows(X.quality_pairs(spark, d), ["doc_id", "block_index"]).filter("code = 'missing_numeric_symbol'")
    return rows.select("doc_id", "block_index", F.array_sort("tokens").alias("tokens"))


SIZES = "SELECT DISTINCT doc_id, 1000 AS source_bytes, n_chars + 500 AS export_bytes FROM documents"


@add(
    f"""SELECT doc_id, pages, total AS warnings, 'warn' AS status, code, n FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id)::BIGINT AS total FROM (
  SELECT doc_id, w.code AS code, count(*) AS n FROM ({WARNINGS}) GROUP BY ALL
  UNION ALL SELECT doc_id, 'blank_translated_page', count(*) FILTER (blank_page) FROM ({PAGES}) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'export_size_ratio_high', 1 FROM ({SIZES}) WHERE round(export_bytes / 1000::DOUBLE, 3) > 2.2::DOUBLE) WHERE n > 0) JOIN (SELECT doc_id, count(*) AS pages FROM (SELECT DISTINCT doc_id, page_num FROM quality_pairs) GROUP BY doc_id) USING (doc_id)
 UNION ALL SELECT doc_id, count(*), 0, 'ok', NULL, NULL FROM ({PAGES}) JOIN ({SIZES}) USING (doc_id) GROUP BY doc_id HAVING sum(warnings) = 0 AND max(round(export_bytes / 1000::DOUBLE, 3)) <= 2.2::DOUBLE""",
    "quality_pairs",
)
def a13_task_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of each document, numbers and sizes included, a row for each code."""
    sizes = X.table(spark, d, "documents").select("doc_id", F.lit(1000).alias("source_bytes"), (F.col("n_chars") + 500).alias("export_bytes")).distinct()
    whole = Q.report(X.quality_pairs(spark, d), ["doc_id"], ["page_num"], sizes)
    return whole.select("doc_id", "pages", "warnings", "status", F.explode_outer("warning_counts").alias("code", "n"))


@add("SELECT id, file_size AS source_bytes, file_size * (id_n % 4) AS export_bytes, round(file_size * (id_n % 4) / greatest(file_size, 1)::DOUBLE, 3) AS size_ratio, file_size * (id_n % 4) / greatest(file_size, 1)::DOUBLE > 2.2::DOUBLE AS size_warning FROM (SELECT *, total_pages AS id_n FROM files)", "files")
def a15_export_sizes(spark: SparkSession, d: str) -> DataFrame:
    f = X.files(spark, d).select("id", F.col("file_size").alias("source_bytes"), (F.col("file_size") * (F.col("total_pages") % 4)).alias("export_bytes"))
    return Q.with_size_warning(f)


@add("SELECT doc_id, page_num, count(*) AS blocks, count(*) FILTER (trim(translated) <> '') AS translated, 1 - count(*) FILTER (trim(translated) <> '') / count(*)::DOUBLE AS skip_ratio FROM quality_pairs GROUP BY doc_id, page_num", "quality_pairs")
def a16_skip_ratio(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(T.stripped(F.col("translated")) != "")
    return X.quality_pairs(spark, d).groupBy("doc_id", "page_num").agg(F.count("*").alias("blocks"), done.alias("translated"), (1 - done / F.count("*")).alias("skip_ratio"))


@add("SELECT doc_id, count(*) FILTER (block_index % 3 = 0) AS emoji_blocks FROM blocks GROUP BY doc_id", "blocks")
def a17_emoji_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("block_index") % 3 == 0, F.concat("text", F.lit("\U0001f600"))).otherwise(F.col("text"))
    return blocks(spark, d).groupBy("doc_id").agg(F.count_if(T.has_emoji(t)).alias("emoji_blocks"))


@add(f"SELECT lang, CASE WHEN bool_or(blank_page) THEN 'fail' WHEN sum(warnings) > 0 THEN 'warn' ELSE 'ok' END AS outcome, count(*) AS pages FROM ({PAGES}) JOIN (SELECT doc_id, any_value(lang) AS lang FROM documents GROUP BY doc_id) USING (doc_id) GROUP BY lang", "quality_pairs")
def a18_run_outcome(spark: SparkSession, d: str) -> DataFrame:
    pages = Q.page_report(X.quality_pairs(spark, d), ["doc_id", "page_num", "lang"])
    outcome = F.when(F.bool_or("blank_page"), "fail").when(F.sum("warnings") > 0, "warn").otherwise("ok")
    return pages.groupBy("lang").agg(outcome.alias("outcome"), F.count("*").alias("pages"))


@add("SELECT doc_id, page_num, list_sort(list_filter(['latin', CASE WHEN bool_or(block_index % 3 = 1) THEN 'cjk' END], lambda x: x IS NOT NULL)) AS scripts, CASE WHEN bool_or(block_index % 3 = 1) THEN 'universal' ELSE 'latin' END AS font FROM blocks GROUP BY doc_id, page_num HAVING bool_or(regexp_matches(text, '[a-zA-ZÀ-ÿ]')) AND NOT bool_or(regexp_matches(text, '[Ā-ɏ]'))", "blocks")
def a19_page_scripts(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("block_index") % 3 == 1, F.concat("text", F.lit("中"))).otherwise(F.col("text"))
    pages = blocks(spark, d).groupBy("doc_id", "page_num").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.scripts(t))))).alias("scripts"))
    pages = pages.filter(F.array_contains("scripts", "latin") & ~F.array_contains("scripts", "latin_extended"))
    return pages.withColumn("font", T.font_route(F.col("scripts")))


@add(
    """SELECT r.doc_id, r.page_num, r.token, CASE WHEN p.doc_id IS NULL THEN 'missing_page' ELSE 'missing_token' END AS problem FROM (SELECT doc_id, page_num, unnest(['the', 'de']) AS token FROM (SELECT doc_id, 0 AS page_num FROM documents UNION SELECT doc_id, 1 FROM documents)) r
 LEFT JOIN (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY block_index) AS t FROM blocks GROUP BY doc_id, page_num) p ON p.doc_id = r.doc_id AND p.page_num = r.page_num WHERE p.doc_id IS NULL OR NOT contains(t, token)""",
    "blocks",
)
def j17_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select("doc_id").distinct()
    required = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_num")).select("doc_id", "page_num", F.explode(F.array(F.lit("the"), F.lit("de"))).alias("token"))
    pages = R.page_texts(blocks(spark, d).withColumn("translated", F.col("text")), ["doc_id", "page_num"], "block_index").withColumnRenamed("translated", "text")
    return Q.missing_tokens(required, pages, ["doc_id", "page_num"])


@add(f"SELECT lang, {ROLE} AS role, sha256(concat_ws(chr(1), lang, 'zh', {ROLE}, text)) AS key, count(*) AS n FROM blocks GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY lang, text"), "blocks")
def f19_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).withColumn("role", R.role(blocks(spark, d)))
    return b.groupBy("lang", "role", "text").agg(F.count("*").alias("n")).select("lang", "role", R.cache_key(F.col("lang"), F.lit("zh"), F.col("role"), F.col("text")).alias("key"), "n")


@add()
def f17_f18_batch_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of batches, replies in a code fence with every fifth one short, parsed again."""
    b = blocks(spark, d)
    go = b.filter(R.translatable(b))
    group = ["doc_id", "page_num", "batch"]
    packed = R.batches(go, ["doc_id", "page_num"], "block_index").join(go, ["doc_id", "page_num", "block_index"])
    from pyspark.sql.window import Window

    packed = packed.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("block_index")) - 1)
    items = R.payloads(packed, group, "at")
    short = F.col("n_items") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    replies = items.select(*group, short.alias("n_items"), F.concat(F.lit("```json\n"), F.col("payload"), F.lit("\n```")).alias("reply"))
    return R.parsed_replies(replies).select(*group, F.size("texts").alias("n_texts"), F.col("texts").isNotNull().alias("parsed"))


@add()
def a12_page_results(spark: SparkSession, d: str) -> DataFrame:
    """Page documents with their blocks nested."""
    return R.page_results(X.quality_pairs(spark, d), ["doc_id", "page_num"], "block_index")


@add(
    f"""SELECT lang, count(*) AS pages, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(expected_blocks) AS BIGINT) AS expected_blocks, CAST(sum(warnings) AS BIGINT) AS warnings FROM ({PAGES}) JOIN (SELECT doc_id, any_value(lang) AS lang FROM documents GROUP BY doc_id) USING (doc_id) GROUP BY lang""",
    "quality_pairs",
)
def translation_quality_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Headline: audited pages of the damaged mock translation, by language."""
    pages = Q.page_report(X.quality_pairs(spark, d), ["doc_id", "page_num", "lang"])
    return pages.groupBy("lang").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("blocks", "expected_blocks", "warnings")])


@add(f"SELECT doc_id, block_index, CASE WHEN rest = '' THEN '' ELSE concat(marker, rest) END AS translated FROM (SELECT *, trim(regexp_replace(substr(ltrim(text), length(marker) + 1), '\\s+', ' ', 'g')) AS rest FROM (SELECT *, {MARKER} AS marker FROM blocks)) WHERE NOT starts_with(rest, marker) OR marker = ''", "blocks")
def f11_normalized_translation(spark: SparkSession, d: str) -> DataFrame:
    """A translation that lost its list marker and gained a line break gets the marker back."""
    source = F.col("text")
    marker = T.leading_marker(source)
    rest = F.substr(F.ltrim(source), F.length(marker) + 1)
    rows = blocks(spark, d).filter((marker == "") | ~F.startswith(T.normalized(rest), marker))
    return rows.select(*KEYS, R.normalized_translation(F.concat(rest, F.lit("\n")), source).alias("translated"))


def number_keys_of(b: DataFrame) -> DataFrame:
    reply = F.when(F.col("block_index") % 2 == 0, F.col("text")).otherwise("none")
    return b.select(*KEYS, (F.size(T.numeric_tokens(F.col("text"))) > 0).alias("has_percent"), (F.size(T.lost_numbers(F.col("text"), reply)) == 0).alias("kept"))


@add("SELECT doc_id, block_index, block_index % 3 < 2 AS has_percent, block_index % 2 = 0 OR block_index % 3 = 2 AS kept FROM blocks", "blocks")
def u3_number_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every block with its own numbers replaced by a percentage, a range or none, looked up among the keys of a translation that has them in every second block."""
    given = X.cases(F.col("block_index") % 3, {0: " 12 %", 1: " 3-5"}, "")
    b = blocks(spark, d).withColumn("text", F.concat(F.regexp_replace("text", "[\\p{N}%<>=≤≥]", ""), given))
    return number_keys_of(b)


@add()
def u3_number_keys_all(spark: SparkSession, d: str) -> DataFrame:
    """As u3_number_keys, over all blocks, with every kind of number."""
    return number_keys_of(blocks(spark, d))
