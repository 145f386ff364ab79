"""Translation of blocks: eligibility, once for each distinct text, in bounded batches, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.keyed import KeyedTable
from ..sources.scratch import written
from .quality import UNTRANSLATED_ROLES, flag

MOST_BLOCKS, MOST_CHARS = 20, 8000
#: Pages of a translated and of a bilingual export's batch.
EXPORT_PAGES, BILINGUAL_EXPORT_PAGES = 100, 50
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
REFERENCE = f"[{SUPERSCRIPTS}]+(?:[,.\\-–—][{SUPERSCRIPTS}]+)*"
Translator = Callable[[list[str], str, str], list[str]]
TRANSLATORS: dict[str, Translator] = {
    "mock": lambda texts, source, target: [t if source == target else f"[{target}: {t}]" for t in texts],
    "echo": lambda texts, source, target: list(texts),
}


def translatable(df: DataFrame) -> Column:
    """Blocks to translate: text, no picture, chart, table, header or formula, of a role that is read."""
    out = (F.col("type") == "text") if "type" in df.columns else F.lit(True)
    for name in ("is_chart_text", "is_table_text", "is_header_footer_metadata"):
        out = out & ~flag(df, name)
    if "layout_role" in df.columns:
        out = out & ~F.coalesce(F.col("layout_role").isin(UNTRANSLATED_ROLES), F.lit(False))
    return out & ~T.is_blank(F.col("text")) & ~T.is_emoji_only(F.col("text")) & ~T.is_formula(F.col("text"))


def role(df: DataFrame) -> Column:
    """The block's layout role; a body block is a list item, caption, heading or body by its text."""
    lines = F.size(F.filter("lines", lambda x: ~T.is_blank(x["text"]))) if "lines" in df.columns else F.lit(1)

    def by_text(text: Column) -> Column:
        words = T.count_of(text, "[\\p{L}\\p{N}_]+(?:[-/][\\p{L}\\p{N}_]+)*")
        heading = (text != "") & (F.length(text) <= 140) & (lines == 1) & ~T.ends_with_stop(text) & (words <= 16)
        return F.when(T.leading_marker(text) != "", "list_item").when(text.rlike("(?i)^(figure|fig\\.?|table)\\s+[\\p{L}\\p{N}_]+"), "caption").when(heading, "heading").otherwise("body")

    body = T.let(T.stripped(F.coalesce("text", F.lit(""))), by_text)
    given = F.coalesce("layout_role", F.lit("body")) if "layout_role" in df.columns else F.lit("body")
    return F.when(given != "body", given).otherwise(body)


def references(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({REFERENCE})"), F.lit(1))


def protected(text: Column) -> Column:
    """Superscript reference markers as [[REFn]], numbered."""
    plain = F.coalesce(text, F.lit(""))
    numbered = F.transform(F.split(plain, REFERENCE, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("[[REF"), (i - 1).cast("string"), F.lit("]]"), p)))
    return F.when(plain.rlike(f"[{SUPERSCRIPTS}]"), F.array_join(numbered, "")).otherwise(plain)


def restored(translated: Column, source: Column) -> Column:
    """The source's markers for their tokens; those that got lost go before the closing punctuation."""
    markers = references(source)
    tokens = "(?i)\\[\\[\\s*REF\\s*(\\d+)\\s*\\]\\]"
    numbers = F.regexp_extract_all(translated, F.lit(tokens), F.lit(1))
    given = F.regexp_extract_all(translated, F.lit(f"({tokens})"), F.lit(1))
    # a token past the last marker stays as it is
    values = F.zip_with(numbers, given, lambda n, g: F.coalesce(F.try_element_at(markers, F.least(n.cast("long"), F.lit(99_999)).cast("int") + 1), g))
    parts = F.split(translated, tokens, -1)
    back = F.array_join(F.zip_with(parts, values, lambda p, v: F.concat(F.coalesce(p, F.lit("")), F.coalesce(v, F.lit("")))), "")

    def lost(text: Column) -> Column:
        # each marker found uses up one occurrence
        state = F.struct(text.alias("rest"), F.lit("").alias("lost"))

        def step(s: Column, m: Column) -> Column:
            at = F.instr(s["rest"], m)
            cut = F.concat(F.substr(s["rest"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.substr(s["rest"], at + F.length(m)))
            return F.when(at > 0, F.struct(cut.alias("rest"), s["lost"].alias("lost"))).otherwise(F.struct(s["rest"].alias("rest"), F.concat(s["lost"], m).alias("lost")))

        return F.aggregate(markers, state, step, lambda s: s["lost"])

    def appended(text: Column) -> Column:
        tail = "(?U)[,.;:!?，。；：！？、\\s]+$"
        return F.concat(F.regexp_replace(text, tail, ""), lost(text), F.regexp_extract(text, f"({tail})", 1))

    return F.when(F.size(markers) == 0, translated).otherwise(F.transform(F.array(back), appended)[0])


def normalized_translation(translated: Column, source: Column, composed: bool = True) -> Column:
    """Sanitised, markers restored, and the source's list marker put back in front."""
    clean = restored(T.sanitized(translated, composed), source)
    marker = T.leading_marker(source)
    return F.transform(F.array(clean), lambda x: F.when((marker != "") & (x != "") & ~F.startswith(x, marker), F.concat(marker, x)).otherwise(x))[0]


def cache_key(source: Column, target: Column, role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", source, target, role, protected(text)), 256)


def looked_up(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``known``, one row a key, where all keys are equal; null is equal to null."""
    other = known.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in known.columns])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def memory_lookup(items: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with what a translation-memory table with one row a key says of them, and ``hit`` (false for a miss)."""
    return looked_up(items, memory.withColumn("hit", F.lit(True)), keys).withColumn("hit", F.coalesce("hit", F.lit(False)))


def batches(df: DataFrame, group: list[str], order: str, text: str = "text", most_blocks: int = MOST_BLOCKS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``batch`` of each block: a page's blocks in order, a new batch at the limit of blocks or of characters."""
    items = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.length(text).alias("n")))).alias("_items"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("blocks"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        flush = (s["blocks"] > 0) & ((s["blocks"] >= most_blocks) | (s["chars"] + x["n"] > most_chars))
        batch = s["batch"] + flush.cast("int")
        return F.struct(batch.alias("batch"), F.when(flush, 1).otherwise(s["blocks"] + 1).alias("blocks"), F.when(flush, x["n"]).otherwise(s["chars"] + x["n"]).alias("chars"), F.concat(s["ids"], F.array(batch)).alias("ids"))

    packed = items.withColumn("_ids", F.aggregate("_items", start, step, lambda s: s["ids"]))
    each = F.explode(F.arrays_zip(F.col("_items").alias("item"), F.col("_ids").alias("batch")))
    return packed.select(*group, each.alias("_e")).select(*group, F.col(f"_e.item.{order}").alias(order), F.col("_e.item.n").alias("n_chars"), F.col("_e.batch").alias("batch"))


def payloads(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """A JSON array of items for each batch: id, text, role, leadingMarker, endsWithSentencePunctuation."""
    text = F.coalesce("text", F.lit(""))
    item = F.struct(F.col(order).alias("id"), protected(text).alias("text"), role(df).alias("role"), T.leading_marker(text).alias("leadingMarker"), T.ends_with_stop(text).alias("endsWithSentencePunctuation"))
    return df.select(*group, item.alias("item")).groupBy(*group).agg(F.to_json(F.array_sort(F.collect_list("item"))).alias("payload"), F.count("*").alias("n_items"))


def parsed_replies(df: DataFrame) -> DataFrame:
    """Replies with columns reply, n_items: ``texts`` by id, or null if the reply is no array of just as many known ids."""
    body = F.regexp_extract("reply", "(?s)\\[.*\\]", 0)
    items = F.filter(F.coalesce(F.from_json(body, "array<struct<id:int,text:string>>"), F.array().cast("array<struct<id:int,text:string>>")), lambda x: x["id"].isNotNull() & x["text"].isNotNull())
    ids = F.array_distinct(F.transform(items, lambda x: x["id"]))
    known = F.forall(ids, lambda i: (i >= 0) & (i < F.col("n_items")))
    good = (F.size(ids) == F.col("n_items")) & known
    # of two texts for an id the later counts
    return df.withColumn("texts", F.when(good, F.transform(F.sort_array(ids), lambda i: F.element_at(F.filter(items, lambda x: x["id"] == i), -1)["text"])))


def attempted(items: DataFrame, source: str, target: str, translator: Translator, number: int = 1, batch: int = MOST_BLOCKS, chars: int = MOST_CHARS, column: str = "text") -> DataFrame:
    """One attempt at all ``items``: with ``translated``, ``attempt``, ``status`` (completed or failed) and ``error``.

    The translator, a function of (texts, source, target), gets bounded batches in each partition. A batch that raises, or comes
    back with another number of texts, fails as a whole; a text that comes back null fails alone.
    """
    added = {"translated": "string", "attempt": "int", "status": "string", "error": "string"}

    def once(texts: list[str], a: str, b: str) -> tuple[list[str | None], str | None]:
        try:
            out = list(translator(texts, a, b))
        except Exception as e:  # a translator may fail in any way
            return [None] * len(texts), f"{type(e).__name__}: {e}"
        return (out, None) if len(out) == len(texts) else ([None] * len(texts), f"{len(out)} texts for {len(texts)}")

    def cut(texts: pd.Series) -> Iterator[list[int]]:
        held: list[int] = []
        n = 0
        for i, t in texts.items():
            if held and (len(held) >= batch or n + len(t or "") > chars):
                yield held
                held, n = [], 0
            held.append(i)
            n += len(t or "")
        if held:
            yield held

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.reset_index(drop=True)
            done: list[str | None] = [None] * len(f)
            errors: list[str | None] = [None] * len(f)
            for (a, b), part in f.groupby([source, target], dropna=False, sort=False):
                for held in cut(part[column]):
                    texts, error = once([part[column][k] for k in held], a, b)
                    for k, x in zip(held, texts, strict=True):
                        done[k], errors[k] = x, error or (None if x is not None else "no text")
            yield f.assign(translated=done, attempt=number, status=["failed" if e else "completed" for e in errors], error=errors)

    return items.mapInPandas(run, items.withColumns({c: F.lit(None).cast(k) for c, k in added.items()}).schema)


def with_fallback(
    items: DataFrame, source: str, target: str, translator: Translator, batch: int = MOST_BLOCKS, chars: int = MOST_CHARS, column: str = "text", retries: int = 1
) -> tuple[DataFrame, DataFrame]:
    """``items`` with ``translated`` (null where every attempt failed), and the log: a row for each item and attempt.

    What the first pass failed on is a table; each retry is a pass of its own over it, spread over all
    partitions, one item a batch, so that one task's bad batches hold up no other and a lost executor repeats one pass only.
    """
    spark = items.sparkSession
    runs = [written(attempted(items, source, target, translator, 1, batch, chars, column), "translate-attempt")]
    for number in range(2, retries + 2):
        failed = runs[-1].filter("status = 'failed'").select(*items.columns)
        if failed.isEmpty():
            break
        spread = failed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        runs.append(written(attempted(spread, source, target, translator, number, 1, chars, column), "translate-attempt"))
    last = [r.filter("status = 'completed'") for r in runs[:-1]] + runs[-1:]
    return reduce(DataFrame.unionByName, last).select(*items.columns, "translated"), reduce(DataFrame.unionByName, runs)


def translated(items: DataFrame, source: str, target: str, translator: Translator, batch: int = MOST_BLOCKS, chars: int = MOST_CHARS, column: str = "text") -> DataFrame:
    """``items`` with ``translated``: in bounded batches, then what failed once more, one by one; a text that fails alone stays null."""
    return with_fallback(items, source, target, translator, batch, chars, column)[0]


def page_attempts(items: DataFrame, log: DataFrame, page: list[str], keys: list[str]) -> DataFrame:
    """Attempts of pages from those of their items: ``items`` has ``page`` and the log's ``keys``, null equal to null.

    A page's attempt failed if any of its items did in that attempt; items that were through before have no part in it.
    """
    tried = log.select(*[F.col(k).alias(f"_{k}") for k in keys], "attempt", "status").withColumn("_hash", F.xxhash64(*[f"_{k}" for k in keys]))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.xxhash64(*keys) == F.col("_hash"))
    met = items.join(tried, on)
    return met.groupBy(*page, "attempt").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("completed").alias("status"))


def mock(text: Column, source: Column, target: Column) -> Column:
    """The mock translator as an expression."""
    return F.when(source.eqNullSafe(target), text).otherwise(F.concat(F.lit("["), F.coalesce(target, F.lit("")), F.lit(": "), text, F.lit("]")))


#: Columns of a translation memory, and what its hash is of.
ITEM = ["lang", "target", "role", "text"]
MEMORY = "key string, lang string, target string, role string, text string, translated string"


def memory(spark: SparkSession, path: str) -> KeyedTable:
    """A translation memory that lives between runs: a row for each (source, target, role, text with protected markers), by its hash."""
    return KeyedTable(spark, path, MEMORY, ("key",))


def from_memory(items: DataFrame, known: KeyedTable) -> DataFrame:
    """Distinct ``items`` with their key, ``translated`` as far as it is known, and ``hit``."""
    keyed = items.withColumn("key", item_key())
    found = known.lookup(keyed.withColumnsRenamed({c: f"_{c}" for c in ITEM}))
    # the four values decide, the hash only finds them
    same = reduce(lambda x, y: x & y, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in ITEM])
    return found.select("key", *[F.col(f"_{c}").alias(c) for c in ITEM], F.when(same, F.col("translated")).alias("translated"), (F.col("hit") & same).alias("hit"))


def item_key() -> Column:
    return F.sha2(F.concat_ws("\u0001", *ITEM), 256)


def remember(blocks: DataFrame, target: str, known: KeyedTable, batch: str, translate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The memory's part of ``translate_once`` alone: translates the items of ``blocks`` that the memory lacks, adds them as ``batch`` and returns what that batch holds.

    No block is stored and no known translation is read: items of one key are one before they are dealt, known keys take theirs out,
    and only what is new goes on. What ``batch`` has of a run that is made again stays in it.
    """
    items = blocks.filter(translatable(blocks)).select("lang", F.lit(target).alias("target"), role(blocks).alias("role"), protected(F.col("text")).alias("text"))
    fresh = known.lacking(items.withColumn("key", item_key())).select(*ITEM)
    done = translate(fresh) if translate else fresh.withColumn("translated", mock(F.col("text"), F.col("lang"), F.col("target")))
    new = done.filter(F.col("translated").isNotNull()).withColumn("key", item_key()).select("key", *ITEM, "translated")
    if batch in known.batches():
        # a batch replaces itself
        new = written(new.unionByName(known.batch(batch)), "translate-added")
    return known.put(new, batch)


def translate_once(
    blocks: DataFrame, target: str, translate: Callable[[DataFrame], DataFrame] | None = None, known: KeyedTable | None = None, batch: str | None = None
) -> DataFrame:
    """Every block with its translation: each distinct (language, role, text) is translated once and joined back.

    ``translate`` maps distinct items (lang, target, role, text with protected markers) to the same rows with
    ``translated``; default: the mock. Blocks that are not for translation get an empty text, failed ones their source.
    With a memory ``known``, only items that it lacks are translated, and those that succeed are added to it as ``batch``:
    a run that breaks off, and is made again under the same name, leaves what one run leaves.
    """
    # the rules on texts are dear: what they say is stored, as both sides of the join read it
    item = {"_go": translatable(blocks), "role": role(blocks), "target": F.lit(target), "_text": protected(F.col("text"))}
    marked = blocks.withColumns(item).withColumn("_hash", F.xxhash64("lang", "role", "_text"))
    marked = written(marked, "translate-marked")
    items = marked.filter("_go").select("lang", "target", "role", F.col("_text").alias("text")).distinct()
    done = translate or (lambda rows: rows.withColumn("translated", mock(F.col("text"), F.col("lang"), F.col("target"))))
    if known is None:
        told = done(items)
    else:
        if batch is None:
            raise ValueError("a memory takes what is new as a named batch")
        looked = written(from_memory(items, known), "translate-known")
        fresh = written(done(looked.filter(~F.col("hit")).select(*ITEM)), "translate-fresh")
        new = fresh.filter(F.col("translated").isNotNull()).withColumn("key", item_key())
        # a batch replaces itself: what it added before stays in it
        known.add(written(new.unionByName(known.batch(batch)), "translate-added"), batch)
        told = looked.filter("hit").select(*ITEM, "translated").unionByName(fresh.select(*ITEM, "translated"))
    # joined by a hash of the item; its values are compared where hashes meet
    told = told.select(F.xxhash64("lang", "role", "text").alias("_of"), F.col("lang").alias("_l"), F.col("role").alias("_r"), F.col("text").alias("_t"), F.col("translated").alias("_done"))
    on = (F.col("_hash") == F.col("_of")) & F.col("_go") & F.col("lang").eqNullSafe(F.col("_l")) & F.col("role").eqNullSafe(F.col("_r")) & F.col("_text").eqNullSafe(F.col("_t"))
    back = F.when(F.col("text").rlike(f"[{SUPERSCRIPTS}]"), restored(F.col("_done"), F.col("text"))).otherwise(F.col("_done"))
    out = F.when(~F.col("_go"), "").otherwise(F.coalesce(back, "text"))
    return marked.join(told, on, "left").withColumn("translated", out).drop("_go", "_done", "_text", "_hash", "_of", "_l", "_r", "_t")


def page_texts(df: DataFrame, page: list[str], order: str) -> DataFrame:
    """Translated text of each page: non-empty blocks in order, one a line."""
    t = T.stripped(F.coalesce("translated", F.lit("")))
    kept = df.filter(t != "").filter(~flag(df, "is_header_footer_metadata"))
    return kept.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), t.alias("t")))), lambda x: x["t"]), "\n").alias("translated"))


def export_batches(pages: DataFrame, task: list[str], order: str, size: int = EXPORT_PAGES) -> DataFrame:
    """``batch`` of each page of a task: runs of ``size`` pages in order, numbered from 0."""
    at = F.row_number().over(Window.partitionBy(*task).orderBy(order)) - 1
    return pages.withColumn("batch", F.floor(at / size))


def export_texts(pages: DataFrame, task: list[str], order: str) -> DataFrame:
    """A row for each task and batch: how many pages, and their translated texts in order, one below the other."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("translated"))))
    rows = pages.groupBy(*task, "batch").agg(F.count("*").alias("pages"), parts.alias("_p"))
    return rows.select(*task, "batch", "pages", F.array_join(F.transform("_p", lambda p: p["translated"]), "\n").alias("text"))


def page_results(df: DataFrame, page: list[str], order: str) -> DataFrame:
    """The page document: original and translated text and the blocks, nested."""
    block = F.struct(F.col(order), "text", F.col("translated").alias("translatedText"))
    rows = df.groupBy(*page).agg(F.array_sort(F.collect_list(block)).alias("textBlocks"))
    joined = lambda name: F.array_join(F.filter(F.transform("textBlocks", lambda b: b[name]), lambda t: T.stripped(t) != ""), "\n")
    return rows.select(*page, joined("text").alias("original"), joined("translatedText").alias("translated"), "textBlocks")
