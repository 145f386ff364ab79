"""Quality rules: counts of one text, then its divergence from its language's profile.

Everything is DataFrame functions. One pass over the corpus gives each language's
character-class shares and its commonest words; a second pass gives each text its counts
and its Jensen-Shannon distance to that profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free, let, scope, words, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: A language has a profile of its own from so many words on; what has fewer is held against the whole corpus.
PROFILE_WORDS = 2_000
#: A word is common from this share of its language's words (so at most 1,000 are), and TOP_WORDS of them count.
WORD_SHARE = 0.001
TOP_WORDS = 24
#: Common words of all languages up to which one list of them speeds up the counting; beyond, the result is the same.
MOST_KNOWN = 5_000
#: Texts below these lengths have too noisy a histogram to be judged by it.
MIN_CHARS = 200
MIN_WORDS = 60
#: Largest accepted Jensen-Shannon distances (base 2, 0 to 1).
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.4

#: Character classes by pattern; what is left (lower-case letters for the most part) is the last class.
CLASSES = {"upper": "\\p{Lu}", "digit": "\\p{Nd}", "space": "[\\x09-\\x0D\\x20]", "stop": "[.,;:!?]", "other": "[^\\p{L}\\p{Nd}\\x09-\\x0D\\x20.,;:!?]"}


def class_counts(text: Column) -> Column:
    """Characters of each class, the rest last."""
    counted = [F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()]
    return let(F.array(*counted), lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of the same length."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def repeated_words(hashed: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` that occur twice or more; ``hashed``: a hash for each word.

    Windows are compared by 64-bit hashes. The sorted (hash, position) list is only built for
    texts in which some window repeats.
    """

    def starts(h: Column) -> Column:
        # equal hashes are neighbours once sorted
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: F.when(i > 0, F.try_element_at(s, i)["h"] == x["h"]).otherwise(False) | F.coalesce(F.try_element_at(s, i + 2)["h"] == x["h"], F.lit(False)))
        return let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        # each repeated window adds the words that the one before does not cover
        return F.aggregate(F.transform(at, lambda x, i: F.when(i > 0, F.least(x - F.try_element_at(at, i), F.lit(size))).otherwise(F.lit(size))), F.lit(0), lambda acc, x: acc + x)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(starts(w), covered)).otherwise(F.lit(0))

    return let(hashed, lambda h: F.when(F.size(h) > size, let(windows(h), count)).otherwise(F.lit(0)))


def base_counts(w: Column, text: Column) -> dict[str, Column]:
    """The counts of each text, from its words ``w``.

    Plain columns, not one struct: Spark would compute a struct again for each field taken from it.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x09-\\x0D\\x20]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(F.transform(w, lambda x: F.xxhash64(x))).cast("long"),
    }


def language_profiles(docs: DataFrame) -> tuple[DataFrame, dict]:
    """A table of the profiles of the languages with PROFILE_WORDS words (own, classes, common, word_shares), and that of the whole corpus.

    One scan of every document counts words by language; a text's class counts travel along as one
    more word, which no other is like as it begins with a space. A word that has WORD_SHARE of the
    whole corpus has it in some language, so the whole corpus's commonest are among the languages'
    common ones, whose counts add up. Languages may be many: they stay a table, and only the whole
    corpus's profile, TOP_WORDS words, reaches the driver.
    """
    n_classes = len(CLASSES) + 1
    classes = F.concat(F.lit(" "), F.array_join(class_counts(F.coalesce("text", F.lit(""))).cast("array<string>"), " "))
    each = F.concat(words(F.col("text")), F.array(classes))
    counted = written(docs.select("lang", F.explode(each).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    is_class = F.startswith("word", F.lit(" "))
    of_class = [F.coalesce(F.sum(F.when(is_class, F.col("n") * F.get(F.split("word", " "), F.lit(i + 1)).cast("long"))), F.lit(0)).alias(f"c{i}") for i in range(n_classes)]
    sums = written(counted.groupBy("lang").agg(F.coalesce(F.sum(F.when(~is_class, F.col("n"))), F.lit(0)).alias("n"), *of_class), "language-sums")
    large = written(sums.filter((F.col("n") >= PROFILE_WORDS) & F.col("lang").isNotNull()).withColumnsRenamed({"lang": "own", "n": "total"}), "language-large")
    every = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(n_classes)]).first()
    # the rest of the languages are one more to count common words by
    rest = every["n"] - (large.agg(F.sum("total")).first()[0] or 0)
    tagged = counted.filter(~is_class).join(large.select("own", "total"), F.col("lang") == F.col("own"), "left").select("own", "total", "word", "n")
    small = tagged.filter(F.col("own").isNull()).groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("own"), F.lit(rest).alias("total"), "word", "n")
    of_own = tagged.filter(F.col("own").isNotNull()).unionByName(small)
    # at most 1 / WORD_SHARE words of each
    common = written(of_own.filter(F.col("n") >= F.greatest(F.lit(1.0), WORD_SHARE * F.col("total"))), "language-common")
    by = Window.partitionBy("own").orderBy(F.desc("n"), "word")
    top = common.filter(F.col("own").isNotNull()).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP_WORDS)
    best = top.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("rank", "word", (F.col("n") / F.col("total")).alias("share")))).alias("best"))
    left = lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))))
    none = F.array().cast("array<struct<rank:int,word:string,share:double>>")
    profiles = large.join(best, "own", "left").withColumn("best", F.coalesce("best", none)).select("own", shares(F.array(*[F.col(f"c{i}") for i in range(n_classes)])).alias("classes"), F.col("best.word").alias("common"), left(F.col("best.share")).alias("word_shares"))
    whole = of_own.join(common.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    first = whole.filter(F.col("n") >= max(1.0, WORD_SHARE * every["n"])).orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()
    chars = [float(every[f"c{i}"]) for i in range(n_classes)]
    p = [x["n"] / every["n"] for x in first]
    of_all = {"classes": [c / (sum(chars) or 1) for c in chars], "common": [x["word"] for x in first], "word_shares": [*p, max(0.0, 1.0 - sum(p))]}
    return written(profiles, "language-profiles", lasting=True), of_all


def quality(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Every row of ``docs`` with its counts, distances and verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept, and
    class_distance and word_distance (double; null where base_failed, or the text is too short to judge).

    * null or empty text: no words, base_failed.
    * null language, or one of fewer than PROFILE_WORDS words: judged by the whole corpus's profile.
    * ties: of words as common as each other, the lesser stands first.
    * repeats are counted by 64-bit hashes of windows of 64-bit hashes of words.
    * repeated rows: each is judged by itself. Empty table: empty result.
    * columns of ``docs`` with a name this adds are replaced.
    """
    with scope(docs.sparkSession):
        profiles, of_all = language_profiles(docs)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in added]
    names = [F.col(f"`{c}`") for c in keep]
    own_text, w, profile, ref_classes, ref_common, ref_words = free(docs.select(*names), "own_text", "own_words", "profile", "ref_classes", "ref_common", "ref_words")
    refs = profiles.toDF(profile, ref_classes, ref_common, ref_words)
    # words to look for at all, where they are few enough for one list; else each text's own reference decides alone
    known = [r[0] for r in refs.select(F.explode(ref_common)).distinct().limit(MOST_KNOWN + 1).collect()]
    listed = set(known) | set(of_all["common"]) if len(known) <= MOST_KNOWN else None
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias(own_text))
    rows = rows.withColumn(w, words(F.col(own_text))).withColumns(base_counts(F.col(w), F.col(own_text)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    # Spark broadcasts the references while they are small, and joins by language where they are not
    rows = rows.join(refs, F.col("lang") == F.col(profile), "left")
    array = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    rows = rows.withColumns({ref_classes: F.coalesce(ref_classes, array(of_all["classes"], "double")), ref_common: F.coalesce(ref_common, array(of_all["common"], "string")), ref_words: F.coalesce(ref_words, array(of_all["word_shares"], "double"))})
    rest = lambda n: F.concat(n, F.array(F.col("n_words") - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)))
    common = lambda c: let(F.transform(ref_common, lambda r: F.size(F.filter(c, lambda x: x == r)).cast("long")), rest)
    some = F.col(w) if listed is None else F.filter(w, lambda x: x.isin(sorted(listed)) if listed else F.lit(False))
    judged = let(some, common)
    n = F.col("n_words")
    rows = rows.select(
        *names,
        *added[:5],
        F.when(~F.col("base_failed") & (F.length(own_text) >= MIN_CHARS), js_distance(let(class_counts(F.col(own_text)), shares), F.col(ref_classes))).alias("class_distance"),
        F.when(~F.col("base_failed") & (n >= MIN_WORDS), js_distance(let(judged, shares), F.col(ref_words))).alias("word_distance"),
        "base_failed",
    )
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return rows.withColumn("kept", ~F.col("base_failed") & ~diverges)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only; nulls, repeats and empty tables as in ``quality``."""
    packed = docs.select("text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return quality(packed).filter("kept").select("row.*")
