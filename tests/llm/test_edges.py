"""Defined results for odd input: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, entries, html, lengths, mixing, ngrams, pii, quality, similar, simhash, sql, substrings, tokenfile
from palimpsest.llm.shared import new_path
from tests import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} the of" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from all of it at once before night falls down"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, text, "en", "a", 10),
        (4, text, "en", "a", 10),
        (5, text, None, "b", 10),
        (None, "one two", "fr", None, 7),
        (6, LONG, "en", "a", len(LONG)),
        (7, "\U0001f600 é 日本 ‑ word", "zz", "c", 3),
    ]
    # names that the operators add themselves
    return spark.createDataFrame(rows, SCHEMA).withColumns({"n_words": F.lit("mine"), "size": F.lit("mine"), "kept": F.lit("mine"), "n_replaced": F.lit("mine"), "hit_spans": F.lit("mine"), "n_tokens": F.lit("mine")}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter(F.lit(False))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "lazy dog and runs away from all of it at once"), (2, None), (3, ""), (4, "one two"), (5, "--- !")], "item_id long, text string")


def test_quality(odd, none):
    rows = {(r["doc_id"], r["text"]): r for r in quality.quality(odd).collect()}
    assert len(rows) == 8 and quality.quality(odd).count() == 9
    for key in ((1, None), (2, ""), (3, " \t\n ")):
        assert rows[key]["n_words"] == 0 and rows[key]["base_failed"] and not rows[key]["kept"]
    assert rows[(6, LONG)]["n_words"] == 180_000
    assert quality.quality(none).collect() == []
    assert set(quality.kept_documents(odd).columns) == set(odd.columns)


def test_near_duplicates(odd, none):
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert len(found) == 9
    by = {(n, d): c for n, d, c in found}
    assert by[(False, 1)] == by[(False, 2)] == by[(False, 3)] == 1
    assert by[(False, 4)] == by[(False, 5)] == 4
    assert simhash.near_duplicates(none).collect() == []
    kept = [r["doc_id"] for r in simhash.one_of_each(odd).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [1, 4, 6, 7, None]
    # a doc_id under which different texts stand loses none of them
    twice = odd.filter("doc_id = 4").limit(1).unionByName(odd.filter("doc_id = 7").withColumn("doc_id", F.lit(4).cast("long")))
    assert simhash.one_of_each(twice).count() == 2


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9
    assert all(r["taken"] == 0 and r["positions"] == [] for r in rows if r["size"] == 0)
    assert {r["source_size"] for r in rows if r["source"] is None} == {2}
    assert mixing.mix(none).collect() == [] and mixing.curriculum(none).collect() == []
    assert mixing.curriculum(odd).columns == odd.columns


def test_tokens(odd, none, spark):
    found = entries.encoded(odd).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in found)
    at = 0
    for start, n in starts:
        assert start == at
        at += n
    by = {r["doc_id"]: r["n_tokens"] for r in found}
    assert by[1] == by[2] == by[3] == 1 and len(found) == 9
    assert entries.encoded(none).collect() == []


def test_substrings(odd, none):
    found = substrings.repeated(odd)
    by = {r["doc_id"]: r for r in found.collect() if r["doc_id"] != 4}
    assert by[5]["n_removed"] == by[5]["n_words"] == 22 and by[5]["kept_text"] == ""
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0
    assert by[6]["n_removed"] == 0 and by[6]["n_words"] == 180_000
    assert {r["n_removed"] for r in found.filter("doc_id = 4").collect()} == {0}
    assert substrings.repeated(none).collect() == []


def test_token_counts(odd, none):
    path = entries.public_tokenizers.path("word_bpe_49k.json")
    counts = lengths.token_counts(odd, path)
    hist = lengths.histogram(counts, ["lang"]).collect()
    assert sum(r["n_docs"] for r in hist) == 9
    assert {r["docs_total"] for r in hist if r["lang"] is None} == {2}
    assert lengths.histogram(lengths.token_counts(none, path), []).collect() == []


def test_scores(odd, none):
    rows = ngrams.scores(odd).collect()
    assert len(rows) == 9
    assert all(r["log_score"] == 0 and r["mean_log_score"] is None for r in rows if r["n_words"] == 0)
    # each of the copies is seen in the others
    assert all(r["n_seen"] == 20 for r in rows if r["n_words"] == 22)
    assert ngrams.scores(none).collect() == []


def test_decontamination(odd, none, bench, spark):
    found = decontaminate.hits(odd, bench)
    by = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(s) for s in by[5]["hit_spans"]] == [(7, 18)] and by[5]["hit_items"] == ["1"]
    assert by[None]["hit_items"] == ["4"] and by[1]["n_words"] == 0 and by[6]["hit_items"] == []
    empty = bench.filter(F.lit(False))
    assert decontaminate.digest(decontaminate.hits(odd, empty)).filter("contaminated").count() == 0
    assert decontaminate.hits(none, bench).collect() == []
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(odd, bench, "spans").collect()}
    assert left[5] == "the quick brown fox jumps over the  before night falls down" and left[1] is None
    assert decontaminate.decontaminate(odd, bench).count() == 5


def test_spans_of_mixed_case(spark, bench):
    """Words of capitals count as words where spans are cut; every other byte stays."""
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "NASA and McDonald's É SAY: Lazy DOG and runs AWAY from All of it AT Once! THE End"), (2, "ÄB ONE, tWo C")], schema)
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert left == {1: "NASA and McDonald's É SAY: ! THE End", 2: "ÄB  C"}


def test_items_without_id_hit(spark, bench, tmp_path):
    """Passages of items whose item_id is null count as hits, as in the SQL."""
    docs = spark.createDataFrame([(1, "x three four y"), (2, "z one two"), (3, "nothing")], "doc_id long, text string")
    more = bench.unionByName(spark.createDataFrame([(None, "three four"), (None, "one two"), (None, "y")], "item_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    more.write.parquet(f"{tmp_path}/benchmark.parquet")
    for chars in (4_000_000, 10):
        found = decontaminate.digest(decontaminate.hits(docs, more, block_chars=chars))
        assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == {1: 3, 2: 2, 3: 0}
        assert compare.differences(found, sql.LEAKS, str(tmp_path)) == ""
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, more).collect()] == [3]


def test_benchmark_in_blocks(odd, bench):
    whole = sorted(map(str, decontaminate.digest(decontaminate.hits(odd, bench)).collect()))
    assert sorted(map(str, decontaminate.digest(decontaminate.hits(odd, bench, block_chars=20)).collect())) == whole


def test_pii(odd, none):
    rows = pii.pseudonymize(odd, "k").collect()
    assert len(rows) == 9 and all(r["n_replaced"] == 0 for r in rows)
    assert {r["text"] for r in rows} == {r["text"] for r in odd.collect()}
    assert pii.pseudonymize(none, "k").collect() == []


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (3, "u", "<script>x", 1), (4, "u", "<p>a &lt; b<p>c", 1), (4, "u", "<p>a &lt; b<p>c", 1)], "page_id long, url string, html string, text long")
    rows = html.extract(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in sorted(rows, key=lambda r: r["page_id"])][:3] == [(1, 0), (2, 0), (3, 0)]
    assert len(rows) == 5 and html.extract(pages.filter(F.lit(False))).collect() == []


def test_files_survive_reading_by_ids(odd, spark):
    path = new_path(spark, "ids")
    tokenfile.write_tokens(odd, path, entries.public_tokenizers.path("word_bpe_49k.json"), 2)
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in tokenfile.read_tokens(spark, path).collect())


def test_reading_token_files_moves_no_segments(odd, spark):
    """Files of any size: only the parts' totals, a row each, are sent; the segments stay where they are read."""
    path, name = new_path(spark, "ids"), "spark.sql.autoBroadcastJoinThreshold"
    tokenfile.write_tokens(odd, path, entries.public_tokenizers.path("word_bpe_49k.json"), 2)
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        plan = tokenfile.crc32s(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


#: Names that some operator uses inside; an input may have any of them.
INNER = """text_bytes key bucket order row sort id end position schedule bucket_start bucket_size source_size target copies taken positions weight
found new fp hash label sid n prefix parity kept_id kept_hash chunk docs own_text own_words own_classes judge profile ref_classes ref_common
ref_words word begin_of file count value start n_hit hit_items class_distance word_distance base_failed html_bytes n_chars_ _text _words _id _of
_hash _key _order _bucket _sort _found _new _row _file _count _position whole""".split()


def test_clashing_names(spark, odd, bench):
    """Columns with the operators' inner names change nothing and come through where columns are kept."""
    docs = odd.select("doc_id", "text", "lang", "source").filter("doc_id is null or doc_id <> 6")
    more = docs.withColumns({c: F.lit(f"mine {c}") for c in INNER})
    path = entries.public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "quality": lambda d: quality.quality(d).select("doc_id", "text", "n_words", "n_repeat_words", "class_distance", "word_distance", "kept"),
        "near": lambda d: simhash.near_duplicates(d),
        "mix": lambda d: mixing.mix(d).select("doc_id", "size", "target", "taken", "positions"),
        "tokens": lambda d: entries.encoded(d),
        "substrings": lambda d: substrings.repeated(d).drop("spans"),
        "scores": lambda d: ngrams.scores(d),
        "pii": lambda d: pii.pseudonymize(d, "k").select("doc_id", "text", "n_replaced"),
        "counts": lambda d: lengths.token_counts(d, path).select("doc_id", "n_tokens"),
        "hits": lambda d: decontaminate.digest(decontaminate.hits(d, bench)),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(more).collect())) == sorted(map(str, run(docs).collect())), name
    for keeps in (quality.kept_documents, simhash.one_of_each, similar.one_of_each, mixing.curriculum, lambda d: decontaminate.decontaminate(d, bench), lambda d: decontaminate.decontaminate(d, bench, "spans")):
        out = keeps(more)
        assert out.columns == more.columns
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in INNER)
    for adds in (lambda d: pii.pseudonymize(d, "k"), mixing.mix, quality.quality, lambda d: decontaminate.hits(d, bench)):
        out = adds(more)
        kept = [c for c in INNER if c not in ("size", "source_size", "target", "copies", "taken", "positions", "class_distance", "word_distance", "base_failed", "hit_items")]
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in kept)


def test_languages_without_a_profile(spark, tmp_path):
    """Null and rare languages are held against the whole corpus, as in the SQL, and ties of words go to the lesser."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lang = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, F.lit("rare")).otherwise(F.col("lang"))
    docs.withColumn("lang", lang).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert compare.differences(entries.op5_quality_rules(spark, str(tmp_path)), sql.QUALITY, str(tmp_path)) == ""


def test_thousands_of_languages(spark, monkeypatch):
    """Profiles are a table: as many languages as there are, with and without the list of all common words."""
    monkeypatch.setattr(quality, "PROFILE_WORDS", 50)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 % 5003).cast("string"), F.lit("x"), F.pmod(F.xxhash64(i), F.lit(9)).cast("string"))))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"), F.lit("mine").alias("a.b"), F.lit("mine").alias("Known"))
    # of the last language's documents one is in another's words
    docs = docs.unionByName(docs.filter("doc_id = 7").withColumns({"doc_id": F.lit(9999).cast("long"), "lang": F.lit("l8")}))
    columns = ["doc_id", "n_words", "kept", "class_distance", "word_distance"]
    found = {}
    for most in (10, 100_000):
        monkeypatch.setattr(quality, "MOST_KNOWN", most)
        found[most] = sorted(tuple(r) for r in quality.quality(docs).select(*columns).collect())
    assert found[10] == found[100_000] and len(found[10]) == 3001
    far = {r[0]: r[4] for r in found[10]}
    assert far[7] < 1e-6 and far[100] < 1e-6 and 0.1 < far[8] and 0.1 < far[9999]


def test_pipeline_on_odd_rows(spark, odd, bench, tmp_path):
    """Nulls, ties, repeats, clashing names and a very long text through every stage; each stage's decisions hold for the next."""
    import corpus_pipeline

    docs = odd.withColumns({c: F.lit(c) for c in ("_hash", "row", "sort", "judge", "position")})
    odd_rows = docs.unionByName(docs.filter("doc_id = 6").withColumn("doc_id", F.lit(8).cast("long")))
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = odd_rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    written_ids = [r["doc_id"] for r in now.collect()]
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(written_ids)
    assert set(written_ids) <= {6}  # of two copies the first; nothing else has twenty words


def test_very_long_and_broken_pages():
    """Time grows with a page's length, whatever is left open in it."""
    import time

    for part in ("<p a='", "<button>", "<a href=x>", "<p>", "<div>", "<b>", "<!--", "<![CDATA[", "<a ", "</p", "<p a=\"x' ", "<option>", "<script>", "<p a='>x", "<svg>", "<a name=x>y"):
        start = time.time()
        html.main_text(part * 30_000)
        assert time.time() - start < 10, part
    assert html.main_text("<a name=top><h1>T</h1><p>" + "The cat is on the mat and so it is. " * 8).count("cat") == 8
    inside = "<article><div class='entry-header'><h1>Head</h1></div><p class='share-price'>The price of the share is on the rise for all of us.</p><p>" + "It is the cat that is on the mat. " * 8 + "</p></article>"
    assert html.main_text(inside).startswith("Head\nThe price")
    teaser = "<article><h2>Teaser</h2><p>Read the rest of it.</p></article><div><p>" + "It is the cat that is on the mat. " * 8 + "</p><p>" + "It is the dog that is in the house. " * 8 + "</p></div>"
    assert "cat" in html.main_text(teaser) and "dog" in html.main_text(teaser)
    assert html.main_text("<p title=\"abc>It is the cat.</p><p>" + "It is the dog that is in the house. " * 8 + "</p>").startswith("It is the cat.")


def test_density_alone_finds_the_article(spark):
    """With article and main tags taken away, blocks of the text are found by the rules: recall of 0.9 and more."""
    import re

    recalls, alike, n = [], 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        whole = html.main_text(r["html"] or "").split("\n")
        bare = html.main_text(re.sub(r"</?(?:article|main)[^>]*>", "", r["html"] or "")).split("\n")
        recalls.append(len(set(whole) & set(bare)) / len(set(whole)))
        alike, n = alike + (whole == bare), n + 1
    assert sum(recalls) / n >= 0.9 and alike / n >= 0.9
