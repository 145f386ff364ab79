"""Tables by key between runs: insert-if-absent, replayed and broken-off batches, compaction, and the translation memory on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ledger as L
from palimpsest.operators import translate as R
from palimpsest.sources import pages as G
from palimpsest.sources.keyed import KeyedTable
from palimpsest.sources.scratch import new_path

SCHEMA = "id long, kind string, value string"


@pytest.fixture
def store(spark):
    return KeyedTable(spark, new_path(spark, "keyed"), SCHEMA, ("id", "kind"), buckets=5)


def held(df):
    return sorted((tuple(r) for r in df.drop("bucket").collect()), key=str)


def test_first_row_of_a_key_stays(spark, store):
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert held(store.rows()) == [] and store.batches() == []
    store.add(rows((1, "a", "x"), (1, "a", "w"), (2, None, "y")), "0")
    assert held(store.add(rows((1, "a", "late"), (2, None, "late"), (1, "b", "z"), (None, None, "n")), "1")) == [(1, "b", "z"), (None, None, "n")]
    assert held(store.rows()) == [(1, "a", "w"), (1, "b", "z"), (2, None, "y"), (None, None, "n")]
    found = store.lookup(spark.createDataFrame([(1, "a"), (9, "a"), (2, None)], "id long, kind string"))
    assert held(found) == [(1, "a", "w", True), (2, None, "y", True), (9, "a", None, False)]


def test_a_batch_again_changes_nothing(spark, store):
    first, second = (spark.range(a, b).select("id", F.lit("k").alias("kind"), F.lit(str(a)).alias("value")) for a, b in ((0, 40), (20, 60)))
    store.add(first, "0")
    store.add(second, "1")
    before = held(store.rows())
    assert held(store.add(second, "1")) == held(store.batch("1")) and held(store.rows()) == before
    # what a batch left that was not committed does not count, and is replaced
    second.write.parquet(f"{store.path}/batch=2")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/batch=2/_SUCCESS"), False)
    assert store.batches() == ["0", "1"] and held(store.rows()) == before
    assert held(store.add(spark.range(70, 71).select("id", F.lit("k").alias("kind"), F.lit("v").alias("value")), "2")) == [(70, "k", "v")]


def test_compaction(spark, store):
    rows = lambda a: spark.range(a, a + 30).select("id", F.lit("k").alias("kind"), F.lit(str(a)).alias("value"))
    for n in range(4):
        store.add(rows(10 * n), str(n))
    before = held(store.rows())
    store.compact(but="3")
    assert store.batches() == ["3", "base=000000001"] and held(store.rows()) == before
    assert held(store.add(rows(30), "3")) == [(i, "k", "30") for i in range(50, 60)]
    store.add(rows(55), "4")
    store.compact()
    assert store.batches() == ["base=000000002"] and len(held(store.rows())) == 85


def test_lookup_reads_the_buckets_it_needs(spark, store):
    store.add(spark.range(500).select("id", F.lit("k").alias("kind"), F.lit("v").alias("value")), "0")
    one = spark.createDataFrame([(7, "k")], "id long, kind string")
    plan = store.met(one.withColumn("bucket", store.bucket()), store.rows(), "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


BLOCKS = [(1, 0, "en", "Some text to read."), (1, 1, "en", "Another text² here."), (2, 0, "en", "Some text to read."), (2, 1, "fr", "Some text to read."), (3, 0, "en", "Another text³ here."), (3, 1, "en", "")]


def run(spark, known, batch, rows=BLOCKS, fail=()):
    """Translations by block, and how many texts the translator saw."""
    seen = spark.sparkContext.accumulator(0)

    def counting(texts, source, target):
        seen.add(len(texts))
        if any(t in fail for t in texts):
            raise RuntimeError
        return R.TRANSLATORS["mock"](texts, source, target)

    df = spark.createDataFrame(rows, "doc_id long, block_index int, lang string, text string")
    out = R.translate_once(df, "zh", lambda items: R.translated(items, "lang", "target", counting, batch=1), known, batch)
    return {(r["doc_id"], r["block_index"]): r["translated"] for r in out.collect()}, seen.value


def test_memory_between_runs(spark):
    known = R.memory(spark, new_path(spark, "memory"))
    once, n = run(spark, known, "a")
    # markers are not part of the key: their two texts are one item
    assert n == 3 and once[(1, 1)] == "[zh: Another text² here.]" and once[(3, 0)] == "[zh: Another text³ here.]" and once[(3, 1)] == ""
    again, n = run(spark, known, "b")
    assert n == 0 and again == once and known.rows().count() == 3
    more, n = run(spark, known, "c", [*BLOCKS, (4, 0, "en", "New words.")])
    assert n == 1 and more == once | {(4, 0): "[zh: New words.]"}


def test_memory_survives_a_break(spark, monkeypatch):
    """A run that ends between translating and adding, or while adding, is as if it had not been."""
    known = R.memory(spark, new_path(spark, "memory"))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            run(spark, known, "a")
    assert known.rows().count() == 0
    once, n = run(spark, known, "a")
    again, m_ = run(spark, known, "a")
    assert n == 3 and m_ == 0 and again == once and known.rows().count() == 3


def test_failed_texts_are_not_remembered(spark):
    known = R.memory(spark, new_path(spark, "memory"))
    once, _ = run(spark, known, "a", fail=("New words.",), rows=[*BLOCKS, (4, 0, "en", "New words.")])
    assert once[(4, 0)] == "New words." and known.rows().count() == 3
    later, n = run(spark, known, "b", rows=[*BLOCKS, (4, 0, "en", "New words.")])
    assert n == 1 and later[(4, 0)] == "[zh: New words.]"


def test_memory_alone_adds_what_translations_add(spark, monkeypatch):
    """Runs that only fill a memory store nothing but the memory, and hold in it what those that translate blocks do."""
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, block_index int, lang string, text string")
    runs = [("a", BLOCKS[:3]), ("b", [*BLOCKS, (4, 0, None, "No language."), (4, 1, None, "No language."), (5, 0, "en", None)])]
    whole, alone = R.memory(spark, new_path(spark, "memory")), R.memory(spark, new_path(spark, "memory"))
    for name, rows in runs:
        R.translate_once(df(rows), "zh", known=whole, batch=name)
    with monkeypatch.context() as m:
        m.setattr(R, "written", lambda *_: (_ for _ in ()).throw(AssertionError("stored")))
        for name, rows in runs:
            R.remember(df(rows), "zh", alone, name)
            assert held(alone.batch(name)) == held(whole.batch(name))
    # the same run again, with a text more that its batch lacks
    assert R.remember(df([*runs[1][1], (6, 0, "en", "New words.")]), "zh", alone, "b").count() == whole.batch("b").count() + 1
    assert alone.rows().count() == whole.rows().count() + 1
    never = lambda items: items.withColumn("translated", F.lit(None).cast("string"))
    assert R.remember(df([(7, 0, "en", "Lost words.")]), "zh", alone, "c", never).count() == 0


def test_page_store(spark):
    """Tasks share folders; a task is found by its folder's hash alone, and written again without touching its neighbours."""
    path = new_path(spark, "pages")
    page = lambda t, n, text: (t, n, text, text, [])
    columns = f"task_id string, pageNum int, original string, translated string, textBlocks array<{G.BLOCK}>"
    write = lambda rows: G.write_page_results(spark.createDataFrame(rows, columns), path, 4)
    write([page(f"t{i}", n, "old") for i in range(12) for n in (1, 2)])
    one = G.read_page_results(spark, path, F.lit("t5"), 4)
    assert sorted(r["pageNum"] for r in one.collect()) == [1, 2]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    write([page("t5", 1, "new"), page("t99", 1, "new")])
    write([])
    found = {}
    for r in G.read_page_results(spark, path).collect():
        found.setdefault(r["task_id"], []).append((r["pageNum"], r["translated"]))
    assert found.pop("t5") == [(1, "new")] and found.pop("t99") == [(1, "new")]
    assert len(found) == 11 and all(sorted(v) == [(1, "old"), (2, "old")] for v in found.values())


def test_failed_batches_are_tried_again_all_over(spark):
    """A batch that fails goes item by item through a second pass, over all partitions; each attempt is a row that the page outcome reads."""
    items = spark.range(200).select(F.lit("en").alias("lang"), F.lit("zh").alias("target"), F.col("id").cast("string").alias("text")).coalesce(1)

    def choosy(texts, source, target):
        if len(texts) > 1 and int(texts[0]) // 20 % 2 or "7" in texts:
            raise RuntimeError("no")
        return [None if t == "3" else t.upper() for t in texts]

    done, log = R.with_fallback(items, "lang", "target", choosy)
    out = {r["text"]: r["translated"] for r in done.collect()}
    assert out == {str(i): None if i in (3, 7) else str(i) for i in range(200)}
    rows = [(int(r["text"]), r["attempt"], r["status"], r["error"]) for r in log.collect()]
    # every other batch of 20 fails, the one that holds the 7, and the 3 by itself
    again = {i for i in range(200) if i // 20 % 2 or i < 20}
    assert sorted((i, a) for i, a, *_ in rows) == sorted([(i, 1) for i in range(200)] + [(i, 2) for i in again])
    assert {(i, e) for i, a, s, e in rows if a == 2 and s == "failed"} == {(3, "no text"), (7, "RuntimeError: no")}
    assert log.filter("attempt = 2").select(F.spark_partition_id()).distinct().count() > 1
    pages = items.withColumns({"task_id": F.lit(1), "page_number": (F.col("text").cast("int") / 20).cast("int")})
    outcome = {r["page_number"]: (r["status"], r["attempts"], r["is_billed"]) for r in L.page_outcomes(R.page_attempts(pages, log, ["task_id", "page_number"], ["lang", "target", "text"])).collect()}
    assert outcome == {p: ("failed", 2, False) if p == 0 else ("completed", 2 if p % 2 else 1, True) for p in range(10)}


def test_no_items_no_attempts(spark):
    done, log = R.with_fallback(spark.createDataFrame([], "lang string, target string, text string"), "lang", "target", R.TRANSLATORS["mock"])
    assert done.count() == 0 and log.count() == 0 and done.columns == ["lang", "target", "text", "translated"]
