"""Files in storage, exports that results invalidate, appended rows, whole deletions, and the room below a block."""

from __future__ import annotations

import random
import tracemalloc

from pyspark.sql import functions as F

from palimpsest.operators import layout as Y
from palimpsest.operators import ledger as L
from palimpsest.sources import heads as H
from palimpsest.sources import pages as G
from palimpsest.sources.scratch import new_path


def test_heads_of_files(spark, tmp_path):
    rows = [("a b%20.pdf", b"%PDF-1.7 and more"), ("é.pdf", b"%P"), ("none.pdf", b""), ("null.pdf", None)]
    files = spark.createDataFrame(rows, "name string, content binary")
    path = str(tmp_path / "up loads")
    assert H.put_files(files, path) == 4 and H.put_files(files, path) == 4  # as a task that runs twice
    assert sorted(p.name for p in (tmp_path / "up loads").iterdir()) == sorted(n for n, _ in rows)
    assert {(r["name"], r["head"], r["size"]) for r in H.uploads(spark, path).collect()} == {("a b%20.pdf", "%PDF", 17), ("é.pdf", "%P", 2), ("none.pdf", "", 0), ("null.pdf", "", 0)}
    found = H.with_heads(spark.createDataFrame([(f"file:{path}/none.pdf",), (f"{path}/gone.pdf",)], "path string"))
    assert {r["path"][-8:]: r["head"] and bytes(r["head"]) for r in found.collect()} == {"none.pdf": b"", "gone.pdf": None}
    judged = L.validate_uploads(spark.createDataFrame([("x.pdf", None, 3), (None, "%PDF", 3)], "name string, head string, size long"), F.lit("free"))
    assert [r["reason"] for r in judged.collect()][0] == "not_pdf_content"


def test_listing(spark, tmp_path):
    """Folders in folders, empty files, files that are not of the store."""
    for name, text in (("a.pdf", "abc"), ("x/b.pdf", ""), ("x/y z/c.pdf", "de"), ("x/_SUCCESS", "no"), (".part", "no"), ("empty/_tmp", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert {(r["path"].replace("file:", "").replace("//", ""), r["length"]) for r in H.listed(spark, root).collect()} == {(f"{tmp_path}/{n}", k) for n, k in (("a.pdf", 3), ("x/b.pdf", 0), ("x/y z/c.pdf", 2))}
    assert {r["key"] for r in G.inventory(spark, f"file:{tmp_path}").collect()} == {"a.pdf", "x/b.pdf", "x/y z/c.pdf"}


def test_new_result_invalidates_exports(spark):
    results, exports = new_path(spark, "results"), new_path(spark, "exports")
    rows = lambda *tasks: spark.createDataFrame([(t, "f") for t in tasks], "task_id string, fileId string")
    made = lambda *tasks: spark.createDataFrame([(t, "pdf") for t in tasks], "task_id string, output_type string")
    fresh = lambda: sorted((r["task_id"], r["version"]) for r in G.fresh_exports(spark, exports, results).collect())
    G.write_task_results(rows("a", "b"), results, 0)
    G.write_exports(made("a", "b", "without result"), exports, 0)
    assert fresh() == [("a", 0), ("b", 0)]
    for _ in range(2):  # a version written again changes nothing
        G.write_task_results(rows("b"), results, 1)
        assert fresh() == [("a", 0)]
    G.write_exports(made("b"), exports, 1)
    G.drop_stale_exports(spark, exports, results)
    assert fresh() == [("a", 0), ("b", 1)] and spark.read.json(exports).count() == 2
    G.write_task_results(rows("a", "b"), results, 2)
    G.drop_stale_exports(spark, exports, results)
    assert H.listed(spark, exports).count() == 0


def test_appended_tasks_begin_anew(spark):
    table = L.ledger_table(spark, new_path(spark, "tasks"), L.TASK_ROW)
    asked = spark.createDataFrame([(1, "f", "u", "en", "zh", "completed", 100.0, None), (2, None, None, None, None, None, None, None)], "id long, file_id string, user_id string, source_lang string, target_lang string, status string, progress double, created_at timestamp")
    first = {r["id"]: r for r in L.append_tasks(table, asked, "x").collect()}
    assert all((r["status"], r["progress"], r["translated_pages"], r["is_partial"]) == ("processing", 0.0, 0, False) for r in first.values())
    assert L.append_tasks(table, asked.withColumn("user_id", F.lit("other")), "y").count() == 0
    assert {r["id"]: r["user_id"] for r in table.rows().collect()} == {1: "u", 2: None}
    assert L.append_tasks(table, asked.limit(0), "z").count() == 0


def test_delete_files(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    files = frame([("a",), ("b",)], "id string")
    tables = {
        "tasks": frame([(1, "a", 2), (2, "b", 0), (3, None, 1)], "id long, file_id string, pages int"),
        "usage_events": frame([(1, "a"), (3, None)], "task_id long, file_id string"),
        "usage_page_events": frame([(1, "a"), (2, "b")], "task_id long, file_id string"),
        "task_pages": frame([(1, 1), (1, 2), (2, 1), (None, 1)], "task_id long, page_number int"),
        "exports": frame([(1, "pdf"), (2, "pdf")], "task_id long, output_type string"),
    }
    kept, keys = L.delete_files(frame([("a",), ("unknown",)], "file_id string"), files, tables)
    rows = {k: sorted((tuple(r)[:2] for r in df.collect()), key=str) for k, df in kept.items()}
    assert rows == {"files": [("b",)], "tasks": [(2, "b"), (3, None)], "usage_events": [(3, None)], "usage_page_events": [(2, "b")], "task_pages": [(2, 1), (None, 1)], "exports": [(2, "pdf")]}
    assert {(r["key"], r["removed"]) for r in keys.collect()} == {("uploads/a.pdf", True), ("results/1/result.json", True), ("results/1/pages/1.json", True), ("results/1/pages/2.json", True), ("exports/1/pdf.pdf", False)}


def brute_room(rows, margin=18.0):
    out = {}
    for doc, page, seq, x0, y0, x1, h in rows:
        later = [(s, ny) for d2, p2, s, nx0, ny, nx1, _ in rows if (d2, p2) == (doc, page) and s > seq and ny > y0 + 1 and ((nx1 >= x0 - 12 and nx0 <= x1 + 12) or abs(nx0 - x0) < 80)]
        out[(doc, page, seq)] = min(h - margin, min(later)[1] - 4 if later else h)
    return out


def test_room_below(spark):
    r = random.Random(5)
    rows = []
    for doc in range(6):
        for seq in range(90):
            # narrow columns far apart, so that the next below is often beyond the window
            x0 = 150.0 * r.randrange(30 if doc % 2 else 4)
            rows.append((doc, 0, seq * 2, x0, float(r.randrange(700)), x0 + r.choice([5.0, 40.0, 130.0]), 792.0))
    blocks = spark.createDataFrame(rows, "doc_id long, page_num int, seq int, x0 double, y0 double, x1 double, page_height double")
    found = {(x["doc_id"], x["page_num"], x["seq"]): x["bottom_limit"] for x in Y.room_below(blocks).collect()}
    assert found == brute_room(rows)
    assert Y.room_below(blocks.limit(0)).count() == 0


def test_room_below_on_a_long_page(spark):
    """A page of 100,000 blocks: pairs are those of the few blocks that the window leaves open."""
    i = F.col("id")
    long = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_num"), i.cast("int").alias("seq"), (300.0 * (i % 20)).alias("x0"), (i / 20).cast("int").cast("double").alias("y0"), (300.0 * (i % 20) + 50).alias("x1"), F.lit(792000.0).alias("page_height"))
    row = Y.room_below(long.withColumn("y0", F.col("y0") * 10)).groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("bottom_limit") == 791982.0).alias("last"), F.sum("bottom_limit").alias("s")).first()
    assert row["n"] == 100_000 and row["last"] == 20
    assert row["s"] == 20 * 791982.0 + sum(20 * (10.0 * k + 6) for k in range(4999))


def test_a_listing_holds_no_folder_whole(tmp_path):
    """Memory of a listing does not grow with the files of a folder."""
    peaks = []
    for n in (200, 6000):
        folder = tmp_path / f"many-{n}"
        (folder / "inner").mkdir(parents=True)
        (folder / ".hidden").touch()
        for i in range(n):
            (folder / f"{i}.pdf").write_bytes(b"x" * (i % 3))
        tracemalloc.start()
        seen = sum(1 + 2 * inside for _, _, inside in H.entries(f"file://{folder}"))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert seen == n + 3
    assert peaks[1] < 2 * peaks[0]
    assert sorted((p.rsplit("/", 1)[1], n, f) for p, n, f in H.entries(str(tmp_path / "many-200")))[:2] == [("0.pdf", 0, False), ("1.pdf", 1, False)]
