"""Files as they lie in storage: put one by one, listed, and known by their first bytes alone."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: Files of a listing in one batch.
SLICE = 10_000


@lru_cache(maxsize=16)
def storage(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of scheme and authority, and the path of its root there."""
    return fs.FileSystem.from_uri(root.replace("s3a:", "s3:", 1))


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop path, which unlike a URI is not escaped."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    authority, _, path = rest.lstrip("/").partition("/")
    found, root = storage(f"{scheme}://{quote(authority, safe='@:.-_')}")
    return found, f"{root.rstrip('/')}/{path}"


def put_files(files: DataFrame, path: str) -> int:
    """Each row (name, content) as a file of its own under ``path``; returns how many. A file appears whole or not at all, so a task may run twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            # one content at a time, not those of a batch
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py() or b"")
                store.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    done = files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def entries(uri: str) -> Iterator[tuple[str, int, bool]]:
    """Path, length and whether it is a folder, of what lies in a folder, but for names that begin with a dot or an underscore.

    A local folder is read entry by entry, so that memory does not grow with it; other stores give theirs as one list.
    """
    store, folder = place(uri)
    # what stands before the path in a Hadoop path
    before = uri[: len(uri) - len(folder.lstrip("/"))] if ":" in uri else ""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not e.name.startswith((".", "_")):
                    inside = e.is_dir()
                    # a link to nothing has no length
                    size = 0 if inside or not os.path.exists(e.path) else e.stat().st_size
                    yield before + (e.path.lstrip("/") if before else e.path), size, inside
        return
    for i in store.get_file_info(fs.FileSelector(folder)):
        if not i.base_name.startswith((".", "_")):
            yield before + (i.path.lstrip("/") if before else i.path), i.size or 0, i.type == fs.FileType.Directory


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file below ``path``, empty ones too, which a scan of files leaves out; none is opened.

    A level of folders is listed by tasks, folder by folder, and the next level's folders are in what they found, so neither
    names nor folders gather in the driver. Names that begin with a dot or an underscore are not files of the store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                for part in batched(entries(uri), SLICE):
                    paths, lengths, folders = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(folders, pa.bool_())], ["path", "length", "folder"])

    found: list[DataFrame] = []
    level = spark.createDataFrame([(path.rstrip("/"),)], "path string")
    while True:
        seen = written(level.mapInArrow(run, "path string, length long, folder boolean"), "listing")
        found.append(seen.filter(~F.col("folder")).select("path", "length"))
        deeper = seen.filter("folder").select("path")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = deeper.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def with_heads(files: DataFrame, size: int = 4) -> DataFrame:
    """``files`` (path, ...) with ``head``: the first ``size`` bytes of each, all of a shorter one, null if it cannot be read.

    What costs is to open a file, whatever its length, so files are dealt evenly and not by their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads: list[bytes | None] = []
            for uri in b.column("path").to_pylist():
                store, name = place(uri)
                try:
                    with store.open_input_file(name) as f:
                        heads.append(f.read(size))
                except OSError:
                    heads.append(None)
            yield b.append_column("head", pa.array(heads, pa.binary()))

    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, files.withColumn("head", F.lit(None).cast("binary")).schema)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """name, head (first four bytes as text) and size of every file under ``path``, for validation."""
    found = with_heads(listed(spark, path))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("head", "ISO-8859-1").alias("head"), F.col("length").alias("size"))
