"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Folders taken in each open scope of this thread, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session, as in tests, gets a temporary folder if that is unset.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path``, and the path as it takes it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path in the shared folder, removed with its ``scope``, else when the session's JVM ends.

    A ``lasting`` one belongs to the scope around the innermost.
    """
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, hadoop = _hadoop(spark, folder)
    # only what is there already can be marked for deletion
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    around = _scopes.get()[: -1 if lasting else None]
    if around:
        around[-1].append(folder)
    return f"{folder}/data"


def written(df: DataFrame, name: str, lasting: bool = False, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors. ``codec``: zstd for rows of text, where bytes count."""
    spark = df.sparkSession
    path = new_path(spark, name, lasting)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """``written`` in few bytes: for rows of text that are read once or twice."""
    return written(df, name, codec="zstd")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables written inside, but for ``lasting`` ones: what is read later must not read the others."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        folders = _scopes.get()[-1]
        _scopes.reset(token)
        for folder in folders:
            files, hadoop = _hadoop(spark, folder)
            files.delete(hadoop, True)
            files.cancelDeleteOnExit(hadoop)
