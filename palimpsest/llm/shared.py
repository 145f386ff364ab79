"""Small helpers that several training-data operators use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path, scope, written

__all__ = ["SPACE", "batches_of", "free", "let", "new_path", "only", "scope", "table", "words", "written"]

#: Separators of words: space and the control characters TAB to CR.
SPACE = "[\\x09-\\x0D\\x20]+"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside gives Python at most so many rows at once, or fewer, if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also when lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of characters other than white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of just these names, whatever others there are: with dots, or of the same letters in another case."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use, one for each of ``names``, none of which ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
