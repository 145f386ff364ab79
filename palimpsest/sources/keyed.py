"""Tables by key that outlive a run: insert-if-absent, batch by batch, on any Hadoop file system.

A table is a folder with a folder for each batch, and in it files by bucket of the key's hash, so that
a lookup of some keys reads their buckets only. A batch counts once its job is committed; writing the
same batch again, as after a failure, replaces it, and never sees itself. A key is in one batch only:
rows whose key an earlier batch has are not added. ``compact`` merges batches into one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import _hadoop

#: Committed by Spark, and by ``compact``, which lists the merged batches in it.
DONE, MERGED = "_SUCCESS", "_merged"


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` (DDL) with one row for each value of ``keys``; a key that holds a null counts as its own value."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self) -> dict[str, str]:
        """Batch and folder of all that is committed and not merged into another."""
        files, root = _hadoop(self.spark, self.path)
        if not files.exists(root):
            return {}
        names = {p.getPath().getName(): p.getPath() for p in files.listStatus(root) if p.isDirectory()}
        marked = lambda p, name: files.exists(self._under(p, name))
        bases = sorted(n for n, p in names.items() if n.startswith("base=") and marked(p, DONE) and marked(p, MERGED))
        gone = set(self._merged(names[bases[-1]])) if bases else set()
        own = {n.split("=", 1)[1]: p.toString() for n, p in names.items() if n.startswith("batch=") and n.split("=", 1)[1] not in gone and marked(p, DONE)}
        return own | ({bases[-1]: names[bases[-1]].toString()} if bases else {})

    def _under(self, folder, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)

    def _merged(self, folder) -> list[str]:
        return [r["value"] for r in self.spark.read.text(self._under(folder, MERGED).toString()).collect()]

    def batches(self) -> list[str]:
        """Names of the batches, merged ones as their base."""
        return sorted(self._folders())

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType.fromDDL(f"{self.schema}, bucket int"))

    def rows(self, but: str | None = None) -> DataFrame:
        """All rows and their bucket, those of batch ``but`` left out."""
        found = [self.spark.read.schema(f"{self.schema}, bucket int").parquet(p) for b, p in sorted(self._folders().items()) if b != but]
        return reduce(DataFrame.unionByName, found, self._empty())

    def batch(self, name: str) -> DataFrame:
        """The rows that one batch added."""
        folder = self._folders().get(str(name))
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).drop("bucket") if folder else self._empty().drop("bucket")

    def met(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """A join on all keys, null equal to null, and on the bucket, by which files are left out."""
        l, r = left.alias("l"), right.alias("r")  # noqa: E741
        on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys], F.col("l.bucket") == F.col("r.bucket"))
        return l.join(r, on, how)

    def lookup(self, items: DataFrame) -> DataFrame:
        """``items``, which have the keys, with the table's other columns and ``hit``."""
        rest = [c for c in T.StructType.fromDDL(self.schema).names if c not in self.keys]
        found = self.met(items.withColumn("bucket", self.bucket()), self.rows().withColumn("hit", F.lit(True)), "left")
        return found.select(*[F.col(f"l.{c}") for c in items.columns], *[F.col(f"r.{c}") for c in rest], F.coalesce("r.hit", F.lit(False)).alias("hit"))

    def absent(self, items: DataFrame, batch: str) -> DataFrame:
        """``items`` whose key no other batch than ``batch`` has."""
        return self.met(items.withColumn("bucket", self.bucket()), self.rows(but=str(batch)).select(*self.keys, "bucket"), "left_anti").drop("bucket")

    def add(self, items: DataFrame, batch: str) -> DataFrame:
        """Inserts the first of the rows of each key (by the other columns) that no other batch has, and returns what batch ``batch`` now holds."""
        names = T.StructType.fromDDL(self.schema).names
        rest = [c for c in names if c not in self.keys]
        new = self.absent(items.select(*names), batch)
        one = new.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else new.distinct()
        return self.put(one.select(*names), batch)

    def lacking(self, items: DataFrame) -> DataFrame:
        """The first of the rows of each key (by the other columns) of ``items`` that no batch has; keys here hold no null.

        Rows of a key are one before they are dealt, and they are dealt once: the join takes them as the grouping leaves them.
        """
        rest = [c for c in items.columns if c not in self.keys]
        one = items.withColumn("bucket", self.bucket()).groupBy(*self.keys, "bucket").agg(F.min(F.struct(*rest)).alias("_r"))
        new = one.join(self.rows().select(*self.keys, "bucket"), [*self.keys, "bucket"], "left_anti")
        return new.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest])

    def put(self, rows: DataFrame, batch: str) -> DataFrame:
        """Batch ``batch`` with ``rows``, one a key that no other batch has; returns what it now holds. They are not read from the batch itself."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return self.batch(str(batch))

    def compact(self, but: str | None = None) -> None:
        """Merges all batches, except ``but``, which may be written again, into one; readers see either state."""
        folders = {b: p for b, p in self._folders().items() if b != but}
        if len(folders) < 2:
            return
        files, _ = _hadoop(self.spark, self.path)
        old = [b for b in folders if b.startswith("base=")]
        number = max([0, *(int(b.split("=")[1]) for b in old)]) + 1
        base = f"{self.path}/base={number:09d}"
        merged = [b for b in folders if b not in old] + [m for b in old for m in self._merged(folders[b])]
        self.rows(but=but).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(base)
        out = files.create(self._under(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base), MERGED), True)
        out.write(bytearray("\n".join(merged).encode()))
        out.close()
        for folder in folders.values():
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
