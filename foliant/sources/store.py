"""Versioned tables in a store that driver and executors share: themes, lexicons or anything else with an id.

A version holds only what it changes: rows that it sets, and ids that it deletes. A writer first claims
its number, by a file that is created only if it is not there, then writes its rows and last a commit;
readers see committed versions alone, so a version is seen whole or not at all, and of two writers
of one number the second gets an error. A writer that dies leaves its number unused. Reading takes the last
word of each id, as of any version.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made this version."""


class Store:
    """A table of rows with an ``id`` below one folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{kind}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _create(self, kind: str, version: int) -> None:
        fs, p = self._fs(f"{self.root}/{kind}/{version:012d}")
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            raise Conflict(f"another writer has made version {version}") from e

    def versions(self) -> list[int]:
        return self._numbers("commits")

    def _write(self, changes: DataFrame, after: int | None) -> int:
        """changes has the columns of the table and ``deleted``."""
        last = max(self._numbers("claims"), default=0)
        if after is not None and last > after:
            raise Conflict(f"version {last} was begun after {after}")
        self._create("claims", last + 1)
        changes.write.parquet(f"{self.root}/data/{last + 1:012d}")
        self._create("commits", last + 1)
        return last + 1

    def save(self, rows: DataFrame, after: int | None = None) -> int:
        """Set rows by their ids, of equal ids the greatest row; the number of the new version.

        With ``after`` the version that the writer has read, a version made meanwhile is a conflict.
        """
        order = F.struct(*[f.name for f in self.schema.fields if f.dataType.typeName() != "map"])
        keep = rows.groupBy("id").agg(F.max_by(F.struct(*self.schema.names), order).alias("row"))
        return self._write(keep.select("row.*").withColumn("deleted", F.lit(False)), after)

    def delete(self, ids: DataFrame, after: int | None = None) -> int:
        """Delete ids that may or may not be there."""
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != "id"]
        return self._write(ids.select("id").distinct().select("id", *nothing).select(*self.schema.names, F.lit(True).alias("deleted")), after)

    def load(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, by default the last."""
        parts = [k for k in self.versions() if version is None or k <= version]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        schema = self.spark.createDataFrame([], self.schema).withColumn("deleted", F.lit(False)).schema
        own = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{k:012d}" for k in parts])
        number = F.regexp_extract(F.input_file_name(), r"/data/([0-9]{12})/", 1)
        last = own.withColumn("_at", number).groupBy("id").agg(F.max_by(F.struct(*self.schema.names, "deleted"), "_at").alias("r"))
        return last.where("NOT r.deleted").select(*[F.col(f"r.{c}").alias(c) for c in self.schema.names])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, one document each, with their ``path`` and what is ``unreadable`` of them (null if nothing is)."""
    own = spark.read.schema(f"{schema}, unreadable string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable").option("multiLine", "true")
    return own.option("recursiveFileLookup", "true").json(path).withColumn("path", F.input_file_name())
