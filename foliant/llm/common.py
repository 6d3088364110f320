"""What the corpus operators share: the shared folder, written tables and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line contract: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share.

    ``spark.checkpoint.dir`` names it; only where that is unset and the master is local
    (tests) a folder of this machine is used. A cluster without the setting is refused:
    its executors would write to disks that the others cannot read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a store that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go when the write ends, as what is read later is the table
#: alone, and Arrow batches hold a few MB, however long the texts are.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind and hold little in Python; the session's settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of a few MB: a batch of very long texts is then no larger than one of short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _WRITING["spark.sql.execution.arrow.maxBytesPerBatch"])
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends here."""
    return Scratch(df.sparkSession).table(df, name)


def forget(spark: SparkSession, *dirs: str) -> None:
    """Delete folders of the shared store that are no longer read."""
    for d in dirs:
        path = spark._jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_STATE: dict = {}


def worker_state(key: Hashable = None, make: Callable[[], Any] = lambda: None) -> Any:
    """What an operator keeps in a Python worker between its tasks, made when it is missing.

    A worker holds the state of one key at a time, so stage after stage it is no larger than
    the largest of them; a call without a key lets go of what earlier operators left.
    """
    if _STATE.get("key", ()) != key:
        _STATE.clear()
        pa.default_memory_pool().release_unused()
        _STATE.update(key=key, value=make())
    return _STATE["value"]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array] | None], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to columns in the order of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text becomes empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


class Scratch:
    """Written tables of one run of an operator; each can be dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._kept: dict[int, tuple[DataFrame, str, str | None]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written to the shared folder and read back."""
        path = shared_dir(self.spark, name)
        with tidy(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept[id(out)] = (out, path, None)
        return out

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As table(), hashed into buckets by key and sorted within each: later joins on key leave it in place."""
        path, table = shared_dir(self.spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with tidy(self.spark):
            df.repartition(n, key).write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
        out = self.spark.table(table)
        self._kept[id(out)] = (out, path, table)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of this run; others and None are left alone."""
        for t in tables:
            if t is not None and id(t) in self._kept:
                _, path, name = self._kept.pop(id(t))
                if name:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                forget(self.spark, path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        keep = {id(t) for t in tables}
        self.drop(*[t for k, (t, _, _) in list(self._kept.items()) if k not in keep])
