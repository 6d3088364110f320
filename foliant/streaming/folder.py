"""A drop folder as a stream: each arriving document is parsed and scored on its own.

All per-document operators are stateless across documents, so a micro-batch runs the same
plan as a batch job; results are appended below the output folder by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import blocks as B
from foliant.operators import lines as L


def parse_stream(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (doc_id, text) in ``source`` to typed blocks in ``out``; exactly once by batch id."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        B.retype(B.parse(L.split_lines(batch))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
