"""Resumable indexing: what is already in the index is left out, and the rest goes in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import file_names


def pending(rows: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't indexed yet."""
    return rows.join(indexed.select(key).distinct(), key, "left_anti")


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], key: str, files: int = 128) -> StreamingQuery:
    """Reads the Parquet files of ``source`` that the checkpoint doesn't know, encodes and appends what ``target`` lacks; a
    batch that is run again adds nothing twice. Stops when all there is has been read."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.dropDuplicates([key])
        if any(not name.startswith(("_", ".")) for name in file_names(spark, target)):  # nothing is there before the first batch, or only what a failed one left
            rows = pending(rows, spark.read.parquet(target), key)
        encode(rows).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
