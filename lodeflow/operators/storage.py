"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Bytes of a row group of stored tables. A task holds one as it writes, and up to 4,096 rows of one as it reads, however wide they are.
ROW_GROUP = 16 << 20


def scratch(spark: SparkSession, name: str = "settled") -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``). What is written there goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # none is named, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="lodeflow-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def writer(df: DataFrame) -> DataFrameWriter:
    return df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: branches do not compute it again, and a lost
    executor takes nothing with it."""
    path = scratch(df.sparkSession)
    writer(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
