"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a small table, as it is stored.
SMALL = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of less than :data:`SMALL` bytes often is one row group, which one task would read and work on alone, so
    its rows are dealt to all cores. Larger tables are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; a
    temporary one only where the session names none, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        known = tempfile.mkdtemp(prefix="lodeflow-")
        spark.conf.set("spark.checkpoint.dir", known) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return spark.conf.get("spark.checkpoint.dir", None) or known


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` as a table written in the shared folder and read again, so that a lost
    executor costs no recomputation and the plans that follow start from the table's true size.
    The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodeflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Rows of a few KB go to Python workers in batches of fewer rows than is usual, which bounds their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def cleared(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (names clash case-insensitively)."""
    own = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in own])


def salts(n_rows: int, rows: int) -> int:
    """How many groups hold ``n_rows`` rows with about ``rows`` in each."""
    return max(1, -(-n_rows // rows))


def process_state(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks. Functions reach workers by value, so their module's own
    variables last for one task only. Nothing depends on what is kept: a new process makes it again."""
    kept = sys.modules.setdefault("_lodeflow_process_state", types.ModuleType("_lodeflow_process_state"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def release_state() -> None:
    """Drops what other operators have kept in this worker process, before one that needs the memory."""
    kept = sys.modules.get("_lodeflow_process_state")
    if kept is not None:
        vars(kept).clear()
