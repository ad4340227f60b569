"""Readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..operators.ordering import running_total

PAGES = "source_file string, page_number int, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict`` fails on a bad line, else its fields are null."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str = "*.pdf", least: int = 20) -> DataFrame:
    """Pages of binary files: ``parse`` gives a file's page texts. A file that it can't parse is skipped; pages below
    ``least`` characters are dropped, the numbers of the others stay."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if files.isEmpty():
        raise LoadError(f"no {pattern} in {path}")

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    texts = parse(content)
                except Exception:  # noqa: BLE001  any fault of a parser makes the file a bad one
                    continue
                rows += [(name.rsplit("/", 1)[-1], i, t.strip()) for i, t in enumerate(texts, 1) if len(t.strip()) >= least]
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "text"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def latest(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row for each key: the last."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), sequence).alias("row")).select(key, "row.*")


def upsert(store: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """``store`` with the last change of each key in place of its row; doing it twice changes nothing."""
    last = latest(changes, key, sequence)
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def by_ids(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given ids; unknown ids are left out."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def subset(rows: DataFrame, manifest: DataFrame | None, key: str, order: str, first: int = 100) -> DataFrame:
    """Rows whose id the manifest lists, else the ``first`` rows in order."""
    return by_ids(rows, manifest, key) if manifest is not None else rows.orderBy(order).limit(first)


def title_of(path) -> "F.Column":
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def document_metadata(files: DataFrame) -> DataFrame:
    """``files`` (path, title, author, total_pages): a missing title comes from the file's name, a missing author is "Unknown"."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return files.withColumn("title", F.coalesce(blank(F.col("title")), title_of(F.col("path")))).withColumn("author", F.coalesce(blank(F.col("author")), F.lit("Unknown")))


def numbered(log: DataFrame, order: str, width: int = 3) -> DataFrame:
    """Adds ``log_id``: Q and the place in order."""
    placed = running_total(log, [order], F.lit(1), "place_")
    number = (F.col("place_") + 1).cast("string")  # padded, never cut
    return placed.withColumn("log_id", F.concat(F.lit("Q"), F.when(F.char_length(number) < width, F.lpad(number, width, "0")).otherwise(number))).drop("place_")
