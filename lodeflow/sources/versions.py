"""Several tables saved as one: a version is a manifest that names them, and is there whole or not at all.

A commit writes its tables to a folder of their own, which nothing names yet, then a manifest under a temporary name, and last
moves it to ``manifests/<version>.json``. The move is the commit: it fails if that version is there already, so of two writers one
wins, and the other takes the next number if it did not rely on what it read, else it fails. What a failed commit leaves behind is in no
manifest, and :func:`vacuum` removes it. Tables of a version never change, so a reader that has opened one keeps it,
whatever is committed later. All file access is by the file system of the folder's own path; no table passes the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import LoadError, StoreError
from ..operators import storage

MANIFESTS, DATA = "manifests", "data"


@dataclass(frozen=True)
class Version:
    """A pinned version: its number, facts of the writer, and where its tables are."""

    folder: str
    number: int
    facts: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.tables:
            raise LoadError(f"version {self.number} of {self.folder} has no table {name}")
        at = self.tables[name]
        return spark.read.schema(T.StructType.fromJson(at["schema"])).parquet(f"{self.folder}/{DATA}/{at['path']}")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def file_names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing, if there is none."""
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The committed versions, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in file_names(spark, f"{folder}/{MANIFESTS}") if n.endswith(".json") and not n.startswith((".", "_")))


def open_version(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    """The latest version, or the one asked for."""
    known = versions(spark, folder)
    if not known or number is not None and number not in known:
        raise LoadError(f"{folder} has no version" + (f" {number}" if number is not None else ""))
    number = known[-1] if number is None else number
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{MANIFESTS}/{number}.json", wholetext=True).collect())
    found = json.loads(text)
    return Version(folder, number, found["facts"], found["tables"])


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], facts: dict | None = None, after: int | None = None, partitioned: dict[str, list[str]] | None = None) -> Version:
    """Writes ``tables`` and makes them the next version. With ``after``, the version that the tables were made from, a commit in
    between is an error; without, the next free number is taken. ``partitioned`` names a table's folder columns. On any error no version is there."""
    folder, own = folder.rstrip("/"), uuid.uuid4().hex
    named = {}
    for name, df in tables.items():
        to = storage.writer(df).mode("errorifexists")
        if columns := (partitioned or {}).get(name):
            to = to.partitionBy(*columns)
        path = f"{own}/{name}"
        to.parquet(f"{folder}/{DATA}/{path}")
        named[name] = {"path": path, "schema": json.loads(df.schema.json())}
    body = json.dumps({"facts": facts or {}, "tables": named}).encode()
    fs, draft = _fs(spark, f"{folder}/{MANIFESTS}/.{own}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    while True:
        known = versions(spark, folder)
        if after is not None and known and known[-1] != after:
            fs.delete(draft, False)
            raise StoreError(f"{folder} has version {known[-1]} since {after} was read")
        number = known[-1] + 1 if known else 1
        try:
            context.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFESTS}/{number}.json"), plain)
        except Exception as e:  # a Java error: only that the number is taken by now lets the loop go on
            if number in versions(spark, folder):
                continue
            raise StoreError(f"version {number} of {folder} can't be committed: {e}") from e
        return Version(folder, number, facts or {}, named)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Drops all versions but the last ``keep``, and tables that no version names; gives the versions dropped. Not to be run beside a commit."""
    if keep < 1:
        raise StoreError("one version stays at least")
    gone = versions(spark, folder)[:-keep]
    for number in gone:
        fs, at = _fs(spark, f"{folder}/{MANIFESTS}/{number}.json")
        fs.delete(at, False)
    used = {t["path"].split("/")[0] for n in versions(spark, folder) for t in open_version(spark, folder, n).tables.values()}
    for name in file_names(spark, f"{folder}/{DATA}"):
        if name not in used:
            fs, at = _fs(spark, f"{folder}/{DATA}/{name}")
            fs.delete(at, True)
    for name in file_names(spark, f"{folder}/{MANIFESTS}"):
        if name.startswith(".") and not name.endswith(".crc"):
            fs, at = _fs(spark, f"{folder}/{MANIFESTS}/{name}")
            fs.delete(at, False)
    return gone
