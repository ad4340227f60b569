"""What the learned scores share: the fold that is held out, and the bounded sample that they learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether a document's label is never learned from: crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of ``bound`` labelled documents at most: those with the least hash of their ids, so
    that reruns agree. Null labels don't count; of several labels of one id the largest does. The sample
    of ids is broadcast, as it has a bounded number of rows; no text is shuffled."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("label_"))
    sample = rows.orderBy(F.xxhash64(key), key).limit(bound)
    return docs.select(F.col(key), F.col(text).alias("text_")).join(F.broadcast(sample), key).select("text_", "label_")
