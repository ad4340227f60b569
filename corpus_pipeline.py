"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, mix, token ids.

Each stage takes what the one before it kept, reads it from a Parquet table in the shared folder, and
works on all of it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm import bpe, minhash, mixing, quality, suffixes
from lodeflow.llm.common import remove_at_exit, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="quality_score_").where(F.col("quality_score_") >= quality.KEEP_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = judged.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier; whole code points only. Emptied documents go."""
    out = suffixes.without_repeats(docs, whole_chars=True).where("n_removed = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.decode("kept", "UTF-8"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, and digests of them and of what they decode to."""
    encoded = bpe.encode_texts(docs.select("doc_id", "source", "text"), decoded="decoded")
    return encoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
