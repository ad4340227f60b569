"""Document fingerprints: a canonical exact digest, in built-in functions throughout.

A text is normalised to Unicode NFKC, case-folded, normalised again, and its runs of white space
become one space (none at the ends). Its fingerprint is wide: two 64-bit xxhashes of that canonical
text under different salts and its length in bytes. :func:`exact_groups` groups documents by
fingerprint and compares the canonical bytes of each member of a bucket with those of the bucket's
first document, so texts that merely collide never share a group. :func:`against_next` compares each
document with an edited copy and with its neighbour.

Cases: a null text counts as empty. Equal ids are ordered by their texts; a null id comes first.
Empty tables give empty results. Very long texts are taken whole. Rows that share an id (or the null id)
share a range of neighbours, which a window sorts and spills. Other columns of the input are
kept by :func:`fingerprints` and :func:`exact_groups`; those with a result's name are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cleared, cut, table

#: Neighbours are found in ranges of about so many documents; the bounds of at most so many ranges are held at the driver.
DOCS_A_RANGE, MAX_RANGES = 500, 100_000
#: Fingerprints of buckets with several documents, about 60 bytes each, that are broadcast; more are joined.
FEW = 1_000_000


def _nfkc(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def _folded(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))


def canonical(text: Column) -> Column:
    spaced = F.regexp_replace(_nfkc(_folded(_nfkc(F.coalesce(text, F.lit(""))))), r"(?U)[\s\x1C-\x1F]+", " ")
    return F.trim(spaced)


def digest(canon: Column) -> Column:
    """Of a canonical text: 16 + 16 hexadecimal digits and the length in bytes."""
    wide = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon))), 16, "0") for salt in (0, 1)]
    return F.concat(*wide, F.lit("-"), F.octet_length(canon).cast("string"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``canonical`` and ``fingerprint``."""
    out = cleared(docs, *[c for c in ("canonical", "fingerprint") if c != text])
    return out.withColumn("canonical", canonical(F.col(text))).withColumn("fingerprint", digest(F.col("canonical")))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint``, ``group_id`` (smallest key with the same canonical text) and ``kept``, for each row.

    Keys and fingerprints are settled in a narrow table; counts are aggregated by fingerprint (map-side first). Only
    texts of buckets with several documents move: their fingerprints are broadcast if they are :data:`FEW` at most, else
    joined. Members' bytes are compared with those of their bucket's first document; a hot bucket is a skewed join with one
    row on the other side, which adaptive execution splits. A member whose bytes differ is grouped by a SHA-256 of
    its bytes besides.
    """
    own = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    marked = fingerprints(own, "text_").select("key_", "fingerprint", "canonical")
    marks = cut(marked.drop("canonical"))
    heads = cut(marks.groupBy("fingerprint").agg(F.min("key_").alias("head_"), F.count("*").alias("n_")).where("n_ > 1").select("fingerprint", "head_"))
    several = F.broadcast(heads) if heads.count() <= FEW else heads
    members = marked.join(several, "fingerprint")
    first_texts = members.where(F.col("key_").eqNullSafe(F.col("head_"))).groupBy("fingerprint").agg(F.min("canonical").alias("head_text_"))
    same = F.col("head_text_").isNull() | (F.col("canonical") == F.col("head_text_"))
    judged = cut(members.join(first_texts, "fingerprint", "left").select("key_", "fingerprint", F.when(same, F.lit("")).otherwise(F.sha2("canonical", 256)).alias("apart_")))
    firsts = judged.groupBy("fingerprint", "apart_").agg(F.min("key_").alias("group_id"))
    grouped = judged.join(firsts, ["fingerprint", "apart_"]).select("key_", "fingerprint", "group_id")
    alone = marks.join(several, "fingerprint", "left_anti").select("key_", "fingerprint", F.col("key_").alias("group_id"))
    return grouped.unionByName(alone).select(F.col("key_").alias(key), "fingerprint", "group_id", F.col("key_").eqNullSafe(F.col("group_id")).alias("kept"))


def _ranges(docs: DataFrame, key: str) -> list[int]:
    """Ids that open a range, ascending; the first is the smallest id."""
    n = max(1, min(MAX_RANGES, math.ceil(docs.count() / DOCS_A_RANGE)))
    at = [i / n for i in range(n)]
    got = docs.agg(F.percentile_approx(key, at, 100_000).alias("cuts"), F.min(key).alias("least")).first()
    return sorted({*(got["cuts"] or []), *([] if got["least"] is None else [got["least"]])})


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts that are at most ``key``, found in two steps of about the root of their number."""
    step = math.isqrt(len(cuts) - 1) + 1
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    firsts, fine = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>"), F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    run = F.size(F.filter(firsts, lambda x: x <= key))
    return (run - 1) * step + F.size(F.filter(F.element_at(fine, run), lambda x: x <= key))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` (null: empty), its ``fingerprint``, and ``next_text``, ``next_fingerprint`` of the
    document with the next key; the last one's next is the first. Each text is shuffled once: a range
    of keys goes together, with a copy of the first document of the range that follows."""
    own = docs.select(F.coalesce(F.col(key), F.lit(-(2**63))).alias("key_"), F.col(key).alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    cuts = _ranges(own.select("key_"), "key_") or [0]
    ranged = own.withColumn("range_", _range_of(F.col("key_"), cuts))
    heads = ranged.where(F.col("key_").isin(cuts)).groupBy("range_", "key_").agg(F.min("text_").alias("text_"))
    heads = heads.select(F.when(F.col("range_") == 1, F.lit(len(cuts))).otherwise(F.col("range_") - 1).alias("range_"), "key_", F.lit(None).cast("long").alias("id_"), "text_", F.lit(True).alias("head_"))
    both = ranged.select("range_", "key_", "id_", "text_", F.lit(False).alias("head_")).unionByName(heads)
    both = both.withColumn("fingerprint", digest(canonical(F.col("text_"))))
    w = Window.partitionBy("range_").orderBy("head_", "key_", "text_")
    nexts = both.withColumn("next_", F.lead(F.struct("text_", "fingerprint")).over(w)).where(~F.col("head_"))
    return nexts.select(F.col("id_").alias(key), F.col("text_").alias(text), "fingerprint", F.col("next_.text_").alias("next_text"), F.col("next_.fingerprint").alias("next_fingerprint"))


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of a copy whose last quarter is the next document's start.
    A likeness is 1 where the fingerprints and then the canonical bytes are equal, else 0."""
    n = F.char_length(F.col(text))
    part = F.floor(n / 4).cast("int")
    rows = with_next(docs, key, text).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left(F.col(text), n - part), F.left(F.col("next_text"), part)))
    rows = rows.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))
    like = lambda mark, other: F.when(F.col("fingerprint") != F.col(mark), 0.0).when(canonical(F.col(text)) == canonical(F.col(other)), 1.0).otherwise(0.0)
    return rows.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like("edited_fingerprint", "edited").alias("near_edited"), like("next_fingerprint", "next_text").alias("near_next")
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likenesses, and the group of equal canonical texts that each document is in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_groups(docs).groupBy(F.col("doc_id").alias("id_"), F.col("fingerprint").alias("mark_")).agg(F.min("group_id").alias("group_id"))
    rows = against_next(docs)
    same = rows["doc_id"].eqNullSafe(groups["id_"]) & (rows["fingerprint"] == groups["mark_"])
    return rows.join(groups, same).select(*rows.columns, "group_id", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
