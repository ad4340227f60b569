"""Reranking: penalties, near-duplicate suppression, final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_set

# Generic words that say nothing about a query.
GENERIC = ("patient", "treatment", "clinical", "study", "data", "results", "cancer", "disease", "may", "used")


def penalty(query: Column, text: Column, short: int = 15, thin: float = 1.5, apart: float = 0.8) -> Column:
    """What is taken off: for a text of few words, and for one that shares no telling word with the query."""
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""))
    asked = F.array_except(word_set(query), F.array(*map(F.lit, GENERIC)))
    return F.when(words < short, thin).otherwise(0.0) + F.when((F.size(asked) > 0) & ~F.arrays_overlap(asked, word_set(text)), apart).otherwise(0.0)


def suppress_duplicates(candidates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Of each query's candidates (qid, id, place, text), in order of ``place``, those not too like one kept before. A fold
    over a query's candidates keeps the hashed word sets of what it keeps; how many candidates a query has is the
    caller's choice (a top k). Sets whose sizes alone rule a likeness out are not compared."""
    words = F.array_distinct(F.transform(word_set(F.col("text")), lambda w: F.xxhash64(w)))
    lists = candidates.select("qid", F.struct("place", "id", words.alias("words")).alias("c")).groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    empty = F.filter("cs", lambda c: F.lit(False))

    def alike(k: Column, c: Column) -> Column:
        m, n = F.size(k["words"]), F.size(c["words"])
        shared = F.size(F.array_intersect(k["words"], c["words"]))
        return (F.least(m, n) > threshold * F.greatest(m, n)) & (shared / (m + n - shared) > threshold)

    def step(kept: Column, c: Column) -> Column:
        return F.when(F.exists(kept, lambda k: alike(k, c)), kept).otherwise(F.concat(kept, F.array(c)))

    kept = lists.select("qid", F.explode(F.aggregate("cs", empty, step)).alias("c"))
    return kept.select("qid", "c.id", "c.place")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
