"""Ranking metrics of retrieved lists against gold. ``retrieved`` has qid, id, rank (from 1); ``gold`` has qid, id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(retrieved: DataFrame, gold: DataFrame, k: int = 5, fixed_denominator: bool = False) -> DataFrame:
    """Per query with a list: ``precision``, ``recall``, ``hit``, ``mrr``, ``ndcg`` at ``k``. Precision is by the length of the list or, with ``fixed_denominator``, by ``k``."""
    want = gold.select("qid", "id").distinct()
    n_gold = want.groupBy("qid").agg(F.count("*").alias("n_gold"))
    rows = retrieved.where(F.col("rank") <= k).join(want.withColumn("hit", F.lit(True)), ["qid", "id"], "left").join(n_gold, "qid", "left")
    return evaluate_marked(rows, k, fixed_denominator)


def evaluate_marked(rows: DataFrame, k: int = 5, fixed_denominator: bool = False) -> DataFrame:
    """:func:`evaluate` of lists that say themselves which rows are gold (``hit``) and how much gold a query has (``n_gold``): where gold is a property of
    what was found, it need not be written as pairs."""
    hit = F.coalesce("hit", F.lit(False))
    per = rows.where(F.col("rank") <= k).groupBy("qid").agg(
        F.count("*").alias("n"), F.countDistinct(F.when(hit, F.col("id"))).alias("distinct_hits"), F.sum(hit.cast("int")).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"), F.coalesce(F.max("n_gold"), F.lit(0)).alias("n_gold"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_gold", "n"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    r6 = lambda c: F.round(c, 6)
    return per.select(
        "qid", r6(F.col("hits") / (F.lit(float(k)) if fixed_denominator else F.col("n"))).alias("precision"),
        r6(F.when(F.col("n_gold") > 0, F.col("distinct_hits") / F.col("n_gold")).otherwise(0.0)).alias("recall"),
        (F.col("hits") > 0).cast("double").alias("hit"), r6(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        r6(F.when(F.col("n_gold") > 0, F.col("dcg") / ideal).otherwise(0.0)).alias("ndcg"),
    )


def context(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with gold: ``context_precision`` over all it retrieved, ``context_recall`` counting repeated gold."""
    want = gold.groupBy("qid", "id").agg(F.count("*").alias("times"))
    got = retrieved.join(want, ["qid", "id"], "left")
    p = got.groupBy("qid").agg(F.avg(F.col("times").isNotNull().cast("double")).alias("p"))
    r = gold.join(retrieved.select("qid", "id").distinct().withColumn("found", F.lit(1.0)), ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("found", F.lit(0.0))).alias("r"))
    return r.join(p, "qid", "left").select("qid", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("context_precision"), F.round("r", 6).alias("context_recall"))


def context_marked(rows: DataFrame, n_gold: DataFrame) -> DataFrame:
    """:func:`context` of lists that say which rows are gold (``hit``), with ``n_gold`` (qid, n_gold): no pair of a query and its gold is written."""
    hit = F.coalesce("hit", F.lit(False)).cast("double")
    per = rows.groupBy("qid").agg(F.avg(hit).alias("p"), F.sum(hit).alias("hits"))
    of = n_gold.where(F.col("n_gold") > 0).join(per, "qid", "left")
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return of.select("qid", r6(F.col("p")).alias("context_precision"), r6(F.col("hits") / F.col("n_gold")).alias("context_recall"))


def citation_metrics(claims: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """``claims`` (aid, cid, evidence_ids, grounded), ``evidence`` (aid, eid), ``gold`` (aid, eid): precision, recall, coverage of citations and coverage of evidence."""
    per = claims.groupBy("aid").agg(
        F.sum(F.size("evidence_ids")).alias("n"), F.sum(F.when(F.col("grounded"), F.size("evidence_ids")).otherwise(0)).alias("ok"), F.avg((F.size("evidence_ids") > 0).cast("double")).alias("citation_coverage")
    )
    used = claims.select("aid", F.explode("evidence_ids").alias("eid")).distinct().withColumn("u", F.lit(1.0))
    share = lambda of, name: of.join(used, ["aid", "eid"], "left").groupBy("aid").agg(F.avg(F.coalesce("u", F.lit(0.0))).alias(name))
    out = per.join(share(gold, "citation_recall"), "aid", "left").join(share(evidence.distinct(), "evidence_coverage"), "aid", "left")
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("aid", r6(F.when(F.col("n") > 0, F.col("ok") / F.col("n"))).alias("citation_precision"), r6(F.col("citation_recall")).alias("citation_recall"), r6(F.col("citation_coverage")).alias("citation_coverage"), r6(F.col("evidence_coverage")).alias("evidence_coverage"))


def by_similarity(pool: DataFrame, k: int = 5, least: float = 0.6) -> DataFrame:
    """Where there is no gold: ``pool`` (qid, id, rank, similarity to the gold answer); relevant is what is at least ``least``. Precision by ``k``, recall by what the pool has."""
    ok, top = F.col("similarity") >= least, F.col("rank") <= k
    per = pool.groupBy("qid").agg(F.sum((ok & top).cast("int")).alias("hits"), F.sum(ok.cast("int")).alias("relevant"))
    return per.select("qid", F.round(F.col("hits") / float(k), 6).alias("precision"), F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), 6).alias("recall"), (F.col("hits") > 0).cast("double").alias("accuracy"))


def run_summary(evals: DataFrame, by: str = "method") -> DataFrame:
    """Means of a run's metrics; those that the run doesn't have are null, but for what follows from another one: hit rate by
    recall, hallucination by 1 - faithfulness. ``overall`` is five times reliability."""
    names = [c for c in evals.columns if c not in (by, "qid")]
    means = evals.groupBy(by).agg(*[F.avg(c).alias(c) for c in names])
    col = lambda c: F.col(c) if c in names else F.lit(None).cast("double")
    out = {c: col(c) for c in ("precision", "recall", "mrr", "ndcg", "faithfulness", "reliability")}
    out |= {"hit_rate": F.coalesce(col("hit_rate"), col("recall")), "hallucination": F.coalesce(col("hallucination"), 1 - col("faithfulness"))}
    return means.select(by, *[F.round(v, 4).alias(k) for k, v in out.items()], F.round(col("reliability") * 5, 2).alias("overall"))
