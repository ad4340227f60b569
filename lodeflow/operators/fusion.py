"""Fusion of retrieval signals and cutoffs. Signals are rows (qid, id, signal, raw)."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RetrievalError
from .storage import settle


def min_max(signals: DataFrame) -> DataFrame:
    """Adds ``norm``: 0 to 1 within query and signal; where all are equal, 1 if above 0, else 0."""
    w = Window.partitionBy("qid", "signal")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    return signals.withColumn("lo_", lo).withColumn("hi_", hi).withColumn(
        "norm", F.when(F.col("hi_") - F.col("lo_") < 1e-9, F.when(F.col("hi_") > 0, 1.0).otherwise(0.0)).otherwise((F.col("raw") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))
    ).drop("lo_", "hi_")


def weights(dense: float = 0.4, bm25: float = 0.3, graph: float = 0.3, alpha: float | None = None) -> dict[str, float]:
    """Checked weights; ``alpha`` gives dense its share and BM25 the rest, and none to the graph."""
    if alpha is not None:
        if not 0 <= alpha <= 1:
            raise RetrievalError("alpha is between 0 and 1")
        dense, bm25, graph = alpha, 1 - alpha, 0.0
    if min(dense, bm25, graph) < 0 or dense + bm25 + graph <= 0:
        raise RetrievalError("weights are not negative, and not all 0")
    return {"dense": dense, "bm25": bm25, "graph": graph}


def strongest(signals: DataFrame) -> DataFrame:
    """One row for query, id, and signal: the greatest raw score (a query and its expansion may both find it)."""
    return signals.groupBy("qid", "id", "signal").agg(F.max("raw").alias("raw"))


def weighted(signals: DataFrame, w: dict[str, float], chunks: DataFrame | None = None) -> DataFrame:
    """``qid``, ``id``, raw scores by signal, ``fused`` (weights renormalised over the signals a query has; a missing one is 0).
    With ``chunks`` (id, text, source), ``text`` and ``source`` with a stand-in where the store has none."""
    normed = min_max(signals)
    names = list(w)
    pivot = normed.groupBy("qid", "id").agg(
        *[F.coalesce(F.max(F.when(F.col("signal") == s, F.col("raw"))), F.lit(0.0)).alias(f"{s}_score") for s in names],
        *[F.coalesce(F.max(F.when(F.col("signal") == s, F.col("norm"))), F.lit(0.0)).alias(f"{s}_norm") for s in names],
    )
    has = normed.groupBy("qid").agg(*[F.max(F.when(F.col("signal") == s, F.lit(float(w[s]))).otherwise(0.0)).alias(f"{s}_w") for s in names])
    total = sum((F.col(f"{s}_w") for s in names[1:]), F.col(f"{names[0]}_w"))
    fused = sum((F.col(f"{s}_w") * F.col(f"{s}_norm") for s in names[1:]), F.col(f"{names[0]}_w") * F.col(f"{names[0]}_norm"))
    out = pivot.join(has, "qid").where(total > 0).select("qid", "id", *[f"{s}_score" for s in names], F.round(fused / total, 6).alias("fused"))
    return out if chunks is None else with_texts(out, chunks)


def with_texts(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` (id) with the columns of ``chunks`` (id, text, source), with a stand-in where the store has none; empty texts go."""
    kept = found.join(chunks, "id", "left").withColumn("text", F.coalesce("text", F.concat(F.lit("Content for chunk "), F.col("id").cast("string")))).withColumn("source", F.coalesce("source", F.lit("document.pdf")))
    return kept.where(F.length("text") > 0)


def by_condition(signals: DataFrame, conditions: DataFrame, names: tuple[str, ...] = ("dense", "bm25", "graph")) -> DataFrame:
    """``condition``, ``qid``, ``id``, ``fused`` for each row of ``conditions`` (``condition`` and a weight for each signal), as
    :func:`weighted` has it. Signals are normalised and pivoted once for all conditions."""
    normed = min_max(signals)
    value = lambda s: F.coalesce(F.max(F.when(F.col("signal") == s, F.col("norm"))), F.lit(0.0)).alias(f"{s}_n")
    has = normed.groupBy("qid").agg(*[F.max((F.col("signal") == s).cast("double")).alias(f"{s}_h") for s in names])
    rows = normed.groupBy("qid", "id").agg(*map(value, names)).join(has, "qid").join(F.broadcast(conditions), F.lit(True))
    total = sum((F.col(s) * F.col(f"{s}_h") for s in names[1:]), F.col(names[0]) * F.col(f"{names[0]}_h"))
    fused = sum((F.col(s) * F.col(f"{s}_h") * F.col(f"{s}_n") for s in names[1:]), F.col(names[0]) * F.col(f"{names[0]}_h") * F.col(f"{names[0]}_n"))
    return rows.where(total > 0).select("condition", "qid", "id", F.round(fused / total, 6).alias("fused"))


def near_tie_cutoff(ranked: DataFrame, score: str, base: int, gap: float = 0.02, extra: int = 20) -> DataFrame:
    """The first ``base`` of each query, and what follows with gaps of at most ``gap``, ``extra`` more at most."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    rows = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= base + extra)
    rows = rows.withColumn("drop_", F.lag(score).over(order) - F.col(score))
    every = Window.partitionBy("qid")
    stop = F.min(F.when((F.col("rank") > base) & (F.col("drop_") > gap), F.col("rank"))).over(every)
    return rows.withColumn("stop_", stop).where(F.col("stop_").isNull() | (F.col("rank") < F.col("stop_"))).drop("drop_", "stop_")


def elbow_cutoff(ranked: DataFrame, score: str, least: int = 3, most: int = 15, times: float = 1.0) -> DataFrame:
    """The first ``most`` of each query, cut after the first gap of more than ``times`` standard deviations; the gap that
    follows the first ``least`` rows is not tested."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    every = Window.partitionBy("qid")
    rows = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = rows.withColumn("gap_", F.round(F.col(score) - F.lead(score).over(order), 6)).withColumn("n_", F.count("*").over(every)).withColumn("std_", F.stddev_pop(score).over(every))
    std = F.when(F.col("std_") == 0, 1e-6).otherwise(F.round("std_", 6))
    first = F.min(F.when((F.col("rank") > least) & (F.col("gap_") > times * std), F.col("rank"))).over(every)
    return rows.withColumn("cut_", first).where((F.col("n_") <= least) | F.col("cut_").isNull() | (F.col("rank") <= F.col("cut_"))).drop("gap_", "n_", "std_", "cut_")


def reciprocal_rank(lists: DataFrame, k: int = 60) -> DataFrame:
    """``lists`` has qid, retriever, id, rank (from 1), score. Gives ``rrf``, ``retrievers`` (sorted, with repeats) and the best raw score's retriever."""
    return lists.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf"),
        F.array_join(F.array_sort(F.collect_list("retriever")), ",").alias("retrievers"),
        F.max_by("retriever", F.struct(F.col("score"), (-F.col("rank")).alias("r"), "retriever")).alias("representative"),
    )


def gather(channels: dict[str, Callable[[], DataFrame]], workers: int = 6) -> tuple[DataFrame | None, dict[str, Exception]]:
    """The ranked lists of several channels as one table, ``qid``, ``retriever``, ``variant``, ``id``, ``rank``, ``score``, and what failed. A channel is a function that gives a list for all
    questions and variants at once; channels run side by side, ``workers`` at a time. One that fails, when it is planned or when it runs, gives no rows."""
    def run(item: tuple[str, Callable[[], DataFrame]]) -> DataFrame | Exception:
        name, make = item
        try:
            rows = make()
            variant = F.col("variant") if "variant" in rows.columns else F.lit(0)
            return settle(rows.select("qid", F.lit(name).alias("retriever"), variant.cast("int").alias("variant"), "id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")))
        except Exception as e:  # noqa: BLE001  whatever a channel raises, the others go on
            logging.getLogger(__name__).warning("channel %s failed: %s", name, e)
            return e

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        got = dict(zip(channels, pool.map(run, channels.items()), strict=True))
    found = [x for x in got.values() if isinstance(x, DataFrame)]
    out = found[0] if found else None
    for more in found[1:]:
        out = out.unionByName(more)
    return out, {k: x for k, x in got.items() if isinstance(x, Exception)}


def candidates(lists: DataFrame, cap: int = 30, k: int = 60) -> DataFrame:
    """``qid``, ``id``, ``rrf``, ``retrievers``, ``representative``, ``place``: the ``cap`` best of each question by reciprocal ranks over all its lists."""
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), "id")
    return reciprocal_rank(lists, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def distinct_variants(variants: DataFrame, most: int = 4) -> DataFrame:
    """Query variants (qid, ordinal, variant): distinct without regard to case, the first kept, ``most`` for a query."""
    first = variants.groupBy("qid", F.lower(F.trim("variant")).alias("folded")).agg(F.min(F.struct("ordinal", "variant")).alias("f"))
    order = Window.partitionBy("qid").orderBy("ordinal")
    rows = first.select("qid", "f.ordinal", "f.variant").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= most).select("qid", "place", "variant")


def section_intent(query: Column) -> Column:
    q = F.lower(query)
    return F.when(q.contains("treat") | q.contains("manag"), "Treatment").when(q.contains("diagnos"), "Diagnosis").when(q.contains("prognos"), "Prognosis").when(q.contains("risk"), "Risk")


def cache_key(query: Column) -> Column:
    return F.sha2(F.lower(F.trim(query)), 256)
