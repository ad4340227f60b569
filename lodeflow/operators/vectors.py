"""Exact vector search for a set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the executors at once; rows that a task compares with them at once.
BLOCK, ROWS = 4_096, 2_048


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", tag: str | None = None) -> DataFrame:
    """``qid``, ``id``, ``score`` (cosine, 6 decimals), ``rank``: the ``k`` nearest of each query, itself left out. With
    ``tag``, only rows with the query's tag count; a null tag fits no row. Queries without a vector, or with a null
    component, have no neighbours; only vectors of a query's length count. Queries go out in blocks of a fixed number; each task keeps its own
    best ``k`` over all its rows, so what is shuffled does not grow with a task's rows."""
    named = queries.select(F.col(key).alias("qid"), F.col(vector).alias("v"), (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("t"))
    rows = corpus.select(F.col(key).alias("id"), F.col(vector).alias("v"), (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("t"))
    held: list = []
    parts: list[DataFrame] = []

    def flush():
        parts.append(_block(rows, [(r["qid"], r["v"], r["t"]) for r in held], k, tag is not None))
        held.clear()

    for row in named.orderBy("qid").toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            flush()
    if held or not parts:
        flush()
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, queries: list, k: int, tagged: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]):
        import numpy as np

        by: dict[int, list] = {}
        for q in shared.value:
            if q[1] and None not in q[1] and not (tagged and q[2] is None):
                by.setdefault(len(q[1]), []).append(q)
        def unit(m):
            m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-320)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        asked = {n: (unit(np.array([x[1] for x in qs], np.float64)), np.array([x[0] for x in qs]), np.array([x[2] for x in qs], object)) for n, qs in by.items()}
        held: list[list] = [[], [], []]  # qid, id, score of what is among the best so far

        def best():
            qid, id_, score = (np.concatenate(x) for x in held)
            order = np.lexsort((id_, -score, qid))
            qid = qid[order]
            starts = np.flatnonzero(np.diff(qid, prepend=qid[0] - 1))
            keep = order[np.arange(len(qid)) - np.repeat(starts, np.diff(np.append(starts, len(qid)))) < k]
            return [[x[keep]] for x in (np.concatenate(h) for h in held)]

        room = 4 * k * max(1, len(shared.value)) + 100_000
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            vectors_ = b.column("v").to_pylist()
            for n, (q, qids, tags) in asked.items():
                usable = [i for i, v in enumerate(vectors_) if v and len(v) == n and None not in v]
                if not usable:
                    continue
                x = unit(np.array([vectors_[i] for i in usable], np.float64))
                ids, own = b.column("id").take(pa.array(usable)).to_numpy(), np.array(b.column("t").take(pa.array(usable)).to_pylist(), object)
                for i in range(0, len(q), 256):
                    s = np.round(q[i : i + 256] @ x.T, 6)
                    s[qids[i : i + 256][:, None] == ids[None, :]] = -9
                    if tagged:
                        s[tags[i : i + 256][:, None] != own[None, :]] = -9
                    if s.shape[1] > k:
                        least = np.partition(s, -k, axis=1)[:, -k][:, None]
                        keep = (s >= least) & (s > -9)
                    else:
                        keep = s > -9
                    r, c = np.nonzero(keep)
                    for rows_, got in zip(held, (qids[i + r], ids[c], s[r, c]), strict=True):
                        rows_.append(got)
                    if sum(map(len, held[0])) > room:
                        held[:] = best()
        if held[0] and sum(map(len, held[0])):
            yield pa.RecordBatch.from_arrays([pa.array(x[0]) for x in best()], ["qid", "id", "score"])

    return rows.mapInArrow(run, "qid long, id long, score double")


def nearest_in_section(corpus: DataFrame, queries: DataFrame, k: int, section: str, wanted, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Two steps: the ``10 * k`` nearest, then those whose ``section`` fits ``wanted`` (a condition on ``section`` and the
    query's ``wanted_section``), ``k`` at most. The filter stays above the first limit."""
    near = nearest(corpus, queries, 10 * k, key, vector)
    of = corpus.select(F.col(key).alias("id"), F.col(section).alias("section"))
    asked = queries.select(F.col(key).alias("qid"), F.col(section).alias("wanted_section"))
    fit = near.join(of, "id").join(asked, "qid").where(wanted)
    order = Window.partitionBy("qid").orderBy("rank")
    return fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("qid", "id", "score", "place")
