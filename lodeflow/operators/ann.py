"""Vector search by inverted lists: approximate with an audited recall, or exact with lists ruled out by their bounds.

Vectors go to the list of the nearest of some centres (:func:`build`); a list is kept as blocks of :data:`BLOCK` vectors, so a list of
any size is many rows. A question is sent to the lists whose centres are nearest, and questions meet blocks in a join on the list, many of each in one
row (:func:`search`). The angle between a question and a list's centre, less the list's greatest angle, is the least that any of its vectors can have: with
``certified`` the lists that this does not rule out are searched too, and the result is that of an exact search.

Centres are fitted in one task to a bounded sample, and are, with one radius each, all that passes the driver: ``n_lists`` rows,
:data:`MOST_LISTS` at most. Neither vectors nor questions do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IndexError_
from . import vectors
from .storage import settle

#: Vectors and questions of a block; blocks of a list that one task gets with the list's questions; lists of an index at most.
BLOCK, ASKED, GROUP, MOST_LISTS = 1_024, 256, 64, 4_096
#: Bytes of unit vectors that a task sends out at once, and of cosines to centres that it holds.
ROOM = 32 << 20
#: What rounding may hide of an angle between two unit vectors.
SLACK = 2e-6


@dataclass(frozen=True)
class Lists:
    """``blocks`` (length, list, part, n, rows of id, tag and unit vector) and ``centres`` (length, list, centre, radius, n)."""

    blocks: DataFrame
    centres: DataFrame


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null, infinite or missing component, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _rows(df: DataFrame, key: str, vector: str, tag: str | None) -> DataFrame:
    tagged = F.col(tag).cast("string") if tag else F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("long").alias("id"), tagged.alias("tag"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(usable(F.col("v"))).withColumn("length", F.size("v"))


def _units(b, known: dict):
    """Of a batch, by length: places in it, and unit vectors; so many at once that a vector for each of their lists, or a cosine to each centre, takes :data:`ROOM` bytes at most."""
    import numpy as np

    lengths = b.column("length").to_numpy()
    flat, ends = b.column("v").flatten().to_numpy(), np.cumsum(lengths)
    for n in np.unique(lengths).tolist():
        every = np.flatnonzero(lengths == n)
        step = max(1, ROOM // (8 * n * (len(known[n][0]) if n in known else 1)))
        for at in (every[i : i + step] for i in range(0, len(every), step)):
            yield n, at, _unit(flat[(ends[at] - n)[:, None] + np.arange(n)])


def _unit(x):
    """Rows of length 1, however small or large they were."""
    import numpy as np

    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(rows: DataFrame, n_lists: int, sample: int, rounds: int) -> DataFrame:
    """Centres by length: a few rounds of spherical means over the sample, whose first rows by hash are the first centres."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = _unit(np.array(pdf.sort_values(["hash", "id"])["v"].tolist(), np.float64))
        centres = np.unique(x, axis=0)
        centres = x[: max(1, min(n_lists, len(centres)))].copy()
        for _ in range(rounds):
            near = np.concatenate([np.argmax(x[i : i + BLOCK] @ centres.T, 1) for i in range(0, len(x), BLOCK)])
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1)
            centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
        return pd.DataFrame({"length": [int(pdf["length"].iloc[0])] * len(centres), "list": range(len(centres)), "centre": list(centres)})

    few = rows.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id").limit(sample)
    return few.groupBy("length").applyInPandas(run, "length int, list int, centre array<double>")


def _known(centres: DataFrame) -> dict:
    """Centres and radii by length, as tasks get them: a bounded number of rows."""
    import numpy as np

    by: dict[int, list] = {}
    for r in centres.orderBy("length", "list").collect():
        by.setdefault(r["length"], []).append(r)
    return {n: (np.array([r["list"] for r in rs]), np.array([r["centre"] for r in rs]), np.array([r.asDict().get("radius") or 0.0 for r in rs])) for n, rs in by.items()}


def build(corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", tag: str | None = None, n_lists: int | None = None, sample: int = 20_000, rounds: int = 6) -> Lists:
    """The index of ``corpus``. ``n_lists``: the root of the number of rows, unless given. All rows are indexed that have a direction; vectors of
    a length that the sample has none of make one list of their own."""
    import pyarrow as pa

    rows = settle(_rows(corpus, key, vector, tag))
    total = rows.count()
    n_lists = max(1, min(MOST_LISTS, n_lists or round(total**0.5)))
    fitted = settle(_fit(rows, n_lists, max(sample, 1), rounds))
    sent = rows.sparkSession.sparkContext.broadcast(_known(fitted))

    def assign(batches):
        import numpy as np

        for b in batches:
            for n, at, x in _units(b, sent.value):
                lists, centres, _ = sent.value.get(n, (np.array([0]), x[:1] * 0.0, None))
                cos = x @ centres.T
                near = np.argmax(cos, 1)
                angle = np.arccos(np.clip(cos[np.arange(len(x)), near], -1, 1))
                taken = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("tag"), pa.array(np.full(len(at), n, np.int32)), pa.array(lists[near].astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(angle)], ["id", "tag", "length", "list", "unit", "angle"])

    placed = settle(rows.mapInArrow(assign, "id long, tag string, length int, list int, unit binary, angle double"))
    sizes = placed.groupBy("length", "list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    radius = F.when(F.col("centre").isNull(), F.lit(4.0)).otherwise(F.col("radius"))  # without a centre nothing is ruled out
    centres = settle(sizes.join(fitted, ["length", "list"], "left").select("length", "list", F.coalesce("centre", F.transform(F.sequence(F.lit(1), "length"), lambda _: F.lit(0.0))).alias("centre"), radius.alias("radius"), "n"))
    dealt = placed.join(F.broadcast(centres.select("length", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))), ["length", "list"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "tag", "unit"), "parts").cast("int"))
    blocks = dealt.groupBy("length", "list", "part").agg(F.count("*").cast("int").alias("n"), F.collect_list(F.struct("id", "tag", "unit")).alias("rows"))
    return Lists(settle(blocks), centres)


def _asked(queries: DataFrame, known, probes: int | None, tagged: bool, best: str | None = None) -> DataFrame:
    """Questions by list: the ``probes`` nearest, or with ``best``, a column of the least cosine that still counts, all others that may hold one."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            for n, at, x in _units(b, known.value):
                if n not in known.value:
                    continue
                lists, centres, radius = known.value[n]
                angle = np.arccos(np.clip(x @ centres.T, -1, 1))
                angle[:, ~centres.any(1)] = 0.0
                order = np.argsort(angle, axis=1, kind="stable")
                if best is None:
                    hit = np.zeros(angle.shape, bool)
                    np.put_along_axis(hit, order[:, :probes], True, axis=1)
                else:
                    least = b.column(best).take(pa.array(at)).to_numpy(zero_copy_only=False)
                    within = np.arccos(np.clip(np.nan_to_num(least, nan=-1.0) - SLACK, -1, 1)) + SLACK
                    hit = angle - radius <= within[:, None]
                    np.put_along_axis(hit, order[:, :probes], False, axis=1)
                r, c = np.nonzero(hit)
                taken = b.take(pa.array(at[r]))
                units = [u.tobytes() for u in x]
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("tag"), pa.array(np.full(len(r), n, np.int32)), pa.array(lists[c].astype(np.int32)), pa.array([units[i] for i in r.tolist()], pa.binary())], ["qid", "qtag", "length", "list", "asked"])

    rows = queries.where(F.col("tag").isNotNull()) if tagged else queries
    return rows.mapInArrow(run, "qid long, qtag string, length int, list int, asked binary")


def _scored(ix: Lists, asked: DataFrame, k: int, tagged: bool) -> DataFrame:
    """``qid``, ``id``, ``score``, ``scanned``: each block's ``k`` best of each question with ties; a row without id says how many were looked at."""
    import pyarrow as pa

    sizes = asked.groupBy("length", "list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("deals"))
    dealt = asked.join(sizes, ["length", "list"]).withColumn("deal", F.pmod(F.xxhash64("qid", "asked"), "deals").cast("int"))
    packed = dealt.groupBy("length", "list", "deal").agg(F.collect_list(F.struct("qid", "qtag", "asked")).alias("asks"))
    groups = ix.centres.select("length", "list", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / (BLOCK * GROUP)).cast("int"))).alias("group"))
    blocks = ix.blocks.withColumn("group", F.floor(F.col("part") / GROUP).cast("int"))
    pairs = packed.join(groups, ["length", "list"]).join(blocks, ["length", "list", "group"]).select("length", "asks", "rows")

    def run(batches):
        import numpy as np

        for b in batches:
            for i in range(b.num_rows):
                n = b.column("length")[i].as_py()
                asks, rows = b.column("asks")[i].values, b.column("rows")[i].values
                qids, ids = asks.field("qid").to_numpy(zero_copy_only=False), rows.field("id").to_numpy(zero_copy_only=False)
                matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, n)
                s = np.round(matrix(asks.field("asked")) @ matrix(rows.field("unit")).T, 6)
                s[qids[:, None] == ids[None, :]] = -9
                if tagged:
                    s[np.array(asks.field("qtag").to_pylist(), object)[:, None] != np.array(rows.field("tag").to_pylist(), object)[None, :]] = -9
                least = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else -8.0
                r, c = np.nonzero((s >= least) & (s > -9))
                whole = np.arange(len(qids))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((qids[r], qids[whole]))), pa.array([*ids[c].tolist(), *[None] * len(qids)], pa.int64()), pa.array([*s[r, c].tolist(), *[None] * len(qids)], pa.float64()), pa.array(np.concatenate((np.zeros(len(r), np.int64), np.full(len(qids), len(ids)))))], ["qid", "id", "score", "scanned"])

    return pairs.mapInArrow(run, "qid long, id long, score double, scanned long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.where(F.col("id").isNotNull()).select("qid", "id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(ix: Lists, queries: DataFrame, k: int, probes: int = 8, key: str = "vec_id", vector: str = "embedding", tag: str | None = None, certified: bool = False) -> tuple[DataFrame, DataFrame]:
    """``qid``, ``id``, ``score`` (cosine, 6 decimals), ``rank``; and ``qid``, ``scanned``, the vectors that each question was compared with. As
    :func:`vectors.nearest` has it: a question's own id is left out, and with ``tag`` only rows with its tag count. ``certified`` searches
    every list that may hold one of the ``k``."""
    if k < 1 or probes < 1:
        raise IndexError_("at least one neighbour and one list are asked for")
    known = queries.sparkSession.sparkContext.broadcast(_known(ix.centres))
    rows = _rows(queries, key, vector, tag)
    found = settle(_scored(ix, _asked(rows, known, probes, tag is not None), k, tag is not None))
    if certified:
        have = _top(found, k).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = have.select(F.col("qid").alias("id"), F.when(F.col("n") >= k, F.col("least")).otherwise(-1.0).alias("least"))
        more = _asked(rows.join(least, "id", "left"), known, probes, tag is not None, "least")
        found = settle(found.union(_scored(ix, more, k, tag is not None)))
    return _top(found, k), found.where(F.col("id").isNull()).groupBy("qid").agg(F.sum("scanned").alias("scanned"))


def audit(ix: Lists, corpus: DataFrame, queries: DataFrame, k: int, probes: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: ``n_queries``, ``recall`` at ``k`` against the exact search, ``scanned`` (mean share of the rows that a question was compared with)."""
    near, seen = search(ix, queries, k, probes, key, vector)
    exact = vectors.nearest(corpus, queries, k, key, vector)
    kept = exact.join(near.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("due"), F.count("hit").alias("hits"))
    rows = ix.centres.agg(F.sum("n").alias("rows"))
    return kept.join(seen, "qid", "left").agg(F.count("*").alias("n_queries"), (F.sum("hits") / F.sum("due")).alias("recall"), F.avg("scanned").alias("mean_")).join(rows, F.lit(True)).select("n_queries", F.coalesce("recall", F.lit(1.0)).alias("recall"), (F.col("mean_") / F.col("rows")).alias("scanned"))


def fitted_probes(ix: Lists, corpus: DataFrame, queries: DataFrame, k: int, least: float = 0.95, sample: int = 200, key: str = "vec_id", vector: str = "embedding") -> tuple[int, float]:
    """The number of lists to search for a recall of ``least``, and the recall, by the audit of ``sample`` of the questions; doubled until it is
    reached or all lists are searched."""
    some = settle(queries.orderBy(F.xxhash64(key, F.lit(7)), key).limit(sample))
    n_lists, probes = ix.centres.count(), 1
    while True:
        recall = audit(ix, corpus, some, k, probes, key, vector).first()["recall"]
        if recall >= least or probes >= n_lists:
            return probes, recall
        probes = min(2 * probes, n_lists)
