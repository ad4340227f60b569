"""Connected components of links, and a map over sorted groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release_state


#: Links that one task holds.
FEW = 500_000
#: Rows of a key that are not dealt to more tasks.
HOT = 1_000


def hot_join(rows: DataFrame, facts: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``facts`` for their ``key``. Rows of a key that has more than :data:`HOT` of them are dealt by a
    hash of ``spread`` too, and the fact of such a key is repeated. At most 20,000 keys have a share of rows that
    makes them hot, so the list of them is small."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_"))
    total, nulls = rows.agg(F.count("*"), F.count(F.when(F.col(key).isNull(), 1))).first()
    hot = cut(counts.where(F.col("rows_") > max(HOT, total // 20_000)).select(key, F.ceil(F.col("rows_") / HOT).cast("int").alias("deals_")))
    if nulls <= HOT and hot.isEmpty():
        return rows.join(facts, key, how)
    deals = F.when(F.col(key).isNull(), min(-(-nulls // HOT), 20_000)).otherwise(F.coalesce("deals_", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("deal_", F.pmod(F.xxhash64(spread), deals).cast("int")).drop("deals_")
    repeated = facts.join(F.broadcast(hot), key, "left").withColumn("deal_", F.explode(F.sequence(F.lit(0), F.coalesce("deals_", F.lit(1)) - 1))).drop("deals_")
    return dealt.join(repeated, [key, "deal_"], how).drop("deal_")


def _roots(batches):
    """Each id of some links, and the least id that it hangs together with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    ids = list(root)
    for i in range(0, len(ids), 100_000):
        some = ids[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["id", "component"])


def _pairs(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in a link with another.

    Alternates two steps until nothing changes: each id's larger neighbours are linked with the least
    of its neighbours and itself, then each id's smaller neighbours are. Least values are aggregated
    before the shuffle and joined back, so an id with very many links is a skewed join with one row on
    the other side. Lineage is cut at each turn. Once :data:`FEW` links are left, 16 bytes each, one task ends the work.
    Null ends and self-links don't count; repeated links count once.
    """
    now = cut(links.where(F.col(a) != F.col(b)).select(*_pairs(F.col(a), F.col(b))).distinct())
    before = None
    while True:
        if now.count() <= FEW:
            return cut(now.coalesce(1).mapInArrow(_roots, "id long, component long"))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.where("a != m").select(*_pairs(F.col("a"), F.col("m"))).union(low.select(F.col("m").alias("a"), F.col("b")))
        now = cut(small.distinct())
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over runs of whole groups. Groups must be of bounded size; many small ones go together,
    which saves the cost of a call for each. ``fn`` gets a table sorted by ``keys``."""

    def run(batches):
        release_state()
        held: list[pa.RecordBatch] = []

        def last_start(b: pa.RecordBatch) -> int:
            """Where the last group of a batch begins."""
            i = b.num_rows - 1
            key = [b.column(k)[i].as_py() for k in keys]
            lo, hi = 0, i  # rows from some place on have this key
            while lo < hi:
                mid = (lo + hi) // 2
                if [b.column(k)[mid].as_py() for k in keys] == key:
                    hi = mid
                else:
                    lo = mid + 1
            return lo

        def same(b: pa.RecordBatch) -> bool:
            return bool(held) and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)

        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                start = last_start(part)
                if start:
                    yield from fn(pa.Table.from_batches([*held, part.slice(0, start)]))
                    held = [part.slice(start)]
                elif same(part):
                    held.append(part)
                else:
                    if held:
                        yield from fn(pa.Table.from_batches(held))
                    held = [part]
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_bounds(columns) -> "tuple":
    """Starts and ends of the groups of sorted columns."""
    import numpy as np

    arrays = [np.asarray(c) for c in columns]
    n = len(arrays[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in arrays:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)
