"""Mixing sources to target weights by cube-method balanced sampling.

Sources, by code point with null last, weigh 3, 1, 2, and so on again, and share a multiple of all words.
A source's target stops at a multiple of its own words; what is above goes to the others by weight. A
target of ``r`` times a source's words takes each of its documents ``floor(r)`` times, and once more with
probability ``r - floor(r)``. Which ones is drawn by the cube method: probabilities move along the null space of
two constraints, the drawn words and the drawn documents, until each is 0 or 1 (flight). A block of
documents ends with two undecided ones at most; these meet in blocks of the next level, until one block for
each source is left (landing): its last two are decided so that the number of documents stays within one of
its target and words come nearest, and then a few drawn documents are exchanged, put in or out, so that words come
nearer and the number stays within one. Where :data:`FEW` documents are left all ways to draw them are compared.

Only ids, sources, sizes and a hash of the text move. Blocks are dealt by hash within a source, and rows that are alike in
all of these are numbered, so neither a hot source nor an id that many rows share makes a block larger. Draws depend
on these and a seed alone, so reruns agree.

Cases: a null text has size 0 and may be taken or not. Rows that share an id, or null ids, are separate documents;
alike rows get the copies that fall to them in the order of a hash of all their columns. A source without words has
target 0; a null source is one source. Very long texts are counted whole. An empty table gives an empty result. Other columns of
the input are not read by the plan; the mix keeps them all, whatever their names but those that end in "_" here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words, table
from .graph import group_bounds, map_groups

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK, SEED = 2_048, 11
#: Documents of a source's last block of which all ways to draw them are compared.
FEW = 12
_NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: ``ordinal``, ``source_size``, ``n`` and ``target``. ``sizes`` has ``source`` and ``size``.

    Water-filling: with sources by ``cap / weight``, the level that is reached when all sources before one
    are full is greatest at the first that isn't, and is there the level of all that aren't. One row for
    each source is ordered in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("ordinal", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("ordinal") - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - full) / left)
    per = per.withColumn("level", F.max("level").over(every))
    return per.select("source", "ordinal", "source_size", "n", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def flight(p: list[float], size: list[float], rng: np.random.Generator) -> None:
    """Moves ``p`` in place until at most two are undecided, keeping sum(p) and sum(p * size)."""
    draws = iter(())
    active: list[int] = []
    waiting = iter(range(len(p)))
    while True:
        active = [i for i in active if _NEAR < p[i] < 1 - _NEAR]
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            if _NEAR < p[i] < 1 - _NEAR:
                active.append(i)
        if len(active) == 3:
            i, j, k = active
            u = (size[j] - size[k], size[k] - size[i], size[i] - size[j])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1.0, -1.0)
        else:
            return
        up = down = float("inf")
        for i, d in zip(active, u, strict=False):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(256).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, d in zip(active, u, strict=False):
            q = p[i] + step * d
            p[i] = 0.0 if q < _NEAR else 1.0 if q > 1 - _NEAR else q


def landing(p: list[float], size: list[float], count: float, wanted: float) -> None:
    """Decides what is left (two at most): the number of documents stays within one of ``count``, and of these ways the one
    holds whose words come nearest to ``wanted``. Then, eight times at most, a drawn document is exchanged for one that
    isn't, or one is put in or out where the number stays within one of ``count``, if words come nearer. Of
    :data:`FEW` documents or less the drawn ones are chosen anew, by the same order of aims."""
    import bisect
    import itertools

    if len(p) <= FEW:
        ways = (w for w in itertools.product((0.0, 1.0), repeat=len(p)) if abs(sum(w) - count) < 1)
        p[:] = min(ways, key=lambda w: (abs(sum(x * s for x, s in zip(w, size, strict=True)) - wanted), abs(sum(w) - count), w))
        return
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    drawn, settled = sum(x == 1 for x in p), sum(s for x, s in zip(p, size, strict=True) if x == 1)
    options = [o for n in range(1 << len(left)) if abs(drawn + sum(o := [n >> b & 1 for b in range(len(left))]) - count) < 1]
    best = min(options, key=lambda o: (abs(settled + sum(x * size[i] for x, i in zip(o, left, strict=True)) - wanted), abs(drawn + sum(o) - count), o))
    for i, x in zip(left, best, strict=True):
        p[i] = float(x)
    for _ in range(8):
        drawn, off = sum(p), sum(s for x, s in zip(p, size, strict=True) if x == 1) - wanted
        out = sorted((s, i) for i, (x, s) in enumerate(zip(p, size, strict=True)) if x == 0)
        found = (abs(off), -1, -1)
        if abs(drawn - 1 - count) < 1:
            found = min([found, *((abs(off - s), i, -1) for i, s in enumerate(size) if p[i] == 1)])
        for i, s in [*([(-1, 0.0)] if abs(drawn + 1 - count) < 1 else []), *((i, s) for i, (x, s) in enumerate(zip(p, size, strict=True)) if x == 1)]:
            at = bisect.bisect(out, (s - off, -1))
            for t, j in out[max(0, at - 1) : at + 1]:
                found = min(found, (abs(off - s + t), i, j))
        if found[1] == found[2] == -1:
            break
        for i, x in ((found[1], 0.0), (found[2], 1.0)):
            if i >= 0:
                p[i] = x


UNITS = "ordinal int, block long, id long, size long, tie long, nth long, chance double, n long"


def _level(units: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    def run(t: pa.Table):
        t = t.combine_chunks()
        starts, ends = group_bounds([t.column("ordinal").to_numpy(), t.column("block").to_numpy()])
        ids, sizes, chances = t.column("id").to_numpy(zero_copy_only=False), t.column("size").to_numpy(), t.column("chance").to_numpy()
        ties, nth = t.column("tie").to_numpy(), t.column("nth").to_numpy()
        known = t.column("id").is_valid().to_numpy()
        ids = np.where(known, ids, 0).astype(np.int64)
        out = chances.copy()
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            order = lo + np.lexsort((nth[lo:hi], ties[lo:hi], sizes[lo:hi], ids[lo:hi], known[lo:hi]))
            key = (seed, level, int(t.column("ordinal")[lo].as_py()), int(t.column("block")[lo].as_py()))
            rng = np.random.default_rng(key)
            order = order[rng.permutation(hi - lo)]
            p = chances[order].tolist()
            s = sizes[order].astype(float).tolist()
            flight(p, s, rng)
            if last:
                landing(p, s, float(chances[order].sum()), float((chances[order] * sizes[order]).sum()))
            out[order] = p
        at = t.schema.get_field_index("chance")
        yield from t.set_column(at, "chance", pa.array(out)).to_batches()

    return map_groups(units, ["ordinal", "block"], run, UNITS)


def _ratio() -> Column:
    """How often a source's words are taken."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return F.when(F.abs(ratio - F.round(ratio)) < _NEAR, F.round(ratio)).otherwise(ratio)


def _decided(docs: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """``id``, ``source``, ``size``, ``tie`` (hash of the text), ``nth`` of alike rows, ``source_size``, ``target`` and ``copies``."""
    sized = docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("tie"))
    sized = cut(sized.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("alike")).select("id", "source", "size", "tie", F.explode(F.sequence(F.lit(1).cast("long"), "alike")).alias("nth")))
    per = cut(targets(sized, weights, share, most))
    named = F.broadcast(per) if per.count() <= 10_000 else per
    units = sized.join(named, sized["source"].eqNullSafe(per["source"])).select("ordinal", "id", "size", "tie", "nth", "n", _ratio().alias("ratio"))
    block = F.floor(F.pmod(F.xxhash64("id", "size", "tie", "nth"), F.ceil(F.col("n") / BLOCK))).alias("block")
    units = units.select("ordinal", block, "id", "size", "tie", "nth", (F.col("ratio") - F.floor("ratio")).alias("chance"), "n")
    widest = per.agg(F.max("n")).first()[0] or 0
    blocks, level, decided = -(-widest // BLOCK), 0, None
    while True:
        level += 1
        units = cut(_level(units, level, blocks <= 1, seed))
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done = units.where(~open_).select("ordinal", "id", "size", "tie", "nth", "chance")
        decided = done if decided is None else decided.union(done)
        if blocks <= 1:
            break
        merge = BLOCK // 2
        blocks = -(-blocks // merge)
        units = units.where(open_).withColumn("block", F.floor(F.col("block") / merge))
    chosen = decided.join(named, "ordinal")
    return chosen.select("id", "source", "size", "tie", "nth", "source_size", "target", (F.floor(_ratio()) + F.col("chance")).cast("long").alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """For each document ``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies)."""
    chosen = _decided(docs, key, source, text, weights, share, most, seed)
    return chosen.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    names = docs.columns
    own = ["id_", "source_", "tie_"]
    plan = _decided(docs, key, source, text, weights, share, most, seed).select(F.col("id").alias("id_"), F.col("source").alias("source_"), F.col("tie").alias("tie_"), F.col("nth").alias("nth_"), F.col("copies").alias("copies_"))
    plan = plan.groupBy(*own).agg(F.count("*").alias("alike_"), F.sum("copies_").alias("copies_"))
    rows = docs.select(*names, F.col(key).cast("long").alias("key_"), F.col(source).alias("from_"), F.xxhash64(text).alias("text_tie_"))
    same = rows["key_"].eqNullSafe(plan["id_"]) & rows["from_"].eqNullSafe(plan["source_"]) & (rows["text_tie_"] == plan["tie_"])
    both = rows.join(plan, same).where("copies_ > 0")
    repeat = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy_")
    alone = both.where("alike_ = 1").select(*names, repeat(F.col("copies_")))
    # copies of alike rows are shared out: as many for each, and one more for the first of them
    order = Window.partitionBy(*own).orderBy(F.xxhash64(*names))
    each = F.floor(F.col("copies_") / F.col("alike_"))
    alike = both.where("alike_ > 1").withColumn("n_", each + F.when(F.row_number().over(order) <= F.col("copies_") - each * F.col("alike_"), 1).otherwise(0))
    return alone.union(alike.where("n_ > 0").select(*names, repeat(F.col("n_")))).select(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL: dict[str, str] = {}
