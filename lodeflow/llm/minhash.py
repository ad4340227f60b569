"""MinHash near-dedup with tensored banding.

A document is its set of distinct word shingles (64-bit hashes; ASCII letters lower-cased). Documents
with equal sets are one. For the others two small collections of minhash triples are made; a table's key
joins a triple of the first with a triple of the second, so ``n * n`` tables take ``6 n`` minhashes and not
``6 n * n``. A pair of documents whose similarity is ``s`` is missed if it agrees in no triple of one
collection: ``2 (1 - s^3)^n`` at most; ``n`` is the least that makes this 5 in 10,000 at the threshold.
Keys are made only of triples that another document has too, as no other key can be shared.

Candidates are compared by their whole sets. In a table's bucket each document is compared with the one
that shares the most buckets, which links a group of copies with one comparison each. Where what that
document collects falls into several components, its members are compared with each other in pairs of blocks of
:data:`BLOCK`; a task holds two blocks and returns only links that join what it has not joined yet. So
every pair in a bucket is linked if it should be, and no join makes all pairs of a group.

Sets travel for documents in candidate pairs only. Buckets and links are joined and aggregated, never
gathered, so a hot bucket is a skewed join with one row on the other side.

Cases: a null or empty text, or one without words, has no shingles and links with nothing. Fewer words
than a shingle has make one shingle. Rows that share an id are one document, linked if any of them is; each is returned.
A null id links with nothing and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, release_state, small_batches, table
from .graph import connected_components, group_bounds, hot_join, map_groups

PIECE = 1 << 20
#: Ids of this many documents, 8 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents in a block of a group that one document does not hold together.
BLOCK = 128

_ROOT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tables(percent: int) -> int:
    """Size of each collection, for a similarity in hundredths."""
    miss = 1 - (percent / 100) ** 3
    return max(1, math.ceil(math.log(2.5e-4) / math.log(miss))) if miss > 0 else 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of the words and shingles of texts."""

    def __init__(self, words: int):
        self.words = words
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[65:91] += np.uint64(32)
        self.lower += np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self._powers(PIECE)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            root, back = np.uint64(_ROOT), np.uint64(pow(_ROOT, -1, 1 << 64))
            self.power, self.inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
            np.cumprod(np.full(n - 1, root), out=self.power[1:])
            np.cumprod(np.full(n - 1, back), out=self.inverse[1:])

    def _of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in some bytes, and where they start."""
        if len(data) > len(self.power):
            self._powers(len(data))
        word = ~self.space[data]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.lower[data] * self.power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts]), starts

    def hashes(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Of each text's words, in order. Texts go through in pieces; a long one is cut where a word ends."""
        held: list[bytes] = []
        size = 0

        def flush():
            if not held:
                return
            got, starts = self._of(np.frombuffer(b" ".join(held), np.uint8))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(got, np.searchsorted(starts, ends[:-1]))

        for t in texts:
            data = (t or "").encode()
            if len(data) > PIECE:
                yield from flush()
                held, size = [], 0
                parts, at = [], 0
                while at < len(data):
                    end = at + PIECE
                    while end < len(data) and not self.space[data[end]]:
                        end += 1
                    parts.append(self._of(np.frombuffer(data[at:end], np.uint8))[0])
                    at = end
                yield np.concatenate(parts)
                continue
            if size + len(data) + 1 > PIECE:
                yield from flush()
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        yield from flush()

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Sorted distinct shingles of each text."""
        k = self.words
        for h in self.hashes(texts):
            n = len(h)
            if not n:
                yield h
                continue
            size = min(k, n)
            s = np.full(n - size + 1, np.uint64(size))
            for i in range(size):
                s = mix(s * np.uint64(0xD1342543DE82EF95) + h[i : n - size + 1 + i])
            yield np.unique(s)


def signatures(docs: DataFrame, key: str, text: str, words: int, n: int) -> DataFrame:
    """``id``, ``n_shingles``, ``digest`` of the set, and the two collections ``left`` and ``right``, each of ``n`` triples of minhashes."""

    def run(batches: Iterable[pa.RecordBatch]):
        import hashlib

        release_state()
        hasher = Hasher(words)
        rng = np.random.default_rng(20_011)
        flip, times = rng.integers(0, 1 << 63, 6 * n, dtype=np.uint64), rng.integers(0, 1 << 63, 6 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in slices(batches):
            sets = list(hasher.sets(b.column(1).to_pylist()))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = sizes > 0
            triples = np.zeros((len(sets), 2 * n), np.uint64)
            if full.any():
                every = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[full]
                least = np.stack([np.minimum.reduceat((every ^ f) * t, starts) for f, t in zip(flip, times, strict=True)], axis=1)
                triples[full] = mix(mix(least[:, 0::3] * np.uint64(_ROOT) + least[:, 1::3]) + least[:, 2::3])
            flat = triples.view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(x).ravel())) for x in (flat[:, :n], flat[:, n:])]
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), digests, *lists], ["id", "n_shingles", "digest", "left", "right"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, left array<long>, right array<long>")


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, ids: DataFrame) -> DataFrame:
    """``id`` and ``shingles`` (packed) of the documents in ``ids``. Few ids are broadcast, which spares the texts' shuffle."""
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "id")

    def run(batches):
        release_state()
        hasher = Hasher(words)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in hasher.sets(b.column(1).to_pylist())], pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        release_state()
        for b in slices(batches, 64):
            keep = []
            last, x = None, None
            for i, (p, q) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                if last is None or b.column("a")[i].as_py() != last:
                    last, x = b.column("a")[i].as_py(), np.frombuffer(p.as_buffer(), np.uint64)
                y = np.frombuffer(q.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return hot_join(pairs.join(right, "b"), left, "a", "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id) of the table keys whose two triples are both shared. ``reps`` has ``id``, ``left``, ``right``."""
    sides = [reps.select("id", F.lit(k).alias("side"), F.posexplode(c).alias("i", "value")) for k, c in enumerate(("left", "right"))]
    triples = sides[0].union(sides[1])
    shared = triples.groupBy("side", "i", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = triples.join(shared, ["side", "i", "value"])
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("i", "value")))  # noqa: E731  at most n each
    both = kept.groupBy("id").agg(of(0).alias("l"), of(1).alias("r"))
    pairs = both.select("id", F.explode("l").alias("l"), "r").select("id", "l", F.explode("r").alias("r"))
    return pairs.select(F.xxhash64("l.i", "r.i", "l.value", "r.value").alias("bucket"), "id")


def stars(keys: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): in each bucket, the document that shares the most buckets, and every other one."""
    counts = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keys.join(counts, "bucket"))
    rank = shared.groupBy("id").agg(F.sum("n").alias("rank"))
    ranked = shared.join(rank, "id")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("id")).alias("minus"))).alias("c")).select("bucket", (-F.col("c.minus")).alias("a"))
    return shared.join(centres, "bucket").where("a != id").select("a", F.col("id").alias("b")).distinct()


def _linked(sets: list[np.ndarray], block: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the sets of two blocks, or within one: a spanning forest of them."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    place = np.cumsum(new) - 1
    often = np.bincount(place) > 1  # a shingle that one document has adds nothing
    keep = often[place]
    owner, place = owner[keep], (np.cumsum(often) - 1)[place[keep]]
    shared = np.zeros((n, n), np.float32)
    step = 8_192
    for at in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(place, (at, at + step))
        m = np.zeros((n, step), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        shared += m @ m.T
    shared = shared.astype(np.int64)
    ok = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if block[0] != block[-1]:
        ok &= block[:, None] != block[None, :]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        p, q = find(int(i)), find(int(j))
        if p != q:
            root[p] = q
            yield int(i), int(j)


def linked_in_groups(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold the members of each group together; ``groups`` has distinct (centre, id)."""
    sizes = groups.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = placed.select("centre", "id", "block", other).select("centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")

    def run(t: pa.Table):
        t = t.sort_by([(c, "ascending") for c in ("centre", "i", "j", "block")]).combine_chunks()
        starts, ends = group_bounds([t.column(c).to_numpy() for c in ("centre", "i", "j")])
        ids, block, packed = t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("shingles")
        a, b = [], []
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            if hi - lo > 1:
                got = [np.frombuffer(packed[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                for i, j in _linked(got, block[lo:hi], percent):
                    a.append(ids[lo + i])
                    b.append(ids[lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_groups(tasks.join(sets, "id"), ["centre", "i", "j"], run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """For each row ``key``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    signed = cut(signatures(docs, key, text, words, tables(percent)))
    full = signed.where("n_shingles > 0 AND id IS NOT NULL")
    heads = full.groupBy("digest").agg(F.min("id").alias("head"))
    joined = full.join(heads, "digest")
    copies = joined.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    pairs = cut(stars(buckets(joined.where("id = head").select("id", "left", "right"))))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = cut(shingle_sets(docs, key, text, words, cut(ids)))
    with small_batches(docs.sparkSession):  # rows with two sets
        found = cut(copies.union(confirmed(pairs, sets, percent)))
    comp = connected_components(found)
    members = pairs.select(F.col("a").alias("centre"), F.col("b").alias("id")).union(pairs.select(F.col("a").alias("centre"), F.col("a").alias("id")).distinct())
    at = members.join(comp, "id", "left").select("centre", "id", F.coalesce("component", "id").alias("component"))
    parted = at.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x != y AND n > 2").select("centre")
    groups = cut(at.join(parted, "centre", "left_semi").select("centre", "id"))
    if not groups.isEmpty():
        with small_batches(docs.sparkSession):
            more = cut(linked_in_groups(groups, sets, percent))
        comp = connected_components(found.union(more))
    out = signed.select("id", "n_shingles").join(comp.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


SQL2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS s FROM w
), flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least AS component_id, doc_id = least AS kept FROM sets JOIN (SELECT id, min(r) AS least FROM reach GROUP BY id) c ON c.id = doc_id
"""

QUERIES = {"op2_minhash": op2_minhash}
ORACLE_SQL = {"op2_minhash": SQL2}
