"""Embedding near-dedup by NN-descent.

Vectors of one label (and length) whose cosine reaches a threshold are linked. Equal unit vectors are one
node with a count. Each node has a list of neighbours; lists start from leaves of random projections and are
refined by joins of neighbours with neighbours of neighbours. At or above the threshold all neighbours
rank alike, in an order drawn by hash: the list of a node in a dense group is so a sample of the group, not
its nearest corner, and the groups hang together. A list that only holds links is saturated and doubles.

The list's links at or above the threshold give groups. An audit compares a fresh sample of vectors with all of their
labels: recall is the share of a vector's links that lead into its own group, averaged over vectors and not over links, and
while it is low there is another round. Links that an audit sees are never used.

An exact check follows, so no link is left to the lists: counts and components are those of the links it finds, and of nothing below the threshold. Vectors are written to the shared folder in files of about
:data:`PART` bytes, in the order of label and group; tasks get pairs of files, fetch each file once for a run of pairs, compare in
double precision in tiles of :data:`TILE`, and return counts of links and a spanning forest, no pairs. Two files
whose centres are farther apart than their radii and the threshold's angle together are not compared: so groups
that the descent found, which lie together in files, are set apart from each other unread. Nothing passes
through the driver, and what is shuffled is ids, centres, counts and forests. What is not set apart by that bound is
compared, so the check's time grows with the square of what a label has of vectors that are like nothing else.

Cases: a null or zero vector, one with null or non-finite components, or one with a null label links with
nothing. Lengths may differ; only equal lengths link. Rows that share an id, or a null id, are judged each by its own
vector. Ties and repeated vectors count as often as they are there. An empty table gives an empty result. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, release_state, remove_at_exit, shared_dir, table
from .graph import connected_components, group_bounds, hot_join, map_groups

#: First length of a list, and of a saturated one at most; vectors compared with each other in a leaf.
LIST, LONGEST, LEAF = 10, 80, 256
#: Projections; rounds of joins, at least and at most; vectors of an audit; share of links in the group that ends the rounds.
TREES, ROUNDS, MOST_ROUNDS, AUDIT, RECALL = 4, 2, 5, 512, 0.95
#: Bytes of vectors in a file of the check; vectors multiplied at once; products of a task, about.
PART, TILE, TASK = 8 << 20, 1_024, 1 << 26
#: Vectors whose mean the projections start from.
SAMPLE = 1_000


def units(df: DataFrame, key: str, vector: str, label: str, seed: int = 0) -> DataFrame:
    """``id``, ``node`` (null where a vector can't link), ``space`` (label and length) and ``unit`` (packed doubles)."""

    def run(batches):
        import hashlib

        salt = seed.to_bytes(8, "little")
        for b in slices(batches, 2048):
            nodes, spaces, packed = [], [], []
            for v, l in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = None
                if v and l is not None and None not in v:
                    a = np.asarray(v, np.float64)
                    top = np.abs(a).max() if np.isfinite(a).all() else 0.0
                    if top > 0:
                        a = a / top
                        x = a / np.sqrt(a @ a)
                if x is None:
                    nodes.append(None)
                    spaces.append(None)
                    packed.append(None)
                    continue
                space = hashlib.blake2b(f"{len(x)}:{l}".encode(), digest_size=8, salt=salt).digest()
                spaces.append(int.from_bytes(space, "little", signed=True))
                packed.append(x.tobytes())
                nodes.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8, key=space, salt=salt).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(spaces, pa.int64()), pa.array(packed, pa.binary())], ["id", "node", "space", "unit"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l"))
    return rows.mapInArrow(run, "id long, node long, space long, unit binary")


def _unpack(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _draw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 for pairs of nodes, the same either way round."""
    x = (a.view(np.uint64) ^ b.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.float64) / (1 << 24)


def leaves(nodes: DataFrame, mean: list[float], trees: range) -> DataFrame:
    """``node``, ``unit``, ``leaf``: for each tree, vectors on the same sides of random planes; about LEAF in each."""

    def run(batches):
        for b in slices(batches, 2048):
            parts = []
            spaces, sizes = b.column("space").to_numpy(), b.column("size").to_numpy()
            lengths = np.array([len(x) for x in b.column("unit").to_pylist()])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = _unpack(b.column("unit").take(pa.array(at)))
                if len(mean) == x.shape[1]:
                    x = x - np.asarray(mean)
                bits = np.ceil(np.log2(np.maximum(1, sizes[at] / (LEAF / 2)))).astype(np.int64).clip(0, 40)
                for t in trees:
                    planes = np.random.default_rng(1_000 + t).standard_normal((x.shape[1], 40))
                    side = ((x @ planes) > 0) & (np.arange(40) < bits[:, None])
                    code = (side * (1 << np.arange(40))).sum(1)
                    leaf = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ spaces[at].view(np.uint64) ^ np.uint64(t * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                    parts.append(pa.RecordBatch.from_arrays([b.column("node").take(pa.array(at)), b.column("unit").take(pa.array(at)), pa.array(leaf.view(np.int64))], ["node", "unit", "leaf"]))
            yield from parts

    return nodes.select("node", "unit", "space", "size").mapInArrow(run, "node long, unit binary, leaf long")


PAIRS = "u long, v long, sim double"


def _best(ids: np.ndarray, x: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best neighbours of each vector among the others."""
    n = len(ids)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    order = np.where(s >= threshold, threshold + _draw(ids[:, None], ids[None, :]), s)
    np.fill_diagonal(order, -2)
    k = min(k, n - 1)
    best = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-order, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()


def _pairs_of(groups: DataFrame, keys: list[str], k: int, threshold: float) -> DataFrame:
    def run(t: pa.Table):
        t = t.combine_chunks()
        starts, ends = group_bounds([t.column(c).to_numpy() for c in keys])
        ids, units_ = t.column("node").to_numpy(), t.column("unit")
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            if hi - lo > 1:
                for o, got in zip(out, _best(ids[lo:hi], _unpack(units_.slice(lo, hi - lo)), k, threshold), strict=True):
                    o.append(got)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["u", "v", "sim"])

    return map_groups(groups, keys, run, PAIRS)


def _shortened(pairs: DataFrame, sizes: DataFrame | None, threshold: float, times: int = 1) -> DataFrame:
    """Each node's list: its best neighbours, as many as its list may hold. Rows beyond are left out before the shuffle."""
    draw = F.pmod(F.xxhash64(F.least("u", "v"), F.greatest("u", "v")), F.lit(1 << 20)) / float(1 << 20)
    order = F.when(F.col("sim") >= threshold, threshold + draw).otherwise(F.col("sim"))
    w = Window.partitionBy("u").orderBy(F.desc("order"), "v")
    rows = pairs.distinct().withColumn("order", order)
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= LONGEST * times)
    if sizes is None:
        return top.where(F.col("place") <= LIST * times).select("u", "v", "sim")
    return top.join(sizes, "u", "left").where(F.col("place") <= F.coalesce("k", F.lit(LIST)) * times).select("u", "v", "sim")


def refine(nodes: DataFrame, lists: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Neighbours and those who have one as neighbour meet at each node; the best pairs join the lists."""
    both = _shortened(lists.union(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")), sizes, threshold, 2)
    around = both.select(F.col("u").alias("centre"), F.col("v").alias("node")).union(lists.select(F.col("u").alias("centre"), F.col("u").alias("node")).distinct())
    found = _pairs_of(around.join(nodes.select("node", "unit"), "node"), ["centre"], 3, threshold)
    return _shortened(lists.union(found), sizes, threshold)


def saturated(lists: DataFrame, sizes: DataFrame | None, threshold: float) -> DataFrame:
    """``u`` and the length ``k`` that its list may have: double where it is full of links."""
    counts = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("worst"))
    if sizes is not None:
        counts = counts.join(sizes, "u", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))
    else:
        counts = counts.withColumn("k", F.lit(LIST))
    full = (F.col("n") >= F.col("k")) & (F.col("worst") >= threshold)
    return cut(counts.select("u", F.when(full, F.least(F.col("k") * 2, F.lit(LONGEST))).otherwise(F.col("k")).alias("k")))


def audited(nodes: DataFrame, groups: DataFrame, turn: int, threshold: float) -> float:
    """Of a sample of vectors, drawn anew each ``turn``: the mean share of a vector's links that lead into its own group."""
    placed = nodes.join(groups.select(F.col("id").alias("node"), "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "space", "unit")
    drawn = placed.orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(AUDIT).collect()
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["component"], r["space"], bytes(r["unit"])) for r in drawn])

    def run(batches):
        by: dict[tuple[int, int], list] = {}
        for n, c, s, u in shared.value:
            by.setdefault((s, len(u)), []).append((n, c, u))
        found = {n: [0, 0] for n, _, _, _ in shared.value}
        for b in slices(batches, 2048):
            ids, own, spaces = (b.column(c).to_numpy() for c in ("node", "component", "space"))
            lengths = np.array([len(x) for x in b.column("unit").to_pylist()], np.int64)
            for (space, length), asked in by.items():
                at = np.flatnonzero((spaces == space) & (lengths == length))
                if not len(at):
                    continue
                x = _unpack(b.column("unit").take(pa.array(at)))
                q = np.frombuffer(b"".join(u for _, _, u in asked), np.float64).reshape(len(asked), -1)
                ok = (q @ x.T >= threshold) & (np.array([n for n, _, _ in asked])[:, None] != ids[at])
                inside = ok & (np.array([c for _, c, _ in asked])[:, None] == own[at])
                for (n, _, _), every, held in zip(asked, ok.sum(1).tolist(), inside.sum(1).tolist(), strict=True):
                    found[n][0] += every
                    found[n][1] += held
        rows = [(n, every, held) for n, (every, held) in found.items() if every]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["node", "every", "held"])

    share = placed.mapInArrow(run, "node long, every long, held long").groupBy("node").agg((F.sum("held") / F.sum("every")).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else float(share)


def described(nodes: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """Writes the vectors in files in the order of spaces and groups. Gives, for each ``file`` and ``space`` in it, the number
    ``n`` of its vectors, their ``centre`` (packed) and their ``radius`` around it, an angle."""
    spark = nodes.sparkSession
    total = nodes.agg(F.sum(F.octet_length("unit"))).first()[0] or 0
    own = groups.select(F.col("id").alias("node"), "component")
    placed = nodes.join(own, "node", "left").select("space", F.col("component").isNull().alias("alone"), "component", "node", "count", "unit")
    order = ["space", "alone", "component", "node"]
    placed.repartitionByRange(max(1, -(-total // PART)), *order).sortWithinPartitions(*order).select("space", "node", "count", "unit").write.parquet(folder)
    files = spark.read.parquet(folder).select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file")).distinct()

    def run(batches):
        release_state()
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                for (space, length), (_, _, x) in _vectors(folder, name).items():
                    centre = x.sum(0)
                    size = np.sqrt(centre @ centre)
                    near = float((x @ (centre / size)).min()) if size > 1e-9 else -1.0
                    rows.append((name, space, length, len(x), (centre / max(size, 1e-9)).tobytes(), float(np.arccos(np.clip(near, -1, 1)))))
                names = ["file", "space", "length", "n", "centre", "radius"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64()))], names)

    return cut(files.mapInArrow(run, "file string, space long, length int, n long, centre binary, radius double"))


def _vectors(folder: str, name: str) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a file, by space and length of vectors: nodes, their counts, and their vectors."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{where}/{name}") as f:
        t = pq.read_table(f).combine_chunks()
    out = {}
    starts, ends = group_bounds([t.column("space").to_numpy()])
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        values = t.column("unit").slice(lo, hi - lo).to_pylist()
        length = len(values[0])  # a space has vectors of one length
        out[int(t.column("space")[lo].as_py()), length] = (t.column("node").slice(lo, hi - lo).to_numpy(), t.column("count").slice(lo, hi - lo).to_numpy(), np.frombuffer(b"".join(values), np.float64).reshape(hi - lo, -1))
    return out


def _parts(ok: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the connected parts of a matrix of links between two sets."""
    out, left = [], ok.any(1)
    while left.any():
        rows = np.zeros(len(ok), bool)
        rows[np.argmax(left)] = True
        while True:
            columns = ok[rows].any(0)
            more = ok[:, columns].any(1)
            if not (more & ~rows).any():
                break
            rows = more
        left &= ~rows
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))
    return out


def checked(files: DataFrame, folder: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All vectors of a space against each other, in pairs of files that may hold links: counts of links
    (``node``, ``links``) and pairs (``a``, ``b``) that hold what is linked together."""
    one, two = (files.select(*[F.col(c).alias(c if c in ("space", "length") else f"{c}_{k}") for c in files.columns]) for k in (1, 2))
    pairs = cut(one.join(two, ["space", "length"]).where("file_1 <= file_2"))
    work = pairs.agg(F.sum(F.col("n_1").cast("double") * F.col("n_2"))).first()[0] or 0
    tasks = max(1, min(round(work / TASK), 100_000))
    reach = float(np.arccos(threshold)) + 1e-6

    def run(batches):
        release_state()
        held: dict[str, dict] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        def vectors(name: str, other: str, key: tuple[int, int]):
            if name not in held:
                for old in [k for k in held if k != other]:
                    del held[old]
                held[name] = _vectors(folder, name)
            return held[name][key]

        for b in batches:
            for row in b.to_pylist():
                key, f, g = (row["space"], row["length"]), row["file_1"], row["file_2"]
                apart = np.arccos(np.clip(np.frombuffer(row["centre_1"], np.float64) @ np.frombuffer(row["centre_2"], np.float64), -1, 1))
                if f != g and apart - row["radius_1"] - row["radius_2"] > reach:
                    continue
                (u, m, x), (v, n, y) = vectors(f, g, key), vectors(g, f, key)
                left, right = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
                forest: list[list[int]] = [[], []]
                for i in range(0, len(u), TILE):
                    for j in range(i if f == g else 0, len(v), TILE):
                        ok = x[i : i + TILE] @ y[j : j + TILE].T >= threshold
                        if f == g and i == j:
                            np.fill_diagonal(ok, False)
                        if not ok.any():
                            continue
                        left[i : i + TILE] += ok @ n[j : j + TILE]
                        if f != g or i != j:
                            right[j : j + TILE] += m[i : i + TILE] @ ok
                        for rows, columns in _parts(ok):
                            ends = [*u[i + rows].tolist(), *v[j + columns].tolist()]
                            for e in ends[1:]:
                                if (p := find(ends[0])) != (q := find(e)):
                                    root[max(p, q)] = min(p, q)
                                    forest[0].append(ends[0])
                                    forest[1].append(e)
                some, others = np.flatnonzero(left), np.flatnonzero(right)
                a = np.concatenate((u[some], v[others], np.array(forest[0], np.int64)))
                links = pa.array([*left[some].tolist(), *right[others].tolist(), *[None] * len(forest[0])], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([*[None] * (len(some) + len(others)), *forest[1]], pa.int64()), links], ["a", "b", "links"])

    dealt = pairs.repartitionByRange(tasks, "file_1", "file_2").sortWithinPartitions("file_1", "file_2", "space")
    got = cut(dealt.mapInArrow(run, "a long, b long, links long"))
    return got.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), got.where("b IS NOT NULL").select("a", "b")


def descended(nodes: DataFrame, threshold: float) -> tuple[DataFrame, float]:
    """Groups (``component``, ``id``) that the lists' links make, and the last audit's recall."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(SAMPLE).select("unit").collect()
    vectors = [np.frombuffer(bytes(r["unit"]), np.float64) for r in sample]
    width = max((len(v) for v in vectors), default=0)
    mean = np.mean([v for v in vectors if len(v) == width], axis=0).tolist() if vectors else []
    leafed = leaves(nodes, mean, range(TREES))
    held = leafed.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("chunks"))
    chunked = leafed.join(held, "leaf").withColumn("chunk", F.pmod(F.xxhash64("node", "leaf"), F.col("chunks")).cast("int")).drop("chunks")
    lists, sizes = cut(_shortened(_pairs_of(chunked, ["leaf", "chunk"], LIST, threshold), None, threshold)), None
    for turn in range(1, MOST_ROUNDS + 1):
        sizes = saturated(lists, sizes, threshold)
        lists = cut(refine(nodes, lists, sizes, threshold))
        if turn >= ROUNDS:
            groups = cut(connected_components(lists.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))))
            recall = audited(nodes, groups, turn, threshold)
            if recall >= RECALL:
                break
    return groups, recall


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """For each row ``key``, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    for seed in range(16):
        rows = cut(units(df, key, vector, label, seed))
        once = cut(rows.where("node IS NOT NULL").groupBy("node", "space", "unit").agg(F.min("id").alias("head"), F.count("*").alias("count")))
        if once.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break  # no two vectors share a hash
    nodes = cut(once.join(once.groupBy("space").agg(F.count("*").alias("size")), "space"))
    groups, _ = descended(nodes, threshold)
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    counts, links = checked(described(nodes, groups, folder), folder, threshold)
    remove_at_exit(df.sparkSession, folder)
    # the descent has brought together what is alike; only pairs that the comparison has found to be links join anything
    of = connected_components(links).select(F.col("id").alias("node"), "component")
    placed = nodes.join(of, "node", "left").select("node", "count", "head", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("head").alias("least"))
    facts = placed.join(counts, "node", "left").join(least, "component").select("node", F.col("count").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), "least")
    out = hot_join(rows.select("id", "node"), facts, "node", "id", "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(key), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT vec_id, coalesce(n, 0) AS n_links, c.least AS component_id, vec_id = c.least AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id JOIN (SELECT id, min(r) AS least FROM reach GROUP BY id) c ON c.id = vec_id
"""

QUERIES = {"op1_nn_descent": op1_nn_descent}
ORACLE_SQL = {"op1_nn_descent": SQL1}
