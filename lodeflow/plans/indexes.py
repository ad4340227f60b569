"""Queries: a stored index and graph, and vector search by inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, bm25, entities, graph
from ..operators.storage import scratch
from ..sources import versions
from . import knowledge, retrieval
from .common import table


def _terms(spark, d):
    """BM25's tables, saved and opened again."""
    ix = bm25.index(table(spark, d, "documents"))
    folder = scratch(spark, "index")
    versions.commit(spark, folder, {"postings": bm25.pack(ix), "idf": ix.idf, "totals": ix.totals}, partitioned={"postings": ["slot"]})
    at = versions.open_version(spark, folder)
    return bm25.stored(*(at.read(spark, name) for name in ("postings", "idf", "totals")))


def index_roundtrip(spark, d):
    """Postings by term, vectors, nodes and edges, committed as one version and read from it: kind, key, n, x."""
    ix = bm25.index(table(spark, d, "documents"))
    lists = ann.build(table(spark, d, "embeddings"), tag="label")
    held = knowledge._held(spark, d)
    nodes, edges = graph.own_nodes(entities.spread(held)), graph.own_edges(held)
    folder = scratch(spark, "index")
    versions.commit(spark, folder, {"postings": bm25.pack(ix), "blocks": lists.blocks, "centres": lists.centres, "nodes": nodes, "edges": edges}, partitioned={"postings": ["slot"]})
    at = versions.open_version(spark, folder)
    row = lambda kind, key, n, x: (F.lit(kind).alias("kind"), key.alias("key"), n.cast("long").alias("n"), x.cast("double").alias("x"))
    postings = at.read(spark, "postings").groupBy("term").agg(F.sum(F.size("postings")).alias("n"), F.sum(F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["tf"])).alias("x"))
    vectors = at.read(spark, "blocks").select("length", F.explode("rows").alias("r"))
    nodes, edges = at.read(spark, "nodes"), at.read(spark, "edges")
    return (
        postings.select(*row("posting", F.col("term"), F.col("n"), F.col("x")))
        .union(vectors.select(*row("vector", F.col("r.id").cast("string"), F.col("length"), F.col("r.tag"))))
        .union(nodes.select(*row("node", F.col("node"), F.col("mention_count"), F.col("n_chunks"))))
        .union(edges.select(*row("edge", F.concat_ws(">", "subject", "object"), F.col("weight"), F.col("confidence"))))
    )


def stored_search(spark, d):
    """Each question's five best by a stored index, of which only the folders and rows of asked terms are read."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return bm25.search(_terms(spark, d), asked, 5).select("qid", "doc_id", "score", "rank")


def _lists(spark, d, tag=None):
    e = table(spark, d, "embeddings")
    return ann.build(e, tag=tag), e, e.where("vec_id % 20 = 0")


def knn_certified(spark, d):
    """The ten nearest, by lists that are searched or ruled out."""
    ix, _, asked = _lists(spark, d)
    return ann.search(ix, asked, 10, 4, certified=True)[0]


def knn_certified_filtered(spark, d):
    ix, _, asked = _lists(spark, d, "label")
    return ann.search(ix, asked, 5, 4, tag="label", certified=True)[0]


def knn_recall(spark, d):
    """The approximate search with as many lists as the audit asks for: whether recall at 10 is 0.95, and no row is looked at twice."""
    ix, e, asked = _lists(spark, d)
    probes, _ = ann.fitted_probes(ix, e, asked, 10)
    got = ann.audit(ix, e, asked, 10, probes)
    return got.select("n_queries", (F.col("recall") >= 0.95).alias("reached"), (F.col("scanned") <= 1).alias("once"))


QUERIES = {f.__name__: f for f in (index_roundtrip, stored_search, knn_certified, knn_certified_filtered, knn_recall)}

ORACLE_SQL = {
    "index_roundtrip": "WITH " + retrieval.BM25.format(k=5) + "," + knowledge.FOUND + """
SELECT 'posting' AS kind, term AS key, count(*)::BIGINT AS n, sum(tf)::DOUBLE AS x FROM post GROUP BY term
UNION ALL SELECT 'vector', vec_id::VARCHAR, len(embedding)::BIGINT, label::DOUBLE FROM embeddings
UNION ALL SELECT 'node', entity, count(*)::BIGINT, count(DISTINCT chunk_id)::DOUBLE FROM found GROUP BY entity
UNION ALL SELECT 'edge', subject || '>' || object, weight::BIGINT, confidence::DOUBLE FROM edges""",
    "stored_search": retrieval.ORACLE_SQL["bm25_topk"],
    "knn_certified": "WITH " + retrieval.DENSE.format(tag="", which="q.vec_id % 20 = 0", k=10) + retrieval._KNN,
    "knn_certified_filtered": retrieval.ORACLE_SQL["knn_filtered"],
    "knn_recall": "SELECT count(*) AS n_queries, true AS reached, true AS once FROM embeddings WHERE vec_id % 20 = 0",
}
