"""Queries: BM25, vectors, fusion, cutoffs, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import lexical_scorer
from ..operators import bm25, fusion, rerank, vectors
from ..operators.storage import settle
from . import knowledge
from .common import table

BM25 = r"""
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9][a-zA-Z0-9\-]*') AS ts FROM documents),
tot AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9][a-zA-Z0-9\-]*')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN post USING (term), tot GROUP BY qid, doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k} AND score > 0)"""

DENSE = """
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id {tag} WHERE {which})) WHERE rank <= {k})"""

SIGNALS = knowledge.FOUND + "," + knowledge.NEAR.format(hub=knowledge.HUB) + "," + knowledge.HITS.format(k=20) + """,
signals AS MATERIALIZED (SELECT qid, doc_id AS id, 'bm25' AS signal, score AS raw FROM bm UNION ALL SELECT qid, id, 'dense', score FROM dense UNION ALL SELECT qid, id, 'graph', score FROM gr),
normed AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (raw - lo) / (hi - lo) END AS norm
  FROM (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM signals WINDOW w AS (PARTITION BY qid, signal)))"""

FUSED = """
fused AS (
  SELECT p.qid, p.id, dense_score, bm25_score, graph_score, round((wd * dense_norm + wb * bm25_norm + wg * graph_norm) / (wd + wb + wg), 6) AS fused
  FROM (SELECT qid, id, {cols} FROM normed GROUP BY qid, id) p
  JOIN (SELECT qid, max(CASE WHEN signal = 'dense' THEN 0.4 ELSE 0 END)::DOUBLE AS wd, max(CASE WHEN signal = 'bm25' THEN 0.3 ELSE 0 END)::DOUBLE AS wb, max(CASE WHEN signal = 'graph' THEN 0.3 ELSE 0 END)::DOUBLE AS wg FROM normed GROUP BY qid) h USING (qid))""".format(
    cols=", ".join(f"coalesce(max(CASE WHEN signal = '{s}' THEN {a} END), 0)::DOUBLE AS {s}_{b}" for s in ("dense", "bm25", "graph") for a, b in (("raw", "score"), ("norm", "norm")))
)
BENCH_VECTORS = "q.vec_id IN (SELECT item_id FROM benchmark)"


def _bm(spark, d, k):
    return bm25.search(bm25.index(table(spark, d, "documents")), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), k)


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    asked = e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return vectors.nearest(e, asked, k)


def _signals(spark, d):
    """Each question's 20 best by BM25, by vectors, and by the graph."""
    bm = _bm(spark, d, 20).select("qid", F.col("doc_id").alias("id"), F.lit("bm25").alias("signal"), F.col("score").alias("raw"))
    dense = _dense(spark, d, 20).select("qid", "id", F.lit("dense").alias("signal"), F.col("score").alias("raw"))
    walked = knowledge.retrieved(spark, d, 20).select("qid", "id", F.lit("graph").alias("signal"), F.col("score").alias("raw"))
    return settle(bm.union(dense).union(walked))


def conditioned(spark, d, grid, k=5):
    """``condition``, ``qid``, ``id``, ``rank``: the ``k`` best under each condition (name, weights of dense, bm25 and graph, whether to
    rerank). Signals are found once; conditions are rows. Reranking takes ``2 k`` candidates by the pair scorer less penalties."""
    rows = spark.createDataFrame([(n, *map(float, w), r) for n, *w, r in grid], "condition string, dense double, bm25 double, graph double, again boolean")
    fused = fusion.by_condition(_signals(spark, d), rows)
    pool = rerank.top(fused.withColumn("qid", F.struct("condition", "qid")), 2 * k, "fused")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("query"))
    both = pool.join(F.broadcast(rows.select("condition", "again")), "condition").withColumn("item", F.col("qid.qid")).join(texts, "id", "left").join(asked, "item", "left")
    again = F.round(lexical_scorer(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))) - rerank.penalty(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))), 6)
    final = both.select("qid", "id", F.when(F.col("again"), again).otherwise(F.col("fused")).alias("final"))
    return rerank.top(final, k, "final").select("qid.condition", "qid.qid", "id", "rank")


def _fused(spark, d):
    return fusion.weighted(_signals(spark, d), fusion.weights())


def bm25_topk(spark, d):
    return _bm(spark, d, 5).select("qid", "doc_id", "score", "rank")


def bm25_index_stats(spark, d):
    return bm25.index(table(spark, d, "documents")).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _asked(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 20 = 0")


def vector_knn(spark, d):
    return vectors.nearest(*_asked(spark, d), 5)


def knn_filtered(spark, d):
    return vectors.nearest(*_asked(spark, d), 5, tag="label")


def knn_section(spark, d):
    return vectors.nearest_in_section(*_asked(spark, d), 3, "label", F.col("section") == F.col("wanted_section"))


def minmax_norm(spark, d):
    return fusion.min_max(_signals(spark, d)).select("qid", "id", "signal", F.round("norm", 6).alias("norm"))


def hybrid_fusion(spark, d):
    return _fused(spark, d)


def adaptive_cutoff(spark, d):
    return fusion.near_tie_cutoff(_fused(spark, d), "fused", 5).select("qid", "id", "fused", "rank")


def elbow_topk(spark, d):
    return fusion.elbow_cutoff(_bm(spark, d, 20).select("qid", F.col("doc_id").alias("id"), "score"), "score").select("qid", "id", "score", "rank")


def rrf(spark, d):
    lists = _bm(spark, d, 20).select("qid", F.lit("bm25").alias("retriever"), F.col("doc_id").alias("id"), "rank", "score").union(_dense(spark, d, 20).select("qid", F.lit("dense").alias("retriever"), "id", "rank", "score"))
    return fusion.reciprocal_rank(lists)


def multi_query_dedup(spark, d):
    v = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("ordinal"), F.initcap(F.col("role")).alias("variant"))
    return fusion.distinct_variants(v.union(table(spark, d, "conversations").select("conv_id", F.col("turn") + 100, F.col("role"))))


def section_intent(spark, d):
    c = table(spark, d, "conversations")
    q = F.concat(F.element_at(F.array(*map(F.lit, ("how to TREAT ", "diagnosis of ", "prognosis ", "risk of ", "managing ", "what is "))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int")), F.col("role"))
    return c.select("conv_id", "turn", fusion.section_intent(q).alias("section"), fusion.cache_key(q).alias("cache_key"))


def _candidates(spark, d):
    return _bm(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("qid", F.col("doc_id").alias("id"), F.col("rank").alias("place"), "score", "text")


def rerank_penalties(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    rows = _candidates(spark, d).join(q, "qid").withColumn("taken", rerank.penalty(F.col("query"), F.col("text")))
    return rerank.top(rows.withColumn("final", F.round(F.col("score") - F.col("taken"), 6)), 5, "final").select("qid", "id", "taken", "final", "rank")


def greedy_dedup(spark, d):
    return rerank.suppress_duplicates(_candidates(spark, d))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z0-9]+'))"
_KNN = "SELECT qid, id, score, rank FROM dense"
CONDITIONED = """
cond AS (SELECT * FROM (VALUES {grid}) AS t(condition, cd, cb, cg, again)),
piv AS (SELECT qid, id, coalesce(max(CASE WHEN signal = 'dense' THEN norm END), 0)::DOUBLE AS d, coalesce(max(CASE WHEN signal = 'bm25' THEN norm END), 0)::DOUBLE AS b, coalesce(max(CASE WHEN signal = 'graph' THEN norm END), 0)::DOUBLE AS g FROM normed GROUP BY ALL),
has AS (SELECT qid, max((signal = 'dense')::INT) AS hd, max((signal = 'bm25')::INT) AS hb, max((signal = 'graph')::INT) AS hg FROM normed GROUP BY ALL),
fs AS (SELECT condition, again, qid, id, round((cd * hd * d + cb * hb * b + cg * hg * g) / (cd * hd + cb * hb + cg * hg), 6) AS fused FROM piv JOIN has USING (qid), cond WHERE cd * hd + cb * hb + cg * hg > 0),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition, qid ORDER BY fused DESC, id) AS place FROM fs) WHERE place <= 10),
sets AS (SELECT p.*, len(list_filter(string_split(trim(regexp_replace(coalesce(t.text, ''), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n,
  list_distinct(regexp_extract_all(lower(coalesce(q.text, '')), '[a-zA-Z0-9]+')) AS qw, list_distinct(regexp_extract_all(lower(coalesce(t.text, '')), '[a-zA-Z0-9]+')) AS tw FROM pool p LEFT JOIN documents t ON t.doc_id = p.id LEFT JOIN benchmark q ON q.item_id = p.qid),
fin AS (SELECT condition, qid, id, CASE WHEN again THEN round(CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_intersect(qw, tw)) / len(qw) END - (CASE WHEN n < 15 THEN 1.5 ELSE 0 END
  + CASE WHEN len(list_filter(qw, lambda w: NOT list_contains({generic}, w))) > 0 AND NOT list_has_any(list_filter(qw, lambda w: NOT list_contains({generic}, w)), tw) THEN 0.8 ELSE 0 END)::DOUBLE, 6) ELSE fused END AS final FROM sets),
rk AS (SELECT * FROM (SELECT condition, qid, id, row_number() OVER (PARTITION BY condition, qid ORDER BY final DESC, id) AS rank FROM fin) WHERE rank <= 5)"""


def conditioned_sql(grid):
    values = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE, {str(r).lower()})" for n, a, b, g, r in grid)
    return CONDITIONED.format(grid=values, generic=list(rerank.GENERIC))


_MIX = "WITH " + BM25.format(k=20) + "," + DENSE.format(tag="", which=BENCH_VECTORS, k=20) + "," + SIGNALS

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_index_stats, vector_knn, knn_filtered, knn_section, minmax_norm, hybrid_fusion, adaptive_cutoff, elbow_topk, rrf, multi_query_dedup, section_intent, rerank_penalties, greedy_dedup)}

ORACLE_SQL = {
    "bm25_topk": "WITH " + BM25.format(k=5) + " SELECT qid, doc_id, score, rank FROM bm",
    "bm25_index_stats": "WITH " + BM25.format(k=5) + " SELECT term, df, round(idf, 6) AS idf FROM idf",
    "vector_knn": "WITH " + DENSE.format(tag="", which="q.vec_id % 20 = 0", k=5) + _KNN,
    "knn_filtered": "WITH " + DENSE.format(tag="AND q.label = c.label", which="q.vec_id % 20 = 0", k=5) + _KNN,
    "knn_section": "WITH " + DENSE.format(tag="", which="q.vec_id % 20 = 0", k=30)
    + ", fit AS (SELECT d.*, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM dense d JOIN embeddings a ON a.vec_id = d.id JOIN embeddings b ON b.vec_id = d.qid WHERE a.label = b.label) SELECT qid, id, score, place FROM fit WHERE place <= 3",
    "minmax_norm": _MIX + " SELECT qid, id, signal, round(norm, 6) AS norm FROM normed",
    "hybrid_fusion": _MIX + "," + FUSED + " SELECT * FROM fused",
    "adaptive_cutoff": _MIX + "," + FUSED + """,
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM fused),
g AS (SELECT *, lag(fused) OVER (PARTITION BY qid ORDER BY rank) - fused AS fall FROM r WHERE rank <= 25),
s AS (SELECT qid, min(CASE WHEN rank > 5 AND fall > 0.02 THEN rank END) AS stop FROM g GROUP BY qid)
SELECT qid, id, fused, rank FROM g JOIN s USING (qid) WHERE stop IS NULL OR rank < stop""",
    "elbow_topk": "WITH " + BM25.format(k=20) + """,
r AS (SELECT qid, doc_id AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm),
g AS (SELECT *, round(score - lead(score) OVER (PARTITION BY qid ORDER BY rank), 6) AS gap, count(*) OVER (PARTITION BY qid) AS n, stddev_pop(score) OVER (PARTITION BY qid) AS sd FROM r WHERE rank <= 15),
c AS (SELECT qid, min(CASE WHEN rank > 3 AND gap > CASE WHEN sd = 0 THEN 1e-6 ELSE round(sd, 6) END THEN rank END) AS cut FROM g GROUP BY qid)
SELECT qid, id, score, rank FROM g JOIN c USING (qid) WHERE n <= 3 OR cut IS NULL OR rank <= cut""",
    "rrf": "WITH " + BM25.format(k=20) + "," + DENSE.format(tag="", which=BENCH_VECTORS, k=20) + """,
l AS (SELECT qid, 'bm25' AS retriever, doc_id AS id, rank, score FROM bm UNION ALL SELECT qid, 'dense', id, rank, score FROM dense)
SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, string_agg(retriever, ',' ORDER BY retriever) AS retrievers, arg_max(retriever, score) AS representative FROM l GROUP BY qid, id""",
    "multi_query_dedup": """WITH v AS (SELECT conv_id AS qid, turn AS ordinal, upper(role[1]) || role[2:] AS variant FROM conversations UNION ALL SELECT conv_id, turn + 100, role FROM conversations),
f AS (SELECT qid, lower(trim(variant)) AS folded, min(ordinal) AS ordinal, arg_min(variant, ordinal) AS variant FROM v GROUP BY ALL)
SELECT qid, place, variant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ordinal) AS place FROM f) WHERE place <= 4""",
    "section_intent": """WITH q AS (SELECT conv_id, turn, ['how to TREAT ', 'diagnosis of ', 'prognosis ', 'risk of ', 'managing ', 'what is '][(conv_id + turn) % 6 + 1] || role AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN lower(q) LIKE '%treat%' OR lower(q) LIKE '%manag%' THEN 'Treatment' WHEN lower(q) LIKE '%diagnos%' THEN 'Diagnosis' WHEN lower(q) LIKE '%prognos%' THEN 'Prognosis' WHEN lower(q) LIKE '%risk%' THEN 'Risk' END AS section, sha256(lower(trim(q))) AS cache_key FROM q""",
    "rerank_penalties": "WITH " + BM25.format(k=20) + r""",
p AS (SELECT bm.qid, bm.doc_id AS id, score, len(list_filter(string_split(trim(regexp_replace(d.text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n,
  list_filter(""" + _WORDS.format("b.text") + ", lambda w: NOT list_contains(" + str(list(rerank.GENERIC)) + ", w)) AS q, " + _WORDS.format("d.text") + r""" AS t
  FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = bm.qid),
x AS (SELECT qid, id, score, (CASE WHEN n < 15 THEN 1.5 ELSE 0 END + CASE WHEN len(q) > 0 AND NOT list_has_any(q, t) THEN 0.8 ELSE 0 END)::DOUBLE AS taken FROM p),
y AS (SELECT qid, id, taken, round(score - taken, 6) AS final FROM x)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM y) WHERE rank <= 5""",
    "greedy_dedup": "WITH RECURSIVE " + BM25.format(k=20) + """,
c AS MATERIALIZED (SELECT bm.qid, bm.doc_id AS id, rank AS place, """ + _WORDS.format("d.text") + """ AS w FROM bm JOIN documents d USING (doc_id)),
near AS MATERIALIZED (SELECT a.qid, a.place AS a, b.place AS b FROM c a JOIN c b ON a.qid = b.qid AND a.place < b.place WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) > 0.75 * len(list_distinct(a.w || b.w))),
nears AS MATERIALIZED (SELECT qid, b, list(a) AS before FROM near GROUP BY ALL),
r AS (SELECT qid, 0::BIGINT AS place, []::BIGINT[] AS kept FROM (SELECT DISTINCT qid FROM c)
  UNION ALL SELECT r.qid, c.place, CASE WHEN list_has_any(r.kept, coalesce(n.before, [])) THEN r.kept ELSE list_append(r.kept, c.place) END FROM r JOIN c ON c.qid = r.qid AND c.place = r.place + 1 LEFT JOIN nears n ON n.qid = c.qid AND n.b = c.place)
SELECT c.qid, c.id, c.place FROM c JOIN (SELECT qid, arg_max(kept, place) AS kept FROM r GROUP BY qid) k ON k.qid = c.qid AND list_contains(k.kept, c.place)""",
}
