"""Queries: fused retrieval, claims with a retry, model calls that fail, prompts for JSON answers, explanations, headings by size of type.

Models are stand-ins: functions of the prompt that answer, answer badly, or fail, so that results are the same everywhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import expansions, lexical_scorer, paraphrases
from ..operators import answers, calls, chunks, claims, fusion, grounding, rerank, vectors
from . import knowledge, retrieval
from .answers import ANSWERS, SCORED, _evidence, _scored, _SET
from .common import table, turns


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def fused_retrieval(spark, d):
    """Each question's five best of 30 that two vectors, BM25 and the graph find; a fourth channel fails and costs nothing. The second vector
    stands for another wording: the next one of the table."""
    def dense():
        e = table(spark, d, "embeddings")
        asked = _questions(spark, d).select("qid", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant")).withColumn("vec_id", F.col("qid") + F.col("variant"))
        near = vectors.nearest(e, e.join(asked.select("vec_id").distinct(), "vec_id", "left_semi"), 15).withColumnRenamed("qid", "vec_id")
        return asked.join(near, "vec_id")

    def words():
        return retrieval._bm(spark, d, 15).withColumnRenamed("doc_id", "id")

    def broken():
        raise RuntimeError("no such service")

    lists, _ = fusion.gather({"dense": dense, "bm25": words, "graph": lambda: knowledge.retrieved(spark, d, 15), "broken": broken})
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = fusion.candidates(lists).join(texts, "id").join(_questions(spark, d), "qid")
    scored = rows.withColumn("final", F.round(lexical_scorer(F.col("query"), F.col("text")) - rerank.penalty(F.col("query"), F.col("text")), 6))
    return rerank.top(scored, 5, "final").select("qid", "id", "rrf", "retrievers", "final", "rank")


def _firsts(spark, d):
    """Of each assistant's turn, the first two passages."""
    e = _evidence(spark, d)
    one = lambda i: F.max(F.when(F.col("idx") == i, F.col("passage")))
    return e.groupBy("aid").agg(one(1).alias("s1"), one(2).alias("s2"))


def claims_retry(spark, d):
    """Replies of six kinds: good JSON, fenced, broken, with claims that nothing supports, between other words, citing what is not there. Those that fail are asked once more."""
    firsts = _firsts(spark, d)
    claim = lambda text, ids, sure=None: F.struct(text.alias("text"), F.array(*map(F.lit, ids)).cast("array<string>").alias("evidence_ids"), *([F.lit(sure).alias("confidence")] if sure else []))
    reply = lambda *cs, open_=(): F.to_json(F.struct(F.array(*cs).alias("claims"), F.array(*map(F.lit, open_)).cast("array<string>").alias("unanswerable_aspects")))
    s1, s2, odd = F.col("s1"), F.coalesce("s2", F.lit("")), F.lit("zzz qqq")
    good = reply(claim(s1, ["E1"], "high"), claim(s2, ["E2"], "low"), open_=["dose"])
    kind = F.col("aid") % 6
    first = (
        F.when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), good, F.lit("\n```\nDone"))).when(kind == 2, '{"claims": [ {"text": "broken').when(kind == 3, F.concat(F.lit('{"claims":['), F.to_json(claim(odd, ["E1"], "high")), F.lit(","), F.to_json(claim(s1, ["E1"])), F.lit("]}")))
        .when(kind == 4, F.concat(F.lit("Sure: "), good, F.lit(" as asked"))).when(kind == 5, reply(claim(odd, ["E9"], "high"))).otherwise(good)
    )
    second = F.when((kind == 3) & (F.col("aid") % 4 == 1), '{"claims": []}').when(kind == 5, reply(claim(odd, [], "unsupported"))).otherwise(good)

    def ask(prompts):
        again = F.col("prompt").contains("not supported by the passages")
        return prompts.join(firsts, "aid").select("aid", F.when(again, second).otherwise(first).alias("reply"))

    evidence = _evidence(spark, d).select("aid", F.concat(F.lit("E"), F.col("idx").cast("string")).alias("eid"), "passage")
    got = claims.answered(turns(spark, d).select("aid", F.col("reference").alias("prompt")), ask, evidence)
    text = answers.assemble(got.select("aid", F.inline("claims")))
    return got.join(text, "aid", "left").select("aid", "n_claims", "n_ungrounded", "parse_failed", "retried", F.coalesce("answer", F.lit("")).alias("answer"))


def _compressor(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        if len(p) % 3 == 0:
            raise TimeoutError("no reply in time")
        out.append("No relevant information found." if len(p) % 3 == 1 else f" Facts from {len(p)} characters. ")
    return out


def compressed_context(spark, d):
    """Each question's five best passages in a model's words, or as they are where it fails or finds nothing."""
    ranked = retrieval._candidates(spark, d).where("place <= 5").select("qid", F.col("place").alias("rank"), "id", "text")
    return calls.compressed(_questions(spark, d), ranked, _compressor, attempts=1, wait=0)


def _expander(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        k = len(p) % (4 if p.startswith("Give") else 3)
        if k == 0:
            raise ConnectionError("no model")
        out.append(('Sure: ["A one", " ", "b two ", "c three"]', "no list", '["A ONE"]')[k - 1] if p.startswith("Give") else ("  ", " A passage. ")[k - 1])
    return out


def query_expansions(spark, d):
    """A question's own words, other wordings and a passage that would answer it, four at most; fewer where the model fails."""
    return fusion.distinct_variants(paraphrases(_questions(spark, d), expansions(_expander, attempts=1, wait=0)))


def font_headings(spark, d):
    """Lines of documents as spans of two sizes of type, every thirteenth line large."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    half = F.floor(F.char_length("line") / 2).cast("int")
    large = F.when((F.col("ordinal") + F.col("doc_id")) % 13 == 0, 6.0).otherwise(0.0)
    one = F.struct((F.lit(10.0) + F.char_length("line") % 3 * 0.5 + large).alias("size"), F.left("line", half).alias("text"))
    two = F.struct((F.lit(10.0) + F.col("doc_id") % 2 + large).alias("size"), F.substr("line", half + 1, F.lit(1 << 30)).alias("text"))
    lines = rows.select(F.col("source").alias("source_file"), F.col("doc_id").alias("page_number"), "ordinal", F.array(one, two).alias("spans"))
    return chunks.font_headings(lines).select("page_number", "ordinal", "heading", "level", "size")


def explanation_report(spark, d):
    """The trace of each answer, its lists joined."""
    got = grounding.explain_answers(_scored(spark, d), _evidence(spark, d))
    joined = lambda c: F.array_join(c, " / ").alias(c)
    return got.select(
        "aid", "answer", F.array_join("explanations.tag", ",").alias("tags"), F.array_join(F.flatten("explanations.sentences"), " / ").alias("sentences"), F.array_max("explanations.confidence").alias("best"),
        joined("unsupported"), joined("low_confidence"), joined("uncited"), "score",
    )


def json_prompts(spark, d):
    """Prompts of at most 600 characters of evidence, and the passages that are in them."""
    ranked = _evidence(spark, d).select(F.col("aid").alias("qid"), F.col("idx").alias("rank"), (F.col("aid") * 100 + F.col("idx")).alias("id"), F.col("passage").alias("text"))
    got = answers.citation_prompts(turns(spark, d).select(F.col("aid").alias("qid"), F.col("reference").alias("question")), ranked, 600)
    return got.select("qid", "user", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


QUERIES = {f.__name__: f for f in (fused_retrieval, claims_retry, compressed_context, query_expansions, font_headings, explanation_report, json_prompts)}

_GOOD = "[{'t': trim(s1), 'e': ['E1'], 'c': 'high', 'g': g1}, {'t': trim(coalesce(s2, '')), 'e': ['E2'], 'c': 'low', 'g': g2}]"
_ODD = "{{'t': 'zzz qqq', 'e': [{e}], 'c': '{c}', 'g': {g}}}"

ORACLE_SQL = {
    "fused_retrieval": "WITH " + retrieval.BM25.format(k=15) + "," + knowledge.FOUND + "," + knowledge.NEAR.format(hub=knowledge.HUB) + "," + knowledge.HITS.format(k=15) + """,
dn AS (SELECT i.item_id AS qid, v.v AS variant, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM benchmark i CROSS JOIN (VALUES (0), (1)) v(v) JOIN embeddings q ON q.vec_id = i.item_id + v.v JOIN embeddings c ON c.vec_id <> q.vec_id),
lists AS (SELECT qid, 'bm25' AS retriever, doc_id AS id, rank FROM bm UNION ALL SELECT qid, 'graph', id, rank FROM gr
  UNION ALL SELECT qid, 'dense', id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, id) AS rank FROM dn) WHERE rank <= 15),
rr AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, string_agg(retriever, ',' ORDER BY retriever) AS retrievers FROM lists GROUP BY qid, id),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS place FROM rr) WHERE place <= 30),
sets AS (SELECT c.*, len(list_filter(string_split(trim(regexp_replace(t.text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n, """ + f"{_SET.format('b.text')} AS qw, {_SET.format('t.text')} AS tw, list_filter({_SET.format('b.text')}, lambda w: NOT list_contains({list(rerank.GENERIC)}, w)) AS telling" + """
  FROM cand c JOIN documents t ON t.doc_id = c.id JOIN benchmark b ON b.item_id = c.qid),
fin AS (SELECT qid, id, rrf, retrievers, round(CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_intersect(qw, tw)) / len(qw) END - (CASE WHEN n < 15 THEN 1.5 ELSE 0 END + CASE WHEN len(telling) > 0 AND NOT list_has_any(telling, tw) THEN 0.8 ELSE 0 END)::DOUBLE, 6) AS final FROM sets)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM fin) WHERE rank <= 5""",
    "claims_retry": "WITH " + ANSWERS + f""",
f AS (SELECT turns.aid, turns.aid % 6 AS kind, max(passage) FILTER (idx = 1) AS s1, max(passage) FILTER (idx = 2) AS s2 FROM turns LEFT JOIN evidence USING (aid) GROUP BY ALL),
g AS (SELECT *, len({_SET.format("coalesce(s1, '')")}) > 0 AS g1, len({_SET.format("coalesce(s2, '')")}) > 0 AS g2 FROM f WHERE s1 IS NOT NULL),
l AS (SELECT aid, kind, kind = 2 AS parse_failed,
  CASE kind WHEN 2 THEN [] WHEN 3 THEN [{_ODD.format(e="'E1'", c="high", g="false")}, {{'t': trim(s1), 'e': ['E1'], 'c': 'low', 'g': g1}}] WHEN 5 THEN [{_ODD.format(e="'E9'", c="high", g="false")}] ELSE {_GOOD} END AS a,
  CASE WHEN kind = 3 AND aid % 4 = 1 THEN [] WHEN kind = 5 THEN [{_ODD.format(e="", c="unsupported", g="NULL::BOOLEAN").replace("[]", "[]::VARCHAR[]")}] ELSE {_GOOD} END AS b FROM g),
s AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_filter(a, lambda x: NOT x.g)) / len(a) END AS sa, CASE WHEN len(b) = 0 THEN 1.0 ELSE len(list_filter(b, lambda x: NOT x.g)) / len(b) END AS sb FROM l),
t AS (SELECT aid, (sa > 0.2)::INT AS retried, parse_failed, CASE WHEN sa > 0.2 AND len(b) > 0 AND sb <= sa THEN b ELSE a END AS cs FROM s)
SELECT aid, len(cs)::BIGINT AS n_claims, len(list_filter(cs, lambda x: NOT x.g))::BIGINT AS n_ungrounded, parse_failed, retried,
  coalesce(array_to_string(list_transform(list_filter(cs, lambda x: coalesce(x.g, true) OR x.c = 'low'), lambda x: CASE WHEN x.c = 'unsupported' THEN x.t || ' (low confidence — not directly supported by retrieved evidence)' ELSE trim(x.t || ' ' || array_to_string(list_transform(x.e, lambda e: '[' || e || ']'), '')) END), ' '), '') AS answer FROM t""",
    "compressed_context": "WITH " + retrieval.BM25.format(k=5) + """,
r AS (SELECT bm.qid, bm.rank, bm.doc_id AS id, coalesce(d.text, '') AS text FROM bm JOIN documents d USING (doc_id)),
p AS (SELECT qid, length('State only the facts in these passages that bear on the question.' || chr(10) || chr(10) || string_agg('Chunk ' || rank || ': ' || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Facts:') AS n
  FROM (SELECT qid, rank, text FROM r) r JOIN (SELECT item_id AS qid, text FROM benchmark) b USING (qid) GROUP BY qid, b.text)
SELECT qid, CASE WHEN n % 3 = 2 THEN 1 ELSE rank END::INT AS rank, CASE WHEN n % 3 = 2 THEN 'compressed_01' ELSE id::VARCHAR END AS chunk, CASE WHEN n % 3 = 2 THEN 'Facts from ' || n || ' characters.' ELSE text END AS text FROM r JOIN p USING (qid) WHERE n % 3 <> 2 OR rank = 1""".replace("string_agg('Chunk ' || rank || ': ' || text,", "string_agg('Chunk ' || rank || ': ' || r.text,"),
    "query_expansions": """WITH q AS (SELECT item_id AS qid, text AS query, (length('Give 2 other wordings of the question, of the same meaning, as a JSON list of strings and nothing else.' || chr(10) || chr(10) || 'Question: ' || text)) % 4 AS k,
  length('Write a passage of two to four sentences, as a textbook has it, that answers the question.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Passage:') % 3 AS h FROM benchmark),
v AS (SELECT qid, 0 AS ordinal, query AS variant FROM q UNION ALL SELECT qid, 1, CASE k WHEN 1 THEN 'A one' ELSE 'A ONE' END FROM q WHERE k IN (1, 3) UNION ALL SELECT qid, 2, 'b two' FROM q WHERE k = 1 UNION ALL SELECT qid, 100, 'A passage.' FROM q WHERE h = 2),
f AS (SELECT qid, lower(trim(variant)) AS folded, min(ordinal) AS ordinal, arg_min(variant, ordinal) AS variant FROM v GROUP BY ALL)
SELECT qid, place, variant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ordinal) AS place FROM f) WHERE place <= 4""",
    "font_headings": r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS ordinal, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT *, CASE WHEN (ordinal + doc_id) % 13 = 0 THEN 6.0 ELSE 0 END AS big FROM l),
z AS (SELECT doc_id, ordinal, line, (10.0 + length(line) % 3 * 0.5 + big)::DOUBLE AS a, (10.0 + doc_id % 2 + big)::DOUBLE AS b FROM s),
m AS (SELECT doc_id, list_sort(list(x))[len(list(x)) // 2 + 1] AS median FROM (SELECT doc_id, a AS x FROM z UNION ALL SELECT doc_id, b FROM z) GROUP BY doc_id),
h AS (SELECT doc_id, ordinal, regexp_replace(line, '^\s+|\s+$', '', 'g') AS heading, (a + b) / 2 AS size, median FROM z JOIN m USING (doc_id))
SELECT doc_id AS page_number, ordinal::INT AS ordinal, heading, CASE WHEN regexp_matches(heading, '(?i)^\s*Chapter\s+\d+[:.\s]') THEN 'chapter' ELSE 'section' END AS level, size FROM h
WHERE heading <> '' AND (size > 1.25 * median OR regexp_matches(heading, '(?i)^\s*Chapter\s+\d+[:.\s]') OR regexp_matches(heading, '^\s*\d+(\.\d+)*\s+[A-Z][A-Za-z\s]{3,80}$'))""",
    "explanation_report": "WITH " + SCORED + r""",
n AS (SELECT aid, count(*) AS n FROM evidence GROUP BY aid),
c AS (SELECT s.*, list_distinct(list_filter(list_transform(regexp_extract_all(sentence, 'P(\d+)', 1), lambda x: x::INT), lambda x: x >= 1 AND x <= coalesce(n.n, 0))) AS cites FROM scored s LEFT JOIN n USING (aid)),
u AS (SELECT *, CASE WHEN len(cites) > 0 THEN cites WHEN idx IS NOT NULL THEN [idx::INT] ELSE [] END AS used FROM c),
e AS (SELECT aid, p, string_agg(sentence, ' / ' ORDER BY ordinal) AS ss, max(combined) AS conf FROM (SELECT aid, ordinal, sentence, combined, unnest(used) AS p FROM u) GROUP BY ALL),
x AS (SELECT aid, string_agg('P' || p, ',' ORDER BY p) AS tags, string_agg(ss, ' / ' ORDER BY p) AS sentences, max(conf) AS best FROM e GROUP BY aid),
y AS (SELECT aid, coalesce(string_agg(sentence, ' ' ORDER BY ordinal) FILTER (status <> 'unsupported'), '') AS answer, coalesce(string_agg(sentence, ' / ' ORDER BY ordinal) FILTER (status = 'unsupported'), '') AS unsupported, coalesce(string_agg(sentence, ' / ' ORDER BY ordinal) FILTER (status = 'partial'), '') AS low_confidence,
  coalesce(string_agg(sentence, ' / ' ORDER BY ordinal) FILTER (len(cites) = 0), '') AS uncited, round(avg((len(used) > 0)::INT), 4) AS score FROM u GROUP BY aid)
SELECT aid, answer, coalesce(tags, '') AS tags, coalesce(sentences, '') AS sentences, best, unsupported, low_confidence, uncited, score FROM y LEFT JOIN x USING (aid)""",
    "json_prompts": "WITH " + ANSWERS + """, r AS (SELECT aid, idx, passage, sum(length(passage) + 6) OVER (PARTITION BY aid ORDER BY idx) AS upto, row_number() OVER (PARTITION BY aid ORDER BY idx) AS n FROM evidence),
b AS (SELECT aid, string_agg('[P' || n || '] ' || passage, chr(10) || chr(10) ORDER BY n) AS blocks, string_agg((aid * 100 + idx)::VARCHAR, ',' ORDER BY n) AS ids FROM r WHERE upto <= 600 OR n = 1 GROUP BY aid)
SELECT aid AS qid, 'Question:' || chr(10) || reference || chr(10) || chr(10) || 'Passages:' || chr(10) || blocks AS user, ids FROM turns JOIN b USING (aid)""",
}
