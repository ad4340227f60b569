"""Queries: prompts, claims, citations, grounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers, grounding, ranking
from .common import TURNS, table, turns

ANSWERS = TURNS + r""",
answers AS (SELECT aid, regexp_replace(candidate, '\. ', ' [P' || (aid % 4) || ']. ', 'g') || ' [P1]' AS answer FROM turns),
evidence AS (SELECT aid, generate_subscripts(ss, 1) AS idx, unnest(ss) AS passage FROM (SELECT aid, list_filter(string_split(regexp_replace(regexp_replace(reference || ' ' || candidate, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM turns))"""
_SPLIT = r"list_filter(string_split(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_SET = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z0-9]+'))"

SCORED = ANSWERS + r""",
ps AS (SELECT aid, generate_subscripts(ss, 1) - 1 AS ordinal, unnest(ss) AS sentence FROM (SELECT aid, """ + _SPLIT.format("answer") + r""" AS ss FROM answers)),
pw AS (SELECT *, """ + _SET.format("sentence") + r""" AS s FROM ps), ew AS (SELECT *, """ + _SET.format("passage") + r""" AS p FROM evidence),
pairs AS (SELECT aid, ordinal, sentence, idx, CASE WHEN idx IS NULL THEN 0.0 ELSE round(greatest(0.0, 0.4::DOUBLE * CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_intersect(s, p)) / len(s) END
  + 0.6::DOUBLE * CASE WHEN len(s) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(s, p)) / sqrt(len(s) * len(p)) END), 6) END AS combined FROM pw LEFT JOIN ew USING (aid)),
scored AS (SELECT aid, ordinal, sentence, idx, combined, CASE WHEN combined >= 0.65 THEN 'grounded' WHEN combined >= 0.45 THEN 'partial' ELSE 'unsupported' END AS status,
  CASE WHEN regexp_matches(sentence, 'P(\d+)') THEN 'explicit' WHEN combined >= 0.45 THEN 'inferred' ELSE 'none' END AS origin
  FROM (SELECT *, row_number() OVER (PARTITION BY aid, ordinal ORDER BY combined DESC, idx) AS place FROM pairs) WHERE place = 1)"""

CHECKED = ANSWERS + r""",
n AS (SELECT aid, count(*) AS n_evidence FROM evidence GROUP BY ALL),
ps AS (SELECT aid, unnest(""" + _SPLIT.format("answer") + r""") AS sentence FROM answers),
mk AS (SELECT ps.aid, sentence, coalesce(n_evidence, 0) AS n_evidence, list_transform(regexp_extract_all(sentence, '\[P(\d+)\]', 1), lambda x: x::INT) AS cites FROM ps LEFT JOIN n USING (aid)),
per AS (SELECT aid, sum(len(cites))::BIGINT AS n_citations, sum(len(list_filter(cites, lambda c: c >= 1 AND c <= n_evidence)))::BIGINT AS n_valid, count(*) AS n_sentences, sum((len(cites) = 0)::INT) AS n_uncited FROM mk GROUP BY ALL),
pr AS (SELECT aid, sentence, unnest(cites) AS idx FROM mk),
ov AS (SELECT aid, avg(CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_intersect(s, p)) / len(s) END) AS overlap FROM (SELECT aid, """ + _SET.format("sentence") + " AS s, " + _SET.format("passage") + r""" AS p FROM pr JOIN evidence USING (aid, idx)) GROUP BY ALL),
ck AS (SELECT aid, n_citations, n_valid, CASE WHEN n_citations > 0 THEN n_valid / n_citations ELSE 0.0 END AS v, coalesce(overlap, 0.0) AS o, n_uncited / n_sentences AS u FROM per LEFT JOIN ov USING (aid)),
checked AS (SELECT aid, n_citations, n_valid, round(v, 4) AS validity, round(o, 4) AS overlap, round(u, 4) AS uncited_ratio, v >= 0.8 AND o >= 0.3 AS well_grounded FROM ck)"""


def _answers(spark, d):
    t = turns(spark, d)
    return t.select("aid", F.concat(F.regexp_replace("candidate", F.lit(r"\. "), F.concat(F.lit(" [P"), (F.col("aid") % 4).cast("string"), F.lit("]. "))), F.lit(" [P1]")).alias("answer"))


def _evidence(spark, d):
    from ..functions.text import sentences

    t = turns(spark, d)
    return t.select("aid", F.posexplode(sentences(F.concat("reference", F.lit(" "), "candidate"))).alias("i", "passage")).select("aid", (F.col("i") + 1).alias("idx"), "passage")


def _scored(spark, d):
    return grounding.ground_sentences(_answers(spark, d), _evidence(spark, d))


def citation_check(spark, d):
    return grounding.check_citations(_answers(spark, d), _evidence(spark, d))


def sentence_grounding(spark, d):
    return _scored(spark, d)


def grounding_report(spark, d):
    return grounding.grounding_report(_scored(spark, d))


def explainability(spark, d):
    return grounding.explain(_scored(spark, d))


def hallucination_summary(spark, d):
    return grounding.hallucination(citation_check(spark, d))


def evidence_prompts(spark, d):
    e = _evidence(spark, d).select(F.col("aid").alias("qid"), F.col("idx").alias("rank"), F.col("passage").alias("text"), F.lit(None).cast("string").alias("source"), F.col("idx").alias("page"))
    q = turns(spark, d).select(F.col("aid").alias("qid"), F.col("reference").alias("question"))
    return answers.prompts(q, e, strict=False)


def extractive_answers(spark, d):
    e = _evidence(spark, d).where("idx = 1")
    return e.select("aid", answers.extractive_answer(F.col("passage")).alias("answer"))


def _claims(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("aid"), F.col("turn").alias("ordinal"), F.concat("role", F.lit(" claims")).alias("text"), F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), (F.col("turn") % 4).cast("string")))).alias("evidence_ids"),
        F.element_at(F.array(*map(F.lit, ("high", "low", "unsupported"))), ((F.col("turn") + F.col("conv_id")) % 3 + 1).cast("int")).alias("confidence"), (F.col("turn") % 2 == 0).alias("grounded"),
    )


def assembled_answers(spark, d):
    return answers.assemble(_claims(spark, d))


def citation_metrics(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("aid"), F.concat(F.lit("E"), (F.col("turn") % 6).cast("string")).alias("eid"))
    return ranking.citation_metrics(_claims(spark, d), c, c.where("aid % 2 = 0"))


def cache_events(spark, d):
    """Hits and misses of a cache with an expiry of an hour, by key: the last use before decides."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hit = F.lag("ts").over(w).isNotNull() & ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) <= 3_600_000_000)
    return e.withColumn("hit", hit.cast("int")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


QUERIES = {f.__name__: f for f in (citation_check, sentence_grounding, grounding_report, explainability, hallucination_summary, evidence_prompts, extractive_answers, assembled_answers, citation_metrics, cache_events)}

CLAIMS = """claims AS (SELECT conv_id AS aid, turn AS ordinal, role || ' claims' AS text, CASE WHEN turn % 3 = 0 THEN []::VARCHAR[] ELSE ['E' || (turn % 4)] END AS eids, ['high', 'low', 'unsupported'][(turn + conv_id) % 3 + 1] AS confidence, turn % 2 = 0 AS grounded FROM conversations)"""

ORACLE_SQL = {
    "citation_check": "WITH " + CHECKED + " SELECT * FROM checked",
    "sentence_grounding": "WITH " + SCORED + " SELECT * FROM scored",
    "grounding_report": "WITH " + SCORED + " SELECT aid, round(avg(combined), 4) AS faithfulness, round(avg((status = 'grounded')::INT), 4) AS grounded_ratio, coalesce(string_agg(sentence, ' ' ORDER BY ordinal) FILTER (status <> 'unsupported'), '') AS cleaned_answer FROM scored GROUP BY aid",
    "explainability": "WITH " + SCORED + " SELECT aid, 'P' || idx AS tag, count(*) AS n_sentences, max(combined) AS confidence FROM scored WHERE origin <> 'none' GROUP BY aid, idx",
    "hallucination_summary": "WITH " + CHECKED + " SELECT count(*) AS n, coalesce(round(1 - avg(well_grounded::INT), 4), 0) AS hallucination_rate, coalesce(round(avg(validity), 4), 0) AS mean_validity, coalesce(round(avg(overlap), 4), 0) AS mean_overlap, coalesce(round(avg(uncited_ratio), 4), 0) AS mean_uncited FROM checked",
    "evidence_prompts": "WITH " + ANSWERS + ", b AS (SELECT aid, string_agg('[P' || idx || '] (unknown source, p.' || idx || '): ' || trim(passage), chr(10) || chr(10) ORDER BY idx) AS evidence FROM evidence GROUP BY aid) SELECT aid AS qid, 'Question: ' || reference || chr(10) || chr(10) || 'Evidence:' || chr(10) || evidence || chr(10) || chr(10) || 'Answer with [Pn] citations.' AS prompt FROM turns JOIN b USING (aid)",
    "extractive_answers": "WITH " + ANSWERS + " SELECT aid, 'According to retrieved medical documentation: ' || left(passage, 200) || ' [P1]' AS answer FROM evidence WHERE idx = 1",
    "assembled_answers": "WITH " + CLAIMS + """, s AS (SELECT aid, ordinal, CASE WHEN NOT grounded AND confidence <> 'low' THEN NULL WHEN confidence = 'unsupported' THEN text || ' (low confidence — not directly supported by retrieved evidence)' ELSE trim(text || ' ' || array_to_string(list_transform(eids, lambda e: '[' || e || ']'), '')) END AS line FROM claims)
SELECT aid, coalesce(string_agg(line, ' ' ORDER BY ordinal) FILTER (line IS NOT NULL), '') AS answer FROM s GROUP BY aid""",
    "citation_metrics": "WITH " + CLAIMS + """, ev AS (SELECT DISTINCT conv_id AS aid, 'E' || (turn % 6) AS eid FROM conversations), gold AS (SELECT conv_id AS aid, 'E' || (turn % 6) AS eid FROM conversations WHERE conv_id % 2 = 0),
used AS (SELECT DISTINCT aid, unnest(eids) AS eid FROM claims),
per AS (SELECT aid, sum(len(eids)) AS n, sum(CASE WHEN grounded THEN len(eids) ELSE 0 END) AS ok, avg((len(eids) > 0)::INT) AS cc FROM claims GROUP BY aid),
cr AS (SELECT aid, avg((u.eid IS NOT NULL)::INT) AS r FROM gold LEFT JOIN used u USING (aid, eid) GROUP BY aid), ec AS (SELECT aid, avg((u.eid IS NOT NULL)::INT) AS r FROM ev LEFT JOIN used u USING (aid, eid) GROUP BY aid)
SELECT aid, coalesce(round(CASE WHEN n > 0 THEN ok / n END, 6), 0)::DOUBLE AS citation_precision, coalesce(round(cr.r, 6), 0) AS citation_recall, round(cc, 6) AS citation_coverage, coalesce(round(ec.r, 6), 0) AS evidence_coverage FROM per LEFT JOIN cr USING (aid) LEFT JOIN ec USING (aid)""",
    "cache_events": "WITH e AS (SELECT event_type, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, ts FROM events) SELECT event_type, count(*) AS n, sum((before IS NOT NULL AND ts - before <= INTERVAL 1 HOUR)::INT)::BIGINT AS hits FROM e GROUP BY event_type",
}
