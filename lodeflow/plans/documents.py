"""Queries: cleaning, headings, chunking, stitching, token sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks
from ..sources import files
from .common import PAGES, pages, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = "string_split({}, chr(10))"

RUNNING = (
    PAGES
    + r""",
ls AS (SELECT source_file, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM pages0),
ends AS (SELECT source_file, unnest(list_distinct([lines[1], lines[-1]])) AS line FROM ls WHERE len(lines) > 0),
cnt AS (SELECT source_file, line, count(*) AS n FROM ends GROUP BY ALL),
tot AS (SELECT source_file, count(*) AS n_pages FROM pages0 GROUP BY ALL),
running AS (SELECT source_file, line, n FROM cnt JOIN tot USING (source_file) WHERE n_pages >= 3 AND n >= greatest(2, floor(n_pages * 0.4)))"""
)

CLEANED = (
    RUNNING
    + r""",
rs AS (SELECT source_file, list(line) AS lines FROM running GROUP BY ALL),
c0 AS (SELECT doc_id, source_file, page_number, CASE WHEN rs.lines IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(rs.lines, regexp_replace(x, '^\s+|\s+$', '', 'g'))), chr(10)) END AS t FROM pages0 LEFT JOIN rs USING (source_file)),
c1 AS (SELECT * REPLACE (regexp_replace(t, '([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g') AS t) FROM c0),
c2 AS (SELECT * REPLACE (array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(x, '^\s*\d{1,4}\s*$') OR regexp_matches(x, '(?i)^\s*Page\s+\d+\s*$')
  OR regexp_matches(x, '(?i)^\s*(Figure|Fig\.|Table)\s+\d+[.\-]?\d*\s*.*$') OR regexp_matches(x, '^\s*(Chapter|CHAPTER)\s+\d+.*$'))), chr(10)) AS t) FROM c1),
c3 AS (SELECT * REPLACE (regexp_replace(t, '\[\d+(?:,\s*\d+)*\]', '', 'g') AS t) FROM c2),
cleaned AS (SELECT doc_id, source_file, page_number, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{2,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM c3)"""
)

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"

_PACK = r"""
{name}s AS MATERIALIZED (SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT {key}, {split} AS ss FROM {source})),
{name}t AS MATERIALIZED (SELECT *, greatest(1, length(s) // 4) AS tok, regexp_matches(s, '(?i)^\s*(Diagnosis|Treatment|Prognosis|Risk Factors|Complications|Etiology|Pathophysiology|Clinical Features|Management|Epidemiology)\s*:?\s*$') AS sec FROM {name}s),
{name}r AS (SELECT {key}, i, 0 AS chunk, tok AS n FROM {name}t WHERE i = 1
  UNION ALL SELECT {tkey}, t.i, CASE WHEN r.n + t.tok > {target} OR t.sec THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.n + t.tok > {target} OR t.sec THEN t.tok ELSE r.n + t.tok END FROM {name}r r JOIN {name}t t ON {on} AND t.i = r.i + 1),
{name} AS (SELECT {key}, chunk, string_agg(s, ' ' ORDER BY i) AS text FROM {name}r JOIN {name}t USING ({key}, i) GROUP BY {key}, chunk)"""


def _pack(name: str, source: str, column: str, keys: tuple[str, ...], target: int) -> str:
    return _PACK.format(name=name, source=source, split=SENTENCES.format(column), key=", ".join(keys), tkey=", ".join(f"t.{k}" for k in keys), on=" AND ".join(f"t.{k} = r.{k}" for k in keys), target=target)


PARENT, CHILD, OVERLAP = 200, 60, 10


def running_headers(spark, d):
    return chunks.running_lines(pages(spark, d))


def clean_pages(spark, d):
    return chunks.clean_pages(pages(spark, d)).select("doc_id", "page_number", "cleaned")


def page_filter(spark, d):
    return chunks.usable_pages(table(spark, d, "conversations"), 40).select("conv_id", "turn", F.char_length("text").alias("n_chars"))


def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunk_sentences(F.col("text"))).alias("ordinal", "s")).select("doc_id", "ordinal", F.md5("s").alias("digest"), T.token_estimate(F.col("s")).alias("tokens"))


def _chunks(spark, d):
    return chunks.chunk_pages(chunks.clean_pages(pages(spark, d)), parent=PARENT, child=CHILD, overlap=OVERLAP)


def pack_chunks(spark, d):
    return _chunks(spark, d).where("level = 'parent'").select("doc_id", "page_number", "parent_ord", F.md5("text").alias("digest"), "tokens")


def child_chunks(spark, d):
    return _chunks(spark, d).where("level = 'child'").select("doc_id", "page_number", "parent_ord", "child_ord", F.md5("text").alias("digest"), "tokens")


def stitch_chunks(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return chunks.stitch(e, "user_id", "event_id", "event_id", "event_type").select("user_id", "first", "n", "ids", "text")


def heading_asof(spark, d):
    p = pages(spark, d)
    return chunks.heading_of_page(p, chunks.headings(p).where("level = 'chapter' AND heading LIKE '%:%'"))


def detect_headings(spark, d):
    return chunks.headings(pages(spark, d)).select("source_file", "page_number", "heading", "level")


def token_sets(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.terms(t)).alias("n_terms"), F.size(T.word_set(t)).alias("n_words"), F.size(T.metric_words(t)).alias("n_metric"), F.md5(T.squeeze(t)).alias("folded"))


def answer_cleanup(spark, d):
    raw = F.concat(F.lit('```json\n{"answer": "'), F.replace(F.col("role"), F.lit('"'), F.lit("")), F.lit(' says so.\\nConfidence: high."}\n```'))
    c = table(spark, d, "conversations").withColumn("raw", F.when(F.col("turn") % 2 == 0, raw).otherwise(F.concat("role", F.lit(" answers.\nConfidence: Medium"))))
    return c.select("conv_id", "turn", T.clean_answer(F.col("raw")).alias("answer"), T.confidence(F.when(F.col("turn") % 2 == 0, F.get_json_object(F.regexp_extract("raw", r"(\{.*\})", 1), "$.answer")).otherwise(F.col("raw"))).alias("confidence"))


def index_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id"), "event_id", "event_type", "value")
    return files.upsert(e.where("event_type <> 'purchase'").transform(lambda x: files.latest(x, "user_id", "event_id")), e.where("event_type = 'purchase'"), "user_id", "event_id")


def ids_lookup(spark, d):
    return files.by_ids(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), "doc_id")


def document_metadata(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), "source", F.lit("_vol-"), "lang", F.lit(".pdf")).alias("path"), F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("A Title")).alias("title"), F.when(F.col("doc_id") % 3 == 0, F.lit("An Author")).alias("author"))
    return files.document_metadata(f).select("doc_id", "title", "author")


def query_log(spark, d):
    return files.numbered(table(spark, d, "benchmark"), "item_id").select("item_id", "log_id")


QUERIES = {f.__name__: f for f in (running_headers, clean_pages, page_filter, split_sentences, pack_chunks, child_chunks, stitch_chunks, heading_asof, detect_headings, token_sets, answer_cleanup, index_upsert, ids_lookup, document_metadata, query_log)}

_PARENTS = "WITH RECURSIVE " + CLEANED + "," + _pack("par", "cleaned", "cleaned", ("doc_id", "page_number"), PARENT)

ORACLE_SQL = {
    "running_headers": "WITH " + RUNNING + " SELECT source_file, line, n FROM running",
    "clean_pages": "WITH " + CLEANED + " SELECT doc_id, page_number, cleaned FROM cleaned",
    "page_filter": r"SELECT conv_id, turn, length(t) AS n_chars FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) WHERE length(t) >= 40",
    "split_sentences": "WITH s AS (SELECT doc_id, " + SENTENCES.format("text") + " AS ss FROM documents), u AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ordinal FROM s) SELECT doc_id, ordinal, md5(s) AS digest, greatest(1, length(s) // 4) AS tokens FROM u",
    "pack_chunks": _PARENTS + " SELECT doc_id, page_number, chunk AS parent_ord, md5(text) AS digest, greatest(1, length(text) // 4) AS tokens FROM par",
    "child_chunks": _PARENTS
    + "," + _pack("kid", "par", "text", ("doc_id", "page_number", "chunk_"), CHILD).replace("FROM par)", "FROM (SELECT doc_id, page_number, chunk AS chunk_, text FROM par))")
    + f", l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page_number, chunk_ ORDER BY chunk) AS before FROM kid), o AS (SELECT doc_id, page_number, chunk_ AS parent_ord, chunk AS child_ord, CASE WHEN before IS NULL THEN text ELSE right(before, {4 * OVERLAP}) || ' ' || text END AS text FROM l)"
    + " SELECT doc_id, page_number, parent_ord, child_ord, md5(text) AS digest, greatest(1, length(text) // 4) AS tokens FROM o",
    "stitch_chunks": """WITH e AS (SELECT *, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, min(event_id) AS first, count(*) AS n, string_agg(event_id::VARCHAR, '+' ORDER BY event_id) AS ids, string_agg(event_type, chr(10) ORDER BY event_id) AS text FROM e GROUP BY user_id, run""",
    "heading_asof": "WITH " + PAGES + r""",
l AS (SELECT source_file, page_number, generate_subscripts(ls, 1) AS o, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM pages0)),
h AS (SELECT source_file, page_number, arg_min(regexp_replace(line, '^\s+|\s+$', '', 'g'), o) AS own FROM l WHERE regexp_matches(line, '(?i)^\s*Chapter\s+\d+[:.\s]') AND line LIKE '%:%' GROUP BY ALL)
SELECT p.source_file, p.page_number, h.own AS heading FROM pages0 p ASOF LEFT JOIN h ON p.source_file = h.source_file AND p.page_number >= h.page_number""",
    "detect_headings": "WITH " + PAGES + r""",
l AS (SELECT source_file, page_number, unnest(string_split(text, chr(10))) AS line FROM pages0)
SELECT source_file, page_number, regexp_replace(line, '^\s+|\s+$', '', 'g') AS heading, CASE WHEN regexp_matches(line, '(?i)^\s*Chapter\s+\d+[:.\s]') THEN 'chapter' ELSE 'section' END AS level
FROM l WHERE regexp_matches(line, '(?i)^\s*Chapter\s+\d+[:.\s]') OR regexp_matches(line, '^\s*\d+(\.\d+)*\s+[A-Z][A-Za-z\s]{3,80}$')""",
    "token_sets": r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-zA-Z0-9][a-zA-Z0-9\-]*')) AS n_terms, len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'))) AS n_words,
len(regexp_extract_all(lower(text), '[a-zA-Z0-9\-]+')) AS n_metric, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS folded FROM documents""",
    "answer_cleanup": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || ' says so.' ELSE role || ' answers.' END AS answer, CASE WHEN turn % 2 = 0 THEN 'High' ELSE 'Medium' END AS confidence FROM conversations",
    "index_upsert": """WITH s AS (SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY user_id), c AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id),
k AS (SELECT coalesce(c.user_id, s.user_id) AS user_id, coalesce(c.event_id, s.event_id) AS event_id FROM s FULL JOIN c USING (user_id)) SELECT k.user_id, k.event_id, e.event_type, e.value FROM k JOIN events e USING (event_id)""",
    "ids_lookup": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "document_metadata": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source[1]) || source[2:] || ' Vol ' || upper(lang[1]) || lang[2:] ELSE 'A Title' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'An Author' ELSE 'Unknown' END AS author FROM documents",
    "query_log": "SELECT item_id, 'Q' || printf('%03d', row_number() OVER (ORDER BY item_id)) AS log_id FROM benchmark",
}
