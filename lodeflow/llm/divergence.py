"""How far the term distributions of a language's sources lie apart: sketch-prefiltered counting, then sparse joins.

1. Each task adds its documents' distinct (language, term) pairs to a count-min sketch; the sketches are merged by
   adding. A cell holds at least the document frequency of each pair that falls into it, so a pair with a cell below
   ``min_docs`` cannot be frequent enough. Only one bit for each cell goes on, which bounds what is broadcast by the sketch's size.
2. A second pass counts, for each group (language and source), the pairs that the sketch lets through. What it discards is
   never shuffled; what it lets through wrongly goes by the exact document frequency.
3. Distributions are sparse: a group is joined with another on the terms that both have. A term that one side lacks has that side's
   floor, which depends on the group alone, so such terms are summed by their counts, without a row for each pair.

The sketch is ``DEPTH`` rows wide as a 256th of the bytes of text, :data:`WIDEST` cells at most; beyond that it lets more through, and results stay the same.
Group pairs of a language are the result, so their number is quadratic in its sources; the shared terms of a pair are summed in the task that meets them.
No text is shuffled. A very long text is handled in one stretch. Probabilities and their sums are exact integers.

Cases: null text, language and source are empty strings. A language without a kept term has pairs of value 0 and no terms.
An empty table gives an empty one. Repeated rows and ids count as often as they stand. Ties are ranked by the item's bytes.
Only the three named columns are read, so others may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, release_state, table
from .words import loosened, squeezed

#: Rows of the sketch, the least and most cells of a row, bytes of text for a cell, and cells that are sent together.
DEPTH, NARROWEST, WIDEST, BYTES_PER_CELL, CHUNK = 3, 1 << 16, 1 << 24, 256, 1 << 12
#: Documents of its language that a term must stand in; ranks of terms that are listed.
MIN_DOCS, TOP_TERMS = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _bytes_of_terms() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z lower-cased, and whether it belongs to a term: a letter of ASCII, or part of any other character."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    inside = np.zeros(256, bool)
    inside[ord("a") : ord("z") + 1] = inside[0x80:] = True
    return lower, inside


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all occurrences in order: the document and the number of the term; and the terms by their numbers."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
    if ends[0] == ends[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    lower, kind = _bytes_of_terms()
    data = lower[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends -= ends[0]
    inside = kind[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = ends[:-1][np.diff(ends) > 0]
    opens[begins] = inside[begins]
    at = np.flatnonzero(opens)
    before = np.cumsum(inside) - inside
    offsets = np.append(before[at], inside.sum()).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    return np.searchsorted(ends, at, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def cells(langs: list[str], words: list[str], width: int) -> np.ndarray:
    """The cells of (language, term) pairs, a row of the result for each row of the sketch."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(f"{a}\0{b}".encode()) for a, b in zip(langs, words, strict=True)), np.uint64, len(words))
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((one + np.uint64(i) * two) & np.uint64(width - 1)).astype(np.int64) + i * width for i in range(DEPTH)])


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(column, "").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _distinct(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two columns, and how often each stands."""
    pairs, counts = np.unique(a * max(n_b, 1) + b, return_counts=True)
    return pairs // max(n_b, 1), pairs % max(n_b, 1), counts


def possible(rows: DataFrame, width: int, min_docs: int = MIN_DOCS) -> np.ndarray:
    """For each cell of the merged sketch of ``rows`` (lang, source, text), whether it has ``min_docs`` documents or more."""

    def add(batches):
        release_state()
        sketch = np.zeros(DEPTH * width, np.uint32)
        for b in bpe.stretches(batches, "text"):
            doc, term, names = terms(b.column("text"))
            lang, langs = _coded(b.column("lang"))
            doc, term, _ = _distinct(doc, term, len(names))
            at, term, counts = _distinct(lang[doc], term, len(names))
            words = names.to_pylist()
            for row in cells([langs[i] for i in at], [words[i] for i in term], width):
                np.add.at(sketch, row, counts.astype(np.uint32))
        for i in range(0, len(sketch), CHUNK):
            if sketch[i : i + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK]), pa.array([squeezed(sketch[i : i + CHUNK])])], ["chunk", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + loosened(counts).astype(np.int64)
        for chunk, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.packbits(counts >= min_docs).tobytes()])], ["chunk", "bits"])

    bits = np.zeros(DEPTH * width // 8, np.uint8)
    merged = rows.mapInArrow(add, "chunk long, counts binary").repartition("chunk").mapInArrow(merge, "chunk long, bits binary")
    for r in merged.toLocalIterator():
        bits[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def counted(rows: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """``n`` occurrences and ``df`` documents of each (lang, source, term) that the sketch lets through."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        release_state()
        allowed = np.unpackbits(sent.value).astype(bool)
        for b in bpe.stretches(batches, "text"):
            doc, term, names = terms(b.column("text"))
            lang, langs = _coded(b.column("lang"))
            source, sources = _coded(b.column("source"))
            group = lang * max(len(sources), 1) + source
            doc, term, times = _distinct(doc, term, len(names))
            at, word = (x for x in _distinct(lang[doc], term, len(names))[:2])
            words = names.to_pylist()
            ok = np.zeros(max(len(langs), 1) * max(len(names), 1), bool)
            ok[at * max(len(names), 1) + word] = allowed[cells([langs[i] for i in at], [words[i] for i in word], width)].all(axis=0)
            kept = ok[lang[doc] * max(len(names), 1) + term]
            pairs, which = np.unique(group[doc[kept]] * max(len(names), 1) + term[kept], return_inverse=True)
            n, df = np.bincount(which, times[kept], len(pairs)).astype(np.int64), np.bincount(which, minlength=len(pairs))
            group, term = pairs // max(len(names), 1), pairs % max(len(names), 1)
            take = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([take(langs, group // max(len(sources), 1)), take(sources, group % max(len(sources), 1)), names.take(pa.array(term)), pa.array(n), pa.array(df.astype(np.int64))], ["lang", "source", "term", "n", "df"])

    found = rows.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: str, total: str = "total", kept: str = "kept") -> Column:
    return F.expr(f"1 + ({SCALE} * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))) DIV CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20, 0))")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, width: int | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source lies from each other source of its language (``pair``), and the terms
    that it has more of than its language (``term``, ``top`` of them)."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    if width is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = min(WIDEST, max(NARROWEST, 1 << (n_bytes // BYTES_PER_CELL).bit_length()))
    found = cut(counted(rows, possible(rows, width, min_docs), width))
    by_lang = cut(found.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df"))
    sizes = by_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    own = found.join(by_lang, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "total_lang")])
        .withColumn("floor", F.when(F.col("kept") > 0, _share("0L")))
    )
    shares = cut(own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share("n").alias("p"), _share("n_lang", "total_lang").alias("q"), "floor"))

    terms_ = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    one, two = groups.alias("x"), groups.alias("y")
    apart = F.abs(F.col("x.floor") - F.col("y.floor"))
    pairs = one.join(two, F.expr("x.lang = y.lang AND x.source <> y.source")).select("x.lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.coalesce(F.col("x.kept") * apart, F.lit(0)).alias("value"))
    alike = shares.groupBy("lang", "source", "p", "floor").agg(F.count("*").alias("rows")).alias("x")
    beside = alike.join(two, F.expr("x.lang = y.lang AND x.source <> y.source")).select("x.lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), (F.col("rows") * (F.abs(F.col("x.p") - F.col("y.floor")) - apart)).alias("value"))
    beside = beside.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a, b = shares.alias("x"), shares.alias("y")
    both = a.join(b, F.expr("x.lang = y.lang AND x.term = y.term AND x.source < y.source")).select("x.lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), (F.abs(F.col("x.p") - F.col("y.p")) - F.abs(F.col("x.p") - F.col("y.floor")) - F.abs(F.col("x.floor") - F.col("y.p")) + apart).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = pairs.union(beside).union(turned(beside)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")).unionByName(ranked(terms_).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence": op12_divergence}

#: All terms of all groups, without a sketch and without sparse sums.
ORACLE_SQL = {
    "op12_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occ AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM occ GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n_lang FROM c GROUP BY ALL HAVING sum(df) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS kept, sum(n_lang) AS total_lang FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, n_lang FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT own.*, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY own.lang, own.source) + {SMOOTH} * kept) AS p, 1 + ({SCALE}::HUGEINT * (n_lang + {SMOOTH})) // (total_lang + {SMOOTH} * kept) AS q FROM own JOIN v ON v.lang = own.lang),
pair AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
rows AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM rows) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
}
