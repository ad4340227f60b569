"""Okapi BM25 over a corpus and a set of queries: one plan for all queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, terms
from .storage import settle

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Index:
    """``postings`` (doc_id, term, tf, dl), ``idf`` (term, df, idf), ``totals`` (n_docs, avgdl), and of a stored index the ``packed`` postings."""

    postings: DataFrame
    idf: DataFrame
    totals: DataFrame
    packed: DataFrame | None = None


#: Folders of a stored index, by hash of term; postings of one of its rows, of what one file holds of a folder, and of what a task gathers by term before they are shuffled.
SLOTS, ROW, FILE, GATHER = 64, 4_096, 1_000_000, 1_000_000

#: Question terms that are broadcast, about 100 bytes each; more are joined by a shuffle.
FEW = 1_000_000

#: Scores of a question and a document that a task sums and sorts, about 250 bytes each; tasks at most, each with more if these are too few.
SCORES, TASKS = 500_000, 8_192


def counted(words: Column) -> Column:
    """Distinct words of an array and how often each is there, as (term, tf): runs of the sorted array, found in one pass. ``sort_array`` sorts without a lambda for each comparison, which ``array_sort`` has."""
    runs = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    each = lambda p: F.transform(p["at"], lambda i, n: F.struct(F.get(p["s"], i).alias("term"), (F.coalesce(F.get(p["at"], n + 1), F.size(p["s"])) - i).cast("long").alias("tf")))
    found = let(F.sort_array(words), lambda s: let(F.struct(s.alias("s"), runs(s).alias("at")), each))
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", epsilon: float = EPSILON) -> Index:
    """A document's terms are counted in its own row and settled, one row for a document, so no token is shuffled; only
    distinct terms of a partition are, for their document counts. Negative weights become ``epsilon`` times the mean weight."""
    words = docs.select(F.col(key).alias("doc_id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    tokens = settle(words.select("doc_id", F.size("terms").alias("dl"), counted(F.col("terms")).alias("postings")))
    totals = tokens.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    postings = tokens.select("doc_id", "dl", F.explode("postings").alias("p")).select("doc_id", "p.term", "dl", "p.tf")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = settle(df.join(F.broadcast(totals), F.lit(True)).withColumn("raw", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, idf, totals)


def slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def pack(ix: Index) -> DataFrame:
    """Postings by term, as an index is stored: ``slot``, ``term``, ``block`` and its ``postings`` (doc_id, tf, dl), about :data:`ROW` at most, so that
    a frequent term is many rows. Such terms are few: each has more than :data:`ROW` documents. Postings are shuffled once, :func:`gathered` by term and dealt by folder, so
    that a folder gets a few files and not one from each task."""
    frequent = ix.idf.where(F.col("df") > ROW).select("term", F.ceil(F.col("df") / ROW).cast("int").alias("blocks"))
    frequent = F.broadcast(frequent) if frequent.count() <= FEW else frequent
    total = ix.idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    files = max(1, -(-total // (SLOTS * FILE)))
    dealt = ix.postings.join(frequent, "term", "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    rows = gathered(dealt).select(slot(F.col("term")).alias("slot"), F.pmod(F.xxhash64("block", "term"), F.lit(files)).alias("file_"), "term", "block", "doc_id", "tf", "dl").repartition(SLOTS * files, "slot", "file_")
    each = F.arrays_zip("doc_id", "tf", "dl").cast(f"array<struct<doc_id:{ix.postings.schema['doc_id'].dataType.simpleString()},tf:bigint,dl:int>>")
    return rows.groupBy("slot", "file_", "term", "block").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("postings")).drop("file_")


def gathered(postings: DataFrame) -> DataFrame:
    """Postings (term, block, doc_id, tf, dl) of a task as lists ``doc_id``, ``tf`` and ``dl`` of each (``term``, ``block``) among :data:`GATHER` of them, so that a term is shuffled
    once for many documents."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= GATHER:
                yield lists(held)
                held = []
        if held:
            yield lists(held)

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        named = t["term"].combine_chunks().dictionary_encode()
        term, block = named.indices.to_numpy().astype(np.int64), t["block"].to_numpy()
        order = np.lexsort((t["doc_id"].to_numpy(), block, term)) if pa.types.is_integer(t["doc_id"].type) else np.lexsort((block, term))
        term, block = term[order], block[order]
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        ends = pa.array(np.append(first, len(order)).astype(np.int32))
        columns = [pa.ListArray.from_arrays(ends, t[c].combine_chunks().take(pa.array(order))) for c in ("doc_id", "tf", "dl")]
        return pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(term[first])), pa.array(block[first], pa.int32()), *columns], ["term", "block", "doc_id", "tf", "dl"])

    key = postings.schema["doc_id"].dataType.simpleString()
    return postings.select("term", "block", "doc_id", F.col("tf").cast("int"), "dl").mapInArrow(run, f"term string, block int, doc_id array<{key}>, tf array<int>, dl array<int>")


def unpacked(packed: DataFrame) -> DataFrame:
    return packed.select("term", F.explode("postings").alias("p")).select("p.doc_id", "term", "p.dl", "p.tf")


def stored(packed: DataFrame, idf: DataFrame, totals: DataFrame) -> Index:
    """The index that :func:`pack` and its other two tables were made of."""
    return Index(unpacked(packed), idf, totals, packed)


def _asked_postings(ix: Index, asked: DataFrame) -> DataFrame:
    """The postings of the asked terms. A stored index is read in the folders of these terms only, and a row's postings are
    unpacked once its term is known to be asked."""
    if ix.packed is None:
        return ix.postings.join(asked, "term", "left_semi")
    slots = [r[0] for r in asked.select(slot(F.col("term"))).distinct().collect()]  # SLOTS numbers at most
    rows = ix.packed.where(F.col("slot").isin(slots)) if len(slots) < SLOTS else ix.packed
    return unpacked(rows.join(asked, "term", "left_semi"))


def _parts(ix: Index, questions: int) -> int:
    """Tasks that documents are dealt to for some questions. Each document may have a score for each, so their bytes before that say little."""
    cores = ix.totals.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(TASKS, -(-ix.totals.first()["n_docs"] * questions // SCORES)))


def search(ix: Index, queries: DataFrame, k: int, key: str = "qid", text: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """``key``, ``doc_id``, ``score`` (6 decimals), ``rank``; a term repeated in a query counts as often. ``k`` rows at most for a query, then
    those above 0. If the asked terms are few, their postings are found where they are and dealt by document, each once however many questions have
    its term, and a document's scores are summed and ranked where it is, about :data:`SCORES` in a task."""
    named = queries.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("qtf"))
    asked = settle(named.join(ix.idf, "term"))
    few = asked.count() <= FEW
    held = _asked_postings(ix, F.broadcast(asked) if few else asked)
    hits = (held.repartition(_parts(ix, asked.select(key).distinct().count()), "doc_id").join(F.broadcast(asked), "term") if few else held.join(asked, "term")).join(F.broadcast(ix.totals), F.lit(True))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(key, "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0))
