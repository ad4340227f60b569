"""Entities and relations. The built-in extractor finds the terms of a gazetteer; another one may give the same columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let, sentences
from .storage import settle

ENTITY_WORD = r"[\p{L}]+"


#: Terms of a gazetteer, about 50 bytes each, that are broadcast; more are joined by a shuffle.
FEW = 1_000_000

#: Terms of the chunks' own gazetteer whose hashes, 8 bytes each, are sent to the tasks, and other words with such a hash that are told apart by name; with more of either, words are shuffled.
MANY, ALIKE = 50_000_000, 1_000

#: Pairs of mentions that a task makes at once, about 100 bytes each.
PAIRS = 1_000_000


def gazetteer(chunks: DataFrame, key: str = "chunk_id", text: str = "text", length: int = 6, least: int = 2, most: int = 10, share: float = 0.001) -> DataFrame:
    """Terms (``entity``, ``df``) of ``length`` letters or more that are in ``least`` chunks or more, and in ``most`` or a ``share`` of
    all, whichever is greater, at most: the band grows with the corpus."""
    return gazetteer_and_common(chunks, key, text, length, least, most, share)[0]


def gazetteer_and_common(chunks: DataFrame, key: str = "chunk_id", text: str = "text", length: int = 6, least: int = 2, most: int = 10, share: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """:func:`gazetteer`, and the terms that are in more chunks than it allows. However large the corpus, these are at most a chunk's mean number of distinct terms,
    divided by ``share``: :func:`mentions` passes over them before it shuffles anything."""
    counts = vocabulary(chunks, key, text, length, most, share).where(F.col("df") >= least)
    return counts.where(F.col("df") <= F.col("most_")).select("entity", "df"), counts.where(F.col("df") > F.col("most_")).select("entity", "df")


def vocabulary(chunks: DataFrame, key: str = "chunk_id", text: str = "text", length: int = 6, most: int = 10, share: float = 0.001) -> DataFrame:
    """Every word (``entity``) of ``length`` letters or more, the number of chunks that have it (``df``), and the most that a term may be in (``most_``); settled."""
    words = chunks.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}]{{{max(1, length)},}}"), F.lit(0)))).alias("entity"))  # shorter words are never made
    total = chunks.agg(F.greatest(F.lit(most), F.ceil(F.count("*") * share)).alias("most_"))
    return settle(words.where(F.char_length("entity") >= length).groupBy("entity").agg(F.count("*").alias("df")).join(F.broadcast(total), F.lit(True)))


def placed_words(words: Column) -> Column:
    """Words with their places in the string that they make with single spaces, as (start, surface). A fold copies what it has gathered, so it runs
    over blocks of about the root of the number of words, and then over the blocks: a sentence of any length takes time near its length."""
    empty = F.struct(F.array().cast("array<struct<start:int,surface:string>>").alias("done"), F.lit(0).alias("at"))
    place = lambda a, w: F.struct(F.concat(a["done"], F.array(F.struct(a["at"].alias("start"), w.alias("surface")))).alias("done"), (a["at"] + F.char_length(w) + 1).alias("at"))
    add = lambda a, f: F.struct(F.concat(a["offsets"], F.array(a["at"])).alias("offsets"), (a["at"] + f["at"]).alias("at"))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v["w"]) - 1) / v["step"]).cast("int")), lambda i: F.aggregate(F.slice(v["w"], i * v["step"] + 1, v["step"]), empty, place))

    def joined(folded: Column) -> Column:
        offsets = F.aggregate(folded, F.struct(F.array().cast("array<int>").alias("offsets"), F.lit(0).alias("at")), add, lambda a: a["offsets"])
        return F.flatten(F.zip_with(folded, offsets, lambda f, o: F.transform(f["done"], lambda w: F.struct((w["start"] + o).alias("start"), w["surface"].alias("surface")))))

    split = F.struct(words.alias("w"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(words))).cast("int")).alias("step"))
    return let(let(split, blocks), joined)


def mentions(chunks: DataFrame, entities: DataFrame, key: str = "chunk_id", text: str = "text", common: DataFrame | None = None) -> DataFrame:
    """``chunk_id``, ``sentence``, ``ordinal`` (place of the word in its sentence), ``start`` (its first character there), ``length``, ``surface``,
    ``entity``. Words of the gazetteer are found where they are if it is small. If not, words shorter than its shortest term and the ``common`` ones, known to be
    none of its terms, are passed over, and only what remains is shuffled. Places are counted for words that were not passed over."""
    rows = chunks.select(F.col(key).alias("chunk_id"), F.posexplode(sentences(F.col(text))).alias("sentence", "s"))
    plain = rows.select("chunk_id", "sentence", F.char_length("s").alias("length"), F.trim(F.regexp_replace("s", r"[^\p{L}]+", " ")).alias("line_"))
    words = plain.select("chunk_id", "sentence", "length", "line_", F.posexplode(F.split("line_", " ")).alias("ordinal", "surface")).withColumn("entity", F.lower("surface"))
    start = F.when(F.col("ordinal") == 0, 0).otherwise(F.expr("char_length(substring_index(line_, ' ', ordinal))") + 1)
    placed = lambda df: df.select("chunk_id", "sentence", "ordinal", start.alias("start"), "length", "surface", "entity")
    known = settle(entities.select("entity"))
    size, shortest = known.agg(F.count("*"), F.min(F.char_length("entity"))).first()
    named = words.where(F.char_length("entity") >= max(1, shortest or 1))
    if size <= FEW:
        return placed(named.join(F.broadcast(known), "entity"))
    if common is not None:
        passed = settle(common.select("entity"))
        named = named.join(F.broadcast(passed) if passed.count() <= FEW else passed, "entity", "left_anti")
    return placed(named).join(known, "entity").select("chunk_id", "sentence", "ordinal", "start", "length", "surface", "entity")


def hashed(entity: Column) -> Column:
    return F.xxhash64(entity)


def among(spark: SparkSession, names: DataFrame) -> Callable[[Column], Column]:
    """A function of a column of arrays of :func:`hashed` words: the places of those whose hash a name (``entity``) has. Only the hashes of the names are sent to the tasks."""
    held = spark.sparkContext.broadcast(np.unique(names.select(hashed(F.col("entity")).alias("h")).toArrow()["h"].to_numpy()))

    @F.arrow_udf("array<int>")
    def places(lists: pa.Array) -> pa.Array:
        known, flat, sizes = held.value, lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
        asked = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
        words, row = flat.drop_null().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(words)  # so that neighbours in the search are neighbours in memory
        at = np.searchsorted(known, words[order])
        inside = at < len(known)
        hit = np.sort(asked[order[inside][known[at[inside]] == words[order][inside]]])
        ends = np.cumsum(np.bincount(row[hit], minlength=len(sizes)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hit - (np.cumsum(sizes) - sizes)[row[hit]], pa.int32()))

    return places.asNondeterministic()  # so that filters on what it finds are not moved below it, where it would run again


def own_sentences(chunks: DataFrame, key: str = "chunk_id", text: str = "text", length: int = 6, least: int = 2, most: int = 10, share: float = 0.001) -> DataFrame:
    """The sentences that mention a term of the chunks' own :func:`gazetteer`: ``chunk_id``, ``sentence``, ``length``, and ``mentions``, (ordinal, start, surface, entity) in order.
    A sentence's words are looked up where they are, by hash, so none is shuffled however large the gazetteer. All words of the chunks are known: those that only share a term's hash are found beforehand and left out."""
    words = vocabulary(chunks, key, text, length, most, share)
    term = (F.col("df") >= least) & (F.col("df") <= F.col("most_"))
    terms, others = words.where(term), words.where(~term)
    if terms.count() <= MANY:
        places = among(chunks.sparkSession, terms)
        alike = [r[0] for r in others.where(F.size(places(F.array(hashed(F.col("entity"))))) > 0).select("entity").limit(ALIKE + 1).collect()]
        if len(alike) <= ALIKE:
            return _sentences(chunks, key, text, length, places, alike)
    found = mentions(chunks, terms, key, text, others.where(F.col("df") >= least))
    return found.groupBy("chunk_id", "sentence").agg(F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("ordinal", "start", "surface", "entity"))).alias("mentions"))


def _sentences(chunks: DataFrame, key: str, text: str, shortest: int, places: Callable[[Column], Column], alike: list[str]) -> DataFrame:
    rows = chunks.select(F.col(key).alias("chunk_id"), F.posexplode(sentences(F.col(text))).alias("sentence", "s"))
    plain = rows.select("chunk_id", "sentence", F.char_length("s").alias("length"), F.trim(F.regexp_replace("s", r"[^\p{L}]+", " ")).alias("line_"))
    asked = F.transform(F.split(F.lower("line_"), " "), lambda w: F.when(F.char_length(w) >= shortest, hashed(w)))
    some = plain.withColumn("at_", places(asked)).where(F.size("at_") > 0)
    start = lambda i: F.when(i == 0, 0).otherwise(F.char_length(F.call_function("substring_index", F.col("line_"), F.lit(" "), i)) + 1)
    made = let(F.split("line_", " "), lambda ws: F.transform("at_", lambda i: F.struct(i.alias("ordinal"), start(i).alias("start"), F.get(ws, i).alias("surface"), F.lower(F.get(ws, i)).alias("entity"))))
    out = some.select("chunk_id", "sentence", "length", made.alias("mentions"))
    return out.withColumn("mentions", F.filter("mentions", lambda m: ~m["entity"].isin(alike))).where(F.size("mentions") > 0) if alike else out


def own_mentions(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Mentions of the chunks' own :func:`gazetteer`, in rows as of :func:`mentions`."""
    return spread(own_sentences(chunks, key, text))


def spread(held: DataFrame) -> DataFrame:
    """The mentions of :func:`own_sentences` in rows. None of its lists is empty; a plain explode would make them once more to see this."""
    return held.select("chunk_id", "sentence", "length", F.explode_outer("mentions").alias("m")).select("chunk_id", "sentence", "m.ordinal", "m.start", "length", "m.surface", "m.entity")


def proximity(start_a: Column, start_b: Column, length: Column) -> Column:
    return nearness(F.abs(start_a - start_b) / F.greatest(length, F.lit(1)))


def nearness(apart: Column) -> Column:
    """Of a distance as a share of a sentence's length; the less this is, the greater."""
    return F.round(1 - F.least(apart, F.lit(1.0)) * 0.7 + 1e-9, 3)  # half goes up


def relations(found: DataFrame) -> DataFrame:
    """Pairs of mentions in one sentence, the earlier one first: ``subject``, ``predicate``, ``object``, their places, ``confidence``. Both sides take
    the same columns, so that mentions are shuffled once for the two."""
    return _pairs(found, F.lit("related_to"))


def _pairs(found: DataFrame, predicate: Column) -> DataFrame:
    a, b = found.alias("a"), found.alias("b")
    on = F.expr("a.chunk_id = b.chunk_id AND a.sentence = b.sentence AND a.ordinal < b.ordinal")
    return a.join(b, on).select(
        F.col("a.chunk_id").alias("chunk_id"), F.col("a.sentence").alias("sentence"), F.col("a.entity").alias("subject"), predicate.alias("predicate"), F.col("b.entity").alias("object"), F.col("a.ordinal").alias("subject_ord"), F.col("b.ordinal").alias("object_ord"),
        proximity(F.col("a.start"), F.col("b.start"), F.greatest("a.length", "b.length")).alias("confidence"),
    )


def sentence_relations(held: DataFrame) -> DataFrame:
    """:func:`relations` of :func:`own_sentences`: a sentence's mentions are in its row, so pairs are made there and nothing is shuffled."""
    earlier = held.select("chunk_id", "sentence", "length", "mentions", F.explode_outer(F.sequence(F.lit(0), F.size("mentions") - 1)).alias("i"))
    pairs = earlier.select("chunk_id", "sentence", "length", F.get("mentions", F.col("i")).alias("a"), F.explode(F.slice("mentions", F.col("i") + 2, F.size("mentions"))).alias("b"))
    return pairs.select(
        "chunk_id", "sentence", F.col("a.entity").alias("subject"), F.lit("related_to").alias("predicate"), F.col("b.entity").alias("object"), F.col("a.ordinal").alias("subject_ord"), F.col("b.ordinal").alias("object_ord"),
        proximity(F.col("a.start"), F.col("b.start"), F.col("length")).alias("confidence"),
    )


def chunk_pairs(held: DataFrame) -> DataFrame:
    """The pairs of :func:`sentence_relations` of two different entities, counted by chunk where they are: ``chunk_id``, ``subject``, ``object``, ``weight``, and ``apart``, the least distance as a share of the
    sentence's length. :data:`PAIRS` are made at once. A chunk whose sentences lie in two batches may have a pair twice, in parts."""
    rows = held.select("chunk_id", "length", F.col("mentions.entity").alias("names"), F.col("mentions.start").alias("starts"))

    def counted(parts: list) -> list:
        key, weight, apart = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return [key[first], np.add.reduceat(weight[order], first), np.minimum.reduceat(apart[order], first)] if len(key) else [key, weight, apart]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, chunks = b.column("names").value_lengths().to_numpy(), b.column("chunk_id").dictionary_encode()
            named = b.column("names").flatten().dictionary_encode()
            entity, start, words, n = named.indices.to_numpy().astype(np.int64), b.column("starts").flatten().to_numpy(), len(named.dictionary), len(chunks.dictionary)
            row = np.repeat(np.arange(len(sizes)), sizes)
            chunk, length = chunks.indices.to_numpy()[row], np.maximum(b.column("length").to_numpy(), 1)[row]
            later = np.cumsum(sizes)[row] - 1 - np.arange(len(row))
            upto, done, at = np.cumsum(later), [], 0
            while at < len(row):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] - later[at] + PAIRS, "right")))
                of = later[at:end]
                i = np.repeat(np.arange(at, end), of)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(of) - of, of)
                two = entity[i] != entity[j]
                i, j = i[two], j[two]
                done.append(counted([[(entity[i] * words + entity[j]) * n + chunk[i], np.ones(len(i), np.int64), np.abs(start[i] - start[j]) / length[i]]]))
                at = end
            if done:
                key, weight, apart = counted(done) if len(done) > 1 else done[0]
                pair = key // n
                yield pa.RecordBatch.from_arrays([chunks.dictionary.take(pa.array(key % n)), named.dictionary.take(pa.array(pair // words)), named.dictionary.take(pa.array(pair % words)), pa.array(weight), pa.array(apart)], ["chunk_id", "subject", "object", "weight", "apart"])

    return rows.mapInArrow(run, f"chunk_id {held.schema['chunk_id'].dataType.simpleString()}, subject string, object string, weight long, apart double")


def linked(found: DataFrame) -> DataFrame:
    """The distinct (``subject``, ``predicate``, ``object``) of :func:`relations`, which is all that a walk needs. A sentence's entities are paired once, by their first and last
    places, and not each mention with each; self-loops are left out."""
    return _directed(paired(found))


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.filter(F.array(F.when(F.col("to_") > 0, F.struct(F.col("a").alias("subject"), F.col("b").alias("object"))), F.when(F.col("from_") > 0, F.struct(F.col("b").alias("subject"), F.col("a").alias("object")))), lambda e: e.isNotNull())).alias("e")).select("e.subject", F.lit("related_to").alias("predicate"), "e.object")


def paired(found: DataFrame) -> DataFrame:
    """Each two entities that share a sentence once: ``a`` before ``b``, and whether there is a relation from ``a`` (``to_``) and to it (``from_``). Mentions are shuffled once, by sentence, for both sides
    and all steps, and pairs once, whatever their directions."""
    once = found.select("chunk_id", "sentence", "entity", "ordinal").repartition("chunk_id", "sentence").groupBy("chunk_id", "sentence", "entity").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    a, b = once.alias("a"), once.alias("b")
    on = F.expr("a.chunk_id = b.chunk_id AND a.sentence = b.sentence AND a.entity < b.entity")
    to, back = F.expr("a.first < b.last").cast("int"), F.expr("b.first < a.last").cast("int")
    return a.join(b, on).select(F.col("a.entity").alias("a"), F.col("b.entity").alias("b"), to.alias("to_"), back.alias("from_")).groupBy("a", "b").agg(F.max("to_").alias("to_"), F.max("from_").alias("from_"))


def around(found: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The mentions of sentences that a walk of ``hops`` from ``seeds`` (seed) looks at: all neighbours of what is fewer hops away."""
    names, part = seeds.select(F.col("seed").alias("entity")).distinct(), found
    for _ in range(hops):
        places = found.join(names, "entity", "left_semi").select("chunk_id", "sentence").distinct()
        part = settle(found.join(places, ["chunk_id", "sentence"], "left_semi"))
        names = part.select("entity").distinct()
    return part


def sentences_around(held: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """:func:`around` of :func:`own_sentences`. A sentence is kept where it is if it has a name by hash, so no mention is shuffled. One that only shares a hash adds links that
    are in the graph anyway, and that a walk from ``seeds`` does not need."""
    names, part = seeds.select(F.col("seed").alias("entity")).distinct(), held
    for _ in range(hops):
        places = among(held.sparkSession, names)
        part = held.where(F.size(places(F.transform("mentions", lambda m: hashed(m["entity"])))) > 0)
        names = part.select(F.explode_outer("mentions.entity").alias("entity")).distinct()
    return part


def sentences_linked(held: DataFrame) -> DataFrame:
    """:func:`linked` of :func:`own_sentences`: pairs are made in a sentence's row, and shuffled once, whatever their directions."""
    subject, object_ = F.col("subject"), F.col("object")
    pairs = sentence_relations(held).where(subject != object_).groupBy(F.least(subject, object_).alias("a"), F.greatest(subject, object_).alias("b"))
    return _directed(pairs.agg(F.max((subject < object_).cast("int")).alias("to_"), F.max((subject > object_).cast("int")).alias("from_")))


def next_verbs(places: DataFrame, chunks_words: DataFrame, verbs: DataFrame) -> DataFrame:
    """``places`` (chunk_id, sentence, ordinal, more) with ``verbs_``, the first two verbs after each in its sentence as (at, word): one pass over a sentence from its end."""
    kept = [c for c in places.columns if c not in ("chunk_id", "sentence", "ordinal")]
    said = chunks_words.join(F.broadcast(verbs.select("word").distinct()), "word").select("chunk_id", "sentence", "ordinal", F.struct(F.col("ordinal").alias("at"), "word").alias("verb_"))
    rows = places.select("chunk_id", "sentence", "ordinal", F.struct(*kept, F.lit(1).alias("own_")).alias("place_")).unionByName(said, allowMissingColumns=True)
    later = Window.partitionBy("chunk_id", "sentence").orderBy(F.desc("ordinal")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("one_", F.last("verb_", ignorenulls=True).over(later))
    rows = rows.withColumn("two_", F.last(F.when(F.col("verb_").isNotNull(), F.struct("one_")), ignorenulls=True).over(later)["one_"])
    return rows.where(F.col("place_").isNotNull()).select("chunk_id", "sentence", "ordinal", *[F.col(f"place_.{c}").alias(c) for c in kept], F.array_compact(F.array("one_", "two_")).alias("verbs_"))


def _named_by(verbs: Column, upto: Column) -> Column:
    between = F.transform(F.filter(verbs, lambda v: v["at"] < upto), lambda v: v["word"])
    return F.when(F.size(between) > 0, F.array_join(between, "_")).otherwise(F.lit("related_to"))


def verb_relations(found: DataFrame, chunks_words: DataFrame, verbs: DataFrame) -> DataFrame:
    """:func:`relations` with the predicates of :func:`verb_predicates`. A mention has its two verbs before it is paired, so pairs are made once and not joined again."""
    return _pairs(settle(next_verbs(found.drop("surface"), chunks_words, verbs)), _named_by(F.col("a.verbs_"), F.col("b.ordinal")))


def verb_predicates(rels: DataFrame, chunks_words: DataFrame, verbs: DataFrame) -> DataFrame:
    """Relations with a predicate of the first two verbs between their ends, joined by "_", where there are any.
    ``rels`` has ``subject_ord`` and ``object_ord`` besides; ``chunks_words`` (chunk_id, sentence, ordinal, word); ``verbs`` (word) is a lexicon."""
    starts = rels.select("chunk_id", "sentence", F.col("subject_ord").alias("ordinal")).distinct()
    known = next_verbs(starts, chunks_words, verbs).withColumnRenamed("ordinal", "subject_ord")
    return rels.join(known, ["chunk_id", "sentence", "subject_ord"]).withColumn("predicate", _named_by(F.col("verbs_"), F.col("object_ord"))).select(*rels.columns)


def sentence_words(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``chunk_id``, ``sentence``, ``ordinal``, ``word`` (lower-cased), numbered as in :func:`mentions`."""
    rows = chunks.select(F.col(key).alias("chunk_id"), F.posexplode(sentences(F.col(text))).alias("sentence", "s"))
    return rows.select("chunk_id", "sentence", F.posexplode(F.split(F.trim(F.regexp_replace("s", r"[^\p{L}]+", " ")), " ")).alias("ordinal", "w")).select("chunk_id", "sentence", "ordinal", F.lower("w").alias("word"))
