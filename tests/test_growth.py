"""Steps that have to grow with their input and no faster, and give the same rows as the plain way."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodeflow.facade import Engine
from lodeflow.functions.text import terms
from lodeflow.models import HashEncoder, unit
from lodeflow.operators import bm25, entities, fusion, graph, ranking, storage


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")


def test_shuffled_mentions_pass_over_common_words(spark, sf, monkeypatch):
    docs = _docs(spark, sf)
    terms, common = entities.gazetteer_and_common(docs)
    want = sorted(map(tuple, entities.mentions(docs, terms).collect()))
    assert common.count() and not terms.join(common, "entity").count()
    monkeypatch.setattr(entities, "FEW", 0)
    assert sorted(map(tuple, entities.mentions(docs, terms, common=common).collect())) == want


def test_verbs_meet_mentions_and_not_pairs(spark):
    """Two verbs at most stand beside a mention, however many its sentence has; pairs get the same predicates as from a table of pairs."""
    words = " ".join(f"drug the illness and that{' the' * i}" for i in range(6))
    c = spark.createDataFrame([(1, words + ". Illness and drug.")], "chunk_id int, text string")
    found = entities.mentions(c, spark.createDataFrame([("drug",), ("illness",)], "entity string"))
    verbs, said = spark.createDataFrame([("the",), ("and",), ("that",)], "word string"), entities.sentence_words(c)
    assert max(len(r["verbs_"]) for r in entities.next_verbs(found, said, verbs).collect()) == 2
    keys = ["sentence", "subject_ord", "object_ord", "predicate"]
    got = sorted(map(tuple, entities.verb_relations(found, said, verbs).select(keys).collect()))
    assert got == sorted(map(tuple, entities.verb_predicates(entities.relations(found), said, verbs).select(keys).collect()))
    spoken = {(r.sentence, r.ordinal): r.word for r in said.collect()}
    for s, i, j, predicate in got:
        between = [spoken[s, k] for k in range(i + 1, j) if spoken[s, k] in ("the", "and", "that")]
        assert predicate == ("_".join(between[:2]) or "related_to")


def test_gold_by_label_is_no_table_of_pairs(spark):
    """Marked lists against the same gold as pairs; a question without a list, one with a null label and one whose label is alone."""
    labels = {0: 1, 1: 1, 2: 1, 3: 2, 4: None, 5: 1, 6: 3}
    got = [(0, 1, 1), (0, 3, 2), (5, 2, 1), (4, 1, 1), (6, 0, 1)]
    lists = spark.createDataFrame(got, "qid int, id int, rank int")
    pairs = spark.createDataFrame([(q, i) for q in (0, 1, 4, 5, 6) for i, x in labels.items() if i != q and x is not None and x == labels[q]], "qid int, id int")
    n = spark.createDataFrame([(q, sum(x == labels[q] for x in labels.values()) - 1) for q in (0, 1, 5, 6)], "qid int, n_gold long")
    marked = spark.createDataFrame([(q, i, r, labels[q] is not None and labels[q] == labels[i]) for q, i, r in got], "qid int, id int, rank int, hit boolean").join(n, "qid", "left")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ranking.context_marked(marked, n)) == rows(ranking.context(lists, pairs))
    assert rows(ranking.evaluate_marked(marked)) == rows(ranking.evaluate(lists, pairs))


def test_questions_with_enough_are_not_walked(spark):
    """Edges are asked for only around the seeds of questions that need them, and a node gives its first chunks only."""
    found = spark.createDataFrame([(i, "wide") for i in range(50)] + [(90, "rare"), (91, "next")], "chunk_id int, entity string")
    e = spark.createDataFrame([("rare", "p", "next"), ("wide", "p", "next")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([(1, "wide"), (2, "rare")], "qid int, seed string")
    asked = []

    def around(of, reach):
        asked.append((reach, {r.seed for r in of.collect()}))
        return e

    got = {(r.qid, r.id, r.hop) for r in graph.retrieve(around, found, seeds, 3, hub=100).collect()}
    assert got == {(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 90, 0), (2, 91, 1), (2, 0, 2)}
    assert asked == [(1, {"rare"}), (2, {"rare"})]


def test_encoder_counts_letters(spark, sf):
    """The same vectors as by a fold over all slots for each term, without one."""
    def folded(text, dim):
        start = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda _: F.lit(0.0))
        count = lambda acc, h: F.transform(acc, lambda v, i: F.when(i == F.pmod(h, F.lit(dim)), v + F.when(h.bitwiseAND(F.lit(1 << 40)) == 0, 1.0).otherwise(-1.0)).otherwise(v))
        return unit(F.aggregate(F.transform(terms(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t)), start, count))

    docs = _docs(spark, sf).where("chunk_id % 10 = 0").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a A a b-c")], "chunk_id long, text string"))
    for dim in (16, 64):
        made = HashEncoder(dim).documents(F.col("text"))
        assert docs.select(made.alias("a"), folded(F.col("text"), dim).alias("b")).where("a <> b").count() == 0


def test_an_engine_that_is_not_saved_makes_no_edge_table(spark, sf, monkeypatch):
    """Walks read the links around their seeds, and find what they find in the whole table of edges."""
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", "source", F.lit(1).alias("page"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    whole, made = graph.edges, []
    monkeypatch.setattr(graph, "edges", lambda rels: made.append(1) or whole(rels))
    engine = Engine(chunks).index()
    seeds = engine.seeds(asked)
    found = lambda: (sorted(map(tuple, engine.walked(seeds, 20).collect())), sorted(map(tuple, graph.expand(engine.linked(), seeds, ["related_to"]).collect())))
    by_links = found()
    assert not made and by_links[0] and by_links[1]
    assert engine.edges is engine.linked() and made == [1]
    assert found() == by_links


def test_pairs_are_shuffled_once(spark, sf):
    """The same links and degrees as from the table of edges, with one shuffle of mentions, one of pairs, and for degrees one of nodes."""
    found = entities.own_mentions(_docs(spark, sf))
    extra = spark.createDataFrame([(-1, 0, i, 0, 9, w, w) for i, w in enumerate("b a b c a".split())], found.schema)
    found = storage.settle(found.union(extra))
    edges = storage.settle(graph.edges(entities.relations(found)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    linked = entities.linked(found)
    assert rows(linked.select("subject", "object")) == rows(edges.select("subject", "object").distinct())
    degrees = graph.pair_degrees(entities.paired(found))
    assert rows(degrees) == rows(graph.degrees(edges))
    for df, most in ((linked, 2), (degrees, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chunk_id" in plan and len(set(re.findall(r"hashpartitioning\(([a-z_]+)#", plan))) == most and not re.search(r"hashpartitioning\(chunk_id#\d+L?, sentence#\d+, entity", plan)


def test_pairs_are_made_where_sentences_are(spark, sf, monkeypatch):
    """Mentions and pairs without a shuffle of words or mentions, whatever the number of terms, as from a join with the gazetteer and of mentions with each other; also where other words
    share the hash of a term, few or many."""
    docs = _docs(spark, sf).where("chunk_id % 4 = 0").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Zebrafish met zebrafish, ÄPFELCHEN und Äpfelchen! Zebrafish"), (-4, "zebrafish äpfelchen")], "chunk_id long, text string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = storage.settle(entities.mentions(docs, entities.gazetteer(docs)))
    want, pairs = rows(found), rows(entities.relations(found))
    monkeypatch.setattr(entities, "FEW", 0)
    assert rows(entities.own_mentions(docs)) == want
    made = entities.sentence_relations(entities.own_sentences(docs))
    assert rows(made) == pairs and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for buckets, most in ((1 << 20, 1_000), (1 << 20, 0), (64, 1_000)):
        monkeypatch.setattr(entities, "hashed", lambda w, n=buckets: F.pmod(F.xxhash64(w), F.lit(n)))
        monkeypatch.setattr(entities, "ALIKE", most)
        assert rows(entities.own_mentions(docs)) == want
    monkeypatch.setattr(entities, "MANY", 0)
    assert rows(entities.sentence_relations(entities.own_sentences(docs))) == pairs


def test_walks_look_at_sentences_where_they_are(spark, monkeypatch):
    """What is around seeds is found without a shuffle of mentions, and gives the links that mentions in rows give; where names share hashes, no link of these is lost and none is made up."""
    texts = ["alphabet bequests alphabet. Bequests, cellular", "cellular dolphins. Dolphins", "dolphins elephant! Elephant furlongs", "furlongs alphabet"]
    held = storage.settle(entities.own_sentences(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")))
    found, seeds = entities.spread(held), spark.createDataFrame([(1, "bequests"), (2, "nowhere")], "qid int, seed string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    everything = rows(entities.linked(found))
    assert everything and rows(entities.sentences_linked(held)) == everything
    for hops in (1, 2):
        part = entities.sentences_around(held, seeds, hops)
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
        assert rows(entities.spread(part)) == rows(entities.around(found, seeds, hops))
    near = set(rows(entities.linked(entities.around(found, seeds, 1))))
    monkeypatch.setattr(entities, "hashed", lambda w: F.pmod(F.xxhash64(w), F.lit(2)))
    assert near <= set(rows(entities.sentences_linked(entities.sentences_around(held, seeds, 1)))) <= set(everything)


def test_stored_graph_is_shuffled_once(spark, sf, monkeypatch):
    """Nodes and edges as from mentions in rows, each with one shuffle; also where a chunk's pairs are made in many parts, and a chunk is there twice."""
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Zebrafish met zebrafish, ÄPFELCHEN und Äpfelchen! Zebrafish"), (-4, "zebrafish äpfelchen"), (-5, "Gryphons zebrafish"), (-5, "gryphons, zebrafish")], "chunk_id long, text string")
    held = storage.settle(entities.own_sentences(_docs(spark, sf).where("chunk_id % 4 = 0").union(odd)))
    found = storage.settle(entities.spread(held))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    nodes, edges = rows(graph.nodes(found)), rows(graph.edges(entities.sentence_relations(held)))
    for most in (1_000_000, 7):
        monkeypatch.setattr(entities, "PAIRS", most)
        for df, want in ((graph.own_nodes(found), nodes), (graph.own_edges(held), edges)):
            assert rows(df) == want and df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert entities.chunk_pairs(held).groupBy("chunk_id", "subject", "object").count().where("count > 2").isEmpty()


def test_postings_are_gathered_before_they_are_shuffled(spark, sf, monkeypatch):
    """A term is shuffled once for the documents that are gathered, not with each of them, and what is packed is the same however many are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(2)
    ix = bm25.index(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(ix.postings.select("doc_id", "term", "dl", "tf"))
    for most in (1_000_000, 3_000):
        monkeypatch.setattr(bm25, "GATHER", most)
        packed = bm25.pack(ix)
        assert rows(bm25.unpacked(packed)) == want and "MapInArrow" in packed._jdf.queryExecution().executedPlan().toString()
    assert bm25.gathered(ix.postings.withColumn("block", F.lit(0))).count() < 0.8 * len(want)


def test_scores_of_a_task_are_bounded(spark, monkeypatch):
    """Documents are dealt to more tasks when more questions may score them, and the best are the same."""
    docs = spark.createDataFrame([(i, f"common word{i % 7} other{i % 3}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(20)], "qid long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    ix = bm25.index(docs)
    want = rows(bm25.search(ix, asked, 5))
    monkeypatch.setattr(bm25, "SCORES", 100)
    found = bm25.search(ix, asked, 5)
    assert rows(found) == want and re.search(r"hashpartitioning\(doc_id#\d+L?, 12\)", found._jdf.queryExecution().executedPlan().toString())


def test_texts_are_read_after_the_cut(spark, sf, monkeypatch):
    """Only candidates' texts leave their place, and only those that are left after the cut meet their questions; what is found is what a cut after all texts gives, an empty text and one without a row too."""
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise("").alias("text"), "source", F.lit(1).alias("page"))
    signals = spark.range(3).select(F.col("id").alias("qid")).join(spark.range(1, 60).where("id < 50 OR id > 55"), F.lit(True)).union(spark.createDataFrame([(1, -7)])).select("qid", "id", F.lit("bm25").alias("signal"), (10.0 - F.col("id") / 7).alias("raw"))
    monkeypatch.setattr(Engine, "signals", lambda self, questions: signals)
    seen, cut = [], fusion.near_tie_cutoff
    monkeypatch.setattr(fusion, "near_tie_cutoff", lambda ranked, *a: seen.append(ranked.columns) or cut(ranked, *a))
    got = Engine(chunks).retrieve(signals, 10)
    all_ = fusion.weighted(signals, fusion.weights(), chunks.withColumnRenamed("chunk_id", "id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cut(all_, "fused", 10).collect())) and got.columns == cut(all_, "fused", 10).columns
    assert "text" not in seen[0] and got.where("id % 5 = 0").isEmpty() and got.where("id = -7").first().text == "Content for chunk -7"


def test_wide_rows_are_stored_in_small_groups(spark, tmp_path):
    """A task that reads a stored table holds a bounded part of it, however wide its rows."""
    import pyarrow.parquet as pq

    wide = spark.range(0, 4_000, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda i: F.rand(7)).alias("v"))
    at = storage.settle(wide).inputFiles()[0]
    file = pq.ParquetFile(at.removeprefix("file://").removeprefix("file:"))
    assert file.num_row_groups > 2 and max(file.metadata.row_group(i).total_byte_size for i in range(file.num_row_groups)) < 2 * storage.ROW_GROUP
