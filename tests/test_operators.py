from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.errors import EvaluationError, GroundingError, LoadError, RetrievalError
from lodeflow.operators import bm25, entities, fusion, graph, grounding, ranking, rerank, vectors
from lodeflow.operators import statistics as st
from lodeflow.plans import evaluation, knowledge
from lodeflow.sources import files
from lodeflow.streaming import ingest


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_bm25(spark):
    docs = frame(spark, "doc_id int, text string", [(1, "trastuzumab treats HER2 breast cancer"), (2, "breast imaging guidelines"), (3, "renal function tests"), (4, None), (5, "cardiac rhythm")])
    q = frame(spark, "qid int, query string", [(1, "trastuzumab breast cancer HER2"), (2, "quantum computing blockchain")])
    got = bm25.search(bm25.index(docs), q, 3).orderBy("qid", "rank").collect()
    assert got[0].doc_id == 1 and {r.qid for r in got} == {1}


def test_fusion(spark):
    s = frame(spark, "qid int, id string, signal string, raw double", [(1, "a", "dense", 1.0), (1, "b", "dense", 3.0), (1, "c", "dense", 5.0), (1, "a", "bm25", 2.0), (1, "b", "bm25", 2.0), (2, "z", "bm25", 0.0)])
    norm = {(r.qid, r.id, r.signal): r.norm for r in fusion.min_max(s).collect()}
    assert norm[1, "a", "dense"] == 0 and norm[1, "b", "dense"] == 0.5 and norm[1, "c", "dense"] == 1 and norm[1, "a", "bm25"] == 1 and norm[2, "z", "bm25"] == 0
    fused = {(r.qid, r.id): r.fused for r in fusion.weighted(s, fusion.weights(0.5, 0.5, 0.0)).collect()}
    assert fused[1, "b"] == 0.75 and fused[1, "c"] == 0.5 and fused[2, "z"] == 0
    for bad in ({"alpha": 1.5}, {"dense": -1.0}):
        with pytest.raises(RetrievalError):
            fusion.weights(**bad)


def test_cutoffs(spark):
    r = frame(spark, "qid int, id int, s double", [(1, i, v) for i, v in enumerate((1.0, 0.9, 0.8, 0.79, 0.785, 0.5, 0.49))])
    assert fusion.near_tie_cutoff(r, "s", 3).count() == 5
    assert fusion.elbow_cutoff(r, "s", 2, 7).count() == 5


def test_rerank(spark):
    c = frame(spark, "qid int, id int, place int, text string", [(1, 1, 1, "a b c d"), (1, 2, 2, "a b c d e"), (1, 3, 3, "x y z"), (1, 4, 4, ""), (2, 5, 1, "a b c d")])
    assert {(r.qid, r.id) for r in rerank.suppress_duplicates(c).collect()} == {(1, 1), (1, 3), (1, 4), (2, 5)}


def test_graph(spark):
    rels = frame(spark, "subject string, predicate string, object string, confidence double, chunk_id int", [("Tras  tuzumab", "treats", "Cancer", 0.5, 1), ("tras tuzumab", "treats", "cancer", 0.9, 2), ("x", "p", "X", 1.0, 1), ("cancer", "p", "leaf", 1.0, 3)])
    e = graph.edges(rels)
    got = {(r.subject, r.object): (r.weight, r.confidence) for r in e.collect()}
    assert got == {("tras tuzumab", "cancer"): (2, 0.9), ("cancer", "leaf"): (1, 1.0)}
    seeds = frame(spark, "qid int, seed string", [(1, "tras tuzumab"), (2, "unknown")])
    assert {(r.qid, r.node, r.hop) for r in graph.neighbourhood(e, seeds, 2).collect()} == {(1, "cancer", 1), (1, "leaf", 2)}
    assert {r.node for r in graph.walk(e, seeds.where("qid = 1"), 2, hub=1).collect()} == {"tras tuzumab", "cancer"}


def test_adaptive_retrieval_takes_every_entity(spark):
    """The registered query against a walk of each mention, one after the other, as published."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    found = entities.mentions(docs, entities.gazetteer(docs))
    chunks, near, said = {}, {}, {}
    for m in found.orderBy("chunk_id", "sentence", "ordinal").collect():
        chunks.setdefault(m.entity, set()).add(m.chunk_id)
        said.setdefault(m.chunk_id, []).append(m.entity)
    links = {(e.subject, e.object) for e in graph.edges(entities.relations(found)).collect()}
    for a, b in links:
        near.setdefault(a, []).append((a, b))
        near.setdefault(b, []).append((a, b))

    def walk(seed, hops):
        at, front = {}, {seed}
        for h in range(1, hops + 1):
            front = {x for n in front if len(near.get(n, ())) <= 100 for link in near.get(n, ()) for x in link} - {seed, *at}
            at |= dict.fromkeys(front, h)
        return at

    want = {}
    for q, seeds in said.items():
        scores = {}
        for seed in seeds:
            scores |= dict.fromkeys(chunks[seed], 0)
            at = walk(seed, 1)
            if sum(c not in scores for n in at for c in chunks[n]) < 5:
                at = walk(seed, 2)
            for n, h in at.items():
                for c in chunks[n]:
                    scores[c] = min(h, scores.get(c, h))
        top = sorted(scores.items(), key=lambda x: (x[1], x[0]))[:10]
        want |= {(q, c): (h, place + 1) for place, (c, h) in enumerate(top)}
    assert max(len(set(x)) for x in said.values()) > 2
    got = {(r.qid, r.id): (r.hop, r["rank"]) for r in knowledge.graph_retrieve_adaptive(spark, sf).collect()}
    assert got == want


def test_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)] + [(60, None, 0), (61, [1.0, None, 0.0, 0.0], 0)]
    c = frame(spark, "vec_id long, embedding array<double>, label int", rows)
    got = {(r.qid, r["rank"]): r.id for r in vectors.nearest(c, c.where("vec_id < 5"), 2).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for q in range(5):
        best = sorted(((-round(cos(rows[q][1], v), 6), i) for i, v, _ in rows[:60] if i != q))[:2]
        assert [got[q, 1], got[q, 2]] == [i for _, i in best]


def test_ranking(spark):
    got = ranking.evaluate(frame(spark, "qid int, id string, rank int", [(1, x, i) for i, x in enumerate("abcde", 1)]), frame(spark, "qid int, id string", [(1, "b"), (1, "d")])).first()
    assert (got.precision, got.recall, got.mrr) == (0.4, 1.0, 0.5) and 0.6 < got.ndcg < 0.7


def test_grounding(spark):
    a = frame(spark, "aid int, answer string", [(1, "Alpha beta gamma [P1]. Nothing like it here [P9]."), (2, "")])
    e = frame(spark, "aid int, idx int, passage string", [(1, 1, "alpha beta gamma p1"), (1, 2, "delta")])
    got = {r.aid: r for r in grounding.check_citations(a, e).collect()}
    assert got[1].n_citations == 2 and got[1].n_valid == 1 and not got[1].well_grounded and got[2].uncited_ratio == 1.0
    with pytest.raises(GroundingError):
        grounding.ground_sentences(a, e, lexical=0.9)


def test_statistics(spark):
    p = frame(spark, "g int, k int, p double", [(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03)])
    assert [round(r.adjusted, 10) for r in st.holm(p, ["g"]).orderBy("k").collect()] == [0.03, 0.06, 0.06]
    base = frame(spark, "id int, value string", [(1, "0.5"), (2, "0.7"), (3, "1")])
    other = frame(spark, "id int, value string", [(3, "0.1"), (1, "N/A"), (2, "0.2"), (9, "1")])
    assert {(r.id, r.base, r.other) for r in st.align(base, other).collect()} == {(2, 0.7, 0.2), (3, 1.0, 0.1)}
    with pytest.raises(EvaluationError):
        st.align(base.union(base), other)
    d, rel = st.percentage_change(F.lit(0.3913), F.lit(0.0967))
    got = spark.range(1).select(d.alias("d"), rel.alias("r")).first()
    assert round(got.d, 4) == -0.2946 and round(got.r, 2) == -75.29


def test_bootstrap(spark):
    got = st.bootstrap(frame(spark, "g int, value double", [(1, v) for v in (0.85, 0.88, 0.9, 0.92, 0.95, 0.91)]), ["g"]).first()
    assert 0.85 <= got.lower < got.upper <= 0.95


def test_bootstrap_in_blocks(spark, monkeypatch):
    """Draws that no task makes alone spread as those of a whole group do; a group without values is 0."""
    monkeypatch.setattr(st, "BLOCK", 40)
    rng = np.random.default_rng(2)
    x = rng.exponential(size=500).round(2)
    rows = [(1, float(v)) for v in x] + [(None, 2.0)] * 30 + [(3, None)]
    got = {r.g: (r.lower, r.upper) for r in st.bootstrap(frame(spark, "g int, value double", rows), ["g"]).collect()}
    want = np.percentile(rng.choice(x, (20_000, len(x))).mean(1), [2.5, 97.5])
    assert got[1] == pytest.approx(want, abs=0.3 * x.std() / len(x) ** 0.5)
    assert got[None] == pytest.approx((2.0, 2.0)) and got[3] == (0.0, 0.0)


def test_bootstrap_query_takes_the_default_resamples(spark, sf):
    d = evaluation.samples(spark, sf)
    want = {(r.lang, r.lower, r.upper) for r in st.bootstrap(d, ["lang"], "base", times=1000).collect()}
    assert {(r.lang, r.lower, r.upper) for r in evaluation.bootstrap_ci(spark, sf).collect()} == want


def test_kappa(spark):
    same = frame(spark, "a double, b double", [(0.1, 0.1), (0.5, 0.5), (1.0, 1.0)])
    assert st.kappa(same, "a", "b").first().kappa == 1.0
    assert st.kappa(frame(spark, "a double, b double", [(0.1, 0.1)]), "a", "b").first().kappa == 1.0
    assert st.kappa(same.limit(0), "a", "b").first().kappa == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"A page that is long enough to stay|short|Another page that is long enough")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    got = files.read_documents(spark, str(tmp_path), lambda x: x.decode().split("|")).orderBy("page_number").collect()
    assert [(r.source_file, r.page_number) for r in got] == [("b.pdf", 1), ("b.pdf", 3)]
    with pytest.raises(LoadError):
        files.read_documents(spark, str(tmp_path), str, "*.none")
    store, new = frame(spark, "id int, seq int, v string", [(1, 1, "a"), (2, 1, "b")]), frame(spark, "id int, seq int, v string", [(2, 2, "c"), (2, 3, "d"), (3, 1, "e")])
    twice = files.upsert(files.upsert(store, new, "id", "seq"), new, "id", "seq")
    assert {(r.id, r.v) for r in twice.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    files.write_jsonl(store, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id int, seq int, v string").count() == 2


def test_ingest_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = frame(spark, "id int, text string", [(i, f"t{i}") for i in range(10)])
    run = lambda: ingest.ingest(spark, src, rows.schema, out, cp, lambda df: df.withColumn("n", F.length("text")), "id").awaitTermination()
    rows.where("id < 6").write.mode("append").parquet(src)
    run()
    rows.where("id >= 4").write.mode("append").parquet(src)
    run()
    got = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(10))


def test_running_total(spark):
    """Ties, nulls first, ranges of all sizes; an empty table has no rows."""
    from lodeflow.operators.ordering import running_total

    rows = [(i, (i * 7) % 13 if i % 11 else None, i % 5) for i in range(300)]
    df = frame(spark, "i int, k int, n int", rows).repartition(7)
    got = {r.i: r.upto for r in running_total(df, ["k", "i"], F.col("n"), "upto").collect()}
    at, want = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        want[i], at = at, at + n
    assert got == want and running_total(df.limit(0), ["k"], F.col("n"), "upto").count() == 0


def test_log_ids_are_not_cut(spark):
    from lodeflow.sources import files

    got = files.numbered(spark.range(1_002), "id").orderBy("id").collect()
    assert (got[0].log_id, got[998].log_id, got[999].log_id, got[1_001].log_id) == ("Q001", "Q999", "Q1000", "Q1002")
