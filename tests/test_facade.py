from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodeflow.config import Settings, first_existing
from lodeflow.errors import IndexError_, LoadError, RetrievalError
from lodeflow.facade import Engine
from lodeflow.functions.cache import Cache
from lodeflow.models import HashEncoder, dot
from lodeflow.operators import entities
from lodeflow.sources import files, sinks


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "Trastuzumab treats early breast cancer when the tumour carries many HER2 receptors on its cells. It is given every third week for a year."),
        (2, "Cisplatin treats ovarian tumours and needs careful checks of renal function before every course of treatment, as it can harm the kidneys."),
        (3, "Radiation follows breast surgery in many patients, and lowers the risk that breast disease returns in the same place within ten years."),
        (4, "Renal function declines with age; cisplatin doses are lowered, or carboplatin is used instead, as guidelines for older patients suggest."),
    ]
    return spark.createDataFrame([(i, t, "book.pdf", i) for i, t in rows], "chunk_id long, text string, source string, page int")


def test_query(spark, chunks):
    names = spark.createDataFrame([("cisplatin",), ("breast",), ("trastuzumab",), ("renal",)], "entity string")
    from lodeflow.models import GazetteerExtractor

    engine = Engine(chunks, extractor=GazetteerExtractor(names)).index()
    q = spark.createDataFrame([(1, "Does trastuzumab treat breast cancer with HER2?"), (2, "cisplatin and renal function")], "qid long, query string")
    got = {r.qid: r for r in engine.query(q, 2).collect()}
    assert got[1].sources.split(",")[0] == "1" and got[2].sources.split(",")[0] in ("2", "4")
    assert all(r.answer.endswith("[P1]") and 0 <= r.faithfulness <= 1 for r in got.values())
    with pytest.raises(RetrievalError):
        engine.query(q, 21)
    with pytest.raises(IndexError_):
        Engine(chunks.limit(0)).index()


def test_encoder(spark):
    enc = HashEncoder(16)
    row = spark.range(1).select(enc.documents(F.lit("a b c")).alias("a"), enc.query(F.lit("c b a")).alias("b"), enc.documents(F.lit(None).cast("string")).alias("z")).select(dot(F.col("a"), F.col("b")).alias("same"), dot(F.col("z"), F.col("z")).alias("zero")).first()
    assert row.same == pytest.approx(1.0) and row.zero == 0.0


def test_verbs(spark):
    c = spark.createDataFrame([(1, "Drug treats and cures illness. Illness and drug.")], "chunk_id int, text string")
    found = entities.mentions(c, spark.createDataFrame([("drug",), ("illness",)], "entity string"))
    verbs = spark.createDataFrame([("treats",), ("cures",)], "word string")
    got = {(r.sentence, r.subject, r.object, r.predicate) for r in entities.verb_predicates(entities.relations(found), entities.sentence_words(c), verbs).collect()}
    assert got == {(0, "drug", "illness", "treats_cures"), (1, "illness", "drug", "related_to")}


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"pool": 7}))
    s = Settings.load(str(tmp_path / "s.json"), hub_degree=5)
    assert (s.pool, s.hub_degree, s.child_tokens) == (7, 5, 300)
    with pytest.raises(LoadError):
        Settings.load(nonsense=1)
    (tmp_path / "base.json").write_text(json.dumps({"pool": 3, "probes": 2}))
    (tmp_path / "own.json").write_text(json.dumps({"defaults": ["base.json"], "probes": 9}))
    s = Settings.load(str(tmp_path / "s.json"), str(tmp_path / "own.json"))
    assert (s.pool, s.probes) == (3, 9)
    for text in (json.dumps({"defaults": ["bad.json"]}), "{", None):
        (tmp_path / "bad.json").write_text(text) if text else (tmp_path / "bad.json").unlink()
        with pytest.raises(LoadError):
            Settings.load(str(tmp_path / "bad.json"))
    assert first_existing([str(tmp_path / "none"), str(tmp_path / "s.json")]).endswith("s.json")
    with pytest.raises(LoadError):
        first_existing([])


def test_cache():
    now = [0.0]
    c = Cache(2, 10, lambda: now[0])
    calls = []
    make = lambda q: calls.append(q) or q.upper()
    assert c.call("a", make) == "A" and c.call(" A ", make) == "A" and calls == ["a"]
    c.call("b", make)
    c.call("a", make)
    c.call("c", make)
    assert c.get("b") is None and c.get("a") == "A"
    now[0] = 11
    assert c.get("a") is None
    assert c.call("n", lambda q: None) is None and c.get("n") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.123456)], "name string, value double")
    sinks.write_report(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().value == "0.1235"
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert {r.log_id for r in files.numbered(spark.read.json(str(tmp_path / "log")), "logged_at").collect()} == {"Q001", "Q002"}
    sinks.log_run(spark, str(tmp_path / "runs"), "r1", {"k": 5}, {"p": 0.5})
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    sinks.logger("t", str(tmp_path / "logs")).info("hello")
    assert (tmp_path / "logs" / "t.log").exists()


def test_labels_and_backfill(spark):
    from lodeflow.operators import fusion, graph

    found = spark.createDataFrame([(1, 0, 0, "A", "a", None), (1, 0, 2, "a", "a", "DRUG"), (2, 0, 0, "a", "a", "GENE"), (3, 0, 0, "b", "b", None)], "chunk_id int, sentence int, ordinal int, surface string, entity string, label string")
    rels = spark.createDataFrame([("a", "c")], "subject string, object string")
    assert {r.node: (r.label, r.mention_count) for r in graph.nodes(found, rels).collect()} == {"a": ("DRUG", 3), "b": ("ENTITY", 1), "c": ("ENTITY", 0)}
    assert {r.label for r in graph.nodes(found.drop("label"), rels).collect()} == {"ENTITY"}
    edges = spark.createDataFrame([("a", "treats", "b"), ("a", "harms", "c")], "subject string, predicate string, object string")
    assert graph.of_predicates(edges, ["harms"]).collect()[0].object == "c" and graph.of_predicates(edges).count() == 2
    signals = spark.createDataFrame([(1, 7, "dense", 0.5), (1, 8, "dense", 0.25), (1, 9, "bm25", 1.0)], "qid long, id long, signal string, raw double")
    store = spark.createDataFrame([(7, "seven", "s.pdf"), (9, "", "e.pdf")], "id long, text string, source string")
    got = {r.id: (r.text, r.source) for r in fusion.weighted(signals, fusion.weights(), store).collect()}
    assert got == {7: ("seven", "s.pdf"), 8: ("Content for chunk 8", "document.pdf")}
