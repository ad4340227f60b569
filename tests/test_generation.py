"""Model calls that fail, claims and their retry, JSON prompts, explanations, fused retrieval, headings by size of type."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeflow.errors import GenerationError, RetrievalError
from lodeflow.facade import Engine
from lodeflow.models import expansions
from lodeflow.operators import answers, calls, chunks as chunking, claims, entities, fusion, grounding
from tests.test_facade import chunks  # noqa: F401  a fixture


def test_calls(spark, tmp_path):
    rows = [(i, p) for i, p in enumerate(["a", "bad one", "c", None, "silent", "f"])]
    df = spark.createDataFrame(rows, "k int, prompt string").coalesce(1)

    def flaky(prompts):  # fails for a batch with "bad" in it, whatever else it holds
        if any("bad" in p for p in prompts):
            raise TimeoutError("slow")
        return [None if "silent" in p else p.upper() for p in prompts]

    got = {r.k: (r.reply, r.error) for r in calls.called(df, flaky, attempts=2, wait=0, batch=3).collect()}
    assert got == {0: ("A", None), 1: (None, "TimeoutError: slow"), 2: ("C", None), 3: (None, "no prompt"), 4: (None, "no reply"), 5: ("F", None)}
    count = tmp_path / "n"

    def late(prompts):  # the third attempt is the first that succeeds
        with count.open("a") as f:
            f.write("x")
        if len(count.read_text()) < 3:
            raise ConnectionError("not yet")
        return prompts

    assert calls.called(df.where("k = 0"), late, wait=0).first().reply == "a" and count.read_text() == "xxx"
    short = calls.called(df.where("k = 0"), lambda p: [], attempts=1, wait=0).first()
    assert short.reply is None and "0 replies to 1" in short.error
    assert calls.called(df.limit(0), flaky).count() == 0
    with pytest.raises(GenerationError):
        calls.called(df, flaky, attempts=0)


def test_expansion(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two bad"), (3, "three")], "qid long, query string")

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise OSError("gone")
        return ["['x']" if "three" in p else 'As asked: [" w1 ", "", "w2", "w3"] done' if p.startswith("Give") else " told " for p in prompts]

    got = sorted((r.qid, r.ordinal, r.variant) for r in expansions(model, attempts=1, wait=0)(q).collect())
    assert got == [(1, 1, "w1"), (1, 2, "w2"), (1, 100, "told"), (3, 100, "['x']")]


def test_compressor(spark):
    ranked = spark.createDataFrame([(1, 1, 7, "a"), (1, 2, 8, None), (2, 1, 7, "bad"), (3, 1, 9, "none"), (4, 1, 9, "x"), (5, 3, 9, "no question")], "qid long, rank int, id long, text string")
    q = spark.createDataFrame([(i, f"q{i}") for i in (1, 2, 3, 4, 6)], "qid long, query string")

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise OSError("gone")
        return [" " if "q4" in p else f"Sorry. {calls.NOTHING}." if "q3" in p else " Facts. " for p in prompts]

    got = sorted(map(tuple, calls.compressed(q, ranked, model, attempts=1, wait=0).collect()))
    assert got == [(1, 1, "compressed_01", "Facts."), (2, 1, "7", "bad"), (3, 1, "9", "none"), (4, 1, "9", "x"), (5, 1, "9", "no question")]


PAYLOAD = {"claims": [{"text": " one two ", "evidence_ids": ["E1"], "confidence": "high"}, {"text": "three"}], "unanswerable_aspects": ["dose"]}


def test_parsing(spark):
    good = json.dumps(PAYLOAD)
    replies = [good, f"Well:\n```json\n{good}\n```\nSo.", f"Sure {good} there", "{\"claims\": [", None, "", "[1, 2]", "{}", '{"claims": null}', '{"claims": "none"}', "{'claims': []}"]
    got = {r.aid: r for r in claims.parsed(spark.createDataFrame(list(enumerate(replies)), "aid int, reply string")).collect()}
    for i in range(3):
        assert [(c.ordinal, c.text, c.evidence_ids, c.confidence) for c in got[i].claims] == [(0, "one two", ["E1"], "high"), (1, "three", [], "low")] and got[i].unanswerable == ["dose"] and not got[i].parse_failed
    assert all(got[i].parse_failed and not got[i].claims for i in (3, 4, 5, 6, 9, 10)) and not got[7].parse_failed and not got[8].claims


def test_retry_asks_only_what_fails(spark):
    """Turns are bounded; a worse answer, or one without claims, is not taken; a claim that says it is unsupported is not judged."""
    evidence = spark.createDataFrame([(i, "E1", "alpha beta gamma delta") for i in range(6)], "aid int, eid string, passage string")
    one = lambda text, ids=("E1",), sure="high": {"text": text, "evidence_ids": list(ids), "confidence": sure}
    says = {
        0: [[one("alpha beta")]], 1: [[one("zzz")], [one("zzz"), one("alpha")], [one("alpha")]], 2: [[one("zzz"), one("alpha")], [one("zzz")], [one("zzz"), one("alpha")]], 3: [[one("zzz")], [], []],
        4: [[one("alpha", ["E9"])], [one("alpha", [], "unsupported")]], 5: [[one("alpha")] * 5 + [one("zzz")]],
    }
    asked = []

    def ask(prompts):
        rows = [(r.aid, r.prompt) for r in prompts.collect()]
        turn = len(asked)
        asked.append({a for a, _ in rows})
        assert all(('- "' in p) == (turn > 0) for _, p in rows)
        return spark.createDataFrame([(a, json.dumps({"claims": says[a][min(turn, len(says[a]) - 1)]})) for a, _ in rows], "aid int, reply string")

    prompts = spark.createDataFrame([(i, "p") for i in range(6)], "aid int, prompt string")
    got = {r.aid: (r.n_claims, r.n_ungrounded, r.retried) for r in claims.answered(prompts, ask, evidence, turns=2).collect()}
    assert asked == [set(range(6)), {1, 2, 3, 4}, {1, 2, 3}]
    assert got == {0: (1, 0, 0), 1: (1, 0, 2), 2: (2, 1, 2), 3: (1, 1, 2), 4: (1, 0, 1), 5: (6, 1, 0)}
    asked.clear()
    assert claims.answered(prompts, ask, evidence, turns=0).count() == 6 and len(asked) == 1
    with pytest.raises(GenerationError):
        claims.answered(prompts, ask, evidence, turns=-1)


def test_json_prompts(spark):
    ranked = spark.createDataFrame([(1, 1, 11, "first passage"), (1, 2, 12, "second"), (1, 5, 13, None), (2, 1, 14, "x" * 500), (3, 1, 1, "y")], "qid long, rank int, id long, text string")
    q = spark.createDataFrame([(1, 'Say "why"?'), (2, "long"), (9, "none")], "qid long, question string")
    got = {r.qid: r for r in answers.citation_prompts(q, ranked, 36).collect()}
    assert set(got) == {1, 2} and got[1].ids == [11, 12] and got[2].ids == [14]
    assert got[1].user.endswith("Passages:\n[P1] first passage\n\n[P2] second")
    form = json.loads(got[1].system[got[1].system.rindex("\n") :])
    assert form == {"id": "1", "question": 'Say "why"?', "answer": "...", "sources": ["P1"]} and answers.REFUSAL in got[1].system
    whole = answers.citation_prompts(q, ranked)
    assert {r.qid: r.ids for r in whole.collect()}[1] == [11, 12, 13]
    replies = [(1, 'Here: {"answer": " Because. ", "sources": ["P2", "P2", "P9", "Q1", "P0"]}'), (2, json.dumps({"answer": answers.REFUSAL}))]
    read = {r.qid: r for r in answers.cited_sources(spark.createDataFrame(replies, "qid long, reply string"), whole).collect()}
    assert (read[1].answer, read[1].ids, read[1].unknown, read[1].refused) == ("Because.", [12], ["P9", "Q1", "P0"], False) and read[2].refused and read[2].ids == []
    broken = answers.cited_sources(spark.createDataFrame([(1, "no"), (2, None)], "qid long, reply string"), whole).collect()
    assert all(r.answer is None and not r.refused for r in broken)


def test_explanations(spark):
    a = spark.createDataFrame([(1, "Alpha beta gamma [P2]. Delta epsilon. Nothing of it [P9]."), (2, "No evidence.")], "aid int, answer string")
    e = spark.createDataFrame([(1, 1, "delta epsilon"), (1, 2, "alpha beta gamma")], "aid int, idx int, passage string")
    where = spark.createDataFrame([(1, 1, "c1", "book", 4), (1, 2, "c2", "book", 5)], "aid int, idx int, chunk_id string, source string, page int")
    got = {r.aid: r for r in grounding.explain_answers(grounding.ground_sentences(a, e), e, where).collect()}
    one = got[1]
    assert [(x.tag, x.chunk_id, x.page) for x in one.explanations] == [("P1", "c1", "4"), ("P2", "c2", "5")]
    assert one.explanations[1].sentences == ["Alpha beta gamma [P2]."] and "Nothing of it [P9]." in one.explanations[0].sentences and one.explanations[0].confidence == 1.0
    assert one.unsupported == ["Nothing of it [P9]."] and one.uncited == ["Delta epsilon.", "Nothing of it [P9]."] and one.score == 1.0 and "Nothing" not in one.answer
    assert got[2].explanations == [] and got[2].score == 0.0 and got[2].unsupported == ["No evidence."]


def test_font_headings(spark):
    s = lambda *xs: [(float(a), b) for a, b in xs]
    rows = [
        ("d", 1, 0, s((20, "Big "), (20, "title "))), ("d", 1, 1, s((10, "body"))), ("d", 1, 2, s((10, "Chapter 4: small"))), ("d", 1, 3, s((12.5, "at the bound"))), ("d", 1, 4, s((12.6, "just above"))), ("d", 1, 5, s((30, "  "))), ("d", 1, 6, []),
        ("d", 1, 7, s((10, "2.1 Treatment of adults"))), ("d", 1, 8, s((10, "more"))), ("d", 2, 0, s((8, "a"), (9, "b"))), ("e", 1, 0, []),
    ]
    df = spark.createDataFrame(rows, "source_file string, page_number int, ordinal int, spans array<struct<size double, text string>>")
    sizes = sorted(x for f, p, _, spans in rows if (f, p) == ("d", 1) for x, _ in spans)
    assert sizes[len(sizes) // 2] == 10.0 or sizes[len(sizes) // 2] == 12.5
    got = {(r.ordinal, r.heading, r.level) for r in chunking.font_headings(df).collect()}
    bound = 1.25 * sizes[len(sizes) // 2]
    want = {(0, "Big title", "section"), (2, "Chapter 4: small", "chapter"), (7, "2.1 Treatment of adults", "section")} | {(o, t, "section") for o, x, t in ((3, 12.5, "at the bound"), (4, 12.6, "just above")) if x > bound}
    assert got == want


def test_gather(spark):
    rows = spark.createDataFrame([(1, 5, 1, 0.5), (1, 6, 2, 0.25)], "qid long, id long, rank int, score double")
    runs = rows.withColumn("score", F.when(F.col("id") == 6, F.raise_error(F.lit("while running")).cast("double")).otherwise(F.col("score")))
    lists, failed = fusion.gather({"a": lambda: rows, "b": lambda: rows.withColumn("variant", F.lit(1)), "planned": lambda: 1 / 0, "runs": lambda: runs})
    assert set(failed) == {"planned", "runs"} and lists.count() == 4
    best = {r.id: r for r in fusion.candidates(lists, cap=1).collect()}
    assert set(best) == {5} and best[5].retrievers == "a,b" and best[5].rrf == pytest.approx(2 / 61, abs=1e-6)
    assert fusion.gather({"planned": lambda: 1 / 0})[0] is None


def test_fused_engine(spark, chunks, monkeypatch):  # noqa: F811
    engine = Engine(chunks).index()
    q = spark.createDataFrame([(1, "Does trastuzumab treat breast cancer with HER2?"), (2, "cisplatin and renal function")], "qid long, query string")

    def model(prompts):
        return ['["kidney function under cisplatin"]' if "renal" in p else "none" for p in prompts]

    got = {r.qid: r for r in engine.query(q, 2, fused=True, expand=expansions(model, passage=False, wait=0)).collect()}
    assert engine.failed == {} and got[1].sources.split(",")[0] == "1" and got[2].sources.split(",")[0] in ("2", "4")
    monkeypatch.setattr(Engine, "dense", lambda *_: 1 / 0)
    again = {r.qid: r for r in engine.query(q, 2, fused=True).collect()}
    assert set(engine.failed) == {"dense"} and again[1].sources.split(",")[0] == "1"
    monkeypatch.setattr(Engine, "words", lambda *_: 1 / 0)
    monkeypatch.setattr(Engine, "walked", lambda *_: 1 / 0)
    with pytest.raises(RetrievalError, match="dense"):
        engine.fused_retrieve(q)


def test_places_of_words(spark):
    """Sentences of one word to some thousands, by blocks, as one pass over the words has it."""
    rng = random.Random(4)
    lists = [[], ["one"], ["a", "bb"], *[[rng.choice(["x", "yy", "Ünï", "zzzz"]) for _ in range(n)] for n in (3, 4, 5, 16, 17, 3_000)]]
    df = spark.createDataFrame([(i, x or [""]) for i, x in enumerate(lists)], "i int, w array<string>")
    for r in df.select("w", entities.placed_words(F.col("w")).alias("p")).collect():
        at, want = 0, []
        for w in r.w:
            want.append((at, w))
            at += len(w) + 1
        assert [tuple(x) for x in r.p] == want


def test_linked_are_the_pairs_of_relations(spark):
    rng = random.Random(9)
    rows = [(c, s, o, o * 5, 90, w, w) for c in range(4) for s in range(3) for o, w in enumerate(rng.choices("abcde", k=rng.randint(0, 9)))]
    found = spark.createDataFrame(rows, "chunk_id int, sentence int, ordinal int, start int, length int, surface string, entity string")
    pairs = entities.relations(found).where("subject <> object").select("subject", "predicate", "object").distinct()
    assert sorted(map(tuple, entities.linked(found).collect())) == sorted(map(tuple, pairs.collect()))
