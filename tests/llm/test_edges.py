"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

from __future__ import annotations

import pytest

from lodeflow.llm import bpe, embeddings, fingerprints, minhash, mixing, quality, records, suffixes, toxicity, urls
from tests.llm.helpers import near, unrepeated

LONG = " ".join(f"word{i % 997}x{i}" for i in range(150_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, kept string, fingerprint string, spans string, decoded string, copies int"
LABELS = "doc_id long, quality int, toxic int"
X = (1.0, "x", "k", "f", "s", "d", 1)


@pytest.fixture(scope="module")
def docs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", "a", 10, *X), (1, base, "en", "a", 10, *X), (1, base + " more", "en", "a", 10, *X), (2, base, None, None, None, *X), (3, None, "en", "b", None, *X), (4, "", "en", "b", 0, *X),
        (5, " \t\n ", "en", "c", 3, *X), (6, LONG, "en", "c", 9, *X), (7, "Ünï <|endoftext|> cødé \U0001f600", "xx", "é", 3, *X), (8, "a", "en", "a", 1, *X), (None, "null id", "en", "a", 1, *X), (None, None, None, None, None, *[None] * 7), (9, "z" * 700, "en", "b", 700, *X),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (3, 0, 0), (None, 1, 1), (9, 0, 1), (6, 1, 0)], LABELS)


def empty(df):
    return df.limit(0)


def test_minhash(spark, docs):
    own = [(i, t) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if i not in (None, 1)]
    want = near([(1, "one two three four five six seven eight nine ten eleven twelve more"), *own], 3, 85)
    got = minhash.near_duplicates(docs, words=3, percent=85).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.doc_id == 2:
            assert r.component_id == 1 and not r.kept
        elif r.doc_id != 1:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_suffixes(docs):
    got = sorted(suffixes.without_repeats(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed))
    assert len(got) == docs.count() and got[0].score is None and "lang" in got[0].asDict()
    nine = next(r for r in got if r.doc_id == 9)
    assert (nine.n_bytes, nine.n_removed, [tuple(s) for s in nine.spans]) == (700, 699, [(1, 700)])
    assert [r.n_removed for r in got if r.doc_id == 6] == [0]
    assert suffixes.without_repeats(empty(docs)).count() == 0


def test_quality_and_toxicity(docs, labels):
    for m, label in ((quality, "quality"), (toxicity, "toxic")):
        for train in ((docs, labels), (docs, empty(labels)), (empty(docs), labels)):
            model = m.train(*train, label)
            got = m.score(docs, model).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
            if train[1].isEmpty():
                assert all(r.score == 0.5 for r in got)
        assert m.score(empty(docs), model).count() == 0


def test_fingerprints(docs):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == docs.count() and len({r.fingerprint for r in got if r.doc_id == 2} | {r.fingerprint for r in got if r.text and r.text.endswith("twelve")}) == 1
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4, 5)}) == 1
    groups = {(r.doc_id, r.group_id) for r in fingerprints.exact_groups(docs).collect()}
    assert (2, 1) in groups and (8, 8) in groups
    pairs = fingerprints.against_next(docs).collect()
    assert len(pairs) == docs.count() and all(r.near_next in (0.0, 1.0) for r in pairs)
    assert fingerprints.against_next(empty(docs)).count() == 0 and fingerprints.exact_groups(empty(docs)).count() == 0


def test_bpe_and_records(spark, docs, tmp_path):
    got = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert len(got) == docs.count() and all(r.decoded == (r.text or "") for r in got)
    assert bpe.encode_texts(empty(docs)).count() == 0
    records.write_records(docs, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r")).orderBy("start").collect()
    assert len(back) == docs.count() and [r.doc_id for r in back[:2]] == [None, None]
    assert [r.start for r in back] == [sum(x.n_tokens for x in back[:i]) for i in range(len(back))]
    records.write_records(empty(docs), str(tmp_path / "e"))
    assert records.read_records(spark, str(tmp_path / "e")).count() == 0


def test_mixing(docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mixture(docs).columns == docs.columns
    assert mixing.mixed(empty(docs)).count() == 0 and mixing.mixture(empty(docs)).count() == 0


def test_embeddings(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [
        (1, v(1, 0), 1, 0), (2, v(2, 0), 1, 0), (3, v(1, 0.01), 1, 0), (4, v(1, 0), 2, 0), (5, v(1, 0), None, 0), (6, v(0, 0), 1, 0), (7, None, 1, 0), (8, [1.0, None], 1, 0), (9, v(float("nan"), 1), 1, 0),
        (10, v(1, 0, 0), 1, 0), (3, v(0, 1), 1, 0), (None, v(1, 0), 1, 0), (11, v(float("inf"), 1), 1, 0), (12, [], 1, 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=repr)
    assert (1, 3, 1, True) in got and (2, 3, 1, False) in got and (3, 3, 1, False) in got and (3, 0, 3, True) in got and (None, 3, 1, False) in got
    assert all((i, 0, i, True) in got for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert embeddings.near_duplicates(empty(df)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.ORG/x", "h"), (2, None, "h"), (3, "no url", "h"), (4, "://", "h"), (5, "http://org?x=/", "h"), (6, "http://x.com/fr/a#b", "h"), (6, "http://x.com/fr/a#b", "h"), (7, "http://evil.example.org/en/1?2", "h"), (8, "http://...", "h"), (None, "http://com/de/", None)]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a.org", "/x", "org/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "org", "", None, "allow"), (6, "x.com", "/fr/a", "com/fr/", "allow"), (6, "x.com", "/fr/a", "com/fr/", "allow"),
        (7, "evil.example.org", "/en/1", "example.org/en/1", "block"), (8, "...", "", None, "allow"), (None, "com", "/de/", "com/de/", "block"),
    ], key=repr)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_repeats_in_order_of_equal_ids(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    df = spark.createDataFrame([(1, text[:200]), (1, text[:200]), (2, text[100:]), (3, text[:50] + text[150:300])], "doc_id long, text string")
    got = [(r.n_bytes, r.n_removed, len(r.spans)) for r in suffixes.without_repeats(df).orderBy("doc_id", "n_removed").collect()]
    want = unrepeated([text[:200], text[:200], text[100:], text[:50] + text[150:300]], 100)
    assert got == [w[:3] for w in want]


def test_whole_chars(spark):
    text = "é" * 3 + "".join(chr(0x100 + (i * 7 + i * i // 5) % 600) for i in range(120))
    df = spark.createDataFrame([(1, text), (2, "a" + text[1:]), (3, "bb" + text[7:90] + "c")], "doc_id long, text string")
    for r in suffixes.without_repeats(df, whole_chars=True).collect():
        r.kept.decode()
