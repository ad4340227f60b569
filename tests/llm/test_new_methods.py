"""Operators 11 to 13 against the library, SQL and brute force, and their defined cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodeflow import llm
from lodeflow.llm import bpe, conversations, divergence, words
from tests.compare import rows

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op12_divergence", "op13_conversation_repair"])
def test_against_sql(spark, sf, duck, name):
    assert rows(llm.queries()[name](spark, sf).toPandas()) == rows(duck.sql(llm.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(words.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op11(spark, sf, library):
    got = {r.doc_id: r for r in llm.queries()["op11_distinct_words"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


ODD = ["", None, " ", "\n\n  x", "it's we'll I'M don't'd", "<|endoftext|> as text", "naïve Ünï cødé ſ µ", "日本語のテキスト ١٢٣ \U0001f600\U0001f1e9", "a b c\u0085d", "\x00\x01�‍", "x" * 5_000, "12 345,6", " lead", "trail  ", "é" * 300 + "日" * 300]


def test_op11_cases(spark, library, monkeypatch):
    """Blocks of few bytes, a table of few known words, null and repeated keys, and columns with clashing names."""
    monkeypatch.setattr(words, "BLOCK", 200)
    monkeypatch.setattr(words, "KNOWN", 5)
    monkeypatch.setattr(bpe, "STRETCH", 64)
    texts = [*ODD, *ODD[3:6]]
    df = spark.createDataFrame([(i if i % 4 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, block int").repartition(3)
    got = words.decode_ids(words.encode_texts(df, packed="packed")).collect()
    want = Counter((i if i % 4 else None, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts))
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(bytes(r.packed) == np.array(r.ids, "<u4").tobytes() for r in got)
    assert words.encode_texts(df.limit(0)).count() == 0


def test_decoding_joins_the_table(spark):
    df = spark.createDataFrame([(1, [0, 50255, 0], "x"), (2, [], "x"), (3, None, "x")], "k int, ids array<int>, decoded string")
    got = {r.k: bytes(r.decoded) for r in words.decode_ids(df).collect()}
    known = words.token_bytes(bpe.vocabulary_file(words.default_path()))
    assert got == {1: known[0] + known[50255] + known[0], 2: b"", 3: b""}
    with pytest.raises(Exception, match="no token has the id|INVALID_ARRAY_INDEX"):
        words.decode_ids(spark.createDataFrame([(1, [50256])], "k int, ids array<int>")).collect()


def test_squeezed():
    for x in ([], [0], [1, 2**32 - 1, 77], list(range(1000))):
        assert words.loosened(words.squeezed(np.array(x, np.uint32))).tolist() == x


def diverged(docs, min_docs, top):
    """Plain counts over all terms of all groups."""
    docs = [((lang or ""), (source or ""), re.findall(divergence.TERM, (text or "").translate(ASCII))) for text, lang, source in docs]
    out = []
    for lang in {x for x, _, _ in docs}:
        own = [(s, t) for x, s, t in docs if x == lang]
        df = Counter(w for _, t in own for w in set(t))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        count = {s: Counter(w for x, t in own if x == s for w in t) for s in {s for s, _ in own}}

        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + divergence.SCALE * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        for s in p:
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s]
            term = [(q[w] - p[s][w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1) if k <= most]
    return sorted(out)


@pytest.mark.parametrize("width", [1 << 16, 16])
def test_op12_cases(spark, monkeypatch, width):
    """Nulls, empty and long texts, one source, no kept terms, letters of all kinds, repeats; a sketch of 16 cells lets more through and changes nothing."""
    monkeypatch.setattr(divergence, "CHUNK", 16)
    rng = random.Random(1)
    vocabulary = ["The", "tHe", "Éa", "éa", "ß", "日本", "x\u0080y", "don't", "a1b", "\U0001f600", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = [(" ".join(rng.choices(vocabulary[: rng.randint(2, 30)], k=rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])) for _ in range(150)]
    docs += [(None, "en", "only null"), ("", "zz", "one"), ("lone term", "zy", "one"), ("lone term", "zy", "two"), ("the " * 50_000, "en", "a"), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, "t", 1.0) for d in docs], "text string, lang string, source string, term string, n double").repartition(3)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(df, min_docs=4, top=5, width=width).collect())
    assert got == diverged(docs, 4, 5)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    docs = [(f"common {'rare' if i == 3 else 'other'}", "en", "a") for i in range(12)]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    for width in (1, 8, 1 << 12):
        bits = np.unpackbits(divergence.possible(df, max(width, 8), 11))
        for term, often in (("common", True), ("other", True), ("rare", False)):
            let = bits[divergence.cells(["en"], [term], max(width, 8))[:, 0]].all()
            assert let or not often
            assert often or width < 1 << 12 or not let


def chats(seed, n, odd=True):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", *(["tool", "", None, "umbrella", "User"] if odd else [])]
    out = []
    for conv in [*range(n), *([None] if odd else [])]:
        for turn in range(rng.randint(0, 9)):
            text = rng.choice(["Yes.", "No", "Why? ", " \t", "", None, "a\n!\v", "Long. text", f"own {turn}.", f"own {turn}", "ends "])
            out.append((conv, rng.choice([turn, turn, turn, 3, None]) if odd else turn, rng.choice(roles), text))
    return out


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_sql(table):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(table, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    found = con.sql(conversations.ORACLE_SQL["op13_conversation_repair"])
    return sorted((tuple(r) for r in found.project(", ".join(REPORT)).fetchall()), key=repr)


def reported(df):
    return sorted((tuple(r) for r in df.select(*REPORT).collect()), key=repr)


@pytest.mark.parametrize("segment", [512, 2])
def test_op13_cases(spark, monkeypatch, segment):
    """Odd roles, nulls everywhere, equal turns; segments of two rows join to the same edits as whole conversations."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    table = chats(5, 60)
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, seg int, audit string")
    assert reported(conversations.repair(df, conversations.damage(df))) == by_sql(table)
    none = conversations.repair(df.limit(0), conversations.damage(df.limit(0)))
    assert none.count() == 0


def test_op13_long_conversation(spark, monkeypatch):
    """One conversation spread over tasks, with one text in a third of its rows, and a row a thousand times."""
    monkeypatch.setattr(conversations, "SEGMENT", 7)
    rng = random.Random(2)
    table = [(1, t, rng.choice(["user", "assistant", "system"]), "same." if t % 3 == 0 else f"text {t}{rng.choice('.,')}") for t in range(600)]
    table += [(1, 601, "user", "again.")] * 1000 + [(2, 0, "user", "Hello."), (2, 1, "assistant", "Good day.")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    assert reported(conversations.repair(df, conversations.damage(df))) == by_sql(table)


def cheapest(pattern, best=None):
    """All edits of a few rows: (cost, audit) of the cheapest, with at most two insertions at a place."""
    found = []
    for edits in itertools.product("DKR", repeat=len(pattern)):
        for places in itertools.product(range(3), repeat=len(pattern) + 1):
            options = [""]
            audit, cost = "", 0
            for i, n in enumerate(places):
                options = [o + x for o in options for x in map("".join, itertools.product("ua", repeat=n))]
                audit, cost = audit + "I" * n, cost + 2 * n
                if i < len(pattern):
                    e, late = edits[i], pattern[i].isupper()
                    cost += {"D": 3, "K": late, "R": 2 + late}[e]
                    audit += e
                    options = options if e == "D" else [o + x for o in options for x in (pattern[i].lower() if e == "K" else "ua")]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_edits_are_the_cheapest(n):
    rng = random.Random(n)
    patterns = list(map("".join, itertools.product("suaxSUAX", repeat=n)))
    for pattern in patterns if n < 3 else rng.sample(patterns, 40):
        known = conversations.distances(pattern, conversations.ENDS)
        letters, q = conversations.walk(pattern, known, conversations.START)
        letters += "I" * (conversations.ENDS[q] // conversations.INSERT)
        assert (known[0][conversations.START], letters) == cheapest(pattern)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (2, 0, "x", "")], "conv_id long, turn long, role string, text string")
    got = [(r.conv_id, r.edit, r.role, r.text) for r in conversations.repaired_rows(df).orderBy("conv_id", "part", "seg", "place").collect()]
    assert [(e, r, t) for c, e, r, t in got if c == 1] == [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "Why?"), ("D", None, None), ("I", "assistant", "")]
    assert [(e, r, t) for c, e, r, t in got if c == 2] == [("D", None, None)]


def test_nothing_below_the_threshold_is_joined(spark):
    """Pairs 5e-10 below and above 0.98, each of its own label, and three vectors of which the outer two hang together by the middle one only."""
    from lodeflow.llm import embeddings

    at = lambda angle: [float(np.cos(angle)), float(np.sin(angle))]
    step = float(np.arccos(0.985))
    rows_ = [(1, at(0), 1), (2, at(np.arccos(0.98 - 5e-10)), 1), (3, at(0), 2), (4, at(np.arccos(0.98 + 5e-10)), 2), (5, at(0), 3), (6, at(step), 3), (7, at(2 * step), 3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False), 5: (1, 5, True), 6: (2, 5, False), 7: (1, 5, False)}
