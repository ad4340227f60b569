from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodeflow.errors import ChunkingError
from lodeflow.functions import overlap
from lodeflow.functions import text as T
from lodeflow.operators import chunks


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, T.fix_hyphenation(F.col("t")), t="cardiotox-\nicity") == "cardiotoxicity"
    assert one(spark, T.strip_page_numbers(F.col("t")), t="a\n 12 \nPage 3\nb") == "a\nb"
    assert one(spark, T.strip_captions(F.col("t")), t="Figure 1. x\nTable 2\nChapter 4: y\nchapter 4\nz") == "chapter 4\nz"
    assert one(spark, T.strip_references(F.col("t")), t="seen [1, 2] here[3]") == "seen  here"
    assert one(spark, T.normalize_whitespace(F.col("t")), t="  a\x00  b\n\n\n\nc ") == "a b\n\nc"


def test_running_lines(spark):
    rows = [("d", i, f"Chapter 4: Breast Cancer\nContent {i}\nend of book") for i in (1, 2, 3)] + [("e", i, "same\nx") for i in (1, 2)]
    got = {(r.source_file, r.line, r.n) for r in chunks.running_lines(spark.createDataFrame(rows, "source_file string, page_number int, text string"), 0.5).collect()}
    assert got == {("d", "Chapter 4: Breast Cancer", 3), ("d", "end of book", 3)}


def test_sizes():
    for bad in ((0, 1, 0), (10, 0, 0), (10, 5, 5)):
        with pytest.raises(ChunkingError):
            chunks.check_sizes(*bad)


def packed(sentences: list[str], target: int) -> list[str]:
    out, cur, n = [], [], 0
    for s in sentences:
        tok = max(1, len(s) // 4)
        if cur and (n + tok > target or re.match(T.SECTION, s)):
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += tok
    return out + [" ".join(cur)] if cur else out


def test_packing(spark):
    for text in ("A b c. D e f! G h? I j.", "One two three. Treatment\nFour. 5 six.", "", "no end", "Alpha beta. Diagnosis. Gamma delta epsilon zeta eta. Theta."):
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text.strip()) if s.strip()]
        for target in (2, 4, 100):
            assert one(spark, T.pack_sentences(T.chunk_sentences(F.col("t")), target), t=text) == packed(parts, target)


def test_chunks_keep_pages_and_parents(spark):
    rows = [("d", i, "Sentence one here. Sentence two there. Sentence three again. " * 6) for i in (1, 2, 3)]
    got = chunks.chunk_pages(spark.createDataFrame(rows, "source_file string, page_number int, cleaned string"), parent=100, child=30, overlap=5).collect()
    parents = {r.chunk_id for r in got if r.level == "parent"}
    assert {r.page_number for r in got} == {1, 2, 3} and parents
    assert all(r.parent_id in parents for r in got if r.level == "child")
    assert len({r.chunk_id for r in got}) == len(got)


def test_stitch(spark):
    rows = [("s", 1, 10, "a"), ("s", 2, 11, "b"), ("s", 4, 12, "c"), ("s", None, 13, "d"), ("t", 5, 14, "e"), ("s", None, 15, "f")]
    got = {(r.g, r.ids, r.text) for r in chunks.stitch(spark.createDataFrame(rows, "g string, i int, k int, t string"), "g", "i", "k", "t").collect()}
    assert got == {("s", "10+11", "a\nb"), ("s", "12", "c"), ("s", "13", "d"), ("s", "15", "f"), ("t", "14", "e")}


def lcs(x, y):
    dp = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a == b else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


@pytest.mark.parametrize("a,b", [("the cat sat", "the cat sat"), ("x y z", "a b c"), ("a b a c b", "b a b c a a"), ("", "a"), ("a-b c", "c a-b c")])
def test_overlap(spark, a, b):
    x, y = a.split(), b.split()
    f1 = lambda h: 2 * h / (len(x) + len(y)) if h else 0.0
    shared = sum(min(x.count(w), y.count(w)) for w in set(x))
    assert one(spark, overlap.answer_f1(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(f1(shared))
    assert one(spark, overlap.rouge_l(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(f1(lcs(x, y)))
    if a == b:
        assert one(spark, overlap.bleu(F.col("a"), F.col("b"), 2), a=a, b=b) == pytest.approx(1.0)


def test_answers(spark):
    assert one(spark, T.clean_answer(F.col("t")), t='```json\n{"answer": "Yes."}\n```') == "Yes."
    assert one(spark, T.clean_answer(F.col("t")), t="It is so.\nConfidence: High") == "It is so."
    assert one(spark, T.confidence(F.col("t")), t="It is so.\nConfidence: mEDIUM.") == "Medium"
    assert one(spark, T.confidence(F.col("t")), t="none") is None
