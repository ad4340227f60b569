"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from lodeflow.llm import mixing, quality
from tests.llm.helpers import near, unrepeated


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_stages(spark, sf, stages):
    assert len(P.STAGES) == 5
    docs, good, apart, cut, mix, ids = stages
    for x in (good, apart, cut, mix):
        assert x.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.9 * len(labels)
    text = {r.doc_id: r.text for r in good.collect()}
    assert {r.doc_id for r in apart.collect()} == {i for i, (_, c) in near(text.items(), 5, 80).items() if i == c}
    order = sorted(r.doc_id for r in apart.collect())
    want = dict(zip(order, unrepeated([text[i] for i in order], 100), strict=True))
    got = {r.doc_id: r for r in cut.collect()}
    for i in order:
        n, gone, _, _ = want[i]
        if gone == n and gone:
            assert i not in got or got[i].text
        elif not gone:
            assert got[i].text == text[i]
        else:
            assert abs(len(got[i].text.encode()) - (n - gone)) <= 6 * want[i][2] and got[i].n_chars == len(got[i].text)
    copies = {r.doc_id: r.copies for r in mixing.mixed(cut).collect()}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert ids.count() == mix.count()


def test_run(spark, sf, stages):
    assert P.run(spark, sf).count() == stages[-1].count()


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert quality.KEEP_AT == 0.7
