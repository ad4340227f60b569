"""Versions of tables, saved engines, packed postings, and inverted lists."""

from __future__ import annotations

import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.errors import IndexError_, LoadError, StoreError
from lodeflow.facade import Engine
from lodeflow.operators import ann, bm25, vectors
from lodeflow.sources import versions
from tests.test_facade import chunks  # noqa: F401  a fixture


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(LoadError):
        versions.open_version(spark, folder)
    one = versions.commit(spark, folder, {"a": spark.range(3), "b": spark.createDataFrame([("x", [1.0])], "k string, v array<double>")}, {"by": "me"})
    two = versions.commit(spark, folder, {"a": spark.range(5)}, after=1)
    assert (one.number, two.number) == (1, 2) and versions.versions(spark, folder) == [1, 2]
    assert one.read(spark, "a").count() == 3 and versions.open_version(spark, folder).read(spark, "a").count() == 5
    old = versions.open_version(spark, folder, 1)
    assert old.facts == {"by": "me"} and old.read(spark, "b").first().v == [1.0]
    with pytest.raises(StoreError):
        versions.commit(spark, folder, {"a": spark.range(1)}, after=1)
    with pytest.raises(LoadError):
        two.read(spark, "b")
    with pytest.raises(LoadError):
        versions.open_version(spark, folder, 7)
    assert versions.commit(spark, folder, {"a": spark.range(1)}).number == 3


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    versions.commit(spark, folder, {"a": spark.range(3)})
    bad = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.commit(spark, folder, {"a": spark.range(9), "b": bad})
    assert versions.versions(spark, folder) == [1] and versions.open_version(spark, folder).read(spark, "a").count() == 3
    left = len(list((tmp_path / "store" / "data").iterdir()))
    assert left == 2 and versions.vacuum(spark, folder, 1) == [] and len(list((tmp_path / "store" / "data").iterdir())) == 1
    assert versions.open_version(spark, folder).read(spark, "a").count() == 3


def test_vacuum_keeps_the_last(spark, tmp_path):
    folder = str(tmp_path / "store")
    for n in range(1, 4):
        versions.commit(spark, folder, {"a": spark.range(n)})
    assert versions.vacuum(spark, folder, 2) == [1] and [versions.open_version(spark, folder, n).read(spark, "a").count() for n in (2, 3)] == [2, 3]
    with pytest.raises(StoreError):
        versions.vacuum(spark, folder, 0)


def test_saved_engine(spark, chunks, tmp_path):  # noqa: F811
    """Another session, in a process of its own, answers as the one that saved; a later version does not touch an open one."""
    folder = str(tmp_path / "engine")
    with pytest.raises(IndexError_):
        Engine(chunks).save(folder)
    engine = Engine(chunks).index()
    assert engine.save(folder) == 1
    asked = [(1, "Does trastuzumab treat breast cancer with HER2?"), (2, "cisplatin and renal function")]
    q = spark.createDataFrame(asked, "qid long, query string")
    want = sorted(map(tuple, engine.query(q, 2).collect()))
    loaded = Engine.load(spark, folder)
    assert sorted(map(tuple, loaded.query(q, 2).collect())) == want
    assert Engine(chunks.where("chunk_id < 3")).index().save(folder, after=1) == 2
    assert loaded.chunks.count() == 4 and Engine.load(spark, folder).chunks.count() == 2 and Engine.load(spark, folder, 1).chunks.count() == 4
    program = f"""
        from pyspark.sql import SparkSession
        from lodeflow.facade import Engine
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        q = spark.createDataFrame({asked!r}, "qid long, query string")
        print("ANSWERS", sorted(map(tuple, Engine.load(spark, {folder!r}, 1).query(q, 2).collect())))
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(program)], capture_output=True, text=True, timeout=300, cwd=sys.path[0] or ".", env={**__import__("os").environ, "PYTHONPATH": ":".join(sys.path)})
    assert f"ANSWERS {want!r}" in out.stdout, out.stderr[-2000:]


def test_packed_postings(spark, monkeypatch, tmp_path):
    """Frequent terms are several rows; a search reads the folders of asked terms and finds what the plain index finds."""
    monkeypatch.setattr(bm25, "ROW", 4)
    docs = spark.createDataFrame([(i, f"all these words {'rare' if i % 9 == 0 else 'other'} w{i} w{i % 5}") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    ix = bm25.index(docs)
    packed = bm25.pack(ix)
    assert packed.where("term = 'all'").count() > 8 and packed.agg(F.max(F.size("postings"))).first()[0] <= 12
    versions.commit(spark, str(tmp_path), {"postings": packed, "idf": ix.idf, "totals": ix.totals}, partitioned={"postings": ["slot"]})
    at = versions.open_version(spark, str(tmp_path))
    again = bm25.stored(*(at.read(spark, n) for n in ("postings", "idf", "totals")))
    q = spark.createDataFrame([(1, "rare w3 w3"), (2, "nothing here"), (3, "all words")], "qid long, query string")
    assert sorted(map(tuple, bm25.search(again, q, 5).collect())) == sorted(map(tuple, bm25.search(ix, q, 5).collect()))
    plan = bm25._asked_postings(again, spark.createDataFrame([("rare",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "slot#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stored_folders_have_few_files_and_scores_are_not_shuffled(spark, sf, tmp_path):
    """A folder has a file and not one from each task; what is shuffled are postings by document, not scores of pairs of question and document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    ix = bm25.index(docs)
    versions.commit(spark, str(tmp_path), {"postings": bm25.pack(ix), "idf": ix.idf, "totals": ix.totals}, partitioned={"postings": ["slot"]})
    assert len(list(tmp_path.glob("data/*/postings/slot=*/*.parquet"))) == len(list(tmp_path.glob("data/*/postings/slot=*")))
    at = versions.open_version(spark, str(tmp_path))
    again = bm25.stored(*(at.read(spark, n) for n in ("postings", "idf", "totals")))
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    assert sorted(map(tuple, bm25.search(again, q, 5).collect())) == sorted(map(tuple, bm25.search(ix, q, 5).collect()))
    for each in (ix, again):
        plan = bm25.search(each, q, 5)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id#" in plan and not [x for x in plan.split("\n") if "hashpartitioning(qid#" in x and "doc_id#" in x.split("hashpartitioning(")[1].split(")")[0]]


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.standard_normal((n // 20, dim)), 20, 0) + 0.2 * rng.standard_normal((n, dim))


def test_certified_is_exact_and_looks_at_few(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "GROUP", 2)
    monkeypatch.setattr(ann, "ASKED", 8)
    x = clustered(1_000, 12, 3)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(2_000, x[0].tolist(), 0), (2_001, None, 0), (2_002, [0.0] * 12, 0), (2_003, [float("nan")] + [1.0] * 11, 0), (2_004, [1.0, 2.0], 0), (2_005, [], 0), (2_006, (x[1] * 1e-200).tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = df.where("vec_id % 10 = 0 OR vec_id >= 2000")
    usable = df.where(ann.usable(F.col("embedding")))
    ix = ann.build(df, n_lists=40, tag="label")
    for tag in (None, "label"):
        got, seen = ann.search(ix, asked, 7, 3, tag=tag, certified=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.nearest(usable, asked.where(ann.usable(F.col("embedding"))), 7, tag=tag).collect()))
        assert tag or seen.agg(F.avg("scanned")).first()[0] < 500
    assert ann.search(ix, asked.limit(0), 7)[0].count() == 0 and ann.search(ann.build(df.limit(0)), asked, 7)[0].count() == 0


def test_questions_go_to_lists_in_parts(spark, sf, monkeypatch):
    """However many questions a batch has and lists they go to, a part of what goes out has a bounded number of bytes."""
    import pyarrow as pa

    monkeypatch.setattr(ann, "ROOM", 8 * 12 * 40 * 5)
    x = np.random.default_rng(1).standard_normal((64, 12))
    batch = pa.RecordBatch.from_pydict({"length": pa.array([12] * 64, pa.int32()), "v": pa.array(x.tolist())})
    parts = list(ann._units(batch, {12: (np.arange(40), None, None)}))
    assert [len(at) for _, at, _ in parts] == [5] * 12 + [4] and np.concatenate([at for _, at, _ in parts]).tolist() == list(range(64))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(clustered(400, 12, 3))], "vec_id long, embedding array<double>, label int")
    got, _ = ann.search(ann.build(df, tag="label"), df, 5, 3, tag="label", certified=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.nearest(df, df, 5, tag="label").collect()))


def test_audit_and_probes(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(2_000, 16, 5))], "vec_id long, embedding array<double>")
    asked, ix = df.where("vec_id % 20 = 0"), ann.build(df)
    few, all_ = (ann.audit(ix, df, asked, 10, p).first() for p in (1, ix.centres.count()))
    assert few.recall <= all_.recall == 1.0 and few.scanned < 0.2 and all_.scanned == pytest.approx(1.0)
    probes, recall = ann.fitted_probes(ix, df, asked, 10)
    assert recall >= 0.95 and probes < ix.centres.count()
