"""Each operator against a brute-force version, a round trip, or held-out labels; and the parts of its method."""

from __future__ import annotations

import hashlib
import random
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeflow import llm
from lodeflow.llm import bpe, embeddings, fingerprints, graph, labelled, minhash, mixing, quality, records, suffixes, toxicity, urls
from tests.compare import rows
from tests.llm.helpers import components, near, unrepeated, words

TOKENIZER = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op1_nn_descent", "op2_minhash", "op4_suffix_dedup", "op7_url_filters"])
def test_against_sql(spark, sf, duck, name):
    assert rows(llm.queries()[name](spark, sf).toPandas()) == rows(duck.sql(llm.oracle_sql()[name]).df())


def test_dense_groups_are_whole(spark, monkeypatch):
    """Groups far beyond a list's length, two corners joined by few links, copies, and a hot label."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(embeddings, "TILE", 32)
    monkeypatch.setattr(embeddings, "PART", 16 * 8 * 50)
    base = rng.standard_normal((12, 16))
    vecs = np.concatenate([base, base[0] + 0.03 * rng.standard_normal((300, 16)), base[1] + 0.06 * rng.standard_normal((60, 16)), np.repeat(base[2:3], 40, 0)])
    label = [i % 7 != 0 for i in range(len(vecs))]
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    ok = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    comp = components(range(len(vecs)), lambda a, b: ok[a, b])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(vecs, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (int(ok[i].sum()) - 1, comp[i]) for i in range(len(vecs))}


def linked(spark, vecs):
    """What is given for vectors of one label, and what brute force gives."""
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    ok = unit @ unit.T >= 0.98
    label, new = np.arange(len(vecs)), None
    while new is None or (new != label).any():
        label, new = label if new is None else new, np.array([(label if new is None else new)[r].min() for r in ok])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    return got, {i: (int(ok[i].sum()) - 1, int(label[i])) for i in range(len(vecs))}


def test_lone_pairs_beside_a_dense_group(spark, monkeypatch):
    """Pairs far from everything else, in a label whose links nearly all belong to one group."""
    monkeypatch.setattr(embeddings, "TREES", 1)
    monkeypatch.setattr(embeddings, "LEAF", 32)
    monkeypatch.setattr(embeddings, "PART", 64 * 8 * 700)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    far = unit(rng.standard_normal((400, 64)))
    pair = unit(far + 0.19 * unit(rng.standard_normal((400, 64))))
    dense = unit(unit(rng.standard_normal(64)) + 0.05 * unit(rng.standard_normal((800, 64))))
    got, want = linked(spark, np.concatenate([far, pair, dense]))
    assert got == want


def test_one_link_between_dense_groups(spark, monkeypatch):
    """Two groups, each far longer than any list, that hang together by one link."""
    monkeypatch.setattr(embeddings, "LONGEST", 10)
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axes = np.linalg.qr(rng.standard_normal((64, 3)))[0].T
    turned = lambda angle: np.cos(angle) * axes[0] + np.sin(angle) * axes[1]
    noise = 0.06 * unit(rng.standard_normal((1_000, 64)))
    ends = np.array([turned(0.15), turned(0.34)])
    got, want = linked(spark, np.concatenate([unit(turned(0.0) + noise[:500]), unit(turned(0.49) + noise[500:]), ends]))
    unlinked = [ends[0] @ unit(turned(0.49) + noise[500:]).T, ends[1] @ unit(turned(0.0) + noise[:500]).T]
    assert max(map(np.max, unlinked)) < 0.98 and len({c for _, c in want.values()}) == 1
    assert got == want


def crippled(monkeypatch):
    """Lists that find nothing but what one leaf of two holds."""
    monkeypatch.setattr(embeddings, "TREES", 1)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    monkeypatch.setattr(embeddings, "LIST", 1)
    monkeypatch.setattr(embeddings, "LONGEST", 1)
    monkeypatch.setattr(embeddings, "MOST_ROUNDS", 2)


def test_links_that_lists_miss(spark, monkeypatch):
    """The audit sees that lists miss links; the check finds all of them, in files with several spaces too."""
    crippled(monkeypatch)
    monkeypatch.setattr(embeddings, "PART", 64 * 8 * 100)
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    far = unit(rng.standard_normal((200, 64)))
    got, want = linked(spark, np.concatenate([far, *[unit(far + 0.1 * unit(rng.standard_normal((200, 64)))) for _ in range(3)]]))
    assert got == want and sum(n for n, _ in want.values()) >= 2_000


def test_audit_measures_recall(spark, monkeypatch):
    rng = np.random.default_rng(13)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    far = unit(rng.standard_normal((300, 64)))
    x = np.concatenate([far, unit(far + 0.1 * unit(rng.standard_normal((300, 64))))])
    df = spark.createDataFrame([(i, 1, v.tobytes(), 600) for i, v in enumerate(x)], "node long, space long, unit binary, size long")
    groups, recall = embeddings.descended(df, 0.98)
    assert recall >= embeddings.RECALL and groups.count() == 600
    crippled(monkeypatch)
    assert embeddings.descended(df, 0.98)[1] < 0.8


def test_files_far_apart_are_not_read(spark, monkeypatch, tmp_path):
    """Tight groups in files of their own: only pairs of files that may hold links are opened."""
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(rng.standard_normal((6, 64)))
    x = np.concatenate([unit(c + 0.02 * unit(rng.standard_normal((100, 64)))) for c in centres])
    monkeypatch.setattr(embeddings, "PART", 64 * 8 * 100)
    nodes = spark.createDataFrame([(i, 1, v.tobytes(), 1) for i, v in enumerate(x)], "node long, space long, unit binary, count long")
    groups = spark.createDataFrame([(i, i // 100 * 100) for i in range(600)], "id long, component long")
    files = embeddings.described(nodes, groups, str(tmp_path / "v"))
    rows_ = files.collect()
    reach = np.arccos(0.98)
    near = [(a, b) for a in rows_ for b in rows_ if a.file < b.file and np.arccos(np.frombuffer(a.centre) @ np.frombuffer(b.centre)) - a.radius - b.radius <= reach]
    assert len(rows_) >= 6 and len(near) <= len(rows_)
    counts, _ = embeddings.checked(files, str(tmp_path / "v"), 0.98)
    assert {r.node: r.links for r in counts.collect()} == dict(enumerate(((x @ x.T >= 0.98).sum(1) - 1).tolist()))


def test_op2(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in llm.queries()["op2_minhash"](spark, sf).collect()}
    assert got == near(texts.items(), 3, 85)


def test_parted_groups(spark, monkeypatch):
    """A group that its centre does not hold together: links between other members count."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]

    def edited(of, n):
        out = list(of)
        for _ in range(n):
            out[rng.randrange(len(out))] = f"e{rng.random()}"
        return out

    docs = [(i, " ".join(edited(base, rng.choice((0, 1, 1, 2, 3, 4))))) for i in range(90)] + [(100 + i, f"{' '.join(base[:30])} other {' '.join(edited(base, 40))}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words=k, percent=percent).collect()}
        assert got == near(docs, k, percent)


def test_tables():
    for percent in (80, 85, 95):
        assert 2 * (1 - (percent / 100) ** 3) ** minhash.tables(percent) <= 5e-4


@pytest.mark.parametrize("few", [500_000, 40, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    want = components({x for p in links for x in p}, lambda a, b, s=set(links): (a, b) in s or (b, a) in s)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 5)
    rows_ = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(60)] + [(99, None)], "id long, key long")
    facts = spark.createDataFrame([(k, k * 2) for k in range(30)], "key long, twice long")
    got = sorted((r.id, r.twice) for r in graph.hot_join(rows_, facts, "key", "id", "left").collect() if r.twice is not None)
    assert got == sorted([(i, 2 if i % 3 else i * 2) for i in range(60) if i % 3 or i < 30])
    assert graph.hot_join(rows_, facts, "key", "id", "left").count() == 61
    nulls = spark.createDataFrame([(i, None) for i in range(20)], "id long, key long")
    assert {r.id for r in graph.hot_join(nulls, facts, "key", "id", "left").collect()} == set(range(20))


def test_op3(spark, sf, texts):
    a = llm.queries()["op3_mixing"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = llm.queries()["op3_mixing"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(words(t)) for i, t in texts.items()}
    assert dict(zip(a.doc_id, a["size"], strict=True)) == size and (a.taken <= 2 * a["size"]).all()
    own = {}
    for i, s in source.items():
        own[s] = own.get(s, 0) + size[i]
    weight = dict(zip(sorted(own), [3, 1, 2] * len(own), strict=False))
    left, total, target = set(own), 1.5 * sum(own.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * own[s]]
        for s in over or list(left):
            target[s] = 2.0 * own[s] if over else level * weight[s]
            total -= target[s]
            left.discard(s)
    a["source"] = a.doc_id.map(source)
    mixed_copies = dict(iter(mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().groupby("source").copies))
    for s, g in a.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s])
        assert abs(g.taken.sum() - target[s]) <= max(60, 0.02 * target[s])
        copies = mixed_copies[s]
        assert abs(copies.sum() - len(g) * target[s] / own[s]) < 1 + 1e-6


def test_mix_keeps_both_totals(spark, monkeypatch):
    """Several levels of blocks, null and repeated ids, and rows that are alike: words and documents of each source."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i % 40, rng.choice("ab") if i % 11 else None, "w " * rng.randrange(40, 60) if i % 5 else "same words here") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(df).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source", dropna=False):
        ratio = g.target.iloc[0] / g.source_size.iloc[0]
        assert abs(g.copies.sum() - len(g) * ratio) < 1 + 1e-6 and abs(g.taken.sum() - g.target.iloc[0]) <= 30  # half a document
        assert g.copies.between(int(ratio + 1e-9), int(ratio - 1e-9) + 1).all()
    mix = mixing.mixture(df)
    assert mix.columns == df.columns and mix.count() == got.copies.sum()
    want = {s: n for s, n in got.groupby(got.source.fillna("")).taken.sum().items()}
    have = {}
    for r in mix.collect():
        have[r.source or ""] = have.get(r.source or "", 0) + len(words(r.text))
    assert have == want


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 400).astype(float)
    chances = rng.random(400)
    p = chances.tolist()
    mixing.flight(p, size.tolist(), rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(chances.sum()) and float(np.dot(p, size)) == pytest.approx(float(np.dot(chances, size)))


def test_mixture_repeats_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixture(docs).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_op4(spark, sf, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in llm.queries()["op4_suffix_dedup"](spark, sf).collect()}
    order = sorted(texts)
    assert got == dict(zip(order, unrepeated([texts[i] for i in order], 100), strict=True))


def test_repeats_of_few_letters(spark):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(300))) * rng.choice((1, 1, 2, 5))) for i in range(60)] + [(100, "ab" * 400), (101, "b" + "ab" * 300), (102, "a" * 99), (103, "a" * 100), (104, "a" * 101)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(zip((i for i, _ in docs), unrepeated([t for _, t in docs], 100), strict=True))


def test_repeats_with_equal_hashes_of_different_bytes(spark, monkeypatch):
    """Hashes of four bits: what is removed still is what repeats."""
    mix = suffixes.mix
    monkeypatch.setattr(suffixes, "mix", lambda x: mix(x) & np.uint64(0x300000003))
    rng = random.Random(12)
    parts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(90, 160))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(4)))) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(zip((i for i, _ in docs), unrepeated([t for _, t in docs], 100), strict=True))


@pytest.mark.parametrize("name,label,least", [("op5_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = llm.queries()[name](spark, sf)
    got = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert out.count() == docs.count() and got >= least


def test_toxic_documents_are_found(spark):
    """Held-out recall and precision. Labels of sf0.01 are wrong for some documents: of its 14 held-out toxic ones five have no insult."""
    for sf, recall in (("sf0.01", 0.64), ("sf0.1", 0.88)):
        d = f"/root/testdata/{sf}"
        got = llm.queries()["op9_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
        hit, said, toxic = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
        assert hit >= recall * toxic and hit >= 0.95 * said


@pytest.mark.parametrize("others", [8, 200])
def test_a_pair_tells_what_its_halves_do_not(spark, others):
    """Toxic by whether two words are there together or not at all; each word by itself says nothing."""
    rng = random.Random(others)
    rows = []
    for i in range(3_000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rest = [f"{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)}" for n in rng.sample(range(15 * others), others)]
        words_ = rest + ["badger"] * a + ["lantern"] * b
        rng.shuffle(words_)
        rows.append((i, " ".join(words_), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(df, toxicity.train(df, df.select("doc_id", "toxic"))).where(labelled.held_out(F.col("doc_id")))
    wrong = got.where((F.col("score") >= 0.5) != (F.col("toxic") == 1)).count()
    assert got.count() > 500 and not wrong


def test_gradients():
    """Both models' gradients against differences of the loss."""
    rng = np.random.default_rng(4)
    loss = lambda p, y: float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    rows, y = [rng.choice(20, rng.integers(0, 9), replace=False).tolist() for _ in range(15)], (rng.random(15) < 0.4).astype(float)
    flat, bag = toxicity.packed(rows)
    machine = {"w0": 0.3, "w": rng.standard_normal(20), "v": rng.standard_normal((20, toxicity.FACTORS))}
    cases = [(machine, lambda m: loss(toxicity.sigmoid(toxicity.fm(m, flat, bag, 15)[0]), y), toxicity.gradient(machine, flat, bag, y))]
    counts = rng.integers(1, 5, 12)
    x, t = rng.standard_normal((counts.sum(), quality.WIDTH)), (rng.random(12) < 0.5).astype(float)
    bags = quality.fit([])
    bags = {k: rng.standard_normal(np.shape(v)) * 0.3 if k not in ("mean", "std") else np.asarray(v, float) for k, v in bags.items()}
    cases.append((bags, lambda m: loss(quality.forward(m, x, counts)["p"], t), quality.gradient(bags, quality.forward(bags, x, counts), t)))
    for model, value, given in cases:
        for k, d in given.items():
            for at in list(np.ndindex(np.shape(model[k])))[:: max(1, np.size(model[k]) // 25)]:
                up, down = ({**model, k: np.array(model[k], float)} for _ in range(2))
                up[k][at] += 1e-5
                down[k][at] -= 1e-5
                assert (value(up) - value(down)) / 2e-5 == pytest.approx(float(np.asarray(d)[at]), abs=1e-6)


def test_held_out_rows_are_not_learned_from(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    n = labelled.training_rows(docs, labels, "quality", 10_000).count()
    assert n == sum(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in labels.collect())
    assert labelled.training_rows(docs, labels, "quality", 7).count() == 7


def test_quality_fits_whole_documents(spark, monkeypatch):
    """Every passage of a long document is fitted to; a small bound takes fewer documents, not parts."""
    taken = []
    monkeypatch.setattr(quality, "fit", lambda bags, **_: taken.append(sorted(len(x) for x, _ in bags)))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    docs = spark.createDataFrame([(i, "word " * 64 * 300) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "PASSAGES", 900)
    quality.train(docs, labels)
    assert taken == [[300] * 8, [300] * 3]


def test_op6(spark, sf, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in llm.queries()["op6_document_fingerprints"](spark, sf).collect()}
    mark = {}
    for i, n in zip(order, [*order[1:], order[0]], strict=True):
        part = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - part] + texts[n][:part]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert mark.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint
        assert got[i].near_next == float(got[i].fingerprint == got[n].fingerprint)
        assert got[i].near_edited == float(folded(edited) == folded(texts[i]))
    least = {}
    for i in order:
        assert got[i].group_id == least.setdefault(folded(texts[i]), i) and got[i].kept == (got[i].group_id == i)


def folded(text):
    """The canonical text, as Python's Unicode tables have it."""
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return " ".join(nfkc(nfkc(text).casefold()).split())


def test_groups_compare_bytes(spark, monkeypatch):
    """One digest for all texts: groups still are those of equal canonical texts, whether fingerprints are broadcast or joined."""
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.when(canon.isNotNull(), F.lit("same")))
    df = spark.createDataFrame([(3, "a b"), (1, "A  B"), (2, "c"), (None, "d"), (5, None), (4, ""), (6, "C"), (6, "C")], "doc_id long, text string")
    for few in (10, 0):
        monkeypatch.setattr(fingerprints, "FEW", few)
        got = sorted(((r.doc_id, r.group_id, r.kept) for r in fingerprints.exact_groups(df).collect()), key=repr)
        assert got == sorted([(3, 1, False), (1, 1, True), (2, 2, True), (None, None, True), (5, 4, False), (4, 4, True), (6, 2, False), (6, 2, False)], key=repr)


def test_canonical(spark):
    same = ["Ｆｕｌｌ  wıdth é", "FULL WıDTH É", "\tfull\nwıdth é "]
    got = spark.createDataFrame([(t,) for t in same], "text string").select(fingerprints.canonical(F.col("text")).alias("c")).distinct().collect()
    assert [r.c for r in got] == ["full wıdth é"]


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "DOCS_A_RANGE", 3)
    ids = random.Random(4).sample(range(-1000, 10**12), 50)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    order = sorted(ids)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df).collect()}
    assert got == {i: f"text {n}" for i, n in zip(order, [*order[1:], order[0]], strict=True)}


def test_many_rules(spark):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "aa.com", "org", "x.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/￿"]
    rules = [urls.Rule(rng.choice(hosts), rng.choice(paths), rng.choice(("allow", "block"))) for _ in range(40)]
    held = {(r.host, r.path): r for r in rules}
    pages = [(i, f"http://{rng.choice(('', 'q.', 'w.w.'))}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', 'z', '/b', '?q', '#f'))}") for i in range(400)]

    def judged(url):
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, _, path = rest.partition("/")
        path = f"/{path}" if "/" in rest else ""
        fit = [r for r in held.values() if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
        return (best.host + best.path, best.verdict) if best else (None, "allow")

    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got == {i: judged(u) for i, u in pages}


def test_rules_are_held_once():
    """Many hosts below a domain with many rules: bounds grow with the rules, not with their product."""
    rules = [urls.Rule("com", f"/{i}/", "block") for i in range(500)] + [urls.Rule(f"h{i}.com", "/", "allow") for i in range(500)]
    assert len(urls.segments(rules)) <= 4 * len(rules)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_op8_and_op10(spark, sf, texts, library):
    ten = {r.doc_id: r for r in llm.queries()["op10_bpe"](spark, sf).collect()}
    eight = {r.doc_id: r for r in llm.queries()["op8_binary_records"](spark, sf).collect()}
    start = 0
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert (ten[i].n_tokens, ten[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert ten[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        ids.append(2)
        assert (eight[i].start, eight[i].n_tokens, eight[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_trie_on_odd_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 200)
    encode, tokens = bpe.encoder(bpe.vocabulary_file())
    rng = random.Random(1)
    kinds = ["abcXYZ  '\n\t.,019", "éèàüßñ çl'ô ①½²ⅷ中文   x", "".join(map(chr, range(1, 128))), "aAbB  \x1c\x1d\x85\xa0ſƀǅ", "ha", " "]
    odd = ["".join(rng.choice(k) for _ in range(rng.randrange(250))) for _ in range(150) for k in kinds] + ["", "a<|endoftext|>b  <|endoftext|> c", "don't 'sit'll", "-" * 500, " " * 300 + "x"]
    odd += ["\t \t x", "a   ", "  ", " ", "a \n", "\n a", "\n\n  b\u2003 c", "x \u00a0 y"]
    flat, ends = encode(pa.array(odd))
    alone = [encode(pa.array([t]))[0] for t in odd]
    for t, ids, one in zip(odd, np.split(flat, ends[:-1]), alone, strict=True):
        ids = ids.tolist()
        assert ids == one.tolist() == library.encode(t, add_special_tokens=False).ids
        assert tokens.texts(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py() == library.decode(ids, skip_special_tokens=False)
    assert tokens.texts(np.array([127, 127, 32]), np.array([1, 3])).to_pylist() == [library.decode([127]), library.decode([127, 32])]


def test_other_splitters_are_errors():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Trie(bpe.vocabulary_file(public_tokenizers.path("word_bpe_49k.json")))


def test_records_are_checked(spark, tmp_path):
    import io

    df = spark.createDataFrame([(3, "three words here"), (1, "one"), (2, "")], "doc_id long, text string")
    index = records.write_records(df, str(tmp_path / "r")).collect()
    for r in index:
        doc_id, ids = records.read_at(str(tmp_path / "r"), r.file, r.offset)
        assert (doc_id, len(ids) // 4) == (r.doc_id, r.n_tokens)
    data = bytearray(records.frame(b"payload"))
    assert list(records.unframed(io.BytesIO(bytes(data)))) == [b"payload"]
    for at in (0, 9, 13, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.unframed(io.BytesIO(bytes(bad))))
    assert records.unpack(records.pack(5, struct.pack("<2I", 1, 70000), 4)) == (5, struct.pack("<2I", 1, 70000))
