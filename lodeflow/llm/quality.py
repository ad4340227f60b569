"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of :data:`PASSAGE` words. Every passage is encoded: a histogram of its
words' shapes (case, digits, and which signs they end with), hashed, and measures of repetition, then
one learned layer. Gated attention weights, learned from document labels alone, say how much each
passage counts; the weighted mean passage is scored. So a junk section in a long document can decide,
whichever passage it is in.

Fitting takes a bounded sample of labelled rows (:data:`SAMPLE`, :data:`PASSAGES`), each with all of its text; passages are encoded on the executors
and the small model is fitted at the driver. Scoring is a map over whole texts: nothing is shuffled.

Cases: a null or empty text is a bag of one passage without words. Labels may be missing or of one kind
only: the model is then fitted to what there is, and with no label every score is 0.5. Rows repeat as
given; empty tables give empty results; other columns stay, one named like a result is replaced.
"""

from __future__ import annotations

import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import cleared, n_words, release_state, table
from .labelled import held_out, training_rows

#: Words in a passage; buckets of word shapes; labelled documents to fit; size of a passage's code and of the attention.
PASSAGE, SHAPES, SAMPLE, CODE, GATES = 64, 128, 6_000, 16, 8
#: Passages that the fit takes, about, at most: where texts are long it takes fewer documents, and all passages of each.
PASSAGES = 200_000
MEASURES = 8
#: Words that a task keeps at most between stretches of text.
WORDS = 150_000
WIDTH = SHAPES + MEASURES
KEEP_AT = 0.7


class Words(dict):
    """Numbers of words, with each one's shape and measures; emptied between stretches of text when large."""

    def __init__(self):
        super().__init__()
        self.shape, self.rows = array.array("H"), array.array("f")

    def __missing__(self, word: str) -> int:
        import zlib

        n = len(word)
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        tail = word[len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) :][:4]
        case = "0" if not letters else "u" if upper == letters and letters > 1 else "c" if word[:1].isupper() else "l" if not upper else "m"
        self.shape.append(zlib.crc32(f"{case}{'d' if digits else ''}{min(letters, 12) // 3}{tail}".encode()) % SHAPES)
        self.rows.extend((n, letters / n, upper / n, digits / n))
        self[word] = i = len(self.shape) - 1
        return i


def passages(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, in order, and each text's number of passages."""
    if len(words) > WORDS:
        words.clear()
        words.__init__()
    split = [(t or "").split() for t in texts]
    n = np.array([len(s) for s in split], np.int64)
    counts = np.maximum(1, -(-n // PASSAGE))
    ids = np.fromiter((words[w] for s in split for w in s), np.int64, int(n.sum()))
    total = int(counts.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if len(ids):
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        within = np.arange(len(ids)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        at = np.repeat(first, n) + within // PASSAGE
        size = np.bincount(at, minlength=total).clip(1)
        shape, rows = np.array(words.shape, np.int64), np.array(words.rows, np.float32).reshape(-1, 4)
        out[:, :SHAPES] = np.sqrt(np.bincount(at * SHAPES + shape[ids], minlength=total * SHAPES).reshape(total, SHAPES) / size[:, None])
        for j in range(4):
            out[:, SHAPES + j] = np.bincount(at, weights=rows[ids, j], minlength=total) / size
        pair = np.unique(at * (len(words) + 1) + ids)
        out[:, SHAPES + 4] = np.bincount(pair // (len(words) + 1), minlength=total) / size
        same = (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
        out[:, SHAPES + 5] = np.bincount(at[1:][same], minlength=total) / size
        longer = np.bincount(at, weights=rows[ids, 0] > 20, minlength=total)
        out[:, SHAPES + 6] = longer / size
        out[:, SHAPES + 7] = np.log1p(size) / 4
    return out, counts


def _stretches(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def forward(m: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Scores of bags, and what the gradient needs."""
    x = np.clip((x - m["mean"]) / m["std"], -6, 6)
    h = np.tanh(x @ m["W"] + m["b"])
    a, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (a * g) @ m["w"]
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    bag = np.repeat(np.arange(len(counts)), counts)
    alpha = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    alpha /= np.add.reduceat(alpha, starts)[bag]
    z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
    return {"x": x, "h": h, "a": a, "g": g, "alpha": alpha, "z": z, "bag": bag, "starts": starts, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["c0"], -30, 30)))}


def gradient(m: dict, f: dict, y: np.ndarray) -> dict:
    ds = (f["p"] - y) / len(y)
    dz = ds[:, None] * m["c"]
    bag, alpha, h, a, g = f["bag"], f["alpha"], f["h"], f["a"], f["g"]
    dalpha = (dz[bag] * h).sum(1)
    de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, f["starts"])[bag])
    da, dg = de[:, None] * m["w"] * g * (1 - a * a), de[:, None] * m["w"] * a * g * (1 - g)
    dh = (alpha[:, None] * dz[bag] + da @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ da, "U": h.T @ dg, "w": (de[:, None] * a * g).sum(0), "c": f["z"].T @ ds, "c0": ds.sum()}


def fit(bags: list[tuple[np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam on the log loss of document labels."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"W": draw(WIDTH, CODE), "b": np.zeros(CODE, np.float32), "V": draw(CODE, GATES), "U": draw(CODE, GATES), "w": draw(GATES), "c": draw(CODE), "c0": np.float32(0)}
    m |= {"mean": np.zeros(WIDTH, np.float32), "std": np.ones(WIDTH, np.float32)}
    if not bags:
        return m | {"c": np.zeros(CODE, np.float32)}
    every = np.concatenate([x for x, _ in bags])
    m |= {"mean": every.mean(0), "std": np.maximum(every.std(0), 0.02).astype(np.float32)}
    names = ("W", "b", "V", "U", "w", "c", "c0")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = [bags[j] for j in order[i : i + batch]]
            f = forward(m, np.concatenate([x for x, _ in some]), np.array([len(x) for x, _ in some]))
            step += 1
            for k, d in gradient(m, f, np.array([y for _, y in some], np.float32)).items():
                d = d + decay * m[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> dict:
    """A model from ``bound`` labelled documents at most, fewer where they have more than :data:`PASSAGES` passages."""

    def run(batches: Iterable[pa.RecordBatch]):
        release_state()
        words = Words()
        for b in slices(batches):
            at = 0
            y = b.column(1).to_pylist()
            for texts in _stretches(b.column(0).to_pylist()):
                x, counts = passages(texts, words)
                ends = np.cumsum(counts)
                rows = [x[e - c : e].astype("<f2").tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(y[at : at + len(rows)], pa.int32())], ["x", "y"])
                at += len(rows)

    size = F.greatest(F.lit(1), F.ceil(n_words(F.col("text_")) / PASSAGE))
    n, total = training_rows(docs, labels, label, bound, key, text).agg(F.count("*"), F.sum(size)).first()
    if n and total > PASSAGES:
        bound = max(1, min(bound, n) * PASSAGES // total)
    got = training_rows(docs, labels, label, bound, key, text).mapInArrow(run, "x binary, y int").toArrow()
    bags = [(np.frombuffer(x, "<f2").astype(np.float32).reshape(-1, WIDTH), int(y)) for x, y in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)]
    bags.sort(key=lambda b: (b[1], b[0].shape, b[0].tobytes()))  # the order of rows does not matter
    return fit(bags)


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    docs = cleared(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release_state()
        words, m = Words(), shared.value
        for b in slices(batches):
            scores = [forward(m, *passages(t, words))["p"] for t in _stretches(b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores).astype(np.float64))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
