"""Toxicity: a factorization machine over hashed terms.

A document's terms are its words and the starts of its words, lower-cased, each hashed to one of :data:`BUCKETS`; a
term counts once, wherever it stands in the whole text. The machine has a weight and a short vector for each term
that tells something; the product of two terms' vectors is the weight of the pair, so a pair such as an insult with
the mention of a group counts beyond what the two add up to.

A term tells something alone, by the G-squared of its counts in toxic and other documents, or in a pair: for all pairs
of the :data:`PAIRED` terms that most documents have, the shares of toxic documents with both, either and neither are
set against what two terms add up to. So a pair is learned of which neither half tells anything. (With
all frequent terms in the machine chance drowns it: held-out recall at sf0.1 was then 0.44 to 0.78, not 0.9.)

Learning takes a bounded sample of labelled documents (:data:`SAMPLE`, :data:`SAMPLE_WORDS`), each with its whole text; terms
are found on the executors and the machine is fitted at the driver. Scoring is a map over whole texts: nothing is shuffled.

Cases: a null or empty text has no terms and gets the score of the intercept alone. A very long text is one
document whose distinct words are held at once. With no label every score is 0.5; with labels of one kind all scores
are near it. Rows repeat as given; empty tables give empty results; other columns stay, one named like a result is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import cleared, n_words, release_state, table
from .labelled import held_out, training_rows

#: Labelled documents to fit, and words in them, about, at most: where texts are long the fit takes fewer documents, each whole.
SAMPLE, SAMPLE_WORDS = 20_000, 20_000_000
#: Hashed terms; length of a term's vector; lengths of a word's starts.
BUCKETS, FACTORS, STARTS = 1 << 22, 8, (3, 4, 5, 6)
#: A term tells something alone if it is in this many documents and its G-squared is at least this.
LEAST, TELLING = 5, 20.0
#: Terms of which pairs are looked at; documents with both, either and neither; least square of the interaction's z, which
#: chance passes for 1 in 4,000 million pairs.
PAIRED, PAIR_LEAST, PAIR_TELLING = 2_048, 10, 40.0
TOXIC_AT = 0.3
#: Words that a task remembers to have looked up.
SEEN = 300_000
WORD = r"[^\W\d_]+"


def hashed(term: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term) % BUCKETS


def terms_of(word: str) -> list[int]:
    return [hashed(word), *(hashed(f"{word[:n]}\0") for n in STARTS if len(word) > n)]


def _words(texts):
    find = re.compile(WORD).findall
    for t in texts:
        yield set(find((t or "").lower()))


class Hits(dict):
    """Of a word: the numbers of the model's terms that it has. Most have none."""

    def __init__(self, place: dict[int, int]):
        self.place, self.seen = place, set()

    def of(self, words: set[str]) -> list[int]:
        new = words - self.seen
        if new:
            if len(self.seen) > SEEN:
                self.seen.clear()
            for w in new:
                if w not in self and (got := [self.place[t] for t in terms_of(w) if t in self.place]):
                    self[w] = got
            self.seen |= new
        return sorted({t for w in words & self.keys() for t in self[w]})


def packed(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of terms as one array, and each term's document."""
    n = np.array([len(r) for r in rows], np.int64)
    return np.fromiter((t for r in rows for t in r), np.int64, int(n.sum())), np.repeat(np.arange(len(rows)), n)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ``at``."""
    return np.stack([np.bincount(at, weights=c, minlength=n) for c in values.T], axis=1)


def fm(model: dict, flat: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Margins of ``n`` documents; and the sums of vectors that the gradient needs."""
    v = model["v"][flat]
    s = _sums(bag, v, n)
    q = np.bincount(bag, weights=(v * v).sum(1), minlength=n)
    return model["w0"] + np.bincount(bag, weights=model["w"][flat], minlength=n) + 0.5 * ((s * s).sum(1) - q), s


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradient(model: dict, flat: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss."""
    margin, s = fm(model, flat, bag, len(y))
    d = (sigmoid(margin) - y) / len(y)
    own = d[bag]
    return {"w0": d.sum(), "w": np.bincount(flat, weights=own, minlength=len(model["w"])), "v": _sums(flat, own[:, None] * (s[bag] - model["v"][flat]), len(model["w"]))}


def fit(rows: list[np.ndarray], y: np.ndarray, n_terms: int, epochs: int = 30, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adagrad on the log loss."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(n_terms), "v": 0.05 * rng.standard_normal((n_terms, FACTORS))}
    if not rows:
        return model
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model["w0"] = float(np.log(p / (1 - p)))
    sums = {k: np.full_like(x, 1e-4) for k, x in model.items()}
    for _ in range(epochs if n_terms else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            some = [rows[j] for j in at]
            flat, bag = np.concatenate(some), np.repeat(np.arange(len(at)), [len(r) for r in some])
            for k, d in gradient(model, flat, bag, y[at]).items():
                d = d + (decay * model[k] if k != "w0" else 0)
                sums[k] = sums[k] + d * d
                model[k] = model[k] - rate * d / np.sqrt(sums[k])
    return model


def telling_alone(both: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Terms by their G-squared; ``both`` are their documents, ``toxic`` the toxic ones of these."""
    k1, k0, n1, n0 = toxic, both - toxic, n_toxic, n - n_toxic

    def share(k, of):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((k > 0) & (of > 0), k * np.log(k / of), 0.0)

    g2 = 2 * (share(k1, both * n1 / n) + share(k0, both * n0 / n) + share(n1 - k1, (n - both) * n1 / n) + share(n0 - k0, (n - both) * n0 / n))
    return np.flatnonzero((both >= LEAST) & (g2 >= TELLING))


def telling_in_pairs(rows: list[np.ndarray], y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Terms of pairs whose share of toxic documents is not what the two terms add up to."""
    top = np.lexsort((np.arange(len(both)), -both))[:PAIRED]
    top = np.sort(top[both[top] >= PAIR_LEAST])
    m, n, n1 = len(top), len(rows), float(y.sum())
    if not m or not 0 < n1 < n:
        return top[:0]
    place = np.full(len(both), -1)
    place[top] = np.arange(m)
    seen, toxic = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for i in range(0, n, 512):
        some = [place[r] for r in rows[i : i + 512]]
        x = np.zeros((len(some), m + 1), np.float32)
        x[np.repeat(np.arange(len(some)), [len(r) for r in some]), np.concatenate(some)] = 1  # -1: the last column, for other terms
        x = x[:, :m]
        seen += x.T @ x
        hit = x[y[i : i + 512] == 1]
        toxic += hit.T @ hit
    da, ta, spread = np.diag(seen).astype(float), np.diag(toxic).astype(float), n1 / n * (1 - n1 / n)
    found = np.zeros(m, bool)
    for i in range(0, m, 256):
        n11, t11 = seen[i : i + 256].astype(float), toxic[i : i + 256].astype(float)
        a, u = da[i : i + 256, None], ta[i : i + 256, None]
        cells = ((n11, t11, 1), (a - n11, u - t11, -1), (da - n11, ta - t11, -1), (n - a - da + n11, n1 - u - ta + t11, 1))
        enough = np.minimum.reduce([c for c, _, _ in cells]) >= PAIR_LEAST
        contrast = sum(sign * t / np.maximum(c, 1) for c, t, sign in cells)
        z2 = contrast**2 / (spread * sum(1 / np.maximum(c, 1) for c, _, _ in cells))
        found |= (enough & (z2 >= PAIR_TELLING)).any(0)
    return top[found]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> dict:
    """A model from ``bound`` labelled documents at most, fewer where they have more than :data:`SAMPLE_WORDS` words."""

    def run(batches):
        release_state()
        parts: dict[str, list[int]] = {}
        for b in slices(batches):
            got = []
            for words in _words(b.column(0).to_pylist()):
                if len(parts) > SEEN // 2:
                    parts.clear()
                for w in words:
                    if w not in parts:
                        parts[w] = terms_of(w)
                got.append(np.unique(np.fromiter((t for w in words for t in parts[w]), np.int32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column(1)], ["x", "y"])

    n, total = training_rows(docs, labels, label, bound, key, text).agg(F.count("*"), F.sum(n_words(F.col("text_")))).first()
    if n and total > SAMPLE_WORDS:
        bound = max(1, min(bound, n) * SAMPLE_WORDS // total)
    got = training_rows(docs, labels, label, bound, key, text).mapInArrow(run, "x binary, y int").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))  # the order of rows does not matter
    if not pairs:
        return {"place": {}, "w0": 0.0, "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    rows, y = [np.frombuffer(x, np.int32) for x, _ in pairs], np.array([float(t == 1) for _, t in pairs])
    both = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, t in zip(rows, y, strict=True) if t)]), minlength=BUCKETS)
    kept = np.union1d(telling_alone(both, toxic, len(y), int(y.sum())), telling_in_pairs(rows, y, both))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    active = [x[x >= 0] for x in (place[r] for r in rows)]
    return fit(active, y, len(kept)) | {"place": dict(zip(kept.tolist(), range(len(kept)), strict=True))}


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic."""
    docs = cleared(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release_state()
        m = shared.value
        hits = Hits(m["place"])
        for b in slices(batches):
            flat, bag = packed([hits.of(w) for w in _words(b.column(text).to_pylist())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(fm(m, flat, bag, b.num_rows)[0]), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
