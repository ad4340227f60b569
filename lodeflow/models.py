"""Interfaces of models, and deterministic stand-ins that need none. The stand-ins are labelled as such: their
scores are not those of a learned model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import let, terms, word_set
from .operators import answers, calls, entities


class Encoder(Protocol):
    """Text to a normalised vector, ``array<double>``."""

    def documents(self, text: Column) -> Column: ...

    def query(self, text: Column) -> Column: ...


class Extractor(Protocol):
    """Chunks (chunk_id, text) to mentions (chunk_id, sentence, ordinal, start, length, surface, entity). One that also has ``sentences``, as :class:`GazetteerExtractor`, spares a shuffle of
    mentions for each walk."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


class PairScorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    """Prompts with the ranked passages behind them (qid, prompt, best) to answers (qid, answer)."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


class HashEncoder:
    """Terms hashed into ``dim`` signed counts, of length 1. Built-in expressions only: a term is a letter for its slot and sign, and letters are counted
    by native passes over the string that they make, not by a fold that goes over all slots for each term."""

    def __init__(self, dim: int = 64, instruction: str = ""):
        self.dim, self.instruction = dim, instruction

    def documents(self, text: Column) -> Column:
        letters = [chr(256 + i) for i in range(2 * self.dim)]
        letter = lambda h: F.element_at(F.array(*map(F.lit, letters)), (2 * F.pmod(h, F.lit(self.dim)) + F.when(h.bitwiseAND(F.lit(1 << 40)) == 0, 1).otherwise(2)).cast("int"))
        count = lambda s, x: F.char_length(s) - F.char_length(F.replace(s, x, F.lit("")))
        slots = F.array(*[F.struct(F.lit(letters[2 * i]).alias("up"), F.lit(letters[2 * i + 1]).alias("down")) for i in range(self.dim)])
        counts = lambda s: F.transform(slots, lambda x: (count(s, x["up"]) - count(s, x["down"])).cast("double"))
        return unit(let(F.array_join(F.transform(terms(F.coalesce(text, F.lit(""))), lambda t: letter(F.xxhash64(t))), ""), counts))

    def query(self, text: Column) -> Column:
        return self.documents(F.concat(F.lit(self.instruction), text))


def unit(v: Column) -> Column:
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y))
    return let(v, lambda x: let(F.struct(x.alias("v"), norm(x).alias("n")), lambda p: F.transform(p["v"], lambda y: F.when(p["n"] > 0, y / p["n"]).otherwise(0.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class GazetteerExtractor:
    """Finds the terms of a table ``entity``; without one, of the chunks' own rare long words."""

    def __init__(self, gazetteer: DataFrame | None = None):
        self.gazetteer = gazetteer

    def __call__(self, chunks: DataFrame) -> DataFrame:
        return entities.own_mentions(chunks) if self.gazetteer is None else entities.mentions(chunks, self.gazetteer)

    def sentences(self, chunks: DataFrame) -> DataFrame | None:
        """Mentions in the rows of their sentences, as :func:`entities.own_sentences` has them; None with a given table."""
        return entities.own_sentences(chunks) if self.gazetteer is None else None


def lexical_scorer(query: Column, text: Column) -> Column:
    """Share of the query's words that a passage has."""
    q, t = word_set(query), word_set(text)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def extractive_generator(prompts: DataFrame) -> DataFrame:
    return prompts.select("qid", answers.extractive_answer(F.col("best")).alias("answer"))


def paraphrases(queries: DataFrame, generate=None) -> DataFrame:
    """Query variants (qid, ordinal, variant): the query itself, then what ``generate`` (a function of the table) adds, if given. :func:`expansions` makes such
    a function of a model."""
    own = queries.select("qid", F.lit(0).alias("ordinal"), F.col("query").alias("variant"))
    return own if generate is None else own.unionByName(generate(queries))


def expansions(call: calls.Call, wordings: int = 2, passage: bool = True, **how):
    """What adds other wordings of a query, and a passage that would answer it. Where the model fails, a query has fewer variants."""
    def generate(queries: DataFrame) -> DataFrame:
        said = calls.paraphrased(queries, call, wordings, **how)
        return said.unionByName(calls.hypothetical(queries, call, **how)) if passage else said

    return generate
