"""Text-overlap metrics of two strings, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import metric_words


def grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def numbered(ordered: Column) -> Column:
    """Of sorted words: each with its place among equal ones, so that a multiset becomes a set."""
    return F.transform(ordered, lambda x, i: F.concat(x, F.lit("\0"), (i - F.array_position(ordered, x)).cast("string")))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets: of each distinct gram the lesser count."""
    return F.size(F.array_intersect(numbered(F.array_sort(a)), numbered(F.array_sort(b))))


def f1(hits: Column, n_a: Column, n_b: Column) -> Column:
    return F.when((n_a == 0) | (n_b == 0) | (hits == 0), 0.0).otherwise(2.0 * hits / (n_a + n_b))


def scores(pairs, candidate: str, reference: str):
    """``pairs`` with ``answer_f1``, ``rouge1``, ``rouge2``, ``meteor``, ``bleu1``, ``bleu2``, ``bleu4``. Words, grams and
    their shared counts are columns of their own, so that each is computed once for a row and not in every lambda."""
    rows = pairs.withColumn("a1_", metric_words(F.col(candidate))).withColumn("b1_", metric_words(F.col(reference)))
    rows = rows.withColumns({f"{x}{n}_": grams(F.col(f"{x}1_"), n) for x in "ab" for n in (2, 3, 4)})
    sets = [f"{x}{n}_" for x in "ab" for n in (1, 2, 3, 4)]
    rows = rows.withColumns({f"s{c}": F.array_sort(c) for c in sets})
    rows = rows.withColumns({f"m{c}": numbered(F.col(f"s{c}")) for c in sets})
    rows = rows.withColumns({f"h{n}_": F.size(F.array_intersect(f"ma{n}_", f"mb{n}_")) for n in (1, 2, 3, 4)})
    n_a, n_b, hits = F.size("a1_"), F.size("b1_"), F.col("h1_")
    p, r = hits / n_a, hits / n_b
    none = (n_a == 0) | (n_b == 0) | (hits == 0)
    meteor_ = F.when(none, 0.0).otherwise(10 * p * r / (r + 9 * p) * (1 - 0.5 * F.pow(1 / hits, 3)))

    def bleu_(n: int) -> Column:
        logs = F.lit(0.0)
        for k in range(1, n + 1):
            logs = logs + F.ln(F.when(F.col(f"h{k}_") == 0, 0.1).otherwise(F.col(f"h{k}_").cast("double")) / F.greatest(F.lit(1), F.size(f"a{k}_"))) / n
        return F.when(none, 0.0).otherwise(F.exp(logs + F.when(n_a >= n_b, 0.0).otherwise(1 - n_b / n_a)))

    out = {"answer_f1": f1(hits, n_a, n_b), "rouge1": f1(hits, n_a, n_b), "rouge2": f1(F.col("h2_"), F.size("a2_"), F.size("b2_")), "meteor": meteor_, "bleu1": bleu_(1), "bleu2": bleu_(2), "bleu4": bleu_(4)}
    return rows.withColumns(out).drop(*sets, *[f"{k}{c}" for k in "sm" for c in sets], *[f"h{n}_" for n in (1, 2, 3, 4)])


def answer_f1(candidate: Column, reference: Column) -> Column:
    a, b = metric_words(candidate), metric_words(reference)
    return f1(shared(a, b), F.size(a), F.size(b))


def rouge_n(candidate: Column, reference: Column, n: int) -> Column:
    a, b = grams(metric_words(candidate), n), grams(metric_words(reference), n)
    return f1(shared(a, b), F.size(a), F.size(b))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one fold over ``a``, with a row of the table as state."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        first = F.struct(F.array(F.lit(0)).alias("row"), F.lit(1).alias("i"))

        def cell(acc: Column, y: Column) -> Column:
            diagonal, above, left = F.element_at(prev, acc["i"]), F.element_at(prev, acc["i"] + 1), F.element_at(acc["row"], -1)
            value = F.when(x == y, diagonal + 1).otherwise(F.greatest(above, left))
            return F.struct(F.concat(acc["row"], F.array(value)).alias("row"), (acc["i"] + 1).alias("i"))

        return F.aggregate(b, first, cell, lambda acc: acc["row"])

    return F.element_at(F.aggregate(a, zero, row), -1)


def rouge_l(candidate: Column, reference: Column) -> Column:
    a, b = metric_words(candidate), metric_words(reference)
    return f1(F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(lcs(a, b)), F.size(a), F.size(b))


def bleu(candidate: Column, reference: Column, n: int) -> Column:
    """Geometric mean of clipped precisions to order ``n``; a zero count becomes 0.1; with the brevity penalty."""
    a, b = metric_words(candidate), metric_words(reference)
    logs = F.lit(0.0)
    for k in range(1, n + 1):
        x, y = grams(a, k), grams(b, k)
        hits, total = shared(x, y), F.greatest(F.lit(1), F.size(x))
        logs = logs + F.ln(F.when(hits == 0, 0.1).otherwise(hits.cast("double")) / total) / n
    penalty = F.when(F.size(a) >= F.size(b), 0.0).otherwise(1 - F.size(b) / F.size(a))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (shared(a, b) == 0), 0.0).otherwise(F.exp(logs + penalty))


def meteor(candidate: Column, reference: Column) -> Column:
    """Unigram harmonic mean with recall weighed 9 to 1, and a penalty for one chunk."""
    a, b = metric_words(candidate), metric_words(reference)
    hits = shared(a, b)
    p, r = hits / F.size(a), hits / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (hits == 0), 0.0).otherwise(10 * p * r / (r + 9 * p) * (1 - 0.5 * F.pow(1 / hits, 3)))


def clinical_reliability(faithful: Column, grounded: Column, hallucinated: Column, semantic: Column, citation: Column) -> Column:
    raw = 0.3 * faithful + 0.3 * grounded + 0.2 * (1 - hallucinated) + 0.1 * semantic + 0.1 * citation
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
