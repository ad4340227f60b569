"""Text columns: tokens, sentences, cleaning, chunk packing. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
TERM = r"[a-zA-Z0-9][a-zA-Z0-9\-]*"
WORD = r"[a-zA-Z0-9]+"
METRIC_WORD = r"[a-zA-Z0-9\-]+"
CITATION = r"\[P(\d+)\]"

# Lines and marks that cleaning removes.
PAGE_LINES = (r"^\s*\d{1,4}\s*$", r"(?i)^\s*Page\s+\d+\s*$")
CAPTION_LINES = (r"(?i)^\s*(Figure|Fig\.|Table)\s+\d+[.\-]?\d*\s*.*$", r"^\s*(Chapter|CHAPTER)\s+\d+.*$")
INLINE_REFERENCE = r"\[\d+(?:,\s*\d+)*\]"
HYPHEN_BREAK = r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row; an expression inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def terms(text: Column) -> Column:
    """Lower-cased search terms, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def metric_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(METRIC_WORD), F.lit(0))


def squeeze(text: Column) -> Column:
    """Lower-cased, runs of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fix_hyphenation(text: Column) -> Column:
    return F.regexp_replace(text, HYPHEN_BREAK, "$1$2")


def drop_lines(text: Column, patterns: tuple[str, ...]) -> Column:
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~_any(x, patterns)), "\n")


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    out = x.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | x.rlike(p)
    return out


def strip_page_numbers(text: Column) -> Column:
    return drop_lines(text, PAGE_LINES)


def strip_captions(text: Column) -> Column:
    return drop_lines(text, CAPTION_LINES)


def strip_references(text: Column) -> Column:
    return F.regexp_replace(text, INLINE_REFERENCE, "")


def normalize_whitespace(text: Column) -> Column:
    out = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{2,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean(text: Column, running: Column | None = None) -> Column:
    """The cleaning steps in order; ``running`` is an array of stripped header and footer lines to drop first."""
    if running is not None:
        kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(running, F.regexp_replace(x, r"^\s+|\s+$", "")))
        text = F.when(F.size(running) > 0, F.array_join(kept, "\n")).otherwise(text)
    return normalize_whitespace(strip_references(strip_captions(strip_page_numbers(fix_hyphenation(text)))))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def chunk_sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` before a capital or digit; stripped, none empty."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])", -1)
    stripped = F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda s: s != "")


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?``."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.filter(F.split(stripped, r"(?<=[.!?])\s+", -1), lambda s: s != "")


# Headings that open a chunk of their own.
SECTION = r"(?i)^\s*(Diagnosis|Treatment|Prognosis|Risk Factors|Complications|Etiology|Pathophysiology|Clinical Features|Management|Epidemiology)\s*:?\s*$"


def pack_sentences(parts: Column, target: int) -> Column:
    """Greedy packing: a chunk closes before a sentence that would take it over ``target`` tokens, or that opens a section."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        tok = token_estimate(s)
        close = (acc["cur"] != "") & ((acc["n"] + tok > target) | s.rlike(SECTION))
        return F.struct(
            F.when(close, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(close | (acc["cur"] == ""), s).otherwise(F.concat_ws(" ", acc["cur"], s)).alias("cur"),
            F.when(close, tok).otherwise(acc["n"] + tok).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def split_children(parts: Column, target: int, overlap: int) -> Column:
    """Packed children; each but the first starts with the last ``4 * overlap`` characters of the one before."""
    raw = pack_sentences(parts, target)
    if not overlap:
        return raw
    return F.transform(raw, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.element_at(raw, i.cast("int")), F.lit(4 * overlap)), F.lit(" "), c)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def clean_answer(text: Column) -> Column:
    """Answer text: code fences and JSON unwrapped, a trailing confidence line dropped."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    answer = F.coalesce(F.get_json_object(inner, "$.answer"), inner)
    return F.regexp_replace(F.regexp_replace(answer, r"(?i)\s*Confidence:\s*(High|Medium|Low)\s*\.?\s*$", ""), r"^\s+|\s+$", "")


def confidence(text: Column) -> Column:
    got = F.regexp_extract(text, r"(?i)Confidence:\s*(High|Medium|Low)\s*\.?\s*$", 1)
    return F.when(got != "", F.initcap(F.lower(got)))
