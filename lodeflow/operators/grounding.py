"""Citations, sentence grounding, explainability, hallucination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GroundingError
from ..functions.text import CITATION, sentences, word_set


def cited(text: Column, pattern: str = CITATION) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def directional(a: Column, b: Column) -> Column:
    """Share of the first set's words that are in the second."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def check_citations(answers: DataFrame, evidence: DataFrame, least_valid: float = 0.8, least_overlap: float = 0.3) -> DataFrame:
    """``answers`` (aid, answer), ``evidence`` (aid, idx from 1, passage). Validity and overlap of cited passages, share of
    sentences without citation, and whether the answer is well grounded."""
    n = evidence.groupBy("aid").agg(F.count("*").alias("n_evidence"))
    rows = answers.join(n, "aid", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    parts = rows.select("aid", "n_evidence", F.explode_outer(sentences(F.col("answer"))).alias("sentence"))
    marks = parts.withColumn("cites", F.coalesce(cited(F.col("sentence")), F.array().cast("array<int>")))
    per = marks.groupBy("aid").agg(
        F.sum(F.size("cites")).alias("n_citations"),
        F.sum(F.size(F.filter("cites", lambda c: (c >= 1) & (c <= F.col("n_evidence"))))).alias("n_valid"),
        F.count("sentence").alias("n_sentences"),
        F.sum(((F.size("cites") == 0) & F.col("sentence").isNotNull()).cast("int")).alias("n_uncited"),
    )
    pairs = marks.select("aid", "sentence", F.explode("cites").alias("idx")).join(evidence, ["aid", "idx"])
    overlap = pairs.groupBy("aid").agg(F.avg(directional(word_set(F.col("sentence")), word_set(F.col("passage")))).alias("overlap"))
    out = per.join(overlap, "aid", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    validity = F.when(F.col("n_citations") > 0, F.col("n_valid") / F.col("n_citations")).otherwise(0.0)
    uncited = F.when(F.col("n_sentences") > 0, F.col("n_uncited") / F.col("n_sentences")).otherwise(1.0)
    return out.select("aid", "n_citations", "n_valid", F.round(validity, 4).alias("validity"), F.round("overlap", 4).alias("overlap"), F.round(uncited, 4).alias("uncited_ratio"), ((validity >= least_valid) & (F.col("overlap") >= least_overlap)).alias("well_grounded"))


def ground_sentences(answers: DataFrame, evidence: DataFrame, similarity=None, lexical: float = 0.4, semantic: float = 0.6, grounded: float = 0.65, partial: float = 0.45) -> DataFrame:
    """Per sentence of an answer, its best passage: ``aid``, ``ordinal``, ``sentence``, ``idx``, ``combined``, ``status``, ``origin``. ``similarity`` is
    a function of two text columns; where there is none, it is the cosine of the word sets."""
    if abs(lexical + semantic - 1) > 1e-6:
        raise GroundingError("the weights add up to 1")
    parts = answers.select("aid", F.posexplode(sentences(F.col("answer"))).alias("ordinal", "sentence")).withColumn("s_", word_set(F.col("sentence")))
    pairs = parts.join(evidence.withColumn("p_", word_set(F.col("passage"))), "aid", "left").withColumn("both_", F.size(F.array_intersect("s_", "p_")))
    n_s, n_p = F.size("s_"), F.size("p_")
    words = F.when(n_s == 0, 0.0).otherwise(F.col("both_") / n_s)
    cosine = F.when((n_s == 0) | (n_p == 0), 0.0).otherwise(F.col("both_") / F.sqrt(n_s * n_p))
    score = F.greatest(F.lit(0.0), lexical * words + semantic * (similarity(F.col("sentence"), F.col("passage")) if similarity else cosine))
    scored = pairs.withColumn("combined", F.when(F.col("idx").isNull(), 0.0).otherwise(F.round(score, 6))).drop("s_", "p_", "both_")
    order = Window.partitionBy("aid", "ordinal").orderBy(F.desc("combined"), "idx")
    best = scored.withColumn("place", F.row_number().over(order)).where("place = 1")
    has = F.size(cited(F.col("sentence"), r"P(\d+)")) > 0
    status = F.when(F.col("combined") >= grounded, "grounded").when(F.col("combined") >= partial, "partial").otherwise("unsupported")
    origin = F.when(has, "explicit").when(F.col("combined") >= partial, "inferred").otherwise("none")
    return best.select("aid", "ordinal", "sentence", "idx", "combined", status.alias("status"), origin.alias("origin"))


def grounding_report(scored: DataFrame) -> DataFrame:
    """Per answer: ``faithfulness``, ``grounded_ratio``, and the answer without unsupported sentences."""
    kept = F.array_sort(F.collect_list(F.when(F.col("status") != "unsupported", F.struct("ordinal", "sentence"))))
    out = scored.groupBy("aid").agg(F.avg("combined").alias("f"), F.avg((F.col("status") == "grounded").cast("double")).alias("g"), kept.alias("kept"))
    return out.select("aid", F.round("f", 4).alias("faithfulness"), F.round("g", 4).alias("grounded_ratio"), F.array_join(F.transform("kept", lambda x: x["sentence"]), " ").alias("cleaned_answer"))


def explain(scored: DataFrame) -> DataFrame:
    """Per answer and passage that supports something: its tag, how many sentences use it, the best score."""
    used = scored.where(F.col("origin") != "none")
    return used.groupBy("aid", "idx").agg(F.count("*").alias("n_sentences"), F.max("combined").alias("confidence")).select("aid", F.concat(F.lit("P"), F.col("idx").cast("string")).alias("tag"), "n_sentences", "confidence")


def explain_answers(scored: DataFrame, evidence: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """The whole trace of each answer: ``aid``, ``answer`` (without unsupported sentences), ``explanations`` (tag, position, chunk, source, page, sentences that use the passage, greatest score; in
    order of position), the lists ``unsupported``, ``low_confidence`` and ``uncited`` of sentences, and ``score``, the share of sentences that rest on a passage. A sentence rests on the passages it cites, if
    there are such, else on its best one. ``chunks`` (aid, idx, chunk_id, source, page) says where passages are from."""
    n = evidence.groupBy("aid").agg(F.count("*").alias("n_passages"))
    rows = scored.join(n, "aid", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
    valid = F.array_distinct(F.filter(cited(F.col("sentence"), r"P(\d+)"), lambda c: (c >= 1) & (c <= F.col("n_passages"))))
    rows = rows.withColumn("cites", valid).withColumn("used", F.when(F.size("cites") > 0, F.col("cites")).when(F.col("idx").isNotNull(), F.array(F.col("idx").cast("int"))).otherwise(F.array().cast("array<int>")))
    each = rows.select("aid", "ordinal", "sentence", "combined", F.explode("used").alias("idx")).groupBy("aid", "idx").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sentence"))).alias("s"), F.max("combined").alias("confidence"))
    at = each if chunks is None else each.join(chunks, ["aid", "idx"], "left")
    where = [F.lit(None).cast("string").alias(c) if chunks is None else F.col(c).cast("string").alias(c) for c in ("chunk_id", "source", "page")]
    one = F.struct(F.col("idx").alias("position"), F.concat(F.lit("P"), F.col("idx").cast("string")).alias("tag"), *where, F.transform("s", lambda x: x["sentence"]).alias("sentences"), "confidence")
    by = at.groupBy("aid").agg(F.array_sort(F.collect_list(one)).alias("explanations"))

    def listed(condition: Column, name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("ordinal", "sentence")))), lambda x: x["sentence"]).alias(name)

    out = rows.groupBy("aid").agg(
        F.array_join(listed(F.col("status") != "unsupported", "a"), " ").alias("answer"), listed(F.col("status") == "unsupported", "unsupported"), listed(F.col("status") == "partial", "low_confidence"), listed(F.size("cites") == 0, "uncited"),
        F.round(F.avg((F.size("used") > 0).cast("double")), 4).alias("score"),
    )
    return out.join(by, "aid", "left").withColumn("explanations", F.coalesce("explanations", F.filter(F.array(F.lit(None).cast(by.schema["explanations"].dataType.elementType)), lambda x: F.lit(False))))


def hallucination(checked: DataFrame) -> DataFrame:
    """Over checked answers: rate, mean validity, overlap and uncited share; zeros where there is none."""
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return checked.agg(
        F.count("*").alias("n"), z(1 - F.avg(F.col("well_grounded").cast("double"))).alias("hallucination_rate"), z(F.avg("validity")).alias("mean_validity"), z(F.avg("overlap")).alias("mean_overlap"), z(F.avg("uncited_ratio")).alias("mean_uncited")
    )
