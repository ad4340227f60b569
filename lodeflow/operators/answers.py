"""Evidence blocks, prompts, an extractive generator, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GenerationError

# The answer when evidence doesn't suffice, and the mark of an unsupported claim.
INSUFFICIENT = "The retrieved documents do not contain sufficient information to answer this question."
UNSUPPORTED = " (low confidence — not directly supported by retrieved evidence)"
# The start of the built-in generator's answer, and the answer that a JSON prompt asks for when evidence doesn't suffice.
STARTS = "According to retrieved medical documentation: "
REFUSAL = "I could not find sufficient information in the uploaded medical documents to answer this question."


def evidence_block(ranked: DataFrame) -> DataFrame:
    """``ranked`` (qid, rank, text, source, page): per query ``evidence``, one numbered passage after another."""
    line = F.concat(F.lit("[P"), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("source", F.lit("unknown source")), F.lit(", p."), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("): "), F.trim("text"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("evidence"), F.count("*").alias("n_passages"))


def prompts(questions: DataFrame, ranked: DataFrame, template: str = "Question: {question}\n\nEvidence:\n{evidence}\n\nAnswer with [Pn] citations.", strict: bool = True) -> DataFrame:
    """``qid``, ``prompt``. ``strict``: a question without passages is an error."""
    both = questions.join(evidence_block(ranked), "qid", "left")
    if strict and not both.where(F.col("evidence").isNull()).isEmpty():
        raise GenerationError("a prompt needs passages")
    out = F.replace(F.replace(F.lit(template), F.lit("{question}"), F.col("question")), F.lit("{evidence}"), F.col("evidence"))
    return both.where(F.col("evidence").isNotNull()).select("qid", out.alias("prompt"))


RULES = (
    "Answer from the numbered passages alone, in your own words. Keep numbers, doses, stages and names as they stand. Do not state what no passage says, and name every passage that you rest on. If the "
    "passages do not answer the question, the answer is exactly: " + REFUSAL + "\nReply with one JSON object and nothing else, of this form:\n"
)


def citation_prompts(questions: DataFrame, ranked: DataFrame, most: int | None = None) -> DataFrame:
    """``qid``, ``system``, ``user``, ``ids``: a pair of prompts that ask for a JSON object with ``id``, ``question``, ``answer`` and ``sources``. ``ranked`` has qid, rank, id and text. Passages are taken in order of rank
    while their blocks have ``most`` characters together, the first in any case, and numbered anew; ``ids`` are theirs, in that order, to check sources
    by. Questions without passages have no row."""
    order = Window.partitionBy("qid").orderBy("rank")
    rows = ranked.withColumn("size_", F.char_length(F.coalesce("text", F.lit(""))) + 6).withColumn("upto_", F.sum("size_").over(order)).withColumn("n_", F.row_number().over(order))
    kept = rows if most is None else rows.where((F.col("upto_") <= most) | (F.col("n_") == 1))
    block = F.concat(F.lit("[P"), F.col("n_").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    packed = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("n_"), block.alias("block"), F.col("id")))).alias("ps"))
    both = questions.join(packed, "qid")
    form = F.to_json(F.struct(F.col("qid").cast("string").alias("id"), F.col("question"), F.lit("...").alias("answer"), F.array(F.lit("P1")).alias("sources")))
    user = F.concat(F.lit("Question:\n"), "question", F.lit("\n\nPassages:\n"), F.array_join(F.transform("ps", lambda p: p["block"]), "\n\n"))
    return both.select("qid", F.concat(F.lit(RULES), form).alias("system"), user.alias("user"), F.transform("ps", lambda p: p["id"]).alias("ids"))


def cited_sources(replies: DataFrame, prompts_: DataFrame) -> DataFrame:
    """``replies`` (qid, reply) to :func:`citation_prompts`: ``qid``, ``answer``, ``ids`` of the passages that ``sources`` names, ``unknown`` names, and ``refused``. A reply that is no JSON object has a null answer."""
    got = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "answer string, sources array<string>", {"allowSingleQuotes": "false"})
    rows = replies.join(prompts_.select("qid", F.col("ids").alias("all_")), "qid").withColumn("got_", got)
    names = F.coalesce("got_.sources", F.array().cast("array<string>"))
    number = lambda s: F.regexp_extract(s, r"^\s*P(\d{1,6})\s*$", 1).try_cast("int")
    known = lambda s: F.coalesce((number(s) >= 1) & (number(s) <= F.size("all_")), F.lit(False))
    return rows.select(
        "qid", F.trim("got_.answer").alias("answer"), F.array_distinct(F.transform(F.filter(names, known), lambda s: F.get("all_", number(s) - 1))).alias("ids"), F.filter(names, lambda s: ~known(s)).alias("unknown"),
        F.coalesce(F.trim("got_.answer") == REFUSAL, F.lit(False)).alias("refused"),
    )


def extractive_answer(best_text: Column) -> Column:
    """The built-in generator: the start of the best passage, cited."""
    return F.concat(F.lit(STARTS), F.left(best_text, F.lit(200)), F.lit(" [P1]"))


def assemble(claims: DataFrame, low: bool = True) -> DataFrame:
    """``claims`` (aid, ordinal, text, evidence_ids, confidence, grounded): the text of each answer. Ungrounded claims go unless their confidence is low; unsupported ones get a mark."""
    marks = F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("["), e, F.lit("]"))), "")
    shown = F.when((~F.coalesce("grounded", F.lit(True))) & (F.col("confidence") != "low"), None)
    shown = shown.when(F.col("confidence") == "unsupported", F.concat("text", F.lit(UNSUPPORTED)) if low else None).otherwise(F.trim(F.concat("text", F.lit(" "), marks)))
    lines = F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("ordinal", shown.alias("line")))))
    return claims.groupBy("aid").agg(F.array_join(F.transform(lines, lambda x: x["line"]), " ").alias("answer"))
