"""Answers as lists of claims: parsing of replies, a check of each claim against what it cites, and a bounded retry of the answers that fail it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GenerationError
from ..functions.text import word_set
from .grounding import directional
from .storage import settle

PAYLOAD = "claims array<struct<text string, evidence_ids array<string>, confidence string>>, unanswerable_aspects array<string>, bad_ string"
CLAIMS = "array<struct<ordinal:int,text:string,evidence_ids:array<string>,confidence:string>>"


def _object(text: Column) -> Column:
    """A reply's payload, null where the text is no JSON object."""
    got = F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_", "allowSingleQuotes": "false"})
    return F.when(text.startswith("{") & got.isNotNull() & got["bad_"].isNull(), got)


def parsed(replies: DataFrame) -> DataFrame:
    """``replies`` (aid, reply) with ``claims`` (ordinal, text, evidence_ids, confidence), ``unanswerable`` and ``parse_failed``. The payload is the whole reply, else
    what is fenced in it, else what stands between its first and its last brace. A reply without a payload, a null one too, has no claims. A missing
    confidence is ``low``."""
    reply = F.trim(F.coalesce("reply", F.lit("")))
    ways = [reply, F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(reply, r"(?s)\{.*\}", 0)]
    rows = replies.withColumn("found_", F.coalesce(*map(_object, ways)))
    claims = F.transform(
        F.coalesce("found_.claims", F.array().cast("array<struct<text:string,evidence_ids:array<string>,confidence:string>>")),
        lambda c, i: F.struct(i.alias("ordinal"), F.trim(F.coalesce(c["text"], F.lit(""))).alias("text"), F.coalesce(c["evidence_ids"], F.array().cast("array<string>")).alias("evidence_ids"), F.coalesce(c["confidence"], F.lit("low")).alias("confidence")),
    )
    return rows.select(*replies.columns, claims.cast(CLAIMS).alias("claims"), F.coalesce("found_.unanswerable_aspects", F.array().cast("array<string>")).alias("unanswerable"), F.col("found_").isNull().alias("parse_failed"))


def supported(claims: DataFrame, evidence: DataFrame, least: float = 0.3) -> DataFrame:
    """``claims`` (aid, ordinal, text, evidence_ids, confidence) with ``grounded``: whether a cited passage of ``evidence`` (aid, eid, passage) has ``least`` of the
    claim's words. A claim that says it is unsupported and cites nothing is not judged."""
    cited = claims.select("aid", "ordinal", "text", F.explode(F.array_distinct("evidence_ids")).alias("eid")).join(evidence, ["aid", "eid"])
    best = cited.groupBy("aid", "ordinal").agg(F.max(directional(word_set(F.col("text")), word_set(F.col("passage")))).alias("best_"))
    disclosed = (F.col("confidence") == "unsupported") & (F.size("evidence_ids") == 0)
    return claims.join(best, ["aid", "ordinal"], "left").withColumn("grounded", F.when(~disclosed, F.coalesce(F.col("best_") >= least, F.lit(False)))).drop("best_")


def correction(prompt: Column, claims: Column) -> Column:
    """The prompt again, with the claims that were not found in what they cite."""
    lines = F.transform(F.filter(claims, lambda c: F.coalesce(~c["grounded"], F.lit(False))), lambda c: F.concat(F.lit('- "'), c["text"], F.lit('" (cited '), F.array_join(c["evidence_ids"], ", "), F.lit(")")))
    return F.concat(
        prompt, F.lit("\n\nThese claims of the last answer are not supported by the passages they cite:\n"), F.array_join(lines, "\n"),
        F.lit("\nAnswer again. Cite passages that do support a claim, or set its confidence to \"unsupported\" and cite none. Add no other claims. Reply with the JSON object only."),
    )


def _checked(replies: DataFrame, evidence: DataFrame, check: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """aid, reply, claims with ``grounded``, n_claims, n_ungrounded, share, unanswerable, parse_failed."""
    rows = settle(parsed(replies.select("aid", "reply")))
    each = check(rows.select("aid", F.inline("claims")), evidence)
    no = (~F.coalesce("grounded", F.lit(True))).cast("int")
    per = each.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text", "evidence_ids", "confidence", "grounded"))).alias("judged_"), F.count("*").alias("n_claims"), F.sum(no).alias("n_ungrounded"))
    none = F.array().cast("array<struct<ordinal:int,text:string,evidence_ids:array<string>,confidence:string,grounded:boolean>>")
    out = rows.drop("claims").join(per, "aid", "left")
    n, bad = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_claims", "n_ungrounded"))
    return out.select("aid", "reply", F.coalesce("judged_", none).alias("claims"), n.alias("n_claims"), bad.alias("n_ungrounded"), F.when(n > 0, bad / n).otherwise(0.0).alias("share"), "unanswerable", "parse_failed")


def answered(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], evidence: DataFrame, check: Callable[[DataFrame, DataFrame], DataFrame] = supported, threshold: float = 0.2, turns: int = 1) -> DataFrame:
    """``prompts`` (aid, prompt) to ``aid``, ``claims``, ``n_claims``, ``n_ungrounded``, ``unanswerable``, ``parse_failed``, ``retried`` (how often it was asked again). ``ask`` gives replies (aid, reply) to
    prompts. Only answers with more than a ``threshold`` of their claims ungrounded are asked again, ``turns`` times at most; a new answer is taken
    if it has claims and is no worse."""
    if turns < 0 or not 0 <= threshold <= 1:
        raise GenerationError("turns are not negative, and the threshold is a share")
    state = settle(_checked(ask(prompts.select("aid", "prompt")), evidence, check).withColumn("retried", F.lit(0)))
    for _ in range(turns):
        failing = F.col("share") > threshold
        again = state.where(failing).join(prompts, "aid").select("aid", correction(F.col("prompt"), F.col("claims")).alias("prompt"))
        if again.isEmpty():
            break
        new = _checked(ask(again), evidence, check)
        own = [c for c in new.columns if c != "aid"]
        both = state.join(new.select("aid", F.struct(*own).alias("new_")), "aid", "left")
        taken = F.coalesce((F.col("new_.n_claims") > 0) & (F.col("new_.share") <= F.col("share")), F.lit(False))
        state = settle(both.select("aid", *[F.when(taken, F.col(f"new_.{c}")).otherwise(F.col(c)).alias(c) for c in own], (F.col("retried") + failing.cast("int")).alias("retried")))
    return state.drop("share", "reply")
