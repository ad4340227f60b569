"""Calls of a language model, which may fail: in batches on executors, with attempts and an error for each row; and what is built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GenerationError

#: What a model gets at once: a function of prompts that gives a reply for each, or raises.
Call = Callable[[list[str]], list[str]]

# Fixed value: what a compressor says when it has found nothing.
NOTHING = "No relevant information found"


def called(rows: DataFrame, call: Call, prompt: str = "prompt", attempts: int = 3, wait: float = 2.0, longest: float = 10.0, batch: int = 16) -> DataFrame:
    """``rows`` with ``reply`` and ``error``. A batch that fails is tried again, after ``wait`` seconds and twice as long each time, ``longest`` at most; if all
    ``attempts`` fail, its rows are asked one by one, once, so that one bad prompt costs no other row its reply. A row that fails
    then has a null reply and the error's text. A null prompt isn't asked."""
    if attempts < 1 or batch < 1:
        raise GenerationError("at least one attempt, and one row in a batch")

    def asked(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        import time

        for k in range(attempts):
            try:
                replies = call(prompts)
                if len(replies) != len(prompts):
                    raise GenerationError(f"{len(replies)} replies to {len(prompts)} prompts")
                return [(None if r is None else str(r), None if r is not None else "no reply") for r in replies]
            except Exception as e:  # noqa: BLE001  a model may raise anything; the row says what
                error = f"{type(e).__name__}: {e}"
                if k + 1 < attempts and wait:
                    time.sleep(min(longest, wait * 2**k))
        if len(prompts) == 1:
            return [(None, error)]
        out = []
        for p in prompts:
            try:
                out.append((str(call([p])[0]), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"))
        return out

    def run(batches) -> Iterator:
        for pdf in batches:
            texts = pdf[prompt].tolist()
            replies: list[tuple[str | None, str | None]] = [(None, "no prompt")] * len(texts)
            there = [i for i, t in enumerate(texts) if isinstance(t, str)]
            for at in range(0, len(there), batch):
                some = there[at : at + batch]
                for i, r in zip(some, asked([texts[i] for i in some]), strict=True):
                    replies[i] = r
            yield pdf.assign(reply=[r for r, _ in replies], error=[e for _, e in replies])

    rows = rows.drop("reply", "error")
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))


def paraphrased(questions: DataFrame, call: Call, n: int = 2, **how) -> DataFrame:
    """``qid``, ``ordinal`` (from 1), ``variant``: up to ``n`` other wordings of each ``query``. A reply is a JSON list, or has one in it; one that has none, or no reply, gives no rows."""
    asked = questions.select("qid", F.concat(F.lit(f"Give {n} other wordings of the question, of the same meaning, as a JSON list of strings and nothing else.\n\nQuestion: "), "query").alias("prompt"))
    reply = F.col("reply")
    listed = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    items = F.from_json(F.when(listed != "", listed).otherwise(reply), T.ArrayType(T.StringType()), {"allowSingleQuotes": "false"})
    kept = F.slice(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), F.lit(1), F.lit(n))
    return called(asked, call, **how).select("qid", F.posexplode(kept).alias("at", "variant")).select("qid", (F.col("at") + 1).alias("ordinal"), "variant")


def hypothetical(questions: DataFrame, call: Call, ordinal: int = 100, **how) -> DataFrame:
    """``qid``, ``ordinal``, ``variant``: a passage that would answer each ``query``, to search with; no row where the model fails or says nothing."""
    asked = questions.select("qid", F.concat(F.lit("Write a passage of two to four sentences, as a textbook has it, that answers the question.\n\nQuestion: "), "query", F.lit("\n\nPassage:")).alias("prompt"))
    return called(asked, call, **how).select("qid", F.lit(ordinal).alias("ordinal"), F.trim("reply").alias("variant")).where(F.col("variant") != "")


def compressed(questions: DataFrame, ranked: DataFrame, call: Call, **how) -> DataFrame:
    """``ranked`` (qid, rank, id, text) with a question's passages in the words of the model as one, ``chunk`` compressed_01; the passages themselves,
    ``chunk`` their id, where the model fails, is silent or finds nothing. Questions without passages have no rows."""
    order = F.array_sort(F.collect_list(F.struct("rank", "text")))
    blocks = F.array_join(F.transform(order, lambda x, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n\n")
    asked = ranked.groupBy("qid").agg(blocks.alias("blocks_")).join(questions.select("qid", "query"), "qid")
    prompt = F.concat(F.lit("State only the facts in these passages that bear on the question.\n\n"), "blocks_", F.lit("\n\nQuestion: "), "query", F.lit("\n\nFacts:"))
    replies = called(asked.select("qid", prompt.alias("prompt")), call, **how)
    good = F.coalesce((F.trim("reply") != "") & ~F.col("reply").contains(NOTHING), F.lit(False))
    both = ranked.join(replies.select("qid", "reply", good.alias("good_")), "qid", "left").withColumn("good_", F.coalesce("good_", F.lit(False)))
    first = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    kept = both.withColumn("place_", first).where(~F.col("good_") | (F.col("place_") == 1))
    return kept.select("qid", F.when(F.col("good_"), 1).otherwise(F.col("place_")).alias("rank"), F.when(F.col("good_"), "compressed_01").otherwise(F.col("id").cast("string")).alias("chunk"), F.when(F.col("good_"), F.trim("reply")).otherwise(F.col("text")).alias("text"))
