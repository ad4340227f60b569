"""Paired tests, corrections, agreement and summaries, as aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvaluationError
from ..functions import tails
from .ordering import running_total
from .storage import settle

#: Distinct values of a group that a resample is drawn from in one task.
BLOCK = 4_096


def usable(c: Column) -> Column:
    """A metric as a number; "", "N/A", and what is no number are missing."""
    text = F.trim(c.cast("string"))
    return F.when(text.isin("", "N/A"), None).otherwise(text.try_cast("double"))


def align(base: DataFrame, other: DataFrame, key: str = "id", value: str = "value", strict: bool = True) -> DataFrame:
    """``key``, ``base``, ``other``: pairs with a value on both sides. ``strict``: repeated ids or missing values of the baseline, or no pair, are errors."""
    left = base.select(F.col(key), usable(F.col(value)).alias("base"))
    right = other.select(F.col(key), usable(F.col(value)).alias("other"))
    if strict:
        n, ids, missing = left.agg(F.count("*"), F.countDistinct(key), F.sum(F.col("base").isNull().cast("int"))).first()
        if n != ids:
            raise EvaluationError("an id is repeated in the baseline")
        if missing:
            raise EvaluationError("the baseline has a value that is no number")
    out = left.join(right, key).where(F.col("base").isNotNull() & F.col("other").isNotNull())
    if strict and out.isEmpty():
        raise EvaluationError("no id is in both samples")
    return out


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by``: ``n`` pairs, ``n_nonzero``, ``w`` (the lesser rank sum, average ranks for ties), ``z`` (normal, without tie correction) and the
    two-sided ``p``: exact for up to :data:`tails.EXACT` pairs without ties or zeros, else normal with tie correction. A group
    without differences has ``w`` and ``z`` 0 and ``p`` 1."""
    d = pairs.withColumn("d", F.round(F.col("base") - F.col("other"), 9)).withColumn("m", F.abs("d"))
    sizes = d.groupBy(*by, "m").agg(F.count("*").alias("ties"), F.sum((F.col("d") > 0).cast("int")).alias("up"))
    order = Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("m") > 0
    ranked = sizes.withColumn("rank", F.coalesce(F.sum(F.when(apart, F.col("ties"))).over(order), F.lit(0)) + (F.col("ties") + 1) / 2)
    some = lambda c: F.coalesce(F.sum(F.when(apart, c)), F.lit(0))
    ties = F.col("ties")
    per = ranked.groupBy(*by).agg(
        F.sum("ties").alias("n"), some(ties).alias("n_nonzero"), some(F.col("rank") * F.col("up")).alias("plus"), some(F.col("rank") * (ties - F.col("up"))).alias("minus"),
        some((ties * ties * ties - ties).cast("double")).alias("tied"),
    )
    n, w = F.col("n_nonzero").cast("double"), F.least("plus", "minus")
    shift, spread = w - n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    exact = (n <= tails.EXACT) & (F.col("n") == F.col("n_nonzero")) & (F.col("tied") == 0)
    p = F.when(n == 0, 1.0).when(exact, tails.signed_rank_two_sided(w, F.when(exact, F.col("n_nonzero")).otherwise(0))).otherwise(tails.normal_two_sided(shift / F.sqrt(spread - F.col("tied") / 48)))
    return per.select(*by, "n", "n_nonzero", w.cast("double").alias("w"), F.round(F.when(n == 0, 0.0).otherwise(shift / F.sqrt(spread)), 6).alias("z"), p.alias("p"))


def paired_t(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by``: ``n``, ``mean_difference``, ``t`` and the two-sided ``p``; the last two are null where differences don't vary."""
    d = pairs.withColumn("d", F.col("base") - F.col("other")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    d = d.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))
    return d.select(*by, "n", F.round("mean", 6).alias("mean_difference"), F.round("t", 6).alias("t"), tails.t_two_sided(F.col("t"), F.col("n") - 1).alias("p"))


def judged(tests: DataFrame, by: list[str], score: Column, family: list[str] | None = None) -> DataFrame:
    """A table of tests with ``p`` gets ``adjusted`` (over a family of groups; all of them, if none is named), ``effect`` (:func:`effect_size` of
    ``score`` and ``n``), ``flag`` and what it says. Probabilities are rounded to 6 decimals."""
    out = holm(tests.withColumn("p", F.round("p", 6)), family or [], tie=by).withColumn("adjusted", F.round("adjusted", 6))
    return out.withColumn("effect", F.round(effect_size(score, F.col("n")), 6)).withColumn("flag", flag(F.col("adjusted")))


def holm(tests: DataFrame, by: list[str], p: str = "p", tie: list[str] | None = None) -> DataFrame:
    """Adds ``adjusted``: the step-down correction within a group of ``by``; equal ones in order of ``tie``, else of all other columns."""
    order = Window.partitionBy(*by).orderBy(p, *(tie or [c for c in tests.columns if c != p and c not in by]))
    stepped = tests.withColumn("step_", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(order) + 1)))
    return stepped.withColumn("adjusted", F.max("step_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step_")


def flag(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def effect_size(z: Column, n: Column) -> Column:
    return F.abs(z) / F.sqrt(n)


def percentage_change(base: Column, new: Column) -> tuple[Column, Column]:
    """Difference, and change in percent of the baseline (0 where that is 0)."""
    return new - base, F.when(base != 0, (new - base) / base * 100).otherwise(0.0)


def kappa(pairs: DataFrame, a: str, b: str, bins: int = 5) -> DataFrame:
    """Quadratically weighted agreement of two scores from 0 to 1, in bins (rounded half to even)."""
    bin_ = lambda c: F.least(F.lit(bins), F.greatest(F.lit(1), F.bround(F.col(c) * (bins - 1) + 1, 0).cast("int")))
    rows = pairs.select(bin_(a).alias("x"), bin_(b).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    mx, my = rows.groupBy("x").agg(F.sum("n").alias("nx")), rows.groupBy("y").agg(F.sum("n").alias("ny"))
    seen = rows.agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("y"), 2)).alias("seen"), F.sum("n").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    due = mx.join(F.broadcast(my), F.lit(True)).agg(F.sum(F.col("nx") * F.col("ny") * F.pow(F.col("x") - F.col("y"), 2)).alias("due"))  # bins x bins rows
    both = seen.join(due, F.lit(True))
    constant = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    value = F.when(F.col("n").isNull(), 0.0).when(constant, (F.col("x0") == F.col("y0")).cast("double")).when(F.col("due") > 0, 1 - F.col("seen") * F.col("n") / F.col("due")).otherwise(0.0)
    return both.select(F.round(value, 6).alias("kappa"))


def correlations(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pearson``, and ``spearman`` with average ranks. Ranks come from counts by distinct value."""
    def ranks(c: str, name: str) -> DataFrame:
        counts = running_total(pairs.groupBy(c).agg(F.count("*").alias("k")), [c], F.col("k"), "before")
        return counts.select(c, (F.col("before") + (F.col("k") + 1) / 2).alias(name))

    rows = pairs.select(a, b).join(ranks(a, "ra"), a).join(ranks(b, "rb"), b)
    return rows.agg(F.round(F.corr(a, b), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


def summary(evals: DataFrame, by: list[str], value: str = "value", share: float = 0.95) -> DataFrame:
    """``n``, ``mean``, ``std`` (of the population), ``median`` and the ends of the mean's interval by Student's t (``lower``, ``upper``; null for one
    value) per group, 4 decimals."""
    r4 = lambda c: F.round(c, 4)
    got = evals.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_"), F.stddev_samp(value).alias("sd_"), r4(F.stddev_pop(value)).alias("std"), r4(F.percentile(value, 0.5)).alias("median")
    )
    reach = F.when(F.col("n") > 1, tails.t_quantile(share, F.col("n") - 1) * F.col("sd_") / F.sqrt("n"))
    return got.withColumn("reach_", reach).select(*by, "n", r4(F.col("mean_")).alias("mean"), "std", "median", r4(F.col("mean_") - F.col("reach_")).alias("lower"), r4(F.col("mean_") + F.col("reach_")).alias("upper"))


def pivot_metrics(summaries: DataFrame, metrics: list[str], by: str = "condition", metric: str = "metric", value: str = "mean") -> DataFrame:
    return summaries.groupBy(by).pivot(metric, metrics).agg(F.first(value))


def bootstrap(evals: DataFrame, by: list[str], value: str = "value", times: int = 1000, share: float = 0.95, seed: int = 42) -> DataFrame:
    """``lower`` and ``upper`` of the mean by percentile bootstrap. Equal values of a group are counted, and its values dealt to blocks of
    about :data:`BLOCK`. How many of a resample's draws fall to each block is multinomial, and so within a block: the draws are those
    of the whole group, which meets in no task. A block returns one sum for each resample. A group without values gives 0."""
    name = F.xxhash64(F.lit(seed), *by)
    groups = evals.groupBy(*by).agg(F.ceil(F.approx_count_distinct(value) / BLOCK).cast("int").alias("blocks_"))
    same = reduce(lambda x, y: x & y, [F.col(f"e.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]) if by else F.lit(True)
    counts = evals.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("value_")).agg(F.count("*").alias("count_"))
    dealt = counts.alias("e").join(groups.alias("g"), same).select("e.*", F.pmod(F.xxhash64("value_"), "blocks_").cast("int").alias("block_")).withColumn("group_", name)
    dealt = settle(dealt.select("group_", "block_", "value_", "count_"))
    sizes = dealt.groupBy("group_", "block_").agg(F.sum("count_").alias("size_")).groupBy("group_").agg(F.array_sort(F.collect_list(F.struct("block_", "size_"))).alias("sizes_"))

    def run(key, left, right):
        import numpy as np
        import pandas as pd

        left = left.sort_values("value_")
        group, block = int(key[0]), int(key[1])
        blocks = {int(r["block_"]): int(r["size_"]) for r in right["sizes_"].iloc[0]}
        n = sum(blocks.values())
        at = sorted(blocks).index(block)
        draws = np.random.default_rng([seed, group & (1 << 64) - 1]).multinomial(n, np.array([blocks[b] for b in sorted(blocks)]) / n, size=times)[:, at]
        x, p = left["value_"].to_numpy(), left["count_"].to_numpy() / left["count_"].sum()
        rng = np.random.default_rng([seed, group & (1 << 64) - 1, block + 1])
        sums = [float(rng.multinomial(k, p) @ x) for k in draws]
        return pd.DataFrame({"group_": [group] * times, "resample_": range(times), "sum_": sums, "n_": [n] * times})

    each = sizes.select("group_", F.explode("sizes_.block_").alias("block_"), "sizes_")
    parts = dealt.groupBy("group_", "block_").cogroup(each.groupBy("group_", "block_")).applyInPandas(run, "group_ long, resample_ int, sum_ double, n_ long")
    total = F.aggregate(F.array_sort(F.collect_list("sum_")), F.lit(0.0), lambda a, x: a + x)  # in order: the same on every run
    means = parts.groupBy("group_", "resample_").agg((total / F.first("n_")).alias("mean_"))
    ends = means.groupBy("group_").agg(F.percentile("mean_", (1 - share) / 2).alias("lower"), F.percentile("mean_", (1 + share) / 2).alias("upper"))
    return groups.withColumn("group_", name).join(ends, "group_", "left").select(*by, F.coalesce("lower", F.lit(0.0)).alias("lower"), F.coalesce("upper", F.lit(0.0)).alias("upper"))


def classify_errors(evals: DataFrame, least: float = 0.85) -> DataFrame:
    """Rows whose first metric below ``least`` names a failure: ``precision``, ``faithfulness``, then ``relevance``."""
    kind = F.when(F.col("precision") < least, "Retrieval/Deduplication Failure").when(F.col("faithfulness") < least, "Grounding/NLI Failure").when(F.col("relevance") < least, "Generation/Intent Failure")
    return evals.withColumn("failure", kind).where(F.col("failure").isNotNull())
