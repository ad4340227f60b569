"""Tails of the normal, t and signed-rank distributions as columns: no Python runs for a row. Absolute errors are below 1e-8."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Signed-rank samples up to this size have their exact distribution, if nothing is tied or zero.
EXACT = 50
#: Degrees of freedom from which an expansion replaces the continued fraction.
MANY = 200
_STEPS = 100


def normal_two_sided(z: Column) -> Column:
    """The chance of a value at least as far from 0 as ``z``."""
    def near(x: Column) -> Column:  # a series of positive terms
        step = lambda s, n: let(s["term"] * 2 * x * x / (2 * n + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.struct(x.alias("term"), x.alias("sum")), step, lambda s: s["sum"])
        return 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * total

    def far(x: Column) -> Column:  # a continued fraction, from its end
        inner = F.aggregate(F.sequence(F.lit(_STEPS), F.lit(1)), x, lambda s, n: x + n / 2.0 / s)
        return F.exp(-x * x) / math.sqrt(math.pi) / inner

    return let(F.abs(z.cast("double")) / math.sqrt(2), lambda x: F.when(x.isNull(), None).when(x < 2, near(x)).otherwise(far(x)))


def _half_ratio(a: Column) -> Column:
    """ln of Gamma(a + 1/2) / Gamma(a): an expansion far out, and what lies between."""
    b = a + 20
    far = 0.5 * F.ln(b) - 1 / (8 * b) + 1 / (192 * b * b * b) - 1 / (640 * F.pow(b, F.lit(5)))
    return far + F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(0.0), lambda s, i: s + F.ln((a + i) / (a + i + 0.5)))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its end."""
    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + F.when(k % 2 == 1, odd).otherwise(even) / s

    return 1 / F.aggregate(F.sequence(F.lit(2 * _STEPS), F.lit(1)), F.lit(1.0), step)


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance of Student's t at least as far from 0 as ``t``."""
    def few(v: Column) -> Column:
        a, b, rest = v["df"] / 2, F.lit(0.5), v["t"] * v["t"] / (v["df"] + v["t"] * v["t"])
        x = v["df"] / (v["df"] + v["t"] * v["t"])
        front = F.exp(-a * F.log1p(v["t"] * v["t"] / v["df"]) + 0.5 * F.ln(rest) + _half_ratio(a) - 0.5 * math.log(math.pi))
        direct, turned = front * _fraction(x, a, b) / a, 1 - front * _fraction(rest, b, a) / b
        return F.when(v["t"] == 0, 1.0).when(x > (a + 1) / (a + b + 2), turned).otherwise(direct)

    def many(v: Column) -> Column:  # to a normal deviate
        a = v["df"] - 0.5
        y = a * F.log1p(v["t"] * v["t"] / v["df"])
        z = let(F.struct(y.alias("y"), (48 * a * a).alias("b")), lambda s: F.sqrt(s["y"]) * (1 + (s["y"] + 3 + (((-0.4 * s["y"] - 3.3) * s["y"] - 24) * s["y"] - 85.5) / (0.8 * s["y"] * s["y"] + 100 + s["b"])) / s["b"]))
        return normal_two_sided(z)

    both = F.struct(F.abs(t.cast("double")).alias("t"), df.cast("double").alias("df"))
    return let(both, lambda v: F.when(v["t"].isNull() | v["df"].isNull() | (v["df"] <= 0), None).when(v["df"] < MANY, few(v)).otherwise(many(v)))


def t_quantile(share: float, df: Column) -> Column:
    """The t that a share of the distribution lies within, on both sides, by halving an interval."""
    def halve(s: Column, _: Column) -> Column:
        return let((s["low"] + s["high"]) / 2, lambda mid: F.when(t_two_sided(mid, df) > 1 - share, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high"))))

    widest = F.struct(F.lit(0.0).alias("low"), F.lit(2.0 / (1 - share)).alias("high"))  # of one degree, the widest
    return F.when(df > 0, F.aggregate(F.sequence(F.lit(1), F.lit(52)), widest, halve, lambda s: (s["low"] + s["high"]) / 2))


def signed_rank_two_sided(w: Column, n: Column) -> Column:
    """Of the 2^n sign patterns of untied ranks, the share with a rank sum of ``w`` at most, twice. For ``n`` up to :data:`EXACT`."""
    def ways(v: Column) -> Column:
        none = F.transform(F.sequence(F.lit(0), (v["n"] * (v["n"] + 1) / 2).cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
        return F.aggregate(F.sequence(F.lit(1), v["n"]), none, lambda acc, r: F.transform(acc, lambda x, s: x + F.when(s >= r, F.get(acc, s - r)).otherwise(0.0)))

    both = F.struct(w.cast("double").alias("w"), n.cast("int").alias("n"))
    return let(both, lambda v: F.when(v["n"] < 1, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.slice(ways(v), F.lit(1), (F.floor(v["w"]) + 1).cast("int")), F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), v["n"]))))
