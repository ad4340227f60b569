"""Tails as columns against plain versions of other make."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodeflow.functions import tails
from lodeflow.operators import statistics as st


def normal_p(z: float) -> float:
    """Two-sided tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_p(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(1 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def exact_wilcoxon_p(w: float, n: int) -> float:
    """Two-sided, for untied samples: of the 2^n sign patterns those with a rank sum of ``w`` at most."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def test_plain_versions():
    assert normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert t_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and t_p(0.0, 5) == pytest.approx(1.0)
    assert exact_wilcoxon_p(3, 7) == pytest.approx(0.078125)


def test_normal(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.959964, 2.82, 2.83, 3.5, -2.0, 6.0, 12.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").select("i", tails.normal_two_sided(F.col("z")).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([normal_p(z) for z in zs], abs=1e-10)


def test_t(spark):
    cases = [(t, df) for t in (0.0, 1e-6, 0.2, 0.9, 1.7, 1.8, 2.228139, -3.0, 7.0, 60.0) for df in (1, 2, 3, 5, 10, 40, 150, 199)]
    got = [r.p for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t double, df int").select("i", tails.t_two_sided(F.col("t"), F.col("df")).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([t_p(*c) for c in cases], abs=1e-8)


def test_many_degrees_join_on(spark):
    """The expansion meets the fraction where it takes over, and the normal tail far out."""
    df = spark.createDataFrame([(0.7, 200), (2.1, 200), (4.0, 200), (2.1, 100_000_000)], "t double, df int").select(tails.t_two_sided(F.col("t"), F.col("df")).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([t_p(0.7, 200), t_p(2.1, 200), t_p(4.0, 200), normal_p(2.1)], abs=1e-8)


def test_quantile(spark):
    dfs = [1, 2, 9, 30, 250, 10_000]
    got = [r.q for r in spark.createDataFrame([(d,) for d in dfs], "df int").select("df", tails.t_quantile(0.95, F.col("df")).alias("q")).orderBy("df").collect()]
    assert got == pytest.approx([12.706205, 4.302653, 2.262157, 2.042272, 1.969498, 1.960201], abs=1e-6)


def test_signed_rank(spark):
    cases = [(w, n) for n in (1, 2, 7, 20, 50) for w in {0, 3, n * (n + 1) // 4} if w <= n * (n + 1) // 2]
    got = [r.p for r in spark.createDataFrame([(i, float(w), n) for i, (w, n) in enumerate(cases)], "i int, w double, n int").select("i", tails.signed_rank_two_sided(F.col("w"), F.col("n")).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([exact_wilcoxon_p(*c) for c in cases], abs=1e-12)


def test_samples(spark):
    """No difference at all, one pair, ties and zeros, a sample of two, and one that does not vary."""
    rows = [("same", 1.0, 1.0)] * 3 + [("one", 2.0, 1.0)] + [("ties", float(i % 3), float((i * 2) % 3)) for i in range(12)] + [("flat", 2.0, 1.0)] * 4 + [("two", 1.0, 0.5), ("two", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, base double, other double")
    got = {r.g: r for r in st.judged(st.wilcoxon(df, ["g"]), ["g"], F.col("z")).collect()}
    assert (got["same"].w, got["same"].z, got["same"].p, got["same"].flag) == (0.0, 0.0, 1.0, "n.s.") and got["one"].p == 1.0 and got["two"].p == 0.5
    d = [b - o for g, b, o in rows if g == "ties" and b != o]
    up = sorted(map(abs, d))
    rank = {m: sum(i for i, x in enumerate(up, 1) if x == m) / up.count(m) for m in up}
    w, n = min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)), len(d)
    spread = n * (n + 1) * (2 * n + 1) / 24 - sum(up.count(m) ** 3 - up.count(m) for m in set(up)) / 48
    assert got["ties"].w == w and got["ties"].n_nonzero == n and got["ties"].p == pytest.approx(normal_p((w - n * (n + 1) / 4) / math.sqrt(spread)), abs=1e-6)
    t = {r.g: r for r in st.paired_t(df, ["g"]).collect()}
    assert t["flat"].p is None and t["one"].t is None and t["two"].p == pytest.approx(t_p(1.25 / (0.75 * math.sqrt(2) / math.sqrt(2)), 1), abs=1e-6)
    s = {r.g: r for r in st.summary(df.select("g", F.col("base").alias("value")), ["g"]).collect()}
    assert s["one"].lower is None and s["two"].upper == pytest.approx(2 + 12.706205, abs=1e-4)
