"""Tails of the distributions that tests need, as column expressions: no Python runs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Lanczos coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 0.5."""
    y = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + float(i))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def _away(x: Column) -> Column:
    """x, kept away from 0 in a continued fraction."""
    return F.when(F.abs(x) < 1e-300, F.lit(1e-300)).otherwise(x)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function; its terms grow with the root of the larger parameter."""
    terms = F.least(F.lit(20000.0), 60 + 6 * F.sqrt(F.greatest(a, b))).cast("int")
    first = 1 / _away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def term(s: Column, coefficient: Column) -> Column:
        d = 1 / _away(1 + coefficient * s["d"])
        c = _away(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    # Even and odd terms take turns: step i is term m = (i + 1) // 2.
    def step(s: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return term(s, F.when(i % 2 == 1, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(1), 2 * terms), start, step, lambda s: s["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 0.5."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = front * _beta_fraction(a, b, x) / a
    high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    n = df.cast("double")
    return beta_share(n / 2, F.lit(0.5), n / (n + t * t))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal: the complementary error function of |z| / sqrt(2)."""
    x = F.abs(z) / math.sqrt(2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda s, k: F.struct((-s["t"] * x * x / k).alias("t"), (s["s"] + -s["t"] * x * x / k / (2 * k + 1)).alias("s")),
        lambda s: 1 - 2 / math.sqrt(math.pi) * s["s"],
    )
    # From the innermost term outwards: x + (k/2) / (x + ...).
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda s, k: x + k / 2.0 / s, lambda s: F.exp(-x * x) / (math.sqrt(math.pi) * s))
    return F.when(x < 2.5, series).otherwise(fraction)


def chi_square_tail(value: Column) -> Column:
    """p-value of a chi-square with one degree of freedom."""
    return normal_tail(F.sqrt(value))


def signed_rank_tail(n: Column, w: Column) -> Column:
    """Two-sided p-value of the smaller rank sum w of n untied differences: sets of ranks counted by their sum."""
    top = F.floor(w).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def with_rank(counts: Column, k: Column) -> Column:
        return F.transform(counts, lambda c, s: c + F.when(s >= k, F.get(counts, s - k)).otherwise(0.0))

    sets = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, with_rank, lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b))
    return F.least(F.lit(1.0), 2 * sets * F.pow(F.lit(0.5), n))
