"""Tail probabilities of the t, F and chi-square distributions as column expressions.

Continued fractions and series run as folds of fixed length over a sequence, so a p-value is plain column arithmetic. The
fractions are read on the side where they converge quickly whatever the sample size (about a hundred terms at most).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 300
TINY = 1e-300
#: Lanczos coefficients (g = 7, nine terms).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""
    y = x + 1.0  # Gamma(x) = Gamma(x + 1) / x keeps small arguments accurate
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (y + float(i))
    t = y + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y - 0.5) * F.log(t) - t + F.log(total) - F.log(x)


def _apart(x: Column) -> Column:
    """``x``, kept away from zero."""
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(first: Column, term) -> Column:
    """Lentz's method: ``h`` after ``TERMS`` terms; ``term(m)`` gives pairs (a, b) of the fraction."""
    start = F.struct(F.lit(1.0).alias("c"), (1.0 / _apart(first)).alias("d"), (1.0 / _apart(first)).alias("h"))

    def fold(s, m):
        c, d, h = s["c"], s["d"], s["h"]
        for a, b in term(m.cast("double")):
            d = 1.0 / _apart(b + a * d)
            c = _apart(b + a / c)
            h = h * d * c
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, fold)["h"]


def betainc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    def fraction(a, b, x):
        one = F.lit(1.0)
        return _fraction(1.0 - (a + b) * x / (a + 1.0), lambda m: [
            (m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m)), one),
            (-(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0)), one)])

    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log1p(-x))
    inner = F.when(x < (a + 1.0) / (a + b + 2.0), front * fraction(a, b, x) / a).otherwise(1.0 - front * fraction(b, a, 1.0 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def gammaincc(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x)."""
    front = F.exp(-x + a * F.log(x) - lgamma(a))
    start = F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda s, n: F.struct(
        (s["t"] * x / (a + n)).alias("t"), (s["s"] + s["t"] * x / (a + n)).alias("s")))["s"]
    b = x + 1.0 - a
    fraction = _gamma_fraction(a, b)
    return F.when(x <= 0, 1.0).when(x < a + 1.0, 1.0 - series * front).otherwise(front * fraction)


def _gamma_fraction(a: Column, b: Column) -> Column:
    start = F.struct(F.lit(1.0 / TINY).alias("c"), (1.0 / _apart(b)).alias("d"), (1.0 / _apart(b)).alias("h"))

    def fold(s, m):
        n = m.cast("double")
        an, bn = -n * (n - a), b + 2.0 * n
        d = 1.0 / _apart(an * s["d"] + bn)
        c = _apart(bn + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, fold)["h"]


def t_two_sided(t: Column, df: Column) -> Column:
    """Null for a null or NaN statistic or no degrees of freedom."""
    p = betainc(df / 2.0, F.lit(0.5), df / (df + t * t))
    return F.when(t.isNotNull() & ~F.isnan(t) & (df > 0), F.when(F.abs(t) == float("inf"), 0.0).otherwise(p))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    p = betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
    return F.when(f.isNotNull() & ~F.isnan(f) & (d1 > 0) & (d2 > 0), F.when(f <= 0, 1.0).otherwise(p))


def chi2_tail(x: Column, df: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (df > 0), gammaincc(df / 2.0, x / 2.0))
