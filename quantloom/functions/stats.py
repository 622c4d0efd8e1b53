"""Column expressions that Spark has no function for: p-values, reproducible random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*keys: Column | str, seed: int | Column = 0, salt: str = "") -> Column:
    """The MD5 hash of the keys, the seed and the salt, as lower-case hex digits."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, (F.lit(seed) if isinstance(seed, int) else seed).cast("string"), F.lit(salt)))


def uniform(*keys: Column | str, seed: int | Column = 0, salt: str = "") -> Column:
    """A number in [0, 1) that depends on the keys, the seed and the salt only: the first 32 bits of an MD5 hash."""
    return F.conv(F.substring(digest(*keys, seed=seed, salt=salt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(u1: Column, u2: Column) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom; null if either is null or df < 1.

    With x = df / (df + t^2): for x <= 1/2 the series of the incomplete beta function, whose terms are all positive;
    else one less the finite trigonometric sum.
    """
    df = df.cast("double")
    x, a = df / (df + t * t), df / 2
    odd = df % 2 == 1
    steps = F.floor((df - 1) / 2).cast("int")
    start = F.struct(F.when(odd, F.lit(1 / math.pi)).otherwise(F.lit(0.5)).alias("b"), F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0)).alias("a"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    beta = F.aggregate(upto(steps), start, lambda s, _: F.struct((s["b"] * (s["a"] + 0.5) / s["a"]).alias("b"), (s["a"] + 1.0).alias("a")), lambda s: s["b"])
    first = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(79)), first, lambda s, j: F.struct((s["c"] * (j + 0.5) / (j + 1) * x).alias("c"), (s["sum"] + s["c"] / (a + j)).alias("sum")), lambda s: s["sum"])
    small = F.pow(x, a) * beta * series
    cos2 = x
    sin = F.sqrt(F.lit(1.0) - x)
    # terms j = 1.. of the sums: cos^(2j-1) * (2 4 ..)/(3 5 ..) for odd df, cos^(2j-2) * (1 3 ..)/(2 4 ..) for even
    many = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    head = F.struct(F.when(odd, F.sqrt(cos2)).otherwise(F.lit(1.0)).alias("c"), F.lit(0.0).alias("sum"))
    ratio = lambda j: F.when(odd, (2.0 * j) / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
    total = F.aggregate(upto(many), head, lambda s, j: F.struct((s["c"] * cos2 * ratio(j)).alias("c"), (s["sum"] + s["c"]).alias("sum")), lambda s: s["sum"])
    angle = F.atan(F.abs(t) / F.sqrt(df))
    inside = F.when(odd, F.lit(2 / math.pi) * (angle + sin * total)).otherwise(sin * total)
    return F.when((df >= 1) & t.isNotNull(), F.when(x <= 0.5, F.least(small, F.lit(1.0))).otherwise(F.greatest(F.lit(1.0) - inside, F.lit(0.0))))


# The coefficients of Stirling's series of the logarithm of n!, in 1 / n, 1 / n^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: What Stirling's formula lacks of the logarithm of n!, for n below 16.
LACKS = [0.0, *[math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]]


def stirling_error(n: Column) -> Column:
    """ln n! less (n + 1/2) ln n - n + ln(2 pi) / 2, of whole n >= 0; 0 for n = 0. From 16 on five terms of the series,
    whose error is less than the sixth, 2e-16."""
    n = n.cast("double")
    inverse, square = 1 / n, 1 / (n * n)
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = series * square + c
    return F.when(n < 16, F.get(F.array(*map(F.lit, LACKS)), n.cast("int"))).otherwise(series * inverse)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x for positive x and mean. Where they are close, by the series in (x - mean) / (x + mean),
    as the difference would lose its digits: nine terms, whose error is below 1e-18 of the first."""
    v = (x - mean) / (x + mean)
    square, tail = v * v, F.lit(0.0)
    for k in range(9, 0, -1):
        tail = (tail + 2.0 / (2 * k + 1)) * square
    return F.when(F.abs(v) < 0.1, (x - mean) * v + x * v * tail).otherwise(x * F.ln(x / mean) + mean - x)


def ln_binomial(x: Column, n: Column, p: Column) -> Column:
    """The logarithm of the probability of x successes in n trials of chance p (0 < p < 1), by constant work: Loader's
    saddle point expansion. It keeps its digits however large n is, which differences of ln n! don't."""
    x, n = x.cast("double"), n.cast("double")
    inside = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    inside = inside + 0.5 * F.ln(n / (2 * math.pi * x * (n - x)))
    return F.when((x < 0) | (x > n), F.lit(float("-inf"))).when(x == 0, n * F.log1p(-p)).when(x == n, n * F.ln(p)).otherwise(inside)


def harmonic(m: Column) -> Column:
    """1 + 1/2 + .. + 1/m of a whole m >= 0, by constant work: the asymptotic series at m + 8, less the eight terms between.
    Its error is below 1e-14."""
    m = m.cast("double")
    far = m + 8
    square = 1 / (far * far)
    out = F.ln(far) + 0.5772156649015329 + 1 / (2 * far) - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    for k in range(1, 9):
        out = out - 1 / (m + k)
    return F.greatest(out, F.lit(0.0))
