"""The two-sided p-value of a correlation, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients of the gamma function for g = 7 and nine terms.
LANCZOS_G = 7.0
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(LANCZOS_G - 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, as many steps as its slowest place needs."""
    tiny = F.lit(1e-300)
    kept = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d = 1 / kept(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / kept(1 + even * s["d"]), kept(1 + even / s["c"])
        mid = F.struct(c1.alias("c"), d1.alias("d"), (s["h"] * d1 * c1).alias("h"))
        second = lambda p: F.struct(kept(1 + odd / p["c"]).alias("c"), (1 / kept(1 + odd * p["d"])).alias("d"), p["h"].alias("h"))
        closed = lambda p: F.struct(p["c"].alias("c"), p["d"].alias("d"), (p["h"] * p["c"] * p["d"]).alias("h"))
        return F.transform(F.transform(F.array(mid), second), closed)[0]

    steps = F.sequence(F.lit(1), F.ceil(20 + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(steps, begin, step, lambda s: s["h"])


def regularised_beta(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for 0 <= x <= 1 and a, b >= 1/2; about ten digits."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    direct, mirrored = front * _fraction(x, a, b) / a, 1 - front * _fraction(1 - x, b, a) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs; 1 for two pairs, null below."""
    freedom = (n - 2).cast("double")
    p = regularised_beta(1 - r * r, freedom / 2, F.lit(0.5))
    return F.when(r.isNull() | (n < 2), F.lit(None).cast("double")).when(n == 2, 1.0).otherwise(p)
