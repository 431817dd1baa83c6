"""Small scalar distribution functions evaluated on the driver.

These act on a handful of numbers (a test statistic, a coefficient), never on
rows, so plain Python is the right tool.
"""

from __future__ import annotations

import math
from statistics import NormalDist

Z95 = NormalDist().inv_cdf(0.975)


def norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_p(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return 2.0 * (1.0 - norm_cdf(abs(z)))


def _gamma_series(a: float, x: float) -> float:
    # lower regularized gamma P(a, x) by its power series (x < a + 1)
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(10_000):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    # upper regularized gamma Q(a, x) by Lentz's continued fraction (x >= a + 1)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) for X ~ chi-square(df)."""
    if x is None or math.isnan(x):
        return float("nan")
    return gamma_q(df / 2.0, x / 2.0)
