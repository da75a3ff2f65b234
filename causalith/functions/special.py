"""Distribution functions on plain numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def upper_gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or tiny)
        c = b + n / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi_square_tail(x: float, dof: float) -> float:
    return upper_gamma_q(dof / 2, x / 2)


def interval(estimate: float, se: float) -> tuple[float, float, float, float]:
    """Standard error, 95 % bounds and p value; without a usable error the bounds are the estimate and p is 1."""
    if not math.isfinite(se) or se <= 0:
        return 0.0, estimate, estimate, 1.0
    return se, estimate - Z95 * se, estimate + Z95 * se, two_sided_p(estimate / se)
