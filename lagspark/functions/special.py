"""Distribution functions and quasi-random points that numpy lacks."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

norm_cdf = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])
norm_ppf = np.vectorize(NormalDist().inv_cdf, otypes=[float])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


@np.vectorize
def f_sf(x: float, d1: float, d2: float) -> float:
    """Survival function of the F distribution."""
    return float("nan") if math.isnan(x) else 1.0 if x <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


@np.vectorize
def chi2_sf(x: float, d: float) -> float:
    return float("nan") if math.isnan(x) else 1.0 if x <= 0 else gammaincc(d / 2, x / 2)


# Sobol direction numbers of Joe and Kuo, dimensions 2 to 8, as
# (degree of the primitive polynomial, its inner coefficients, first numbers).
_SOBOL = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17))]


def sobol(n: int, dims: int) -> np.ndarray:
    """Unscrambled Sobol points 1..n (the origin is dropped), at most 8 dimensions."""
    if not 1 <= dims <= 8:
        raise ValueError("1 to 8 dimensions")
    bits = 30
    direction = np.zeros((dims, bits), np.int64)
    direction[0] = [1 << (bits - 1 - k) for k in range(bits)]
    for d in range(1, dims):
        degree, inner, first = _SOBOL[d - 1]
        m = list(first)
        for k in range(degree, bits):
            new = m[k - degree] ^ (m[k - degree] << degree)
            for j in range(1, degree):
                if inner >> (degree - 1 - j) & 1:
                    new ^= m[k - j] << j
            m.append(new)
        direction[d] = [m[k] << (bits - 1 - k) for k in range(bits)]
    index = np.arange(1, n + 1)
    gray = index ^ (index >> 1)
    out = np.zeros((n, dims), np.int64)
    for k in range(bits):
        on = (gray >> k & 1).astype(bool)
        out[on] ^= direction[:, k]
    return out / float(1 << bits)
