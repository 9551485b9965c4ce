"""Distribution functions that Spark lacks: normal, Student t, F and chi-square, with quantiles and a noncentral F tail."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    """A root of a function that rises from below to above 0."""
    for _ in range(steps):
        mid = 0.5 * (low + high)
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def normal_quantile(p: float) -> float:
    return bisect(lambda x: normal_cdf(x) - p, -40.0, 40.0)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * scale
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    value = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return scale * value


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 - f_cdf(x, d1, d2)


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def f_quantile(p: float, d1: float, d2: float) -> float:
    high = 1.0
    while f_cdf(high, d1, d2) < p:
        high *= 2.0
    return bisect(lambda x: f_cdf(x, d1, d2) - p, 0.0, high)


def noncentral_f_sf(x: float, d1: float, d2: float, noncentrality: float) -> float:
    """A Poisson mixture of central terms, from its mode outwards."""
    half = noncentrality / 2.0
    y = d1 * x / (d1 * x + d2)
    total, mode = 0.0, int(half)
    for step in (1, -1):
        j = mode if step == 1 else mode - 1
        while j >= 0:
            weight = math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) if half > 0 else float(j == 0)
            total += weight * beta_cdf(d1 / 2.0 + j, d2 / 2.0, y)
            if weight < 1e-14:
                break
            j += step
    return 1.0 - total
