"""Distribution functions on plain floats, for the last step on aggregated rows."""

from __future__ import annotations

import math


def binom_two_sided(b: int, c: int) -> float:
    """Exact two-sided test of b against c at one half; 1 for no trials."""
    n = b + c
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(b, c) + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(5000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return min(1.0, max(0.0, front * (f - 1)))


def _inverse(cdf, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def beta_ppf(p: float, a: float, b: float) -> float:
    return _inverse(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def odds_ci(b: int, c: int, alpha: float) -> tuple[float | None, float | None]:
    """Clopper-Pearson limits of b of b + c as odds; none for no trials."""
    n = b + c
    if n == 0:
        return None, None
    low = 0.0 if b == 0 else beta_ppf(alpha / 2, b, n - b + 1)
    high = 1.0 if c == 0 else beta_ppf(1 - alpha / 2, b + 1, n - b)
    return low / (1 - low), math.inf if c == 0 else high / (1 - high)


def t_cdf(t: float, df: float) -> float:
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - half if t > 0 else half


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    bound = 1.0
    while t_cdf(bound, df) < max(p, 1 - p):
        bound *= 2
    return _inverse(lambda x: t_cdf(x, df), p, -bound, bound)


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
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
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def signed_rank_exact(w: float, n: int) -> float:
    """Exact two-sided p of the smaller rank sum for n untied differences."""
    ways = [1]
    for r in range(1, n + 1):
        new = [0] * (len(ways) + r)
        for s, k in enumerate(ways):
            new[s] += k
            new[s + r] += k
        ways = new
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
