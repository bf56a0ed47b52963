"""Tail probabilities without scipy: normal, Student's t (also as logarithms), and the exact signed-rank distribution."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-16:
            break
    return out


def log_betainc(a: float, b: float, x: float) -> float:
    """Logarithm of the regularized incomplete beta function."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_fraction(a, b, x)) - math.log(a)
    return math.log1p(-math.exp(front + math.log(_fraction(b, a, 1 - x)) - math.log(b)))


def log_t_two_sided(t: float, dof: float) -> float:
    """Natural logarithm of P(|T| >= |t|)."""
    if math.isinf(t):
        return -math.inf
    return log_betainc(dof / 2, 0.5, dof / (dof + t * t))


def t_two_sided(t: float, dof: float) -> float:
    return math.exp(log_t_two_sided(t, dof))


def pearson_p(r: float | None, n: int) -> float | None:
    if r is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p of the smaller rank sum w of n untied differences other than 0."""
    ways = np.ones(1)
    for k in range(1, n + 1):
        more = np.zeros(len(ways) + k)
        more[: len(ways)] += ways
        more[k:] += ways
        ways = more
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def signed_rank_p(w: float, n: int, tie_term: float, exact_to: int = 50) -> float:
    """Exact up to exact_to differences without ties; else normal with the tie correction and no continuity correction. No difference: 1."""
    if n == 0:
        return 1.0
    if n <= exact_to and tie_term == 0:
        return signed_rank_exact(w, n)
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return normal_two_sided((w - mean) / math.sqrt(var)) if var > 0 else 1.0


def format_p(p: float | None) -> str:
    if p is None:
        return ""
    return "< 1e-300" if p < 1e-300 else f"{p:.2e}" if p < 1e-4 else f"{p:.4f}"
