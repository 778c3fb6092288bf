"""Special functions and distributions in numpy: normal, Student-t, chi-square."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def norm_pdf(x: float) -> float:
    return _N.pdf(x)


def lgamma(x):
    """log-gamma of positive arrays: the argument is raised by recurrence to 8 or more, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series + shift


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_pdf(x: float, nu: float) -> float:
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(x * x / nu))


def t_sf(x: float, nu: float) -> float:
    half = 0.5 * betainc(nu / 2, 0.5, nu / (nu + x * x))
    return half if x >= 0 else 1 - half


def t_ppf(p: float, nu: float) -> float:
    """Quantile by safeguarded Newton steps from the normal one."""
    if p > 0.5:
        return -t_ppf(1 - p, nu)
    lo, hi, x = -1e12, 0.0, min(norm_ppf(p), -1e-9) if p < 0.5 else 0.0
    for _ in range(200):
        f = t_sf(-x, nu) - p
        lo, hi = (x, hi) if f < 0 else (lo, x)
        step = x - f / max(t_pdf(x, nu), 1e-300)
        new = step if lo < step < hi else (lo + hi) / 2 if lo > -1e11 else x * 2 - 1
        if abs(new - x) <= 1e-14 * max(1.0, abs(x)):
            return new
        x = new
    return x


def chi2_sf(x: float, df: int) -> float:
    """Upper tail: closed forms for df 1 and even df, else one recurrence from df 1."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return math.exp(-x / 2) * total
    p = math.erfc(math.sqrt(x / 2))
    for k in range(1, df, 2):
        p += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    return p


def golden(f, lo: float, hi: float, tol: float = 1e-6) -> float:
    """Minimum of a unimodal function on [lo, hi]."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol * max(1.0, abs(lo)):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def t_multipliers(nu: float, alpha: float) -> tuple[float, float]:
    """VaR and ES of the unit-variance Student-t at tail probability alpha."""
    if nu <= 2:
        raise ValueError("nu must exceed 2")
    s, t = math.sqrt((nu - 2) / nu), t_ppf(alpha, nu)
    return -s * t, s * t_pdf(t, nu) / alpha * (nu + t * t) / (nu - 1)


def normal_multipliers(alpha: float) -> tuple[float, float]:
    z = norm_ppf(alpha)
    return -z, norm_pdf(z) / alpha


def implied_nu(var: float, es: float, alpha: float, lo: float = 2.05, hi: float = 200.0) -> float | None:
    """Degrees of freedom whose ES/VaR ratio is es/var: None where the tail is no heavier than normal, lo where it is heavier than lo's."""
    if not (es > var > 0):
        raise ValueError("implied nu needs ES > VaR > 0")

    def ratio(nu: float) -> float:
        v, e = t_multipliers(nu, alpha)
        return e / v

    target = es / var
    v, e = normal_multipliers(alpha)
    if target <= e / v * (1 + 1e-9) or target <= ratio(hi):
        return None
    if target >= ratio(lo):
        return lo
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ratio(mid) > target else (lo, mid)
        if hi - lo < 1e-10 * hi:
            break
    return (lo + hi) / 2


def fit_t_nu(z: np.ndarray, lo: float = 2.1, hi: float = 100.0) -> float:
    """Maximum-likelihood degrees of freedom of the unit-variance Student-t, from 100 finite values or more."""
    z = np.asarray(z, float)
    z2 = z[np.isfinite(z)] ** 2
    if len(z2) < 100:
        raise ValueError("need at least 100 finite values")

    def nll(nu: float) -> float:
        const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return float((nu + 1) / 2 * np.log1p(z2 / (nu - 2)).sum() - len(z2) * const)

    grid = np.exp(np.linspace(math.log(lo), math.log(hi), 25))
    k = int(np.argmin([nll(g) for g in grid]))
    return golden(nll, grid[max(k - 1, 0)], grid[min(k + 1, 24)])
