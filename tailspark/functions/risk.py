"""Risk measures and scoring rules as column expressions: VaR and ES are positive loss magnitudes, alpha a tail probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dist import normal_multipliers, t_multipliers


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside a lambda over elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def check_alpha(alpha: float) -> float:
    if not 0 < alpha < 0.5:
        raise ValueError(f"alpha must lie in (0, 0.5): {alpha}")
    return alpha


def var_es_normal(sigma: Column, alpha: float, mu: float = 0.0) -> tuple[Column, Column]:
    """Of N(mu, sigma**2); null where sigma is negative."""
    kv, ke = normal_multipliers(check_alpha(alpha))
    ok = F.when(sigma >= 0, sigma)
    return ok * kv - mu, ok * ke - mu


def var_es_student_t(sigma: Column, nu: float, alpha: float, mu: float = 0.0) -> tuple[Column, Column]:
    """Of a Student-t scaled to variance sigma**2; null where sigma is negative."""
    kv, ke = t_multipliers(nu, check_alpha(alpha))
    ok = F.when(sigma >= 0, sigma)
    return ok * kv - mu, ok * ke - mu


def var_es_sample(sample: Column, alpha: float, least: int = 100) -> tuple[Column, Column]:
    """Of an array: linear-interpolated quantile, and the mean of what lies at it or below; null under `least` values."""
    check_alpha(alpha)

    def tail(s: Column, q: Column) -> Column:
        below = F.filter(s, lambda x: x <= q)
        return F.struct((-q).alias("var"), (-F.aggregate(below, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(below), F.lit(0))).alias("es"))

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(alpha)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) >= least, let(a + (b - a) * (at - low), lambda q: tail(s, q)))

    both = let(F.array_sort(F.filter(sample, lambda x: x.isNotNull() & ~F.isnan(x))), of)
    return both["var"], both["es"]


def qlike(sigma2: Column, proxy: Column) -> Column:
    """ln s2 + proxy/s2, for s2 > 0 and proxy >= 0, else null."""
    ok = F.when((sigma2 > 0) & (proxy >= 0), sigma2)
    return F.ln(ok) + proxy / ok


def mse(sigma2: Column, proxy: Column) -> Column:
    return (sigma2 - proxy) * (sigma2 - proxy)


def fz0(var: Column, es: Column, r: Column, alpha) -> Column:
    """Fissler-Ziegel loss of order 0, hits counted at or below -VaR; null unless es > 0 and es >= var."""
    e = F.when((es > 0) & (es >= var), es)
    hit = F.when(r <= -var, F.lit(1.0)).otherwise(F.lit(0.0))
    return -hit * (var + r) / (alpha * e) + var / e + F.ln(e) - 1.0


def breach(r: Column, var: Column) -> Column:
    """1 where the loss exceeds VaR strictly."""
    return (r < -var).cast("int")


def close_to(x: Column, a: float) -> Column:
    return F.abs(x - F.lit(a)) <= 1e-8 + 1e-5 * abs(a)


def persistence(alpha: Column, beta: Column, gamma: Column) -> Column:
    return alpha + beta + gamma / 2
