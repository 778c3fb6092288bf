"""(GJR-)GARCH(1,1) by maximum likelihood, many windows at once.

All windows, starting points and gradient perturbations go through the variance recursion together, one vector step per day, so a
series' blocks cost little more than one fit. Parameters are searched without bounds: alpha and gamma as logistic shares of 0.5,
beta as a share of what persistence 0.9995 leaves, omega and nu on logistic scales of their ranges.
"""

from __future__ import annotations

import numpy as np

from ..functions.dist import lgamma

MOST, FLOOR = 0.9995, 1e-12
# Starting points (alpha, beta), gamma, nu.
STARTS, GAMMA0, NU0 = ((0.05, 0.90), (0.10, 0.80), (0.02, 0.95)), 0.05, 8.0
STEP = 1e-5


def _logit(p):
    return np.log(p / (1 - p))


def _sig(u):
    return 1 / (1 + np.exp(-np.clip(u, -35, 35)))


def next_variances(w: np.ndarray, omega, alpha, beta, gamma) -> np.ndarray:
    """Percent-squared variance for the day after each decimal window, from the window's variance."""
    x = w * 100
    s2 = x.var(axis=1)
    for t in range(x.shape[1]):
        e = x[:, t]
        s2 = np.maximum(omega + (alpha + gamma * (e < 0)) * e * e + beta * s2, FLOOR)
    return s2


class _Likelihood:
    def __init__(self, w: np.ndarray, asymmetric: bool, student: bool):
        self.x = np.ascontiguousarray((w * 100).T)  # days, windows
        self.v = self.x.var(axis=0)
        self.asymmetric, self.student = asymmetric, student
        self.size = 3 + asymmetric + student

    def unpack(self, u: np.ndarray, v: np.ndarray):
        """u: (..., size); v: variances that broadcast with u[..., 0]."""
        omega = np.clip((10 * v + 1e-6) * _sig(u[..., 0]), 1e-8, None)
        alpha = 0.5 * _sig(u[..., 1])
        gamma = 0.5 * _sig(u[..., 3]) if self.asymmetric else np.zeros_like(alpha)
        beta = (MOST - alpha - gamma / 2) * _sig(u[..., 2])
        nu = 2.1 + 97.9 * _sig(u[..., -1]) if self.student else None
        return omega, alpha, beta, gamma, nu

    def start(self) -> np.ndarray:
        out = []
        for a, b in STARTS:
            g = GAMMA0 if self.asymmetric else 0.0
            p = min(a + b + g / 2, 0.999)
            b = p - a - g / 2
            omega = np.maximum(self.v * (1 - p), 1e-6)
            cols = [_logit(np.clip(omega / (10 * self.v + 1e-6), 1e-9, 0.999)), np.full_like(self.v, _logit(a / 0.5)), np.full_like(self.v, _logit(b / (MOST - a - g / 2)))]
            if self.asymmetric:
                cols.append(np.full_like(self.v, _logit(g / 0.5)))
            if self.student:
                cols.append(np.full_like(self.v, _logit((NU0 - 2.1) / 97.9)))
            out.append(np.stack(cols, axis=-1))
        return np.stack(out)  # starts, windows, size

    def __call__(self, u: np.ndarray) -> np.ndarray:
        """Mean negative log-likelihood for u (variants, windows, size)."""
        omega, alpha, beta, gamma, nu = self.unpack(u, self.v)
        s2 = np.broadcast_to(self.v, omega.shape).copy()
        logs, total = np.zeros_like(s2), np.zeros_like(s2)
        for e in self.x:
            e2 = e * e
            logs += np.log(s2)
            total += np.log1p(e2 / ((nu - 2) * s2)) if self.student else e2 / s2
            s2 = omega + (alpha + gamma * (e < 0)) * e2 + beta * s2
            np.maximum(s2, FLOOR, out=s2)
        n = len(self.x)
        if not self.student:
            return 0.5 * (np.log(2 * np.pi) + (logs + total) / n)
        return 0.5 * logs / n + (nu + 1) / 2 * total / n - lgamma((nu + 1) / 2) + lgamma(nu / 2) + 0.5 * np.log(np.pi * (nu - 2))


def fit_blocks(w: np.ndarray, asymmetric: bool, student: bool, steps: int = 60, chunk: int = 64) -> dict[str, np.ndarray]:
    """Parameters of each window (rows of w): omega, alpha, beta, gamma, nu, loglik, converged."""
    parts = [_fit(w[k : k + chunk], asymmetric, student, steps) for k in range(0, len(w), chunk)]
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if parts else {}


def _fit(w: np.ndarray, asymmetric: bool, student: bool, steps: int) -> dict[str, np.ndarray]:
    """BFGS for all windows from the best of the three starts after a few steps of each."""
    f = _Likelihood(w, asymmetric, student)
    k = f.size

    def gradient(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, n, _ = u.shape
        moved = u[None] + STEP * np.concatenate([np.zeros((1, k)), np.eye(k), -np.eye(k)])[:, None, None, :]
        values = f(moved.reshape(-1, n, k)).reshape(2 * k + 1, s, n)
        return values[0], np.moveaxis((values[1 : k + 1] - values[k + 1 :]) / (2 * STEP), 0, -1)

    def bfgs(u: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, g = gradient(u)
        h = np.broadcast_to(np.eye(k), (*u.shape, k)).copy()
        sizes = 2.0 ** -np.arange(0, 12, 2)
        done = np.zeros(u.shape[:2], bool)  # each window stops by itself, so no window's result depends on another's
        for _ in range(steps):
            d = -np.einsum("...ij,...j->...i", h, g)
            slope = (d * g).sum(-1)
            bad = slope >= 0
            d[bad] = -g[bad]
            h[bad] = np.eye(k)
            slope = (d * g).sum(-1)
            d *= np.minimum(1, 2 / np.maximum(np.abs(d).max(-1), 1e-300))[..., None]
            tried = u[None] + sizes[:, None, None, None] * d[None]
            values = f(tried.reshape(-1, *u.shape[1:])).reshape(len(sizes), *u.shape[:2])
            good = values <= y + 1e-4 * sizes[:, None, None] * slope
            pick = np.where(good.any(0), good.argmax(0), values.argmin(0))
            value = np.take_along_axis(values, pick[None], 0)[0]
            step = np.where(((value < y) & ~done)[..., None], sizes[pick][..., None] * d, 0)
            done |= np.abs(step).max(-1) < 1e-7
            if done.all():
                break
            u = u + step
            y2, g2 = gradient(u)
            dy = g2 - g
            sy = (step * dy).sum(-1)
            ok = sy > 1e-12
            rho = np.where(ok, 1 / np.where(ok, sy, 1), 0)[..., None, None]
            left = np.eye(k) - rho * step[..., :, None] * dy[..., None, :]
            h = np.where(ok[..., None, None], left @ h @ np.swapaxes(left, -1, -2) + rho * step[..., :, None] * step[..., None, :], h)
            done |= np.abs(y - y2) < 1e-11
            y, g = y2, g2
        return u, y, g

    u, y, _ = bfgs(f.start(), 8)
    best = y.argmin(0)
    u = np.take_along_axis(u, best[None, :, None], 0)
    u, y, g = bfgs(u, steps)
    omega, alpha, beta, gamma, nu = f.unpack(u[0], f.v)
    # flat directions (a share at its bound) have no gradient; what remains is noise of the differences
    converged = np.isfinite(y[0]) & (np.abs(g[0]).max(-1) < 1e-3)
    return {"omega": omega, "alpha": alpha, "beta": beta, "gamma": gamma, "nu": nu if student else np.full_like(omega, np.inf), "loglik": -y[0] * len(f.x), "converged": converged}
