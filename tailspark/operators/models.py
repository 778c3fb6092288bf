"""Forecast models as kernels over one series: all origins of a series at once, in chunks that bound memory.

A model maps (returns, origin rows, settings) to arrays (horizons, origins) of variance and (horizons, alphas, origins) of VaR
and ES, and errors by origin. Windows end at and include the origin; nothing later is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

import numpy as np

from ..functions.dist import normal_multipliers, t_multipliers
from .garch import fit_blocks, next_variances

# Decay of the EWMA recursion; resampled paths and the seed of their rows.
LAMBDA = 0.94
PATHS, PATH_SEED = 20_000, 1234
CHUNK = 64


@dataclass(frozen=True)
class WalkForward:
    """Settings of a walk-forward run."""

    window: int = 1000
    refit_every: int = 21
    horizons: tuple[int, ...] = (1, 5, 20)
    alphas: tuple[float, ...] = (0.01, 0.025, 0.05)
    start: date | None = None

    def __post_init__(self):
        if self.window < 250 or self.refit_every < 1 or min(self.horizons) < 1 or not all(0 < a < 0.5 for a in self.alphas):
            raise ValueError("window must be 250 or more, refit_every and horizons 1 or more, alphas in (0, 0.5)")


@dataclass
class Forecasts:
    sigma2: np.ndarray
    var: np.ndarray
    es: np.ndarray
    errors: dict[int, str] = field(default_factory=dict)
    refits: int = 0

    @classmethod
    def empty(cls, cfg: WalkForward, n: int) -> Forecasts:
        shape = (len(cfg.horizons), len(cfg.alphas), n)
        return cls(np.full(shape[::2], np.nan), np.full(shape, np.nan), np.full(shape, np.nan))

    def normal(self, cfg: WalkForward) -> Forecasts:
        """VaR and ES of a normal law with the variances given."""
        for j, a in enumerate(cfg.alphas):
            kv, ke = normal_multipliers(a)
            self.var[:, j], self.es[:, j] = kv * np.sqrt(self.sigma2), ke * np.sqrt(self.sigma2)
        return self


def windows(r: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(r, size)[at - size + 1]


def empirical(samples: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """VaR and ES of each row: the linear-interpolated quantile and the mean at it or below."""
    q = np.quantile(samples, alpha, axis=-1)
    tail = samples <= q[..., None]
    return -q, -(samples * tail).sum(axis=-1) / tail.sum(axis=-1)


def ewma_paths(w: np.ndarray, lam: float = LAMBDA) -> np.ndarray:
    """Variance recursion of each window, from its population variance: one column per row and one for the next."""
    out = np.empty((w.shape[0], w.shape[1] + 1))
    out[:, 0] = w.var(axis=1)
    for t in range(w.shape[1]):
        out[:, t + 1] = lam * out[:, t] + (1 - lam) * w[:, t] ** 2
    return out


def historical(r: np.ndarray, at: np.ndarray, cfg: WalkForward) -> Forecasts:
    f = Forecasts.empty(cfg, len(at))
    for h_i, h in enumerate(cfg.horizons):
        sums = np.convolve(r, np.ones(h), "valid") if h > 1 else r
        sums = np.concatenate([np.full(h - 1, np.nan), sums])
        for k in range(0, len(at), CHUNK * 8):
            s = windows(sums, at[k : k + CHUNK * 8], cfg.window - h + 1)
            f.sigma2[h_i, k : k + len(s)] = s.var(axis=1)
            for j, a in enumerate(cfg.alphas):
                f.var[h_i, j, k : k + len(s)], f.es[h_i, j, k : k + len(s)] = empirical(s, a)
    return f


def ewma_rm(r: np.ndarray, at: np.ndarray, cfg: WalkForward) -> Forecasts:
    f = Forecasts.empty(cfg, len(at))
    for k in range(0, len(at), CHUNK * 8):
        w = windows(r, at[k : k + CHUNK * 8], cfg.window)
        f.sigma2[:, k : k + len(w)] = np.array(cfg.horizons)[:, None] * ewma_paths(w)[:, -1]
    return f.normal(cfg)


def fhs_ewma(r: np.ndarray, at: np.ndarray, cfg: WalkForward) -> Forecasts:
    """The resampled rows are the same at every origin (the generator starts anew), so they are drawn once per horizon."""
    f = Forecasts.empty(cfg, len(at))
    draws = {h: np.random.default_rng(PATH_SEED).integers(0, cfg.window, size=(PATHS, h)).astype(np.int32) for h in cfg.horizons if h > 1}
    for k in range(0, len(at), CHUNK):
        w = windows(r, at[k : k + CHUNK], cfg.window)
        paths = ewma_paths(w)
        z = w / np.sqrt(np.maximum(paths[:, :-1], 1e-300))
        for h_i, h in enumerate(cfg.horizons):
            if h == 1:
                _sampled(f, h_i, k, np.sqrt(paths[:, -1])[:, None] * z, cfg)
                continue
            for i in range(len(w)):
                s2, total, zi = np.full(PATHS, paths[i, -1]), np.zeros(PATHS), z[i]
                for step in range(h):
                    x = np.sqrt(s2) * zi[draws[h][:, step]]
                    total += x
                    s2 = LAMBDA * s2 + (1 - LAMBDA) * x * x
                _sampled(f, h_i, k + i, total[None, :], cfg)
    return f


def _sampled(f: Forecasts, h_i: int, k: int, samples: np.ndarray, cfg: WalkForward) -> None:
    f.sigma2[h_i, k : k + len(samples)] = samples.var(axis=1)
    for j, a in enumerate(cfg.alphas):
        f.var[h_i, j, k : k + len(samples)], f.es[h_i, j, k : k + len(samples)] = empirical(samples, a)


def _mean_of_last(v: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(n - 1, np.nan), np.convolve(v, np.ones(n) / n, "valid")])


def har_proxy(r: np.ndarray, at: np.ndarray, cfg: WalkForward) -> Forecasts:
    f = Forecasts.empty(cfg, len(at))
    v = r * r
    x = np.column_stack([np.ones_like(v), *(_mean_of_last(v, n) for n in (1, 5, 22))])
    coef: dict[int, np.ndarray] = {}
    fitted = False
    for k, i in enumerate(at):
        if k % cfg.refit_every == 0 or not fitted:
            first, fits = i - cfg.window + 1, {}
            try:
                for h in cfg.horizons:
                    t = np.arange(first + 21, i + 1 - h)
                    if len(t) < 100:
                        raise ValueError(f"too few observations for horizon {h}")
                    y = np.convolve(v[first : i + 1], np.ones(h), "valid")[22:][: len(t)]
                    fits[h] = np.linalg.lstsq(x[t], y, rcond=None)[0]
                coef, fitted = fits, True
                f.refits += 1
            except (ValueError, np.linalg.LinAlgError) as e:
                f.errors[k] = repr(e)
                continue
        floor = 0.05 * v[i - cfg.window + 1 : i + 1].mean()
        f.sigma2[:, k] = [max(x[i] @ coef[h], floor * h) for h in cfg.horizons]
    return f.normal(cfg)


def garch(asymmetric: bool, student: bool) -> Callable[[np.ndarray, np.ndarray, WalkForward], Forecasts]:
    """Parameters by block; a block whose fit didn't converge loses its first origin and keeps the parameters, as the first
    block does until a fit succeeds."""

    def run(r: np.ndarray, at: np.ndarray, cfg: WalkForward) -> Forecasts:
        f = Forecasts.empty(cfg, len(at))
        starts = np.arange(0, len(at), cfg.refit_every)
        fits = fit_blocks(windows(r, at[starts], cfg.window), asymmetric, student)
        block, fitted = np.arange(len(at)) // cfg.refit_every, False
        use: list[np.ndarray] = []
        held = None
        for k in range(len(at)):
            if k % cfg.refit_every == 0 or not fitted:
                if k % cfg.refit_every == 0:
                    fit = {n: x[block[k]] for n, x in fits.items()}
                else:
                    fit = {n: x[0] for n, x in fit_blocks(windows(r, at[k : k + 1], cfg.window), asymmetric, student).items()}
                f.refits += int(fit["converged"])
                fitted = fitted or bool(fit["converged"])
                held = fit
                if not fit["converged"]:
                    f.errors[k] = "fit did not converge"
            use.append(np.array([held[n] for n in ("omega", "alpha", "beta", "gamma", "nu")]))
        params = np.stack(use) if use else np.zeros((0, 5))
        for k in range(0, len(at), CHUNK * 8):
            p = params[k : k + CHUNK * 8]
            s2 = next_variances(windows(r, at[k : k + CHUNK * 8], cfg.window), *p.T[:4])
            pers = np.minimum(p[:, 1] + p[:, 2] + p[:, 3] / 2, 0.9995 - 1e-6)
            mean = p[:, 0] / (1 - pers)
            for h_i, h in enumerate(cfg.horizons):
                steps = pers ** np.arange(h)[:, None]
                f.sigma2[h_i, k : k + len(p)] = (mean + steps * (s2 - mean)).sum(axis=0) / 1e4
        if not student:
            f.normal(cfg)
        else:
            for nu in np.unique(params[:, 4]):
                same = params[:, 4] == nu
                for j, a in enumerate(cfg.alphas):
                    kv, ke = t_multipliers(float(nu), a)
                    f.var[:, j, same], f.es[:, j, same] = kv * np.sqrt(f.sigma2[:, same]), ke * np.sqrt(f.sigma2[:, same])
        for k in f.errors:
            f.sigma2[:, k] = f.var[:, :, k] = f.es[:, :, k] = np.nan
        return f

    return run


MODELS: dict[str, Callable[[np.ndarray, np.ndarray, WalkForward], Forecasts]] = {
    "historical": historical,
    "fhs-ewma": fhs_ewma,
    "ewma-rm": ewma_rm,
    "garch11-n": garch(False, False),
    "garch11-t": garch(False, True),
    "gjr-garch11-t": garch(True, True),
    "har-proxy": har_proxy,
}
EXTRA_MODELS = {"gjr-garch11-n": garch(True, False)}


def check_window(r: np.ndarray, least: int = 250) -> np.ndarray:
    r = np.asarray(r, float)
    if r.ndim != 1 or len(r) < least or not np.isfinite(r).all():
        raise ValueError(f"a window must be 1-D, finite and of {least} values or more")
    return r


def plug_in(model) -> Callable[[np.ndarray, np.ndarray, WalkForward], Forecasts]:
    """Adapt an object with fit(window) and forecast(window, horizons, alphas) -> [(sigma2, {alpha: var}, {alpha: es}), ...]:
    it is fitted on schedule, retried at each origin until a first success, and one bad origin doesn't end the run."""

    def run(r: np.ndarray, at: np.ndarray, cfg: WalkForward) -> Forecasts:
        f, fitted = Forecasts.empty(cfg, len(at)), False
        for k, i in enumerate(at):
            w = r[i - cfg.window + 1 : i + 1]
            try:
                check_window(w)
                if k % cfg.refit_every == 0 or not fitted:
                    model.fit(w)
                    f.refits, fitted = f.refits + 1, True
                for h_i, (s2, var, es) in enumerate(model.forecast(w, cfg.horizons, cfg.alphas)):
                    f.sigma2[h_i, k] = s2
                    f.var[h_i, :, k], f.es[h_i, :, k] = [var[a] for a in cfg.alphas], [es[a] for a in cfg.alphas]
            except Exception as e:  # noqa: BLE001 - whatever a plugged-in model raises is recorded by origin
                f.errors[k] = repr(e)
                f.sigma2[:, k] = f.var[:, :, k] = f.es[:, :, k] = np.nan
        return f

    return run
