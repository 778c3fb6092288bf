"""Walk-forward runs: models by series, one grouped kernel per pair, failures kept beside forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import returns as ret
from ..operators.models import EXTRA_MODELS, MODELS, Forecasts, WalkForward

_OUT = "series string, origin date, model string, horizon int, alpha double, sigma2 double, var double, es double, realized double, error string, refits int"


def _forward(r: np.ndarray, h: int) -> np.ndarray:
    out = np.full(len(r), np.nan)
    if len(r) > h:
        out[: len(r) - h] = np.lib.stride_tricks.sliding_window_view(r[1:], h).sum(axis=1)
    return out


def _kernel(models: dict[str, Callable], cfg: WalkForward):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        series, model = pdf["series"].iloc[0], pdf["model"].iloc[0]
        dates, r = pdf["date"].to_numpy(), pdf["r"].to_numpy(float)
        if len(np.unique(dates)) < len(dates):
            raise ValueError(f"{series}: dates must be unique")
        first = cfg.window - 1
        if cfg.start is not None:
            first = max(first, int(np.searchsorted(dates, cfg.start)))
        at = np.arange(first, len(r))
        columns = [c.split()[0] for c in _OUT.split(", ")]
        if not len(at):
            return pd.DataFrame(columns=columns)
        # a window with a value that isn't finite fails; the model never sees it, and its schedule counts the other origins
        spoilt = np.concatenate([[0], np.cumsum(~np.isfinite(r))])
        whole = spoilt[at + 1] == spoilt[at + 1 - cfg.window]
        refused, at = at[~whole], at[whole]
        f = models[model](r, at, cfg) if len(at) else Forecasts.empty(cfg, 0)
        nh, na, n = f.var.shape
        truth = np.stack([_forward(r, h)[at] for h in cfg.horizons])
        good = ~np.isin(np.arange(n), list(f.errors))
        shape = (nh, na, n)
        keep = np.broadcast_to(good, shape).ravel()
        flat = lambda x: np.broadcast_to(x, shape).ravel()[keep]
        out = pd.DataFrame({
            "series": series, "origin": flat(dates[at]), "model": model, "horizon": flat(np.array(cfg.horizons)[:, None, None]), "alpha": flat(np.array(cfg.alphas)[None, :, None]),
            "sigma2": flat(f.sigma2[:, None, :]), "var": f.var.ravel()[keep], "es": f.es.ravel()[keep], "realized": flat(truth[:, None, :]), "error": None, "refits": f.refits,
        })
        failed = {**{at[k]: e for k, e in f.errors.items()}, **dict.fromkeys(refused, "the window holds values that aren't finite")}
        if failed:
            bad = pd.DataFrame({"series": series, "origin": [dates[i] for i in failed], "model": model, "error": list(failed.values()), "refits": f.refits})
            out = pd.concat([out, bad.reindex(columns=columns)], ignore_index=True) if len(out) else bad.reindex(columns=columns)
        out["realized"] = out["realized"].astype(object).where(out["realized"].notna(), None)
        return out[columns]

    return run


def walk_forward(returns: DataFrame, models: Iterable[str] | dict[str, Callable] = tuple(MODELS), cfg: WalkForward | None = None) -> DataFrame:
    """Forecasts and failures of all models over all series in one table: rows with `error` are failures.

    A task holds one series' history for one model. Model names resolve in MODELS, or pass {name: kernel} for plugged-in ones.
    """
    cfg = cfg or WalkForward()
    known = {**MODELS, **EXTRA_MODELS}
    chosen = dict(models) if isinstance(models, dict) else {m: known[m] for m in models}
    grid = returns.select("series", "date", "r").filter(F.col("r").isNotNull() & ~F.isnan("r")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in chosen])))
    return grid.groupBy("series", "model").applyInPandas(_kernel(chosen, cfg), _OUT)


def forecasts(run: DataFrame) -> DataFrame:
    return run.filter("error IS NULL").drop("error", "refits")


def failures(run: DataFrame) -> DataFrame:
    return run.filter("error IS NOT NULL").select("series", "model", "origin", "error")


def prepare(prices: DataFrame, cfg: WalkForward, drop_spikes: bool = True, most: float = 1.0) -> DataFrame:
    """Prices to the returns that models see: bridged log-returns, corrupt ticks out, spike pairs out, short histories out."""
    r = ret.clean(ret.log_returns(prices), most)
    if drop_spikes:
        r = ret.drop_spikes(ret.spike_flags(r))
    return ret.long_enough(r, cfg.window + 250)


def run_baselines(prices: DataFrame, cfg: WalkForward | None = None, models: Iterable[str] = tuple(MODELS)) -> tuple[DataFrame, DataFrame]:
    """The baseline grid: (forecasts, breach summary at the first horizon and the largest alpha)."""
    cfg = cfg or WalkForward()
    f = forecasts(walk_forward(prepare(prices, cfg), models, cfg))
    return f, breach_summary(f, cfg.horizons[0], max(cfg.alphas))


def breach_summary(f: DataFrame, horizon: int = 1, alpha: float = 0.05) -> DataFrame:
    from ..functions.risk import breach, close_to

    one = f.filter((F.col("horizon") == horizon) & close_to(F.col("alpha"), alpha) & F.col("realized").isNotNull())
    return one.groupBy("model").agg(F.avg(breach(F.col("realized"), F.col("var"))).alias("breach_rate"), F.count(F.lit(1)).alias("n"))
