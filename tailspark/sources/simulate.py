"""Synthetic (GJR-)GARCH series."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Days before the first one that is kept; the default parameters below belong to the same process.
BURN_IN = 1000


def garch_path(n: int, omega: float = 0.05, alpha: float = 0.08, beta: float = 0.90, gamma: float = 0.0, nu: float | None = None, seed: int = 42) -> np.ndarray:
    """n decimal returns of a zero-mean process whose parameters are in percent; innovations normal, or Student-t of unit variance."""
    if (p := alpha + beta + gamma / 2) >= 1:
        raise ValueError("the process must be stationary")
    rng = np.random.default_rng(seed)
    total = n + BURN_IN
    z = rng.standard_normal(total) if nu is None else rng.standard_t(nu, total) * math.sqrt((nu - 2) / nu)
    out, s2 = np.empty(total), omega / (1 - p)
    for t, e in enumerate(z.tolist()):
        x = math.sqrt(s2) * e
        out[t] = x
        s2 = omega + (alpha + gamma * (x < 0)) * x * x + beta * s2
    return out[BURN_IN:] / 100


def garch_panel(spark: SparkSession, series: int, n: int, seed: int = 42, **params) -> DataFrame:
    """`series` simulated series of n days each, one task a series: (series, date, r)."""

    def make(batches):
        for pdf in batches:
            for k in pdf["id"]:
                days = [date(2000, 1, 1) + timedelta(days=i) for i in range(n)]
                yield pd.DataFrame({"series": f"s{k}", "date": days, "r": garch_path(n, seed=seed + int(k), **params)})

    return spark.range(series).repartition(max(1, series)).mapInPandas(make, "series string, date date, r double")
