"""From quantile forecasts to variance, VaR and ES."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf
from ..functions.risk import check_alpha

# The default grid of levels, and the central range that gives the scale.
LEVELS = (0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.975, 0.99)
CENTRAL = (0.1, 0.9)
DAY = ["model", "series", "context", "origin", "day"]


def check_levels(levels, native=None) -> None:
    lv = list(levels)
    if not lv or any(not 0 < x < 1 for x in lv) or any(a >= b for a, b in zip(lv, lv[1:], strict=False)):
        raise ValueError("levels must increase within (0, 1)")
    if native is not None and (other := [x for x in lv if not any(abs(x - n) <= 1e-8 + 1e-5 * n for n in native)]):
        raise ValueError(f"levels the model doesn't give: {other}")


def native_levels(levels, native) -> tuple[float, ...]:
    """The requested levels that the model gives."""
    return tuple(x for x in levels if any(abs(x - n) <= 1e-8 + 1e-5 * n for n in native))


def z_of(level: Column, levels) -> Column:
    """The normal quantile of a level out of a known grid."""
    out = F.lit(None).cast("double")
    for x in levels:
        out = F.when(level == F.lit(x), F.lit(norm_ppf(x))).otherwise(out)
    return out


def central_scale(quantiles: DataFrame, levels=LEVELS) -> DataFrame:
    """DAY keys and `scale`: the slope of central quantiles on normal ones; null where it isn't positive or two levels lack."""
    central = [x for x in levels if CENTRAL[0] <= x <= CENTRAL[1]]
    if len(central) < 2:
        raise ValueError("need two central levels or more")
    q = quantiles.filter(F.col("level").between(*CENTRAL)).withColumn("z", z_of(F.col("level"), central))
    slope = F.regr_slope("quantile", "z")
    return q.groupBy(*DAY).agg(F.when((F.count("z") >= 2) & (slope > 0), slope).alias("scale"))


def from_quantiles(quantiles: DataFrame, alpha: float) -> DataFrame:
    """DAY keys, var, es off a quantile function: interpolated quantile, and the mean below it by trapezoids; the part under the
    lowest level counts at that level's quantile. Null where alpha lies outside the grid or the quantiles cross."""
    check_alpha(alpha)
    w = Window.partitionBy(*DAY).orderBy("level")
    q = quantiles.withColumns({"l2": F.lead("level").over(w), "q2": F.lead("quantile").over(w)})
    l1, q1, l2, q2 = (F.col(c) for c in ("level", "quantile", "l2", "q2"))
    at = q1 + (q2 - q1) * (alpha - l1) / (l2 - l1)
    inside = (l1 <= alpha) & (l2 > alpha)
    area = F.when(l2 <= alpha, (q1 + q2) / 2 * (l2 - l1)).when(inside, (q1 + at) / 2 * (alpha - l1)).otherwise(0.0)
    g = q.groupBy(*DAY).agg(
        F.max(F.when(inside, at)).alias("q"), F.sum(F.coalesce(area, F.lit(0.0))).alias("area"), F.min("level").alias("l0"),
        F.min_by("quantile", "level").alias("q0"), F.max(F.when(q2 < q1, 1).otherwise(0)).alias("crossed"),
    )
    ok = (F.col("l0") <= alpha) & F.col("q").isNotNull() & (F.col("crossed") == 0)
    var = F.when(ok, -F.col("q"))
    es = -(F.col("area") + F.col("l0") * F.col("q0")) / alpha
    return g.select(*DAY, var.alias("var"), F.when(ok, F.greatest(es, var)).alias("es"))


def matrix(quantiles: DataFrame, day: int, levels=LEVELS) -> DataFrame:
    """Origins by levels for one day (repeats averaged); raises if the day is absent."""
    one = quantiles.filter(F.col("day") == day)
    if one.isEmpty():
        raise ValueError(f"no quantiles for day {day}")
    return one.groupBy("model", "series", "context", "origin").pivot("level", list(levels)).avg("quantile")


def cube(quantiles: DataFrame) -> DataFrame:
    """One row per origin: days, each an ordered array of (level, quantile); raises if grids differ between days."""
    days = quantiles.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("level", "quantile"))).alias("grid"))
    grids = days.select(F.transform("grid", lambda x: x["level"]).alias("g")).distinct()
    if len(grids.take(2)) > 1:
        raise ValueError("level grids differ between days")
    return days.groupBy("model", "series", "context", "origin").agg(F.array_sort(F.collect_list(F.struct("day", "grid"))).alias("days"))


class QuantileForecaster(ABC):
    """What can be materialised: a model without fitting, from contexts of returns to quantiles of each future day.

    native_levels None: all levels; max_context None: contexts of any length; data_cutoff: the last day that the model can have
    seen in its training. A model is shipped to the workers whole, so what is large is loaded at its first use there.
    """

    name: str
    native_levels: tuple[float, ...] | None = None
    max_context: int | None = None
    data_cutoff: date | None = None

    @abstractmethod
    def predict(self, contexts: list[np.ndarray], horizon: int, levels) -> np.ndarray:
        """(contexts, horizon, levels) quantiles; contexts are whole, trimmed and finite."""

    def __call__(self, contexts, horizon: int, levels) -> np.ndarray:
        """predict() with its input and output checked: contexts trimmed to max_context, quantiles rising with their levels."""
        check_levels(levels, self.native_levels)
        if horizon < 1:
            raise ValueError("horizon must be 1 or more")
        made = []
        for c in contexts:
            c = np.asarray(c, float)
            if c.ndim != 1 or not len(c) or not np.isfinite(c).all():
                raise ValueError("a context must be 1-D and finite")
            made.append(c[-self.max_context :] if self.max_context else c)
        q = np.asarray(self.predict(made, horizon, tuple(levels)), float)
        if q.shape != (len(made), horizon, len(levels)):
            raise ValueError(f"{self.name} gave quantiles of shape {q.shape}, not {(len(made), horizon, len(levels))}")
        return np.maximum.accumulate(q, axis=2)


class EwmaQuantiles(QuantileForecaster):
    """A forecaster without weights: normal quantiles at the EWMA scale of the context, equal for all days."""

    name, max_context = "ewma-quantiles", 1024

    def __init__(self, lam: float = 0.94):
        self.lam = lam

    def predict(self, contexts: list[np.ndarray], horizon: int, levels) -> np.ndarray:
        z = np.array([norm_ppf(x) for x in levels])
        out = np.empty((len(contexts), horizon, len(z)))
        for i, c in enumerate(contexts):
            weight = (1 - self.lam) * self.lam ** np.arange(len(c) - 1, -1, -1)
            out[i] = np.sqrt(self.lam ** len(c) * c.var() + (weight * c * c).sum()) * z
        return out


class Pretrained(QuantileForecaster):
    """Any local pretrained model: load() gives, once per worker, a function (contexts, horizon, levels) -> quantiles.

    Levels that the model doesn't give itself aren't made up: only native ones can be asked for.
    """

    def __init__(self, name: str, load: Callable[[], Callable], native_levels: tuple[float, ...] | None = None, max_context: int | None = None, data_cutoff: date | None = None):
        check_levels(native_levels or (0.5,))
        self.name, self.load, self.native_levels, self.max_context, self.data_cutoff, self._model = name, load, native_levels, max_context, data_cutoff, None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def predict(self, contexts: list[np.ndarray], horizon: int, levels) -> np.ndarray:
        if self._model is None:
            self._model = self.load()
        return self._model(contexts, horizon, levels)


FORECASTERS: dict[str, Callable[[], QuantileForecaster]] = {"ewma-quantiles": EwmaQuantiles}


def register(name: str, make: Callable[[], QuantileForecaster]) -> None:
    """Make a forecaster known by a name, for forecaster() and the command line."""
    FORECASTERS[name] = make


def forecaster(name: str) -> QuantileForecaster:
    if name not in FORECASTERS:
        raise ValueError(f"unknown forecaster {name!r}: one of {sorted(FORECASTERS)}")
    return FORECASTERS[name]()


def clean_of(df: DataFrame, cutoff: date | None, origin: str = "origin") -> DataFrame:
    """df with after_cutoff: whether the origin lies after what the model can have seen; null where that isn't known."""
    known = F.lit(None).cast("boolean") if cutoff is None else F.col(origin) > F.lit(cutoff)
    return df.withColumn("after_cutoff", known)
