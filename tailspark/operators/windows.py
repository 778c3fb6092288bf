"""Rolling windows of models: origins, refit blocks, overlapping sums, regressors, recursions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import let
from .returns import by_date, forward_sum


def origins(returns: DataFrame, window: int, start: date | None = None, refit_every: int = 21) -> DataFrame:
    """Rows that have a full window behind them (and lie at start or later), with their ordinal k and refit block."""
    full = returns.withColumn("rn", F.row_number().over(by_date())).filter(F.col("rn") >= window)
    if start is not None:
        full = full.filter(F.col("date") >= F.lit(start))
    k = F.row_number().over(by_date()) - 1
    return full.withColumn("k", k).withColumn("block", F.floor(F.col("k") / refit_every).cast("int"))


def trailing(n: int):
    return by_date().rowsBetween(1 - n, 0)


def window_array(value: str, n: int) -> Column:
    """The last n values as an array, null before there are n."""
    w = trailing(n)
    return F.when(F.count(value).over(w) == n, F.collect_list(value).over(w))


def overlapping_sums(returns: DataFrame, h: int) -> DataFrame:
    w = trailing(h)
    return returns.withColumn("s", F.when(F.count("r").over(w) == h, F.sum("r").over(w)))


def har_rows(returns: DataFrame, horizon: int) -> DataFrame:
    """Means of the last 1, 5 and 22 squared returns and the forward h-sum; from the 22nd row on."""
    v = returns.withColumn("v", F.col("r") * F.col("r")).withColumn("rn", F.row_number().over(by_date()))
    means = {f"x{n}": F.avg("v").over(trailing(n)) for n in (1, 5, 22)}
    return v.withColumns(means | {"y": forward_sum(F.col("v"), horizon)}).filter(F.col("rn") >= 22)


def population_variance(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return let(mean, lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / F.size(a)


def ewma_next(a: Column, lam: float = 0.94) -> Column:
    """The recursion's value after the array, from its population variance."""
    return F.aggregate(a, population_variance(a), lambda s, x: lam * s + (1 - lam) * x * x)


def garch_next(a: Column, omega: float, alpha: float, beta: float, gamma: float = 0.0) -> Column:
    """The filter's next variance in percent squared, for an array of decimal returns; floored at 1e-12."""
    step = lambda s, x: F.greatest(omega + (alpha + F.when(x < 0, gamma).otherwise(0.0)) * x * x + beta * s, F.lit(1e-12))
    return let(F.transform(a, lambda x: x * 100), lambda pct: F.aggregate(pct, population_variance(pct), step))


def monotone(quantiles: DataFrame) -> DataFrame:
    """Crossing quantiles repaired by a running maximum over levels."""
    w = Window.partitionBy("model", "series", "context", "origin", "day").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return quantiles.withColumn("quantile", F.max("quantile").over(w))


def time_index_ok(returns: DataFrame) -> bool:
    """Whether dates are unique within each series (order is ours to impose)."""
    return returns.groupBy("series", "date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
