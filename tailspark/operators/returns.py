"""Returns, targets and cleaning over (series, date) panels: windows per series in row order, never calendar ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_date():
    return Window.partitionBy("series").orderBy("date")



def log_returns(prices: DataFrame) -> DataFrame:
    """(series, date, r): non-positive and null prices go first, so a return bridges the gap they leave."""
    ln = F.ln("price")
    return prices.filter((F.col("price") > 0) & ~F.isnan("price")).withColumn("r", ln - F.lag(ln).over(by_date())).filter(F.col("r").isNotNull()).select("series", "date", "r")


def squared(returns: DataFrame) -> DataFrame:
    return returns.withColumn("v", F.col("r") * F.col("r"))


def clean(returns: DataFrame, most: float = 1.0) -> DataFrame:
    return returns.filter(F.abs("r") <= most)


def long_enough(returns: DataFrame, least: int) -> DataFrame:
    """The series with `least` rows or more: counts combine before they move, and the semi-join is on the few series."""
    return returns.join(returns.groupBy("series").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("series"), "series", "left_semi")


def only_series(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named series; a name that doesn't occur raises."""
    have = {r[0] for r in df.filter(F.col("series").isin(names)).select("series").distinct().collect()}
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"unknown series: {missing}")
    return df.filter(F.col("series").isin(names))


def numbered(returns: DataFrame) -> DataFrame:
    return returns.withColumn("rn", F.row_number().over(by_date()))


def forward_sum(value, h: int, window=None):
    """The sum over the next h rows, null unless there are h of them."""
    if h < 1:
        raise ValueError("horizon must be 1 or more")
    w = (window or by_date()).rowsBetween(1, h)
    return F.when(F.count(value).over(w) == h, F.sum(value).over(w))


def targets(returns: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(series, origin, horizon, realized): all horizons from one window pass."""
    wide = returns.select("series", F.col("date").alias("origin"), *[forward_sum(F.col("r"), h).alias(f"h{h}") for h in horizons])
    return wide.select("series", "origin", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("realized")) for h in horizons])).alias("x")).select("series", "origin", "x.*")


def spike_flags(returns: DataFrame, scales: float = 12.0, retracement: float = 0.8, window: int = 121, least: int = 20) -> DataFrame:
    """returns with `spike`: a move beyond `scales` times the centred rolling median that the next row takes back.

    Series under 10 rows, rows without a scale or a successor aren't flagged.
    """
    half = window // 2
    around = by_date().rowsBetween(-half, half)
    scale = F.when(F.count("r").over(around) >= least, F.percentile(F.abs("r"), F.lit(0.5)).over(around))
    flag = (F.abs("r") > scales * scale) & (F.abs(F.col("r") + F.lead("r").over(by_date())) <= (1 - retracement) * F.abs("r"))
    return returns.withColumn("spike", F.coalesce(flag & (F.count(F.lit(1)).over(Window.partitionBy("series")) >= 10), F.lit(False)))


def drop_spikes(flagged: DataFrame) -> DataFrame:
    """Without flagged rows and the row after each."""
    after = F.coalesce(F.lag("spike").over(by_date()), F.lit(False))
    return flagged.withColumn("_after", after).filter(~F.col("spike") & ~F.col("_after")).drop("_after", "spike")
