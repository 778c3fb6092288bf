"""Universe and regime settings from YAML, checked, as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

import yaml
from pyspark.sql import DataFrame, SparkSession

# The asset classes a universe may have.
ASSET_CLASSES = ("equity_index", "equity_single", "fx", "crypto", "commodity", "bond_etf")


@dataclass(frozen=True)
class Universe:
    start: date
    end: date
    series: dict[str, list[dict]]
    price_field: str = "adj_close"

    def __post_init__(self):
        if unknown := set(self.series) - set(ASSET_CLASSES):
            raise ValueError(f"unknown asset classes: {sorted(unknown)}")
        for day in (self.start, self.end):
            if not isinstance(day, date):
                raise ValueError(f"start and end must be dates: {day!r}")
        if self.start >= self.end:
            raise ValueError("start must precede end")
        names = [_checked(s, ("ticker",), ("name",), "a series")["ticker"] for _, s in self.all_series()]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"series named twice: {twice}")

    def all_series(self) -> list[tuple[str, dict]]:
        return [(k, s) for k, specs in self.series.items() for s in specs]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s["ticker"], s.get("name"), k) for k, s in self.all_series()], "series string, name string, asset_class string")

    def select(self, names: list[str]) -> list[tuple[str, dict]]:
        have = {s["ticker"]: (k, s) for k, s in self.all_series()}
        if unknown := [n for n in names if n not in have]:
            raise ValueError(f"unknown series: {unknown}")
        return [have[n] for n in names]


@dataclass(frozen=True)
class Regimes:
    windows: list[tuple[str, date, date]] = field(default_factory=list)

    def __post_init__(self):
        for name, start, end in self.windows:
            if start >= end:
                raise ValueError(f"{name}: start must precede end")
        ordered = sorted(self.windows, key=lambda w: w[1])
        for a, b in zip(ordered, ordered[1:], strict=False):
            if b[1] <= a[2]:
                raise ValueError(f"{a[0]} and {b[0]} overlap")

    def is_crisis(self, day: date) -> bool:
        return any(a <= day <= b for _, a, b in self.windows)

    def column(self, day):
        """The regime of a date column, as one filter-like expression: no join."""
        from pyspark.sql import functions as F

        cond = F.lit(False)
        for _, a, b in self.windows:
            cond = cond | day.between(F.lit(a), F.lit(b))
        return F.when(cond, "crisis").otherwise("calm")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.windows, "name string, start date, end date")


def _checked(x, must: tuple[str, ...], may: tuple[str, ...], what: str) -> dict:
    """x, if it is a mapping with the keys that it must and may have."""
    if not isinstance(x, dict):
        raise ValueError(f"{what} must be a mapping: {x!r}")
    if missing := [k for k in must if x.get(k) is None]:
        raise ValueError(f"{what} lacks {missing}")
    if unknown := sorted(set(x) - {*must, *may}, key=str):
        raise ValueError(f"{what} has unknown keys {unknown}")
    return x


def _read(path: str):
    with open(path) as f:
        return yaml.safe_load(f)


def load_universe(path: str) -> Universe:
    """A YAML file of start, end, price_field (adj_close by default) and series: asset class -> list of ticker and name."""
    x = _checked(_read(path), ("start", "end", "series"), ("price_field",), "a universe")
    if not isinstance(x["series"], dict) or not all(isinstance(v, list) for v in x["series"].values()):
        raise ValueError("series must map asset classes to lists")
    return Universe(x["start"], x["end"], x["series"], x.get("price_field") or "adj_close")


def load_regimes(path: str) -> Regimes:
    """A YAML file of crisis_windows: a list of name, start and end."""
    x = _checked(_read(path), ("crisis_windows",), (), "regimes")
    rows = [_checked(w, ("name", "start", "end"), (), "a crisis window") for w in x["crisis_windows"]]
    return Regimes([(w["name"], w["start"], w["end"]) for w in rows])
