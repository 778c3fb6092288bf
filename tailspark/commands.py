"""Commands: python -m tailspark.commands baselines | quantiles | report. Prices are Parquet with series, date and a price column."""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import quantiles as qt
from .operators import returns as ret
from .operators.models import MODELS, WalkForward
from .plans import evaluate as ev
from .plans import quantile_path as qp
from .plans import walkforward as wf
from .sources.config import load_regimes, load_universe
from .sources.panel import QuantileTable, load_prices, write_forecasts

log = logging.getLogger(__name__)


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tailspark")
    sub = top.add_subparsers(dest="command", required=True)
    runs = argparse.ArgumentParser(add_help=False)
    runs.add_argument("--prices", nargs="+", required=True, help="price files or folders")
    runs.add_argument("--universe", help="YAML: its series are kept and its price field is read")
    runs.add_argument("--tickers", nargs="*", help="only these series; unknown ones end the run")
    runs.add_argument("--window", type=int, default=1000)
    runs.add_argument("--out", required=True)
    base = sub.add_parser("baselines", parents=[runs], help="walk-forward forecasts of the baseline models")
    base.add_argument("--refit-every", type=int, default=21)
    base.add_argument("--models", nargs="*", default=list(MODELS))
    quant = sub.add_parser("quantiles", parents=[runs], help="materialise a forecaster's quantiles; a rerun adds what lacks")
    quant.add_argument("--model", default="ewma-quantiles")
    quant.add_argument("--module", help="a Python module to import first, which registers forecasters")
    quant.add_argument("--context", type=int, default=1024)
    quant.add_argument("--horizon", type=int, default=20)
    report = sub.add_parser("report", help="tables of a forecast table, as text and as Parquet")
    report.add_argument("--forecasts", required=True)
    report.add_argument("--universe", required=True)
    report.add_argument("--regimes", required=True)
    report.add_argument("--alpha", type=float, default=0.01)
    report.add_argument("--out", required=True)
    return top.parse_args(argv)


def _prices(spark: SparkSession, a: argparse.Namespace):
    universe = load_universe(a.universe) if a.universe else None
    prices = load_prices(spark, a.prices, universe.price_field if universe else "adj_close")
    if universe:
        tickers = [s["ticker"] for _, s in universe.all_series()]
        prices = prices.filter(F.col("series").isin(tickers) & F.col("date").between(F.lit(universe.start), F.lit(universe.end)))
    return ret.only_series(prices, a.tickers) if a.tickers else prices


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    a = _arguments(argv)
    spark = spark or SparkSession.builder.appName("tailspark").getOrCreate()
    if a.command == "report":
        classes = load_universe(a.universe).table(spark)
        ev.write_report(spark.read.parquet(a.forecasts), load_regimes(a.regimes), classes, a.out, alpha=a.alpha)
        log.info("wrote %s/text and %s/summary", a.out, a.out)
        return
    cfg = WalkForward(window=a.window) if a.command == "quantiles" else WalkForward(window=a.window, refit_every=a.refit_every)
    returns = wf.prepare(_prices(spark, a), cfg)
    if a.command == "quantiles":
        if a.module:
            importlib.import_module(a.module)
        qp.materialize(returns, QuantileTable(spark, a.out), qt.forecaster(a.model), a.window, a.horizon, a.context)
        log.info("%s holds %d origins", a.out, QuantileTable(spark, a.out).origins().count())
        return
    if unknown := sorted(set(a.models) - set(MODELS)):
        raise SystemExit(f"unknown models: {unknown}")
    write_forecasts(wf.forecasts(wf.walk_forward(returns, a.models, cfg)), a.out)
    done = spark.read.parquet(a.out)
    for r in wf.breach_summary(done).orderBy("model").collect():  # one row a model
        log.info("%s: 1-day 5 %% breach rate %.4f over %d days", r["model"], r["breach_rate"], r["n"])


if __name__ == "__main__":
    main()
