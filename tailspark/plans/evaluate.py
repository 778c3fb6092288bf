"""Evaluation of a forecast table: losses, backtests, rankings, splits, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import breach, close_to, fz0, qlike
from ..operators.backtests import CELL, dynamic_quantile, hits, independence, kupiec
from ..operators.comparison import diebold_mariano, model_confidence_sets
from ..sources.config import Regimes
from ..sources.work import stored

# Upper 5 % points of the chi-square distribution by degrees of freedom.
CHI2_95 = {1: 3.841458820694124, 2: 5.991464547107979, 6: 12.591587243743977}


def evaluated(forecasts: DataFrame, regimes: Regimes | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Rows with a realized value, with their regime (an OR of date ranges, no join) and asset class (a small left join)."""
    f = forecasts.filter(F.col("realized").isNotNull())
    if regimes is not None:
        f = f.withColumn("regime", regimes.column(F.col("origin")))
    return f if classes is None else f.join(F.broadcast(classes.select("series", "asset_class")) if classes.count() <= 100_000 else classes.select("series", "asset_class"), "series", "left")


def loss_rows(f: DataFrame, horizon: int, alpha: float, loss: str) -> DataFrame:
    sub = f.filter((F.col("horizon") == horizon) & close_to(F.col("alpha"), alpha))
    if loss == "fz0":
        return sub.filter("var > 0 AND es >= var").withColumn("loss", fz0(F.col("var"), F.col("es"), F.col("realized"), F.col("alpha")))
    return sub.filter("sigma2 > 0").withColumn("loss", qlike(F.col("sigma2"), F.col("realized") * F.col("realized")))


def variance_table(f: DataFrame, horizon: int = 1) -> DataFrame:
    """Pooled mean QLIKE by model, at the smallest alpha (exactly), best first."""
    least = f.filter(F.col("horizon") == horizon).agg(F.min("alpha")).first()[0]
    if least is None:
        return f.sparkSession.createDataFrame([], "model string, qlike double, n long")
    sub = f.filter((F.col("horizon") == horizon) & (F.col("alpha") == least) & (F.col("sigma2") > 0))
    return sub.groupBy("model").agg(F.avg(qlike(F.col("sigma2"), F.col("realized") * F.col("realized"))).alias("qlike"), F.count(F.lit(1)).alias("n")).orderBy("qlike")


def tail_table(f: DataFrame, horizon: int, alpha: float, least: int = 200) -> DataFrame:
    """Mean FZ0, breach rate, and the share of series (of `least` rows or more) that pass each test at 5 %, best FZ0 first."""
    sub = loss_rows(f, horizon, alpha, "fz0").select(*CELL, "origin", "realized", "var", "es", "loss")
    pooled = sub.groupBy("model").agg(F.avg("loss").alias("fz0"), F.avg(breach(F.col("realized"), F.col("var"))).alias("breach_rate"))
    t = hits(sub)
    for name, df, free in (("kupiec", kupiec(t, least=least), 1), ("christoffersen", independence(t, least=least), 1), ("dq", dynamic_quantile(t, least=least), 6)):
        share = df.groupBy("model").agg(F.avg((F.col("statistic") < CHI2_95[free]).cast("int")).alias(f"pass_{name}"))
        pooled = pooled.join(share, "model", "left")
    return pooled.orderBy("fz0")


def aligned_losses(f: DataFrame, horizon: int, alpha: float, loss: str, by: list[Column] | None = None) -> DataFrame:
    """(cell, origin, model, loss): the mean over series within a date, over (origin, series) pairs that every model covers."""
    rows = loss_rows(f, horizon, alpha, loss).withColumn("cell", F.concat_ws("|", *by) if by else F.lit("all"))
    rows = rows.filter(F.col("loss").isNotNull()).select("cell", "origin", "series", "model", "loss")
    models = rows.select("cell", "model").distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    whole = rows.groupBy("cell", "origin", "series").agg(F.count_distinct("model").alias("have")).join(models, "cell").filter("have = m").select("cell", "origin", "series")
    return rows.join(whole, ["cell", "origin", "series"], "left_semi").groupBy("cell", "origin", "model").agg(F.avg("loss").alias("loss"))


def rank_models(losses: DataFrame, horizon: int, draws: int = 1000) -> DataFrame:
    """(cell, model, mean_loss, vs_best_p, mcs_p, in_mcs): Diebold-Mariano against the cell's best model, set at 90 %."""
    losses = stored(losses, "losses")
    means = losses.groupBy("cell", "model").agg(F.avg("loss").alias("mean_loss"))
    best = means.groupBy("cell").agg(F.min_by("model", F.struct("mean_loss", "model")).alias("best"))
    against = losses.join(best, "cell").filter("model != best").select("cell", "origin", "model", "loss", "best")
    of_best = losses.select("cell", "origin", F.col("model").alias("best"), F.col("loss").alias("best_loss"))
    dm = diebold_mariano(against.join(of_best, ["cell", "origin", "best"]), ["cell", "model"], "loss", "best_loss", "origin", horizon).select("cell", "model", F.col("p_value").alias("vs_best_p"))
    return means.join(dm, ["cell", "model"], "left").join(model_confidence_sets(losses, draws=draws), ["cell", "model"], "left").orderBy("cell", "mean_loss")


def split(f: DataFrame, column: str, horizon: int = 1, alpha: float = 0.01, loss: str = "fz0", least: int = 200) -> DataFrame:
    """Mean loss by model and value of `column`, starred where in the set; cells of under `least` dates are left out."""
    losses = aligned_losses(f.filter(F.col(column).isNotNull()), horizon, alpha, loss, [F.col(column)])
    enough = losses.groupBy("cell").agg(F.count_distinct("origin").alias("dates")).filter(F.col("dates") >= least).select("cell")
    ranked = rank_models(losses.join(enough, "cell", "left_semi"), horizon)
    shown = F.format_string("%.4f%s", "mean_loss", F.when(F.coalesce("in_mcs", F.lit(False)), "*").otherwise(""))
    return ranked.groupBy("model").pivot("cell").agg(F.first(shown)).orderBy("model")


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a table, whole; for reports only: a result of over `most` rows raises and should be written instead."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has over {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def report(forecasts: DataFrame, regimes: Regimes, classes: DataFrame, horizons=(1, 5, 20), alpha: float = 0.01) -> tuple[str, DataFrame]:
    """The evaluation report as text, and its summary table: QLIKE over the FZ0 ranking, columns either lacks null."""
    f = stored(evaluated(forecasts, regimes, classes), "evaluated")
    head = f.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("series").alias("series"), F.count_distinct("model").alias("models"), F.min("origin").alias("first"), F.max("origin").alias("last"))
    ql, fz = (stored(rank_models(aligned_losses(f, 1, alpha, loss), 1), f"ranking-{loss}") for loss in ("qlike", "fz0"))
    variance = stored(variance_table(f), "variance")
    parts = [("Forecasts", head), ("QLIKE, pooled", variance.orderBy("qlike")), ("QLIKE, ranking", ql.orderBy("mean_loss")), *((f"Tails, h={h}", tail_table(f, h, alpha)) for h in horizons), ("FZ0, ranking", fz.orderBy("mean_loss")), ("FZ0 by regime", split(f, "regime")), ("FZ0 by asset class", split(f, "asset_class"))]
    text = "\n\n".join(f"## {name}\n\n{markdown(df)}" for name, df in parts)
    summary = variance.withColumn("table", F.lit("qlike")).unionByName(fz.withColumn("table", F.lit("fz0")), allowMissingColumns=True)
    return text, summary


def write_report(forecasts: DataFrame, regimes: Regimes, classes: DataFrame, path: str, horizons=(1, 5, 20), alpha: float = 0.01) -> None:
    """report() as the folders `text` and `summary` under path, which any file system that Spark writes can hold."""
    text, summary = report(forecasts, regimes, classes, horizons, alpha)
    forecasts.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
