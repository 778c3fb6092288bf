"""The registered queries over the driver's tables, and the same in SQL.

There is no price table: a panel of daily prices is the mean lineitem price per return flag and ship date (or order priority and
order date, or event type and hour). Doubles are rounded on both sides, dates are text.
"""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.dist import fit_t_nu, implied_nu, norm_ppf, t_multipliers
from ..operators import backtests as bt
from ..operators import comparison as cmp
from ..operators import quantiles as qt
from ..operators import returns as ret
from ..operators import windows as win
from ..operators.models import WalkForward
from ..sources.config import Regimes, Universe
from ..sources.panel import first_writer_wins, prices_from, quantile_file_column, safe_name_column
from ..sources.simulate import garch_panel
from ..sources.work import stored
from . import evaluate as ev
from . import quantile_path as qp
from . import walkforward as wf

QUERIES, ORACLES = {}, {}
W = 250
ALPHAS = (0.01, 0.05)
GRID = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
REGIMES = Regimes([("first", date(1996, 3, 1), date(1996, 12, 31)), ("second", date(1998, 8, 1), date(1999, 2, 28)), ("third", date(2000, 3, 1), date(2001, 1, 31))])
CLASSES = [("A", "equity_index"), ("N", "fx")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text."""
    fix = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[fix[t](f"`{c}`").alias(c) if t in fix else F.col(f"`{c}`") for c, t in df.dtypes])


def prices(spark, d):
    return prices_from(table(spark, d, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice")


def orders_prices(spark, d):
    return prices_from(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def returns(spark, d):
    return ret.clean(ret.log_returns(prices(spark, d)))


PX = "px AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS price FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2)"
OPX = PX.replace("l_returnflag", "o_orderpriority").replace("l_shipdate", "o_orderdate").replace("l_extendedprice", "o_totalprice").replace("lineitem", "orders")
LR = "lr AS (SELECT * FROM (SELECT series, date, ln(price) - lag(ln(price)) OVER (PARTITION BY series ORDER BY date) AS r FROM px WHERE price > 0) WHERE r IS NOT NULL)"
RT = "rt AS (SELECT series, date, r, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM lr WHERE abs(r) <= 1)"
BASE = f"WITH {PX}, {LR}, {RT}"
F250 = f"WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW), o AS (PARTITION BY series ORDER BY date)"
WN = f"wn AS (SELECT series, date, rn, r, list(r) OVER f AS l, var_pop(r) OVER f AS v0, quantile_cont(r, 0.01) OVER f AS q0, quantile_cont(r, 0.05) OVER f AS q1, lead(r) OVER o AS y FROM rt {F250}), wo AS (SELECT *, list_reduce(l, lambda s, x: 0.94 * s + 0.06 * x * x, v0) AS s2 FROM wn WHERE rn >= {W})"
# Fixed values, from tables: VaR and ES of the standard normal, and quantiles of Student's t with 5 degrees of freedom, at ALPHAS.
_K = [(2.3263478740408408, 2.665214220345806), (1.6448536269514722, 2.062712807507426)]
_Q5 = [-3.364929998907206, -2.015048373333022]
# VaR and ES of that t at variance 1, by its density 8 / (3 pi sqrt 5) * (1 + q*q/5)^-3
_T5 = [(f"(sqrt(0.6::DOUBLE) * {-q!r}::DOUBLE)", f"(sqrt(0.6::DOUBLE) * 8 / (3 * pi() * sqrt(5)) * pow(1 + {q * q!r}::DOUBLE / 5, -3) / {a} * (5 + {q * q!r}::DOUBLE) / 4)") for q, a in zip(_Q5, ALPHAS)]
# Normal quantiles of GRID; upper 5 % points of chi-square with 1 and 6 degrees of freedom.
_NORMAL = (-2.3263478740408408, -1.6448536269514722, -1.2815515655446004, -0.6744897501960817, 0.0, 0.6744897501960817, 1.2815515655446004, 2.3263478740408408)
_CHI1, _CHI6 = 3.841458820694124, 12.591587243743977
FC = "fc AS (" + " UNION ALL ".join(
    f"SELECT series, date AS origin, 'ewma-rm' AS model, 1 AS horizon, {a}::DOUBLE AS alpha, s2 AS sigma2, sqrt(s2) * {_K[j][0]!r}::DOUBLE AS var, sqrt(s2) * {_K[j][1]!r}::DOUBLE AS es, y AS realized FROM wo UNION ALL "
    f"SELECT series, date, 'historical', 1, {a}::DOUBLE, v0, -q{j}, -list_avg(list_filter(l, lambda x: x <= q{j})), y FROM wo"
    for j, a in enumerate(ALPHAS)
) + ")"
FCS = f"{BASE}, {WN}, {FC}"
FZ = "-(CASE WHEN realized <= -var THEN 1 ELSE 0 END) * (var + realized) / (alpha * es) + var / es + ln(es) - 1"


def forecasts(spark, d):
    """Two models at horizon 1 by the walk-forward kernels: many alphas share a window's sort there."""
    cfg = WalkForward(window=W, horizons=(1,), alphas=ALPHAS)
    return wf.forecasts(wf.walk_forward(returns(spark, d), ["ewma-rm", "historical"], cfg))


def closed_forecasts(spark, d):
    """The same as column expressions: one window pass, no Python."""
    r = returns(spark, d).withColumns({"rn": F.row_number().over(ret.by_date()), "l": win.window_array("r", W), "realized": ret.forward_sum(F.col("r"), 1)})
    r = r.filter(F.col("rn") >= W).withColumns({"s2": win.ewma_next(F.col("l")), "v0": win.population_variance(F.col("l"))})
    rows = []
    for a in ALPHAS:
        nv, ne = risk.var_es_normal(F.sqrt("s2"), a)
        hv, he = risk.var_es_sample(F.col("l"), a)
        rows += [F.struct(F.lit(m).alias("model"), F.lit(a).alias("alpha"), F.col(s).alias("sigma2"), v.alias("var"), e.alias("es")) for m, s, v, e in (("ewma-rm", "s2", nv, ne), ("historical", "v0", hv, he))]
    out = r.select("series", F.col("date").alias("origin"), "realized", F.explode(F.array(*rows)).alias("x"))
    return out.select("series", "origin", "x.model", F.lit(1).alias("horizon"), "x.alpha", "x.sigma2", "x.var", "x.es", "realized")


def done(spark, d):
    """Written once: evaluations read it several times."""
    return stored(forecasts(spark, d).filter("realized IS NOT NULL"), "forecasts")


FCD = f"{FCS}, fd AS (SELECT * FROM fc WHERE realized IS NOT NULL)"

# ------------------------------------------------------------------ sources


@query(f"WITH {PX} SELECT series, CAST(date AS VARCHAR) AS date, round(price, 7) AS price FROM px")
def s02_price_scan(spark, d):
    return rounded(prices(spark, d), 7)


@query("SELECT * FROM (VALUES ('equity_index', 'A', 'first'), ('equity_index', 'B', 'second'), ('fx', 'N', NULL)) t(asset_class, series, name)")
def s05_universe(spark, d):
    u = Universe(date(1995, 1, 1), date(2002, 1, 1), {"equity_index": [{"ticker": "A", "name": "first"}, {"ticker": "B", "name": "second"}], "fx": [{"ticker": "N"}]})
    return u.table(spark).select("asset_class", "series", "name")


@query("SELECT DISTINCT regexp_replace(p_brand || '=' || p_type, '[^A-Za-z0-9_-]', '_', 'g') AS file FROM part")
def s01_safe_names(spark, d):
    return table(spark, d, "part").select(safe_name_column(F.concat_ws("=", "p_brand", "p_type")).alias("file")).distinct()


@query("SELECT DISTINCT regexp_replace(p_brand || '.' || p_size, '[^A-Za-z0-9_.-]', '_', 'g') || '/' || regexp_replace('^' || p_type || '/' || p_partkey % 7, '[^A-Za-z0-9_.-]', '_', 'g') || '__h20__c1024.parquet' AS quantile_file FROM part")
def s06_cache_paths(spark, d):
    p = table(spark, d, "part")
    model, series = F.concat_ws(".", "p_brand", "p_size"), F.concat(F.lit("^"), "p_type", F.lit("/"), F.col("p_partkey") % 7)
    return p.select(quantile_file_column(model, series, 20, 1024).alias("quantile_file")).distinct()


@query(f"""{FCS} SELECT CASE WHEN origin BETWEEN DATE '1996-03-01' AND DATE '1996-12-31' OR origin BETWEEN DATE '1998-08-01' AND DATE '1999-02-28' OR origin BETWEEN DATE '2000-03-01' AND DATE '2001-01-31' THEN 'crisis' ELSE 'calm' END AS regime,
asset_class, model, count(*) AS n FROM fc LEFT JOIN (VALUES ('A', 'equity_index'), ('N', 'fx')) c(series, asset_class) ON fc.series = c.series WHERE realized IS NOT NULL GROUP BY 1, 2, 3""")
def s10_evaluation_scan(spark, d):
    f = ev.evaluated(forecasts(spark, d), REGIMES, spark.createDataFrame(CLASSES, "series string, asset_class string"))
    return f.groupBy("regime", "asset_class", "model").agg(F.count(F.lit(1)).alias("n"))


@query()
def s13_simulated_panel(spark, d):
    return garch_panel(spark, 3, 500, nu=6.0)


# ------------------------------------------------------------------ returns


@query(f"WITH {PX}, {LR} SELECT series, CAST(date AS VARCHAR) AS date, round(r, 6) + 0.0 AS r FROM lr")
def p01_log_returns(spark, d):
    return rounded(ret.log_returns(prices(spark, d)))


@query(f"WITH {PX}, {LR} SELECT series, round(sum(r * r), 6) AS v FROM lr GROUP BY 1")
def p02_squared(spark, d):
    return rounded(ret.squared(ret.log_returns(prices(spark, d))).groupBy("series").agg(F.sum("v").alias("v")))


@query(f"{BASE} SELECT series, count(*) AS n, round(sum(r), 6) AS total FROM rt GROUP BY 1")
def p03_clean(spark, d):
    return rounded(returns(spark, d).groupBy("series").agg(F.count("r").alias("n"), F.sum("r").alias("total")))


@query("""WITH px AS (SELECT event_type AS series, date_trunc('hour', ts) AS date, avg(value) AS price FROM events GROUP BY 1, 2),
lr AS (SELECT * FROM (SELECT series, date, ln(price) - lag(ln(price)) OVER (PARTITION BY series ORDER BY date) AS r FROM px WHERE price > 0) WHERE r IS NOT NULL)
SELECT series, n, n >= 600 AS kept FROM (SELECT series, count(*) AS n FROM lr GROUP BY 1)""")
def p04_min_history(spark, d):
    e = table(spark, d, "events")
    hourly = e.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("date")).agg(F.avg("value").alias("price"))
    r = ret.log_returns(hourly)
    long = ret.long_enough(r, 600).select("series").distinct().withColumn("kept", F.lit(True))
    return r.groupBy("series").agg(F.count(F.lit(1)).alias("n")).join(long, "series", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query(f"{BASE} SELECT series, count(*) AS n FROM rt WHERE series IN ('A', 'R') GROUP BY 1")
def p05_select_series(spark, d):
    return ret.only_series(returns(spark, d), ["A", "R"]).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FCS} SELECT model, count(*) AS n, round(avg(var), 6) AS var FROM fc WHERE horizon = 1 AND abs(alpha - 0.05) <= 1e-8 + 1e-5 * 0.05 AND var > 0 AND es >= var AND sigma2 > 0 GROUP BY 1")
def p06_p07_slices(spark, d):
    f = forecasts(spark, d).filter((F.col("horizon") == 1) & risk.close_to(F.col("alpha"), 0.05)).filter("var > 0 AND es >= var AND sigma2 > 0")
    return rounded(f.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("var").alias("var")))


@query(f"{FCD} SELECT series, model, alpha, CAST(sum(CASE WHEN realized < -var THEN 1 ELSE 0 END) AS BIGINT) AS breaches FROM fd GROUP BY 1, 2, 3")
def p08_breaches(spark, d):
    return bt.hits(done(spark, d)).groupBy("series", "model", "alpha").agg(F.sum("hit").alias("breaches"))


@query("SELECT level FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(level)")
def p11_native_levels(spark, d):
    qt.check_levels(GRID)
    return spark.createDataFrame([(x,) for x in qt.native_levels(GRID, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))], "level double")


@query(f"{BASE} SELECT series, CAST(date AS VARCHAR) AS origin, round(sum(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 511 PRECEDING AND CURRENT ROW), 6) + 0.0 AS total, least(rn, 512) AS n FROM rt QUALIFY rn >= {W}")
def j08_p13_contexts(spark, d):
    c = qp.contexts(returns(spark, d), W, 512)
    return rounded(c.select("series", "origin", F.aggregate("x", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("x").cast("long").alias("n")))


def _fwd(h: int) -> str:
    f = f"OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(r) {f} = {h} THEN sum(r) {f} END"


@query(f"{BASE} " + " UNION ALL ".join(f"SELECT series, CAST(date AS VARCHAR) AS origin, {h} AS horizon, round({_fwd(h)}, 6) + 0.0 AS realized FROM rt" for h in (1, 5, 20)))
def w02_j03_forward_sums(spark, d):
    return rounded(ret.targets(returns(spark, d), (1, 5, 20)))


_SPIKES = f"""WITH {OPX}, {LR}, sc AS (SELECT *, CASE WHEN count(r) OVER a >= 20 THEN median(abs(r)) OVER a END AS scale, lead(r) OVER o AS nxt, count(*) OVER (PARTITION BY series) AS n FROM lr
WINDOW a AS (PARTITION BY series ORDER BY date ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING), o AS (PARTITION BY series ORDER BY date)),
fl AS (SELECT series, date, r, coalesce(abs(r) > 3 * scale AND abs(r + nxt) <= (1 - 0.8) * abs(r), false) AND n >= 10 AS spike FROM sc)"""


@query(f"{_SPIKES} SELECT series, CAST(date AS VARCHAR) AS date FROM fl WHERE spike")
def w03_spikes(spark, d):
    return rounded(ret.spike_flags(ret.log_returns(orders_prices(spark, d)), scales=3.0).filter("spike").select("series", "date"))


@query(f"{_SPIKES} SELECT series, count(*) AS n, round(sum(r), 6) AS total FROM (SELECT *, lag(spike) OVER (PARTITION BY series ORDER BY date) AS after FROM fl) WHERE NOT spike AND NOT coalesce(after, false) GROUP BY 1")
def w04_drop_spikes(spark, d):
    kept = ret.drop_spikes(ret.spike_flags(ret.log_returns(orders_prices(spark, d)), scales=3.0))
    return rounded(kept.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total")))


@query(f"{BASE} SELECT series, CAST(date AS VARCHAR) AS origin, k, CAST(floor(k / 21.0) AS INTEGER) AS block FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS k FROM rt WHERE rn >= {W} AND date >= DATE '1997-01-01')")
def w05_w06_origins(spark, d):
    o = win.origins(returns(spark, d), W, date(1997, 1, 1))
    return rounded(o.select("series", F.col("date").alias("origin"), "k", "block"))


@query(f"{BASE}, s AS (SELECT series, CASE WHEN count(r) OVER w = 5 THEN sum(r) OVER w END AS s FROM rt WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT series, count(s) AS n, round(min(s), 6) AS low, round(var_pop(s), 6) AS v FROM s GROUP BY 1")
def w07_overlapping_sums(spark, d):
    s = win.overlapping_sums(returns(spark, d), 5)
    return rounded(s.groupBy("series").agg(F.count("s").alias("n"), F.min("s").alias("low"), F.var_pop("s").alias("v")))


@query(f"""{BASE}, v AS (SELECT series, date, rn, r * r AS v FROM rt), h AS (SELECT series, date, rn, v AS x1, avg(v) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x5,
avg(v) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS x22, {_fwd(5).replace("count(r)", "count(v)").replace("sum(r)", "sum(v)")} AS y FROM v)
SELECT series, CAST(date AS VARCHAR) AS origin, round(x1, 6) + 0.0 AS x1, round(x5, 6) + 0.0 AS x5, round(x22, 6) + 0.0 AS x22, round(y, 6) + 0.0 AS y FROM h WHERE rn >= 22""")
def w09_w10_har_rows(spark, d):
    return rounded(win.har_rows(returns(spark, d), 5).select("series", F.col("date").alias("origin"), "x1", "x5", "x22", "y"))


@query(f"{BASE}, {WN} SELECT series, CAST(date AS VARCHAR) AS origin, round(s2, 6) AS s2 FROM wo")
def w11_ewma(spark, d):
    r = returns(spark, d).withColumn("l", win.window_array("r", W)).filter("l IS NOT NULL")
    return rounded(r.select("series", F.col("date").alias("origin"), win.ewma_next(F.col("l")).alias("s2")))


@query(f"{BASE}, {WN} SELECT series, CAST(date AS VARCHAR) AS origin, round(list_reduce(list_transform(l, lambda x: x * 100), lambda s, x: greatest(0.05 + (0.08 + CASE WHEN x < 0 THEN 0.04 ELSE 0 END) * x * x + 0.85 * s, 1e-12), v0 * 10000), 3) AS s2 FROM wo")
def w12_garch_filter(spark, d):
    r = returns(spark, d).withColumn("l", win.window_array("r", W)).filter("l IS NOT NULL")
    return rounded(r.select("series", F.col("date").alias("origin"), win.garch_next(F.col("l"), 0.05, 0.08, 0.85, 0.04).alias("s2")), 3)


# ------------------------------------------------------------------ joins and sets


@query(f"{BASE} SELECT a.series, CAST(b.date AS VARCHAR) AS origin, count(*) AS n, round(sum(a.r), 6) + 0.0 AS total FROM rt a JOIN rt b ON a.series = b.series AND a.rn BETWEEN b.rn - 21 AND b.rn WHERE b.rn >= 22 GROUP BY 1, 2")
def j07_window_members(spark, d):
    r = win.origins(returns(spark, d), 1)
    w = win.trailing(22)
    rows = r.withColumns({"n": F.count("r").over(w), "total": F.sum("r").over(w)}).filter("rn >= 22")
    return rounded(rows.select("series", F.col("date").alias("origin"), "n", "total"))


@query(f"{BASE}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS origin FROM orders), n AS (SELECT DISTINCT series FROM rt) SELECT n.series, count(*) AS origins, count(r) AS matched, round(sum(r), 6) AS total FROM n CROSS JOIN o LEFT JOIN rt ON rt.date = o.origin AND rt.series = n.series GROUP BY 1")
def j04_reindex(spark, d):
    r = returns(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    # the panel's few series times the dates of a calendar
    grid = o.withColumn("series", F.explode(F.array(*[F.lit(x[0]) for x in r.select("series").distinct().orderBy("series").collect()])))
    j = grid.join(r, ["series", "date"], "left")
    return rounded(j.groupBy("series").agg(F.count(F.lit(1)).alias("origins"), F.count("r").alias("matched"), F.sum("r").alias("total")))


_NEW = f"{BASE}, a AS (SELECT series, date AS origin, round(r, 6) AS r FROM rt WHERE rn <= 900), b AS (SELECT series, date AS origin, round(-r, 6) AS r FROM rt WHERE rn > 600)"


@query(f"{_NEW} SELECT series, CAST(origin AS VARCHAR) AS origin, r + 0.0 AS r FROM (SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a ON a.series = b.series AND a.origin = b.origin)")
def u03_j05_first_writer_wins(spark, d):
    r = win.origins(returns(spark, d), 1).withColumnRenamed("date", "origin")
    old, new = r.filter("rn <= 900").select("series", "origin", "r"), r.filter("rn > 600").select("series", "origin", (-F.col("r")).alias("r"))
    return rounded(first_writer_wins(old, new, ["series", "origin"]))


@query(f"{_NEW} SELECT b.series, count(*) AS todo FROM b ANTI JOIN a ON a.series = b.series AND a.origin = b.origin GROUP BY 1")
def j06_todo_origins(spark, d):
    r = win.origins(returns(spark, d), 1).select("series", F.col("date").alias("origin"), "rn")
    return r.filter("rn > 600").join(r.filter("rn <= 900").select("series", "origin"), ["series", "origin"], "left_anti").groupBy("series").agg(F.count(F.lit(1)).alias("todo"))


@query("SELECT s.series, m.model, h.horizon, a.alpha FROM (SELECT DISTINCT l_returnflag AS series FROM lineitem) s, (VALUES ('historical'), ('ewma-rm'), ('har-proxy')) m(model), (VALUES (1), (5), (20)) h(horizon), (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) a(alpha)")
def j09_grid(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series")).distinct()
    lits = lambda *x: F.explode(F.array(*map(F.lit, x)))
    return s.withColumn("model", lits("historical", "ewma-rm", "har-proxy")).withColumn("horizon", lits(1, 5, 20)).withColumn("alpha", lits(0.01, 0.05))


_CELLS = """x AS (SELECT * FROM fd WHERE alpha = 0.05 AND NOT (model = 'historical' AND series = 'R' AND day(origin) < 10)),
cl AS (SELECT origin, series FROM x GROUP BY 1, 2 HAVING count(DISTINCT model) = 2)"""


@query(f"{FCD}, {_CELLS} SELECT CAST(origin AS VARCHAR) AS origin, model, round(avg({FZ}), 6) + 0.0 AS loss FROM x SEMI JOIN cl ON x.origin = cl.origin AND x.series = cl.series GROUP BY 1, 2")
def j11_a04_aligned_losses(spark, d):
    f = done(spark, d).filter(~((F.col("model") == "historical") & (F.col("series") == "R") & (F.dayofmonth("origin") < 10)))
    return rounded(ev.aligned_losses(f, 1, 0.05, "fz0").drop("cell"))


# ------------------------------------------------------------------ measures and losses


@query(f"{BASE}, {WN} " + " UNION ALL ".join(f"SELECT series, CAST(date AS VARCHAR) AS origin, {a}::DOUBLE AS alpha, round(sqrt(s2) * {_K[j][0]!r}::DOUBLE, 6) AS nv, round(sqrt(s2) * {_K[j][1]!r}::DOUBLE, 6) AS ne, round(sqrt(s2) * {_T5[j][0]}, 6) AS tv, round(sqrt(s2) * {_T5[j][1]}, 6) AS te FROM wo" for j, a in enumerate(ALPHAS)))
def f01_f02_parametric(spark, d):
    f = closed_forecasts(spark, d).filter("model = 'ewma-rm'")
    out = None
    for a in ALPHAS:
        (nv, ne), (tv, te) = risk.var_es_normal(F.sqrt("sigma2"), a), risk.var_es_student_t(F.sqrt("sigma2"), 5.0, a)
        one = f.filter(F.col("alpha") == a).select("series", "origin", "alpha", nv.alias("nv"), ne.alias("ne"), tv.alias("tv"), te.alias("te"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"{FCS} SELECT series, CAST(origin AS VARCHAR) AS origin, alpha, round(sigma2, 6) AS sigma2, round(var, 6) AS var, round(es, 6) AS es FROM fc WHERE model = 'historical'")
def m01_f03_historical(spark, d):
    return rounded(closed_forecasts(spark, d).filter("model = 'historical'").select("series", "origin", "alpha", "sigma2", "var", "es"))


@query(f"""{BASE}, s AS (SELECT series, date, rn, CASE WHEN rn >= 5 THEN sum(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS s FROM rt),
q AS (SELECT *, list(s) OVER f AS l, quantile_cont(s, 0.05) OVER f AS q, var_pop(s) OVER f AS v FROM s WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN {W - 5} PRECEDING AND CURRENT ROW))
SELECT series, CAST(date AS VARCHAR) AS origin, round(v, 6) AS sigma2, round(-q, 6) AS var, round(-list_avg(list_filter(l, lambda x: x <= q)), 6) AS es FROM q WHERE rn >= {W}""")
def m01_historical_h5(spark, d):
    cfg = WalkForward(window=W, horizons=(5,), alphas=(0.05,))
    f = wf.forecasts(wf.walk_forward(returns(spark, d), ["historical"], cfg))
    return rounded(f.select("series", "origin", "sigma2", "var", "es"))


@query(f"{FCS} SELECT series, CAST(origin AS VARCHAR) AS origin, alpha, round(sigma2, 6) AS sigma2, round(var, 6) AS var, round(es, 6) AS es, round(realized, 6) + 0.0 AS realized FROM fc WHERE model = 'ewma-rm'")
def m03_e01_ewma_walk_forward(spark, d):
    cfg = WalkForward(window=W, horizons=(1,), alphas=ALPHAS)
    f = wf.forecasts(wf.walk_forward(returns(spark, d), ["ewma-rm"], cfg))
    return rounded(f.select("series", "origin", "alpha", "sigma2", "var", "es", "realized"))


def _cholesky(k: int, a: str, b: str) -> str:
    """Select items that factor a symmetric matrix of columns {a}{i}_{j} (i <= j) and solve for {b}{i} half-way: z0, z1, ..."""
    out = []
    for i in range(k):
        for j in range(i):
            out.append(f"({a}{j}_{i} - (0{''.join(f' + l{i}_{m} * l{j}_{m}' for m in range(j))})) / l{j}_{j} AS l{i}_{j}")
        out.append(f"sqrt({a}{i}_{i} - (0{''.join(f' + l{i}_{m} * l{i}_{m}' for m in range(i))})) AS l{i}_{i}")
        out.append(f"({b}{i} - (0{''.join(f' + l{i}_{m} * z{m}' for m in range(i))})) / l{i}_{i} AS z{i}")
    return ", ".join(out)


def _har(h: int) -> str:
    """HAR by normal equations over 1e4 times the squared returns, at each 21st origin and carried to the next."""
    p, over = f"q{h}", f"OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {W - 22} PRECEDING AND {h} PRECEDING)"
    y = f"sum(v) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""{p}0 AS (SELECT series, date, rn, 1.0::DOUBLE AS x0, x1, x5 AS x2, x22 AS x3, {y} AS y, avg(v) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS mean FROM hv),
{p}1 AS (SELECT *, {", ".join(f"sum(x{i} * x{j}) {over} AS a{i}_{j}" for i in range(4) for j in range(i, 4))}, {", ".join(f"sum(x{i} * y) {over} AS b{i}" for i in range(4))} FROM {p}0),
{p}2 AS (SELECT *, {_cholesky(4, "a", "b")} FROM {p}1 WHERE rn >= {W} AND (rn - {W}) % 21 = 0),
{p}3 AS (SELECT series, (rn - {W}) // 21 AS block, z3 / l3_3 AS c3, (z2 - l3_2 * c3) / l2_2 AS c2, (z1 - l2_1 * c2 - l3_1 * c3) / l1_1 AS c1, (z0 - l1_0 * c1 - l2_0 * c2 - l3_0 * c3) / l0_0 AS c0 FROM {p}2),
{p} AS (SELECT series, date, {h} AS horizon, greatest(c0 + c1 * x1 + c2 * x2 + c3 * x3, 0.05 * mean * {h}) / 1e4 AS s2 FROM {p}0 JOIN {p}3 USING (series) WHERE rn >= {W} AND block = (rn - {W}) // 21)"""


_HAR = f"""{BASE}, hv AS (SELECT series, date, rn, r * r * 1e4 AS v, r * r * 1e4 AS x1, avg(r * r * 1e4) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x5,
avg(r * r * 1e4) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS x22 FROM rt), {_har(1)}, {_har(5)}, ha AS (SELECT * FROM q1 UNION ALL SELECT * FROM q5)
SELECT series, CAST(date AS VARCHAR) AS origin, horizon, round(s2, 6) AS sigma2, round(sqrt(s2) * {_K[1][0]!r}::DOUBLE, 6) AS var, round(sqrt(s2) * {_K[1][1]!r}::DOUBLE, 6) AS es FROM ha"""


@query(_HAR)
def m07_har_proxy(spark, d):
    cfg = WalkForward(window=W, horizons=(1, 5), alphas=(0.05,))
    f = wf.forecasts(wf.walk_forward(returns(spark, d), ["har-proxy"], cfg))
    return rounded(f.select("series", "origin", "horizon", "sigma2", "var", "es"))


@query(f"""{FCD} SELECT model, alpha, count(*) AS n, round(avg(ln(sigma2) + realized * realized / sigma2), 6) AS qlike,
round(avg(pow(sigma2 - realized * realized, 2)), 6) AS mse, round(avg({FZ}), 6) + 0.0 AS fz0 FROM fd GROUP BY 1, 2""")
def f05_f06_f07_losses(spark, d):
    f, y2 = done(spark, d), F.col("realized") * F.col("realized")
    return rounded(f.groupBy("model", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg(risk.qlike(F.col("sigma2"), y2)).alias("qlike"), F.avg(risk.mse(F.col("sigma2"), y2)).alias("mse"), F.avg(risk.fz0(F.col("var"), F.col("es"), F.col("realized"), F.col("alpha"))).alias("fz0")))


# VaR and ES of a t law imply its own degrees of freedom
@query("SELECT DISTINCT l_linenumber + 2.5::DOUBLE AS nu, l_linenumber + 2.5::DOUBLE AS implied FROM lineitem")
def f10_implied_nu(spark, d):
    @F.pandas_udf("double")
    def back(nu: pd.Series) -> pd.Series:
        return nu.map(lambda n: implied_nu(*t_multipliers(n, 0.025), 0.025)).astype(float)

    nus = table(spark, d, "lineitem").select((F.col("l_linenumber") + 2.5).cast("double").alias("nu")).distinct()
    return rounded(nus.select("nu", back("nu").alias("implied")), 5)


@query()
def f11_fitted_nu(spark, d):
    @F.pandas_udf("double")
    def nu(z: pd.Series) -> float:
        return fit_t_nu(z.to_numpy() / z.std(ddof=0))

    r = returns(spark, d)
    return r.groupBy("series").agg(nu("r").alias("nu"))


@query("SELECT p_partkey, round(p_size / 500.0::DOUBLE + 0.85 + (p_partkey % 7) / 100.0::DOUBLE / 2, 9) AS persistence FROM part")
def f14_persistence(spark, d):
    p = table(spark, d, "part")
    a, gamma = F.col("p_size") / 500.0, (F.col("p_partkey") % 7) / 100.0
    return p.select("p_partkey", F.round(risk.persistence(a, F.lit(0.85), gamma), 9).alias("persistence"))


# ------------------------------------------------------------------ quantiles

_Z = ", ".join(f"({x}::DOUBLE, {z!r}::DOUBLE)" for x, z in zip(GRID, _NORMAL))
QN = f"qn AS (SELECT 'm' AS model, series, 512 AS context, date AS origin, day, level, sqrt(v0) * (1 + 0.01 * day) * z + 0.0001 * day AS quantile FROM wn, (VALUES (1), (2), (3)) g(day), (VALUES {_Z}) t(level, z) WHERE rn >= {W})"
QNS = f"{BASE}, {WN}, {QN}"


def quantiles(spark, d):
    """Every origin from the W-th return on."""
    full = returns(spark, d).withColumns({"rn": F.row_number().over(ret.by_date()), "s": F.sqrt(F.var_pop("r").over(win.trailing(W)))}).filter(F.col("rn") >= W)
    days = full.withColumn("day", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.lit(norm_ppf(x)).alias("z")) for x in GRID]))
    rows = days.select("series", "date", "s", "day", grid.alias("g"))
    q = F.col("s") * (1 + 0.01 * F.col("day")) * F.col("g.z") + 0.0001 * F.col("day")
    return rows.select(F.lit("m").alias("model"), "series", F.lit(512).alias("context"), F.col("date").alias("origin"), "day", F.col("g.level").alias("level"), q.alias("quantile"))


_SC = "sc AS (SELECT model, series, context, origin, day, regr_slope(quantile, z) AS scale FROM (SELECT qn.*, z FROM qn JOIN (VALUES " + ", ".join(f"({x}::DOUBLE, {z!r}::DOUBLE)" for x, z in zip(GRID, _NORMAL) if 0.1 <= x <= 0.9) + ") t(lv, z) ON level = lv) GROUP BY 1, 2, 3, 4, 5)"


@query(f"{QNS}, {_SC} SELECT series, CAST(origin AS VARCHAR) AS origin, day, round(scale, 6) AS scale FROM sc")
def f09_central_scale(spark, d):
    return rounded(qt.central_scale(quantiles(spark, d), GRID).select("series", "origin", "day", "scale"))


@query(f"""{QNS}, b AS (SELECT *, lead(level) OVER g AS l2, lead(quantile) OVER g AS q2 FROM qn WHERE day = 1 WINDOW g AS (PARTITION BY series, origin ORDER BY level)),
c AS (SELECT *, quantile + (q2 - quantile) * (0.05 - level) / (l2 - level) AS mid FROM b)
SELECT series, CAST(origin AS VARCHAR) AS origin, round(-max(CASE WHEN level <= 0.05 AND l2 > 0.05 THEN mid END), 6) AS var,
round(-(sum(CASE WHEN l2 <= 0.05 THEN (quantile + q2) / 2 * (l2 - level) WHEN level <= 0.05 THEN (quantile + mid) / 2 * (0.05 - level) ELSE 0 END) + min(level) * arg_min(quantile, level)) / 0.05, 6) AS es FROM c GROUP BY series, origin""")
def f04_m09_from_quantiles(spark, d):
    return rounded(qt.from_quantiles(quantiles(spark, d).filter("day = 1"), 0.05).select("series", "origin", "var", "es"))


@query(f"{QNS} SELECT series, CAST(origin AS VARCHAR) AS origin, day, level, round(max(quantile) OVER (PARTITION BY series, origin, day ORDER BY level), 6) + 0.0 AS quantile FROM (SELECT * REPLACE (quantile - CASE WHEN level = 0.5 THEN 0.2 ELSE 0 END AS quantile) FROM qn)")
def w15_monotone(spark, d):
    crossed = quantiles(spark, d).withColumn("quantile", F.col("quantile") - F.when(F.col("level") == 0.5, 0.2).otherwise(0.0))
    return rounded(win.monotone(crossed).select("series", "origin", "day", "level", "quantile"))


@query(f"{QNS}, {_SC} SELECT series, CAST(origin AS VARCHAR) AS origin, round(r / prev, 6) + 0.0 AS z FROM (SELECT sc.series, sc.origin, rt.r, lag(scale) OVER (PARTITION BY sc.series ORDER BY sc.origin) AS prev FROM sc LEFT JOIN rt ON rt.series = sc.series AND rt.date = sc.origin WHERE day = 1)")
def w16_innovations(spark, d):
    z = qp.innovations(returns(spark, d), qt.central_scale(quantiles(spark, d), GRID))
    return rounded(z.select("series", "origin", "z"))


@query(f"{QNS} SELECT series, CAST(origin AS VARCHAR) AS origin, " + ", ".join(f'round(avg(quantile) FILTER (level = {x}), 6) + 0.0 AS "{x}"' for x in GRID) + " FROM qn WHERE day = 2 GROUP BY 1, 2")
def a08_matrix(spark, d):
    return rounded(qt.matrix(quantiles(spark, d), 2, GRID).drop("model", "context"))


@query(f"{QNS} SELECT series, CAST(origin AS VARCHAR) AS origin, count(DISTINCT day) AS days, count(*) AS cells FROM qn GROUP BY 1, 2")
def a09_cube(spark, d):
    c = qt.cube(quantiles(spark, d))
    return rounded(c.select("series", "origin", F.size("days").cast("long").alias("days"), F.aggregate("days", F.lit(0), lambda s, x: s + F.size(x["grid"])).cast("long").alias("cells")))


@query(f"{QNS} SELECT count(DISTINCT (model, series, context, origin)) AS origins FROM qn")
def s08_distinct_origins(spark, d):
    return quantiles(spark, d).select("model", "series", "context", "origin").distinct().agg(F.count(F.lit(1)).alias("origins"))


_V8 = f"{QNS}, {_SC}, h AS (SELECT series, origin, 1 AS horizon, sum(scale * scale) FILTER (day <= 1) AS sigma2 FROM sc GROUP BY 1, 2 UNION ALL SELECT series, origin, 3, sum(scale * scale) FROM sc GROUP BY 1, 2)"


@query(f"{_V8} SELECT series, CAST(origin AS VARCHAR) AS origin, horizon, 'm-vol' AS model, round(sigma2, 6) AS sigma2, round(sqrt(sigma2) * {_K[1][0]!r}::DOUBLE, 6) AS var, round(sqrt(sigma2) * {_K[1][1]!r}::DOUBLE, 6) AS es FROM h")
def m08_vol_path_normal(spark, d):
    f = qp.quantile_forecasts(quantiles(spark, d), returns(spark, d), "vol", (1, 3), (0.05,), GRID, least=10**9)
    return rounded(f.select("series", "origin", "horizon", "model", "sigma2", "var", "es"))


@query()
def m08_w17_vol_path_student(spark, d):
    return qp.quantile_forecasts(quantiles(spark, d), returns(spark, d), "vol", (1, 3), (0.05,), GRID, nu_window=200, least=100)


_M10 = f"""{BASE}, cx AS (SELECT series, date AS origin, rn, lead(r) OVER (PARTITION BY series ORDER BY date) AS realized, list(r) OVER c AS l, var_pop(r) OVER c AS v FROM rt WINDOW c AS (PARTITION BY series ORDER BY date ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)),
sd AS (SELECT *, list_reduce(l, lambda s, x: 0.94 * s + 0.06 * x * x, v) AS s2 FROM cx WHERE rn > {W})
SELECT series, CAST(origin AS VARCHAR) AS origin, 'ewma-quantiles-direct' AS model, 1 AS horizon, 0.05::DOUBLE AS alpha, round(s2, 6) AS sigma2, round(sqrt(s2) * {_K[1][0]!r}::DOUBLE, 6) AS var,
round(sqrt(s2) * (({_K[0][0]!r}::DOUBLE + {_K[1][0]!r}::DOUBLE) / 2 * 0.04 + 0.01 * {_K[0][0]!r}::DOUBLE) / 0.05, 6) AS es, round(realized, 6) + 0.0 AS realized FROM sd"""


@query(_M10)
def m10_e05_materialized(spark, d):
    r = returns(spark, d)
    todo = qp.contexts(r, 1 + W, 512)
    q = qp.predict(todo, qt.forecaster("ewma-quantiles"), 5, 512, GRID)
    return rounded(qp.quantile_forecasts(q, r, "direct", alphas=(0.05,), levels=GRID))


# ------------------------------------------------------------------ backtests

_H = f"{FCD}, hh AS (SELECT *, CASE WHEN realized < -var THEN 1 ELSE 0 END AS hit FROM fd)"
_CELL = "series, model, horizon, alpha"


@query(f"""{_H}, g AS (SELECT {_CELL}, count(*) AS n, CAST(sum(hit) AS BIGINT) AS x FROM hh GROUP BY ALL) SELECT {_CELL}, n AS n_obs, x AS n_breaches,
round(-2 * ((n - x) * ln(1 - alpha) + x * ln(alpha) - CASE WHEN x = 0 OR x = n THEN 0 ELSE (n - x) * ln(1 - x / n) + x * ln(x / n) END), 6) + 0.0 AS statistic FROM g""")
def b02_kupiec(spark, d):
    return rounded(bt.kupiec(bt.hits(done(spark, d))))


_TR = f"{_H}, pr AS (SELECT *, lag(hit) OVER (PARTITION BY {_CELL} ORDER BY origin) AS b FROM hh), tr AS (SELECT {_CELL}, count(*) AS n_obs, CAST(sum(hit) AS BIGINT) AS n_breaches, " + ", ".join(f"count(*) FILTER (b = {a} AND hit = {b}) AS n{a}{b}" for a in (0, 1) for b in (0, 1)) + " FROM pr GROUP BY ALL)"
_L = lambda p: f"ln(least(greatest({p}, 1e-12), 1.0))"
_IND = f"{_TR}, pp AS (SELECT *, n01 / greatest(n00 + n01, 1) AS p0, n11 / greatest(n10 + n11, 1) AS p1, (n01 + n11) / greatest(n00 + n01 + n10 + n11, 1) AS p FROM tr), st AS (SELECT *, -2 * ((n00 + n10) * {_L('1 - p')} + (n01 + n11) * {_L('p')} - n00 * {_L('1 - p0')} - n01 * {_L('p0')} - n10 * {_L('1 - p1')} - n11 * {_L('p1')}) AS statistic FROM pp)"


@query(f"{_IND} SELECT {_CELL}, n_obs, n_breaches, n00, n01, n10, n11, round(statistic, 6) + 0.0 AS statistic FROM st")
def b03_a11_independence(spark, d):
    return rounded(bt.independence(bt.hits(done(spark, d))))


@query(f"""{_IND}, po AS (SELECT *, -2 * ((n_obs - n_breaches) * ln(1 - alpha) + n_breaches * ln(alpha) - CASE WHEN n_breaches IN (0, n_obs) THEN 0 ELSE (n_obs - n_breaches) * ln(1 - n_breaches / n_obs) + n_breaches * ln(n_breaches / n_obs) END) AS pof FROM st)
SELECT {_CELL}, round(pof + statistic, 5) + 0.0 AS statistic, round(exp(-(pof + statistic) / 2), 5) AS p_value FROM po""")
def b04_conditional_coverage(spark, d):
    f = bt.backtests(done(spark, d), shortfall=False).filter("test = 'christoffersen_cc'")
    return rounded(f.select("series", "model", "horizon", "alpha", "statistic", "p_value"), 5)


@query(f"""{_H}, dd AS (SELECT {_CELL}, origin, var, hit - alpha AS y FROM hh), lg AS (SELECT *, lag(y, 1) OVER w AS x1, lag(y, 4) OVER w AS x4 FROM dd WINDOW w AS (PARTITION BY {_CELL} ORDER BY origin))
SELECT {_CELL}, count(*) AS n, round(sum(x1 * y), 6) + 0.0 AS m1, round(sum(x4 * var), 6) + 0.0 AS m2 FROM lg WHERE x4 IS NOT NULL GROUP BY ALL""")
def b05_w13_dq_moments(spark, d):
    m = bt.dq_moments(bt.hits(done(spark, d)))
    return rounded(m.groupBy("series", "model", "horizon", "alpha").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") * F.col("y")).alias("m1"), F.sum(F.col("x4") * F.col("var")).alias("m2")))


# b' (X'X)^-1 b is the squared length of the half-way solution
_DQ = f"""dy AS (SELECT {_CELL}, origin, hit, var AS x5, 1.0::DOUBLE AS x0, hit - alpha AS y FROM hh),
dl AS (SELECT *, {", ".join(f"lag(y, {k}) OVER w AS x{k}" for k in range(1, 5))} FROM dy WINDOW w AS (PARTITION BY {_CELL} ORDER BY origin)),
ds AS (SELECT {_CELL}, count(*) + 4 AS n_obs, {", ".join(f"sum(x{i} * x{j}) AS m{i}_{j}" for i in range(6) for j in range(i, 6))}, {", ".join(f"sum(x{i} * y) AS b{i}" for i in range(6))} FROM dl WHERE x4 IS NOT NULL GROUP BY ALL),
dc AS (SELECT *, {_cholesky(6, "m", "b")} FROM ds WHERE n_obs >= 100),
dq AS (SELECT {_CELL}, n_obs, ({" + ".join(f"z{i} * z{i}" for i in range(6))}) / (alpha * (1 - alpha)) AS statistic FROM dc)"""


@query(f"{_H}, {_DQ}, nb AS (SELECT {_CELL}, CAST(sum(hit) AS BIGINT) AS n_breaches FROM hh GROUP BY ALL) SELECT {_CELL}, n_obs, n_breaches, round(statistic, 4) + 0.0 AS statistic FROM dq JOIN nb USING ({_CELL})")
def b05_dynamic_quantile(spark, d):
    return rounded(bt.dynamic_quantile(bt.hits(done(spark, d))), 4)


@query(f"{_H} SELECT {_CELL}, count(*) AS n_obs, CAST(sum(hit) AS BIGINT) AS n_breaches, round(sum(realized * hit / es) / (count(*) * alpha) + 1, 6) + 0.0 AS statistic FROM hh GROUP BY series, model, horizon, alpha")
def b06_z2(spark, d):
    return rounded(bt.z2(bt.hits(done(spark, d))))


@query()
def b06_all_backtests(spark, d):
    return bt.backtests(done(spark, d))


# ------------------------------------------------------------------ comparison and tables

_AL = f"{FCD}, al AS (SELECT origin, model, avg({FZ}) AS loss FROM fd WHERE alpha = 0.05 AND var > 0 AND es >= var GROUP BY 1, 2)"
_NW = f"""{_AL}, df AS (SELECT a.origin, a.loss - b.loss AS d FROM al a JOIN al b ON a.origin = b.origin AND a.model = 'ewma-rm' AND b.model = 'historical'),
dm AS (SELECT origin, d - avg(d) OVER () AS e, d FROM df), lg AS (SELECT d, e, e * lag(e, 1) OVER (ORDER BY origin) AS p1, e * lag(e, 2) OVER (ORDER BY origin) AS p2 FROM dm),
nw AS (SELECT count(*) AS n, avg(d) AS m, greatest(avg(e * e) + 2 * (1 - 1 / 3.0::DOUBLE) * sum(p1) / count(*) + 2 * (1 - 2 / 3.0::DOUBLE) * sum(p2) / count(*), 1e-16) AS lrv FROM lg)"""


def _diff(spark, d):
    """Both models' losses of a date in one row: one aggregate, no join."""
    a = ev.aligned_losses(done(spark, d), 1, 0.05, "fz0")
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("loss")))
    return a.groupBy("cell", "origin").agg(of("ewma-rm").alias("a"), of("historical").alias("b")).dropna()


def _two_sided(t: str, nu: str) -> str:
    """The two-sided tail of Student's t: with x = sqrt(nu) tan(u) its density is cos(u)**(nu-1), summed by Simpson's rule."""
    weight = "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    part = lambda a: f"((pi() / 2 - {a}) * list_sum(list_transform(range(20001), lambda i: ({weight}) * pow(greatest(cos({a} + i * (pi() / 2 - {a}) / 20000), 0), {nu} - 1))))"
    return f"({part(f'atan(abs({t}) / sqrt({nu}))')} / {part('0.0::DOUBLE')})"


@query(f"{_NW} SELECT n, round(m, 5) + 0.0 AS mean_value, round(lrv, 5) + 0.0 AS lrv FROM nw")
def c01_w14_long_run_variance(spark, d):
    v = cmp.long_run_variance(_diff(spark, d).withColumn("d", F.col("a") - F.col("b")), ["cell"], "d", "origin", 2)
    return rounded(v.drop("cell"), 5)


@query(f"{_NW}, st AS (SELECT n, m, m / sqrt(lrv / n) * sqrt((n + 1 - 2 * 3 + 3 * 2 / n) / n) AS t FROM nw) SELECT n, round(m, 5) + 0.0 AS mean_diff, round(t, 5) + 0.0 AS statistic, round({_two_sided('t', '(n - 1)')}, 5) AS p_value FROM st")
def c02_diebold_mariano(spark, d):
    return rounded(cmp.diebold_mariano(_diff(spark, d), ["cell"], "a", "b", "origin", 3).drop("cell"), 5)


@query(f"{FCD} SELECT model, round(avg(CASE WHEN realized < -var THEN 1 ELSE 0 END), 6) AS breach_rate, count(*) AS n FROM fd WHERE horizon = 1 AND alpha = 0.05 GROUP BY 1")
def a01_breach_summary(spark, d):
    return rounded(wf.breach_summary(forecasts(spark, d)))


@query(f"{FCD} SELECT model, round(avg(ln(sigma2) + realized * realized / sigma2), 6) AS qlike, count(*) AS n FROM fd WHERE alpha = 0.01 AND sigma2 > 0 GROUP BY 1")
def a02_t01_variance_table(spark, d):
    return rounded(ev.variance_table(done(spark, d)))


@query(f"""{_IND}, po AS (SELECT *, -2 * ((n_obs - n_breaches) * ln(1 - alpha) + n_breaches * ln(alpha) - CASE WHEN n_breaches IN (0, n_obs) THEN 0 ELSE (n_obs - n_breaches) * ln(1 - n_breaches / n_obs) + n_breaches * ln(n_breaches / n_obs) END) AS pof FROM st WHERE n_obs >= 200 AND alpha = 0.05),
sh AS (SELECT model, avg(CASE WHEN pof < {_CHI1} THEN 1 ELSE 0 END) AS pass_kupiec, avg(CASE WHEN statistic < {_CHI1} THEN 1 ELSE 0 END) AS pass_christoffersen FROM po GROUP BY 1),
tt AS (SELECT model, avg({FZ}) AS fz0, avg(hit) AS breach_rate FROM hh WHERE alpha = 0.05 GROUP BY 1), {_DQ},
sq AS (SELECT model, avg(CASE WHEN statistic < {_CHI6} THEN 1 ELSE 0 END) AS pass_dq FROM dq WHERE n_obs >= 200 AND alpha = 0.05 GROUP BY 1)
SELECT model, round(fz0, 6) + 0.0 AS fz0, round(breach_rate, 6) AS breach_rate, round(pass_kupiec, 6) AS pass_kupiec, round(pass_christoffersen, 6) AS pass_christoffersen, round(pass_dq, 6) AS pass_dq FROM tt LEFT JOIN sh USING (model) LEFT JOIN sq USING (model)""")
def a03_tail_table(spark, d):
    return rounded(ev.tail_table(done(spark, d), 1, 0.05))


@query(f"{FCD} SELECT count(*) AS n, count(DISTINCT series) AS series, count(DISTINCT model) AS models, CAST(min(origin) AS VARCHAR) AS first, CAST(max(origin) AS VARCHAR) AS last FROM fd")
def a12_totals(spark, d):
    f = done(spark, d)
    return rounded(f.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series").alias("series"), F.count_distinct("model").alias("models"), F.min("origin").alias("first"), F.max("origin").alias("last")))


@query(f"{_AL} SELECT arg_min(model, m) AS best, round(min(m), 6) + 0.0 AS mean_loss FROM (SELECT model, avg(loss) AS m FROM al GROUP BY 1)")
def t03_best_model(spark, d):
    m = ev.aligned_losses(done(spark, d), 1, 0.05, "fz0").groupBy("model").agg(F.avg("loss").alias("m"))
    return rounded(m.agg(F.min_by("model", "m").alias("best"), F.min("m").alias("mean_loss")))


@query(f"{BASE} SELECT count(*) - count(DISTINCT (series, date)) AS repeats FROM rt")
def t05_unique_dates(spark, d):
    r = returns(spark, d)
    return r.agg((F.count(F.lit(1)) - F.count_distinct("series", "date")).alias("repeats"))


@query(f"{FCD} SELECT model, 'qlike' AS kind, round(avg(ln(sigma2) + realized * realized / sigma2), 6) AS qlike, NULL::DOUBLE AS fz0 FROM fd WHERE alpha = 0.01 GROUP BY 1 UNION ALL SELECT model, 'fz0', NULL, round(avg({FZ}), 6) + 0.0 FROM fd WHERE alpha = 0.05 GROUP BY 1")
def u02_union_of_summaries(spark, d):
    f = done(spark, d)
    a = ev.variance_table(f).select("model", F.lit("qlike").alias("kind"), "qlike")
    b = ev.loss_rows(f, 1, 0.05, "fz0").groupBy("model").agg(F.avg("loss").alias("fz0")).withColumn("kind", F.lit("fz0"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


@query()
def a05_c04_ranking(spark, d):
    return ev.rank_models(ev.aligned_losses(done(spark, d), 1, 0.05, "fz0"), 1)


# two models: the better one has no test, the other is tested against it with no lag
_BEST = f"""{_AL}, mm AS (SELECT model, avg(loss) AS mean_loss FROM al GROUP BY 1), bb AS (SELECT arg_min(model, mean_loss) AS best FROM mm),
dd AS (SELECT a.model, a.loss - b.loss AS d FROM al a JOIN al b ON a.origin = b.origin JOIN bb ON b.model = bb.best AND a.model <> bb.best),
tv AS (SELECT model, count(*) AS n, avg(d) / sqrt(greatest(var_pop(d), 1e-16) / count(*)) * sqrt((count(*) - 1) / count(*)) AS t FROM dd GROUP BY 1),
vb AS (SELECT model, {_two_sided('t', '(n - 1)')} AS p FROM tv)"""


@query(f"{_BEST} SELECT 'all' AS cell, model, round(mean_loss, 5) + 0.0 AS mean_loss, round(p, 5) AS vs_best_p FROM mm LEFT JOIN vb USING (model)")
def a05_j10_against_best(spark, d):
    """The ranking without its resampled columns."""
    ranked = ev.rank_models(ev.aligned_losses(done(spark, d), 1, 0.05, "fz0"), 1)
    return rounded(ranked.select("cell", "model", "mean_loss", "vs_best_p"), 5)


_RG = "CASE WHEN origin BETWEEN DATE '1996-03-01' AND DATE '1996-12-31' OR origin BETWEEN DATE '1998-08-01' AND DATE '1999-02-28' OR origin BETWEEN DATE '2000-03-01' AND DATE '2001-01-31' THEN 'crisis' ELSE 'calm' END"
_SPLIT = "{0}, ev AS (SELECT fd.*, {1} AS cell FROM fd{2}), al AS (SELECT cell, origin, model, avg({3}) AS loss FROM ev WHERE cell IS NOT NULL AND alpha = 0.05 AND var > 0 AND es >= var GROUP BY 1, 2, 3) SELECT cell, model, round(avg(loss), 6) + 0.0 AS mean_loss, count(*) AS dates FROM al GROUP BY 1, 2"


def _split_means(f, column):
    losses = ev.aligned_losses(f.filter(F.col(column).isNotNull()), 1, 0.05, "fz0", [F.col(column)])
    return rounded(losses.groupBy("cell", "model").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("dates")))


@query(_SPLIT.format(FCD, _RG, "", FZ))
def a06_regime_means(spark, d):
    return _split_means(ev.evaluated(forecasts(spark, d), REGIMES), "regime")


@query(_SPLIT.format(FCD, "asset_class", " LEFT JOIN (VALUES ('A', 'equity_index'), ('N', 'fx')) c(series, asset_class) ON fd.series = c.series", FZ))
def a07_class_means(spark, d):
    return _split_means(ev.evaluated(forecasts(spark, d), None, spark.createDataFrame(CLASSES, "series string, asset_class string")), "asset_class")


@query()
def a06_regime_split(spark, d):
    f = ev.evaluated(forecasts(spark, d), REGIMES)
    return ev.split(f, "regime", alpha=0.05, least=100)


@query()
def a07_class_split(spark, d):
    f = ev.evaluated(forecasts(spark, d), None, spark.createDataFrame(CLASSES, "series string, asset_class string"))
    return ev.split(f, "asset_class", alpha=0.05, least=100)


@query()
def e02_all_models(spark, d):
    """All seven models over all series and horizons."""
    cfg = WalkForward(window=W, alphas=ALPHAS)
    return wf.forecasts(wf.walk_forward(wf.prepare(prices(spark, d), cfg), cfg=cfg))


@query()
def e03_baseline_breaches(spark, d):
    cfg = WalkForward(window=W, alphas=(0.05,))
    return wf.run_baselines(prices(spark, d), cfg, ("historical", "ewma-rm", "har-proxy", "garch11-n"))[1]


# the run's own returns: spikes of 12 scales out, series of W + 250 returns or more
_PREP = f"""WITH {PX}, {LR}, c0 AS (SELECT * FROM lr WHERE abs(r) <= 1), sc AS (SELECT *, CASE WHEN count(r) OVER a >= 20 THEN median(abs(r)) OVER a END AS scale, lead(r) OVER o AS nxt, count(*) OVER (PARTITION BY series) AS n FROM c0
WINDOW a AS (PARTITION BY series ORDER BY date ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING), o AS (PARTITION BY series ORDER BY date)),
fl AS (SELECT series, date, r, coalesce(abs(r) > 12 * scale AND abs(r + nxt) <= (1 - 0.8) * abs(r), false) AND n >= 10 AS spike FROM sc),
ks AS (SELECT series, date, r FROM (SELECT *, lag(spike) OVER (PARTITION BY series ORDER BY date) AS after FROM fl) WHERE NOT spike AND NOT coalesce(after, false)),
rt AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM ks WHERE series IN (SELECT series FROM ks GROUP BY 1 HAVING count(*) >= {W + 250}))"""
_E2 = ", ".join(f"h{h} AS (SELECT series, date, rn, {h} AS horizon, s, list(s) OVER f AS l, quantile_cont(s, 0.01) OVER f AS q0, quantile_cont(s, 0.05) OVER f AS q1, var_pop(s) OVER f AS v FROM (SELECT series, date, rn, CASE WHEN rn >= {h} THEN sum(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) END AS s FROM rt) WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN {W - h} PRECEDING AND CURRENT ROW))" for h in (1, 5, 20))
_E2F = " UNION ALL ".join(
    f"SELECT series, 'historical' AS model, {h} AS horizon, {a}::DOUBLE AS alpha, v AS sigma2, -q{j} AS var, -list_avg(list_filter(l, lambda x: x <= q{j})) AS es FROM h{h} WHERE rn >= {W} UNION ALL "
    f"SELECT series, 'ewma-rm', {h}, {a}::DOUBLE, {h} * s2, sqrt({h} * s2) * {_K[j][0]!r}::DOUBLE, sqrt({h} * s2) * {_K[j][1]!r}::DOUBLE FROM wo"
    for h in (1, 5, 20) for j, a in enumerate(ALPHAS)
)


@query(f"{_PREP}, {WN}, {_E2}, al AS ({_E2F}) SELECT series, model, horizon, alpha, count(*) AS n, round(avg(sigma2), 6) AS sigma2, round(avg(var), 6) AS var, round(avg(es), 6) AS es FROM al GROUP BY 1, 2, 3, 4")
def e02_closed_models(spark, d):
    """The whole run's two closed-form models over all series and horizons, averaged by cell."""
    cfg = WalkForward(window=W, alphas=ALPHAS)
    f = wf.forecasts(wf.walk_forward(wf.prepare(prices(spark, d), cfg), ["historical", "ewma-rm"], cfg))
    return rounded(f.groupBy("series", "model", "horizon", "alpha").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("sigma2", "var", "es")]))


@query(f"{_PREP}, {WN}, {FC} SELECT model, round(avg(CASE WHEN realized < -var THEN 1 ELSE 0 END), 6) AS breach_rate, count(*) AS n FROM fc WHERE alpha = 0.05 AND realized IS NOT NULL GROUP BY 1")
def e03_closed_breaches(spark, d):
    cfg = WalkForward(window=W, alphas=(0.05,))
    return rounded(wf.run_baselines(prices(spark, d), cfg, ("historical", "ewma-rm"))[1])


@query()
def e07_report_summary(spark, d):
    _, summary = ev.report(forecasts(spark, d), REGIMES, spark.createDataFrame(CLASSES, "series string, asset_class string"), horizons=(1,), alpha=0.05)
    return summary


@query(f"{BASE}, pv AS (SELECT series, date, rn, sqrt(var_pop(r) OVER f) AS sd, sum(r) OVER o AS prefix FROM rt {F250}) SELECT series, CAST(date AS VARCHAR) AS origin, round(sd, 6) AS sd, round(prefix, 5) + 0.0 AS prefix FROM pv WHERE rn >= {W}")
def w08_a10_prefix_and_variance(spark, d):
    w = ret.by_date().rowsBetween(Window.unboundedPreceding, 0)
    r = returns(spark, d).withColumns({"rn": F.row_number().over(ret.by_date()), "sd": F.sqrt(F.var_pop("r").over(win.trailing(W))), "prefix": F.sum("r").over(w)}).filter(F.col("rn") >= W)
    r = r.select("series", F.col("date").alias("origin"), F.round("sd", 6).alias("sd"), (F.round("prefix", 5) + 0.0).alias("prefix"))
    return r.withColumn("origin", F.col("origin").cast("string"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Prices to returns to historical and EWMA forecasts to breach rates."""
    return a01_breach_summary(spark, d)
