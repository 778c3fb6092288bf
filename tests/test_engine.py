import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tailspark.functions import dist, risk
from tailspark.operators import comparison as cmp
from tailspark.operators import quantiles as qt
from tailspark.operators import returns as ret
from tailspark.operators.backtests import backtests, hits, kupiec, z2_simulated
from tailspark.operators.garch import fit_blocks
from tailspark.operators.models import WalkForward, plug_in
from tailspark.plans import quantile_path as qp
from tailspark.plans import walkforward as wf
from tailspark.sources.config import Regimes, Universe
from tailspark.sources.panel import QuantileTable, safe_name
from tailspark.sources.simulate import garch_path


def panel(spark, values, name="r", series="s", start=date(2015, 1, 1)):
    rows = [(series, start + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series string, date date, {name} double")


def test_distributions_match_closed_forms():
    assert dist.t_ppf(0.975, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-10)
    assert dist.t_ppf(0.05, 2) == pytest.approx(0.9 * -math.sqrt(2 / (4 * 0.05 * 0.95)), rel=1e-10)
    assert dist.t_sf(dist.t_ppf(0.9, 7.5), 7.5) == pytest.approx(0.1, rel=1e-10)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and dist.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert dist.chi2_sf(12.591587243743977, 6) == pytest.approx(0.05) and dist.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05)
    x = np.array([0.3, 1.0, 4.5, 60.0])
    assert np.allclose(dist.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


@pytest.mark.parametrize("nu", [3.0, 6.0, 40.0])
def test_implied_nu_inverts(nu):
    assert dist.implied_nu(*dist.t_multipliers(nu, 0.025), 0.025) == pytest.approx(nu, rel=1e-6)


def test_implied_nu_edges():
    v, e = dist.normal_multipliers(0.025)
    assert dist.implied_nu(v, e, 0.025) is None and dist.implied_nu(1, 50, 0.025) == 2.05
    with pytest.raises(ValueError):
        dist.implied_nu(1, 1, 0.025)


def test_closed_forms_against_draws():
    x = np.random.default_rng(1).standard_normal(2_000_000)
    v, e = dist.normal_multipliers(0.05)
    assert v == pytest.approx(-np.quantile(x, 0.05), rel=0.005) and e == pytest.approx(-x[x <= -v].mean(), rel=0.005)


def test_returns_bridge_gaps_and_targets_are_whole(spark):
    r = ret.log_returns(panel(spark, [100, -5, 110, 99], "price")).orderBy("date").collect()
    assert [round(x.r, 9) for x in r] == [round(math.log(1.1), 9), round(math.log(0.9), 9)]
    t = ret.targets(panel(spark, [0.01, -0.02, 0.03]), (1, 2)).orderBy("horizon", "origin").collect()
    assert [None if x.realized is None else round(x.realized, 9) for x in t] == [-0.02, 0.03, None, 0.01, None, None]
    with pytest.raises(ValueError):
        ret.forward_sum(F.col("r"), 0)


@pytest.mark.parametrize(("first", "second", "sd", "found"), [(0.16, -0.145, 0.004, True), (-0.73, -0.06, 0.03, False), (-0.10, 0.089, 0.04, False), (0.16, 0.01, 0.004, False)])
def test_spikes(spark, first, second, sd, found):
    r = np.random.default_rng(5).normal(0, sd, 200)
    r[100], r[101] = first, second
    flagged = ret.spike_flags(panel(spark, r))
    assert flagged.filter("spike").count() == int(found)
    assert ret.drop_spikes(flagged).count() == 200 - 2 * found


def test_no_lookahead(spark):
    r = garch_path(420, seed=21)
    cfg = WalkForward(window=300, refit_every=40, horizons=(1, 5), alphas=(0.01, 0.05))
    changed = r.copy()
    changed[360:] = 0.5
    models = ["historical", "ewma-rm", "har-proxy", "garch11-n", "fhs-ewma"]
    cut = date(2015, 1, 1) + timedelta(days=359)
    a, b = (wf.forecasts(wf.walk_forward(panel(spark, x), models, cfg)).filter(F.col("origin") <= F.lit(cut)).drop("realized").orderBy("model", "origin", "horizon", "alpha").toPandas() for x in (r, changed))
    assert len(a) == 61 * 5 * 4
    assert np.allclose(a[["sigma2", "var", "es"]].astype(float), b[["sigma2", "var", "es"]].astype(float), rtol=1e-9)


def test_repeated_dates_raise(spark):
    twice = panel(spark, [0.01] * 300).unionByName(panel(spark, [0.01] * 300))
    with pytest.raises(Exception, match="unique"):
        wf.walk_forward(twice, ["historical"], WalkForward(window=250)).count()


def test_settings_are_checked():
    for bad in ({"window": 100}, {"horizons": (0,)}, {"alphas": (0.5,)}):
        with pytest.raises(ValueError):
            WalkForward(**bad)


def test_plug_in_failures_are_kept(spark):
    class Fails:
        def fit(self, w):
            if w[-1] > 0:
                raise ValueError("no")

        def forecast(self, w, horizons, alphas):
            return [(1.0, {a: 1.0 for a in alphas}, {a: 2.0 for a in alphas}) for _ in horizons]

    cfg = WalkForward(window=250, horizons=(1,), alphas=(0.05,))
    run = wf.walk_forward(panel(spark, [0.01] * 253 + [-0.01] + [0.01] * 3), {"mine": plug_in(Fails())}, cfg)
    assert wf.failures(run).count() == 4 and wf.forecasts(run).count() == 4


def test_garch_recovers_parameters():
    r = garch_path(5000, seed=11)
    p = fit_blocks(r[None, :], False, False)
    assert p["converged"][0] and p["alpha"][0] == pytest.approx(0.08, abs=0.03) and p["beta"][0] == pytest.approx(0.90, abs=0.04)
    t = fit_blocks(garch_path(5000, nu=6.0, seed=7)[None, :], False, True)
    assert 4.5 < t["nu"][0] < 8.5
    with pytest.raises(ValueError):
        garch_path(10, alpha=0.2, beta=0.9)


def test_losses_are_least_at_the_truth(spark):
    r = pd.DataFrame({"r": np.random.default_rng(2).standard_normal(20_000)})
    df = spark.createDataFrame(r)
    v, e = dist.normal_multipliers(0.05)
    f = lambda k: risk.fz0(F.lit(v * k), F.lit(e * k), F.col("r"), 0.05)
    q = lambda k: risk.qlike(F.lit(k), F.col("r") * F.col("r"))
    low, at, high, ql, qa, qh = df.agg(*[F.avg(f(k)) for k in (0.8, 1.0, 1.25)], *[F.avg(q(k)) for k in (0.7, 1.0, 1.4)]).first()
    assert at < low and at < high and qa < ql and qa < qh


def forecast_rows(spark, r, var, es, alpha=0.05):
    rows = [("s", date(2015, 1, 1) + timedelta(days=i), "m", 1, alpha, 1.0, float(var), float(es), float(x)) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "series string, origin date, model string, horizon int, alpha double, sigma2 double, var double, es double, realized double")


def test_backtests(spark):
    r = np.random.default_rng(3).standard_normal(1000)
    v, e = dist.normal_multipliers(0.05)
    good = {x.test: x for x in backtests(forecast_rows(spark, r, v, e)).collect()}
    assert len(good) == 5 and all(x.p_value > 0.01 for x in good.values())
    bad = {x.test: x for x in backtests(forecast_rows(spark, r, 0.7 * v, 0.7 * e)).collect()}
    assert bad["kupiec_pof"].p_value < 0.01 and bad["acerbi_szekely_z2"].p_value < 0.05
    none = kupiec(hits(forecast_rows(spark, r, 100 * v, 100 * e))).first()
    assert none.n_breaches == 0 and none.statistic == pytest.approx(-2 * 1000 * math.log(0.95))
    with pytest.raises(ValueError):
        z2_simulated(r, np.full(1000, -1.0), np.full(1000, 1.0), 0.05)


def test_confidence_set_and_bootstrap():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((600, 1)) + 0.5 * rng.standard_normal((600, 4))
    p, inside = cmp.confidence_set(base + np.array([0, 0, 0, 0.5]), draws=300)
    assert not inside[3] and inside[:3].sum() >= 1 and p[3] < 0.1
    counts = cmp.bootstrap_counts(50, 7, 20, 1)
    assert (counts.sum(axis=1) == 50).all() and counts.min() >= 0
    with pytest.raises(ValueError):
        cmp.confidence_set(base[:50])


def test_quantile_store_is_idempotent(spark, tmp_path):
    store = QuantileTable(spark, str(tmp_path / "q"))
    r = panel(spark, garch_path(330, seed=5))
    model = qt.forecaster("ewma-quantiles")
    for _ in range(2):
        qp.materialize(r, store, model, window=300, horizon=3, context=64)
    assert store.read().count() == 31 * 3 * len(qt.LEVELS)
    f = qp.quantile_forecasts(store.read(), r, "direct", alphas=(0.05,))
    v = qp.quantile_forecasts(store.read(), r, "vol", (1, 3), (0.05,))
    assert f.count() == 31 and v.count() == 62
    one = f.orderBy("origin").first()
    assert one["var"] == pytest.approx(math.sqrt(one["sigma2"]) * dist.normal_multipliers(0.05)[0], rel=1e-6)


def test_streamed_quantiles_merge(spark, tmp_path):
    from tailspark.sources.panel import QUANTILES
    from tailspark.streaming.incremental import stream_quantiles

    q = qp.predict(qp.contexts(panel(spark, garch_path(305, seed=6)), 300, 64), qt.forecaster("ewma-quantiles"), 2, 64)
    q.write.parquet(str(tmp_path / "in"))
    store = QuantileTable(spark, str(tmp_path / "out"))
    for k in range(2):
        stream_quantiles(spark.readStream.schema(QUANTILES).parquet(str(tmp_path / "in")), store, str(tmp_path / f"c{k}")).awaitTermination()
    assert store.read().count() == q.count()


def test_levels_and_names():
    with pytest.raises(ValueError):
        qt.check_levels((0.1, 0.1))
    with pytest.raises(ValueError):
        qt.check_levels((0.05, 0.5), (0.1, 0.5))
    with pytest.raises(ValueError):
        qt.forecaster("none")
    assert safe_name("BRK.B/x") == "BRK_B_x" and safe_name("BRK.B", True) == "BRK.B"


def test_config():
    with pytest.raises(ValueError):
        Regimes([("a", date(2000, 1, 1), date(2000, 6, 1)), ("b", date(2000, 6, 1), date(2001, 1, 1))])
    r = Regimes([("a", date(2000, 1, 1), date(2000, 6, 1))])
    assert r.is_crisis(date(2000, 6, 1)) and not r.is_crisis(date(2000, 6, 2))
    with pytest.raises(ValueError):
        Universe(date(2000, 1, 1), date(2001, 1, 1), {"art": []})
    with pytest.raises(ValueError):
        Universe(date(2000, 1, 1), date(2001, 1, 1), {"fx": [{"ticker": "x"}]}).select(["y"])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_runs_have_whole_settings(spark, monkeypatch):
    from tailspark.plans import queries as q

    d = "/root/testdata/sf0.001"
    every = {r[0] for r in q.returns(spark, d).groupBy("series").count().filter(f"count > {q.W}").collect()}
    assert len(every) > 1 and {r[0] for r in q.QUERIES["m10_e05_materialized"](spark, d).select("series").distinct().collect()} == every
    seen = []
    monkeypatch.setattr(q.wf, "walk_forward", lambda df, cfg: seen.append(cfg) or df)
    monkeypatch.setattr(q.wf, "forecasts", lambda df: df)
    monkeypatch.setattr(q.wf, "run_baselines", lambda df, cfg, models: seen.append(cfg) or (df, df))
    q.QUERIES["e02_all_models"](spark, d)
    q.QUERIES["e03_baseline_breaches"](spark, d)
    assert [(c.refit_every, c.horizons) for c in seen] == [(21, (1, 5, 20))] * 2


def test_forecasts_are_made_once(spark):
    """Evaluations read a written table: no kernel stands in the plans of what is read several times."""
    from tailspark.plans import queries as q

    d = "/root/testdata/sf0.001"
    for name in ("a03_tail_table", "a05_c04_ranking", "c02_diebold_mariano", "b04_conditional_coverage", "e07_report_summary"):
        plan = q.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" not in plan, name


def test_missing_price_files_are_skipped(spark, tmp_path, caplog):
    from tailspark.sources.panel import load_prices

    panel(spark, [1, 2, 3], "adj_close").write.parquet(str(tmp_path / "a"))
    assert load_prices(spark, [str(tmp_path / "a"), str(tmp_path / "none")]).count() == 3 and "none" in caplog.text
    with pytest.raises(ValueError):
        load_prices(spark, [str(tmp_path / "none")])


def test_quantile_path_refuses(spark):
    r = panel(spark, garch_path(320, seed=5))
    q = qp.predict(qp.contexts(r, 300, 64), qt.forecaster("ewma-quantiles"), 3, 64)
    with pytest.raises(ValueError, match="3 days, need 5"):
        qp.quantile_forecasts(q, r, "vol", (1, 5), (0.05,))
    with pytest.raises(ValueError, match="reach from"):
        qp.quantile_forecasts(q, r, "direct", alphas=(0.001,))
    with pytest.raises(ValueError, match="no quantiles"):
        qp.quantile_forecasts(q.limit(0), r, "vol", (1,), (0.05,))
    marked = qp.quantile_forecasts(q, r, "vol", (1, 3), (0.05,), cutoff=date(2015, 11, 1))
    assert {x.after_cutoff for x in marked.collect()} == {True, False} and all(x.after_cutoff == (x.origin > date(2015, 11, 1)) for x in marked.collect())


def test_store_refuses_uneven_batches(spark, tmp_path):
    store = QuantileTable(spark, str(tmp_path / "q"))
    q = qp.predict(qp.contexts(panel(spark, garch_path(302, seed=5)), 300, 64), qt.forecaster("ewma-quantiles"), 2, 64, (0.05, 0.5, 0.9))
    first = q.agg(F.min("origin")).first()[0]
    for bad in (q.unionByName(q.limit(1)), q.filter("NOT (day = 2 AND level = 0.5)"), q.filter((F.col("origin") != F.lit(first)) | (F.col("day") == 1)), q.filter((F.col("origin") != F.lit(first)) | (F.col("level") != 0.9)), q.filter("day = 2")):
        with pytest.raises(ValueError):
            store.append(bad)
    assert store.read() is None
    store.append(q)
    assert store.read().count() == 3 * 2 * 3 and store.origins().count() == 3
    store.append(q.withColumn("quantile", F.lit(9.0)))
    assert store.read().filter("quantile = 9").count() == 0


def test_settings_files(tmp_path):
    from tailspark.sources.config import load_regimes, load_universe

    def read(load, text):
        (tmp_path / "x.yaml").write_text(text)
        return load(str(tmp_path / "x.yaml"))

    good = "start: 2000-01-01\nend: 2001-01-01\nseries:\n  fx: [{ticker: X, name: x}, {ticker: Y}]\n"
    assert [s["ticker"] for _, s in read(load_universe, good).all_series()] == ["X", "Y"] and read(load_universe, good).price_field == "adj_close"
    for bad in (good.replace("Y", "X"), good.replace("end:", "ende:"), good.replace("ticker: Y", "tick: Y"), good + "more: 1\n", good.replace("2001-01-01", "soon"), "series: {}\n", good.replace("fx", "art"), "- a\n", "start: 2000-01-01\nend: 2001-01-01\nseries: {fx: X}\n"):
        with pytest.raises(ValueError):
            read(load_universe, bad)
    windows = "crisis_windows:\n  - {name: a, start: 2000-01-01, end: 2000-06-01}\n"
    assert read(load_regimes, windows).is_crisis(date(2000, 3, 1))
    for bad in (windows.replace("end", "until"), windows.replace("crisis_windows", "windows"), windows.replace("2000-06-01", "1999-01-01")):
        with pytest.raises(ValueError):
            read(load_regimes, bad)


class Constant:
    """What a pretrained model's loader may give: a plain function."""

    def __call__(self, contexts, horizon, levels):
        return np.broadcast_to(np.array([c[-1] for c in contexts])[:, None, None] + np.array(levels)[::-1], (len(contexts), horizon, len(levels)))


def test_pretrained_adapter(spark):
    import pickle

    m = qt.Pretrained("mine", Constant, (0.1, 0.5, 0.9), 4, date(2020, 1, 1))
    out = m([[0.0] * 10 + [1.0]], 2, (0.1, 0.9))
    assert out.shape == (1, 2, 2) and (np.diff(out, axis=2) >= 0).all() and m._model is not None and pickle.loads(pickle.dumps(m))._model is None
    for bad in (lambda: m([[np.nan]], 1, (0.1,)), lambda: m([[1.0]], 0, (0.1,)), lambda: m([[1.0]], 1, (0.2,)), lambda: m([[]], 1, (0.1,)), lambda: qt.Pretrained("x", lambda: lambda c, h, lv: np.zeros(3))([[1.0]], 1, (0.5,))):
        with pytest.raises(ValueError):
            bad()
    qt.register("mine", lambda: m)
    rows = qp.predict(qp.contexts(panel(spark, [0.01] * 12), 10, 8), qt.forecaster("mine"), 2, 8).collect()
    assert len(rows) == 3 * 2 * 3 and {r.level for r in rows} == {0.1, 0.5, 0.9}
    del qt.FORECASTERS["mine"]


def test_windows_that_are_not_finite_fail(spark):
    r = [0.01, -0.01] * 150
    r[255] = float("inf")
    run = wf.walk_forward(panel(spark, r), ["historical", "ewma-rm", "garch11-n", "har-proxy", "fhs-ewma"], WalkForward(window=250, horizons=(1,), alphas=(0.05,)))
    for m in ("historical", "ewma-rm", "har-proxy", "fhs-ewma"):
        assert wf.failures(run).filter(F.col("model") == m).count() >= 45
        ok = wf.forecasts(run).filter(F.col("model") == m)
        assert ok.filter(~F.col("var").isNotNull() | F.isnan("var") | (F.col("var") == float("inf"))).count() == 0
    assert wf.failures(run).filter("model = 'historical'").filter("error LIKE '%finite%'").count() == 45


def test_degrees_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_t(5, 500)
    z[[0, 40, 41, 300]] = np.nan
    rows = [("m", "s", 64, date(2015, 1, 1) + timedelta(days=i), None if i == 0 else float(x), i) for i, x in enumerate(z)]
    df = spark.createDataFrame(rows, "model string, series string, context int, origin date, z double, i int")
    out = [r.nu for r in qp.degrees(df, 21, 150, 120).orderBy("origin").collect()]
    seen, nu, want = [], None, []
    for i, x in enumerate(z):
        if np.isfinite(x):
            seen.append(x)
        if i % 21 == 0 and len(seen) >= 120:
            nu = dist.fit_t_nu(np.array(seen[-150:]))
        want.append(nu)
    assert [None if x is None else round(x, 9) for x in out] == [None if x is None else round(x, 9) for x in want] and len({x for x in want if x}) > 10


def test_student_tails_against_a_plain_loop(spark):
    """The vol path by hand: scales add up, nu from past innovations, multipliers of that t."""
    r = panel(spark, garch_path(420, nu=5.0, seed=8))
    q = qp.predict(qp.contexts(r, 251, 64), qt.forecaster("ewma-quantiles"), 3, 64)
    got = {(x.origin, x.horizon): x for x in qp.quantile_forecasts(q, r, "vol", (1, 3), (0.05,), nu_window=120, least=100).collect()}
    ret_of = {x.date: x.r for x in r.collect()}
    scale = {(x.origin, x.day): x.scale for x in qt.central_scale(q).collect()}
    origins = sorted({o for o, _ in scale})
    seen, nu, heavy = [], None, 0
    for i, o in enumerate(origins):
        if i:
            seen.append(ret_of[o] / scale[origins[i - 1], 1])
        if i % 21 == 0 and len(seen) >= 100:
            nu = dist.fit_t_nu(np.array(seen[-120:]))
        kv, ke = dist.normal_multipliers(0.05) if nu is None else dist.t_multipliers(nu, 0.05)
        heavy += nu is not None
        for h in (1, 3):
            s2 = sum(scale[o, k] ** 2 for k in range(1, h + 1))
            x = got[o, h]
            assert (x.sigma2, x.var, x.es) == pytest.approx((s2, kv * math.sqrt(s2), ke * math.sqrt(s2)))
    assert heavy > 40 and len(got) == 2 * len(origins)


def test_filtered_simulation_against_a_plain_loop(spark):
    r = garch_path(252, seed=9)
    f = {(x.origin, x.horizon): x for x in wf.forecasts(wf.walk_forward(panel(spark, r), ["fhs-ewma"], WalkForward(window=250, horizons=(1, 5), alphas=(0.05,)))).collect()}
    w = r[:250]
    s2 = [w.var()]
    for x in w:
        s2.append(0.94 * s2[-1] + 0.06 * x * x)
    z, last = w / np.sqrt(s2[:-1]), s2[-1]
    day = date(2015, 1, 1) + timedelta(days=249)
    one = np.sqrt(last) * z
    x = f[day, 1]
    assert x.var == pytest.approx(-np.quantile(one, 0.05)) and x.sigma2 == pytest.approx(one.var()) and x.es == pytest.approx(-one[one <= np.quantile(one, 0.05)].mean())
    rng, sums = np.random.default_rng(77), []
    for _ in range(20_000):
        s, total = last, 0.0
        for e in z[rng.integers(0, 250, 5)]:
            step = math.sqrt(s) * e
            total, s = total + step, 0.94 * s + 0.06 * step * step
        sums.append(total)
    x = f[day, 5]
    assert x.var == pytest.approx(-np.quantile(sums, 0.05), rel=0.06) and x.sigma2 == pytest.approx(np.var(sums), rel=0.06)


@pytest.mark.parametrize(("name", "asymmetric", "student"), [("garch11-n", False, False), ("garch11-t", False, True), ("gjr-garch11-t", True, True)])
def test_garch_forecasts_against_a_plain_filter(spark, name, asymmetric, student):
    """The kernel's forecasts from its own parameters, and these against a coarse search of a plain likelihood."""
    r = garch_path(620, gamma=0.08 if asymmetric else 0.0, beta=0.86, nu=6.0 if student else None, seed=10)
    f = {(x.origin, x.horizon): x for x in wf.forecasts(wf.walk_forward(panel(spark, r), [name], WalkForward(window=600, refit_every=30, horizons=(1, 5), alphas=(0.05,)))).collect()}
    w = r[:600] * 100
    p = {k: float(v[0]) for k, v in fit_blocks(r[None, :600], asymmetric, student).items()}

    def path(omega, alpha, beta, gamma):
        s = [w.var()]
        for x in w:
            s.append(max(omega + (alpha + gamma * (x < 0)) * x * x + beta * s[-1], 1e-12))
        return np.array(s)

    def nll(omega, alpha, beta, gamma, nu):
        s = path(omega, alpha, beta, gamma)[:-1]
        if not student:
            return 0.5 * float(np.sum(np.log(2 * math.pi * s) + w * w / s))
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return float(np.sum(-c + 0.5 * np.log(s) + (nu + 1) / 2 * np.log1p(w * w / (s * (nu - 2)))))

    s2 = path(p["omega"], p["alpha"], p["beta"], p["gamma"])[-1]
    pers = p["alpha"] + p["beta"] + p["gamma"] / 2
    mean = p["omega"] / (1 - pers)
    kv, ke = dist.t_multipliers(p["nu"], 0.05) if student else dist.normal_multipliers(0.05)
    day = date(2015, 1, 1) + timedelta(days=599)
    for h in (1, 5):
        want = sum(mean + pers**k * (s2 - mean) for k in range(h)) / 1e4
        x = f[day, h]
        assert (x.sigma2, x.var, x.es) == pytest.approx((want, kv * math.sqrt(want), ke * math.sqrt(want)), rel=1e-6)
    best = nll(p["omega"], p["alpha"], p["beta"], p["gamma"], p["nu"])
    rng = np.random.default_rng(1)
    for _ in range(150):  # no parameters near or far are likelier
        k = np.exp(rng.normal(0, 0.15, 5))
        omega, alpha, beta, gamma, nu = (x * y for x, y in zip((p["omega"], p["alpha"], p["beta"], p["gamma"], p["nu"] or 8.0), k, strict=True))
        if alpha + beta + gamma / 2 < 0.9995 and nu > 2.05:
            assert nll(omega, alpha, beta, gamma, nu) > best - 0.05


def test_shortfall_p_value_against_a_plain_loop():
    rng = np.random.default_rng(6)
    v, e = dist.t_multipliers(5.0, 0.05)
    var, es = np.where(np.arange(300) % 2, v, 2 * dist.normal_multipliers(0.05)[0]), np.where(np.arange(300) % 2, e, 2 * dist.normal_multipliers(0.05)[1])
    r = rng.standard_normal(300) * np.where(np.arange(300) % 2, 1.1, 2.1)
    stat, p = z2_simulated(r, var, es, 0.05, n_sim=4000)
    want = sum(x / s for x, q, s in zip(r, var, es) if x < -q) / (300 * 0.05) + 1
    assert stat == pytest.approx(want)
    below = 0
    for _ in range(4000):
        x = np.where(np.arange(300) % 2, rng.standard_t(5, 300) * math.sqrt(0.6), 2 * rng.standard_normal(300))
        below += (x * (x < -var) / es).sum() / 15 + 1 <= stat
    assert p == pytest.approx(below / 4000, abs=0.04) and z2_simulated(r, var, es, 0.05, n_sim=4000) == (stat, p)


def test_confidence_set_against_plain_rounds():
    rng = np.random.default_rng(4)
    for shift in ((0, 0, 0, 0.5), (0, 0.02, 0.3, 0.31), (0, 0, 0, 0), (0, 1, 2, 3)):
        x = rng.standard_normal((400, 1)) + 0.5 * rng.standard_normal((400, 4)) + np.array(shift)
        p, inside = cmp.confidence_set(x, draws=200, block=5, seed=3)
        means = np.array([[x[np.repeat(np.arange(400), c)][:, m].mean() for m in range(4)] for c in cmp.bootstrap_counts(400, 5, 200, 3)])
        left, high, want = [0, 1, 2, 3], 0.0, {}
        while True:
            if len(left) == 1:
                want[left[0]] = 1.0
                break
            d = {m: x[:, m].mean() - x[:, left].mean() for m in left}
            b = {m: means[:, m] - means[:, left].mean(axis=1) - d[m] for m in left}
            se = {m: math.sqrt((b[m] ** 2).mean()) for m in left}
            t = {m: d[m] / se[m] for m in left}
            high = max(high, float((np.max([b[m] / se[m] for m in left], axis=0) >= max(t.values())).mean()))
            if high >= 0.1 and (np.max([b[m] / se[m] for m in left], axis=0) >= max(t.values())).mean() >= 0.1:
                want |= dict.fromkeys(left, high)
                break
            worst = max(t, key=t.get)
            want[worst] = high
            left.remove(worst)
        assert [bool(i) for i in inside] == [m in left for m in range(4)] and p == pytest.approx([want[m] for m in range(4)])


def test_bootstrap_resamples_whole_blocks():
    counts = cmp.bootstrap_counts(23, 5, 40, 2)
    start = np.random.default_rng(2).integers(0, 19, size=(40, 5))
    for c, s in zip(counts, start, strict=True):
        rows = [k for a in s for k in range(a, a + 5)][:23]
        assert np.bincount(rows, minlength=23).tolist() == c.tolist()


def test_fitted_nu_is_likeliest():
    z = np.random.default_rng(2).standard_t(6, 3000) * math.sqrt(4 / 6)
    nu = dist.fit_t_nu(z)
    like = lambda n: len(z) * (math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(math.pi * (n - 2))) - (n + 1) / 2 * np.log1p(z * z / (n - 2)).sum()
    assert 4.5 < nu < 8.5 and like(nu) >= max(like(x) for x in np.linspace(2.2, 30, 800)) - 1e-6


def test_simulated_series_follow_the_recursion():
    rng = np.random.default_rng(42)
    z = rng.standard_normal(1005)
    s2, out = 0.05 / (1 - 0.98), []
    for e in z:
        x = math.sqrt(s2) * e
        out.append(x / 100)
        s2 = 0.05 + 0.08 * x * x + 0.90 * s2
    assert garch_path(5) == pytest.approx(out[1000:])


def test_commands(spark, tmp_path):
    from tailspark import commands

    days = [date(2015, 1, 1) + timedelta(days=i) for i in range(560)]
    rows = [(s, d, float(100 * math.exp(x))) for k, s in enumerate(("X", "Y")) for d, x in zip(days, np.cumsum(garch_path(560, seed=k)), strict=True)]
    spark.createDataFrame(rows, "series string, date date, adj_close double").write.parquet(str(tmp_path / "prices"))
    (tmp_path / "u.yaml").write_text("start: 2014-01-01\nend: 2020-01-01\nseries:\n  fx: [{ticker: X}, {ticker: Y}]\n")
    (tmp_path / "r.yaml").write_text("crisis_windows:\n  - {name: a, start: 2015-10-01, end: 2016-02-01}\n")
    common = ["--prices", str(tmp_path / "prices"), "--universe", str(tmp_path / "u.yaml"), "--window", "250"]
    commands.main(["baselines", *common, "--models", "historical", "ewma-rm", "--out", str(tmp_path / "f")], spark)
    assert spark.read.parquet(str(tmp_path / "f")).groupBy("series", "model").count().count() == 4
    commands.main(["report", "--forecasts", str(tmp_path / "f"), "--universe", str(tmp_path / "u.yaml"), "--regimes", str(tmp_path / "r.yaml"), "--out", str(tmp_path / "report")], spark)
    assert "## QLIKE, pooled" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "report" / "text")).collect()) and spark.read.parquet(str(tmp_path / "report" / "summary")).count() == 4
    for _ in range(2):
        commands.main(["quantiles", *common, "--tickers", "X", "--horizon", "2", "--context", "64", "--out", str(tmp_path / "q")], spark)
    assert QuantileTable(spark, str(tmp_path / "q")).origins().count() == 310
    with pytest.raises(ValueError):
        commands.main(["quantiles", *common, "--tickers", "Z", "--out", str(tmp_path / "q2")], spark)
    with pytest.raises(SystemExit):
        commands.main(["baselines", *common, "--models", "none", "--out", str(tmp_path / "g")], spark)
