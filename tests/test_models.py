"""Estimators, walk-forward, saved models and exact quantiles."""

import datetime

import numpy as np
import pandas as pd
import pytest

from cadence.operators import estimators as est
from cadence.operators import models, quantiles, series, trees
from cadence.sources import readers, sinks

DAY = datetime.date(2020, 1, 6)


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, DAY + datetime.timedelta(days=7 * i), float(v)) for i, v in enumerate(values)], "key string, t date, v double")


def walk(spark, values, model, train, **options):
    return models.walkforward(frame(spark, values), ["key"], "t", "v", model, train, **options).orderBy("te", "h").collect()


def test_walkforward_rejects_bad_parameters(spark):
    df = frame(spark, range(20))
    for options in ({"horizon": 0}, {"step": 0}, {"window": "other"}, {"refit_every": -1}):
        with pytest.raises(ValueError):
            models.walkforward(df, ["key"], "t", "v", "naive", 10, **options)
    with pytest.raises(ValueError):
        models.walkforward(df, ["key"], "t", "v", "naive", "2020-03-01", window="sliding")
    assert walk(spark, range(20), "naive", 20) == []  # nothing is left to forecast


def test_walkforward_of_a_constant_model(spark):
    constant = lambda y, horizon: np.full((horizon, 3), 15.0)
    rows = walk(spark, range(1, 21), constant, 10, horizon=1, step=1)
    assert len(rows) == 10 and np.mean([abs(r.actual - r.predicted) for r in rows]) == 2.5
    rows = walk(spark, range(1, 21), constant, 10, horizon=1, step=2, window="sliding")
    assert [r.te for r in rows] == [10, 12, 14, 16, 18]
    rows = walk(spark, range(1, 21), constant, 12, horizon=3, step=2)
    assert sorted({r.te for r in rows}) == [12, 14, 16, 18] and {(r.te, r.h) for r in rows if r.te == 18} == {(18, 1), (18, 2)}
    assert [r.date for r in rows if (r.te, r.h) == (12, 3)] == [DAY + datetime.timedelta(days=7 * 14)]


@pytest.mark.parametrize("refit_every, fits", [(1, [10, 12, 14, 16, 18]), (2, [10, 10, 14, 14, 18]), (0, [10] * 5)])
def test_refits_follow_the_schedule(spark, refit_every, fits):
    seen = est.Estimator(lambda y, first=0, start=None: {"n": len(y), "first": first}, lambda p, y, horizon, first=0, start=None, level=0.95: np.array([[p["n"] * 100 + len(y), first, p["first"]]] * horizon, float))
    rows = walk(spark, range(1, 21), seen, 10, horizon=1, step=2, refit_every=refit_every)
    assert [r.fit for r in rows] == fits
    assert [r.predicted for r in rows] == [f * 100 + te for f, te in zip(fits, range(10, 20, 2))]
    rows = walk(spark, range(1, 21), seen, 6, horizon=1, step=2, refit_every=2, window="sliding")
    assert all(r.predicted == 606 for r in rows) and [r.lower for r in rows] == [r.te - 6 for r in rows] and [r.upper for r in rows] == [r.fit - 6 for r in rows]


def test_walkforward_of_fitted_models_beats_naive_on_a_season(spark):
    rng = np.random.default_rng(1)
    y = 50 + 20 * np.sin(2 * np.pi * np.arange(220) / 52.1775) + rng.normal(size=220)
    error = lambda m, **o: np.mean([abs(r.actual - r.predicted) for r in walk(spark, y, m, 160, horizon=4, step=12, **o)])
    naive = error("naive")
    for m, o in (("sarima", {"refit_every": 2}), ("holt-winters", {"refit_every": 2}), ("Prophet", {}), ("seasonal_arima", {"refit_every": 0}), ("gru", {"refit_every": 0, "epochs": 15})):
        assert error(m, **o) < naive, m


def test_failures_of_a_fit_are_rows(spark):
    df = frame(spark, range(30)).unionByName(frame(spark, [1.0] * 12, "b"))
    rows = models.walkforward(df, ["key"], "t", "v", "sarima", 8, horizon=1, step=4).collect()
    assert {(r.key, r.te, r.status) for r in rows if r.te == 8} == {("a", 8, "failed"), ("b", 8, "failed")} and all(r.predicted is None for r in rows if r.status == "failed")
    assert all(r.status == "success" for r in rows if r.te >= 12)


@pytest.mark.parametrize("cell", ["lstm", "gru"])
def test_gradients_through_time(cell):
    rng = np.random.default_rng(1)
    p = {k: rng.normal(0, 0.4, d) for k, d in est.net_shape(cell, (5, 4), 6, 3).items()}
    x, d = rng.normal(size=(4, 7, 3)), rng.normal(size=(4, 3))
    g = est.net_gradient(p, cell, x, d, est.net_forward(p, cell, x)[1])
    for k in p:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p[k].shape)
            kept, e = p[k][i], 1e-6
            p[k][i] = kept + e
            up = (est.net_forward(p, cell, x)[0] * d).sum()
            p[k][i] = kept - e
            down = (est.net_forward(p, cell, x)[0] * d).sum()
            p[k][i] = kept
            assert abs((up - down) / (2 * e) - g[k][i]) < 1e-6, (k, i)


def test_nets_learn_and_stop_early():
    y = 30 + 10 * np.sin(2 * np.pi * np.arange(200) / 52.0)
    short = est.net_fit(y, epochs=1)
    long_ = est.net_fit(y, epochs=30)
    loss = lambda p: np.abs(est.net_ahead(p, y[:180], 20)[:, 0] - y[180:]).mean()
    assert loss(long_) < loss(short) and loss(long_) < 4
    assert est.net_fit(y, epochs=30)["bo"].tolist() == long_["bo"].tolist()  # seeded


def test_seasonal_arima_finds_its_coefficients():
    rng = np.random.default_rng(3)
    e, x = rng.normal(size=900), np.zeros(900)
    for t in range(13, 900):
        x[t] = 0.6 * x[t - 1] + 0.5 * x[t - 12] - 0.3 * x[t - 13] + e[t]  # (1 - 0.6 B)(1 - 0.5 B^12)
    ar, _, sar, _ = est.seasonal_arma(x[100:], (1, 0, 1, 0), 12)
    assert abs(ar[0] - 0.6) < 0.08 and abs(sar[0] - 0.5) < 0.08
    y = np.cumsum(x) + 10 * np.sin(2 * np.pi * np.arange(900) / 12)
    p = est.arima_fit(y, order=(1, 1, 0), seasonal=(0, 1, 1), period=12, pairs=0)
    assert np.isnan(est.arima_errors(p, y)[:13]).all() and np.isfinite(est.arima_errors(p, y)[13:]).all()
    with pytest.raises(ValueError):
        est.arima_fit(y[:60], seasonal=(1, 1, 1), period=52)


def test_intervals_follow_the_level():
    y = np.random.default_rng(4).normal(size=80).cumsum() + 50
    wide, narrow = (est.arimax(y, 4, level=v) for v in (0.99, 0.5))
    assert np.allclose(wide[:, 0], narrow[:, 0]) and (wide[:, 2] > narrow[:, 2]).all() and (wide[:, 1] < narrow[:, 1]).all()
    with pytest.raises(ValueError):
        est.naive(y, 1, level=1.0)


def test_holidays_are_weeks_of_their_own():
    assert [str(est.easter(y).date()) for y in (2000, 2019, 2024, 2025)] == ["2000-04-23", "2019-04-21", "2024-03-31", "2025-04-20"]
    start = pd.Timestamp("2024-01-01")
    x = est.holiday_columns(start, 0, 53)
    assert x.shape == (53, 12) and x[0, 0] == 1 and x[51, 9] == 1 and (x.sum(0) >= 1).all()
    assert x[12, 10] == x[12, 11] == 1  # 28 and 29 March 2024 lie in the week of the 25th
    rng = np.random.default_rng(5)
    days = est.holiday_columns(start, 0, 212)
    y = 100 + 30 * days[:, 3] + rng.normal(size=212)  # every 28 July
    with_days, without = (est.additive(y[:180], 32, start=s)[:, 0] for s in (start, None))
    truth = y[180:]
    assert np.abs(with_days - truth).mean() < np.abs(without - truth).mean()


def test_saved_models_forecast_what_fitted_ones_do(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = frame(spark, 40 + rng.normal(size=160).cumsum()).unionByName(frame(spark, [1.0] * 5, "b"))
    for name in ("naive", "holt_winters", "sarima", "prophet", "lstm"):
        options = {"epochs": 2} if name == "lstm" else {}
        path = str(tmp_path / name)
        sinks.write(models.fitted(df, ["key"], "t", "v", name, **options), path)
        saved = sinks.parameters(spark, path)
        meta = {r.key: r for r in saved.collect()}
        assert (meta["a"].n, meta["a"].model, meta["b"].n) == (160, name, 5) and meta["a"].parameters and (meta["b"].error is None) == (meta["b"].parameters is not None)
        f, base = models.model_of(name)
        want = {r.h: r.predicted for r in models.grouped_forecast(df, ["key"], "t", "v", f, 3, **(base | options)).where("key = 'a'").collect()}
        got = models.from_fitted(saved, df, ["key"], "t", "v", 3).collect()
        assert all(abs(r.predicted - want[r.h]) < 1e-9 for r in got if r.key == "a")
    # A later series is filtered by the parameters of the earlier one.
    later = models.from_fitted(models.fitted(frame(spark, range(100)), ["key"], "t", "v", "naive"), frame(spark, range(120)), ["key"], "t", "v", 1).first()
    assert later.predicted == 119


def test_overrides_come_between_defaults_and_the_callers(spark):
    assert models.settings({"a": 1, "b": 1, "c": 1}, {"LIMA": {"b": 2, "c": 2}}, " lima ", c=3) == {"a": 1, "b": 2, "c": 3}
    df = frame(spark, range(60)).unionByName(frame(spark, range(60), "b"))
    got = {r.key: r.parameters for r in models.fitted(df, ["key"], "t", "v", "seasonal_naive", {"B": {"season": 13}}).collect()}
    assert '"season": 52' in got["a"] and '"season": 13' in got["b"]


def test_trees_walk_forward(spark):
    y = 20 + 10 * np.sin(np.arange(90) / 5)
    df = frame(spark, y).unionByName(frame(spark, y * 2, "b"))
    shape = {"lags": (1, 2), "windows": (4,)}
    cutoffs = [DAY + datetime.timedelta(days=7 * i) for i in (59, 69, 79)]
    rows = trees.walkforward(df, ["key"], "t", "v", "random_forest", cutoffs, 3, 2, numTrees=5, maxDepth=5, **shape).collect()
    assert len(rows) == 18 and np.mean([abs(r.actual - r.predicted) for r in rows]) < 8
    with pytest.raises(ValueError):
        trees.walkforward(df, ["key"], "t", "v", "gbt", [])


def test_monday_grid_and_calendar(spark):
    df = frame(spark, range(5)).withColumn("t", series.F.date_add("t", 2))
    got = [(str(r.t), r.v) for r in series.date_grid(df, ["key"], "t", weekday="MON").orderBy("t").collect()]
    assert got == [("2020-01-13", None), ("2020-01-20", None), ("2020-01-27", None), ("2020-02-03", None)]
    assert [r.v for r in series.date_grid(frame(spark, range(3)), ["key"], "t", weekday="MON").orderBy("t").collect()] == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        series.calendar(df, "t", ())
    with pytest.raises(ValueError, match="not in the frame"):
        series.standardized(df, ["nope"], series.F.lit(True), ["key"])
    r = series.calendar(frame(spark, range(14)), "t", ["key"], 52.0).orderBy("t").collect()[11]
    assert abs(r.sin_week - np.sin(2 * np.pi * r.week_of_year / 52.0)) < 1e-12


@pytest.mark.parametrize("few", [10_000, 5])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=301), "b": np.repeat([3.0, 7.0, 7.5], [50, 200, 20]), "c": np.array([5.0]), "d": np.exp(rng.normal(size=200) * 20), None: rng.integers(-3, 4, 99).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "hi": 1.0}
    got = {r.k: r for r in quantiles.quantiles(df, "v", shares, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in shares.items():
            assert np.isclose(got[k][name], np.quantile(vs, p), rtol=1e-12), (k, name)
    every = np.concatenate(list(groups.values()))
    whole = quantiles.quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).first()
    assert np.isclose(whole.q1, np.quantile(every, 0.25)) and np.isclose(whole.q3, np.quantile(every, 0.75))
    assert quantiles.quantiles(df.where("false"), "v", {"x": 0.5}).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from cadence.functions import scratch

    class Fake:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Fake)


def test_tables_and_reports_are_written(spark, tmp_path):
    df = frame(spark, range(3))
    sinks.write_tables({"national": df, "departments": df}, str(tmp_path / "t"))
    assert readers.csv(spark, str(tmp_path / "t" / "national"), ["key", "t", "v"]).count() == 3
    sinks.json_report(spark, {"mae": 1.5, "at": DAY}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().mae == 1.5
