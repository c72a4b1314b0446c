"""Regression by aggregates, folds, tuning and stacking against numpy and plain loops."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import estimators, evaluate, folds, regression, stacking, tuning

START = datetime.date(2015, 1, 5)
KEY = ["key"]


def series(n, k, seed=1):
    rng = np.random.RandomState(seed + k)
    t = np.arange(n)
    return 50 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 52.1775) + np.cumsum(rng.randn(n)) * (k % 2) + rng.randn(n) * 2


DATA = {f"k{k}": series(n, k) for k, n in enumerate((150, 220, 60))}


def frame(spark, data):
    rows = [(k, START + datetime.timedelta(days=7 * i), None if v is None else float(v), "x") for k, y in data.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "key string, t date, v double, y string").repartition(3)


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark, DATA).cache()


def by_key(df, *names):
    return {r["key"]: r for r in df.collect()}


# --- regression ------------------------------------------------------------------------------

def test_regression_equals_least_squares(spark):
    rng = np.random.RandomState(3)
    rows = [(f"k{i % 3}", *map(float, rng.randn(4))) for i in range(300)]
    rows += [("k0", None, 1.0, 2.0, 3.0), ("k1", 1.0, float("nan"), 2.0, 3.0), ("k2", 1.0, 2.0, 3.0, None), (None, 1.0, 2.0, 3.0, 4.0)]
    got = by_key(regression.fitted(spark.createDataFrame(rows, "key string, a double, b double, c double, y double"), KEY, [F.col("a"), F.col("b"), F.col("a") * 2, F.col("c"), F.lit(0.0)], F.col("y")))
    for k in ("k0", "k1", "k2"):
        m = np.array([r[1:] for r in rows if r[0] == k and None not in r and not any(map(math.isnan, r[1:]))])
        x, y = np.column_stack([np.ones(len(m)), m[:, :3]]), m[:, 3]
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        r = got[k]
        assert r["n"] == len(m) and np.allclose([*np.array(r["beta"])[[0, 1, 2, 4]]], beta) and r["beta"][3] == pytest.approx(0, abs=1e-9) and r["beta"][5] == 0
        assert r["sse"] == pytest.approx(e @ e) and r["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))
    assert got[None]["n"] == 1 and got[None]["r2"] is None


def test_a_perfect_line_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", i, 3.0 + 2 * i) for i in range(9)], "key string, x int, y double")
    r = regression.fitted(df, KEY, [F.col("x")], F.col("y")).first()
    assert np.allclose(r["beta"], [3, 2]) and r["sse"] == pytest.approx(0, abs=1e-9)
    assert regression.fitted(df.limit(0), KEY, [F.col("x")], F.col("y")).count() == 0


def test_a_key_may_lie_in_any_number_of_partitions(df):
    one = by_key(regression.fitted(df.coalesce(1), KEY, [F.dayofyear("t")], F.col("v")))
    many = by_key(regression.fitted(df.repartition(17), KEY, [F.dayofyear("t")], F.col("v")))
    assert all(np.allclose(one[k]["beta"], many[k]["beta"], rtol=1e-9) for k in DATA)


def test_additive_model_equals_ridge(df):
    fits = by_key(regression.additive_fitted(df, KEY, "t", "v"))
    ahead = {(r["key"], r["h"]): r for r in regression.additive_forecast(df, KEY, "t", "v", 5).collect()}
    for k, y in DATA.items():
        p = estimators.additive_fit(y, 0, START)
        assert np.allclose(fits[k]["beta"], p["beta"], atol=1e-6) and fits[k]["sigma"] == pytest.approx(p["sigma"], rel=1e-6)
        want = estimators.additive(y, 5, 0, START)
        assert np.allclose([[ahead[k, h][c] for c in ("predicted", "lower", "upper")] for h in range(1, 6)], want, atol=1e-5)


@pytest.mark.parametrize("year", [1995, 2000, 2008, 2024, 2038])
def test_easter(spark, year):
    assert spark.range(1).select(regression.easter(F.lit(year))).first()[0] == estimators.easter(year).date()


def test_walkforward_reads_only_the_past(df):
    x = lambda i: [i.cast("double"), *regression.fourier(i, 1)]
    got = regression.walkforward(df, KEY, "t", "v", x, 60, 3, 20).collect()
    assert {(r["key"], r["te"]) for r in got} == {(k, te) for k, y in DATA.items() for te in range(60, len(y), 20)}
    for r in got:
        y, te = DATA[r["key"]], r["te"]
        m = lambda at: np.column_stack([np.ones(len(at)), at, np.sin(2 * np.pi * at / 52.1775), np.cos(2 * np.pi * at / 52.1775)])
        beta = np.linalg.lstsq(m(np.arange(te)), y[:te], rcond=None)[0]
        assert r["predicted"] == pytest.approx((m(np.array([te + r["h"] - 1])) @ beta)[0], abs=1e-6) and r["actual"] == pytest.approx(y[te + r["h"] - 1])


def dickey_fuller(x, most):
    d = np.diff(x)

    def fit(lag, trim):
        a = np.column_stack([np.ones(len(d) - trim), x[trim:-1], *[d[trim - j - 1:len(d) - j - 1] for j in range(lag)]])
        b = np.linalg.lstsq(a, d[trim:], rcond=None)[0]
        e = d[trim:] - a @ b
        return len(e), e @ e, b, a

    lag = min(range(most + 1), key=lambda k: (lambda f: f[0] * np.log(f[1] / f[0]) + 2 * (k + 2))(fit(k, most)))
    n, sse, b, a = fit(lag, lag)
    return n, lag, b[1] / np.sqrt(sse / (n - lag - 2) * np.linalg.inv(a.T @ a)[1, 1])


def test_unit_root(spark, df):
    rng = np.random.RandomState(5)
    data = DATA | {"noise": rng.randn(300), "walk": np.cumsum(rng.randn(300)), "flat": np.ones(40), "two": np.array([1.0, 2.0]), "one": np.array([1.0])}
    got = by_key(regression.unit_root(frame(spark, data), KEY, "t", "v"))
    for k in (*DATA, "noise", "walk"):
        y = data[k]
        n, lag, tau = dickey_fuller(y, min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2))
        assert (got[k]["n"], got[k]["lag"]) == (n, lag) and got[k]["statistic"] == pytest.approx(tau, rel=1e-6)
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]
    assert all(k not in got or got[k]["statistic"] is None for k in ("flat", "two", "one"))


def test_p_values_at_published_critical_values(spark):
    taus = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,), (3.0,), (-19.0,), (None,)], "tau double")
    p = [r[0] for r in taus.select(regression.unit_root_p(F.col("tau"))).collect()]
    assert p[:3] == pytest.approx([0.01, 0.05, 0.10], abs=2e-3) and p[3:] == [1.0, 0.0, None]


def test_significant_lags(df):
    got = by_key(evaluate.significant_lags(df, KEY, "t", "v", 40))
    for k, y in DATA.items():
        x = y - y.mean()
        acf = [x[j:] @ x[:len(x) - j] / (x @ x) for j in range(min(40, len(x) // 2) + 1)]
        assert got[k]["significant_lags"] == sum(abs(a) > 1.96 / math.sqrt(len(x)) for a in acf) and got[k]["lag_1"] == pytest.approx(acf[1])


# --- folds -----------------------------------------------------------------------------------

def test_smoothing_state_equals_the_recursion(spark, df):
    rows = folds.arrays(df, KEY, "t", "v")
    w = (0.3, 0.1, 0.2, 0.9)
    for season in (4, 26):
        got = by_key(rows.select("key", folds.smoothing_state(F.col("y"), [F.lit(x) for x in w], season).alias("s")))
        for k, y in DATA.items():
            sse, level, trend, cycle = estimators.smoothing_run(y, np.array(w), season)
            s = got[k]["s"]
            assert (s["sse"], s["level"], s["trend"]) == pytest.approx((sse, level, trend)) and np.allclose(np.roll(cycle, -(len(y) % season)), s["cycle"])


def test_the_search_finds_no_worse_than_its_grid_and_moves(df):
    rows = folds.arrays(df, KEY, "t", "v")
    found = by_key(folds.smoothed_series(rows, KEY, 4, 8, rounds=4))
    for k, y in DATA.items():
        grid = min(estimators.smoothing_run(y, np.array(w), 4)[0] for w in folds.SMOOTHING_GRID)
        assert found[k]["loss"] <= grid + 1e-9 and found[k]["loss"] == pytest.approx(estimators.smoothing_run(y, np.array(found[k]["w"]), 4)[0])
        assert all(0.01 <= x <= 0.98 for x in found[k]["w"])


def test_short_series_repeat_their_season(spark):
    data = {"a": [1.0, 2.0, 3.0], "b": [None, 5.0], "c": [None, None]}
    got = {(r["key"], r["h"]): r["predicted"] for r in folds.smoothing_forecast(frame(spark, data), KEY, "t", "v", 4, season=2, least=8).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 3.0, ("a", 3): 2.0, ("a", 4): 3.0, ("b", 1): 5.0, ("b", 2): 5.0, ("b", 3): 5.0, ("b", 4): 5.0}
    assert folds.smoothing_forecast(frame(spark, {}), KEY, "t", "v", 4).count() == 0


def test_smoothing_walkforward_reads_only_the_past(spark):
    y = series(90, 1)
    changed = np.concatenate([y[:70], y[70:] + 1000])
    run = lambda v: {(r["te"], r["h"]): r["predicted"] for r in folds.smoothing_walkforward(frame(spark, {"a": v}), KEY, "t", "v", 40, 2, 15, 4, 8, rounds=1).collect()}
    a, b = run(y), run(changed)
    assert set(a) == {(te, h) for te in range(40, 90, 15) for h in (1, 2)}
    assert all(a[k] == b[k] for k in a if k[0] <= 70) and any(a[k] != b[k] for k in a if k[0] > 70)


def test_fourier_arima(df):
    ahead = {(r["key"], r["h"]): r for r in folds.fourier_arima_forecast(df, KEY, "t", "v", 3, pairs=2, moving=False).collect()}
    full = by_key(folds.fourier_arima(df, KEY, "t", "v", pairs=2))
    for k, y in DATA.items():
        want = estimators.arimax(y, 3, order=(1, 1, 0), pairs=2)
        assert np.allclose([ahead[k, h]["predicted"] for h in (1, 2, 3)], want[:, 0], atol=1e-6)
        z = np.diff(y) - np.diff(estimators.fourier_terms(np.arange(len(y)), 2), axis=0) @ np.array(full[k]["beta"])
        sse = lambda phi, theta: float(np.sum(estimators.arma_errors(z, np.array([1, -phi]), np.array([1, theta])) ** 2))
        assert full[k]["sse"] == pytest.approx(sse(full[k]["phi"], full[k]["theta"]))
        assert full[k]["sse"] <= min(sse(p, q) for p, q in folds.ARMA_GRID) + 1e-9
    plain = by_key(folds.fourier_arima(df, KEY, "t", "v", pairs=0))
    assert all(plain[k]["beta"] == [] and plain[k]["level"] == pytest.approx(y[-1]) for k, y in DATA.items())


@pytest.mark.parametrize("ar", [(1.5, -0.7), (-0.4, 0.5), (0.3,)])
def test_autoregressions_are_recovered(ar):
    rng = np.random.RandomState(0)
    e, x = rng.randn(4000), np.zeros(4000)
    for i in range(2, 4000):
        x[i] = sum(c * x[i - j - 1] for j, c in enumerate(ar)) + e[i]
    p = estimators.arima_fit(x + 100, order=(len(ar), 0, 0), pairs=0)
    assert np.allclose(-p["ar"][1:], ar, atol=0.05) and p["sigma"] == pytest.approx(1, abs=0.05)
    chosen = estimators.arima_fit(x + 100, order=None, pairs=0)
    assert chosen["sigma"] == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("ma", [(1.2, 0.5), (-1.1, 0.4)])
def test_moving_averages_are_recovered(ma):
    e = np.random.RandomState(1).randn(6000)
    x = e.copy()
    x[1:] += ma[0] * e[:-1]
    x[2:] += ma[1] * e[:-2]
    assert np.allclose(estimators.arima_fit(x, order=(0, 0, 2), pairs=0)["ma"][1:], ma, atol=0.05)


def test_coefficients_beyond_the_edge_are_pulled_back():
    for c, sign in ((np.array([1.2]), -1), (np.array([0.5, 0.6]), -1), (np.array([3.0, 1.0]), 1), (np.array([2.0, -1.0, 0.0]), -1)):
        inside = estimators.settled(c, sign)
        assert len(inside) == len(c) and np.abs(np.roots(np.concatenate([[1.0], sign * inside]))).max() <= 0.98 + 1e-6
    assert estimators.settled(np.array([1.5, -0.7]), -1).tolist() == [1.5, -0.7]


# --- tuning and stacking -----------------------------------------------------------------------

def test_tuning_equals_a_loop(df):
    space = {"alpha": (0.1, 0.4, 0.7, 0.9), "pull": (0.0, 0.5)}
    for metric in ("mae", "rmse", "smape"):
        got = {(r["key"], r["trial"]): r for r in tuning.tuned(df, KEY, "t", "v", space, metric=metric, validation=18, rungs=2, eta=3).collect()}
        for k, y in DATA.items():
            losses = {}
            for trial, p in enumerate(tuning.choices(space)):
                level = mean = y[0]
                guess = [np.nan]
                for i, v in enumerate(y[1:], 1):
                    guess.append((1 - p["pull"]) * level + p["pull"] * mean)
                    level, mean = p["alpha"] * v + (1 - p["alpha"]) * level, (mean * i + v) / (i + 1)
                for rung, m in enumerate((6, 18)):
                    a, g = y[-m:], np.array(guess)[-m:]
                    e = np.abs(a - g)
                    losses[trial, rung] = {"mae": e.mean(), "rmse": np.sqrt((e**2).mean()), "smape": (200 * e / (np.abs(a) + np.abs(g))).mean()}[metric]
            first = sorted(range(8), key=lambda s: losses[s, 0])
            kept = sorted(first[:3], key=lambda s: losses[s, 1])
            for place, trial in enumerate(first, 1):
                r = got[k, trial]
                rung = 1 if trial in kept else 0
                assert (r["rung"], r["rank"]) == (rung, kept.index(trial) + 1 if rung else place) and r["loss"] == pytest.approx(losses[trial, rung])
                assert r["best"] == (trial == kept[0])


def test_tuning_of_short_and_empty_series(spark):
    got = tuning.tuned(frame(spark, {"a": [1.0], "b": [2.0, None, 3.0]}), KEY, "t", "v", {"alpha": (0.5, 0.9)}, validation=5, rungs=2).collect()
    assert {(r["key"], r["best"]) for r in got if r["key"] == "a"} == {("a", False)} and sum(r["best"] for r in got if r["key"] == "b") == 1
    assert tuning.tuned(frame(spark, {}), KEY, "t", "v", {"alpha": (0.5,)}).count() == 0
    with pytest.raises(ValueError):
        tuning.tuned(frame(spark, {"a": [1.0, 2.0]}), KEY, "t", "v", {"alpha": (0.5,)}, metric="other")


def nnls(x, y):
    best = (y @ y, np.zeros(x.shape[1]))
    for mask in itertools.product((0, 1), repeat=x.shape[1]):
        on = [j for j, m in enumerate(mask) if m]
        if on:
            w = np.zeros(x.shape[1])
            w[on] = np.linalg.lstsq(x[:, on], y, rcond=None)[0]
            if (w >= 0).all() and (e := y - x @ w) @ e < best[0] - 1e-9:
                best = (e @ e, w)
    return best[1]


def test_stacked_weights_are_non_negative_least_squares(spark):
    rng = np.random.RandomState(4)
    models, rows, want = ("a", "b", "c"), [], {}
    for k in range(8):
        y = rng.randn(40) + 3
        x = np.column_stack([y * rng.randn() + rng.randn(40) * s for s in (0.5, 1, 2)])
        want[f"k{k}"] = nnls(x, y)
        rows += [(f"k{k}", START + datetime.timedelta(days=i), m, float(y[i]), float(x[i, j])) for i in range(40) for j, m in enumerate(models)]
        rows.append((f"k{k}", START - datetime.timedelta(days=1), "a", 99.0, 1.0))  # not all models have a prediction
    got = by_key(stacking.stacked(spark.createDataFrame(rows, "key string, date date, model string, actual double, predicted double"), KEY, models))
    assert any((w == 0).any() for w in want.values()) and any((w > 0).sum() > 1 for w in want.values())
    assert all(np.allclose(got[k]["weights"], w, atol=1e-8) for k, w in want.items())
    with pytest.raises(ValueError):
        stacking.stacked(spark.createDataFrame(rows[:1], "key string, date date, model string, actual double, predicted double"), KEY, [])


def test_stacking_knows_only_the_past(spark):
    rng = np.random.RandomState(6)
    y = rng.rand(60) * 5 + 10
    pred = {m: y + rng.randn(60) * s for m, s in (("a", 1.0), ("b", 3.0))}
    rows = [("k", te, h, START + datetime.timedelta(days=te + h), m, float(y[te + h - 1]), float(pred[m][te + h - 1] + h)) for te in range(20, 56, 4) for h in (1, 2, 3) for m in pred]
    schema = "key string, te int, h int, date date, model string, actual double, predicted double"
    got = stacking.walkforward(spark.createDataFrame(rows, schema), KEY, ("a", "b")).collect()
    assert len(got) == 27
    for r in got:
        past = [(x, h) for x in range(20, 56, 4) for h in (1, 2, 3) if x + h <= r["te"]]
        x = np.array([[pred[m][a + h - 1] + h for m in ("a", "b")] for a, h in past])
        w = nnls(x, np.array([y[a + h - 1] for a, h in past])) if past else np.array([0.5, 0.5])
        assert np.allclose(r["weights"], w, atol=1e-8)
