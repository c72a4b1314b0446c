"""Grids, gap filling, features, splits, backtests and metrics on literal rows."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadence.operators import evaluate, series

DAY = datetime.date(2023, 1, 1)
WEEK = datetime.timedelta(days=7)


def frame(spark, values, key="a", start=DAY, step=WEEK):
    return spark.createDataFrame([(key, start + step * i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, t date, v double")


def values(df, col="v"):
    return [r[col] for r in df.orderBy("key", "t").collect()]


def test_interpolation_and_fills(spark):
    df = frame(spark, [None, 1, 2, None, 4, None, None, 7, None])
    assert values(series.interpolated(df, ["key"], "t", "v")) == [1, 1, 2, 3, 4, 5, 6, 7, 7]
    assert values(series.interpolated(df, ["key"], "t", "v", "forward")) == [None, 1, 2, 3, 4, 5, 6, 7, 7]
    gaps = frame(spark, [1, 2, None, None, 5])
    assert values(series.filled(gaps, ["key"], "t", "v", "ffill")) == [1, 2, 2, 2, 5]
    assert values(series.filled(gaps, ["key"], "t", "v", "bfill")) == [1, 2, 5, 5, 5]
    assert values(series.filled(frame(spark, [None, None]), ["key"], "t", "v")) == [0, 0]
    with pytest.raises(ValueError):
        series.filled(gaps, ["key"], "t", "v", "nearest")


def test_grid_drops_what_is_off_it(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + WEEK * 3, 4.0), ("a", DAY + datetime.timedelta(days=9), 9.0), ("b", DAY, 2.0)], "key string, t date, v double")
    got = series.date_grid(df, ["key"], "t").orderBy("key", "t").collect()
    assert [(r.key, r.v) for r in got] == [("a", 1.0), ("a", None), ("a", None), ("a", 4.0), ("b", 2.0)]


def test_lags_and_rolling_equal_pandas(spark):
    v = list(np.random.default_rng(0).normal(size=40))
    out = series.rolling(series.lagged(frame(spark, v), ["key"], "t", "v", [1, 4]), ["key"], "t", "v", [4]).orderBy("t").toPandas()
    s = pd.Series(v)
    np.testing.assert_allclose(out["lag_4"].astype(float), s.shift(4))
    np.testing.assert_allclose(out["rolling_mean_4"].astype(float), s.shift(1).rolling(4).mean())
    np.testing.assert_allclose(out["rolling_std_4"].astype(float), s.shift(1).rolling(4).std())
    assert values(series.smoothed(frame(spark, [1, 2, 3, 4]), ["key"], "t", "v"), "smoothed") == [1, 1.5, 2, 3]


def test_step_features_follow_the_matrix(spark):
    v = list(np.random.default_rng(1).normal(size=30))
    last = series.feature_matrix(frame(spark, v), ["key"], "t", "v", [1, 2], [4]).orderBy(F.desc("t")).first()
    made = series.step_features(F.array(*[F.lit(x) for x in v[:-1]]), F.lit(DAY + WEEK * 29), F.lit(29), [1, 2], [4])
    step = spark.range(1).select(*[c.alias(k) for k, c in made.items()]).first()
    for k in series.feature_names([1, 2], [4]):
        assert step[k] == pytest.approx(last[k])
    short = series.step_features(F.array(F.lit(3.0)), F.lit(DAY), F.lit(1), [1, 2], [4])
    one = spark.range(1).select(*[c.alias(k) for k, c in short.items()]).first()
    assert (one.lag_1, one.lag_2, one.rolling_mean_4, one.rolling_std_4) == (3.0, None, 3.0, 0.0)


def test_splits(spark):
    long_ = frame(spark, range(260))
    n = {r.split: r["count"] for r in series.temporal_split(long_, ["key"], "t", train=0.6, val=0.2, test=0.2).groupBy("split").count().collect()}
    assert n == {"train": 156, "val": 52, "test": 52}
    with pytest.raises(ValueError):
        series.temporal_split(long_, ["key"], "t", train=0.7, val=0.2, test=0.2)
    with pytest.raises(PySparkException, match="Insufficient training data"):
        series.temporal_split(frame(spark, range(50)), ["key"], "t").collect()
    with pytest.raises(ValueError):
        series.temporal_split(long_, ["key"], "t", "random")
    twice = series.temporal_split(long_, ["key"], "t", "years", train=(2023, 2024), val=(2024, 2025), test=(2025, 2026))
    assert twice.count() > 260


def test_metrics(spark):
    a, p = [10, 15, 12, 18, 20, 17, 22, 25, 23, 20], [11, 14, 13, 17, 21, 16, 23, 24, 24, 19]
    df = spark.createDataFrame([("m", DAY + WEEK * i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, p))], "model string, date date, actual double, predicted double")
    r = evaluate.metrics(df, ["model"]).first()
    assert (r.mae, r.rmse, r.me, r.n) == (1, 1, 0, 10) and 0 < r.r2 < 1 and r.mda == 100
    flat = spark.createDataFrame([("m", DAY, 0.0, 0.0)], df.schema)
    r = evaluate.metrics(flat, ["model"]).first()
    assert (r.mae, r.mape, r.smape, r.mda, r.r2) == (0, None, None, None, None)
    near = spark.createDataFrame([("m", DAY + WEEK * i, v, 0.5) for i, v in enumerate((0.0, 1e-6, 2e-6, 5e-6))], df.schema)
    assert evaluate.metrics(near, ["model"], epsilon=1e-5).first().mape is None


def test_backtest_origins(spark):
    df = frame(spark, range(1, 21))
    rows = evaluate.backtest(df, ["key"], "t", "v", 10, 1, 1)
    assert rows.count() == 10 and evaluate.by_horizon(rows, ["key"]).first().mae == 1
    sliding = evaluate.backtest(df, ["key"], "t", "v", 10, 1, 2, window="sliding", model="mean").orderBy("te").collect()
    assert [r.te for r in sliding] == [10, 12, 14, 16, 18] and [r.predicted for r in sliding] == [5.5, 7.5, 9.5, 11.5, 13.5]
    steps = evaluate.backtest(df, ["key"], "t", "v", 12, 3, 2)
    assert steps.select("te").distinct().count() == 4 and steps.where("te = 18").count() == 2
    assert evaluate.backtest(df, ["key"], "t", "v", 20, 1).count() == 0
    by_date = evaluate.backtest(df, ["key"], "t", "v", str(DAY + WEEK * 9), 1, 1)
    assert by_date.count() == 10
    for bad in ({"horizon": 0}, {"step": 0}, {"train": 0}):
        with pytest.raises(ValueError):
            evaluate.backtest(df, ["key"], "t", "v", **({"train": 10, "horizon": 1, "step": 1} | bad))
    season = evaluate.backtest(df, ["key"], "t", "v", 10, 3, 5, "seasonal_naive", season=4).where("te = 10").orderBy("h").collect()
    assert [r.predicted for r in season] == [7, 8, 9]


def test_blend_rank_and_ensemble(spark):
    rows = spark.createDataFrame([("k", 1, DAY, 5.0, None), ("k", 2, DAY, 5.0, 7.0), ("k", 3, DAY, 5.0, 9.0)], "key string, h int, date date, actual double, predicted double")
    assert evaluate.blended(rows, ["key"]).first().predicted == 7
    table = spark.createDataFrame([("a", 1.0, 0.2), ("b", None, 0.9), ("c", 1.0, None)], "model string, mae double, r2 double")
    assert [r.model for r in evaluate.ranked_models(table, "mae").orderBy("rank").collect()] == ["a", "c", "b"]
    assert [r.model for r in evaluate.ranked_models(table, "r2").orderBy("rank").collect()] == ["b", "a", "c"]
    preds = spark.createDataFrame([("x", DAY, 1.0, 2.0), ("y", DAY, 1.0, 4.0), ("z", DAY, 1.0, None)], "model string, date date, actual double, predicted double")
    assert evaluate.ensemble(preds, ["date"], {"x": 3, "y": 1, "z": 9}).first().predicted == 2.5
    assert evaluate.ensemble(preds, ["date"], how="median").first().predicted == 3
    tall = spark.createDataFrame([("m", 1, "mae", 2.0), ("m", 4, "mae", 3.0), ("m", 1, "r2", 0.9), ("m", 4, "r2", 0.5), ("q", 1, "mae", 0.0), ("q", 4, "mae", 1.0)], "model string, h int, metric string, value double")
    assert {(r.model, r.metric): r.change for r in evaluate.degradation(tall, 1, 4).collect()} == {("m", "mae"): 50.0, ("m", "r2"): -0.4, ("q", "mae"): None}
