"""Sums, rates, ranks, outliers, sources, sinks and grouped models."""

import datetime
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadence.functions import scalar
from cadence.operators import models, outliers, panel, training, trees
from cadence.sources import readers, sinks
from cadence.streaming.weekly import weekly_counts

DAY = datetime.date(2020, 1, 6)


def test_scalars(spark):
    df = spark.createDataFrame([("\tab ", "7", "nan", "2020-01-05"), ("x", "150", "1.5", "bad")], "s string, i string, n string, d string")
    got = df.select(scalar.stripped(F.col("s")), scalar.padded(F.col("i")), scalar.number(F.col("n"), 0), scalar.day(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("ab", "07", 0.0, datetime.date(2020, 1, 5)), ("x", "150", 1.5, None)]
    r = spark.range(1).select(scalar.rate(F.lit(1), F.lit(0)), scalar.rate(F.lit(1), F.lit(8), 1.0, 2), scalar.rate(F.lit(None).cast("int"), F.lit(3))).first()
    assert tuple(r) == (None, 0.12, None)


def test_rates_are_ratios_of_sums(spark):
    df = spark.createDataFrame([("a", 2000, 1.0, 100.0), ("b", 2000, 9.0, 300.0), ("c", 2000, 5.0, 0.0)], "department string, year int, x double, population double")
    assert panel.national_rates(df, ["x"]).first().x_rate == 15 / 400 * 1e5
    assert {r.department: r.x_rate for r in panel.with_rates(df, ["x"]).collect()}["c"] is None


def test_ranks(spark):
    df = spark.createDataFrame([(d, y, v) for y, row in ((2000, (3, 3, 1, None)), (2001, (1, 2, 3, 4))) for d, v in zip("abcd", row)], "department string, year int, v int")
    ranked = panel.rank_within(df, "v")
    assert {(r.department, r.year): r["rank"] for r in ranked.collect()} == {("a", 2000): 1, ("b", 2000): 1, ("c", 2000): 3, ("a", 2001): 4, ("b", 2001): 3, ("c", 2001): 2, ("d", 2001): 1}
    top = {r.department: (r.top_years, r.percent) for r in panel.top_frequency(ranked, 2).collect()}
    assert top == {"a": (1, 50.0), "b": (1, 50.0), "c": (1, 50.0), "d": (1, 50.0)}
    assert panel.rank_grid(ranked, [2000, 2001]).where("department = 'd'").first()["2000"] is None
    with pytest.raises(PySparkException, match="repeat"):
        panel.rank_grid(ranked.unionAll(ranked), [2000, 2001]).collect()
    with pytest.raises(ValueError):
        panel.available(df, ["w"])


def test_census(spark):
    wide = spark.createDataFrame([("a", "1", "10", None), ("b", "2", "bad", "30")], "department string, iddpto string, `1993` string, `1995` string")
    tall = panel.census_long(wide, ["department"])
    assert {(r.department, r.year): r.population for r in tall.collect()} == {("a", 1993): 10.0, ("a", 1995): None, ("b", 1993): None, ("b", 1995): 30.0}


def test_outliers(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [("b", i, 5.0) for i in range(5)], "key string, year int, v double")
    assert [r.v for r in outliers.beyond_fences(df, "v", ["key"]).collect()] == [100.0]
    assert outliers.severity(df.where("key = 'b'"), "v").first().severity is None
    a, b = df.where("year < 2"), df.where("year > 0 and year < 3")
    got = {(r.key, r.year): r["class"] for r in outliers.classified(a, b, ["key", "year"]).collect()}
    assert got[("a", 0)] == "iqr_only" and got[("a", 1)] == "confirmed" and got[("b", 2)] == "arima_only"
    assert outliers.common(a, b, ["key", "year"]).count() == 2 and outliers.only(a, b, ["key", "year"]).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "w.csv").write_text("ANO , iddpto," + ",".join(readers.COUNTS) + "\n2001,7,1,2,3,x,5,6\nbad,8,1,1,1,1,1,1\n")
    rows = readers.annual_cases(spark, str(tmp_path / "w.csv")).collect()
    assert len(rows) == 1 and rows[0].iddpto == "07" and rows[0].hosp_60plus == 0 and rows[0].year == 2001
    with pytest.raises(ValueError, match="missing"):
        readers.csv(spark, str(tmp_path / "w.csv"), ["nope"])
    weekly = spark.createDataFrame([(" lima\t", "2021-01-03", "4"), ("x", "bad", "1")], "department string, week_start string, pneumonia_under5 string")
    r = readers.weekly_cases(weekly, "under5", "Lima").first()
    assert (r.department, r.week_of_year, r.cases, r.year) == ("LIMA", 53, 4.0, 2021)
    (tmp_path / "m.json").write_text(json.dumps({"department": "A", "age_group": "g", "model": "n", "metrics_by_horizon": {"1": {"mae": 2.0}}}))
    assert readers.horizon_metrics(spark, str(tmp_path / "*.json")).where("metric = 'mae'").first().value == 2.0
    rows = spark.createDataFrame([(DAY, s, "m", 1.0, 2.0, "A", "g") for s in ("train", "val", "backtest")], readers.PREDICTIONS)
    sinks.write_splits(rows, str(tmp_path / "p"))
    sinks.write_splits(rows.where("split = 'val'").withColumn("actual", F.lit(9.0)), str(tmp_path / "p"))
    assert {r.split: r.actual for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"train": 1.0, "val": 9.0, "backtest": 1.0}
    sinks.write(rows, str(tmp_path / "c"), "csv")
    sinks.write(rows.limit(0), str(tmp_path / "c"), "csv", force=False)
    assert readers.predictions(spark, str(tmp_path / "c")).count() == 3
    with pytest.raises(ValueError):
        sinks.write(rows, str(tmp_path / "x"), "orc")


def wave(n, trend=0.1):
    t = np.arange(n)
    return 50 + trend * t + 10 * np.sin(2 * np.pi * t / 52)


@pytest.mark.parametrize("name", ["holt_winters", "SARIMA", "auto-sarima", "Prophet", "lstm", "GRU"])
def test_models_beat_the_last_value_on_a_wave(name):
    f, options = models.model_of(name)
    y = wave(260)
    out = f(y[:234], 26, **options)
    assert out.shape == (26, 3) and (out[:, 1] <= out[:, 0]).all() and (out[:, 0] <= out[:, 2]).all()
    assert np.abs(out[:, 0] - y[234:]).mean() < np.abs(y[233] - y[234:]).mean()


def test_failures_are_rows(spark):
    df = spark.createDataFrame([("a", DAY + datetime.timedelta(days=7 * i), float(v)) for i, v in enumerate(wave(120))] + [("b", DAY, 1.0)], "key string, t date, v double")
    got = models.grouped_forecast(df, ["key"], "t", "v", models.arimax, 3).collect()
    assert {(r.key, r.status) for r in got} == {("a", "success"), ("b", "failed")} and all(r.predicted >= 0 for r in got if r.key == "a")
    parts = models.decomposed(df, ["key"], "t", "v", 52).toPandas()
    assert len(parts) == 120 and np.allclose(parts.observed, parts.trend + parts.seasonal + parts.remainder)
    assert models.residuals(df, ["key"], "t", "v").where("residual is null").count() == 2
    with pytest.raises(ValueError):
        models.model_of("oracle")


def test_trees(spark):
    df = spark.createDataFrame([(k, DAY + datetime.timedelta(days=7 * i), float(v)) for k in "ab" for i, v in enumerate(wave(120, 0))], "key string, t date, v double")
    shape = {"lags": (1, 2), "windows": (4,)}
    model = trees.fit(df, ["key"], "t", "v", numTrees=5, maxDepth=4, **shape)
    got = trees.forecast(model, df, ["key"], "t", "v", 3, **shape).collect()
    assert len(got) == 6 and all(30 < r.predicted < 70 for r in got)
    assert abs(sum(x for _, x in trees.importances(model, **shape)) - 1) < 1e-6
    assert len(trees.choices({"a": [1, 2], "b": [3, 4, 5]})) == 6 and len(trees.choices({"a": [1, 2], "b": [3, 4, 5]}, 2)) == 2


def test_weekly_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, 5), "x") for d in (1, 2, 8)]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(str(tmp_path / "e"))
    batch = {(r.week_start, r.cases) for r in weekly_counts(spark.read.parquet(str(tmp_path / "e")), "kind").collect()}
    assert batch == {(datetime.date(2024, 1, 1), 2), (datetime.date(2024, 1, 8), 1)}
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "e"))
    q = weekly_counts(stream, "kind").writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.week_start, r.cases) for r in spark.table("weekly").collect()} == batch


def test_training_pipeline(spark):
    df = spark.createDataFrame([("a", DAY + datetime.timedelta(days=7 * i), float(v)) for i, v in enumerate(wave(150, 0))] + [("b", DAY + datetime.timedelta(days=7 * i), 1.0) for i in range(8)], "key string, t date, v double")
    rows = training.held_out(df, ["key"], "t", "v", "sarima", least=1)
    got = rows.collect()
    assert {(r.key, r.split, r.status) for r in got} == {("a", "val", "success"), ("a", "test", "success"), ("b", "val", "failed")}
    assert sum(r.key == "a" for r in got) == 30
    best = {r.split: r.best for r in training.report(rows, ["key"]).where("key = 'a'").collect()}
    assert best == {"val": "sarima", "test": "sarima"}
    tall = training.long_predictions(df, rows, ["key"], "t", "v", least=1)
    assert tall.where("split = 'train' and model = 'actual'").count() == 127


def test_diagnostics(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", DAY + datetime.timedelta(days=7 * i), float(v)) for i, v in enumerate(wave(150) + rng.normal(size=150))] + [("b", DAY, 1.0)], "key string, t date, v double")
    got = {r.key: r for r in models.diagnosed(df, ["key"], "t", "v").collect()}
    assert got["a"].n == 149 and got["a"].bic > got["a"].aic and got["a"].rmse < 3 and got["a"].adf < -3
    assert got["b"].n is None and got["b"].adf is None
    walk = np.cumsum(rng.normal(size=300))
    assert models.dickey_fuller(walk) > -3.4 and models.dickey_fuller(np.diff(walk)) < -5


def test_equal_means_are_ranked_by_name(spark):
    """(0.1 + 0.2) + 0.3 is more than (0.3 + 0.2) + 0.1 in doubles; the means are equal."""
    rows = [("m", "b", v) for v in (0.1, 0.2, 0.3)] + [("m", "a", v) for v in (0.3, 0.2, 0.1)] + [("m", "c", v) for v in (None, 0.1, 0.4)]
    df = spark.createDataFrame(rows, "measure string, department string, value double").coalesce(1)
    for n, want in ((1, {"c"}), (2, {"a", "c"}), (3, {"a", "b", "c"})):
        assert {r.department for r in panel.top_of_each(df, "measure", "department", "value", n, digits=2).collect()} == want
    means = {r.department: r.m for r in df.groupBy("department").agg(panel.exact_mean("value", 2).alias("m")).collect()}
    assert means["a"] == means["b"] == 0.2 and means["c"] == 0.25
