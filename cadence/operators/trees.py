"""Tree forecasters: one global Spark ML model over all keys, rolled forward step by step on arrays of history."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from .evaluate import metrics
from .series import feature_matrix, feature_names, step_features

LAGS, WINDOWS = (1, 2, 4, 8, 13), (4, 13, 26)
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": 42}
SETTLED = 4  #: steps of a forecast that one plan holds
BOOSTED = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42}


def fit(df: DataFrame, keys: Sequence[str], t: str, value: str, kind: str = "random_forest", lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, **params):
    """A pipeline (features, trees) on every series' rows; a key is known by the mean of its values, so any number of keys will do."""
    if kind not in ("random_forest", "gbt"):
        raise ValueError(f"unknown kind {kind}")
    base, est = (FOREST, RandomForestRegressor) if kind == "random_forest" else (BOOSTED, GBTRegressor)
    level = df.groupBy(*keys).agg(F.avg(value).alias("__level"))
    rows = feature_matrix(df, keys, t, value, lags, windows).join(level, list(keys))
    trees = est(featuresCol="features", labelCol=value, predictionCol="predicted", **(base | params))
    return Pipeline(stages=[VectorAssembler(inputCols=["__level", *feature_names(lags, windows)], outputCol="features"), trees]).fit(rows)


def forecast(model, df: DataFrame, keys: Sequence[str], t: str, value: str, horizon: int, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, days: int = 7) -> DataFrame:
    """(keys, h, date, predicted): each step's features come from the history with the steps before it appended; never below 0.

    Every ``SETTLED`` steps the state, one row for each key, is written, so that no plan holds more copies of the trees.
    """
    keep = max(max(lags), max(windows))
    w = Window.partitionBy(*keys).orderBy(F.desc(t))
    ends = (df.select(*keys, t, value).withColumn("__n", F.row_number().over(w)).withColumns({"__all": F.count("*").over(Window.partitionBy(*keys)), "__level": F.avg(value).over(Window.partitionBy(*keys))})
            .where(F.col("__n") <= keep).groupBy(*keys)
            .agg(F.max(t).alias("last"), F.max("__all").alias("size"), F.max("__level").alias("__level"), F.transform(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("history")))
    state = ends.where(F.size("history") >= keep).withColumn("path", F.array().cast("array<double>"))
    for h in range(1, horizon + 1):
        made = step_features(F.col("history"), F.date_add("last", days * h), F.col("size") + h - 1, lags, windows)
        step = model.transform(state.withColumns(made)).withColumn("p", F.greatest(F.lit(0.0), "predicted"))
        state = step.select(*keys, "last", "size", "__level", F.concat("history", F.array("p")).alias("history"), F.concat("path", F.array("p")).alias("path"))
        if h % SETTLED == 0 and h < horizon:
            state = stored(state, "forecast")
    return state.select(*keys, "last", F.posexplode("path").alias("h", "predicted")).select(*keys, (F.col("h") + 1).alias("h"), F.date_add("last", (F.col("h") + 1) * days).alias("date"), "predicted")


def importances(model, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> list[tuple[str, float]]:
    """Features by their share of the trees' gain, the largest first."""
    got = model.stages[-1].featureImportances.toArray()
    total = got.sum() or 1.0
    return sorted(zip(["key", *feature_names(lags, windows)], (float(x / total) for x in got)), key=lambda x: (-x[1], x[0]))


def choices(space: dict[str, Sequence], n: int | None = None, seed: int = 42) -> list[dict]:
    """All parameter sets of a space, or ``n`` drawn without repeats; a draw of all is the whole space."""
    every = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    return every if n is None or n >= len(every) else random.Random(seed).sample(every, n)


def tuned(train: DataFrame, val: DataFrame, keys: Sequence[str], t: str, value: str, space: dict[str, Sequence], metric: str = "mae", kind: str = "random_forest", n: int | None = None, fixed: dict | None = None, **shape) -> tuple[dict, list[tuple[dict, float]]]:
    """Parameters of least validation error over a temporal split, and every trial; failed trials are skipped."""
    if metric not in ("mae", "rmse", "smape"):
        raise ValueError(f"metric must be mae, rmse or smape, not {metric}")
    horizon = val.groupBy(*keys).count().agg(F.max("count")).first()[0]
    trials, best = [], None
    for params in choices(space, n):
        model = fit(train, keys, t, value, kind, **shape, **(fixed or {}), **params)
        got = forecast(model, train, keys, t, value, horizon, **shape)
        scored = val.select(*keys, F.col(t).alias("date"), F.col(value).alias("actual")).join(got, [*keys, "date"])
        score = metrics(scored, keys).agg(F.avg(metric)).first()[0]
        trials.append((params, score))
        if score is not None and (best is None or score < best[1]):
            best = (params, score)
    if best is None:
        raise RuntimeError("no trial succeeded")
    return best[0], trials


def walkforward(df: DataFrame, keys: Sequence[str], t: str, value: str, kind: str, cutoffs: Sequence, horizon: int = 4, refit_every: int = 1, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, **params) -> DataFrame:
    """(keys, te, h, date, actual, predicted) of one model of all keys at each origin of ``cutoffs``, dates in order.

    The model is fitted on all rows up to the first cutoff and every ``refit_every``-th after it, 0 only once; between, newer rows only feed its features.
    """
    if refit_every < 0 or not cutoffs:
        raise ValueError("refit_every must not be negative and cutoffs not empty")
    out, model = None, None
    for s, te in enumerate(cutoffs):
        past = df.where(F.col(t) <= F.lit(te))
        if model is None or refit_every and s % refit_every == 0:
            model = fit(past, keys, t, value, kind, lags, windows, **params)
        ahead = stored(forecast(model, past, keys, t, value, horizon, lags, windows).withColumn("te", F.lit(te).cast("date")), "tree-origin")
        out = ahead if out is None else out.unionByName(ahead)
    actual = df.select(*keys, F.col(t).alias("date"), F.col(value).cast("double").alias("actual"))
    return out.join(actual, [*keys, "date"]).select(*keys, "te", "h", "date", "actual", "predicted")
