"""Metrics, rolling-origin backtests, comparison of models. Predictions are tall: keys, h, date, actual, predicted."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import change
from .series import with_position

METRICS = ("mae", "rmse", "me", "mape", "smape", "mda", "r2")
HIGHER_IS_BETTER = ("mda", "r2")
EPSILON = 1e-10


def metric_columns(a: Column, p: Column, before: Column, epsilon: float = EPSILON) -> dict[str, Column]:
    """Aggregates of the seven metrics; ``before`` is the actual of the row before.

    Percentages leave out rows whose base is no more than ``epsilon``; r2 is null where the
    actuals do not vary; mda compares directions and is null under two rows.
    """
    e = a - p
    base = (F.abs(a) + F.abs(p)) / 2
    return {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "me": F.avg(e),
        "mape": F.avg(F.when(F.abs(a) > epsilon, F.abs(e / F.nullif(a, F.lit(0.0))))) * 100,
        "smape": F.avg(F.when(base > epsilon, F.abs(e) / F.nullif(base, F.lit(0.0)))) * 100,
        "mda": F.avg((F.signum(a - before) == F.signum(p - before)).cast("double")) * 100,
        "r2": 1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0))),
    }


def metrics(df: DataFrame, by: Sequence[str], t: str = "date", actual: str = "actual", predicted: str = "predicted", epsilon: float = EPSILON) -> DataFrame:
    """The seven metrics of each group over its rows that have both values, in one window pass and one aggregate."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    rows = rows.withColumn("__before", F.lag(actual).over(Window.partitionBy(*by).orderBy(t)))
    made = metric_columns(F.col(actual).cast("double"), F.col(predicted).cast("double"), F.col("__before").cast("double"), epsilon)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(m) for m, c in made.items()])


def tall_metrics(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(by), list(METRICS), "metric", "value")


def origins(df: DataFrame, keys: Sequence[str], t: str, train: int | datetime.date | str, horizon: int, step: int = 1) -> DataFrame:
    """(keys, te, h): each origin te = number of rows known, each horizon that the series still holds.

    ``train`` is a number of rows, or a date: the rows up to it. Series no longer than the training size have no origin.
    """
    if horizon < 1 or step < 1:
        raise ValueError("horizon and step must be positive")
    if isinstance(train, int):
        if train < 1:
            raise ValueError("training size must be positive")
        size = F.lit(train)
    else:
        size = F.count_if(F.col(t) <= F.lit(str(train)).cast("date"))
    span = df.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), size.cast("int").alias("T")).where("T >= 1 and T < n")
    each = span.select(*keys, "n", F.explode(F.sequence(F.col("T"), F.col("n") - 1, F.lit(step))).alias("te"))
    return each.select(*keys, "te", F.explode(F.sequence(F.lit(1), F.least(F.lit(horizon), F.col("n") - F.col("te")))).alias("h"))


def backtest(df: DataFrame, keys: Sequence[str], t: str, value: str, train: int | str, horizon: int = 4, step: int = 4, model: str = "naive", season: int = 52, window: str = "expanding") -> DataFrame:
    """(keys, te, h, date, actual, predicted) of a model that is a place in the past: equi-joins on positions, no loop.

    ``naive`` takes the origin's value, ``seasonal_naive`` the one a season before, ``mean`` the mean of the training rows.
    """
    if window not in ("expanding", "sliding"):
        raise ValueError("window must be expanding or sliding")
    numbered = with_position(df.select(*keys, F.col(t).alias("date"), F.col(value).cast("double").alias("v")), keys, "date")
    at = origins(numbered, keys, "date", train, horizon, step)
    points = at.withColumn("i", F.col("te") + F.col("h")).join(numbered.select(*keys, "i", "date", F.col("v").alias("actual")), [*keys, "i"])
    if model == "naive":
        source = F.col("te")
    elif model == "seasonal_naive":
        source = F.col("te") - F.least(F.lit(season), F.col("te")) + 1 + F.pmod(F.col("h") - 1, F.least(F.lit(season), F.col("te")))
    elif model == "mean":
        w = Window.partitionBy(*keys).orderBy("date")
        frame = w.rowsBetween(Window.unboundedPreceding, 0) if window == "expanding" or not isinstance(train, int) else w.rowsBetween(-(train - 1), 0)
        numbered, source = numbered.withColumn("v", F.avg("v").over(frame)), F.col("te")
    else:
        raise ValueError(f"unknown model {model}")
    past = numbered.select(*keys, F.col("i").alias("__from"), F.col("v").alias("predicted"))
    return points.withColumn("__from", source).join(past, [*keys, "__from"], "left").select(*keys, "te", "h", "date", "actual", "predicted")


def refit_origin(te: Column, first: Column, step: int, refit_every: int) -> Column:
    """Origin whose fit serves the one at ``te``; 0 fits once."""
    s = ((te - first) / step).cast("int")
    return first if refit_every == 0 else first + (s - F.pmod(s, F.lit(refit_every))) * step


def by_horizon(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics(rows, [*keys, "h"])


def by_step(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics(rows, [*keys, "te"])


def blended(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One prediction for each date: that of the shortest horizon that has one."""
    return rows.groupBy(*keys, "date").agg(F.first("actual", True).alias("actual"), F.min_by("predicted", F.when(F.col("predicted").isNotNull(), F.col("h"))).alias("predicted"))


def with_mean_baseline(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rows(model, date, actual, predicted)`` with a model that predicts the mean actual."""
    one = rows.select(*by, "date", "actual").distinct()
    mean = F.avg("actual").over(Window.partitionBy(*by)) if by else F.lit(None)
    base = one.withColumn("predicted", mean) if by else one.crossJoin(F.broadcast(one.agg(F.avg("actual").alias("predicted"))))
    return rows.select(*by, "model", "date", "actual", "predicted").unionByName(base.withColumn("model", F.lit("mean_baseline")).select(*by, "model", "date", "actual", "predicted"))


def compared(rows: DataFrame, by: Sequence[str] = (), include_baseline: bool = True) -> DataFrame:
    """Metrics of every model on the same dates."""
    return metrics(with_mean_baseline(rows, by) if include_baseline else rows, [*by, "model"])


def ranked_models(table: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """1..n from the best, nulls last, ties by name; scores that are better when higher are ranked downwards."""
    key = F.desc_nulls_last(metric) if metric in HIGHER_IS_BETTER else F.asc_nulls_last(metric)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return table.withColumn("rank", F.row_number().over(part.orderBy(key, "model")))


def best_models(tall: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(metric, model, value): the best model of each metric; ties by name."""
    sign = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    best = F.min_by(F.struct("model", "value"), F.struct(sign, F.col("model")))
    return tall.where("value is not null").groupBy(*by, "metric").agg(best.alias("b")).select(*by, "metric", "b.model", "b.value")


def degradation(tall: DataFrame, short: int, long: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """How each metric changes from the short to the long horizon."""
    a = tall.where(F.col("h") == short).select(*by, "metric", F.col("value").alias("v_short"))
    b = tall.where(F.col("h") == long).select(*by, "metric", F.col("value").alias("v_long"))
    score = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), change(F.col("v_short"), F.col("v_long"), "r2")).otherwise(change(F.col("v_short"), F.col("v_long"), "mae"))
    return a.join(b, [*by, "metric"]).withColumn("change", score)


def horizon_table(tall: DataFrame, horizons: Sequence[int], metrics: Sequence[str]) -> DataFrame:
    """One row for each model, one column for each horizon and metric, two digits."""
    names = [f"h={h} {m}" for h in horizons for m in metrics]
    named = tall.withColumn("__c", F.concat(F.lit("h="), F.col("h").cast("string"), F.lit(" "), F.col("metric")))
    return named.groupBy("model").pivot("__c", names).agg(F.bround(F.first("value"), 2))


def ensemble(rows: DataFrame, by: Sequence[str], weights: dict[str, float] | None = None, how: str = "average") -> DataFrame:
    """One prediction of several models: weighted average over those that have one, or median."""
    if how == "median":
        return rows.groupBy(*by).agg(F.first("actual", True).alias("actual"), F.median("predicted").alias("predicted"))
    if how != "average":
        raise ValueError(f"unknown ensemble {how}")
    w = F.lit(1.0)
    for m, x in (weights or {}).items():
        w = F.when(F.col("model") == m, F.lit(float(x))).otherwise(w)
    w = F.when(F.col("predicted").isNotNull(), w)
    return rows.groupBy(*by).agg(F.first("actual", True).alias("actual"), F.try_divide(F.sum(w * F.col("predicted")), F.sum(w)).alias("predicted"))


def autocorrelation(df: DataFrame, keys: Sequence[str], t: str, value: str, lags: int = 40) -> DataFrame:
    """(keys, lag, acf, significant) of residuals; significant beyond 1.96 over the root of n. Lags of one window sort."""
    part = Window.partitionBy(*keys)
    d = df.withColumns({"__d": F.col(value) - F.avg(value).over(part)})
    w = part.orderBy(t)
    d = d.withColumns({f"__l{k}": F.lag("__d", k).over(w) for k in range(1, lags + 1)})
    one = d.groupBy(*keys).agg(F.count("__d").alias("n"), *[F.try_divide(F.sum(F.col("__d") * F.col(f"__l{k}")), F.sum(F.col("__d") * F.col("__d"))).alias(f"l{k}") for k in range(1, lags + 1)])
    tall = one.unpivot([*keys, "n"], [f"l{k}" for k in range(1, lags + 1)], "lag", "acf")
    return tall.select(*keys, F.substring("lag", 2, 3).cast("int").alias("lag"), "acf", (F.abs("acf") > 1.96 / F.sqrt("n")).alias("significant"))


def significant_lags(df: DataFrame, keys: Sequence[str], t: str, value: str, lags: int = 40) -> DataFrame:
    """(keys, lag_1, significant_lags): the first autocorrelation, and how many up to ``lags`` or half of the series lie beyond 1.96 over the root of n, lag 0 among them."""
    each = autocorrelation(df, keys, t, value, lags)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    known = each.join(sizes, list(keys)).where(F.col("lag") <= F.floor(F.col("__n") / 2))
    return known.groupBy(*keys).agg(F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("lag_1"), (1 + F.count_if("significant")).alias("significant_lags"))


def metric_grid(rows: DataFrame, test_set: str = "department", t: str = "date") -> DataFrame:
    """The seven metrics of every test set and model, and of every model over all sets (test set null), in one window and one aggregate.

    Directions are compared with the actual before within a set and model, whatever the level.
    """
    known = rows.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull()).withColumn("__before", F.lag("actual").over(Window.partitionBy(test_set, "model").orderBy(t)))
    made = metric_columns(F.col("actual").cast("double"), F.col("predicted").cast("double"), F.col("__before").cast("double"))
    whole = known.groupingSets([[F.col(test_set), F.col("model")], [F.col("model")]], test_set, "model").agg(F.count("*").alias("n"), F.grouping(test_set).alias("__all"), *[c.alias(n) for n, c in made.items()])
    return whole.select(F.when(F.col("__all") == 0, F.col(test_set)).alias(test_set), "model", "n", *METRICS)
