"""Train, validate and test a model of every key at once: one plan for all series, failures as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, models, series


def held_out(df: DataFrame, keys: Sequence[str], t: str, value: str, model: str = "sarima", **split) -> DataFrame:
    """(keys, date, split, model, actual, predicted, lower, upper, status, error) of the validation and test rows.

    Validation rows are forecast from the training rows, test rows from both; nothing after an origin is read.
    """
    f, options = models.model_of(model)
    rows = series.temporal_split(df.select(*keys, F.col(t).alias("date"), F.col(value).cast("double").alias("actual")), keys, "date", **split)
    counts = rows.groupBy(*keys).pivot("split", ["val", "test"]).count().agg(F.max("val").alias("val"), F.max("test").alias("test")).first()
    out = []
    for part, known, horizon in (("val", ("train",), counts.val), ("test", ("train", "val"), counts.test)):
        if not horizon:
            continue
        ahead = models.grouped_forecast(rows.where(F.col("split").isin(*known)), keys, "date", "actual", f, int(horizon), **options)
        actual = rows.where(F.col("split") == part).withColumn("h", F.row_number().over(series.by_time(keys, "date"))).select(*keys, "h", "date", "split", "actual")
        failed = ahead.where("status = 'failed'").select(*keys, "status", "error")
        good = actual.join(ahead.where("status = 'success'").drop("date"), [*keys, "h"])
        bad = actual.join(failed, list(keys)).withColumns({c: F.lit(None).cast("double") for c in ("predicted", "lower", "upper")})
        out.append(good.unionByName(bad).drop("h"))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return both.withColumn("model", F.lit(model))


def scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of each key, split and model, the mean baseline beside them."""
    return evaluate.compared(rows, [*keys, "split"])


def report(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, split, best, rmse, text): the best model by RMSE as one line for each key and split."""
    best = evaluate.ranked_models(scores(rows, keys), "rmse", [*keys, "split"]).where("rank = 1")
    text = F.format_string("%s: best of %s rows is %s, RMSE %.3f, MAE %.3f", F.col("split"), F.col("n").cast("string"), F.col("model"), F.col("rmse"), F.col("mae"))
    return best.select(*keys, "split", F.col("model").alias("best"), "rmse", text.alias("text"))


def long_predictions(df: DataFrame, rows: DataFrame, keys: Sequence[str], t: str, value: str, **split) -> DataFrame:
    """Training actuals and held-out predictions in one tall frame, as the sinks write them."""
    train = series.temporal_split(df, keys, t, **split).where("split = 'train'")
    first = train.select(*keys, F.col(t).alias("date"), "split", F.lit("actual").alias("model"), F.col(value).cast("double").alias("actual"), F.lit(None).cast("double").alias("predicted"))
    return first.unionByName(rows.select(*first.columns))
