"""Outliers: global fences, severities, residuals of a model of each key, and their agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

FENCE, SIGMAS, LEAST = 1.5, 2.5, 10


def fences(df: DataFrame, value: str, by: Sequence[str] = (), k: float = FENCE) -> DataFrame:
    """Lower and upper bound of each group from its exact quartiles, linearly interpolated."""
    q = quantiles(df, value, {"q1": 0.25, "q3": 0.75}, by)
    return q.withColumns({"lower": F.col("q1") - k * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + k * (F.col("q3") - F.col("q1"))})


def beyond_fences(df: DataFrame, value: str, by: Sequence[str] = (), k: float = FENCE) -> DataFrame:
    """Rows strictly beyond the fences of their group, with the bounds."""
    bounds = fences(df, value, by, k)
    joined = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))  # one row
    return joined.where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def severity(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distance from the group's mean in sample deviations; null where those are 0."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    joined = df.join(s, list(by)) if by else df.crossJoin(F.broadcast(s))  # one row
    return joined.withColumn("severity", F.try_divide(F.abs(F.col(value) - F.col("__m")), F.nullif(F.col("__s"), F.lit(0.0)))).drop("__m", "__s")


def extreme_residuals(res: DataFrame, keys: Sequence[str], residual: str = "residual", sigmas: float = SIGMAS) -> DataFrame:
    """Rows whose residual exceeds ``sigmas`` sample deviations of its key's residuals; nulls are left out."""
    known = res.where(F.col(residual).isNotNull())
    s = known.groupBy(*keys).agg(F.stddev_samp(residual).alias("__s"))
    return known.join(s, list(keys)).where(F.abs(residual) > sigmas * F.col("__s")).drop("__s")


def classified(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str, str] = ("confirmed", "iqr_only", "arima_only")) -> DataFrame:
    """Keys of either set with the class of where they are."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = left.join(right, list(keys), "full_outer")
    name = F.when(F.col("__a") & F.col("__b"), names[0]).when(F.col("__a"), names[1]).otherwise(names[2])
    return both.withColumn("class", name).drop("__a", "__b")


def summary(found: DataFrame) -> DataFrame:
    """(measure, n, mean_severity, worst) of what ``report`` found."""
    return found.groupBy("measure").agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), F.max("severity").alias("worst"))


def common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def only(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def report(df: DataFrame, keys: Sequence[str], columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Outliers of several columns in one plan: (keys, measure, value, severity), the worst first; ``top`` of each measure."""
    from pyspark.sql import Window

    tall = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "measure", "value")
    found = severity(tall, "value", ["measure"]).join(beyond_fences(tall, "value", ["measure"]).select(*keys, "measure"), [*keys, "measure"], "left_semi")
    if top is None:
        return found
    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("severity"), *keys))
    return found.withColumn("place", place).where(F.col("place") <= top)
