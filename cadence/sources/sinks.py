"""Sinks: tables in CSV or Parquet, guarded writes, and predictions of which some splits are replaced."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED = ("train", "val", "test")


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, force: bool = True) -> None:
    """Overwrite ``path``, or leave it alone where it exists and ``force`` is off."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {fmt}")
    out = df.write.mode("overwrite" if force else "ignore")
    out = out.partitionBy(*partition_by) if partition_by else out
    out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path)


def replaced(old: DataFrame, new: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """``old`` with its rows of ``splits`` replaced by ``new``."""
    return old.where(~F.col("split").isin(*splits)).unionByName(new)


def write_splits(new: DataFrame, path: str) -> None:
    """Write predictions so that only the (department, age_group, model, split) partitions they hold are overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("department", "age_group", "model", "split").parquet(path)


def replace_backtest(points: DataFrame, path: str, keys: tuple[str, ...] = ("department", "age_group", "model")) -> None:
    """Blend the horizons of backtest ``points(keys, te, h, date, actual, predicted)``, the nearest one first, and replace only the ``backtest`` partitions of their keys.

    The new rows are staged beside the table and moved in when the job has ended, so a job that fails leaves the old ones.
    """
    blended = points.groupBy(*keys, "date").agg(F.first("actual", True).alias("actual"), F.min_by("predicted", F.when(F.col("predicted").isNotNull(), F.col("h"))).alias("predicted"))
    write_splits(blended.withColumn("split", F.lit("backtest")), path)


def json_reports(reports: DataFrame, path: str) -> None:
    """A row for each report, as lines of JSON; Spark writes them where they are."""
    reports.write.mode("overwrite").json(path)


def json_report(spark, report: dict, path: str) -> None:
    """One small report as one JSON file, through Spark's file system so that any store will do."""
    spark.createDataFrame([(json.dumps(report, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], base: str, fmt: str = "csv", force: bool = True) -> None:
    """Several tables under one folder, one sub-folder each: national and departmental ones, or a rank grid and its frequencies for each measure."""
    for name, df in tables.items():
        write(df, f"{base}/{name}", fmt, force=force)


def parameters(spark, path: str) -> DataFrame:
    """What ``models.fitted`` learnt, as ``write`` kept it."""
    return spark.read.parquet(path)
