"""Scans: files and JDBC tables with the clean-up each kind of input needs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import day, number, padded, stripped
from .sinks import write

COUNTS = ("pneumonia_under5", "pneumonia_60plus", "hosp_under5", "hosp_60plus", "deaths_under5", "deaths_60plus")
AGE_COLUMN = {"under5": "pneumonia_under5", "60plus": "pneumonia_60plus"}
PREDICTIONS = "date date, split string, model string, actual double, predicted double, department string, age_group string"


def normalized(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return found is not None and len(found) > 0


def csv(spark: SparkSession, path: str, columns: Sequence[str] = (), schema: str | None = None) -> DataFrame:
    """A CSV with a header, every column a string unless ``schema`` says otherwise; ``columns`` must be there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return required(normalized(reader.schema(schema).csv(path) if schema else reader.csv(path)), columns)


def table(spark: SparkSession, name: str, url: str, limit: int | None = None, columns: Sequence[str] = (), where: Column | None = None, split_by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table over JDBC; columns, the filter and the limit are left to the database.

    ``split_by``, a number or date column, deals the scan into ``parts`` ranges between its least and its greatest value, which the database tells; rows without one are in the first.
    """
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    if split_by is not None:
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(split_by)
        lo, hi = source(query=f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {name}").load().first()
        if lo is not None:
            options = options | {"partitionColumn": split_by, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(parts)}
    df = source(dbtable=name).load()
    df = df if where is None else df.where(where)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def census(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ["iddpto", "department"])


def population(spark: SparkSession, path: str) -> DataFrame:
    """Annual population with a zero-padded id; rows without population are dropped."""
    df = csv(spark, path, ["iddpto", "year", "population"])
    return df.withColumns({"iddpto": padded(F.col("iddpto")), "year": F.col("year").try_cast("int"), "population": number(F.col("population"))}).na.drop(subset=["population"])


def annual_cases(spark: SparkSession, path: str) -> DataFrame:
    """Surveillance rows for annual sums: ``ano`` becomes ``year``, ids are padded, rows without a year are dropped."""
    return surveillance(csv(spark, path))


def surveillance(df: DataFrame) -> DataFrame:
    if "ano" in df.columns and "year" not in df.columns:
        df = df.withColumnRenamed("ano", "year")
    required(df, ["year", "iddpto", *COUNTS])
    return df.withColumns({"year": number(F.col("year")).cast("long"), "iddpto": padded(F.col("iddpto"))} | {c: number(F.col(c), 0) for c in COUNTS}).na.drop(subset=["year"])


def measures(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Annual measures: names trimmed, the given columns as numbers with 0 for what cannot be read."""
    df = csv(spark, path, ["department", "year", *columns])
    return df.withColumns({"department": stripped(F.col("department")), "year": number(F.col("year")).cast("int")} | {c: number(F.col(c), 0) for c in columns})


def weekly(df: DataFrame, counts: Sequence[str] = COUNTS) -> DataFrame:
    """Weekly rows cleaned: department upper-cased, counts as numbers, bad dates dropped, year and month from the week's start."""
    required(df, ["department", "week_start", *counts])
    out = df.withColumns({"department": F.upper(stripped(F.col("department"))), "week_start": day(F.col("week_start"))} | {c: number(F.col(c), 0) for c in counts})
    return out.na.drop(subset=["week_start"]).withColumns({"year": F.year("week_start"), "month": F.month("week_start"), "week_of_year": F.weekofyear("week_start")})


def weekly_cases(df: DataFrame, age_group: str, department: str | None = None) -> DataFrame:
    """The case counts of one age group, optionally of one department."""
    if age_group not in AGE_COLUMN:
        raise ValueError(f"age group must be one of {', '.join(AGE_COLUMN)}")
    out = weekly(df, [AGE_COLUMN[age_group]]).withColumnRenamed(AGE_COLUMN[age_group], "cases")
    return out if department is None else out.where(F.col("department") == department.strip().upper())


def department_series(clean: DataFrame, department: str, age_group: str, start_year: int | None = None) -> DataFrame:
    """One series of the clean weekly table; with a table partitioned by key only its files are read."""
    out = clean.where((F.col("department") == department.strip().upper()) & (F.col("age_group") == age_group))
    return out if start_year is None else out.where(F.year("week_start") >= start_year)


def predictions(spark: SparkSession, pattern: str, department: str | None = None, age_group: str | None = None) -> DataFrame:
    """Predictions of many files, each row once."""
    df = spark.read.option("header", True).schema(PREDICTIONS).csv(pattern).dropDuplicates()
    for c, v in (("department", department), ("age_group", age_group)):
        df = df if v is None else df.where(F.col(c) == v)
    return df


METRIC = T.StructType([T.StructField(m, T.DoubleType()) for m in ("mae", "rmse", "me", "mape", "smape", "mda", "r2")])


def horizon_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """(department, age_group, model, h, metric, value) of rolling-origin reports, one JSON object on a line."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("department", "age_group", "model")] + [T.StructField("metrics_by_horizon", T.MapType(T.StringType(), METRIC))])
    df = spark.read.option("encoding", "UTF-8").schema(schema).json(pattern)
    wide = df.select("department", "age_group", "model", F.explode("metrics_by_horizon").alias("h", "m")).select("department", "age_group", "model", F.col("h").try_cast("int").alias("h"), "m.*")
    return wide.unpivot(["department", "age_group", "model", "h"], METRIC.names, "metric", "value")


def top_names(ranking: DataFrame, n: int = 3, order: Column | None = None) -> DataFrame:
    """The first ``n`` names of a ranking: its first column that names a department or region, ties by name."""
    name = next((c for c in ranking.columns if "depart" in c.lower() or "region" in c.lower()), None)
    if name is None:
        raise ValueError("no department or region column")
    keys = [F.col(name)] if order is None else [order, F.col(name)]
    return ranking.orderBy(*keys).select(F.col(name).alias("department")).limit(n)


def fingerprint(spark: SparkSession, paths: Sequence[str], options: dict) -> str:
    """A digest of the files under ``paths`` (names, sizes, times of change) and of options: another one means that what was made of them is stale."""
    seen = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(where):
            raise FileNotFoundError(path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(seen), options], sort_keys=True, default=str).encode()).hexdigest()[:32]


def processed(spark: SparkSession, base: str, inputs: Sequence[str], options: dict, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> tuple[DataFrame, bool]:
    """The table made of ``inputs`` by ``options``, and whether it was there already.

    It is kept under ``base`` by the fingerprint of its inputs, so it is made anew only where they or the options have changed; a job that failed leaves no success mark and is repeated.
    """
    path = f"{base}/{fingerprint(spark, inputs, options)}"
    there = exists(spark, f"{path}/_SUCCESS")
    if not there:
        write(make(), path, partition_by=partition_by)
    return spark.read.parquet(path), there
