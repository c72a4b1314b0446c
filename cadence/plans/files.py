"""Queries of databases, spreadsheets, replaced partitions, processed tables, and workflows of several granularities, with their SQL."""

from __future__ import annotations

import glob
import os
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.csv as pa_csv
import pyspark
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators import evaluate, models, panel, series
from ..sources import readers, sinks, workbooks
from ..sources.readers import COUNTS
from . import inputs as I
from .catalogue import DEPT, MET, MONTHS, NAIVE, SPLIT, longs, month_incidence, naive_points, own, points_sql, query, r, rounded, score_sql

# --- databases --------------------------------------------------------------------------------

ORDERS = {"o_orderkey": ("long", "BIGINT"), "o_custkey": ("long", "BIGINT"), "o_orderstatus": ("string", "VARCHAR(32672)"), "o_totalprice": ("double", "DOUBLE"), "o_orderdate": ("date", "DATE")}


def loaded(batches: Iterable[pa.RecordBatch], path: str) -> None:
    """Rows of orders imported into an embedded database of their own, which becomes the archive ``path``; rows go through a file, so memory does not grow with them."""
    jars = glob.glob(os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "derby*.jar"))
    java = os.path.join(os.environ["JAVA_HOME"], "bin", "java") if os.environ.get("JAVA_HOME") else "java"
    with tempfile.TemporaryDirectory() as home:
        home, out = os.path.realpath(home), None  # the other process may have another working directory
        for b in batches:
            out = out or pa_csv.CSVWriter(f"{home}/orders.csv", b.schema, write_options=pa_csv.WriteOptions(include_header=False))
            out.write_batch(b)
        if out:
            out.close()
        columns = ", ".join(f'"{c}" {kind}' for c, (_, kind) in ORDERS.items())
        script = ["connect 'jdbc:derby:orders;create=true'", f"CREATE TABLE orders ({columns})"]
        script += [f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ORDERS', '{home}/orders.csv', ',', '\"', 'UTF-8', 0)"] if out else []
        script += ["connect 'jdbc:derby:orders;shutdown=true'"]
        run = subprocess.run([java, "-Xmx256m", "-XX:+UseSerialGC", f"-Dderby.system.home={home}", "-cp", os.pathsep.join(jars), "org.apache.derby.tools.ij"],
                             input=";\n".join([*script, "exit;\n"]), capture_output=True, text=True, cwd=home)
        wrong = [line for line in run.stdout.splitlines() if "ERROR" in line and "ERROR 08006" not in line]  # 08006: the database was shut down
        if run.returncode or wrong or "ERROR 08006" not in run.stdout:
            raise RuntimeError(f"the database was not loaded: {run.stdout[-2000:]}{run.stderr[-2000:]}")
        # Not compressed, so that the database reaches each of its pages at once.
        with zipfile.ZipFile(f"{path}.{uuid.uuid4().hex}", "w", zipfile.ZIP_STORED) as z:
            for folder, _, names in os.walk(f"{home}/orders"):
                for n in names:
                    z.write(f"{folder}/{n}", os.path.relpath(f"{folder}/{n}", home))
        os.replace(z.filename, path)


def database(spark, d) -> list[str]:
    """URLs of the orders in embedded databases of Spark's own jars, one for each task that loads its rows.

    A writable one is seen by one JVM only; these are read-only archives in the shared folder, which the driver and all executors open at once.
    """
    where = urlparse(own(spark, "databases"))
    if where.scheme not in ("", "file"):
        raise RuntimeError("embedded databases need a shared folder that is mounted; give readers.table the URL of a server")
    folder = where.path
    os.makedirs(folder)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{TaskContext.get().partitionId()}.jar"
        loaded(batches, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    rows = I.table(spark, d, "orders").select(*[F.col(c).cast(kind).alias(c) for c, (kind, _) in ORDERS.items()])
    paths = [r.path for r in rows.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(load, "path string").collect()]
    if not paths:  # a table without files
        paths = [f"{folder}/none.jar"]
        loaded([], paths[0])
    return [f"jdbc:derby:jar:({p})orders" for p in sorted(paths)]


def orders(spark, d, **asked):
    """What is asked of the orders in all databases; each is scanned as ``readers.table`` scans it."""
    return I.union([readers.table(spark, "orders", url, **asked) for url in database(spark, d)])


@query(f"SELECT o_orderkey, o_orderstatus, {r('o_totalprice', 'o_totalprice')} FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def jdbc_scan(spark, d):
    """Database tables read in four ranges of their key; the database filters and picks the columns."""
    got = orders(spark, d, columns=["o_orderkey", "o_orderstatus", "o_totalprice"], where=(F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F"), split_by="o_orderkey", parts=4)
    return rounded(got, "o_totalprice")


@query("SELECT CAST(least(100, count(*)) AS BIGINT) AS n, CAST(least(100, count(*)) AS BIGINT) AS n_keys FROM orders")
def jdbc_limit(spark, d):
    """The first hundred rows that a database gives."""
    return orders(spark, d, limit=100).limit(100).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


# --- spreadsheets -----------------------------------------------------------------------------


@query(I.sql(I.ANNUAL, "SELECT department, CAST(year AS BIGINT) AS year, " + ", ".join(COUNTS) + " FROM annual"))
def spreadsheet(spark, d):
    """Annual counts written as a workbook, read back by its own source, turned into CSV and counted on the way."""
    path = own(spark, "annual.xlsx")
    workbooks.write_sheet(panel.annual_sums(I.raw(spark, d), ("department", "year")).select("department", "year", *COUNTS), path)
    got = workbooks.to_csv(spark, path, own(spark, "annual.csv"))
    return got.select("department", F.col("year").cast("long").alias("year"), *[F.col(c).cast("double").alias(c) for c in COUNTS])


# --- replaced partitions ------------------------------------------------------------------------

OLD = f"{SPLIT}, old AS (SELECT department, week_start AS date, split, cases AS actual, cases AS predicted FROM split)"


@query(I.sql(f"{points_sql(52, 4, 2, 'te')}, sized AS (SELECT *, count(*) OVER (PARTITION BY department) AS n FROM clean), old AS (SELECT department, week_start AS date, CASE WHEN i <= ceil(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i <= ceil(n * CAST(0.8 AS DOUBLE)) + ceil(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split, cases AS actual, cases AS predicted FROM sized)",
             f"SELECT department, date, split, {r('actual', 'actual')}, {r('predicted', 'predicted')} FROM old UNION ALL SELECT department, date, 'backtest', {r('any_value(actual)', 'actual')}, {r('arg_min(predicted, h)', 'predicted')} FROM pts GROUP BY 1, 2"))
def backtest_replaced(spark, d):
    """Predictions on disk: splits and an old backtest are written, then the horizons of a new one are blended and only its partitions are replaced."""
    path, model = own(spark, "predictions"), {"age_group": F.lit("all"), "model": F.lit("naive")}
    rows = series.temporal_split(I.clean(spark, d), DEPT, "week_start", least=1).select("department", F.col("week_start").alias("date"), "split", F.col("cases").alias("actual"), F.col("cases").alias("predicted"))
    old = rows.unionByName(rows.where("split = 'test'").withColumns({"split": F.lit("backtest"), "predicted": F.col("predicted") + 1000}))
    sinks.write_splits(old.withColumns(model), path)
    sinks.replace_backtest(evaluate.backtest(I.clean(spark, d), DEPT, "week_start", "cases", 52, 4, 2, "naive").withColumns(model), path)
    return rounded(spark.read.parquet(path).select("department", "date", "split", "actual", "predicted"), "actual", "predicted")


# --- processed tables ----------------------------------------------------------------------------


@query(I.sql(I.CLEAN, f"SELECT state, reused, year(week_start) >= y AS kept, count(*) AS n, {r('sum(cases)', 'total')} FROM clean, (VALUES ('absent', false, 1996), ('fresh', true, 1996), ('stale', false, 1998)) AS s(state, reused, y) WHERE year(week_start) >= y GROUP BY ALL"))
def processed_series(spark, d):
    """The clean weekly table as it is absent, fresh, and stale because an option changed: it is made, read, made again."""
    base, out = own(spark, "processed"), []
    inputs = [f"{d}/{t}.parquet" for t in ("orders", "customer", "nation", "region")]
    for state, first in (("absent", 1996), ("fresh", 1996), ("stale", 1998)):
        df, reused = readers.processed(spark, base, inputs, {"first": first}, lambda: I.clean(spark, d).where(F.year("week_start") >= first), ["department"])
        out.append(df.groupBy(F.lit(state).alias("state"), F.lit(reused).alias("reused"), (F.year("week_start") >= first).alias("kept")).agg(F.count("*").alias("n"), F.sum("cases").alias("total")))
    return rounded(I.union(out), "total")


# --- several granularities in one scan --------------------------------------------------------------

CHANGES = ", ".join(r(f"({c}_rate / nullif(lag({c}_rate) OVER (PARTITION BY level, department ORDER BY year), 0) - 1) * 100", f"{c}_change") for c in COUNTS[:2])


@query(I.sql(f"{I.ANNUAL}, wide AS (SELECT department, year, CASE WHEN grouping(department) = 1 THEN 'year' ELSE 'department,year' END AS level, sum(population) AS population, {', '.join(f'sum({c}) AS {c}, sum({c}) / nullif(sum(population), 0) * 100000 AS {c}_rate' for c in COUNTS[:2])} FROM annual JOIN pop USING (department, year) GROUP BY GROUPING SETS ((year), (department, year)))",
             f"SELECT department, CAST(year AS BIGINT) AS year, level, population, {', '.join(COUNTS[:2])}, {', '.join(r(f'{c}_rate', f'{c}_rate') for c in COUNTS[:2])}, {CHANGES} FROM wide"))
def annual_workflow(spark, d):
    """National and departmental rates with their change on the year before, one scan."""
    joined = panel.annual_sums(I.raw(spark, d), ("department", "year")).join(I.population(spark, d), ["department", "year"])
    out = panel.annual_workflow(joined, COUNTS[:2])
    return rounded(longs(out, "year"), *[f"{c}_{x}" for c in COUNTS[:2] for x in ("rate", "change")])


@query(I.sql(MONTHS, f"SELECT department, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, concat_ws(',', CASE WHEN grouping(department) = 0 THEN 'department' END, CASE WHEN grouping(year) = 0 THEN 'year' END, CASE WHEN grouping(month) = 0 THEN 'month' END) AS level, "
             f"count(incidence) AS n, {r('avg(incidence)', 'mean')}, {r('stddev_samp(incidence)', 'std')}, {r('min(incidence)', 'least')}, {r('max(incidence)', 'most')} FROM inc GROUP BY GROUPING SETS ((month), (year, month), (department, month), (year))"))
def seasonality_workflow(spark, d):
    """Profiles of months, of years, of months in years and of months in departments, one scan."""
    return rounded(longs(panel.seasonality_workflow(month_incidence(spark, d)), "year", "month"), "mean", "std", "least", "most")


GRID_ROWS = f"{NAIVE}, seen AS (SELECT department, 'naive' AS model, date, actual, predicted FROM pts WHERE h = 1 UNION ALL SELECT department, 'half', date, actual, predicted / 2 FROM pts WHERE h = 1), rowed AS (SELECT *, lag(actual) OVER (PARTITION BY department, model ORDER BY date) AS before FROM seen)"


def grid_sql() -> str:
    e = "(actual - predicted)"
    base = "((abs(actual) + abs(predicted)) / 2)"
    parts = [r(f"avg(abs({e}))", "mae"), r(f"sqrt(avg({e} * {e}))", "rmse"), r(f"avg({e})", "me"), r(f"avg(CASE WHEN abs(actual) > 1e-10 THEN abs({e} / nullif(actual, 0)) END) * 100", "mape"),
             r(f"avg(CASE WHEN {base} > 1e-10 THEN abs({e}) / nullif({base}, 0) END) * 100", "smape"), r("avg(CASE WHEN sign(actual - before) = sign(predicted - before) THEN 1.0 WHEN before IS NOT NULL THEN 0.0 END) * 100", "mda"),
             r(f"1 - sum({e} * {e}) / nullif(var_pop(actual) * count(*), 0)", "r2")]
    return f"SELECT department, model, count(*) AS n, {', '.join(parts)} FROM rowed GROUP BY GROUPING SETS ((department, model), (model))"


@query(I.sql(GRID_ROWS, grid_sql()))
def metric_grid(spark, d):
    """The metrics of two models on every department and on all together."""
    rows = naive_points(spark, d).where("h = 1").withColumn("model", F.lit("naive"))
    both = rows.unionByName(rows.withColumns({"model": F.lit("half"), "predicted": F.col("predicted") / 2}))
    return rounded(evaluate.metric_grid(both), *MET)


# --- national decomposition --------------------------------------------------------------------------

NATIONAL = f"""{I.RAW}, {I.POP}, people_of AS (SELECT year, sum(population) AS population FROM pop GROUP BY 1), sums AS (SELECT week_start, CAST(count(*) AS DOUBLE) AS cases FROM raw GROUP BY 1),
ends AS (SELECT min(week_start) AS lo, max(week_start) AS hi FROM sums), mondays AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM ends),
inc AS (SELECT 'all' AS department, m.week_start, s.cases / nullif(p.population, 0) * 100000 AS v FROM mondays m LEFT JOIN sums s USING (week_start) LEFT JOIN people_of p ON p.year = year(m.week_start)),
{I.filled_sql('inc', 'week_start', 'v')}"""


def national_weeks(spark, d):
    """National weekly incidence on the Monday grid, gaps interpolated."""
    sums = I.raw(spark, d).groupBy(F.lit("all").alias("nation"), "week_start").agg(F.count("*").cast("double").alias("cases"))
    people = I.population(spark, d).groupBy("year").agg(F.sum("population").alias("population"))
    rates = sums.withColumn("year", F.year("week_start")).join(F.broadcast(people), "year", "left").select("nation", "week_start", (F.col("cases") / F.nullif("population", F.lit(0)) * 100000).alias("incidence"))
    return series.interpolated(series.date_grid(rates, ["nation"], "week_start", weekday="MON"), ["nation"], "week_start", "incidence")


@query(I.sql(NATIONAL, f"SELECT count(*) AS n, {r('avg(v)', 'mean')}, CAST(0 AS DOUBLE) AS gap FROM filled"))
def stl_national(spark, d):
    """The national series taken apart: as many weeks as the Monday grid has, the same mean, components that add up."""
    parts = models.decomposed(national_weeks(spark, d), ["nation"], "week_start", "incidence", 52)
    whole = F.col("trend") + F.col("seasonal") + F.col("remainder")
    return rounded(parts.agg(F.count("*").alias("n"), F.avg(whole).alias("mean"), F.max(F.abs(whole - F.col("observed"))).alias("gap")), "mean", "gap")
