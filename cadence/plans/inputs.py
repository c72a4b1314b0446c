"""What stands in for surveillance data among the driver's tables, as frames and as SQL.

Departments are nations, weeks come from order dates, age groups from order priorities,
hospital stays and deaths from order states, population from customers and the year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..sources.readers import COUNTS

CENSUS_YEARS = (1995, 1998, 2001)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    """One row for each order with its department, region, week and six counts of 0 or 1."""
    o = table(spark, d, "orders").select("o_custkey", F.to_date(F.date_trunc("week", F.col("o_orderdate").cast("timestamp"))).alias("week_start"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("u"), "o_orderstatus")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("department"), F.col("r_name").alias("region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    f, p = (F.col("o_orderstatus") == "F").cast("int"), (F.col("o_orderstatus") == "P").cast("int")
    old = 1 - F.col("u")
    made = dict(zip(COUNTS, (F.col("u"), old, f * F.col("u"), f * old, p * F.col("u"), p * old)))
    return rows.select("department", "region", "week_start", F.year("week_start").alias("year"), F.month("week_start").alias("month"), *[c.cast("double").alias(k) for k, c in made.items()])


def weekly(spark: SparkSession, d: str, key: str = "department") -> DataFrame:
    """(key, week_start, cases)."""
    return raw(spark, d).groupBy(key, "week_start").agg(F.count("*").cast("double").alias("cases"))


def clean(spark: SparkSession, d: str) -> DataFrame:
    """(department, week_start, cases) on a whole 7-day grid, gaps interpolated."""
    k = ["department"]
    return series.interpolated(series.date_grid(weekly(spark, d), k, "week_start"), k, "week_start", "cases")


def population(spark: SparkSession, d: str) -> DataFrame:
    """(department, year, population) of 1995 to 2001."""
    n = table(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("department"))
    people = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001)))).select("department", "year", (F.col("k") * (100 + F.col("year") - 1995)).cast("double").alias("population"))


def census(spark: SparkSession, d: str) -> DataFrame:
    """Wide census: a column for each census year, one of them missing for some departments."""
    n = table(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("department"))
    people = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    cols = [F.when((F.col("n_nationkey") % 5 != 0) | F.lit(y == 1998), F.col("k") * (100 + (y - 1995) ** 2)).cast("double").alias(str(y)) for y in CENSUS_YEARS]
    return people.select("department", *cols)


RAW = """raw AS (
  SELECT n_name AS department, r_name AS region, w AS week_start, CAST(year(w) AS BIGINT) AS year, CAST(month(w) AS BIGINT) AS month, u AS pneumonia_under5, 1 - u AS pneumonia_60plus,
    f * u AS hosp_under5, f * (1 - u) AS hosp_60plus, p * u AS deaths_under5, p * (1 - u) AS deaths_60plus
  FROM (SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE) AS u,
               CAST(o_orderstatus = 'F' AS DOUBLE) AS f, CAST(o_orderstatus = 'P' AS DOUBLE) AS p FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
POP = """people AS (SELECT n_nationkey, n_name AS department, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
pop AS (SELECT department, y AS year, CAST(k * (100 + y - 1995) AS DOUBLE) AS population FROM people, unnest(range(1995, 2002)) AS t(y)),
census AS (SELECT department, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(k * 100 AS DOUBLE) END AS y1995, CAST(k * 109 AS DOUBLE) AS y1998, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(k * 136 AS DOUBLE) END AS y2001 FROM people)"""
CENSUS_LONG = "tall AS (SELECT department, 1995 AS year, y1995 AS population FROM census UNION ALL SELECT department, 1998, y1998 FROM census UNION ALL SELECT department, 2001, y2001 FROM census)"
WEEKLY = "weekly AS (SELECT department, week_start, CAST(count(*) AS DOUBLE) AS cases FROM raw GROUP BY 1, 2)"
BACK = "OVER (PARTITION BY department ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY department ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def filled_sql(source: str, t: str, value: str, both: bool = True) -> str:
    """CTEs that number and interpolate ``source(department, t, value)``; the last is ``filled``."""
    return f"""num AS (SELECT department, {t} AS t, {value} AS x, row_number() OVER (PARTITION BY department ORDER BY {t}) AS i FROM {source}),
near AS (SELECT *, last_value(x IGNORE NULLS) {BACK} AS pv, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) {BACK} AS pi,
  first_value(x IGNORE NULLS) {AHEAD} AS nv, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) {AHEAD} AS ni FROM num),
filled AS (SELECT department, t, i, x, coalesce(x, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv{', nv' if both else ''}) AS v FROM near)"""


GRID = """grid AS (SELECT department, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM (SELECT department, min(week_start) AS lo, max(week_start) AS hi FROM weekly GROUP BY 1)),
gridded AS (SELECT g.department, g.week_start, w.cases FROM grid g LEFT JOIN weekly w USING (department, week_start))"""
CLEAN = ",\n".join([RAW, WEEKLY, GRID, filled_sql("gridded", "week_start", "cases"), "clean AS (SELECT department, t AS week_start, i, v AS cases FROM filled)"])
ANNUAL = ",\n".join([RAW, POP, "annual AS (SELECT department, year, " + ", ".join(f"sum({c}) AS {c}" for c in COUNTS) + " FROM raw GROUP BY 1, 2)"])


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
