"""The library's own queries over the driver's tables, with their SQL."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rate, tidy
from ..functions.scratch import shared_dir
from ..operators import evaluate, models, outliers, panel, series, training, trees
from ..sources import readers, sinks
from ..sources.readers import COUNTS
from ..streaming.weekly import weekly_counts
from . import inputs as I

DEPT = ["department"]
MET = ("mae", "rmse", "me", "mape", "smape", "mda", "r2")
AGES = {"under5": "pneumonia_under5", "60plus": "pneumonia_60plus"}
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the function's name, with its SQL if it has one."""
    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: tidy(F.col(n)) for n in names})


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def per(count: str, population: str = "population") -> str:
    return f"({count}) / nullif({population}, 0) * 100000"


# --- sums, rates, profiles -------------------------------------------------------------

@query(I.sql(I.RAW, "SELECT department, week_start, " + ", ".join(f"sum({c}) AS {c}" for c in COUNTS) + " FROM raw GROUP BY 1, 2"))
def weekly_cases(spark, d):
    return panel.annual_sums(I.raw(spark, d), ("department", "week_start"))


@query(I.sql(I.RAW, "SELECT department, week_start, 'under5' AS age_group, sum(pneumonia_under5) AS cases FROM raw GROUP BY 1, 2 UNION ALL SELECT department, week_start, '60plus', sum(pneumonia_60plus) FROM raw GROUP BY 1, 2"))
def weekly_long_groups(spark, d):
    return panel.age_groups_long(panel.annual_sums(I.raw(spark, d), ("department", "week_start")), ["department", "week_start"], AGES)


@query(I.sql(I.ANNUAL, "SELECT * FROM annual"))
def annual_counts(spark, d):
    return longs(panel.annual_sums(I.raw(spark, d), ("department", "year")), "year")


@query(I.sql(I.ANNUAL, "SELECT a.*, population, " + ", ".join(f"round_even({per(c)}, 2) AS {c}_rate" for c in COUNTS) + " FROM annual a JOIN pop USING (department, year)"))
def annual_rates(spark, d):
    return longs(panel.annual_rates(panel.annual_sums(I.raw(spark, d), ("department", "year")), I.population(spark, d), ("department", "year")), "year")


@query(I.sql(I.ANNUAL, "SELECT year, sum(population) AS population, " + ", ".join(f"sum({c}) AS {c}, {r(per(f'sum({c})', 'sum(population)'), c + '_rate')}" for c in COUNTS) + " FROM annual JOIN pop USING (department, year) GROUP BY year"))
def national_rates(spark, d):
    joined = panel.annual_sums(I.raw(spark, d), ("department", "year")).join(I.population(spark, d), ["department", "year"])
    return rounded(longs(panel.national_rates(joined, COUNTS), "year"), *[f"{c}_rate" for c in COUNTS])


@query(I.sql(I.ANNUAL, "SELECT department, year, " + ", ".join(r(per(c), f"{c}_rate") for c in COUNTS) + " FROM annual JOIN pop USING (department, year)"))
def department_rates(spark, d):
    joined = panel.annual_sums(I.raw(spark, d), ("department", "year")).join(I.population(spark, d), ["department", "year"])
    return rounded(longs(panel.with_rates(joined, COUNTS).select("department", "year", *[f"{c}_rate" for c in COUNTS]), "year"), *[f"{c}_rate" for c in COUNTS])


MONTHS = ",\n".join([I.RAW, I.POP, "monthly AS (SELECT department, year, month, CAST(count(*) AS DOUBLE) AS cases FROM raw GROUP BY 1, 2, 3)",
                     "inc AS (SELECT department, year, month, cases, population, cases / nullif(population, 0) * 100000 AS incidence FROM monthly JOIN pop USING (department, year))"])


def month_rows(spark, d) -> DataFrame:
    return I.raw(spark, d).groupBy("department", "year", "month").agg(F.count("*").cast("double").alias("cases"))


def month_incidence(spark, d) -> DataFrame:
    return panel.monthly(month_rows(spark, d), I.population(spark, d), DEPT)


@query(I.sql(MONTHS, f"SELECT year, month, cases, population, {r(per('cases'), 'incidence')} FROM (SELECT year, month, sum(cases) AS cases FROM monthly GROUP BY 1, 2) JOIN (SELECT year, sum(population) AS population FROM pop GROUP BY 1) USING (year)"))
def monthly_national(spark, d):
    return rounded(longs(panel.monthly(month_rows(spark, d), I.population(spark, d)), "year", "month"), "incidence")


@query(I.sql(MONTHS, f"SELECT department, year, month, cases, population, {r('incidence', 'incidence')} FROM inc"))
def monthly_department(spark, d):
    return rounded(longs(month_incidence(spark, d), "year", "month"), "incidence")


@query(I.sql(MONTHS, f"SELECT month, {r('avg(incidence)', 'mean')}, {r('median(incidence)', 'median')}, {r('stddev_samp(incidence)', 'std')}, {r('min(incidence)', 'min')}, {r('max(incidence)', 'max')} FROM inc GROUP BY month"))
def month_profile(spark, d):
    return rounded(longs(panel.month_profile(month_incidence(spark, d), digits=9), "month"), "mean", "median", "std", "min", "max")


@query(I.sql(MONTHS, f"SELECT month, {r('quantile_cont(incidence, 0.25)', 'q1')}, {r('quantile_cont(incidence, 0.5)', 'median')}, {r('quantile_cont(incidence, 0.75)', 'q3')} FROM inc GROUP BY month"))
def month_quartiles(spark, d):
    return rounded(longs(panel.month_quartiles(month_incidence(spark, d)), "month"), "q1", "median", "q3")


@query(I.sql(MONTHS, f"SELECT department, year, {r('avg(incidence)', 'incidence')} FROM inc GROUP BY 1, 2"))
def annual_trend(spark, d):
    return rounded(longs(panel.mean_by(month_incidence(spark, d), ["department", "year"]), "year"), "incidence")


@query(I.sql(f"{I.RAW}, {I.POP}, {I.WEEKLY}", f"SELECT department, week_start, year, cases, population, {r(per('cases'), 'incidence')} FROM (SELECT *, CAST(year(week_start) AS BIGINT) AS year FROM weekly) JOIN pop USING (department, year)"))
def weekly_incidence(spark, d):
    w = I.weekly(spark, d).withColumn("year", F.year("week_start"))
    return rounded(longs(panel.incidence(w, I.population(spark, d), ["department", "year"]), "year"), "incidence").select("department", "week_start", "year", "cases", "population", "incidence")


@query(I.sql(f"{I.RAW}, {I.WEEKLY}", "SELECT week_start, sum(cases) AS cases, CAST(min(year(week_start)) AS BIGINT) AS year FROM weekly GROUP BY 1"))
def weekly_national(spark, d):
    return longs(I.weekly(spark, d).groupBy("week_start").agg(F.sum("cases").alias("cases"), F.min(F.year("week_start")).alias("year")), "year")


@query(I.sql(f"{I.RAW}, {I.WEEKLY}", "SELECT department, count(DISTINCT week_start) AS weeks FROM weekly GROUP BY 1 HAVING count(DISTINCT week_start) >= 104"))
def available_keys(spark, d):
    return panel.available_keys(I.weekly(spark, d))


@query(I.sql(I.ANNUAL, "SELECT count(*) AS n_rows, count(DISTINCT department) AS n_keys, CAST(min(year) AS BIGINT) AS first_year, CAST(max(year) AS BIGINT) AS last_year, CAST(count(*) FILTER (population IS NULL) AS BIGINT) AS n_null, CAST(count(*) FILTER (population <= 0) AS BIGINT) AS n_not_positive, min(population) AS least, max(population) AS most FROM pop"))
def quality_report(spark, d):
    return longs(panel.quality_report(I.population(spark, d), "department", "year", "population"), "first_year", "last_year")


@query(I.sql(f"{I.RAW}, {I.WEEKLY}, {I.GRID}", f"SELECT {r('(1 - CAST(count(*) FILTER (cases IS NULL) AS DOUBLE) / (count(*) * 3)) * 100', 'percent')} FROM gridded"))
def completeness(spark, d):
    return rounded(panel.completeness(series.date_grid(I.weekly(spark, d), DEPT, "week_start")), "percent")


@query(I.sql(MONTHS, "SELECT department, year, month, cases FROM (SELECT *, count(*) OVER (PARTITION BY department) AS n FROM monthly WHERE cases >= 10) WHERE n >= 10"))
def minimum_cases(spark, d):
    return longs(panel.enough_rows(month_rows(spark, d), "cases"), "year", "month")


# --- ranks and reshaping ---------------------------------------------------------------

RATES = ",\n".join([I.ANNUAL, "rates AS (SELECT department, year, " + ", ".join(f"round_even({per(c)}, 2) AS {c}_rate" for c in COUNTS) + " FROM annual JOIN pop USING (department, year))",
                    "tall AS (" + " UNION ALL ".join(f"SELECT department, year, '{c}_rate' AS measure, {c}_rate AS value FROM rates" for c in COUNTS) + ")",
                    "ranked AS (SELECT *, rank() OVER (PARTITION BY measure, year ORDER BY value DESC) AS rank FROM tall WHERE value IS NOT NULL)"])


def tall_rates(spark, d) -> DataFrame:
    return panel.long_measures(annual_rates(spark, d), ["department", "year"], [f"{c}_rate" for c in COUNTS])


def ranked(spark, d) -> DataFrame:
    return panel.rank_within(tall_rates(spark, d), "value", ["measure", "year"])


@query(I.sql(RATES, "SELECT department, year, measure, value, rank FROM ranked"))
def rank_by_year(spark, d):
    return longs(ranked(spark, d), "year", "rank")


@query(I.sql(RATES, "SELECT department, " + ", ".join(f"max(rank) FILTER (year = {y}) AS y{y}" for y in range(1995, 2002)) + " FROM ranked WHERE measure = 'pneumonia_under5_rate' GROUP BY 1"))
def rank_grid(spark, d):
    grid = panel.rank_grid(ranked(spark, d).where("measure = 'pneumonia_under5_rate'"), list(range(1995, 2002)))
    return grid.select("department", *[F.col(str(y)).cast("long").alias(f"y{y}") for y in range(1995, 2002)])


@query(I.sql(RATES, "SELECT measure, department, CAST(count(*) FILTER (rank <= 3) AS BIGINT) AS top_years, any_value(n) AS n_years, round_even(count(*) FILTER (rank <= 3) / any_value(n) * 100, 1) AS percent FROM ranked JOIN (SELECT measure, count(DISTINCT year) AS n FROM ranked GROUP BY 1) USING (measure) GROUP BY 1, 2"))
def topk_frequency(spark, d):
    return panel.top_frequency(ranked(spark, d), by=["measure"])


@query(I.sql(MONTHS, f"SELECT department, year, month, {r('incidence', 'incidence')} FROM inc WHERE department IN (SELECT department FROM inc GROUP BY 1 ORDER BY avg(incidence) DESC, department LIMIT 10)"))
def top_groups_trend(spark, d):
    return rounded(longs(panel.top_groups(month_incidence(spark, d), "incidence", 10).select("department", "year", "month", "incidence"), "year", "month"), "incidence")


@query(I.sql(MONTHS, "SELECT department, year, " + ", ".join(r(f"avg(incidence) FILTER (month = {m})", f"m{m}") for m in range(1, 13)) + " FROM inc GROUP BY 1, 2"))
def month_heatmap(spark, d):
    grid = panel.month_grid(month_incidence(spark, d), keys=DEPT)
    return grid.select("department", F.col("year").cast("long").alias("year"), *[tidy(F.col(str(m))).alias(f"m{m}") for m in range(1, 13)])


@query(I.sql(f"{I.POP}, {I.CENSUS_LONG}", "SELECT department, CAST(year AS BIGINT) AS year, population FROM tall"))
def census_unpivot(spark, d):
    return longs(panel.census_long(I.census(spark, d), DEPT), "year")


YEAR_GRID = f"{I.POP}, {I.CENSUS_LONG}, keys AS (SELECT department, y AS year FROM (SELECT DISTINCT department FROM tall), unnest(range(1993, 2004)) AS t(y)), ygrid AS (SELECT k.department, k.year, population FROM keys k LEFT JOIN tall USING (department, year))"


def census_grid(spark, d) -> DataFrame:
    return series.year_grid(panel.census_long(I.census(spark, d), DEPT), DEPT, 1993, 2003)


@query(I.sql(YEAR_GRID, "SELECT department, CAST(year AS BIGINT) AS year, population FROM ygrid"))
def year_grid(spark, d):
    return longs(census_grid(spark, d), "year")


@query(I.sql(f"{YEAR_GRID}, {I.filled_sql('ygrid', 'year', 'population', False)}", f"SELECT department, CAST(t AS BIGINT) AS year, {r('v', 'population')} FROM filled WHERE t BETWEEN 1995 AND 2002"))
def population_interpolated(spark, d):
    out = series.interpolated(census_grid(spark, d), DEPT, "year", "population", "forward")
    return rounded(longs(panel.years_between(out, 1995, 2002), "year"), "population")


# --- series ----------------------------------------------------------------------------

GRIDDED = f"{I.RAW}, {I.WEEKLY}, {I.GRID}"


@query(I.sql(GRIDDED, "SELECT * FROM gridded"))
def week_grid(spark, d):
    return series.date_grid(I.weekly(spark, d), DEPT, "week_start")


MONDAYS = f"""{I.RAW}, {I.WEEKLY}, moved AS (SELECT department, CAST(week_start + CAST(CASE WHEN department < 'NATION_2' THEN 0 ELSE 2 END AS INTEGER) AS DATE) AS week_start, cases FROM weekly),
mgrid AS (SELECT department, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM (SELECT department, CAST(min(week_start) + CAST((8 - isodow(min(week_start))) % 7 AS INTEGER) AS DATE) AS lo, max(week_start) AS hi FROM moved GROUP BY 1) WHERE lo <= hi)"""


@query(I.sql(MONDAYS, "SELECT g.department, g.week_start, m.cases FROM mgrid g LEFT JOIN moved m USING (department, week_start)"))
def monday_grid(spark, d):
    """Some departments report on Mondays, the others on Wednesdays: those have a grid without values."""
    moved = I.weekly(spark, d).withColumn("week_start", F.expr("date_add(week_start, CASE WHEN department < 'NATION_2' THEN 0 ELSE 2 END)"))
    return series.date_grid(moved, DEPT, "week_start", weekday="MON").select("department", "week_start", "cases")


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {r('cases', 'cases')} FROM clean"))
def week_interpolated(spark, d):
    return rounded(I.clean(spark, d), "cases")


def fill_sql(first: str, second: str) -> str:
    return I.sql(f"{GRIDDED}, {I.filled_sql('gridded', 'week_start', 'cases')}, f AS (SELECT department, t AS week_start, coalesce(last_value(x IGNORE NULLS) {I.BACK}, 0) AS b, coalesce(first_value(x IGNORE NULLS) {I.AHEAD}, 0) AS a, last_value(x IGNORE NULLS) {I.BACK} AS bn, first_value(x IGNORE NULLS) {I.AHEAD} AS an FROM num)",
                 f"SELECT department, week_start, coalesce({first}, {second}, 0) AS cases FROM f")


@query(fill_sql("bn", "an"))
def ffill(spark, d):
    return series.filled(series.date_grid(I.weekly(spark, d), DEPT, "week_start"), DEPT, "week_start", "cases", "ffill")


@query(fill_sql("an", "bn"))
def bfill(spark, d):
    return series.filled(series.date_grid(I.weekly(spark, d), DEPT, "week_start"), DEPT, "week_start", "cases", "bfill")


OVER = "OVER (PARTITION BY department ORDER BY week_start"


@query(I.sql(I.CLEAN, "SELECT department, week_start, " + ", ".join(r(f"lag(cases, {k}) {OVER})", f"lag_{k}") for k in (1, 2, 4, 8, 13)) + " FROM clean"))
def lag_features(spark, d):
    out = series.lagged(I.clean(spark, d), DEPT, "week_start", "cases", (1, 2, 4, 8, 13)).drop("cases")
    return rounded(out, *[f"lag_{k}" for k in (1, 2, 4, 8, 13)])


def frame(n: int) -> str:
    return f"{OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def roll(n: int) -> str:
    return ", ".join(r(f"CASE WHEN count(cases) {frame(n)} = {n} THEN {f}(cases) {frame(n)} END", f"rolling_{s}_{n}") for s, f in (("mean", "avg"), ("std", "stddev_samp")))


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {roll(4)}, {roll(13)}, {roll(26)} FROM clean"))
def rolling_features(spark, d):
    out = series.rolling(I.clean(spark, d), DEPT, "week_start", "cases", (4, 13, 26)).drop("cases")
    return rounded(out, *[f"rolling_{s}_{n}" for n in (4, 13, 26) for s in ("mean", "std")])


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {r(f'avg(cases) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'smoothed')} FROM clean"))
def smoothed(spark, d):
    return rounded(series.smoothed(I.clean(spark, d), DEPT, "week_start", "cases").drop("cases"), "smoothed")


ANGLE = "2 * pi() * week(week_start) / 52.1775"
CALENDAR = f"CAST(week(week_start) AS BIGINT) AS week_of_year, {r(f'sin({ANGLE})', 'sin_week')}, {r(f'cos({ANGLE})', 'cos_week')}, CAST(month(week_start) AS BIGINT) AS month, CAST(quarter(week_start) AS BIGINT) AS quarter, CAST(i - 1 AS BIGINT) AS trend"


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {CALENDAR} FROM clean"))
def calendar_features(spark, d):
    out = series.calendar(I.clean(spark, d), "week_start", DEPT).drop("cases")
    return rounded(longs(out, "week_of_year", "month", "quarter", "trend"), "sin_week", "cos_week")


@query(I.sql(I.CLEAN, f"SELECT * FROM (SELECT department, week_start, {r('cases', 'cases')}, {r(f'lag(cases, 1) {OVER})', 'lag_1')}, {r(f'lag(cases, 52) {OVER})', 'lag_52')}, {roll(4)}, {CALENDAR} FROM clean) WHERE lag_52 IS NOT NULL AND rolling_std_4 IS NOT NULL"))
def feature_matrix(spark, d):
    out = series.feature_matrix(I.clean(spark, d), DEPT, "week_start", "cases", (1, 52), (4,))
    return rounded(longs(out, "week_of_year", "month", "quarter", "trend"), "cases", "lag_1", "lag_52", "rolling_mean_4", "rolling_std_4", "sin_week", "cos_week")


@query(I.sql(I.CLEAN, "SELECT department, week_start, CAST(i AS BIGINT) AS i, " + ", ".join(r(f"{f}(2 * pi() * {k} * i / 52.1775)", f"{f}_{k}") for k in range(1, 7) for f in ("sin", "cos")) + " FROM clean"))
def fourier_terms(spark, d):
    out = series.fourier(series.with_position(I.clean(spark, d), DEPT, "week_start")).drop("cases")
    return rounded(longs(out, "i"), *[f"{f}_{k}" for k in range(1, 7) for f in ("sin", "cos")])


TRAIN = "week_start < DATE '2000-01-01'"


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {r('(cases - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 'cases')} FROM clean JOIN (SELECT department, avg(cases) AS m, stddev_pop(cases) AS s FROM clean WHERE {TRAIN} GROUP BY 1) USING (department)"))
def standard_scale(spark, d):
    return rounded(series.standardized(I.clean(spark, d), ["cases"], F.expr(TRAIN), DEPT), "cases")


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {r('coalesce((cases - min(cases) OVER p) / nullif(max(cases) OVER p - min(cases) OVER p, 0), 0)', 'scaled')} FROM clean WINDOW p AS (PARTITION BY department)"))
def minmax_scale(spark, d):
    return rounded(series.minmax(I.clean(spark, d), DEPT, "cases").select("department", "week_start", "scaled"), "scaled")


LAGS = f"{I.CLEAN}, lags AS (SELECT cases, lag(cases, 1) {OVER}) AS lag_1, lag(cases, 2) {OVER}) AS lag_2, CAST(week(week_start) AS DOUBLE) AS week FROM clean)"
PICKED = ("cases", "lag_1", "lag_2", "week")


def lag_columns(spark, d) -> DataFrame:
    out = series.lagged(I.clean(spark, d), DEPT, "week_start", "cases", (1, 2))
    return out.select("cases", "lag_1", "lag_2", F.weekofyear("week_start").cast("double").alias("week"))


@query(I.sql(LAGS, " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'var_pop({c})', 'variance')} FROM lags" for c in PICKED)))
def variance_filter(spark, d):
    return rounded(series.variances(lag_columns(spark, d), PICKED), "variance")


@query(I.sql(LAGS, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM lags" for i, a in enumerate(PICKED) for b in PICKED[i + 1:])))
def correlation_pairs(spark, d):
    return rounded(series.correlations(lag_columns(spark, d), PICKED), "r")


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {r('past[1]', 'oldest')}, {r('past[8]', 'newest')}, {r('list_sum(future)', 'ahead')} FROM (SELECT department, week_start, list(cases) {OVER} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS past, list(cases) {OVER} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS future FROM clean) WHERE len(past) = 8 AND len(future) = 4"))
def sequences(spark, d):
    out = series.sequences(I.clean(spark, d), DEPT, "week_start", "cases", 8, 4)
    total = F.aggregate("future", F.lit(0.0), lambda s, x: s + x)
    return rounded(out.select("department", "week_start", F.get("past", F.lit(0)).alias("oldest"), F.get("past", F.lit(7)).alias("newest"), total.alias("ahead")), "oldest", "newest", "ahead")


SPLIT = f"{I.CLEAN}, sized AS (SELECT *, count(*) OVER (PARTITION BY department) AS n FROM clean), split AS (SELECT *, CASE WHEN i <= ceil(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i <= ceil(n * CAST(0.8 AS DOUBLE)) + ceil(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM sized)"


@query(I.sql(SPLIT, "SELECT department, week_start, split FROM split"))
def split_ratio(spark, d):
    return series.temporal_split(I.clean(spark, d), DEPT, "week_start", least=1).drop("cases")


@query(I.sql(I.CLEAN, " UNION ALL ".join(f"SELECT department, week_start, '{s}' AS split FROM clean WHERE year(week_start) BETWEEN {a} AND {b}" for s, a, b in (("train", 1995, 1999), ("val", 1999, 2000), ("test", 2000, 2001)))))
def split_years(spark, d):
    return series.temporal_split(I.clean(spark, d), DEPT, "week_start", "years", train=(1995, 1999), val=(1999, 2000), test=(2000, 2001)).drop("cases")


@query(I.sql(GRIDDED, "SELECT department, n, n_null, n_negative, n >= 104 AS long_enough, (n_null > 0.2 * n OR n_negative > 0) AS warns FROM (SELECT department, count(*) AS n, CAST(count(*) FILTER (cases IS NULL) AS BIGINT) AS n_null, CAST(count(*) FILTER (cases < 0) AS BIGINT) AS n_negative FROM gridded GROUP BY 1)"))
def series_validation(spark, d):
    return series.validation(series.date_grid(I.weekly(spark, d), DEPT, "week_start"), DEPT, "cases")


@query(I.sql(f"{GRIDDED}, known(department, reliable_from) AS (VALUES ('NATION_0', 1998), ('NATION_1', 1997))", "SELECT department, CAST(reliable_from AS BIGINT) AS reliable_from, count(*) AS zero_weeks FROM gridded JOIN known USING (department) WHERE year(week_start) < reliable_from AND coalesce(cases, 0) = 0 GROUP BY 1, 2"))
def underreporting(spark, d):
    g = series.date_grid(I.weekly(spark, d), DEPT, "week_start").na.fill(0, ["cases"])
    return longs(series.underreported(g, "department", "week_start", "cases", {"NATION_0": 1998, "NATION_1": 1997}), "reliable_from")


# --- outliers --------------------------------------------------------------------------

FENCED = f"{MONTHS}, q AS (SELECT quantile_cont(incidence, 0.25) AS q1, quantile_cont(incidence, 0.75) AS q3 FROM inc), fenced AS (SELECT inc.*, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM inc, q)"


@query(I.sql(FENCED, f"SELECT department, year, month, {r('incidence', 'incidence')}, {r('lower', 'lower')}, {r('upper', 'upper')} FROM fenced WHERE incidence < lower OR incidence > upper"))
def iqr_outliers(spark, d):
    out = outliers.beyond_fences(month_incidence(spark, d), "incidence").select("department", "year", "month", "incidence", "lower", "upper")
    return rounded(longs(out, "year", "month"), "incidence", "lower", "upper")


@query(I.sql(MONTHS, f"SELECT department, year, month, {r('abs(incidence - m) / nullif(s, 0)', 'severity')} FROM inc, (SELECT avg(incidence) AS m, stddev_samp(incidence) AS s FROM inc)"))
def outlier_severity(spark, d):
    return rounded(longs(outliers.severity(month_incidence(spark, d), "incidence").select("department", "year", "month", "severity"), "year", "month"), "severity")


ALIKE = f"{FENCED}, a AS (SELECT department, year, month FROM fenced WHERE incidence < lower OR incidence > upper), b AS (SELECT department, year, month FROM (SELECT *, abs(incidence - avg(incidence) OVER (PARTITION BY department)) AS e, stddev_samp(incidence) OVER (PARTITION BY department) AS s FROM inc) WHERE e > 2 * s)"


@query(I.sql(ALIKE, "SELECT department, year, month, CASE WHEN a.year IS NOT NULL AND b.year IS NOT NULL THEN 'confirmed' WHEN a.year IS NOT NULL THEN 'iqr_only' ELSE 'arima_only' END AS class FROM (SELECT *, year AS y, month AS m FROM a) a FULL JOIN b USING (department, year, month)".replace("a.year IS", "a.y IS").replace("FULL JOIN b", "FULL JOIN (SELECT *, year AS y FROM b) b").replace("b.year IS", "b.y IS")))
def outlier_sets(spark, d):
    inc = month_incidence(spark, d)
    a = outliers.beyond_fences(inc, "incidence")
    mean = inc.groupBy("department").agg(F.avg("incidence").alias("m"))
    b = outliers.extreme_residuals(inc.join(mean, "department").withColumn("residual", F.col("incidence") - F.col("m")), DEPT, sigmas=2.0)
    return longs(outliers.classified(a, b, ["department", "year", "month"]), "year", "month")


RATED = f"{RATES}, tops AS (SELECT measure, department FROM (SELECT measure, department, row_number() OVER (PARTITION BY measure ORDER BY avg(value) DESC, department) AS place FROM tall WHERE value IS NOT NULL GROUP BY 1, 2) WHERE place <= 3)"


@query(I.sql(RATED, "SELECT measure, department, year, value FROM tall JOIN tops USING (measure, department)"))
def regional_workflow(spark, d):
    """The years of the three departments of highest mean rate, for all six measures in one plan."""
    return longs(panel.top_of_each(tall_rates(spark, d), "measure", "department", "value", 3, digits=2).select("measure", "department", "year", "value"), "year")


OUTLYING = f"""{RATES}, stat AS (SELECT measure, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM tall WHERE value IS NOT NULL GROUP BY 1),
outlying AS (SELECT department, year, measure, value, abs(value - m) / nullif(s, 0) AS severity FROM tall JOIN stat USING (measure) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"""


@query(I.sql(OUTLYING, f"SELECT department, year, measure, {r('value', 'value')}, {r('severity', 'severity')} FROM outlying"))
def outlier_report(spark, d):
    found = outliers.report(annual_rates(spark, d), ["department", "year"], [f"{c}_rate" for c in COUNTS])
    return rounded(longs(found.select("department", "year", "measure", "value", "severity"), "year"), "value", "severity")


@query(I.sql(OUTLYING, f"SELECT measure, count(*) AS n, {r('avg(severity)', 'mean_severity')}, {r('max(severity)', 'worst')} FROM outlying GROUP BY 1"))
def outlier_summary(spark, d):
    return rounded(outliers.summary(outlier_report(spark, d)), "mean_severity", "worst")


# --- backtests -------------------------------------------------------------------------

def points_sql(train: int, horizon: int, step: int, source: str) -> str:
    """CTE ``pts`` of origins, horizons, actuals and the value at the place ``source``."""
    return f"""{I.CLEAN}, span AS (SELECT department, count(*) AS n FROM clean GROUP BY 1 HAVING count(*) > {train}),
starts AS (SELECT department, n, te FROM span, unnest(range({train}, n, {step})) AS t(te)), oh AS (SELECT department, te, h FROM starts, unnest(range(1, {horizon} + 1)) AS u(h) WHERE te + h <= n),
pts AS (SELECT oh.department, te, h, y.week_start AS date, y.cases AS actual, x.cases AS predicted FROM oh JOIN clean y ON y.department = oh.department AND y.i = te + h JOIN clean x ON x.department = oh.department AND x.i = {source})"""


NAIVE = points_sql(52, 4, 4, "te")
SEASONAL = points_sql(104, 4, 13, "te - 52 + 1 + (h - 1) % 52")


def score_sql(by: str, before: str) -> str:
    e = "(actual - predicted)"
    base = "((abs(actual) + abs(predicted)) / 2)"
    parts = [r(f"avg(abs({e}))", "mae"), r(f"sqrt(avg({e} * {e}))", "rmse"), r(f"avg({e})", "me"), r(f"avg(CASE WHEN abs(actual) > 1e-10 THEN abs({e} / nullif(actual, 0)) END) * 100", "mape"),
             r(f"avg(CASE WHEN {base} > 1e-10 THEN abs({e}) / nullif({base}, 0) END) * 100", "smape"), r("avg(CASE WHEN sign(actual - before) = sign(predicted - before) THEN 1.0 WHEN before IS NOT NULL THEN 0.0 END) * 100", "mda"),
             r(f"1 - sum({e} * {e}) / nullif(var_pop(actual) * count(*), 0)", "r2")]
    return f"SELECT {by}, count(*) AS n, {', '.join(parts)} FROM (SELECT *, lag(actual) OVER (PARTITION BY {by} ORDER BY date) AS before FROM {before}) GROUP BY {by}"


def naive_points(spark, d) -> DataFrame:
    return evaluate.backtest(I.clean(spark, d), DEPT, "week_start", "cases", 52, 4, 4, "naive")


def seasonal_points(spark, d) -> DataFrame:
    return evaluate.backtest(I.clean(spark, d), DEPT, "week_start", "cases", 104, 4, 13, "seasonal_naive")


def points_out(df: DataFrame) -> DataFrame:
    return rounded(longs(df, "te", "h"), "actual", "predicted")


@query(I.sql(NAIVE, f"SELECT department, te, h, date, {r('actual', 'actual')}, {r('predicted', 'predicted')} FROM pts"))
def naive_backtest(spark, d):
    return points_out(naive_points(spark, d))


@query(I.sql(SEASONAL, f"SELECT department, te, h, date, {r('actual', 'actual')}, {r('predicted', 'predicted')} FROM pts"))
def seasonal_naive_backtest(spark, d):
    return points_out(seasonal_points(spark, d))


@query(I.sql(f"{points_sql(52, 4, 4, 'te')}, means AS (SELECT department, i, avg(cases) OVER (PARTITION BY department ORDER BY i ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS m FROM clean)", f"SELECT pts.department, te, h, date, {r('actual', 'actual')}, {r('m', 'predicted')} FROM pts JOIN means ON means.department = pts.department AND means.i = te"))
def mean_backtest_sliding(spark, d):
    return points_out(evaluate.backtest(I.clean(spark, d), DEPT, "week_start", "cases", 52, 4, 4, "mean", window="sliding"))


def walked(spark, d, model: str, train: int, step: int, **options) -> DataFrame:
    return models.walkforward(I.clean(spark, d), DEPT, "week_start", "cases", model, train, 4, step, **options)


def walk_sql(ctes: str, predicted: str = "predicted", fit: str = "te") -> str:
    return I.sql(ctes, f"SELECT pts.department, te, {fit} AS fit, h, date, {r('actual', 'actual')}, {r(predicted, 'predicted')}, status FROM (SELECT *, 'success' AS status, min(te) OVER (PARTITION BY department) AS first FROM pts) pts")


def walk_out(df: DataFrame) -> DataFrame:
    return points_out(df.drop("lower", "upper", "error").withColumn("fit", F.col("fit").cast("long")))


@query(walk_sql(NAIVE, fit="first + (te - first) // 12 * 12"))
def walkforward_naive(spark, d):
    """The grouped walk-forward with a refit at every third origin; a naive forecast does not depend on the fit."""
    return walk_out(walked(spark, d, "naive", 52, 4, refit_every=3))


@query(walk_sql(SEASONAL, fit="first"))
def walkforward_seasonal_naive(spark, d):
    return walk_out(walked(spark, d, "seasonal_naive", 104, 13, refit_every=0))


@query(I.sql(f"{points_sql(52, 4, 4, 'te')}, means AS (SELECT department, i, avg(cases) OVER (PARTITION BY department ORDER BY i ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS m FROM clean)", f"SELECT pts.department, te, te AS fit, h, date, {r('actual', 'actual')}, {r('m', 'predicted')}, 'success' AS status FROM pts JOIN means ON means.department = pts.department AND means.i = te"))
def walkforward_mean_sliding(spark, d):
    return walk_out(walked(spark, d, "mean", 52, 4, window="sliding"))


#: Walk-forward of an autoregression of differences, fitted once at the first origin: its coefficient is a ratio of sums.
WALKED_AR = f"""{points_sql(104, 1, 13, 'te')}, diffs AS (SELECT department, i, cases - lag(cases) {OVER}) AS x FROM clean), pairs AS (SELECT department, i, x, lag(x) OVER (PARTITION BY department ORDER BY i) AS b FROM diffs),
phi AS (SELECT department, least(0.98, greatest(-0.98, sum(x * b) / sum(b * b))) AS phi FROM pairs WHERE i <= 104 AND b IS NOT NULL GROUP BY 1)"""


@query(I.sql(WALKED_AR, f"SELECT pts.department, te, CAST(104 AS BIGINT) AS fit, h, date, {r('actual', 'actual')}, {r('greatest(0, predicted + phi * x)', 'predicted')}, 'success' AS status FROM pts JOIN phi USING (department) JOIN diffs ON diffs.department = pts.department AND diffs.i = te"))
def walkforward_ar(spark, d):
    return walk_out(models.walkforward(I.clean(spark, d), DEPT, "week_start", "cases", "arimax", 104, 1, 13, refit_every=0, order=(1, 1, 0), pairs=0))


SHAPE = "SELECT department, h, count(*) AS n, CAST(0 AS BIGINT) AS failed, TRUE AS ordered, TRUE AS in_range FROM pts GROUP BY 1, 2"


def shape(df: DataFrame) -> DataFrame:
    """Rows of each horizon, failures, whether intervals hold their point, and whether it lies within ten times the greatest actual."""
    near = (F.col("lower") <= F.col("predicted")) & (F.col("predicted") <= F.col("upper"))
    top = df.groupBy("department").agg((F.max("actual") * 10).alias("top"))
    return longs(df.join(top, "department").groupBy("department", "h").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "success").alias("failed"), F.min(near).alias("ordered"),
                                                                         F.min(F.col("predicted").between(0, F.col("top"))).alias("in_range")), "h")


def walk_shape(name: str, model: str, step: int, **options) -> None:
    def run(spark, d):
        return shape(walked(spark, d, model, 130, step, **options))

    _queries[name] = run
    _sql[name] = I.sql(points_sql(130, 4, step, "te"), SHAPE)


for _name, _model, _step, _refit in (("walkforward_arima", "sarima", 13, 2), ("walkforward_auto_arima", "autosarima", 52, 1), ("walkforward_seasonal_arima", "seasonal_arima", 52, 0), ("walkforward_holt_winters", "holt_winters", 26, 2), ("walkforward_additive", "prophet", 13, 1)):
    walk_shape(_name, _model, _step, refit_every=_refit)


@query(I.sql(NAIVE, score_sql("department, h", "pts")))
def metrics_by_horizon(spark, d):
    return rounded(longs(evaluate.by_horizon(naive_points(spark, d), DEPT), "h"), *MET)


@query(I.sql(NAIVE, score_sql("department, te", "pts")))
def metrics_by_step(spark, d):
    return rounded(longs(evaluate.by_step(naive_points(spark, d), DEPT), "te"), *MET)


@query(I.sql(points_sql(52, 4, 2, "te"), f"SELECT department, date, {r('any_value(actual)', 'actual')}, {r('arg_min(predicted, h)', 'predicted')} FROM pts GROUP BY 1, 2"))
def blend_horizons(spark, d):
    pts = evaluate.backtest(I.clean(spark, d), DEPT, "week_start", "cases", 52, 4, 2, "naive")
    return rounded(evaluate.blended(pts, DEPT), "actual", "predicted")


BOTH = f"""{NAIVE.replace('pts AS', 'pts_n AS')},
pts_s AS (SELECT p.department, te, h, date, actual, x.cases AS predicted FROM pts_n p JOIN clean x ON x.department = p.department AND x.i = te - 52 + 1 + (h - 1) % 52),
both_ AS (SELECT 'naive' AS model, * FROM pts_n UNION ALL SELECT 'seasonal_naive', * FROM pts_s)"""


def both_models(spark, d) -> DataFrame:
    c = I.clean(spark, d)
    parts = [evaluate.backtest(c, DEPT, "week_start", "cases", 52, 4, 4, m).withColumn("model", F.lit(m)) for m in ("naive", "seasonal_naive")]
    return I.union(parts)


FIRST = f"{BOTH}, one AS (SELECT model, department, date, actual, predicted FROM both_ WHERE h = 1), base AS (SELECT 'mean_baseline' AS model, department, date, actual, avg(actual) OVER (PARTITION BY department) AS predicted FROM one WHERE model = 'naive'), cmp AS (SELECT * FROM one UNION ALL SELECT * FROM base)"


def first_step(spark, d) -> DataFrame:
    return both_models(spark, d).where("h = 1")


@query(I.sql(FIRST, score_sql("department, model", "cmp")))
def compare_models(spark, d):
    return rounded(evaluate.compared(first_step(spark, d), DEPT), *MET)


@query(I.sql(FIRST, f"SELECT department, model, rmse, CAST(row_number() OVER (PARTITION BY department ORDER BY rmse ASC NULLS LAST, model) AS BIGINT) AS rank FROM ({score_sql('department, model', 'cmp')})"))
def rank_models(spark, d):
    return longs(evaluate.ranked_models(rounded(evaluate.compared(first_step(spark, d), DEPT), *MET), "rmse", DEPT).select("department", "model", "rmse", "rank"), "rank")


@query(I.sql(NAIVE, f"SELECT department, 'mae' AS metric, {r('s', 'v_short')}, {r('l', 'v_long')}, CASE WHEN s > 0 THEN round_even((l / s - 1) * 100, 1) END AS change FROM (SELECT department, avg(abs(actual - predicted)) FILTER (h = 1) AS s, avg(abs(actual - predicted)) FILTER (h = 4) AS l FROM pts GROUP BY 1)"))
def degradation(spark, d):
    tall = evaluate.tall_metrics(evaluate.by_horizon(naive_points(spark, d), DEPT), ["department", "h"]).where("metric = 'mae'")
    return rounded(evaluate.degradation(tall, 1, 4, DEPT), "v_short", "v_long")


@query(I.sql(FIRST, f"SELECT department, 'mae' AS metric, arg_min(model, mae * 1e6 + CASE model WHEN 'mean_baseline' THEN 0 WHEN 'naive' THEN 0.1 ELSE 0.2 END) AS model, min(mae) AS value FROM ({score_sql('department, model', 'cmp')}) GROUP BY 1"))
def best_models(spark, d):
    tall = evaluate.tall_metrics(rounded(evaluate.compared(first_step(spark, d), DEPT), *MET), ["department", "model"])
    return evaluate.best_models(tall.where("metric = 'mae'"), DEPT)


@query(I.sql(BOTH, f"SELECT department, te, h, date, {r('avg(actual)', 'actual')}, {r(chr(40) + 'sum(predicted * CASE model WHEN ' + chr(39) + 'naive' + chr(39) + ' THEN 0.6 ELSE 0.4 END)) / sum(CASE model WHEN ' + chr(39) + 'naive' + chr(39) + ' THEN 0.6 ELSE 0.4 END)', 'predicted')} FROM both_ GROUP BY 1, 2, 3, 4"))
def ensemble_average(spark, d):
    return points_out(evaluate.ensemble(both_models(spark, d), ["department", "te", "h", "date"], {"naive": 0.6, "seasonal_naive": 0.4}))


@query(I.sql(BOTH, f"SELECT department, te, h, date, {r('avg(actual)', 'actual')}, {r('median(predicted)', 'predicted')} FROM both_ GROUP BY 1, 2, 3, 4"))
def ensemble_median(spark, d):
    return points_out(evaluate.ensemble(both_models(spark, d), ["department", "te", "h", "date"], how="median"))


@query(I.sql(SPLIT, f"SELECT week_start AS date, split, CASE split WHEN 'train' THEN 'actual' ELSE 'naive' END AS model, {r('cases', 'actual')}, department FROM split WHERE split <> 'val' UNION ALL SELECT week_start, 'val', 'replaced', {r('cases * 2', 'actual')}, department FROM split WHERE split = 'val'"))
def partial_overwrite_union(spark, d):
    rows = series.temporal_split(I.clean(spark, d), DEPT, "week_start", least=1).select(F.col("week_start").alias("date"), "split", F.when(F.col("split") == "train", "actual").otherwise("naive").alias("model"), F.col("cases").alias("actual"), "department")
    new = rows.where("split = 'val'").withColumns({"model": F.lit("replaced"), "actual": F.col("actual") * 2})
    return rounded(sinks.replaced(rows, new, ("val",)), "actual")


@query(I.sql(f"{I.CLEAN}, d AS (SELECT department, week_start, cases - avg(cases) OVER (PARTITION BY department) AS x FROM clean), l AS (SELECT *, " + ", ".join(f"lag(x, {k}) {OVER}) AS x{k}" for k in range(1, 9)) + " FROM d)",
             " UNION ALL ".join(f"SELECT department, CAST({k} AS BIGINT) AS lag, {r(f'sum(x * x{k}) / nullif(sum(x * x), 0)', 'acf')} FROM l GROUP BY 1" for k in range(1, 9))))
def autocorrelation(spark, d):
    return rounded(longs(evaluate.autocorrelation(I.clean(spark, d), DEPT, "week_start", "cases", 8).drop("significant"), "lag"), "acf")


@query("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS cases FROM events GROUP BY 1, 2")
def weekly_events(spark, d):
    return weekly_counts(I.table(spark, d, "events").select("event_type", "ts"), "event_type")


# --- estimators without SQL --------------------------------------------------------------

def model_query(name: str, model: str, **options):
    def run(spark, d):
        f, base = models.model_of(model)
        return rounded(models.grouped_forecast(I.clean(spark, d), DEPT, "week_start", "cases", f, 8, **(base | options)), "predicted", "lower", "upper")

    _queries[name] = run


for _name, _model in (("arimax_auto", "auto_sarima"), ("recurrent_lstm", "lstm"), ("recurrent_gru", "gru")):
    model_query(_name, _model)


def degenerate(spark, d) -> DataFrame:
    """Series of one value: the number of the department's weeks, or of its first letters for the trees' sake one of two."""
    c = I.clean(spark, d)
    n = c.groupBy("department").agg(F.count("*").cast("double").alias("n"))
    return c.join(n, "department").select("department", "week_start", F.col("n").alias("cases"))


FLAT = f"{I.CLEAN}, flat AS (SELECT department, CAST(count(*) AS DOUBLE) AS n FROM clean GROUP BY 1)"
FLAT_MODELS = ("naive", "seasonal_naive", "mean", "holt_winters", "sarima", "auto_sarima", "seasonal_arima", "prophet", "lstm", "gru")


@query(I.sql(FLAT, " UNION ALL ".join(f"SELECT department, '{m}' AS model, CAST(h AS BIGINT) AS h, round(n, 3) + 0.0 AS predicted, 'success' AS status FROM flat, unnest(range(1, 5)) AS t(h)" for m in FLAT_MODELS)))
def flat_forecasts(spark, d):
    """Every estimator on series that do not move."""
    rows = degenerate(spark, d)
    parts = []
    for m in FLAT_MODELS:
        f, options = models.model_of(m)
        parts.append(models.grouped_forecast(rows, DEPT, "week_start", "cases", f, 4, **options).select("department", F.lit(m).alias("model"), F.col("h").cast("long").alias("h"), tidy(F.col("predicted"), 3).alias("predicted"), "status"))
    return I.union(parts)


@query(I.sql(I.CLEAN, " UNION ALL ".join(f"SELECT department, '{k}' AS model, CAST(h AS BIGINT) AS h, CAST(CASE WHEN department < 'NATION_2' THEN 5 ELSE 9 END AS DOUBLE) AS predicted FROM (SELECT DISTINCT department FROM clean), unnest(range(1, 7)) AS t(h)" for k in ("random_forest", "gbt"))))
def flat_trees(spark, d):
    """Both tree models on series of two values, forecast beyond one written state."""
    rows = I.clean(spark, d).withColumn("cases", F.when(F.col("department") < "NATION_2", 5.0).otherwise(9.0))
    parts = []
    for kind, params in (("random_forest", {"numTrees": 10, "maxDepth": 4}), ("gbt", {"maxIter": 5})):
        m = trees.fit(rows, DEPT, "week_start", "cases", kind, **params)
        parts.append(trees.forecast(m, rows, DEPT, "week_start", "cases", 6).select("department", F.lit(kind).alias("model"), F.col("h").cast("long").alias("h"), tidy(F.col("predicted"), 3).alias("predicted")))
    return I.union(parts)


@query(I.sql(points_sql(200, 3, 60, "te"), "SELECT department, h, count(*) AS n FROM pts GROUP BY 1, 2"))
def walkforward_trees(spark, d):
    """One forest of all keys, refitted at every second origin; origins are weeks of the longest series."""
    c = I.clean(spark, d)
    last, first = c.agg(F.max("week_start"), F.min("week_start")).first()
    weeks = (last - first).days // 7 + 1
    cutoffs = [first + datetime.timedelta(days=7 * (te - 1)) for te in range(200, weeks, 60)]
    out = trees.walkforward(c, DEPT, "week_start", "cases", "random_forest", cutoffs, 3, 2)
    return longs(out.groupBy("department", "h").agg(F.count("*").alias("n")), "h")


#: ARIMA(1,1,0) without regressors in closed form: differences, their coefficient, what it leaves.
AR = f"""{I.CLEAN}, diffs AS (SELECT department, week_start, cases, cases - lag(cases) {OVER}) AS x FROM clean), pairs AS (SELECT *, lag(x) {OVER}) AS b FROM diffs),
phi AS (SELECT department, least(0.98, greatest(-0.98, sum(x * b) / sum(b * b))) AS phi FROM pairs WHERE b IS NOT NULL GROUP BY 1),
res AS (SELECT department, week_start, cases, x - coalesce(phi * b, 0) AS residual FROM pairs JOIN phi USING (department))"""


def ar_residuals(spark, d) -> DataFrame:
    return models.residuals(I.clean(spark, d), DEPT, "week_start", "cases", order=(1, 1, 0))


@query(I.sql(AR, f"SELECT department, week_start, {r('cases', 'cases')}, {r('residual', 'residual')} FROM res"))
def arima_residuals(spark, d):
    return rounded(ar_residuals(spark, d), "cases", "residual")


@query(I.sql(AR, f"SELECT department, week_start, {r('cases', 'cases')}, {r('residual', 'residual')} FROM res JOIN (SELECT department, stddev_samp(residual) AS s FROM res GROUP BY 1) USING (department) WHERE abs(residual) > 2.5 * s"))
def arima_residual_outliers(spark, d):
    return rounded(outliers.extreme_residuals(ar_residuals(spark, d), DEPT), "cases", "residual")


@query(I.sql(AR, f"SELECT department, CAST(n AS DOUBLE) AS n, {r('n * ln(mse) + 4', 'aic')}, {r('n * ln(mse) + 2 * ln(n)', 'bic')}, {r('sqrt(mse)', 'rmse')}, {r('m', 'mean')}, {r('s', 'std')}, {r('lo', 'least')}, {r('hi', 'most')} FROM (SELECT department, count(residual) AS n, avg(residual * residual) AS mse, avg(residual) AS m, stddev_samp(residual) AS s, min(residual) AS lo, max(residual) AS hi FROM res GROUP BY 1)"))
def arima_diagnostics(spark, d):
    out = models.diagnosed(I.clean(spark, d), DEPT, "week_start", "cases", order=(1, 1, 0), pairs=0).drop("adf")
    return rounded(out, *[c for c in models.DIAGNOSTICS if c != "adf"])


@query(I.sql(I.CLEAN, f"SELECT department, count(*) AS n, {r('sum(cases)', 'total')}, CAST(0 AS DOUBLE) AS gap FROM clean GROUP BY 1 HAVING count(*) >= 104"))
def stl_sums(spark, d):
    """Components of the decomposition add up to what was observed, week by week."""
    parts = stl(spark, d)
    whole = F.col("trend") + F.col("seasonal") + F.col("remainder")
    return rounded(parts.groupBy("department").agg(F.count("*").alias("n"), F.sum(whole).alias("total"), F.max(F.abs(whole - F.col("observed"))).alias("gap")), "total", "gap")


#: Naive forecasts of the validation rows from the last training row, and of the test rows from the last validation row.
PIPELINE = f"""{SPLIT}, ends AS (SELECT department, split, arg_max(cases, i) AS last FROM split GROUP BY 1, 2),
held AS (SELECT s.department, s.split, 'naive' AS model, week_start AS date, cases AS actual, e.last AS predicted FROM split s JOIN ends e ON e.department = s.department AND e.split = CASE s.split WHEN 'val' THEN 'train' ELSE 'val' END WHERE s.split <> 'train'),
scored AS (SELECT * FROM held UNION ALL SELECT department, split, 'mean_baseline', date, actual, avg(actual) OVER (PARTITION BY department, split) FROM held)"""


@query(I.sql(PIPELINE, score_sql("department, split, model", "scored")))
def train_pipeline_naive(spark, d):
    rows = training.held_out(I.clean(spark, d), DEPT, "week_start", "cases", "naive", least=1)
    return rounded(training.scores(rows, DEPT), *MET)


@query(I.sql(I.CLEAN, f"SELECT department, 'naive' AS model, count(*) AS n, max(week_start) AS last_date, {r('arg_max(cases, week_start)', 'predicted')} FROM clean GROUP BY 1"))
def saved_models(spark, d):
    """Models fitted, written, read back and asked for a forecast."""
    path = own(spark, "models")
    c = I.clean(spark, d)
    sinks.write(models.fitted(c, DEPT, "week_start", "cases", "naive"), path)
    saved = sinks.parameters(spark, path)
    got = models.from_fitted(saved, c, DEPT, "week_start", "cases", 1)
    return rounded(saved.join(got, "department").select("department", "model", "n", "last_date", "predicted"), "predicted")


# --- sources: written as the files that readers take, then read ----------------------------------------

def own(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str, fmt: str = "csv") -> str:
    path = own(df.sparkSession, name)
    sinks.write(df, path, fmt)
    return path


RAWISH = f"{I.RAW}, rawish AS (SELECT department, week_start, year, " + ", ".join(f"sum({c}) AS {c}" for c in COUNTS) + " FROM raw GROUP BY 1, 2, 3)"


@query(I.sql(RAWISH, "SELECT upper(department) AS department, week_start, CAST(year(week_start) AS BIGINT) AS year, CAST(month(week_start) AS BIGINT) AS month, CAST(week(week_start) AS BIGINT) AS week_of_year, " + ", ".join(COUNTS) + " FROM rawish"))
def csv_weekly(spark, d):
    rows = panel.annual_sums(I.raw(spark, d), ("department", "week_start")).withColumn("department", F.concat(F.lit("  "), F.lower("department")))
    out = readers.weekly(readers.csv(spark, written(rows, "weekly.csv")))
    return longs(out, "year", "month", "week_of_year").select("department", "week_start", "year", "month", "week_of_year", *COUNTS)


@query(I.sql(RAWISH, "SELECT upper(department) AS department, week_start, pneumonia_60plus AS cases FROM rawish WHERE department = 'NATION_1'"))
def csv_weekly_cases(spark, d):
    rows = panel.annual_sums(I.raw(spark, d), ("department", "week_start"))
    return readers.weekly_cases(readers.csv(spark, written(rows, "weekly-cases.csv")), "60plus", " nation_1 ").select("department", "week_start", "cases")


@query(I.sql(I.ANNUAL, "SELECT lpad(regexp_extract(department, '[0-9]+'), 2, '0') AS iddpto, CAST(year AS BIGINT) AS year, " + ", ".join(COUNTS) + " FROM annual"))
def csv_surveillance(spark, d):
    rows = panel.annual_sums(I.raw(spark, d), ("department", "year")).select(F.regexp_extract("department", "[0-9]+", 0).alias(" IDDPTO"), F.col("year").alias("ANO"), *COUNTS)
    return readers.annual_cases(spark, written(rows, "surveillance.csv")).select("iddpto", "year", *COUNTS)


@query(I.sql(I.POP, "SELECT lpad(regexp_extract(department, '[0-9]+'), 2, '0') AS iddpto, CAST(year AS BIGINT) AS year, population FROM pop WHERE year <> 1997"))
def csv_population(spark, d):
    rows = I.population(spark, d).select(F.regexp_extract("department", "[0-9]+", 0).alias("iddpto"), "year", F.when(F.col("year") != 1997, F.col("population").cast("string")).otherwise("n/a").alias("population"))
    return longs(readers.population(spark, written(rows, "population.csv")).select("iddpto", "year", "population"), "year")


@query(I.sql(I.ANNUAL, "SELECT department, CAST(year AS BIGINT) AS year, " + ", ".join(COUNTS[:2]) + " FROM annual"))
def csv_measures(spark, d):
    rows = panel.annual_sums(I.raw(spark, d), ("department", "year")).withColumn("department", F.concat("department", F.lit(" ")))
    return longs(readers.measures(spark, written(rows, "measures.csv"), COUNTS[:2]).select("department", "year", *COUNTS[:2]), "year")


@query(I.sql(I.POP, "SELECT department, CAST(n_nationkey AS BIGINT) AS iddpto FROM people"))
def csv_census(spark, d):
    rows = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("IDDPTO"), F.col("n_name").alias(" Department "))
    return readers.census(spark, written(rows, "census.csv")).select("department", F.col("iddpto").cast("long").alias("iddpto"))


@query(I.sql(I.CLEAN, f"SELECT department, week_start, {r('cases', 'cases')} FROM clean WHERE department = 'NATION_1' AND year(week_start) >= 1997"))
def department_series(spark, d):
    """One key's series from a table partitioned by key: only its files are read."""
    path = own(spark, "series")
    sinks.write(I.clean(spark, d).withColumn("age_group", F.lit("all")), path, partition_by=["department", "age_group"])
    return rounded(readers.department_series(spark.read.parquet(path), "nation_1", "all", 1997).select("department", "week_start", "cases"), "cases")


@query(I.sql(NAIVE, f"SELECT department, date, {r('actual', 'actual')}, {r('predicted', 'predicted')}, 'naive' AS model FROM pts WHERE h = 1"))
def prediction_files(spark, d):
    """Predictions written as two files with rows in common, read back as one set."""
    rows = naive_points(spark, d).where("h = 1").select("date", F.lit("backtest").alias("split"), F.lit("naive").alias("model"), "actual", "predicted", "department", F.lit("all").alias("age_group"))
    base = own(spark, "predictions")
    for part in ("a", "b"):
        sinks.write(rows, f"{base}/{part}_predictions.csv", "csv")
    got = readers.predictions(spark, f"{base}/*_predictions.csv", age_group="all")
    return rounded(got.select("department", "date", "actual", "predicted", "model"), "actual", "predicted")


@query(I.sql(NAIVE, f"SELECT department, CAST(h AS BIGINT) AS h, 'mae' AS metric, {r('avg(abs(actual - predicted))', 'value')} FROM pts GROUP BY 1, 2"))
def report_files(spark, d):
    """One JSON report for each department, read back as rows."""
    scored = evaluate.by_horizon(naive_points(spark, d), DEPT)
    base = own(spark, "reports")
    reports = scored.groupBy("department").agg(F.map_from_entries(F.collect_list(F.struct(F.col("h").cast("string"), F.struct(*MET)))).alias("metrics_by_horizon"))
    reports = reports.select("department", F.lit("all").alias("age_group"), F.lit("naive").alias("model"), "metrics_by_horizon")
    sinks.json_reports(reports, base)
    got = readers.horizon_metrics(spark, base).where("metric = 'mae'")
    return rounded(longs(got.select("department", "h", "metric", "value"), "h"), "value")


@query(I.sql(RATES, "SELECT department FROM (SELECT department, avg(value) AS m FROM tall WHERE measure = 'pneumonia_under5_rate' GROUP BY 1) ORDER BY m DESC, department LIMIT 3"))
def top_ranked(spark, d):
    mean = tall_rates(spark, d).where("measure = 'pneumonia_under5_rate'").groupBy("department").agg(panel.exact_mean("value", 2).alias("value"))
    return readers.top_names(mean, 3, F.desc("value"))


@query(I.sql(NAIVE, "SELECT CAST(h AS BIGINT) AS h, 'naive' AS model, round_even(avg(abs(actual - predicted)), 2) AS mae FROM pts WHERE h <= 2 GROUP BY 1"))
def horizon_table(spark, d):
    """The table of models by horizons, turned back into rows."""
    tall = evaluate.tall_metrics(evaluate.by_horizon(naive_points(spark, d).withColumn("model", F.lit("naive")), ["model"]), ["model", "h"])
    wide = evaluate.horizon_table(tall.where("metric = 'mae'"), (1, 2), ("mae",))
    out = wide.unpivot(["model"], ["h=1 mae", "h=2 mae"], "h", "mae")
    return out.select(F.regexp_extract("h", "[0-9]+", 0).cast("long").alias("h"), "model", "mae")


@query()
def arima_outliers(spark, d):
    return outliers.extreme_residuals(models.residuals(I.clean(spark, d), DEPT, "week_start", "cases"), DEPT)


@query()
def residual_diagnostics(spark, d):
    return rounded(models.diagnosed(I.clean(spark, d), DEPT, "week_start", "cases"), *models.DIAGNOSTICS)


@query()
def stl(spark, d):
    return models.decomposed(I.clean(spark, d), DEPT, "week_start", "cases", 52)


@query()
def random_forest(spark, d):
    m = trees.fit(I.clean(spark, d), DEPT, "week_start", "cases")
    return trees.forecast(m, I.clean(spark, d), DEPT, "week_start", "cases", 4)


@query()
def gbt(spark, d):
    m = trees.fit(I.clean(spark, d), DEPT, "week_start", "cases", "gbt")
    return trees.forecast(m, I.clean(spark, d), DEPT, "week_start", "cases", 4)


@query()
def tuning(spark, d):
    rows = series.temporal_split(I.clean(spark, d), DEPT, "week_start", least=1)
    train, val = rows.where("split = 'train'").drop("split"), rows.where("split = 'val'").drop("split")
    _, trials = trees.tuned(train, val, DEPT, "week_start", "cases", {"maxDepth": [3, 5]})
    return spark.createDataFrame([(p["maxDepth"], float(s) if s is not None else None) for p, s in trials], "max_depth int, mae double")


@query()
def train_pipeline(spark, d):
    rows = training.held_out(I.clean(spark, d), DEPT, "week_start", "cases", "sarima", least=1)
    return rounded(training.scores(rows, DEPT), *MET)


def region_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Weekly series by region on a whole grid, naive rolling-origin backtest, metrics by horizon."""
    k = ["region"]
    c = series.weekly_clean(I.weekly(spark, d, "region"), k, "week_start", "cases")
    return evaluate.by_horizon(evaluate.backtest(c, k, "week_start", "cases", 52, 4, 4), k)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files, learning  # noqa: F401  register their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import files, learning  # noqa: F401

    return dict(_sql)
