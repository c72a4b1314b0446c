"""Panel operators: sums, rates, ranks, profiles, reshaping. Each is one lazy plan over all keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number, padded, rate, stripped
from ..sources.readers import COUNTS
from .quantiles import quantiles

MEASURES = ("cases_rate_men5", "cases_rate_60mas", "hosp_rate_men5", "hosp_rate_60mas", "death_rate_men5", "death_rate_60mas")
START_YEAR, START_OLDER, TOP_K = 2000, 2006, 3


def standardized(df: DataFrame) -> DataFrame:
    """Names normalised, id padded, year an int with 0 for what cannot be read, the region from the first name there is."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    names = [c for c in ("department", "departamento", "iddpto") if c in df.columns]
    if not names:
        raise ValueError("no region column")
    out = df.withColumn("region", F.coalesce(*[stripped(F.col(c)) for c in names])).withColumn("year", number(F.col("year"), 0).cast("int"))
    return out.withColumn("iddpto", padded(F.col("iddpto"))) if "iddpto" in df.columns else out


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    found = [m for m in wanted if m in df.columns]
    if not found:
        raise ValueError("none of the measures is there")
    return found


def years_between(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    return df.where(F.col(year).between(first, last))


def start_year(measure: Column) -> Column:
    """First year of a measure: the older group's counts begin later."""
    return F.when(measure.startswith("older_") | measure.endswith("_60mas"), F.lit(START_OLDER)).otherwise(F.lit(START_YEAR))


def annual_sums(df: DataFrame, keys: Sequence[str] = ("iddpto", "year"), counts: Sequence[str] = COUNTS) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def with_rates(df: DataFrame, counts: Sequence[str], population: str = "population", digits: int | None = None, suffix: str = "_rate") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": rate(F.col(c), F.col(population), digits=digits) for c in counts})


def annual_rates(sums: DataFrame, population: DataFrame, keys: Sequence[str] = ("iddpto", "year"), counts: Sequence[str] = COUNTS) -> DataFrame:
    """Counts and rates of the key-years that have a population; 2 digits, half to even."""
    return with_rates(sums.join(population, list(keys), "inner"), counts, digits=2)


def national_rates(df: DataFrame, counts: Sequence[str], by: Sequence[str] = ("year",)) -> DataFrame:
    """Ratio of sums over all keys, not the mean of their ratios."""
    return with_rates(df.groupBy(*by).agg(F.sum("population").alias("population"), *[F.sum(c).alias(c) for c in counts]), counts)


def incidence(cases: DataFrame, population: DataFrame, on: Sequence[str], value: str = "cases") -> DataFrame:
    """Cases with the population of their key and year, and the rate; rows without a population go."""
    return cases.join(population, list(on), "inner").withColumn("incidence", rate(F.col(value), F.col("population")))


def monthly(cases: DataFrame, population: DataFrame, keys: Sequence[str] = (), value: str = "cases") -> DataFrame:
    """Month sums and incidence by ``keys``; without keys the national ones."""
    sums = cases.groupBy(*keys, "year", "month").agg(F.sum(value).alias(value))
    people = population.groupBy(*keys, "year").agg(F.sum("population").alias("population"))
    return incidence(sums, people, [*keys, "year"], value)


def month_profile(df: DataFrame, value: str = "incidence", digits: int = 3) -> DataFrame:
    v = F.col(value)
    rest = df.groupBy("month").agg(*[F.bround(f(v), digits).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    middle = quantiles(df, value, {"median": 0.5}, ["month"]).select("month", F.bround("median", digits).alias("median"))
    return rest.join(middle, "month", "left").select("month", "mean", "median", "std", "min", "max")


def month_quartiles(df: DataFrame, value: str = "incidence") -> DataFrame:
    return quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["month"])


def mean_by(df: DataFrame, by: Sequence[str], value: str = "incidence") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def rank_within(df: DataFrame, value: str, by: Sequence[str] = ("year",)) -> DataFrame:
    """1 for the highest value of each group; ties share the best rank; rows without a value go."""
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value))))


def long_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str = "measure", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(list(ids), list(measures), name, value)


def ranks(df: DataFrame, measures: Sequence[str] = MEASURES, region: str = "department") -> DataFrame:
    """(region, year, measure, value, rank) of all measures in one window."""
    tall = long_measures(df, [region, "year"], available(df, measures))
    return rank_within(tall.where(F.col("year") >= start_year(F.col("measure"))), "value", ["measure", "year"])


def top_frequency(ranked: DataFrame, k: int = TOP_K, region: str = "department", by: Sequence[str] = ()) -> DataFrame:
    """In how many years each region is among the first k, and the share of all years there are."""
    years = ranked.groupBy(*by).agg(F.count_distinct("year").alias("n_years"))
    hits = ranked.groupBy(*by, region).agg(F.count_if(F.col("rank") <= k).alias("top_years"))
    joined = hits.join(years, list(by)) if by else hits.crossJoin(F.broadcast(years))
    return joined.withColumn("percent", F.bround(F.col("top_years") / F.col("n_years") * 100, 1))


def rank_grid(ranked: DataFrame, years: Sequence[int], region: str = "department") -> DataFrame:
    """One row for each region, one column for each year; a region and year that repeat raise when run."""
    once = F.when(F.count("rank") > 1, F.raise_error(F.lit("region and year repeat"))).otherwise(F.max("rank"))
    return ranked.groupBy(region).pivot("year", list(years)).agg(once)


def month_grid(df: DataFrame, value: str = "incidence", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.avg(value))


def top_groups(df: DataFrame, value: str, n: int, key: str = "department") -> DataFrame:
    """Rows of the ``n`` groups of highest mean; ties by name."""
    best = df.groupBy(key).agg(F.avg(value).alias("__mean")).orderBy(F.desc("__mean"), key).limit(n).select(key)
    return df.join(F.broadcast(best), key, "left_semi")


def exact_mean(value: str, digits: int) -> Column:
    """Mean of values that have ``digits`` digits after the point: sums of whole units do not depend on the order of rows, so equal means are equal."""
    return F.sum(F.round(F.col(value) * 10 ** digits).cast("long")) / F.count(value) / 10 ** digits


def top_of_each(df: DataFrame, measure: str, key: str, value: str, n: int, digits: int | None = None) -> DataFrame:
    """Rows of the ``n`` keys of highest mean within each measure, ties by name; the means are few, so only they are ranked.

    With ``digits``, as many as the values have, means are exact; sums of doubles tell equal means apart by the order of their rows.
    """
    mean = df.where(F.col(value).isNotNull()).groupBy(measure, key).agg((F.avg(value) if digits is None else exact_mean(value, digits)).alias("__mean"))
    place = F.row_number().over(Window.partitionBy(measure).orderBy(F.desc("__mean"), key))
    return df.join(mean.withColumn("__place", place).where(F.col("__place") <= n).select(measure, key), [measure, key], "left_semi")


def enough_rows(df: DataFrame, value: str, least: float = 10, rows: int = 10, key: str = "department") -> DataFrame:
    """Rows of at least ``least``, of the groups that keep at least ``rows`` of them."""
    kept = df.where(F.col(value) >= least)
    return kept.join(kept.groupBy(key).count().where(F.col("count") >= rows).select(key), key, "left_semi").select(*df.columns)


def available_keys(df: DataFrame, least: int = 104, key: str = "department", week: str = "week_start") -> DataFrame:
    """Keys that have ``least`` distinct weeks."""
    return df.groupBy(key).agg(F.count_distinct(week).alias("weeks")).where(F.col("weeks") >= least)


def quality_report(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """One row: keys, span, nulls, values not above zero."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
                  F.count_if(F.col(value).isNull()).alias("n_null"), F.count_if(F.col(value) <= 0).alias("n_not_positive"), F.min(value).alias("least"), F.max(value).alias("most"))


def completeness(df: DataFrame) -> DataFrame:
    """Share of cells that hold a value, in percent."""
    nulls = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns), F.lit(0))
    return df.agg(((1 - F.try_divide(nulls, F.count("*") * len(df.columns))) * 100).alias("percent"))


def census_long(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Year columns (all digits) as rows, the values as numbers."""
    years = [c for c in df.columns if c.isdigit()]
    tall = df.select(*ids, *[number(F.col(f"`{c}`")).alias(c) for c in years]).unpivot(list(ids), years, "year", "population")
    return tall.withColumn("year", F.col("year").cast("int"))


def age_groups_long(df: DataFrame, keys: Sequence[str], groups: dict[str, str]) -> DataFrame:
    """One row for each age group; ``groups`` maps its name to its count column."""
    named = df.select(*keys, *[F.col(c).cast("double").alias(g) for g, c in groups.items()])
    return named.unpivot(list(keys), list(groups), "age_group", "cases")


def levels(df: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str], **aggregates: Column) -> DataFrame:
    """(columns, level, aggregates): several granularities from one pass; ``level`` names the columns that a row is grouped by, the others are null in it."""
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id(*columns).alias("__id"), *[a.alias(n) for n, a in aggregates.items()])
    name = F.concat_ws(",", *[F.when(F.col("__id").bitwiseAND(F.lit(1 << (len(columns) - 1 - i))) == 0, F.lit(c)) for i, c in enumerate(columns)])
    return out.withColumn("level", name).drop("__id").select(*columns, "level", *aggregates)


def annual_workflow(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """National and departmental counts, population, rates per 100 000 and their change on the year before, in percent, of rows (department, year, population, counts); one scan."""
    wide = levels(df, [["year"], ["department", "year"]], ["department", "year"], population=F.sum("population"), **{c: F.sum(c) for c in counts})
    rates = with_rates(wide, counts)
    w = Window.partitionBy("department", "level").orderBy("year")
    return rates.withColumns({f"{c}_change": (F.try_divide(F.col(f"{c}_rate"), F.lag(f"{c}_rate").over(w)) - 1) * 100 for c in counts})


def seasonality_workflow(df: DataFrame, value: str = "incidence") -> DataFrame:
    """Mean, deviation and extremes of ``value`` by month, by year and month, by department and month, and by year, of rows (department, year, month, value); one scan."""
    v = F.col(value)
    return levels(df, [["month"], ["year", "month"], ["department", "month"], ["year"]], ["department", "year", "month"], n=F.count(v), mean=F.avg(v), std=F.stddev_samp(v), least=F.min(v), most=F.max(v))
