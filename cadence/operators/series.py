"""Series operators: regular grids, gap filling, lags, rolling statistics, features, scaling and splits.

A series frame has key columns, a date column and a value; each operator shares
one window specification by key, so a single sort serves all its frames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import WEEKS_PER_YEAR, week_angle

MIN_TRAIN = 104
RELIABLE_FROM = {"MOQUEGUA": 2008, "TACNA": 2007, "TUMBES": 2007}


def by_time(keys: Sequence[str], t: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(t)


def with_position(df: DataFrame, keys: Sequence[str], t: str, name: str = "i") -> DataFrame:
    """Row number of each series from 1."""
    return df.withColumn(name, F.row_number().over(by_time(keys, t)))


def year_grid(df: DataFrame, keys: Sequence[str], first: int, last: int, year: str = "year") -> DataFrame:
    """Every key with every year; the known values joined on."""
    grid = df.select(*keys).distinct().withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(df, [*keys, year], "left")


def date_grid(df: DataFrame, keys: Sequence[str], t: str, days: int = 7, weekday: str | None = None) -> DataFrame:
    """Each series on dates ``days`` apart from its first to its last; rows off the grid are dropped.

    With ``weekday`` ("MON") the grid starts at the first such day of the series, so a series kept on other days has no values on it.
    Dates that repeat in a series are kept as they are; aggregate first.
    """
    span = df.groupBy(*keys).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    if weekday is not None:
        span = span.withColumn("lo", F.next_day(F.date_sub("lo", 1), weekday)).where("lo <= hi")
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(f"interval {int(days)} days"))).alias(t))
    return grid.join(df, [*keys, t], "left")


def interpolated(df: DataFrame, keys: Sequence[str], t: str, value: str, edges: str = "both", out: str | None = None) -> DataFrame:
    """Linear by row position. Edges: ``both`` repeats the nearest value, ``forward`` only the last one."""
    if edges not in ("both", "forward"):
        raise ValueError("edges must be both or forward")
    w = by_time(keys, t)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col("__i"))
    df = df.withColumn("__i", F.row_number().over(w))
    pv, pi = F.last(value, True).over(back), F.last(known, True).over(back)
    nv, ni = F.first(value, True).over(ahead), F.first(known, True).over(ahead)
    line = pv + (nv - pv) * (F.col("__i") - pi) / F.nullif(ni - pi, F.lit(0))
    filled = F.coalesce(F.col(value), line, pv, *([nv] if edges == "both" else []))
    return df.withColumn(out or value, filled).drop("__i")


def filled(df: DataFrame, keys: Sequence[str], t: str, value: str, method: str = "interpolate") -> DataFrame:
    """Missing values by ``interpolate``, ``ffill`` (then backwards) or ``bfill`` (then forwards); 0 where a series has none."""
    if method == "interpolate":
        out = interpolated(df, keys, t, value)
        return out.withColumn(value, F.coalesce(value, F.lit(0.0)))
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown method {method}")
    w = by_time(keys, t)
    last = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    order = (last, first) if method == "ffill" else (first, last)
    return df.withColumn(value, F.coalesce(*order, F.lit(0.0)))


def weekly_clean(raw: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Sums by key and week on the 7-day grid of each series, gaps interpolated."""
    sums = raw.groupBy(*keys, t).agg(F.sum(value).alias(value))
    return interpolated(date_grid(sums, keys, t), keys, t, value)


def lagged(df: DataFrame, keys: Sequence[str], t: str, value: str, lags: Sequence[int]) -> DataFrame:
    w = by_time(keys, t)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def rolling(df: DataFrame, keys: Sequence[str], t: str, value: str, windows: Sequence[int]) -> DataFrame:
    """Mean and sample deviation of the ``n`` rows strictly before each row; null until ``n`` values are there."""
    out = {}
    for n in windows:
        w = by_time(keys, t).rowsBetween(-n, -1)
        full = F.count(value).over(w) == n
        out[f"rolling_mean_{n}"] = F.when(full, F.avg(value).over(w))
        out[f"rolling_std_{n}"] = F.when(full, F.stddev_samp(value).over(w))
    return df.withColumns(out)


def smoothed(df: DataFrame, keys: Sequence[str], t: str, value: str, n: int = 3, out: str = "smoothed") -> DataFrame:
    """Trailing mean of up to ``n`` rows, the current one included."""
    return df.withColumn(out, F.avg(value).over(by_time(keys, t).rowsBetween(-(n - 1), 0)))


def calendar(df: DataFrame, t: str, keys: Sequence[str], period: float = WEEKS_PER_YEAR) -> DataFrame:
    """ISO week with its sine and cosine over a year of ``period`` weeks, month, quarter and the position from 0."""
    if not keys:
        raise ValueError("keys are needed: positions of one series only would be numbered in one task")
    week = F.weekofyear(t)
    return df.withColumns({"week_of_year": week, "sin_week": F.sin(week_angle(week, period)), "cos_week": F.cos(week_angle(week, period)),
                           "month": F.month(t), "quarter": F.quarter(t), "trend": F.row_number().over(by_time(keys, t)) - 1})


def feature_matrix(df: DataFrame, keys: Sequence[str], t: str, value: str, lags: Sequence[int] = (1, 2, 4, 8, 13, 26, 52), windows: Sequence[int] = (4, 13, 26)) -> DataFrame:
    """Lags, rolling statistics and calendar terms of each row; rows with any of them missing go."""
    out = calendar(rolling(lagged(df, keys, t, value, lags), keys, t, value, windows), t, keys)
    return out.na.drop(subset=[value, *feature_names(lags, windows)])


def feature_names(lags: Sequence[int], windows: Sequence[int]) -> list[str]:
    return [*(f"lag_{k}" for k in lags), *(f"rolling_{s}_{n}" for n in windows for s in ("mean", "std")), "week_of_year", "sin_week", "cos_week", "month", "quarter", "trend"]


def step_features(history: Column, date: Column, trend: Column, lags: Sequence[int], windows: Sequence[int]) -> dict[str, Column]:
    """The same features for the step after an array of past values; short histories use what there is, a deviation of one value is 0."""
    out = {f"lag_{k}": F.get(history, F.size(history) - k) for k in lags}
    for n in windows:
        part = F.slice(history, F.greatest(F.lit(1), F.size(history) - n + 1), n)
        size = F.size(part).cast("double")
        mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / size
        square = F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)
        out[f"rolling_mean_{n}"] = mean
        out[f"rolling_std_{n}"] = F.when(size < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), (square - size * mean * mean) / F.nullif(size - 1, F.lit(0.0)))))
    week = F.weekofyear(date)
    return out | {"week_of_year": week, "sin_week": F.sin(week_angle(week)), "cos_week": F.cos(week_angle(week)), "month": F.month(date), "quarter": F.quarter(date), "trend": trend}


def fourier(df: DataFrame, position: str = "i", pairs: int = 6, period: float = WEEKS_PER_YEAR) -> DataFrame:
    """Sine and cosine of the first ``pairs`` harmonics of the absolute position."""
    out = {}
    for k in range(1, pairs + 1):
        out[f"sin_{k}"] = F.sin(F.col(position).cast("double") * F.lit(2 * math.pi * k / period))
        out[f"cos_{k}"] = F.cos(F.col(position).cast("double") * F.lit(2 * math.pi * k / period))
    return df.withColumns(out)


def standardized(df: DataFrame, columns: Sequence[str], train: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Columns less their training mean over their training population deviation, by key; a deviation of 0 counts as 1."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the frame: {', '.join(missing)}")
    stats = df.where(train).groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    scale = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return joined.withColumns(scale).drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def minmax(df: DataFrame, keys: Sequence[str], value: str, out: str = "scaled") -> DataFrame:
    """0 to 1 within each series; a flat series is 0. ``unscaled`` is the way back."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumns({out: F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.when(F.col(value).isNotNull(), 0.0)), "lo": lo, "hi": hi})


def unscaled(c: Column, lo: Column, hi: Column) -> Column:
    return c * (hi - lo) + lo


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, variance): population variance of each column, one pass."""
    return df.agg(*[F.var_pop(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "variance")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"p{n}") for n, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"p{n}" for n in range(len(pairs))])).alias("p")).select("p.*")


def selected(df: DataFrame, columns: Sequence[str], threshold: float, method: str = "variance") -> list[str]:
    """Columns whose variance exceeds the threshold, or that no earlier kept column is correlated with beyond it."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    if method == "variance":
        found = {r.feature: r.variance for r in variances(df, columns).collect()}
        return [c for c in columns if (found[c] or 0) > threshold]
    if method != "correlation":
        raise ValueError(f"unknown method {method}")
    bad = {r.b for r in correlations(df, columns).collect() if r.r is not None and abs(r.r) > threshold}
    return [c for c in columns if c not in bad]


def sequences(df: DataFrame, keys: Sequence[str], t: str, value: str, back: int, ahead: int) -> DataFrame:
    """Arrays of the ``back`` values before each row and of the ``ahead`` from it on, where both are whole."""
    w = by_time(keys, t)
    out = df.withColumns({"past": F.collect_list(value).over(w.rowsBetween(-back, -1)), "future": F.collect_list(value).over(w.rowsBetween(0, ahead - 1))})
    return out.where((F.size("past") == back) & (F.size("future") == ahead))


def split_by_ratio(df: DataFrame, keys: Sequence[str], t: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, least: int = MIN_TRAIN) -> DataFrame:
    """``split`` of each row by its place in its series; series with too few training rows raise when run."""
    if abs(train + val + test - 1) > 0.01:
        raise ValueError("ratios must sum to 1")
    n, i = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(by_time(keys, t))
    te = F.ceil(n * F.lit(float(train)))
    ve = te + F.ceil(n * F.lit(float(val)))
    name = F.when(i <= te, "train").when(i <= ve, "val").otherwise("test")
    return df.withColumn("split", F.when(te < least, F.raise_error(F.lit("Insufficient training data"))).otherwise(name))


def split_by_years(df: DataFrame, t: str, train: tuple[int, int], val: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """Rows of each inclusive range of years; ranges may overlap, so a row may come twice."""
    parts = [df.where(F.year(t).between(*r)).withColumn("split", F.lit(s)) for s, r in (("train", train), ("val", val), ("test", test))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def temporal_split(df: DataFrame, keys: Sequence[str], t: str, strategy: str = "dynamic", **options) -> DataFrame:
    if strategy == "dynamic":
        return split_by_ratio(df, keys, t, **options)
    if strategy == "years":
        return split_by_years(df, t, **options)
    raise ValueError(f"unknown strategy {strategy}")


def validation(df: DataFrame, keys: Sequence[str], value: str, least: int = MIN_TRAIN) -> DataFrame:
    """One row for each series: its length, nulls and negatives, whether it is long enough and whether it deserves a warning."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_null"), F.count_if(F.col(value) < 0).alias("n_negative"))
    return out.withColumns({"long_enough": F.col("n") >= least, "warns": (F.col("n_null") > 0.2 * F.col("n")) | (F.col("n_negative") > 0)})


def underreported(df: DataFrame, key: str, t: str, value: str, reliable: dict[str, int] | None = None) -> DataFrame:
    """(key, first reliable year, weeks of 0 before it) of the keys that the table of reliable years names."""
    known = RELIABLE_FROM if reliable is None else reliable
    table = df.sparkSession.createDataFrame(list(known.items()), f"{key} string, reliable_from int")
    return df.join(F.broadcast(table), key).where((F.year(t) < F.col("reliable_from")) & (F.col(value) == 0)).groupBy(key, "reliable_from").agg(F.count("*").alias("zero_weeks"))
