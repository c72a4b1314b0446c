"""Models that are folds over a key's ordered values: additive smoothing, ARMA errors, and the search for their weights as a plan.

A series is one row (keys, first, last, y) with its values in order. Candidate weights are exploded as rows, each is scored by a state machine in
``aggregate``, and the best of a key is chosen by ``min_by``; later rounds move one weight of the best by ever smaller steps. No round leaves the plan.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import let
from .evaluate import origins
from .regression import banded, fourier, products, solved
from .series import by_time, with_position

Score = Callable[[Column, list[Column]], Column]

#: First candidates of smoothing: weights of level, trend and season, and the damping of the trend.
SMOOTHING_GRID = tuple(itertools.product((0.05, 0.2, 0.5), (0.02, 0.1, 0.3), (0.05, 0.2, 0.5), (0.85, 0.95)))
SMOOTHING_STEPS = (0.1, 0.05, 0.1, 0.03)
#: First candidates of ARMA(1, 1).
ARMA_GRID = tuple(itertools.product((-0.8, -0.4, 0.0, 0.4, 0.8), repeat=2))
ARMA_STEPS = (0.2, 0.2)
EDGE = 0.98


def arrays(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """(keys, first, last, y): each series as one row, null values left out."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("date").alias("t"), F.col(value).cast("double").alias("v")))).alias("__s"))
    return rows.select(*keys, F.col("__s")[0]["t"].alias("first"), F.element_at("__s", -1)["t"].alias("last"), F.transform("__s", lambda x: x["v"]).alias("y"))


def searched(series: DataFrame, keys: Sequence[str], score: Score, grid: Sequence[Sequence[float]], steps: Sequence[float], rounds: int = 6, low: float = 0.01, high: float = EDGE) -> DataFrame:
    """``series`` with the weights ``w`` of least ``loss``: of ``grid``, then of ``rounds`` moves of one weight of the best by its step, which halves after every other round. Ties go to the earlier candidate; null losses never win."""
    rest = [c for c in series.columns if c not in keys]
    m = len(steps)

    def best(candidates: DataFrame) -> DataFrame:
        scored = candidates.withColumn("__loss", score(F.col("y"), [F.col("__c.w")[j] for j in range(m)]))
        chosen = F.min_by(F.struct("__c.w", F.col("__loss").alias("loss")), F.struct(F.coalesce("__loss", F.lit(float("inf"))).alias("a"), F.col("__c.no").alias("b")))
        return scored.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], chosen.alias("__b")).select(*keys, *rest, "__b.w", "__b.loss")

    tried = F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in grid]), lambda w, i: F.struct(w.alias("w"), i.alias("no")))
    out = best(series.withColumn("__c", F.explode(tried)))
    moves = [tuple(0.0 for _ in steps)] + [tuple(x if i == j else 0.0 for i in range(m)) for j in range(m) for x in (-1.0, 1.0)]
    for k in range(rounds):
        shifts = F.array(*[F.array(*[F.lit(x * steps[j] / 2 ** (k // 2)) for j, x in enumerate(v)]) for v in moves])
        near = F.transform(shifts, lambda v, i: F.struct(F.zip_with("w", v, lambda a, b: F.least(F.lit(high), F.greatest(F.lit(low), a + b))).alias("w"), i.alias("no")))
        out = best(out.select(*keys, *rest, F.explode(near).alias("__c")))
    return out


# --- additive smoothing with a damped trend -----------------------------------------------------

def smoothing_state(y: Column, w: list[Column], season: int) -> Column:
    """Level, trend, cycle (the next season first) and squared one-step errors after the last value; null under two seasons."""
    a, b, g, d = w
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / season
    one, two = mean(F.slice(y, 1, season)), mean(F.slice(y, season + 1, season))

    def step(s: Column, v: Column) -> Column:
        first = F.get(s["cycle"], F.lit(0))
        return let(v - (s["level"] + d * s["trend"] + first), lambda e: F.struct(
            (s["level"] + d * s["trend"] + a * e).alias("level"), (d * s["trend"] + a * b * e).alias("trend"),
            F.concat(F.slice(s["cycle"], 2, season - 1), F.array(first + g * (1 - a) * e)).alias("cycle"), (s["sse"] + e * e).alias("sse")))

    start = let(one, lambda m: F.struct(m.alias("level"), ((two - m) / season).alias("trend"), F.transform(F.slice(y, 1, season), lambda v: v - m).alias("cycle"), F.lit(0.0).alias("sse")))
    return F.when(F.size(y) >= 2 * season, F.aggregate(F.slice(y, F.lit(season + 1), F.greatest(F.lit(0), F.size(y) - season)), start, step))


def smoothed_series(series: DataFrame, keys: Sequence[str], season: int = 52, least: int = 104, grid: Sequence[Sequence[float]] = SMOOTHING_GRID, rounds: int = 6) -> DataFrame:
    """``series`` with weights ``w``, ``loss`` and the ``state`` after the last value. Series under ``least`` values have none."""
    long = series.where(F.size("y") >= max(least, 2 * season))
    found = searched(long, keys, lambda y, w: smoothing_state(y, w, season)["sse"], grid, SMOOTHING_STEPS, rounds)
    return found.withColumn("state", smoothing_state(F.col("y"), [F.col("w")[j] for j in range(4)], season))


def smoothing_forecast(df: DataFrame, keys: Sequence[str], t: str, value: str, horizon: int, season: int = 52, least: int = 104, level: float = 0.95, grid: Sequence[Sequence[float]] = SMOOTHING_GRID, rounds: int = 6) -> DataFrame:
    """(keys, h, date, predicted, lower, upper, weights): additive smoothing of every key; short series repeat their last season and have no weights."""
    return ahead(arrays(df, keys, t, value), list(keys), horizon, season, least, level, grid, rounds)


def ahead(series: DataFrame, keys: list[str], horizon: int, season: int, least: int, level: float, grid, rounds: int) -> DataFrame:
    found = smoothed_series(series, keys, season, least, grid, rounds)
    size, h = F.size("y"), F.col("h")
    damped = F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda s, k: s + F.pow(F.col("w")[3], k))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    dates = F.date_add("last", 7 * h).alias("date")
    good = found.select("*", steps).select(*keys, "h", dates, "w", (F.col("state.level") + damped * F.col("state.trend") + F.get("state.cycle", (h - 1) % season)).alias("__p"),
                                           (F.sqrt(F.col("loss") / F.greatest(F.lit(1), size - season)) * F.sqrt(1 + (h - 1) * F.col("w")[0] * F.col("w")[0])).alias("__s"))
    short = series.where((size < max(least, 2 * season)) & (size > 0)).select("*", steps, F.least(F.lit(season), size).alias("__n"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / size
    spread = let(mean(F.col("y")), lambda m: F.sqrt(mean(F.transform("y", lambda v: (v - m) * (v - m)))))
    rest = short.select(*keys, "h", dates, F.lit(None).cast("array<double>").alias("w"), F.get("y", (size - F.col("__n") + (h - 1) % F.col("__n")).cast("int")).alias("__p"), spread.alias("__s"))
    both = good.unionByName(rest)
    return banded(both, [*keys, "w"], F.col("__s"), level).withColumnRenamed("w", "weights")


def smoothing_walkforward(df: DataFrame, keys: Sequence[str], t: str, value: str, train: int | str, horizon: int = 4, step: int = 4, season: int = 52, least: int = 104, grid: Sequence[Sequence[float]] = SMOOTHING_GRID, rounds: int = 6) -> DataFrame:
    """(keys, te, h, date, actual, predicted, lower, upper): smoothing whose weights are sought anew at every rolling origin, all origins side by side."""
    names = list(keys)
    numbered = with_position(df.select(*names, F.col(t).cast("date").alias("date"), F.col(value).cast("double").alias("actual")), names, "date")
    points = origins(numbered, names, "date", train, horizon, step)
    series = arrays(numbered, names, "date", "actual").join(points.where("h = 1").select(*names, "te"), names)
    cut = series.select(*names, "te", "first", F.date_add("first", 7 * (F.col("te") - 1)).alias("last"), F.slice("y", F.lit(1), F.col("te")).alias("y"))
    got = ahead(cut, [*names, "te"], horizon, season, least, 0.95, grid, rounds).drop("date", "weights")
    actual = numbered.select(*names, "i", "date", "actual")
    return points.join(got, [*names, "te", "h"]).withColumn("i", F.col("te") + F.col("h")).join(actual, [*names, "i"]).select(*names, "te", "h", "date", "actual", "predicted", "lower", "upper")


# --- regression with ARIMA(1, 1, 1) errors ----------------------------------------------------------

def arma_state(z: Column, w: list[Column]) -> Column:
    """Last value, last error and squared errors of an ARMA(1, 1) recursion that starts from nothing."""
    phi, theta = w

    def step(s: Column, v: Column) -> Column:
        return let(v - phi * s["last"] - theta * s["error"], lambda e: F.struct(v.alias("last"), e.alias("error"), (s["sse"] + e * e).alias("sse")))

    return F.aggregate(z, F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("error"), F.lit(0.0).alias("sse")), step)


def fourier_arima(df: DataFrame, keys: Sequence[str], t: str, value: str, pairs: int = 6, moving: bool = True, grid: Sequence[Sequence[float]] = ARMA_GRID, rounds: int = 8) -> DataFrame:
    """(keys, n, last, level, beta, phi, theta, sse, z, e): regression of differences on differenced Fourier terms of the place, with ARMA(1, 1) errors.

    beta comes from a Gram matrix; phi and theta are sought as a plan, or with ``moving`` False theta is 0 and phi a quotient of two sums, both within
    ``EDGE``. ``z`` and ``e`` are the last difference and error, ``level`` the last value.
    """
    names, p = list(keys), 2 * pairs
    rows = with_position(df.where(F.col(value).isNotNull()).select(*names, F.col(t).cast("date").alias("date"), F.col(value).cast("double").alias("v")), names, "date")
    rows = rows.withColumn("__d", F.col("v") - F.lag("v").over(by_time(names, "date")))
    x = [a - b for a, b in zip(fourier(F.col("i") - 1, pairs), fourier(F.col("i") - 2, pairs))]
    ends = rows.groupBy(*names).agg(F.count("*").alias("n"), F.max("date").alias("last"), F.max_by("v", "date").alias("level"))
    if pairs:
        beta = solved(products(rows.where("__d is not null"), names, x, F.col("__d")), names, p).select(*names, "beta")
    else:
        beta = ends.select(*names, F.array().cast("array<double>").alias("beta"))
    known = F.aggregate(F.zip_with("beta", F.array(*x) if pairs else F.array().cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    left = rows.where("__d is not null").join(beta, names).select(*names, "date", (F.col("__d") - known).alias("z"))
    if moving:
        found = searched(arrays(left, names, "date", "z"), names, lambda z, w: arma_state(z, w)["sse"], grid, ARMA_STEPS, rounds, -EDGE, EDGE)
        state = arma_state(F.col("y"), [F.col("w")[0], F.col("w")[1]])
        errors = found.select(*names, F.col("w")[0].alias("phi"), F.col("w")[1].alias("theta"), state.alias("s")).select(*names, "phi", "theta", "s.sse", F.col("s.last").alias("z"), F.col("s.error").alias("e"))
    else:
        pair = left.withColumn("__b", F.lag("z").over(by_time(names, "date")))
        phi = F.least(F.lit(EDGE), F.greatest(F.lit(-EDGE), F.coalesce(F.try_divide(F.sum(F.col("z") * F.col("__b")), F.sum(F.col("__b") * F.col("__b"))), F.lit(0.0))))
        fit = pair.groupBy(*names).agg(phi.alias("phi"))
        error = F.col("z") - F.col("phi") * F.coalesce("__b", F.lit(0.0))
        errors = pair.join(fit, names).groupBy(*names).agg(F.first("phi").alias("phi"), F.lit(0.0).alias("theta"), F.sum(error * error).alias("sse"), F.max_by("z", "date").alias("z"), F.max_by(error, F.col("date")).alias("e"))
    return ends.join(beta, names).join(errors, names).select(*names, "n", "last", "level", "beta", "phi", "theta", "sse", "z", "e")


def fourier_arima_forecast(df: DataFrame, keys: Sequence[str], t: str, value: str, horizon: int, pairs: int = 6, moving: bool = True, level: float = 0.95, grid: Sequence[Sequence[float]] = ARMA_GRID, rounds: int = 8) -> DataFrame:
    """(keys, h, date, predicted, lower, upper) after each key's last week by ``fourier_arima``."""
    fits = fourier_arima(df, keys, t, value, pairs, moving, grid, rounds)
    h, phi, theta = F.col("h"), F.col("phi"), F.col("theta")
    powers = lambda upto: F.transform(F.sequence(F.lit(1), upto), lambda k: F.pow(phi, k - 1))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    rows = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add("last", 7 * h))
    moved = (phi * F.col("z") + theta * F.col("e")) * total(powers(h))
    season = total(F.zip_with("beta", F.array(*[a - b for a, b in zip(fourier(F.col("n") - 1 + h, pairs), fourier(F.col("n") - 1, pairs))]) if pairs else F.array().cast("array<double>"), lambda a, b: a * b))
    # The weight of an error k steps later: 1 + (phi + theta) (1 + phi + ... + phi^(k-1)).
    weight = lambda k: F.when(k == 0, F.lit(1.0)).otherwise(1 + (phi + theta) * total(powers(F.greatest(k, F.lit(1)))))
    spread = F.sqrt(F.col("sse") / (F.col("n") - 1)) * F.sqrt(total(F.transform(F.sequence(F.lit(0), h - 1), lambda k: weight(k) * weight(k))))
    return banded(rows.withColumn("__p", F.col("level") + moved + season), list(keys), spread, level)
