"""Linear regression of every key by aggregates: Gram matrices as mergeable sums, solved by Cholesky in array functions.

A row with features x and target y adds x_i * (x, y) to row i of its key's matrix, so a key may have any length and be read in any number of
tasks; nothing of it is gathered but the matrix. Rows that lack a feature or the target are left out. A feature that those before it explain gets 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import WEEKS_PER_YEAR
from .evaluate import origins
from .series import by_time, with_position

#: Public holidays of Peru by month and day, and days from Easter Sunday (fixed values).
HOLIDAYS = ((1, 1), (5, 1), (6, 29), (7, 28), (7, 29), (8, 30), (10, 8), (11, 1), (12, 8), (12, 25))
EASTER_DAYS = (-3, -2)
NEGLIGIBLE = 1e-10  #: share of a feature that is left when it counts as explained
DROPPED = 1e150


def doubles(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of the same length; 0 for empty ones."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def products(df: DataFrame, keys: Sequence[str], x: Sequence[Column], y: Column) -> DataFrame:
    """(keys, i, s): row i of the Gram matrix of the features and, as the last, the target; rows of zeros are absent."""
    row = F.array(*[c.cast("double") for c in (*x, y)])
    whole = df.select(*keys, row.alias("__f")).where(~F.exists("__f", lambda v: v.isNull() | F.isnan(v)))
    each = whole.select(*keys, "__f", F.posexplode("__f").alias("i", "__x")).where("__x <> 0")
    sums = each.groupBy(*keys, "i").agg(*[F.sum(F.col("__x") * F.col("__f")[j]).alias(f"__s{j}") for j in range(len(x) + 1)])
    return sums.select(*keys, "i", F.array(*[f"__s{j}" for j in range(len(x) + 1)]).alias("s"))


def matrices(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """(keys, a): the whole matrix, p features and the target, of ``rows(keys, i, s)``."""
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), p + 1)
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(p)), lambda i: F.coalesce(F.try_element_at("m", i), zeros)).alias("a"))


def cholesky(a: Column, p: int, penalty: Sequence[float] | None = None) -> Column:
    """Rows of the lower triangle of the bordered matrix; its last row holds z, and the root of the squared errors at its end."""
    extra = doubles(*(penalty or [0.0] * p), 0.0)

    def row(lower: Column, i: Column) -> Column:
        def entry(r: Column, j: Column) -> Column:
            other = F.when(j < i, F.slice(F.get(lower, j), 1, j)).otherwise(r)
            rest = F.get(F.get(a, i), j) - dot(r, other)
            own = F.get(F.get(a, i), i) + F.get(extra, i)
            pivot = rest + F.get(extra, i)
            square = F.when((i < p) & (pivot <= own * NEGLIGIBLE), F.lit(DROPPED)).otherwise(F.sqrt(F.greatest(pivot, F.lit(0.0))))
            return F.concat(r, F.array(F.when(j < i, rest / F.get(F.get(lower, j), j)).otherwise(square)))

        return F.aggregate(F.sequence(F.lit(0), i), doubles(), entry)

    none = F.array().cast("array<array<double>>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(p)), none, lambda lower, i: F.concat(lower, F.array(row(lower, i))))


def backward(lower: Column, p: Column | int) -> Column:
    """Coefficients of the first p features from the triangle."""
    p = F.lit(p) if isinstance(p, int) else p
    z = F.element_at(lower, -1)

    def before(x: Column, i: Column) -> Column:
        known = F.aggregate(F.transform(x, lambda v, m: v * F.get(F.get(lower, i + 1 + m), i)), F.lit(0.0), lambda s, v: s + v)
        return F.concat(F.array((F.get(z, i) - known) / F.get(F.get(lower, i), i)), x)

    return F.when(p > 0, F.aggregate(F.reverse(F.sequence(F.lit(0), p - 1)), doubles(), before)).otherwise(doubles())


def solved(rows: DataFrame, keys: Sequence[str], p: int, penalty: Sequence[float] | None = None) -> DataFrame:
    """(keys, n, beta, sse, lower) of Gram rows whose first feature is the constant. With a ``penalty`` of squares sse holds it too."""
    made = matrices(rows, keys, p).withColumn("lower", cholesky(F.col("a"), p, penalty))
    last = F.element_at(F.element_at("lower", -1), -1)
    return made.select(*keys, F.col("a")[0][0].cast("long").alias("n"), backward(F.col("lower"), p).alias("beta"), (last * last).alias("sse"), "lower")


def fitted(df: DataFrame, keys: Sequence[str], x: Sequence[Column], y: Column, penalty: Sequence[float] | None = None) -> DataFrame:
    """(keys, n, beta, sse, sigma, r2, aic, bic) of the regression of y on a constant and the features x; beta has the constant first.

    sigma divides by the degrees of freedom; r2 and the criteria are null where they are not defined.
    """
    p = len(x) + 1
    out = solved(products(df, keys, [F.lit(1.0), *x], y), keys, p, [0.0, *penalty] if penalty else None)
    n, mse = F.col("n").cast("double"), F.col("sse") / F.col("n")
    square = F.transform(F.element_at("lower", -1), lambda v: v * v)
    spread = F.aggregate(F.slice(square, 2, p), F.lit(0.0), lambda s, v: s + v)  # of y about its mean
    likely = n * F.ln(F.when(mse > 0, mse))
    return out.select(*keys, "n", "beta", "sse", F.sqrt(F.try_divide("sse", F.when(n > p, n - p))).alias("sigma"), (1 - F.try_divide("sse", F.when(spread > 0, spread))).alias("r2"),
                      (likely + 2 * p).alias("aic"), (likely + F.lit(p) * F.ln(n)).alias("bic"))


def applied(rows: DataFrame, fits: DataFrame, keys: Sequence[str], x: Sequence[Column], out: str = "predicted") -> DataFrame:
    """``rows`` with the value that their key's regression gives their features; keys without one have none."""
    known = fits.select(*keys, F.col("beta").alias("__beta"))
    line = dot(F.col("__beta"), F.array(F.lit(1.0), *[c.cast("double") for c in x]))
    return rows.join(known, list(keys), "left").withColumn(out, line).drop("__beta")


# --- features ------------------------------------------------------------------------------

def fourier(at: Column, pairs: int, period: float = WEEKS_PER_YEAR) -> list[Column]:
    """Sines and cosines of the place ``at``."""
    angle = lambda k: at.cast("double") * F.lit(2 * math.pi * k / period)
    return [F.sin(angle(k)) for k in range(1, pairs + 1)] + [F.cos(angle(k)) for k in range(1, pairs + 1)]


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (the anonymous rule of 1876)."""
    part = lambda x, n: F.floor(x / n)
    a, b, c = year % 19, part(year, 100), year % 100
    h = (19 * a + b - part(b, 4) - part(b - part(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * part(c, 4) - h - c % 4) % 7
    m = part(a + 11 * h + 22 * k, 451)
    day = h + k - 7 * m + 114
    return F.make_date(year, part(day, 31).cast("int"), (day % 31 + 1).cast("int"))


def holidays(week: Column) -> list[Column]:
    """1 in the week from the date ``week`` that holds the holiday, a column for each."""
    def held(day: Callable[[Column], Column]) -> Column:
        within = [F.datediff(day(y), week).between(0, 6) for y in (F.year(week), F.year(F.date_add(week, 6)))]
        return (within[0] | within[1]).cast("double")

    fixed = [held(lambda y, m=m, d=d: F.make_date(y, F.lit(m), F.lit(d))) for m, d in HOLIDAYS]
    return fixed + [held(lambda y, d=d: F.date_add(easter(y), d)) for d in EASTER_DAYS]


def hinges(share: Column, changes: int, until: float = 0.8) -> list[Column]:
    """Changes of slope at even places of the first ``until`` of the past."""
    return [F.greatest(F.lit(0.0), share - until * k / (changes + 1)) for k in range(1, changes + 1)]


# --- models ----------------------------------------------------------------------------------

class Additive:
    """Trend with shrunken changes of slope, yearly season and holidays: its features and the squares that shrink them (the posterior mode of Taylor and Letham's model under normal priors).

    ``share`` is the place as a share of the past that is fitted, ``at`` the place itself, ``week`` its date; the target is divided by ``scale``.
    """

    def __init__(self, changes: int = 25, pairs: int = 10, change_scale: float = 0.05, season_scale: float = 10.0, holiday_scale: float = 10.0):
        self.changes, self.pairs = changes, pairs
        prior = lambda s, n: [0.01 / s**2] * n
        self.penalty = [1e-9, *prior(change_scale, changes), *prior(season_scale, 2 * pairs), *prior(holiday_scale, len(HOLIDAYS) + len(EASTER_DAYS))]

    def features(self, share: Column, at: Column, week: Column) -> list[Column]:
        return [share, *hinges(share, self.changes), *fourier(at, self.pairs), *holidays(week)]


def additive_fitted(df: DataFrame, keys: Sequence[str], t: str, value: str, model: Additive | None = None) -> DataFrame:
    """(keys, n, first, beta, sigma): the additive model of every key's whole past; beta is in units of the value."""
    model = model or Additive()
    names = list(keys)
    spans = df.where(F.col(value).isNotNull()).groupBy(*names).agg(F.min(t).alias("first"), F.max(t).alias("__last"), F.greatest(F.max(F.abs(value)), F.lit(1e-9)).alias("__scale"))
    spans = spans.withColumn("n", (F.datediff("__last", "first") / 7 + 1).cast("long"))
    at = F.datediff(t, "first") / 7
    rows = df.join(spans, names)
    got = fitted(rows.withColumn("__y", F.col(value) / F.col("__scale")), names, model.features(at / F.col("n"), at, F.col(t)), F.col("__y"), model.penalty)
    # The constant is free, so errors have mean 0; the triangle's squared errors hold what shrinks beta, too.
    pulls = dot(F.transform("beta", lambda b: b * b), doubles(0.0, *model.penalty))
    sigma = F.col("__scale") * F.sqrt(F.greatest(F.lit(0.0), F.col("sse") - pulls) / F.col("__rows"))
    known = spans.join(got.select(*names, F.col("n").alias("__rows"), "beta", "sse"), names)
    return known.select(*names, "n", "first", F.transform("beta", lambda b: b * F.col("__scale")).alias("beta"), sigma.alias("sigma"))


def additive_forecast(df: DataFrame, keys: Sequence[str], t: str, value: str, horizon: int, level: float = 0.95, model: Additive | None = None) -> DataFrame:
    """(keys, h, date, predicted, lower, upper) after each key's last week, none below 0; as wide as ``level`` of the errors, wider with the distance."""
    model = model or Additive()
    names = list(keys)
    fits = additive_fitted(df, names, t, value, model)
    weeks = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("__at", F.col("n") - 1 + F.col("h"))
    weeks = weeks.withColumn("date", F.date_add("first", (F.col("__at") * 7).cast("int")))
    line = dot(F.col("beta"), F.array(F.lit(1.0), *model.features(F.col("__at") / F.col("n"), F.col("__at"), F.col("date"))))
    return banded(weeks.withColumn("__p", line), names, F.col("sigma") * F.sqrt(1 + (F.col("h") - 1) / F.col("n")), level)


def banded(rows: DataFrame, keys: Sequence[str], sigma: Column, level: float) -> DataFrame:
    """Point ``__p`` of each (keys, h, date) with the ends of its interval, all at least 0."""
    from statistics import NormalDist

    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    low = lambda c: F.greatest(F.lit(0.0), c)
    return rows.select(*keys, "h", "date", low(F.col("__p")).alias("predicted"), low(F.col("__p") - z * sigma).alias("lower"), low(F.col("__p") + z * sigma).alias("upper"))


def running(parts: DataFrame, keys: Sequence[str], tes: DataFrame, width: int) -> DataFrame:
    """(keys, te, i, s): at each origin of ``tes(keys, tes)`` the sum of Gram rows ``parts(keys, te, i, s)`` of it and all before it."""
    every = parts.select(*keys, "i").distinct().join(tes, list(keys)).select(*keys, "i", F.explode("tes").alias("te"))
    so_far = Window.partitionBy(*keys, "i").orderBy("te").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.coalesce(F.sum(F.col("s")[j]).over(so_far), F.lit(0.0)) for j in range(width)]
    return every.join(parts, [*keys, "i", "te"], "left").select(*keys, "te", "i", F.array(*sums).alias("s"))


def walkforward(df: DataFrame, keys: Sequence[str], t: str, value: str, features: Callable[[Column], list[Column]], train: int | str, horizon: int = 4, step: int = 4, penalty: Sequence[float] | None = None) -> DataFrame:
    """(keys, te, h, date, actual, predicted): a regression on ``features(place)`` fitted at every rolling origin, all origins in one plan.

    A row's products go to the first origin that knows it; the matrices of later origins are running sums of those, so every row is read once whatever the
    number of origins. Places count from 0.
    """
    names = list(keys)
    numbered = with_position(df.select(*names, F.col(t).alias("date"), F.col(value).cast("double").alias("actual")), names, "date")
    points = origins(numbered, names, "date", train, horizon, step)
    tes = points.where("h = 1").groupBy(*names).agg(F.sort_array(F.collect_list("te")).alias("tes"))
    known = numbered.join(tes, names).withColumn("te", F.get(F.filter("tes", lambda e: e >= F.col("i")), F.lit(0))).where("te is not null")
    x = [F.lit(1.0), *features(F.col("i") - 1)]
    parts = products(known, [*names, "te"], x, F.col("actual"))
    run = running(parts, names, tes, len(x) + 1)
    fits = solved(run, [*names, "te"], len(x), penalty)
    ahead = points.withColumn("i", F.col("te") + F.col("h")).join(numbered, [*names, "i"])
    return applied(ahead, fits, [*names, "te"], x[1:]).select(*names, "te", "h", "date", "actual", "predicted")


# --- unit roots ----------------------------------------------------------------------------------

#: Response surface of the Dickey-Fuller statistic with a constant (MacKinnon, 1994; fixed values): beyond ``MOST`` the p-value is 1, below ``LEAST`` 0;
#: up to ``BEND`` the first polynomial gives the normal quantile, above it the second.
BEND, LEAST, MOST = -1.61, -18.83, 2.74
LOW_SURFACE = (2.1659, 1.4412, 0.038269)
HIGH_SURFACE = (1.7339, 0.93202, -0.12745, -0.010368)


def normal_probability(z: Column) -> Column:
    """The standard normal distribution function by a rational approximation of the error function (Abramowitz and Stegun 7.1.26; fixed values), to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    u = 1 / (1 + 0.3275911 * x)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def unit_root_p(tau: Column) -> Column:
    """Approximate p-value of a Dickey-Fuller statistic with a constant."""
    poly = lambda c: sum((F.lit(v) * F.pow(tau, F.lit(float(k))) for k, v in enumerate(c)), F.lit(0.0))
    inside = normal_probability(F.when(tau <= BEND, poly(LOW_SURFACE)).otherwise(poly(HIGH_SURFACE)))
    return F.when(tau.isNull() | F.isnan(tau), F.lit(None)).when(tau > MOST, F.lit(1.0)).when(tau < LEAST, F.lit(0.0)).otherwise(inside)


def unit_root(df: DataFrame, keys: Sequence[str], t: str, value: str, most: int | None = None) -> DataFrame:
    """(keys, n, lag, statistic, p_value, stationary): the augmented Dickey-Fuller test with a constant, its lag chosen by AIC.

    Differences are regressed on the level before, a constant and lagged differences. One matrix with all lags up to ``most`` (by default
    12 * (n / 100)^(1/4) of the longest series, fewer for shorter ones) gives the squared errors of every smaller number of lags, as the models are nested: the triangle's last row has
    what each feature explains. The chosen lags are then fitted on all rows that have them. ``n`` is the number of those; null statistics where a series is too short.
    """
    names = list(keys)
    own = df.where(F.col(value).isNotNull()).select(*names, F.col(t).alias("__t"), F.col(value).cast("double").alias("__v"))
    if most is None:
        longest = own.groupBy(*names).count().agg(F.max("count")).first()[0] or 1
        most = math.ceil(12 * (longest / 100) ** 0.25)
    w = by_time(names, "__t")
    rows = own.withColumns({"__n": F.count("*").over(Window.partitionBy(*names)).cast("double"), "__before": F.lag("__v").over(w)}).withColumn("__d", F.col("__v") - F.col("__before"))
    rows = rows.withColumns({f"__d{k}": F.lag("__d", k).over(w) for k in range(1, most + 1)})
    limit = F.least(F.lit(float(most)), F.ceil(12 * F.pow(F.col("__n") / 100, F.lit(0.25))), F.greatest(F.lit(0.0), F.floor(F.col("__n") / 2) - 2)).cast("int")
    rows = rows.withColumn("__most", limit)
    x = lambda upto: [F.lit(1.0), F.col("__before"), *[F.when(upto >= k, F.col(f"__d{k}")).otherwise(F.lit(0.0)) for k in range(1, most + 1)]]

    # The errors of 2 + k features are y'y less what the first 2 + k explain.
    all_lags = matrices(products(rows, [*names, "__most"], x(F.col("__most")), F.col("__d")), [*names, "__most"], most + 2).withColumn("__l", cholesky(F.col("a"), most + 2))
    total, n = F.get(F.element_at("a", -1), F.lit(most + 2)), F.col("a")[0][0]
    sse = lambda k: total - F.aggregate(F.transform(F.slice(F.element_at("__l", -1), F.lit(1), k + 2), lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    score = lambda k: F.struct((n * F.ln(F.greatest(sse(k), F.lit(1e-300)) / n) + 2 * (k + 2)).alias("aic"), k.alias("lag"))
    chosen = all_lags.where(n > 0).select(*names, F.array_min(F.transform(F.sequence(F.lit(0), F.col("__most")), score))["lag"].alias("lag"))

    # The level goes last, so that its own pivot is what the other features leave of it.
    again = rows.join(chosen, names)
    last = x(F.col("lag"))
    got = solved(products(again, [*names, "lag"], [last[0], *last[2:], last[1]], F.col("__d")), [*names, "lag"], most + 2)
    left = F.get(F.get("lower", F.lit(most + 1)), F.lit(most + 1))
    free = F.col("n") - 2 - F.col("lag")
    tau = F.when((left < DROPPED) & (free > 0) & (F.col("sse") > 0), F.get("beta", F.lit(most + 1)) * left / F.sqrt(F.col("sse") / free))
    out = got.select(*names, "n", "lag", tau.alias("statistic"))
    return out.withColumn("p_value", unit_root_p(F.col("statistic"))).withColumn("stationary", F.col("p_value") < 0.05)
