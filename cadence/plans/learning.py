"""Queries of regression by aggregates, folds, tuning and stacking over the driver's tables, with their SQL."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from ..operators import evaluate, folds, regression, stacking, tuning
from ..operators.regression import WEEKS_PER_YEAR
from . import inputs as I
from .catalogue import DEPT, NAIVE, longs, points_out, points_sql, query, r, rounded

X1 = f"(2 * pi() * (i - 1) / {WEEKS_PER_YEAR})"


def place(i):
    return i.cast("double")


# --- regression ------------------------------------------------------------------------------

@query(I.sql(I.CLEAN, f"SELECT department, count(*) AS n, {r('regr_intercept(cases, i - 1)', 'level')}, {r('regr_slope(cases, i - 1)', 'slope')}, {r('regr_syy(cases, i - 1) - regr_slope(cases, i - 1) * regr_sxy(cases, i - 1)', 'sse')}, "
             f"{r('CASE WHEN var_pop(cases) > 0 THEN regr_r2(cases, i - 1) END', 'r2')} FROM clean GROUP BY 1"))
def regression_trend(spark, d):
    """Linear trend of every department."""
    rows = I.series.with_position(I.clean(spark, d), DEPT, "week_start").withColumn("at", F.col("i") - 1)
    fit = regression.fitted(rows, DEPT, [place(F.col("at"))], F.col("cases"))
    return rounded(fit.select("department", "n", F.col("beta")[0].alias("level"), F.col("beta")[1].alias("slope"), "sse", "r2"), "level", "slope", "sse", "r2")


def cramer(a: str, by: str, of: str) -> str:
    """CTEs of the regression of ``y`` on 1, ``u`` and ``v`` of each group by Cramer's rule on centred sums; the last is ``{a}fit`` with b0, b1, b2, sse, n."""
    return f"""{a}sums AS (SELECT {by}, count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, regr_sxx(y, u) AS uu, regr_sxx(y, v) AS vv, covar_pop(u, v) * count(*) AS uv, regr_sxy(y, u) AS uy, regr_sxy(y, v) AS vy, regr_syy(y, u) AS yy FROM {of} GROUP BY {by}),
{a}slopes AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b2 FROM {a}sums),
{a}fit AS (SELECT *, my - b1 * mu - b2 * mv AS b0, yy - b1 * uy - b2 * vy AS sse FROM {a}slopes)"""


@query(I.sql(f"{I.CLEAN}, seen AS (SELECT department, cases AS y, sin{X1} AS u, cos{X1} AS v FROM clean), {cramer('', 'department', 'seen')}",
             f"SELECT department, n, {r('b0', 'level')}, {r('b1', 'sine')}, {r('b2', 'cosine')}, {r('sse', 'sse')}, {r('n * ln(sse / n) + 6', 'aic')} FROM fit"))
def regression_season(spark, d):
    """One pair of yearly Fourier terms for every department."""
    rows = I.series.with_position(I.clean(spark, d), DEPT, "week_start")
    fit = regression.fitted(rows, DEPT, regression.fourier(F.col("i") - 1, 1), F.col("cases"))
    return rounded(fit.select("department", "n", F.col("beta")[0].alias("level"), F.col("beta")[1].alias("sine"), F.col("beta")[2].alias("cosine"), "sse", "aic"), "level", "sine", "cosine", "sse", "aic")


@query(I.sql(I.CLEAN, "SELECT department, count(*) AS n, CAST(59 AS BIGINT) AS features, CAST(0 AS DOUBLE) AS gap FROM clean GROUP BY 1"))
def additive_normal_equations(spark, d):
    """The additive model's errors are at right angles to all 59 features, but for what shrinks them: the largest gap as a share of the largest value."""
    rows, model = I.clean(spark, d), regression.Additive()
    fits = regression.additive_fitted(rows, DEPT, "week_start", "cases", model)
    at = F.datediff("week_start", "first") / 7
    x = model.features(at / F.col("n"), at, F.col("week_start"))
    error = regression.applied(rows.join(fits.select("department", "first", "n"), DEPT), fits, DEPT, x).withColumn("e", F.col("cases") - F.col("predicted"))
    sums = error.groupBy("department").agg(F.count("*").alias("rows"), F.max(F.abs("cases")).alias("most"), F.array(*[F.sum(c * F.col("e")) for c in (F.lit(1.0), *x)]).alias("g"))
    pulls = regression.doubles(0.0, *model.penalty)
    gaps = F.zip_with(F.zip_with("g", F.zip_with("beta", pulls, lambda b, p: b * p), lambda g, b: F.abs(g - b)), F.array_repeat(F.col("most"), len(x) + 1), lambda g, m: g / m)
    return rounded(sums.join(fits, DEPT).select("department", F.col("rows").alias("n"), F.size("beta").cast("long").alias("features"), F.round(F.array_max(gaps), 4).alias("gap")), "gap")


TREND_WALK = f"{points_sql(104, 4, 13, 'te')}, lines AS (SELECT s.department, s.te, regr_intercept(c.cases, c.i - 1) AS b0, regr_slope(c.cases, c.i - 1) AS b1 FROM starts s JOIN clean c ON c.department = s.department AND c.i <= s.te GROUP BY 1, 2)"


@query(I.sql(TREND_WALK, f"SELECT department, te, h, date, {r('actual', 'actual')}, {r('b0 + b1 * (te + h - 1)', 'predicted')} FROM pts JOIN lines USING (department, te)"))
def walkforward_trend(spark, d):
    """A linear trend fitted at every origin from running sums."""
    return points_out(regression.walkforward(I.clean(spark, d), DEPT, "week_start", "cases", lambda i: [place(i)], 104, 4, 13))


SEASON_WALK = f"{points_sql(104, 4, 13, 'te')}, seen AS (SELECT s.department, s.te, c.cases AS y, sin{X1} AS u, cos{X1} AS v FROM starts s JOIN clean c ON c.department = s.department AND c.i <= s.te), {cramer('', 'department, te', 'seen')}"


@query(I.sql(SEASON_WALK, f"SELECT p.department, p.te, h, date, {r('actual', 'actual')}, {r(f'b0 + b1 * sin(2 * pi() * (p.te + h - 1) / {WEEKS_PER_YEAR}) + b2 * cos(2 * pi() * (p.te + h - 1) / {WEEKS_PER_YEAR})', 'predicted')} FROM pts p JOIN fit f ON f.department = p.department AND f.te = p.te"))
def walkforward_season(spark, d):
    """Yearly Fourier terms fitted at every origin from running sums."""
    return points_out(regression.walkforward(I.clean(spark, d), DEPT, "week_start", "cases", lambda i: regression.fourier(i, 1), 104, 4, 13))


OVER = "OVER (PARTITION BY department ORDER BY week_start)"
ERF = "(1 - x * (0.254829592 + x * (-0.284496736 + x * (1.421413741 + x * (-1.453152027 + x * 1.061405429)))) * exp(-z * z / 2))"
UNIT_ROOT = f"""{I.CLEAN}, d0 AS (SELECT department, week_start, lag(cases) {OVER} AS u, cases - lag(cases) {OVER} AS y FROM clean), d1 AS (SELECT *, lag(y) {OVER} AS v FROM d0),
both_known AS (SELECT * FROM d1 WHERE v IS NOT NULL), {cramer('one_', 'department', 'both_known')},
short AS (SELECT department, count(*) AS n, regr_slope(y, u) AS b, regr_syy(y, u) - regr_slope(y, u) * regr_sxy(y, u) AS sse FROM both_known GROUP BY 1),
long AS (SELECT department, count(*) AS n, regr_slope(y, u) AS b, regr_syy(y, u) - regr_slope(y, u) * regr_sxy(y, u) AS sse, regr_sxx(y, u) AS uu FROM d1 WHERE u IS NOT NULL GROUP BY 1),
picked AS (SELECT department, CASE WHEN o.n * ln(o.sse / o.n) + 6 < s.n * ln(s.sse / s.n) + 4 THEN 1 ELSE 0 END AS lag FROM one_fit o JOIN short s USING (department)),
tested AS (SELECT department, lag, CASE lag WHEN 1 THEN o.n ELSE l.n END AS n, CASE lag WHEN 1 THEN o.b1 / sqrt(o.sse / (o.n - 3) * o.vv / (o.uu * o.vv - o.uv * o.uv)) ELSE l.b / sqrt(l.sse / (l.n - 2) / l.uu) END AS tau
  FROM picked JOIN one_fit o USING (department) JOIN long l USING (department)),
surface AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS z FROM tested),
spread AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS x FROM surface),
judged AS (SELECT *, CASE WHEN tau > 2.74 THEN 1 WHEN tau < -18.83 THEN 0 WHEN z >= 0 THEN (1 + {ERF}) / 2 ELSE (1 - {ERF}) / 2 END AS p FROM spread)"""


@query(I.sql(UNIT_ROOT, f"SELECT department, n, CAST(lag AS BIGINT) AS lag, {r('tau', 'statistic')}, {r('p', 'p_value')}, p < 0.05 AS stationary FROM judged"))
def unit_root(spark, d):
    """Augmented Dickey-Fuller test with up to one lag, as SQL can solve it."""
    return rounded(longs(regression.unit_root(I.clean(spark, d), DEPT, "week_start", "cases", most=1), "lag"), "statistic", "p_value")


@query()
def unit_root_all_lags(spark, d):
    """The same with as many lags as the length allows."""
    return rounded(regression.unit_root(I.clean(spark, d), DEPT, "week_start", "cases"), "statistic", "p_value")


LAGS = 40
ACF = f"""{I.CLEAN}, centred AS (SELECT department, i, cases - avg(cases) OVER (PARTITION BY department) AS x FROM clean), whole AS (SELECT department, sum(x * x) AS xx, count(*) AS n FROM centred GROUP BY 1),
acf AS (SELECT a.department, a.i - b.i AS k, sum(a.x * b.x) / any_value(xx) AS c, any_value(n) AS n FROM centred a JOIN centred b ON a.department = b.department AND a.i - b.i BETWEEN 1 AND {LAGS} JOIN whole w ON w.department = a.department GROUP BY 1, 2)"""


@query(I.sql(ACF, f"SELECT department, {r('max(CASE WHEN k = 1 THEN c END)', 'lag_1')}, 1 + count(*) FILTER (abs(c) > 1.96 / sqrt(n)) AS significant_lags FROM acf WHERE k <= n // 2 GROUP BY 1"))
def significant_lags(spark, d):
    """The first autocorrelation, and how many up to lag 40 or half of the series are significant, lag 0 among them."""
    return rounded(evaluate.significant_lags(I.clean(spark, d), DEPT, "week_start", "cases", LAGS), "lag_1")


BAND = ("predicted", "lower", "upper")


@query()
def additive_trend_season(spark, d):
    """Trend with changes of slope, yearly season and holidays, eight weeks ahead."""
    return rounded(regression.additive_forecast(I.clean(spark, d), DEPT, "week_start", "cases", 8), *BAND)


# --- folds -----------------------------------------------------------------------------------

@query()
def holt_winters(spark, d):
    """Additive smoothing with a yearly season, its weights sought on a grid and by six rounds of moves from the best, eight weeks ahead."""
    return rounded(folds.smoothing_forecast(I.clean(spark, d), DEPT, "week_start", "cases", 8).drop("weights"), *BAND)


@query()
def arimax(spark, d):
    """Six pairs of Fourier terms with ARIMA(1, 1, 1) errors, eight weeks ahead."""
    return rounded(folds.fourier_arima_forecast(I.clean(spark, d), DEPT, "week_start", "cases", 8), *BAND)


SEASON = 4
FOLD_GRID = tuple(itertools.product((0.1, 0.4), (0.05, 0.2), (0.1, 0.3), (0.9,)))


def smoothing_sql(source: str, key: str) -> str:
    """CTEs (recursive) that run every candidate over ``source({key}, y, n)``; the last is ``best`` with weights and the state after the last value."""
    cands = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE, {x}::DOUBLE)" for i, (a, b, g, x) in enumerate(FOLD_GRID))
    return f"""cand AS (SELECT * FROM (VALUES {cands}) AS c(no, a, b, g, x)),
begun AS (SELECT {key}, y, n, no, a, b, g, x, list_sum(y[1:{SEASON}]) / {SEASON} AS l, list_sum(y[{SEASON + 1}:{2 * SEASON}]) / {SEASON} AS l2 FROM {source}, cand WHERE n >= {2 * SEASON}),
run AS (SELECT {key}, y, n, no, a, b, g, x, {SEASON} AS k, l, (l2 - l) / {SEASON} AS t, list_transform(y[1:{SEASON}], lambda v: v - l) AS c, 0::DOUBLE AS sse FROM begun
  UNION ALL SELECT {key}, y, n, no, a, b, g, x, k + 1, l + x * t + a * e, x * t + a * b * e, list_append(c[2:], c[1] + g * (1 - a) * e), sse + e * e FROM (SELECT *, y[k + 1] - (l + x * t + c[1]) AS e FROM run WHERE k < n)),
best AS (SELECT * FROM run WHERE k = n QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY sse, no) = 1)"""


def ahead_sql(h: str) -> str:
    return f"greatest(0, l + t * list_sum(list_transform(range(1, {h} + 1), lambda j: x ** j)) + c[({h} - 1) % {SEASON} + 1])"


ARRAYS = f"{I.CLEAN}, series AS (SELECT department, list(cases ORDER BY week_start) AS y, count(*) AS n, max(week_start) AS last FROM clean GROUP BY 1)"


def recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


@query(recursive(f"{ARRAYS}, {smoothing_sql('series', 'department')}", f"SELECT department, CAST(h AS BIGINT) AS h, CAST(s.last + CAST(7 * h AS INTEGER) AS DATE) AS date, a, b, g, {r(ahead_sql('h'), 'predicted')}, {r('sse', 'sse')} FROM best JOIN series s USING (department), unnest(range(1, 7)) AS u(h)"))
def smoothing_fold(spark, d):
    """Additive smoothing with a season of four weeks: the best of a grid of weights and what it forecasts."""
    series = folds.arrays(I.clean(spark, d), DEPT, "week_start", "cases")
    loss = folds.smoothed_series(series, DEPT, SEASON, 2 * SEASON, FOLD_GRID, 0).select("department", F.col("loss").alias("sse"))
    got = folds.smoothing_forecast(I.clean(spark, d), DEPT, "week_start", "cases", 6, SEASON, 2 * SEASON, grid=FOLD_GRID, rounds=0).where("weights is not null").join(loss, DEPT)
    return rounded(longs(got.select("department", "h", "date", *[F.col("weights")[j].alias(c) for j, c in enumerate("abg")], "predicted", "sse"), "h"), "predicted", "sse")


WALK_ARRAYS = f"{points_sql(150, 4, 40, 'te')}, series AS (SELECT s.department, s.te, s.department || '|' || s.te AS key, list(c.cases ORDER BY c.week_start) AS y, count(*) AS n FROM starts s JOIN clean c ON c.department = s.department AND c.i <= s.te GROUP BY 1, 2)"


@query(recursive(f"{WALK_ARRAYS}, {smoothing_sql('series', 'key')}", f"SELECT p.department, p.te, p.h, p.date, {r('p.actual', 'actual')}, {r(ahead_sql('p.h'), 'predicted')} FROM pts p JOIN best ON best.key = p.department || '|' || p.te"))
def walkforward_smoothing(spark, d):
    """Smoothing whose weights are sought anew at every origin."""
    return points_out(folds.smoothing_walkforward(I.clean(spark, d), DEPT, "week_start", "cases", 150, 4, 40, SEASON, 2 * SEASON, FOLD_GRID, 0).drop("lower", "upper"))


#: Differences of the series and of one pair of Fourier terms, the regression of the first on the second through 0, and what it leaves.
FOURIER_AR = f"""{I.CLEAN}, steps AS (SELECT department, week_start, i, cases, cases - lag(cases) {OVER} AS y, sin{X1} - sin(2 * pi() * (i - 2) / {WEEKS_PER_YEAR}) AS u, cos{X1} - cos(2 * pi() * (i - 2) / {WEEKS_PER_YEAR}) AS v FROM clean),
moves AS (SELECT department, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * y) AS uy, sum(v * y) AS vy FROM steps WHERE y IS NOT NULL GROUP BY 1),
beta AS (SELECT department, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b2 FROM moves),
lefts AS (SELECT department, week_start, y - b1 * u - b2 * v AS z FROM steps JOIN beta USING (department) WHERE y IS NOT NULL), pairs AS (SELECT *, lag(z) {OVER} AS b FROM lefts)"""
ENDS = "ends AS (SELECT department, count(*) AS n, max(week_start) AS last, arg_max(cases, week_start) AS level FROM clean GROUP BY 1)"
PHI = "phis AS (SELECT department, least(0.98, greatest(-0.98, coalesce(sum(z * b) / nullif(sum(b * b), 0), 0))) AS phi, 0::DOUBLE AS theta, arg_max(z, week_start) AS z, 0::DOUBLE AS e FROM pairs GROUP BY 1)"
SEASON_MOVE = f"b1 * (sin(2 * pi() * (n - 1 + h) / {WEEKS_PER_YEAR}) - sin(2 * pi() * (n - 1) / {WEEKS_PER_YEAR})) + b2 * (cos(2 * pi() * (n - 1 + h) / {WEEKS_PER_YEAR}) - cos(2 * pi() * (n - 1) / {WEEKS_PER_YEAR}))"


def arima_sql(phis: str) -> str:
    return f"SELECT department, CAST(h AS BIGINT) AS h, CAST(last + CAST(7 * h AS INTEGER) AS DATE) AS date, {r('phi', 'phi')}, {r('theta', 'theta')}, {r(f'greatest(0, level + (phi * z + theta * e) * list_sum(list_transform(range(0, h), lambda k: phi ** k)) + {SEASON_MOVE})', 'predicted')} FROM ends JOIN beta USING (department) JOIN {phis} USING (department), unnest(range(1, 7)) AS t(h)"


def arima_out(fits, ahead):
    return rounded(longs(ahead.join(fits.select("department", "phi", "theta"), DEPT).select("department", "h", "date", "phi", "theta", "predicted"), "h"), "phi", "theta", "predicted")


@query(I.sql(f"{FOURIER_AR}, {ENDS}, {PHI}", arima_sql("phis")))
def fourier_ar(spark, d):
    """Fourier regression with ARIMA(1, 1, 0) errors, all of it by sums."""
    c = I.clean(spark, d)
    return arima_out(folds.fourier_arima(c, DEPT, "week_start", "cases", 1, moving=False), folds.fourier_arima_forecast(c, DEPT, "week_start", "cases", 6, 1, moving=False))


ARMA_TRIED = tuple(itertools.product((-0.5, 0.0, 0.5), (-0.6, -0.2, 0.3)))
ARMA_RUN = f"""zs AS (SELECT department, list(z ORDER BY week_start) AS zz, count(*) AS m FROM lefts GROUP BY 1), cand AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p}::DOUBLE, {q}::DOUBLE)' for i, (p, q) in enumerate(ARMA_TRIED))}) AS c(no, phi, theta)),
run AS (SELECT department, zz, m, no, phi, theta, 0 AS k, 0::DOUBLE AS z, 0::DOUBLE AS e, 0::DOUBLE AS sse FROM zs, cand
  UNION ALL SELECT department, zz, m, no, phi, theta, k + 1, zz[k + 1], w, sse + w * w FROM (SELECT *, zz[k + 1] - phi * z - theta * e AS w FROM run WHERE k < m)),
arma AS (SELECT * FROM run WHERE k = m QUALIFY row_number() OVER (PARTITION BY department ORDER BY sse, no) = 1)"""


@query(recursive(f"{FOURIER_AR}, {ENDS}, {ARMA_RUN}", arima_sql("arma")))
def fourier_arma(spark, d):
    """Fourier regression with ARIMA(1, 1, 1) errors, the best of a grid of coefficients."""
    c, grid = I.clean(spark, d), {"grid": ARMA_TRIED, "rounds": 0}
    return arima_out(folds.fourier_arima(c, DEPT, "week_start", "cases", 1, **grid), folds.fourier_arima_forecast(c, DEPT, "week_start", "cases", 6, 1, **grid))


# --- tuning --------------------------------------------------------------------------------------

ALPHAS, PULLS, HELD, RUNGS, ETA = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8), (0.0, 0.25), 36, 3, 3


def halving_sql(sets: list[dict], error: str, guesses: str, mean: str = "avg({})") -> str:
    """CTEs from ``{guesses}(department, trial, i, n, actual, guess)`` to ``done``: every trial's last rung, place and loss."""
    out, left, alive = [], len(sets), "true"
    for k in range(RUNGS):
        part = math.ceil(HELD / ETA ** (RUNGS - 1 - k))
        source = f"(SELECT DISTINCT department, trial, true AS alive FROM {guesses})" if k == 0 else f"(SELECT department, trial, alive AND place <= {left} AS alive FROM rung{k - 1})"
        out.append(f"""loss{k} AS (SELECT department, trial, {mean.format(error)} AS loss FROM {guesses} WHERE i > n - {part} AND guess IS NOT NULL GROUP BY 1, 2),
rung{k} AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY alive DESC, loss NULLS LAST, trial) AS place FROM (SELECT s.department, s.trial, s.alive, CASE WHEN alive THEN loss END AS loss FROM {source} s LEFT JOIN loss{k} USING (department, trial)))""")
        left = max(1, math.ceil(left / ETA))
    ends = " UNION ALL ".join(f"SELECT department, trial, {k} AS rung, place, loss FROM rung{k} WHERE alive" for k in range(RUNGS))
    return ",\n".join(out) + f",\nreached AS ({ends}), done AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY department, trial ORDER BY rung DESC) = 1)"


def done_sql(ctes: str, write=I.sql) -> str:
    return write(ctes, f"SELECT department, CAST(trial AS BIGINT) AS trial, {r('loss', 'loss')}, CAST(rung AS BIGINT) AS rung, place AS rank, rung = {RUNGS - 1} AND place = 1 AND loss IS NOT NULL AS best FROM done")


def trials_out(df):
    return rounded(longs(df.drop("parameters"), "trial", "rung", "rank"), "loss")


SETS = [{"alpha": a, "pull": p} for a in ALPHAS for p in PULLS]
LEVELS = f"""trial AS (SELECT * FROM (VALUES {', '.join(f"({i}, {s['alpha']}::DOUBLE, {s['pull']}::DOUBLE)" for i, s in enumerate(SETS))}) AS t(trial, alpha, pull)),
run AS (SELECT department, y, n, trial, alpha, pull, 1 AS i, y[1] AS l, y[1] AS m, y[1] AS actual, CAST(NULL AS DOUBLE) AS guess FROM series, trial
  UNION ALL SELECT department, y, n, trial, alpha, pull, i + 1, alpha * y[i + 1] + (1 - alpha) * l, (m * i + y[i + 1]) / (i + 1), y[i + 1], (1 - pull) * l + pull * m FROM run WHERE i < n)"""


@query(done_sql(f"{ARRAYS}, {LEVELS}, {halving_sql(SETS, 'abs(actual - guess)', 'run')}", recursive))
def tuning_grid(spark, d):
    """Exponential smoothing of every department: a grid of trials thinned by successive halving of the mean absolute error."""
    return trials_out(tuning.tuned(I.clean(spark, d), DEPT, "week_start", "cases", {"alpha": ALPHAS, "pull": PULLS}, validation=HELD, rungs=RUNGS, eta=ETA))


BLENDS = {"season": (4, 13, 26, 52), "share": (0.0, 0.25, 0.5, 0.75, 1.0)}
DRAWN = tuning.choices(BLENDS, 9, 7)
BLEND = f"""seen AS (SELECT department, i, cases AS actual, count(*) OVER (PARTITION BY department) AS n, lag(cases) {OVER} AS b, {', '.join(f'lag(cases, {k}) {OVER} AS b{k}' for k in BLENDS['season'])} FROM clean),
guesses AS ({' UNION ALL '.join(f"SELECT department, {j} AS trial, i, n, actual, {s['share']} * b{s['season']} + (1 - {s['share']}) * b AS guess FROM seen" for j, s in enumerate(DRAWN))})"""


@query(done_sql(f"{I.CLEAN}, {BLEND}, {halving_sql(DRAWN, 'CASE WHEN abs(actual) + abs(guess) > 2e-10 THEN 200 * abs(actual - guess) / (abs(actual) + abs(guess)) END', 'guesses')}"))
def tuning_random(spark, d):
    """Random draws of a blend of last and seasonal values, scored by the symmetric percentage error."""
    return trials_out(tuning.tuned(I.clean(spark, d), DEPT, "week_start", "cases", BLENDS, tuning.seasonal_blend, "smape", HELD, 9, 7, RUNGS, ETA))


@query(done_sql(f"{I.CLEAN}, {BLEND}, {halving_sql(DRAWN, '(actual - guess) * (actual - guess)', 'guesses', 'sqrt(avg({}))')}"))
def tuning_rmse(spark, d):
    return trials_out(tuning.tuned(I.clean(spark, d), DEPT, "week_start", "cases", BLENDS, tuning.seasonal_blend, "rmse", HELD, 9, 7, RUNGS, ETA))


# --- stacking ------------------------------------------------------------------------------------

STACKED = ("naive", "mean")
STACK = f"""{NAIVE}, means AS (SELECT department, i, avg(cases) OVER (PARTITION BY department ORDER BY i ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS m FROM clean),
duo AS (SELECT pts.department, te, h, date, actual, predicted AS u, m AS v FROM pts JOIN means ON means.department = pts.department AND means.i = te)"""


def weights_sql(sums: str) -> str:
    """Non-negative weights w1, w2 of two models from sums uu, vv, uv, uy, vy: both, or the better one alone."""
    return f"""free AS (SELECT *, CASE WHEN vv * uu - uv * uv > 1e-10 * uu * vv THEN (uy * vv - vy * uv) / (uu * vv - uv * uv) ELSE CASE WHEN uu > 0 THEN uy / uu ELSE 0 END END AS f1, CASE WHEN vv * uu - uv * uv > 1e-10 * uu * vv THEN (vy * uu - uy * uv) / (uu * vv - uv * uv) ELSE 0 END AS f2 FROM {sums}),
weighed AS (SELECT *, CASE WHEN f1 >= 0 AND f2 >= 0 THEN f1 WHEN coalesce(uy * greatest(uy, 0) / nullif(uu, 0), 0) >= coalesce(vy * greatest(vy, 0) / nullif(vv, 0), 0) * (1 - 1e-12) THEN greatest(0, uy / uu) ELSE 0 END AS w1,
  CASE WHEN f1 >= 0 AND f2 >= 0 THEN f2 WHEN coalesce(uy * greatest(uy, 0) / nullif(uu, 0), 0) >= coalesce(vy * greatest(vy, 0) / nullif(vv, 0), 0) * (1 - 1e-12) THEN 0 ELSE greatest(0, vy / vv) END AS w2 FROM free)"""


SUMS = "sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * y) AS uy, sum(v * y) AS vy"


def forecasts(spark, d):
    c = I.clean(spark, d)
    naive = evaluate.backtest(c, DEPT, "week_start", "cases", 52, 4, 4, "naive").withColumn("model", F.lit("naive"))
    return naive.unionByName(evaluate.backtest(c, DEPT, "week_start", "cases", 52, 4, 4, "mean", window="sliding").withColumn("model", F.lit("mean")))


@query(I.sql(f"{STACK}, first AS (SELECT department, u, v, actual AS y FROM duo WHERE h = 1), sums AS (SELECT department, {SUMS} FROM first GROUP BY 1), {weights_sql('sums')}", f"SELECT department, {r('w1', 'naive')}, {r('w2', 'mean')} FROM weighed"))
def stacked_weights(spark, d):
    """Non-negative weights of two models on their first steps."""
    got = stacking.stacked(forecasts(spark, d).where("h = 1"), DEPT, STACKED)
    return rounded(got.select("department", *[F.col("weights")[j].alias(m) for j, m in enumerate(STACKED)]), *STACKED)


@query(I.sql(f"{STACK}, sums AS (SELECT s.department, s.te, {SUMS.replace('u *', 'b.u *').replace('v *', 'b.v *').replace('* u', '* b.u').replace('* v', '* b.v').replace('* y', '* b.actual')} FROM starts s JOIN duo b ON b.department = s.department AND b.te + b.h <= s.te GROUP BY 1, 2), {weights_sql('sums')}",
             f"SELECT b.department, b.te, b.h, b.date, {r('b.actual', 'actual')}, {r('CASE WHEN w1 > 0 OR w2 > 0 THEN w1 * u + w2 * v ELSE (u + v) / 2 END', 'predicted')} FROM duo b LEFT JOIN weighed w ON w.department = b.department AND w.te = b.te"))
def walkforward_stacked(spark, d):
    """At every origin the two models are weighed by what was known then."""
    return points_out(stacking.walkforward(forecasts(spark, d), DEPT, STACKED).drop("weights"))
