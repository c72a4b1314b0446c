"""Grouped models: forecasters, residuals, diagnostics and decompositions of every key at once.

Each forecast gives rows (keys, h, date, predicted, lower, upper, status, error); a key whose fit fails
gives one row that says so. Series are bounded by their key, and keys are dealt out by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .estimators import WEEK, Estimator, additive, arima_errors, arima_fit, arimax, holt_winters, mean, naive, recurrent, seasonal_naive
from .evaluate import origins, refit_origin
from .series import with_position

FORECAST = "h int, date date, predicted double, lower double, upper double, status string, error string"


def key_fields(df: DataFrame, keys: Sequence[str]) -> tuple[list[str], str]:
    """Names of the key columns in the frame's order, and their part of a schema."""
    fields = [f for f in df.schema.fields if f.name in keys]
    return [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def predicted(model: Callable[..., np.ndarray], y: np.ndarray, horizon: int, start, options: dict) -> np.ndarray:
    """Estimators are told the date of the first value; any other function of (values, horizon) is a model too. Never below 0."""
    out = model(y, horizon, start=start, **options) if isinstance(model, Estimator) else model(y, horizon, **options)
    return np.clip(out, 0, None)


def forecast_rows(head: dict, last: pd.Timestamp, out: np.ndarray | None, error: str | None = None) -> pd.DataFrame:
    if out is None:
        rows = {"h": [0], "date": [last.date()], "predicted": [None], "lower": [None], "upper": [None], "status": ["failed"], "error": [(error or "")[:200]]}
    else:
        h = np.arange(1, len(out) + 1)
        rows = {"h": h, "date": [(last + WEEK * int(k)).date() for k in h], "predicted": out[:, 0], "lower": out[:, 1], "upper": out[:, 2], "status": "success", "error": None}
    return pd.DataFrame(head | rows)


def grouped_forecast(df: DataFrame, keys: Sequence[str], t: str, value: str, forecast: Callable[..., np.ndarray], horizon: int, **options) -> DataFrame:
    """``forecast(values, horizon, **options)`` gives an array (horizon, 3): point, lower, upper. Any such function is a model."""
    names, kinds = key_fields(df, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        head, last = {k: pdf[k].iloc[0] for k in names}, pd.Timestamp(pdf[t].iloc[-1])
        try:
            return forecast_rows(head, last, predicted(forecast, pdf[value].to_numpy(float), horizon, pd.Timestamp(pdf[t].iloc[0]), options))
        except Exception as e:  # one key's failure is a row of the result
            return forecast_rows(head, last, None, str(e))

    return df.select(*names, t, value).groupBy(*names).applyInPandas(run, f"{kinds}, {FORECAST}")


def fitted(df: DataFrame, keys: Sequence[str], t: str, value: str, model: str, overrides: dict[str, dict] | None = None, **options) -> DataFrame:
    """(keys, model, n, first_date, last_date, parameters, error): what a model learnt of every key, as JSON that ``sinks.write`` keeps.

    ``overrides`` holds options for some keys, by their names in upper case joined by a bar; the caller's own options come last.
    """
    est, base = model_of(model)
    names, kinds = key_fields(df, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        own = settings(base, overrides or {}, "|".join(str(pdf[k].iloc[0]) for k in names), **options)
        try:
            made, error = json.dumps(est.fit(pdf[value].to_numpy(float), 0, pd.Timestamp(pdf[t].iloc[0]), **own), default=plain), None
        except Exception as e:
            made, error = None, str(e)[:200]
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in names} | {"model": model, "n": len(pdf), "first_date": pdf[t].iloc[0], "last_date": pdf[t].iloc[-1], "parameters": made, "error": error}])

    return df.select(*names, F.col(t).cast("date").alias(t), value).groupBy(*names).applyInPandas(run, f"{kinds}, model string, n long, first_date date, last_date date, parameters string, error string")


def plain(v):
    return v.tolist() if isinstance(v, np.ndarray) else v.item()


def from_fitted(saved: DataFrame, df: DataFrame, keys: Sequence[str], t: str, value: str, horizon: int, level: float = 0.95) -> DataFrame:
    """Forecasts after the series of ``df`` by parameters that ``fitted`` made, perhaps of a shorter past; keys without parameters fail."""
    names, kinds = key_fields(df, keys)

    def run(of: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*names, "h", "date", "predicted", "lower", "upper", "status", "error"])
        pdf = pdf.sort_values(t)
        head, last = {k: pdf[k].iloc[0] for k in names}, pd.Timestamp(pdf[t].iloc[-1])
        try:
            if not len(of) or of["parameters"].iloc[0] is None:
                raise ValueError("no fitted parameters")
            start = pd.Timestamp(pdf[t].iloc[0])
            first = (start - pd.Timestamp(of["first_date"].iloc[0])).days // 7
            est, p = model_of(of["model"].iloc[0])[0], json.loads(of["parameters"].iloc[0])
            return forecast_rows(head, last, np.clip(est.ahead(p, pdf[value].to_numpy(float), horizon, first, start, level), 0, None))
        except Exception as e:
            return forecast_rows(head, last, None, str(e))

    return saved.groupBy(*names).cogroup(df.select(*names, t, value).groupBy(*names)).applyInPandas(run, f"{kinds}, {FORECAST}")


def walkforward(df: DataFrame, keys: Sequence[str], t: str, value: str, model: str | Callable[..., np.ndarray], train: int | str, horizon: int = 4, step: int = 4,
                refit_every: int = 1, window: str = "expanding", level: float = 0.95, **options) -> DataFrame:
    """(keys, te, fit, h, date, actual, predicted, lower, upper, status, error): a model judged at every rolling origin.

    The origin ``te`` knows the first te rows (``sliding``: the last ``train`` of them). The model is fitted at the first origin and at every
    ``refit_every``-th after it, 0 only once; between, its parameters meet the newer rows. Every fit is a group of its own, so the
    fits of one key run side by side; a fit that fails gives rows without predictions for all its origins.
    """
    if window not in ("expanding", "sliding"):
        raise ValueError("window must be expanding or sliding")
    if window == "sliding" and not isinstance(train, int):
        raise ValueError("a sliding window needs a number of rows")
    if refit_every < 0:
        raise ValueError("refit_every must not be negative")
    est, base = model_of(model) if isinstance(model, str) else (model, {})
    names, kinds = key_fields(df, keys)
    numbered = with_position(df.select(*names, F.col(t).cast("date").alias("date"), F.col(value).cast("double").alias("v")), names, "date")
    points = origins(numbered, names, "date", train, horizon, step)
    at = points.where("h = 1").select(*names, "te")
    first = at.groupBy(*names).agg(F.min("te").alias("__first"))
    fits = (at.join(first, names).withColumn("fit", refit_origin(F.col("te"), F.col("__first"), step, refit_every).cast("int"))
            .groupBy(*names, "fit").agg(F.sort_array(F.collect_list("te")).alias("tes"), F.max("te").alias("__last")))
    low = F.col("fit") - train if window == "sliding" else F.lit(0)
    rows = numbered.join(fits, names).where((F.col("i") <= F.col("__last")) & (F.col("i") > low)).select(*names, "fit", "tes", "i", "date", "v")
    span = train if window == "sliding" else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, y, fit = pdf["i"].to_numpy(), pdf["v"].to_numpy(float), int(pdf["fit"].iloc[0])
        begin = pd.Timestamp(pdf["date"].iloc[0])

        def past(te: int) -> tuple[np.ndarray, int, pd.Timestamp]:
            lo = max(int(i[0]), te - span + 1) if span else int(i[0])
            return y[lo - int(i[0]):te - int(i[0]) + 1], lo - 1, begin + WEEK * (lo - int(i[0]))

        out, p, error = [], None, None
        if isinstance(est, Estimator):
            try:
                p = est.fit(*past(fit), **(base | options))
            except Exception as e:
                error = str(e)
        for te in pdf["tes"].iloc[0]:
            got, why = None, error
            if why is None:
                try:
                    got = est.ahead(p, *(lambda v, f, s: (v, horizon, f, s))(*past(int(te))), level) if isinstance(est, Estimator) else est(past(int(te))[0], horizon, **options)
                except Exception as e:
                    why = str(e)
            got = np.full((horizon, 3), np.nan) if got is None else np.clip(got, 0, None)
            out += [(int(te), fit, h + 1, *(None if np.isnan(x) else float(x) for x in got[h]), "success" if why is None else "failed", why and why[:200]) for h in range(horizon)]
        made = pd.DataFrame(out, columns=["te", "fit", "h", "predicted", "lower", "upper", "status", "error"])
        for k in names:
            made[k] = pdf[k].iloc[0]
        return made[[*names, "te", "fit", "h", "predicted", "lower", "upper", "status", "error"]]

    ahead = rows.groupBy(*names, "fit").applyInPandas(run, f"{kinds}, te int, fit int, h int, predicted double, lower double, upper double, status string, error string")
    actual = numbered.select(*names, "i", "date", F.col("v").alias("actual"))
    known = points.join(ahead, [*names, "te", "h"]).withColumn("i", F.col("te") + F.col("h")).join(actual, [*names, "i"])
    return known.select(*names, "te", "fit", "h", "date", "actual", "predicted", "lower", "upper", "status", "error")


def model_of(name: str) -> tuple[Estimator, dict]:
    """A grouped model by its name, whatever its case, blanks, dashes or underscores. Trees are one model of all keys: see ``trees``."""
    key = name.lower().replace("_", "").replace("-", "").replace(" ", "")
    known = {
        "naive": (naive, {}), "seasonalnaive": (seasonal_naive, {}), "mean": (mean, {}),
        "holtwinters": (holt_winters, {}), "sarima": (arimax, {}), "arimax": (arimax, {}), "autosarima": (arimax, {"order": None}),
        "seasonalarima": (arimax, {"order": (1, 1, 1), "seasonal": (1, 1, 1), "pairs": 0}),
        "prophet": (additive, {}), "additive": (additive, {}), "lstm": (recurrent, {"cell": "lstm"}), "gru": (recurrent, {"cell": "gru"}),
    }
    if key not in known:
        raise ValueError(f"unknown model {name}")
    return known[key]


def settings(defaults: dict, overrides: dict[str, dict], key: str, **given) -> dict:
    """Parameters: the defaults, then the key's own, then the caller's."""
    return defaults | overrides.get(key.strip().upper(), {}) | given


def residuals(df: DataFrame, keys: Sequence[str], t: str, value: str, order: tuple[int, int, int] = (1, 1, 1), least: int = 10) -> DataFrame:
    """(keys, t, value, residual) of an ARIMA model of each key; keys that are short or fail have null residuals, as have the first d rows."""
    names, _ = key_fields(df, keys)
    cols, kinds = key_fields(df, [*keys, t])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf[value].to_numpy(float)
        try:
            res = arima_errors(arima_fit(y, order=order, pairs=0), y) if len(y) >= least and np.isfinite(y).all() else np.full(len(y), np.nan)
        except (np.linalg.LinAlgError, ValueError):
            res = np.full(len(y), np.nan)
        return pdf.assign(residual=pd.array([None if not np.isfinite(r) else float(r) for r in res], dtype="Float64"))[[*cols, value, "residual"]]

    return df.select(*cols, value).groupBy(*names).applyInPandas(run, f"{kinds}, `{value}` double, residual double")


def dickey_fuller(x: np.ndarray, lags: int = 1) -> float:
    """t statistic of the level in a regression of differences on it, a constant and lagged differences."""
    d = np.diff(x)
    n = len(d) - lags
    if n < lags + 4:
        return float("nan")
    a = np.column_stack([x[lags:-1], np.ones(n), *[d[lags - k - 1:len(d) - k - 1] for k in range(lags)]])
    b, *_ = np.linalg.lstsq(a, d[lags:], rcond=None)
    e = d[lags:] - a @ b
    var = e @ e / max(1, n - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0]
    return float(b[0] / np.sqrt(var)) if var > 0 else float("nan")


DIAGNOSTICS = ("n", "aic", "bic", "rmse", "mean", "std", "least", "most", "adf")


def diagnosed(df: DataFrame, keys: Sequence[str], t: str, value: str, order: tuple[int, int, int] = (1, 1, 1), pairs: int = 6) -> DataFrame:
    """Residual diagnostics of each key's model: information criteria, spread, unit root statistic; null where it cannot be fitted."""
    names, kinds = key_fields(df, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(t)[value].to_numpy(float)
        out = dict.fromkeys(DIAGNOSTICS)
        try:
            p = arima_fit(y, order=order, pairs=pairs)
            e = arima_errors(p, y)
            e = e[np.isfinite(e)]
            k, mse = p["k"], float(np.mean(e**2))
            out = {"n": float(len(e)), "aic": len(e) * np.log(max(mse, 1e-12)) + 2 * k, "bic": len(e) * np.log(max(mse, 1e-12)) + k * np.log(len(e)), "rmse": mse**0.5,
                   "mean": e.mean(), "std": e.std(ddof=1), "least": e.min(), "most": e.max(), "adf": dickey_fuller(e)}
            out = {c: float(v) if np.isfinite(v) else None for c, v in out.items()}
        except (ValueError, np.linalg.LinAlgError):
            pass
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in names} | out])[[*names, *DIAGNOSTICS]].astype({c: "Float64" for c in DIAGNOSTICS})

    return df.select(*names, t, value).groupBy(*names).applyInPandas(run, kinds + ", " + ", ".join(f"{c} double" for c in DIAGNOSTICS))


def loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Locally linear fits at positions ``at`` with tricube weights over the ``span`` nearest values."""
    n = len(y)
    x = np.arange(n)
    q = min(span, n)
    out = np.empty(len(at))
    for j, p in enumerate(at):
        lo = int(min(max(0, np.ceil(p - q / 2)), n - q))
        i = np.arange(lo, lo + q)
        far = max(abs(p - lo), abs(p - lo - q + 1), 1.0) * (span / q if span > n else 1.0)
        w = np.clip(1 - (np.abs(x[i] - p) / (far * 1.0001)) ** 3, 0, None) ** 3 * weights[i]
        if w.sum() <= 0:
            w = np.ones(q)
        m = (w * x[i]).sum() / w.sum()
        c = (w * y[i]).sum() / w.sum()
        v = (w * (x[i] - m) ** 2).sum()
        out[j] = c + ((w * (x[i] - m) * y[i]).sum() / v * (p - m) if v > 1e-9 else 0.0)
    return out


def mean_filter(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.ones(n) / n, "valid")


def stl(y: np.ndarray, period: int, seasonal: int, inner: int = 2, outer: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and remainder by loess (Cleveland et al., 1990)."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("at least two periods are needed")
    seasonal += seasonal % 2 == 0
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    span += span % 2 == 0
    low = period + (period % 2 == 0)
    trend, season, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for o in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            free = y - trend
            for k in range(period):
                part = np.arange(k, n, period)
                got = loess(free[part], seasonal, robust[part], np.arange(-1, len(part) + 1))
                cycle[k + period * np.arange(len(part) + 2)] = got
            smooth = mean_filter(mean_filter(mean_filter(cycle, period), period), 3)
            season = cycle[period:period + n] - loess(smooth, low, np.ones(len(smooth)), np.arange(n))
            trend = loess(y - season, span, robust, np.arange(n))
        rest = y - trend - season
        if o < outer:
            h = 6 * np.median(np.abs(rest))
            robust = np.clip(1 - (np.abs(rest) / h) ** 2, 0, None) ** 2 if h > 1e-12 else np.ones(n)
    return trend, season, y - trend - season


def decomposed(df: DataFrame, keys: Sequence[str], t: str, value: str, period: int | None = 52) -> DataFrame:
    """(keys, t, observed, trend, seasonal, remainder) of each series; series under two periods have none. ``period`` None adapts to the length."""
    names, _ = key_fields(df, keys)
    cols, kinds = key_fields(df, [*keys, t])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf[value].to_numpy(float)
        p = period or max(4, min(52, len(y) // 4))
        if len(y) < 2 * p or not np.isfinite(y).all():
            return pdf.iloc[:0].assign(observed=0.0, trend=0.0, seasonal=0.0, remainder=0.0)[[*cols, "observed", "trend", "seasonal", "remainder"]]
        a, b, c = stl(y, p, p + 1)
        return pdf.assign(observed=y, trend=a, seasonal=b, remainder=c)[[*cols, "observed", "trend", "seasonal", "remainder"]]

    return df.select(*cols, value).groupBy(*names).applyInPandas(run, f"{kinds}, observed double, trend double, seasonal double, remainder double")
