"""Forecasters of one series: what ``fit`` learns, and what ``ahead`` makes of it for later data.

``fit(y, first, start, **options)`` gives parameters, a dict of numbers and arrays; ``ahead(parameters, y, horizon, first, start, level)``
gives an array (horizon, 3) of point, lower and upper for the steps after ``y``, which need not be what was fitted.
``first`` is the place of y[0] in the whole series, ``start`` its date where one is known; steps are weeks.
Written from the published algorithms; every series is bounded by its key, and Spark deals the keys out (``models``).
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd

PERIOD = 52.1775
WEEK = pd.Timedelta(days=7)


class Estimator(NamedTuple):
    fit: Callable[..., dict]
    ahead: Callable[..., np.ndarray]

    def __call__(self, y: np.ndarray, horizon: int, first: int = 0, start: pd.Timestamp | None = None, level: float = 0.95, **options) -> np.ndarray:
        return self.ahead(self.fit(y, first, start, **options), y, horizon, first, start, level)


def banded(point: np.ndarray, sigma: np.ndarray | float, level: float) -> np.ndarray:
    """Point with the two ends of its central interval of probability ``level``."""
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    return np.stack([point, point - z * sigma, point + z * sigma], 1)


def some(y: np.ndarray, least: int = 1) -> None:
    if len(y) < least:
        raise ValueError("empty series" if least == 1 else f"at least {least} values are needed")


# --- naive ------------------------------------------------------------------------------

def naive_fit(y, first=0, start=None) -> dict:
    some(y)
    return {}


def naive_ahead(p, y, horizon, first=0, start=None, level=0.95):
    some(y)
    return banded(np.repeat(y[-1], horizon), np.std(np.diff(y)) * np.sqrt(np.arange(1, horizon + 1)) if len(y) > 1 else 0.0, level)


def seasonal_fit(y, first=0, start=None, season: int = 52) -> dict:
    some(y)
    return {"season": season}


def seasonal_ahead(p, y, horizon, first=0, start=None, level=0.95):
    """The last season repeated; series shorter than a season repeat whole."""
    some(y)
    s = min(int(p["season"]), len(y))
    return banded(y[len(y) - s + np.arange(horizon) % s], float(np.std(y)), level)


def mean_fit(y, first=0, start=None) -> dict:
    some(y)
    return {}


def mean_ahead(p, y, horizon, first=0, start=None, level=0.95):
    """The mean of the rows at hand."""
    some(y)
    return banded(np.repeat(y.mean(), horizon), float(np.std(y)), level)


# --- Holt-Winters -----------------------------------------------------------------------

def smoothing_run(y: np.ndarray, weights: np.ndarray, season: int) -> tuple[float, float, float, np.ndarray]:
    """Squared one-step errors and last level, trend and cycle of additive smoothing with a damped trend."""
    a, b, g, d = weights
    level, trend = float(y[:season].mean()), float((y[season:2 * season].mean() - y[:season].mean()) / season)
    cycle, sse = (y[:season] - level).astype(float).copy(), 0.0
    for i in range(season, len(y)):
        k = i % season
        e = y[i] - (level + d * trend + cycle[k])
        sse += e * e
        level, trend = level + d * trend + a * e, d * trend + a * b * e
        cycle[k] += g * (1 - a) * e
    return sse, level, trend, cycle


def smoothing_weights(y: np.ndarray, season: int, begin: np.ndarray) -> np.ndarray:
    """Weights of least squared error by coordinate search with halving steps."""
    best, score, width = begin.copy(), smoothing_run(y, begin, season)[0], 0.2
    while width > 0.01:
        moved = False
        for j in range(4):
            for step in (-width, width):
                trial = best.copy()
                trial[j] = np.clip(trial[j] + step, 0.01, 0.98)
                if (s := smoothing_run(y, trial, season)[0]) < score - 1e-12 * max(1.0, score):
                    best, score, moved = trial, s, True
        width = width if moved else width / 2
    return best


def smoothing_fit(y, first=0, start=None, season: int = 52, least: int = 104, reoptimize: bool = True) -> dict:
    """Short series have no weights. With ``reoptimize`` later data move the weights from where the fit left them."""
    some(y)
    w = smoothing_weights(y, season, np.array([0.3, 0.1, 0.1, 0.95])) if len(y) >= least else None
    return {"season": season, "least": least, "reoptimize": reoptimize, "n": len(y), "weights": w}


def smoothing_ahead(p, y, horizon, first=0, start=None, level=0.95):
    season, weights = int(p["season"]), p["weights"]
    if weights is None or len(y) < max(p["least"], 2 * season):
        return seasonal_ahead(p, y, horizon, first, start, level)
    weights = np.asarray(weights, float)
    if p["reoptimize"] and len(y) != p["n"]:
        weights = smoothing_weights(y, season, weights)
    sse, last, trend, cycle = smoothing_run(y, weights, season)
    damp = np.cumsum(weights[3] ** np.arange(1, horizon + 1))
    point = last + damp * trend + cycle[(len(y) + np.arange(horizon)) % season]
    return banded(point, np.sqrt(sse / max(1, len(y) - season)) * np.sqrt(1 + np.arange(horizon) * weights[0] ** 2), level)


# --- regression with (seasonal) ARIMA errors -------------------------------------------------

def fourier_terms(at: np.ndarray, pairs: int, period: float = PERIOD) -> np.ndarray:
    k = np.arange(1, pairs + 1)
    angle = 2 * np.pi * at[:, None] * k[None, :] / period
    return np.concatenate([np.sin(angle), np.cos(angle)], 1)


def polynomial(coefficients: np.ndarray, sign: int, gap: int = 1) -> np.ndarray:
    """1 + sign * sum of c_k B^(k*gap)."""
    out = np.zeros(len(coefficients) * gap + 1)
    out[0] = 1.0
    out[gap::gap] = sign * np.asarray(coefficients, float)
    return out


def differences(d: int, seasonal: int, period: int) -> np.ndarray:
    out = np.ones(1)
    for gap, n in ((1, d), (period, seasonal)):
        for _ in range(n):
            out = np.convolve(out, polynomial(np.ones(1), -1, gap))
    return out


def filtered(poly: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x filtered by a polynomial in the lag, without the first values that lack a past; columns each on their own."""
    n = len(poly) - 1
    if x.ndim == 2:
        return np.stack([filtered(poly, c) for c in x.T], 1) if x.shape[1] else x[n:]
    return np.convolve(x, poly)[n:len(x)] if len(x) > n else x[:0]


def arma_errors(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors for lag polynomials ``ar`` and ``ma``; what lies before the series is 0."""
    w = np.convolve(x, ar)[:len(x)]
    lags = [int(k) for k in np.flatnonzero(ma) if k]
    if not lags:
        return w
    e = w.tolist()
    c = [float(ma[k]) for k in lags]
    for i in range(len(e)):
        for k, m in zip(lags, c):
            if k > i:
                break
            e[i] -= m * e[i - k]
    return np.array(e)


def settled(c: np.ndarray, sign: int, edge: float = 0.98) -> np.ndarray:
    """Coefficients of a lag polynomial 1 + sign * (c_1 B + ...) whose inverse roots are pulled to ``edge`` where they lie beyond it.

    So an autoregression stays stationary and a moving average invertible, whatever the size of single coefficients.
    """
    if not len(c) or not np.isfinite(c).all():
        return np.zeros(len(c))
    roots = np.roots(np.concatenate([[1.0], sign * c]))
    size = np.abs(roots)
    if (size <= edge).all():
        return c
    whole = np.real(np.poly(roots * np.where(size > edge, edge / np.maximum(size, edge), 1.0)))[1:] * sign
    return np.concatenate([whole, np.zeros(len(c) - len(whole))])


def arma_start(x: np.ndarray, p: int, q: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA coefficients by regressions on past values and the errors of a long autoregression (Hannan and Rissanen)."""
    n = len(x)
    m = min(max(p + q + 4, int(np.log(max(n, 3)) * 2)), max(1, n // 4))
    e = np.zeros(n)
    far = np.stack([x[m - i - 1:n - i - 1] for i in range(m)], 1)
    e[m:] = x[m:] - far @ np.linalg.lstsq(far, x[m:], rcond=None)[0]
    ar, ma, lead = np.zeros(p), np.zeros(q), max(p, q, 1)
    for _ in range(rounds if p + q else 0):
        cols = [x[lead - i - 1:n - i - 1] for i in range(p)] + [e[lead - i - 1:n - i - 1] for i in range(q)]
        coef = np.linalg.lstsq(np.stack(cols, 1), x[lead:], rcond=None)[0]
        ar, ma = settled(coef[:p], -1), settled(coef[p:], 1)
        e = arma_errors(x, polynomial(ar, -1), polynomial(ma, 1))
    return ar, ma


def seasonal_arma(x: np.ndarray, order: tuple[int, int, int, int], period: int, rounds: int = 12) -> list[np.ndarray]:
    """Coefficients (ar, ma, seasonal ar, seasonal ma) of least conditional sum of squares, by Gauss-Newton steps that are halved until they help."""
    p, q, sp, sq = order
    cut = np.cumsum([p, q, sp, sq])[:-1]
    theta = np.concatenate([*arma_start(x, p, q), np.full(sp + sq, 0.1)])

    def errors(v: np.ndarray) -> np.ndarray:
        a, m, sa, sm = np.split(v, cut)
        return arma_errors(x, np.convolve(polynomial(a, -1), polynomial(sa, -1, period)), np.convolve(polynomial(m, 1), polynomial(sm, 1, period)))

    e = errors(theta)
    for _ in range(rounds):
        jac = np.stack([(errors(theta + 1e-5 * u) - e) / 1e-5 for u in np.eye(len(theta))], 1)
        step, better = np.linalg.lstsq(jac, -e, rcond=None)[0], None
        for scale in (1.0, 0.5, 0.25, 0.1):
            trial = np.concatenate([settled(c, sign) for c, sign in zip(np.split(theta + scale * step, cut), (-1, 1, -1, 1))])
            t = errors(trial)
            if t @ t < e @ e:
                better = trial, t
                break
        if better is None or e @ e - better[1] @ better[1] < 1e-8 * (e @ e):
            break
        theta, e = better
    return np.split(theta, cut)


def arima_fit(y, first=0, start=None, order: tuple[int, int, int] | None = (1, 1, 1), seasonal: tuple[int, int, int] = (0, 0, 0), period: int = 52, pairs: int = 6) -> dict:
    """Regression on Fourier terms of the absolute place with (seasonal) ARIMA errors; ``order`` None chooses p, q <= 3 by AICc and d by the spread of differences."""
    some(y, 10)
    n = len(y)
    pairs = min(pairs, max(0, (n - 4) // 6))
    d = order[1] if order else int(np.std(np.diff(y)) < np.std(y))
    diff = differences(d, seasonal[1], period)
    if n - len(diff) < 8 + period * max(seasonal[0], seasonal[2]):
        raise ValueError("the series is too short for these orders")
    x = fourier_terms(first + np.arange(n), pairs)
    dy, dx = filtered(diff, y), filtered(diff, x)
    if len(diff) == 1:
        dx = np.concatenate([dx, np.ones((len(dy), 1))], 1)
    beta = np.linalg.lstsq(dx, dy, rcond=None)[0] if dx.shape[1] else np.zeros(0)
    z = dy - dx @ beta
    best = None
    for p, q in [(order[0], order[2])] if order else [(p, q) for p in range(4) for q in range(4)]:
        if seasonal[0] or seasonal[2]:
            ar, ma, sar, sma = seasonal_arma(z, (p, q, seasonal[0], seasonal[2]), period)
        else:
            (ar, ma), sar, sma = arma_start(z, p, q), np.zeros(0), np.zeros(0)
        full_ar = np.convolve(polynomial(ar, -1), polynomial(sar, -1, period))
        full_ma = np.convolve(polynomial(ma, 1), polynomial(sma, 1, period))
        e = arma_errors(z, full_ar, full_ma)
        k = p + q + len(sar) + len(sma) + len(beta) + 1
        aicc = len(z) * np.log(max(np.mean(e**2), 1e-12)) + 2 * k + 2 * k * (k + 1) / max(1, len(z) - k - 1)
        if best is None or aicc < best[0]:
            best = (aicc, full_ar, full_ma, float(np.std(e)), k)
    return {"beta": beta, "pairs": pairs, "diff": diff, "ar": best[1], "ma": best[2], "sigma": best[3], "k": best[4]}


def arima_errors(p: dict, y: np.ndarray, first: int = 0) -> np.ndarray:
    """One-step errors of a fitted model on ``y``; NaN for the first rows, which have no difference."""
    diff, beta = np.asarray(p["diff"], float), np.asarray(p["beta"], float)
    x = filtered(diff, fourier_terms(first + np.arange(len(y)), int(p["pairs"])))
    x = np.concatenate([x, np.ones((len(x), 1))], 1) if len(diff) == 1 else x
    z = filtered(diff, y) - x @ beta
    return np.concatenate([np.full(len(diff) - 1, np.nan), arma_errors(z, np.asarray(p["ar"], float), np.asarray(p["ma"], float))])


def arima_ahead(p, y, horizon, first=0, start=None, level=0.95):
    """New data are filtered by the fitted parameters; the levels follow from the whole lag polynomial."""
    diff, beta, pairs = np.asarray(p["diff"], float), np.asarray(p["beta"], float), int(p["pairs"])
    some(y, len(diff))
    n = len(y)
    x = fourier_terms(first + np.arange(n + horizon), pairs)
    x = np.concatenate([x, np.ones((n + horizon, 1))], 1) if len(diff) == 1 else x
    known = x @ beta
    u = (y - known[:n]).tolist()
    e = np.nan_to_num(arima_errors(p, y, first)).tolist()
    full, ma = np.convolve(diff, np.asarray(p["ar"], float)), np.asarray(p["ma"], float)
    pull, push = [(int(k), -float(full[k])) for k in np.flatnonzero(full) if k], [(int(k), float(ma[k])) for k in np.flatnonzero(ma) if k]
    psi = [1.0]
    for h in range(horizon):
        u.append(sum(c * u[-k] for k, c in pull if k <= len(u)) + sum(c * e[-k] for k, c in push if k <= len(e)))
        e.append(0.0)
        if h:
            psi.append(sum(c * psi[h - k] for k, c in pull if k <= h) + (float(ma[h]) if h < len(ma) else 0.0))
    return banded(np.array(u[n:]) + known[n:], p["sigma"] * np.sqrt(np.cumsum(np.square(psi))), level)


# --- additive trend, season and holidays ---------------------------------------------------------

#: Public holidays of Peru by month and day (fixed values), and days from Easter Sunday.
FIXED_DAYS = ((1, 1), (5, 1), (6, 29), (7, 28), (7, 29), (8, 30), (10, 8), (11, 1), (12, 8), (12, 25))
EASTER_DAYS = (-3, -2)


def easter(year: int) -> pd.Timestamp:
    """Easter Sunday of the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, d = divmod(h + k - 7 * m + 114, 31)
    return pd.Timestamp(year, month, d + 1)


def holiday_columns(start: pd.Timestamp | None, first_step: int, n: int) -> np.ndarray:
    """One column for each holiday: 1 in the week of ``n`` weeks from ``start`` + ``first_step`` that holds it."""
    kinds = len(FIXED_DAYS) + len(EASTER_DAYS)
    out = np.zeros((n, kinds if start is not None else 0))
    if start is None:
        return out
    begin = pd.Timestamp(start) + WEEK * first_step
    for year in range(begin.year, (begin + WEEK * n).year + 1):
        days = [pd.Timestamp(year, m, d) for m, d in FIXED_DAYS] + [easter(year) + pd.Timedelta(days=d) for d in EASTER_DAYS]
        for k, day in enumerate(days):
            at = (day - begin).days // 7
            if 0 <= at < n:
                out[at, k] = 1.0
    return out


def additive_columns(p: dict, place: int, n: int) -> np.ndarray:
    """Constant, trend, changes of slope, season and holidays of ``n`` steps from the absolute ``place``."""
    at = place + np.arange(n)
    t = (at - p["first"]) / p["n"]
    knots = np.linspace(0, 0.8, int(p["changes"]) + 2)[1:-1]
    start = pd.Timestamp(p["start"]) if p["start"] is not None else None
    return np.concatenate([np.ones((n, 1)), t[:, None], np.maximum(0, t[:, None] - knots[None, :]), fourier_terms(at, int(p["pairs"])), holiday_columns(start, place - p["first"], n)], 1)


def additive_fit(y, first=0, start=None, changes: int = 25, pairs: int = 10, change_scale: float = 0.05, season_scale: float = 10.0, holiday_scale: float = 10.0) -> dict:
    """Piecewise linear trend with shrunken changes of slope, yearly Fourier terms and holidays, by ridge regression (the posterior mode of Taylor and Letham's model under normal priors)."""
    some(y, 10)
    n, scale = len(y), max(float(np.abs(y).max()), 1e-9)
    p = {"first": int(first), "n": n, "start": None if start is None else str(pd.Timestamp(start).date()), "changes": changes, "pairs": pairs}
    x = additive_columns(p, first, n)
    days = x.shape[1] - 2 - changes - 2 * pairs
    prior = np.concatenate([[1e-9, 1e-9], np.full(changes, 0.01 / change_scale**2), np.full(2 * pairs, 0.01 / season_scale**2), np.full(days, 0.01 / holiday_scale**2)])
    beta = np.linalg.solve(x.T @ x + np.diag(prior), x.T @ (y / scale)) * scale
    return p | {"beta": beta, "sigma": float(np.std(y - x @ beta))}


def additive_ahead(p, y, horizon, first=0, start=None, level=0.95):
    x = additive_columns(p, first + len(y), horizon)
    ahead = first + len(y) - (p["first"] + p["n"]) + np.arange(horizon)
    return banded(x @ np.asarray(p["beta"], float), p["sigma"] * np.sqrt(1 + np.maximum(0, ahead) / p["n"]), level)


# --- recurrent nets -----------------------------------------------------------------------------

def sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def lstm_forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of every step of ``x`` (batch, steps, inputs), and what the way back needs."""
    n, units = len(x), len(u)
    h, c, states, kept = np.zeros((n, units)), np.zeros((n, units)), [], []
    into = x @ w + b
    for t in range(x.shape[1]):
        a = into[:, t] + h @ u
        i, f, o = (sigmoid(a[:, k * units:(k + 1) * units]) for k in range(3))
        g = np.tanh(a[:, 3 * units:])
        before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        kept.append((before, i, f, o, g, tc))
        states.append(h)
    return np.stack(states, 1), kept


def lstm_backward(d: np.ndarray, x: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.empty_like(x)
    dh, dc = np.zeros_like(d[:, 0]), np.zeros_like(d[:, 0])
    for t in reversed(range(x.shape[1])):
        (h, c), i, f, o, g, tc = kept[t]
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        a = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += x[:, t].T @ a
        du += h.T @ a
        db += a.sum(0)
        dx[:, t], dh, dc = a @ w.T, a @ u.T, dc * f
    return dx, (dw, du, db)


def gru_forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    n, units = len(x), len(u)
    h, states, kept = np.zeros((n, units)), [], []
    into = x @ w + b
    for t in range(x.shape[1]):
        own = h @ u
        z, r = (sigmoid(into[:, t, k * units:(k + 1) * units] + own[:, k * units:(k + 1) * units]) for k in range(2))
        back = own[:, 2 * units:]
        g = np.tanh(into[:, t, 2 * units:] + r * back)
        kept.append((h, z, r, g, back))
        h = (1 - z) * h + z * g
        states.append(h)
    return np.stack(states, 1), kept


def gru_backward(d: np.ndarray, x: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.empty_like(x)
    dh = np.zeros_like(d[:, 0])
    for t in reversed(range(x.shape[1])):
        h, z, r, g, back = kept[t]
        dh = dh + d[:, t]
        dg = dh * z * (1 - g * g)
        az, ar = dh * (g - h) * z * (1 - z), dg * back * r * (1 - r)
        a, own = np.concatenate([az, ar, dg], 1), np.concatenate([az, ar, dg * r], 1)
        dw += x[:, t].T @ a
        du += h.T @ own
        db += a.sum(0)
        dx[:, t], dh = a @ w.T, dh * (1 - z) + own @ u.T
    return dx, (dw, du, db)


CELLS = {"lstm": (4, lstm_forward, lstm_backward), "gru": (3, gru_forward, gru_backward)}


def net_shape(cell: str, units: tuple[int, int], dense: int, block: int) -> dict[str, tuple[int, ...]]:
    gates, (a, b) = CELLS[cell][0], units
    return {"w1": (3, gates * a), "u1": (a, gates * a), "b1": (gates * a,), "w2": (a, gates * b), "u2": (b, gates * b), "b2": (gates * b,),
            "wd": (b, dense), "bd": (dense,), "wo": (dense, block), "bo": (block,)}


def net_forward(p: dict, cell: str, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Two recurrent layers, a rectified dense one and a linear one on the last state."""
    _, forward, _ = CELLS[cell]
    one, kept1 = forward(x, p["w1"], p["u1"], p["b1"])
    two, kept2 = forward(one, p["w2"], p["u2"], p["b2"])
    mid = np.maximum(0, two[:, -1] @ p["wd"] + p["bd"])
    return mid @ p["wo"] + p["bo"], (one, kept1, two, kept2, mid)


def net_gradient(p: dict, cell: str, x: np.ndarray, d: np.ndarray, cache: tuple) -> dict:
    """Gradients by back-propagation through time for the output's gradient ``d``."""
    one, kept1, two, kept2, mid = cache
    back = CELLS[cell][2]
    dm = (d @ p["wo"].T) * (mid > 0)
    d_two = np.zeros_like(two)
    d_two[:, -1] = dm @ p["wd"].T
    d_one, (w2, u2, b2) = back(d_two, one, kept2, p["w2"], p["u2"])
    _, (w1, u1, b1) = back(d_one, x, kept1, p["w1"], p["u1"])
    return {"w1": w1, "u1": u1, "b1": b1, "w2": w2, "u2": u2, "b2": b2, "wd": two[:, -1].T @ dm, "bd": dm.sum(0), "wo": mid.T @ d, "bo": d.sum(0)}


def smoothed(y: np.ndarray, n: int) -> np.ndarray:
    """Trailing mean of up to ``n`` values."""
    total = np.concatenate([[0.0], np.cumsum(y)])
    i = np.arange(1, len(y) + 1)
    lo = np.maximum(0, i - n)
    return (total[i] - total[lo]) / (i - lo)


def net_inputs(z: np.ndarray, ends: np.ndarray, back: int, first: int) -> np.ndarray:
    """(windows, back, 3): value, sine and cosine of the week of the ``back`` steps before each end."""
    at = ends[:, None] + np.arange(-back, 0)[None, :]
    angle = 2 * np.pi * (first + at) / 52.0
    return np.stack([z[at], np.sin(angle), np.cos(angle)], -1)


def net_fit(y, first=0, start=None, cell: str = "gru", back: int = 52, block: int = 4, smooth: int = 3, units: tuple[int, int] = (16, 8), dense: int = 16,
            epochs: int = 40, val: int = 26, patience: int = 8, batch: int = 32, rate: float = 0.005, seed: int = 42) -> dict:
    """Changes from the last value, learnt on absolute errors by Adam; the last ``val`` windows stop it ``patience`` epochs after their best."""
    some(y, back + block + val)
    s = smoothed(y, smooth)
    lo, hi = float(s.min()), float(s.max())
    z = (s - lo) / max(hi - lo, 1e-9)
    ends = np.arange(back, len(y) - block + 1)
    x, target = net_inputs(z, ends, back, first), np.stack([z[e:e + block] - z[e - 1] for e in ends])
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1, d) / np.sqrt(d[0]) if len(d) == 2 else np.zeros(d) for k, d in net_shape(cell, tuple(units), dense, block).items()}
    if cell == "lstm":  # gates that forget start open
        for k, n in (("b1", units[0]), ("b2", units[1])):
            p[k][n:2 * n] = 1.0
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    n, best, waited, t = len(x) - val, None, 0, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            j = order[i:i + batch]
            out, cache = net_forward(p, cell, x[j])
            g = net_gradient(p, cell, x[j], np.sign(out - target[j]) / out.size, cache)
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            t += 1
            for k in p:
                step = g[k] / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * step
                v[k] = 0.999 * v[k] + 0.001 * step * step
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = float(np.abs(net_forward(p, cell, x[n:])[0] - target[n:]).mean())
        if best is None or loss < best[0] - 1e-6:
            best, waited = (loss, p), 0
        else:
            waited += 1
            if waited >= patience:
                break
    p = best[1]
    sigma = float(np.std(net_forward(p, cell, x)[0] - target)) * (hi - lo)
    return {"cell": cell, "back": back, "block": block, "smooth": smooth, "low": lo, "high": hi, "sigma": sigma, **p}


def net_ahead(p, y, horizon, first=0, start=None, level=0.95):
    """Forecasts in blocks, each from the values and blocks before it."""
    some(y, int(p["back"]))
    net = {k: np.asarray(p[k], float) for k in ("w1", "u1", "b1", "w2", "u2", "b2", "wd", "bd", "wo", "bo")}
    lo, hi, back, n = p["low"], p["high"], int(p["back"]), len(y)
    out = (smoothed(y, int(p["smooth"])) - lo) / max(hi - lo, 1e-9)
    while len(out) < n + horizon:
        x = net_inputs(np.append(out, 0.0), np.array([len(out)]), back, first)
        out = np.append(out, np.clip(out[-1] + net_forward(net, p["cell"], x)[0][0], -0.5, 1.5))
    return banded(out[n:n + horizon] * (hi - lo) + lo, p["sigma"], level)


naive = Estimator(naive_fit, naive_ahead)
seasonal_naive = Estimator(seasonal_fit, seasonal_ahead)
mean = Estimator(mean_fit, mean_ahead)
holt_winters = Estimator(smoothing_fit, smoothing_ahead)
arimax = Estimator(arima_fit, arima_ahead)
additive = Estimator(additive_fit, additive_ahead)
recurrent = Estimator(net_fit, net_ahead)
