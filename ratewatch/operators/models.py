"""Two forecasting models in numpy: they see arrays of a batch of series, Spark deals out the series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: How many yearly and weekly Fourier terms, changepoints, and over which part of the history.
YEARLY, WEEKLY, CHANGES, CHANGE_SPAN = 10, 3, 25, 0.8


class CannotFit(ValueError):
    """The data don't allow this model."""


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _seasons(days: np.ndarray, holidays: Sequence[np.ndarray]) -> np.ndarray:
    columns = [f(2 * np.pi * k * days / period) for period, n in ((365.25, YEARLY), (7.0, WEEKLY)) for k in range(1, n + 1) for f in (np.sin, np.cos)]
    return np.stack([*columns, *(np.isin(days, h).astype(float) for h in holidays)], axis=1)


def trend_forecast(days: np.ndarray, y: np.ndarray, future: np.ndarray, holidays: Sequence[np.ndarray], prior: float = 0.05, width: float = 0.8, rounds: int = 12, seed: int = 0, samples: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piecewise-linear trend times one plus seasons; days are numbers of days, and each holiday (its days) has an effect of its own.

    The most likely parameters by turns: the trend's (slopes may change at set points, under a Laplace prior that is
    fit by reweighting) given the seasons, and the seasons' (Gaussian prior) given the trend. The band comes from ``samples``
    futures: as many slope changes as the history has in such a time, of the size that they have there, and the residuals'
    spread. ``seed`` makes them; the same seed gives the same band.
    """
    if len(y) < 2 or not np.isfinite(y).all():
        raise CannotFit("the trend model needs two rates")
    scale = np.abs(y).max() or 1.0
    first, span = days[0], max(1.0, float(days[-1] - days[0]))
    t, tf, z = (days - first) / span, (future - first) / span, y / scale
    n_changes = min(CHANGES, max(0, int(len(y) * CHANGE_SPAN) - 1))
    points = t[np.linspace(0, int(len(y) * CHANGE_SPAN) - 1, n_changes + 1).round().astype(int)[1:]] if n_changes else np.empty(0)
    base = lambda u: np.concatenate([np.ones((len(u), 1)), u[:, None], np.maximum(0, u[:, None] - points)], axis=1)
    a, s = base(t), _seasons(days, holidays)
    season, beta, change, noise = np.zeros(len(y)), np.zeros(s.shape[1]), np.full(n_changes, prior), 0.1
    theta = np.zeros(a.shape[1])
    for _ in range(rounds):
        x = a * (1 + season)[:, None]
        weight = np.concatenate([[1 / 25, 1 / 25], 1 / (prior * np.maximum(np.abs(change), 1e-4))])
        theta = np.linalg.solve(x.T @ x / noise**2 + np.diag(weight), x.T @ z / noise**2)
        change, trend = theta[2:], a @ theta
        x = s * trend[:, None]
        beta = np.linalg.solve(x.T @ x / noise**2 + np.eye(s.shape[1]) / 100, x.T @ (z - trend) / noise**2)
        season = s @ beta
        noise = max(1e-4, float(np.sqrt(np.mean((z - trend * (1 + season)) ** 2))))
    trend, season = base(tf) @ theta, 1 + _seasons(future, holidays) @ beta
    spread = noise * np.sqrt(len(y) / max(1.0, len(y) - _freedom(a * (1 + s @ beta)[:, None], np.concatenate([[1 / 25, 1 / 25], 1 / (prior * np.maximum(np.abs(change), 1e-4))]), noise) - _freedom(s * (a @ theta)[:, None], np.full(s.shape[1], 1 / 100), noise)))
    rnd = np.random.default_rng(seed)
    paths = (trend + _new_trends(rnd, tf, n_changes / CHANGE_SPAN, float(np.abs(change).mean()) if n_changes else 0.0, samples)) * season
    low, high = np.quantile(paths + rnd.normal(0, spread, paths.shape), [0.5 - width / 2, 0.5 + width / 2], axis=0)
    center = trend * season
    return center * scale, np.minimum(low, center) * scale, np.maximum(high, center) * scale


def _freedom(x: np.ndarray, weight: np.ndarray, noise: float) -> float:
    """How many parameters a ridge fit has in effect."""
    gram = x.T @ x / noise**2
    return float(np.trace(np.linalg.solve(gram + np.diag(weight), gram)))


def _new_trends(rnd: np.random.Generator, ahead: np.ndarray, rate: float, size: float, samples: int) -> np.ndarray:
    """What slope changes after time 1 add to the trend at times ``ahead``, a row a sample: ``rate`` of them in a unit of time, Laplace of mean ``size``."""
    end = max(float(ahead.max()), 1.0)
    counts = rnd.poisson(rate * (end - 1), samples)
    most = max(1, int(counts.max()))
    at, slope = rnd.uniform(1, end, (samples, most)), rnd.laplace(0, size, (samples, most)) * (np.arange(most) < counts[:, None])
    return np.einsum("sc,sch->sh", slope, np.maximum(0, ahead - at[:, :, None]))


# -- ARIMA by exact likelihood, many series at once


def _coefficients(partial: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions from their partial autocorrelations, a row each."""
    out = partial.copy()
    for k in range(1, partial.shape[1]):
        out[:, :k] = out[:, :k] - partial[:, k : k + 1] * out[:, :k][:, ::-1]
    return out


def _partials(coefficients: np.ndarray) -> np.ndarray:
    """The way back, for one row of coefficients of a stationary autoregression."""
    left, out = coefficients.copy(), np.empty(len(coefficients))
    for k in range(len(coefficients) - 1, -1, -1):
        out[k] = left[k]
        left = (left[:k] + left[k] * left[:k][::-1]) / (1 - left[k] ** 2)
    return out


def _parameters(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA coefficients of any numbers: both are within the region where the model holds."""
    r = np.tanh(x)
    return _coefficients(r[:, :p]), -_coefficients(r[:, p:])


@dataclass
class Filtered:
    """Exact innovations of a batch (rows) over time, their variances in units of the noise's, and what is known of the next values."""

    innovations: np.ndarray
    variances: np.ndarray
    state: np.ndarray
    covariance: np.ndarray


def kalman(w: np.ndarray, lengths: np.ndarray, ar: np.ndarray, ma: np.ndarray, block: int = 64) -> Filtered:
    """The Kalman filter of ARMA models in their state-space form, from the stationary distribution.

    ``w`` has a series a row, zeros after its length. The filter's variance doesn't hang on the values: once it no longer
    changes in any row, innovations follow a fixed recursion, which goes on in blocks as products with its impulse response.
    After a series' end its state stays as it was.
    """
    n_rows, n = w.shape
    p, q = ar.shape[1], ma.shape[1]
    r = max(p, q + 1)
    phi, shock = np.zeros((n_rows, r)), np.zeros((n_rows, r))
    phi[:, :p], shock[:, 0], shock[:, 1 : q + 1] = ar, 1.0, ma
    noise = shock[:, :, None] * shock[:, None, :]
    step = np.zeros((n_rows, r, r))
    step[:, :, 0] = phi
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    twice = np.einsum("bij,bkl->bikjl", step, step).reshape(n_rows, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) - twice, noise.reshape(n_rows, r * r, 1)).reshape(n_rows, r, r)
    state = np.zeros((n_rows, r))
    v, f = np.zeros((n_rows, n)), np.ones((n_rows, n))
    last_state, last_cov = np.zeros((n_rows, r)), noise.copy()
    t = 0
    while t < n and (t < r or np.abs(cov - noise).max() > 1e-12):
        ended = lengths == t
        last_state[ended], last_cov[ended] = state[ended], cov[ended]
        f[:, t] = cov[:, 0, 0]
        v[:, t] = w[:, t] - state[:, 0]
        gain = cov[:, :, 0] / f[:, t, None]
        known = state + gain * v[:, t, None]
        cov = cov - gain[:, :, None] * gain[:, None, :] * f[:, t, None, None]
        state = phi * w[:, t, None]
        state[:, :-1] += known[:, 1:]
        moved = noise.copy()
        moved[:, :-1, :-1] += cov[:, 1:, 1:]
        cov = moved
        t += 1
    if t < n:
        u = w[:, t:].copy()
        for k in range(1, p + 1):
            u[:, k:] -= ar[:, k - 1 : k] * w[:, t : n - k]
        u[:, : min(r, n - t)] -= state[:, : min(r, n - t)]
        response = np.zeros((n_rows, block))
        response[:, 0] = 1.0
        for k in range(1, block):
            for j in range(1, min(k, q) + 1):
                response[:, k] -= ma[:, j - 1] * response[:, k - j]
        lag = np.subtract.outer(np.arange(block), np.arange(block))
        filter_ = np.where(lag >= 0, response[:, np.maximum(lag, 0)], 0.0)
        for at in range(0, n - t, block):
            part = u[:, at : at + block]
            for k in range(min(q, part.shape[1])):
                for j in range(k + 1, q + 1):
                    if at >= j - k:
                        part[:, k] -= ma[:, j - 1] * v[:, t + at + k - j]
            size = part.shape[1]
            v[:, t + at : t + at + size] = (filter_[:, :size, :size] @ part[:, :, None])[:, :, 0]
        steady = np.flatnonzero(lengths > t)
        for i in range(r):  # the state after each series' end, from its last values and innovations
            for j in range(r - i):
                back = lengths[steady] - 1 - j
                from_w = phi[steady, i + j] * w[steady, back]
                from_v = (ma[steady, i + j] if i + j < q else 0.0) * v[steady, back]
                last_state[steady, i] += np.where(back >= t, from_w + from_v, 0.0)
            early = lengths[steady] - t < r - i  # so soon after the filter settled that its state still shows
            k = steady[early]
            last_state[k, i] += state[k, i + lengths[k] - t]
        last_cov[steady] = noise[steady]
        ended = lengths == t
        last_state[ended], last_cov[ended] = state[ended], cov[ended]
    else:
        ended = lengths == n
        last_state[ended], last_cov[ended] = state[ended], cov[ended]
    inside = np.arange(n) < lengths[:, None]
    return Filtered(np.where(inside, v, 0.0), np.where(inside, f, 1.0), last_state, last_cov)


def likelihood(found: Filtered, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The noise's variance that is most likely, and the log-likelihood with it, of each row."""
    variance = (found.innovations**2 / found.variances).sum(axis=1) / lengths
    return variance, -0.5 * (lengths * (np.log(2 * np.pi * variance) + 1) + np.log(found.variances).sum(axis=1))


def _scaled(w: np.ndarray, lengths: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """Residuals whose sum of squares is least where the exact likelihood is greatest."""
    found = kalman(w, lengths, *_parameters(x, p))
    mean = np.log(found.variances).sum(axis=1) / lengths
    return found.innovations / np.sqrt(found.variances) * np.exp(mean / 2)[:, None]


def _start(w: np.ndarray, p: int, q: int) -> np.ndarray:
    """First parameters of one series: innovations from a long autoregression, then least squares on values and innovations."""
    m = min(len(w) // 3, p + q + 4)
    lags = lambda x, k, at: np.stack([x[at - j : len(x) - j] for j in range(1, k + 1)], axis=1)
    e = np.concatenate([np.zeros(m), w[m:] - lags(w, m, m) @ np.linalg.lstsq(lags(w, m, m), w[m:], rcond=None)[0]])
    at = m + max(p, q)
    theta = np.linalg.lstsq(np.concatenate([lags(w, p, at)[:, :p] if p else np.empty((len(w) - at, 0)), lags(e, q, at)[:, :q] if q else np.empty((len(w) - at, 0))], axis=1), w[at:], rcond=None)[0]
    for _ in range(60):  # into the region where the model holds
        partial = np.concatenate([_partials(theta[:p]), _partials(-theta[p:])])
        if (np.abs(partial) < 0.97).all():
            return np.arctanh(partial)
        theta = theta * 0.9
    return np.full(p + q, 0.1)


def fit_arma(w: np.ndarray, lengths: np.ndarray, p: int, q: int, steps: int = 40) -> np.ndarray:
    """The most likely parameters of each row, by damped Gauss-Newton steps of all rows at once (numbers for ``_parameters``)."""
    n_rows, k = len(w), p + q
    x = np.stack([_start(w[i, :n], p, q) for i, n in enumerate(lengths)])
    damp, tiny, dampings = np.full(n_rows, 1e-2), 1e-6, np.array([1e-3, 1e-1, 1.0, 1e1, 1e3])
    live = np.arange(n_rows)
    for _ in range(steps):
        tried = np.concatenate([x[live][None], x[live] + tiny * np.eye(k)[:, None]]).reshape(-1, k)
        res = _scaled(np.tile(w[live], (k + 1, 1)), np.tile(lengths[live], k + 1), tried, p).reshape(k + 1, len(live), -1)
        loss = (res[0] ** 2).sum(axis=1)
        slope = (res[1:] - res[0]) / tiny
        gram, side = np.einsum("ibn,jbn->bij", slope, slope), np.einsum("ibn,bn->bi", slope, res[0])
        diagonal = np.maximum(np.einsum("bii->bi", gram), 1e-12 * loss[:, None] + 1e-300)
        lifted = gram[None] + (damp[live] * dampings[:, None])[:, :, None, None] * (diagonal[:, :, None] * np.eye(k))
        moves = np.clip(-np.linalg.solve(lifted, np.broadcast_to(side, (len(dampings), *side.shape))[..., None])[..., 0], -1.0, 1.0)
        ways = np.clip(x[live] + moves, -4.0, 4.0)
        losses = (_scaled(np.tile(w[live], (len(dampings), 1)), np.tile(lengths[live], len(dampings)), ways.reshape(-1, k), p) ** 2).sum(axis=1).reshape(len(dampings), -1)
        losses[~np.isfinite(losses)] = np.inf
        best = losses.argmin(axis=0)
        least = losses[best, np.arange(len(live))]
        better = least < loss
        moved = np.abs(ways[best, np.arange(len(live))] - x[live]).max(axis=1)
        x[live[better]] = ways[best, np.arange(len(live))][better]
        damp[live] = np.clip(damp[live] * np.where(better, dampings[best], 1e2), 1e-9, 1e9)
        live = live[np.where(better, (loss - least > 1e-13 * loss) & (moved > 1e-8), damp[live] < 1e8)]
        if not len(live):
            break
    return x


def padded(series: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays as rows with zeros behind them, and their lengths."""
    lengths = np.array([len(x) for x in series], np.int64)
    out = np.zeros((len(series), int(lengths.max())))
    for i, x in enumerate(series):
        out[i, : len(x)] = x
    return out, lengths


def arima_ahead(found: Filtered, variance: np.ndarray, ar: np.ndarray, ma: np.ndarray, ends: Sequence[np.ndarray], d: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of the next h levels and their deviations. ``ends``: the last level, the last difference and so on of each row."""
    n_rows, r = found.state.shape
    step = np.zeros((n_rows, r, r))
    step[:, : ar.shape[1], 0] = ar
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    shock = np.zeros((n_rows, r, 1))
    shock[:, 0], shock[:, 1 : ma.shape[1] + 1, 0] = 1.0, ma
    look = np.zeros((n_rows, h, r))  # the first row of each power of the step
    look[:, 0, 0] = 1.0
    for i in range(1, h):
        look[:, i] = (look[:, i - 1, None] @ step)[:, 0]
    psi = (look @ shock)[:, :, 0]
    lag = np.subtract.outer(np.arange(h), np.arange(h))
    later = np.where((lag >= 0) & (np.arange(h) > 0), psi[:, np.maximum(lag, 0)], 0.0)  # the first shock is in the state's covariance
    center = (look @ found.state[:, :, None])[:, :, 0]
    add = np.linalg.matrix_power(np.tril(np.ones((h, h))), d)
    root = add @ later
    spread = add @ look @ found.covariance @ look.transpose(0, 2, 1) @ add.T + root @ root.transpose(0, 2, 1)
    for level in reversed(range(d)):
        center = ends[level][:, None] + center.cumsum(axis=1)
    return center, np.sqrt(np.einsum("bii->bi", spread) * variance[:, None])


def arima_forecasts(series: Sequence[np.ndarray], h: int, order: tuple[int, int, int] = (2, 1, 2), fallback: tuple[int, int, int] | None = (1, 1, 1), alpha: float = 0.05) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | CannotFit]:
    """ARIMA by exact Gaussian likelihood: forecasts and bands of a batch of series, or why there are none; then a smaller order is tried.

    Levels before the first are free (a diffuse start), so that the likelihood is that of the differences.
    """
    p, d, q = order
    out: list = [CannotFit(f"too few rates for ARIMA{order}")] * len(series)
    rows, scales = [], []
    for i, y in enumerate(series):
        w = np.diff(y, d) if d else y
        if len(w) < 3 * (p + q) + 8 or not np.isfinite(w).all():
            continue
        if w.std() <= 1e-12 * max(1.0, float(np.abs(y).max())):
            out[i] = CannotFit("the differences don't vary")
            continue
        rows.append(i)
        scales.append(float(np.sqrt(np.mean(w * w))))
    if rows:
        scale = np.array(scales)
        w, lengths = padded([(np.diff(series[i], d) if d else series[i]) / s for i, s in zip(rows, scales)])
        x = fit_arma(w, lengths, p, q) if p + q else np.empty((len(rows), 0))
        ar, ma = _parameters(x, p)
        found = kalman(w, lengths, ar, ma)
        variance, _ = likelihood(found, lengths)
        ends = [np.array([np.diff(series[i], k)[-1] for i in rows]) / scale for k in range(d)]
        center, deviation = arima_ahead(found, variance, ar, ma, ends, d, h)
        half = normal_quantile(1 - alpha / 2) * deviation
        for i, c, w_, s in zip(rows, center, half, scales):
            fine = np.isfinite(c).all() and np.isfinite(w_).all()
            out[i] = (c * s, (c - w_) * s, (c + w_) * s) if fine else CannotFit(f"ARIMA{order} gives no number")
    failed = [i for i, x in enumerate(out) if isinstance(x, CannotFit)]
    if failed and fallback:
        for i, x in zip(failed, arima_forecasts([series[i] for i in failed], h, fallback, None, alpha)):
            out[i] = x
    return out


def business_days(days: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mondays to Fridays from the first with a rate to the last day of a series, each with the last business day's rate; as ``panel.to_business_days``."""
    work = np.is_busday(days) & np.isfinite(y)
    if not work.any():
        return days[:0], y[:0]
    grid = np.arange(days[work][0], days[-1] + 1)
    grid = grid[np.is_busday(grid)]
    return grid, y[work][np.searchsorted(days[work], grid, side="right") - 1]
