"""Special functions for arrays: normal, gamma and Pearson III distributions."""

from __future__ import annotations

import math

import numpy as np

_AT = np.arange(-38 * 64, 9 * 64 + 1) / 64
_BELOW = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _AT])
#: Coefficients of Stirling's series for log gamma: B(2k) / (2k (2k - 1)).
_STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
#: Shapes from which the uniform expansion is used instead of a series.
_LARGE = 1e4


def normal_density(x: np.ndarray) -> np.ndarray:
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x) -> np.ndarray:
    """Taylor's series around the nearest point of a table, by Hermite's polynomials; relative to its value down to -37."""
    x = np.clip(np.asarray(x, float), -37.9, 8.9)
    i = np.rint((np.nan_to_num(x) - _AT[0]) * 64).astype(np.int64)
    a = _AT[i]
    h = x - a
    before, he, power, total = np.zeros_like(a), np.ones_like(a), h, h.copy()
    for k in range(1, 12):
        before, he = he, a * he - (k - 1) * before
        power = -power * h / (k + 1)
        total = total + he * power
    return _BELOW[i] + normal_density(a) * total


def normal_ppf(p):
    """Inverse of normal_cdf by Halley's method from a rational start; infinite at 0 and 1."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, np.minimum(p, 1 - p), 0.5)
    s = np.sqrt(-2 * np.log(q))
    z = (2.515517 + 0.802853 * s + 0.010328 * s * s) / (1 + 1.432788 * s + 0.189269 * s * s + 0.001308 * s**3) - s
    for _ in range(4):
        step = (normal_cdf(z) - q) / np.maximum(normal_density(z), 1e-300)
        z = z - step / (1 + z * step / 2)
    z = np.where(p < 0.5, z, -z)
    return np.where(inside, z, np.where(p <= 0, -np.inf, np.inf))[()]


def log_gamma(x) -> np.ndarray:
    """Stirling's series, after small arguments are raised by 10."""
    x = np.asarray(x, float)
    small = x < 10
    y = np.where(small, x + 10, x)
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    rising = np.prod([np.where(small, x + k, 1.0) for k in range(10)], axis=0)
    return out - np.log(rising)


def gamma_weight(a, y) -> np.ndarray:
    """y^a e^-y / gamma(a), which is y times the density at y; exact for large a too."""
    a, y = np.asarray(a, float), np.asarray(y, float)
    far = (y - a) / a
    large = a >= 20
    b = np.where(large, a, 20.0)
    rest = sum(c / b ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    with np.errstate(over="ignore", divide="ignore"):
        near = np.sqrt(b / (2 * math.pi)) * np.exp(-b * (far - np.log1p(np.maximum(far, -1))) - rest)
        plain = np.exp(a * np.log(np.maximum(y, 1e-300)) - y - log_gamma(a))
    return np.where(y <= 0, 0.0, np.where(large, near, plain))


def _uniform(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Temme's expansion to its first term, for large shapes."""
    far = (y - a) / a
    eta = np.sign(far) * np.sqrt(np.maximum(2 * (far - np.log1p(np.maximum(far, -1 + 1e-12))), 0))
    near = np.abs(eta) < 0.03
    safe = np.where(near, 1.0, eta)
    c0 = np.where(near, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864, 1 / np.where(near, 1.0, far) - 1 / safe)
    rest = np.exp(-a * eta**2 / 2) / np.sqrt(2 * math.pi * a) * c0
    return np.clip(normal_cdf(eta * np.sqrt(a)) - rest, 0, 1), np.clip(normal_cdf(-eta * np.sqrt(a)) + rest, 0, 1)


def gamma_tails(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower and upper incomplete gamma functions, each exact where it is small: series, continued fraction or, for large a, an expansion."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    shape = a.shape
    a, x = a.ravel(), x.ravel()
    lower, upper = np.zeros(len(a)), np.ones(len(a))
    positive = x > 0
    at = np.flatnonzero(positive & (a > _LARGE))
    lower[at], upper[at] = _uniform(a[at], x[at])
    weight = gamma_weight(a, np.where(positive, x, 1.0))
    at = np.flatnonzero(positive & (a <= _LARGE) & (x < a + 1))
    term = 1 / a[at]
    total, k, live = term.copy(), a[at].copy(), np.arange(len(at))
    while len(live):
        k[live] += 1
        term[live] *= x[at[live]] / k[live]
        total[live] += term[live]
        live = live[term[live] > 1e-17 * total[live]]
    lower[at] = np.minimum(weight[at] * total, 1)
    upper[at] = 1 - lower[at]
    at = np.flatnonzero(positive & (a <= _LARGE) & (x >= a + 1))
    b = x[at] + 1 - a[at]
    c, d = np.full(len(at), 1e300), 1 / b
    h, live, i = d.copy(), np.arange(len(at)), 0
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    while len(live):
        i += 1
        own = -i * (i - a[at[live]])
        b[live] += 2
        d[live] = 1 / tiny(own * d[live] + b[live])
        c[live] = tiny(b[live] + own / c[live])
        change = d[live] * c[live]
        h[live] *= change
        live = live[np.abs(change - 1) > 1e-15]
        if i > 20_000:
            break
    upper[at] = np.clip(weight[at] * h, 0, 1)
    lower[at] = 1 - upper[at]
    return lower.reshape(shape)[()], upper.reshape(shape)[()]


def gamma_cdf(a, x):
    return gamma_tails(a, x)[0]


def gamma_ppf(a, p, upper: bool = False):
    """The x whose lower (or upper) tail is p: Halley's steps inside a shrinking bracket, from Wilson and Hilferty's approximation."""
    a, p = (v.ravel().copy() for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float)))
    z = normal_ppf(p) * (-1 if upper else 1)
    z = np.clip(np.nan_to_num(z, posinf=9, neginf=-9), -9, 9)
    cube = 1 - 1 / (9 * a) + z / (3 * np.sqrt(a))
    least = np.where(upper, 1 - p, p)
    with np.errstate(all="ignore"):
        head = np.exp((np.log(np.maximum(least, 1e-300)) + log_gamma(a + 1)) / a)
    x = np.where((cube > 0.2) | (a > 50), a * np.maximum(cube, 1e-3) ** 3, np.clip(head, 1e-300, a))
    low, high = np.zeros(len(a)), np.full(len(a), np.inf)
    live = np.flatnonzero((p > 0) & (p < 1))
    for _ in range(200):
        if not len(live):
            break
        own, t = a[live], x[live]
        tails = gamma_tails(own, t)
        miss = p[live] - tails[1] if upper else tails[0] - p[live]
        low[live], high[live] = np.where(miss < 0, t, low[live]), np.where(miss >= 0, t, high[live])
        slope = np.maximum(gamma_weight(own, t) / t, 1e-300)
        step = miss / slope
        bend = 1 - step * ((own - 1) / t - 1) / 2
        new = t - step / np.where(bend > 0.2, bend, 1)
        middle = np.where(np.isinf(high[live]), 2 * t + 1, (low[live] + np.minimum(high[live], 1e308)) / 2)
        near = np.abs(new - t) <= 1e-14 * t
        x[live] = np.where(near | ((new > low[live]) & (new < high[live])), new, middle)
        live = live[~near & (high[live] - low[live] > 1e-15 * t)]
    out = np.where((p > 0) & (p < 1), x, np.where((p <= 0) != upper, 0.0, np.inf))
    return out if len(out) > 1 else out[0]


def pearson3_cdf(x, mean, std, skew) -> np.ndarray:
    """P(X < x) for a shifted gamma distribution with the given moments; nearly symmetric ones are normal."""
    x, mean, std, skew = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, mean, std, skew)))
    z = (x - mean) / std
    flat = ~(np.abs(skew) >= 1e-5)
    g = np.where(flat, 1.0, skew)
    a = 4 / g**2
    lower, upper = gamma_tails(a, a + z * np.sqrt(a) * np.sign(g))
    return np.where(flat | np.isnan(z), normal_cdf(z), np.where(g > 0, lower, upper))


def pearson3_ppf(p, mean, std, skew):
    """Quantile of a shifted gamma distribution with the given moments; nearly symmetric ones are normal."""
    p, mean, std, skew = (v.ravel() for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (p, mean, std, skew))))
    flat = ~(np.abs(skew) >= 1e-5)
    g = np.where(flat, 1.0, skew)
    a, out = 4 / g**2, mean + std * normal_ppf(p)
    for upper, at in ((False, np.flatnonzero(~flat & (g > 0))), (True, np.flatnonzero(~flat & (g < 0)))):
        if len(at):
            y = np.atleast_1d(gamma_ppf(a[at], p[at], upper))
            out[at] = mean[at] + std[at] * g[at] / 2 * (y - a[at])
    return out[0] if len(out) == 1 else out
