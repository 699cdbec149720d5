"""Gamma-family functions and tail probabilities on NumPy arrays and scalars."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_SHIFT = 10


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive arguments: shifted upwards, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    product = np.ones_like(x)
    for k in range(_SHIFT):
        product = product * np.where(x < _SHIFT, x + k, 1.0)
    z = np.where(x < _SHIFT, x + _SHIFT, x)
    inv2 = 1.0 / (z * z)
    series = (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    low = x < _SHIFT
    shift = np.zeros_like(x)
    for k in range(_SHIFT):
        shift += np.where(low, 1.0 / (x + k), 0.0)
    z = np.where(low, x + _SHIFT, x)
    inv2 = 1.0 / (z * z)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240)))
    return np.log(z) - 0.5 / z - series - shift


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    low = x < _SHIFT
    shift = np.zeros_like(x)
    for k in range(_SHIFT):
        shift += np.where(low, 1.0 / (x + k) ** 2, 0.0)
    z = np.where(low, x + _SHIFT, x)
    inv, inv2 = 1.0 / z, 1.0 / (z * z)
    series = inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30)))
    return inv + 0.5 * inv2 + series + shift


def negbin_terms(y: np.ndarray, size: float, mu: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of each count, its score and its information for the size."""
    one = np.full(1, size)
    loglik = (
        lgamma(y + size) - lgamma(one) - lgamma(y + 1)
        + size * math.log(size) + y * np.log(mu) - (y + size) * np.log(size + mu)
    )
    score = digamma(y + size) - digamma(one) + math.log(size) + 1 - np.log(mu + size) - (y + size) / (mu + size)
    info = trigamma(one) - trigamma(y + size) - 1 / size + 2 / (mu + size) - (y + size) / (mu + size) ** 2
    return loglik, score, info


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def f_upper(x: float, df1: float, df2: float) -> float:
    """P(X > x) for an F variable, by the continued fraction of the incomplete beta function."""
    if x <= 0 or df1 <= 0 or df2 <= 0:
        return 1.0
    a, b, t = df2 / 2, df1 / 2, df2 / (df2 + df1 * x)
    flip = t > (a + 1) / (a + b + 2)
    if flip:
        a, b, t = b, a, 1 - t
    if t <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(t) + b * math.log1p(-t)) / a
    c, d = 1.0, 1 / (1 - (a + b) * t / (a + 1) or 1e-300)
    h = d
    for m in range(1, 2000):
        for num in (m * (b - m) * t / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * t / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if flip else front * h


def chi2_upper(x: float, df: float) -> float:
    """P(X > x) for a chi-square variable."""
    if df <= 0 or x <= 0:
        return 1.0
    a, t = df / 2, x / 2
    front = math.exp(-t + a * math.log(t) - math.lgamma(a))
    if t < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= t / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = t + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def weighted_chi2_upper(x: float, weights: dict[float, float]) -> float:
    """P(sum of w X_w > x), X_w independent chi-square variables with weights[w] degrees of freedom; weights may be negative.

    Imhof's integral over half periods of its oscillation, the alternating rest summed by repeated averages; far out in the
    tail, where only the integral's error would be left, Kuonen's saddlepoint approximation.
    """
    w = np.array([k for k in weights if weights[k] > 0 and k != 0.0], dtype=float)
    m = np.array([weights[k] for k in w.tolist()], dtype=float)
    if not len(w):
        return 1.0 if x < 0 else 0.0
    if np.ptp(w) == 0 and w[0] > 0:
        return chi2_upper(x / w[0], float(m.sum()))
    if (w > 0).all() and x <= 0:
        return 1.0
    scale = float(np.abs(w).max())
    w, x = w / scale, x / scale
    period = 2 * math.pi / max(abs(x), 0.5)
    edges = np.r_[0.0, period * 2.0 ** np.arange(-10, 1), period * np.arange(2, 90)]
    nodes, gauss = np.polynomial.legendre.leggauss(24)
    low, high = edges[:-1, None], edges[1:, None]
    u = (high + low) / 2 + (high - low) / 2 * nodes
    theta = 0.5 * (m * np.arctan(w * u[..., None])).sum(-1) - 0.5 * x * u
    decay = np.exp(-np.minimum(0.25 * (m * np.log1p((w * u[..., None]) ** 2)).sum(-1), 700.0))
    parts = (np.sin(theta) * decay / u * gauss).sum(1) * (high - low)[:, 0] / 2
    tail = np.cumsum(parts)[-40:]
    while len(tail) > 1:
        tail = (tail[1:] + tail[:-1]) / 2
    p = 0.5 + float(tail[0]) / math.pi
    return min(max(p, 0.0), 1.0) if p > 1e-4 else _saddlepoint_upper(x, w, m)


def _saddlepoint_upper(x: float, w: np.ndarray, m: np.ndarray) -> float:
    """Upper tail by the cumulant function -sum m/2 log(1 - 2 t w) at the root of its derivative x."""
    top = 1 / (2 * w.max()) if w.max() > 0 else math.inf
    bottom = 1 / (2 * w.min()) if w.min() < 0 else -1e6
    if math.isinf(top):
        return 0.0
    low, high = bottom * (1 - 1e-12), top * (1 - 1e-12)
    for _ in range(300):
        t = (low + high) / 2
        if (m * w / (1 - 2 * t * w)).sum() < x:
            low = t
        else:
            high = t
    t = (low + high) / 2
    k0 = -0.5 * (m * np.log1p(-2 * t * w)).sum()
    k2 = 2 * (m * w**2 / (1 - 2 * t * w) ** 2).sum()
    r = math.copysign(math.sqrt(max(2 * (t * x - k0), 0.0)), t)
    v = t * math.sqrt(k2)
    if abs(r) < 1e-8 or v / r <= 0:
        return 0.5
    z = r + math.log(v / r) / r
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_lower(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, for arrays."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    t, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    t = np.clip(t, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
    c = np.ones_like(t)
    d = 1 / np.where(np.abs(v := 1 - (p + q) * t / (p + 1)) < 1e-300, 1e-300, v)
    h = d.copy()
    for k in range(1, 3000):
        change = 0.0
        for term in (k * (q - k) * t / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * t / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 / np.where(np.abs(v := 1 + term * d) < 1e-300, 1e-300, v)
            c = np.where(np.abs(v := 1 + term / c) < 1e-300, 1e-300, v)
            h = h * c * d
            change = c * d
        if np.abs(change - 1).max(initial=0.0) < 1e-13:
            break
    return np.where(flip, 1 - front * h, front * h)


#: A Poisson count is a negative binomial one of this size.
POISSON_SIZE = 1e8


def negbin_quantile(u: np.ndarray, size: float, mu: np.ndarray) -> np.ndarray:
    """Least count whose distribution function reaches u: a normal start, then steps by the probabilities beside it."""
    size = min(size, POISSON_SIZE)
    u = np.clip(u, 1e-12, 1 - 1e-12)
    normal = NormalDist()
    z = np.array([normal.inv_cdf(v) for v in u.tolist()])
    sd = np.sqrt(mu + mu * mu / size)
    skew = (1 + 2 * mu / size) / np.maximum(sd, 1e-12)
    count = np.maximum(np.floor(mu + sd * (z + skew * (z * z - 1) / 6)), 0.0)
    reached = beta_lower(size / (size + mu), np.full_like(mu, size), count + 1)
    chance = lambda k, i: np.exp(negbin_terms(k, size, mu[i])[0])
    low = np.flatnonzero(reached < u)
    while len(low):
        count[low] += 1
        reached[low] += chance(count[low], low)
        # beyond any mass that rounding leaves out
        low = low[(reached[low] < u[low]) & (count[low] < mu[low] + 60 * sd[low] + 60)]
    high = np.flatnonzero(count > 0)
    while len(high):
        below = reached[high] - chance(count[high], high)
        step = below >= u[high]
        high, below = high[step], below[step]
        count[high] -= 1
        reached[high] = below
        high = high[count[high] > 0]
    return count
