"""Special functions and small optimisers in plain numpy: what statistics needs beyond SQL's scalar functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np

EPS = 1e-15
_NORMAL = NormalDist()


def logsumexp(a: np.ndarray, axis: int = 1) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def softmax(a: np.ndarray, limit: float = 50.0) -> np.ndarray:
    """Row-wise softmax of logits held within +-limit."""
    e = np.exp(np.clip(a, -limit, limit) - np.clip(a, -limit, limit).max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logit(p):
    p = np.clip(p, EPS, 1 - EPS)
    return np.log(p) - np.log1p(-p)


def expit(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x) -> np.ndarray:
    """log Gamma of an array, evaluated once for each distinct value."""
    x = np.asarray(x, float)
    values, back = np.unique(x, return_inverse=True)
    return _lgamma(values).astype(float)[back].reshape(x.shape)


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300  # continued fraction (modified Lentz)
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square with df degrees of freedom > x); nan without degrees of freedom."""
    return float("nan") if df <= 0 or x != x else gamma_q(df / 2.0, max(x, 0.0) / 2.0)


def normal_cdf(x):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def two_sided(z):
    """Two-sided normal p-values."""
    return np.vectorize(math.erfc, otypes=[float])(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def adjust_p(p: Sequence[float], method: str) -> np.ndarray:
    """Multiplicity-adjusted p-values: none, bonferroni, holm or BH."""
    p = np.asarray(p, float)
    n = len(p)
    if method == "none" or not n:
        return p
    if method == "bonferroni":
        return np.minimum(1.0, n * p)
    order = np.argsort(p, kind="stable")
    out = np.empty(n)
    if method == "holm":
        out[order] = np.minimum(1.0, np.maximum.accumulate((n - np.arange(n)) * p[order]))
    elif method == "BH":
        out[order] = np.minimum(1.0, np.minimum.accumulate((n / np.arange(1, n + 1) * p[order])[::-1])[::-1])
    else:
        raise ValueError(f"no such adjustment: {method}")
    return out


def pinv(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse, singular values below sqrt(machine epsilon) of the largest left out."""
    return np.linalg.pinv(a, rcond=math.sqrt(np.finfo(float).eps))


def inverse(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a moment or information matrix, scaled to a unit diagonal first, so that units do not matter."""
    d = np.sqrt(np.abs(np.diag(a)))
    d = np.where(d > 0, d, 1.0)
    return pinv(a / np.outer(d, d)) / np.outer(d, d)


def gauss_hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the standard normal; one node is the mean."""
    if n == 1:
        return np.zeros(1), np.ones(1)
    nodes, weights = np.polynomial.hermite_e.hermegauss(n)
    return nodes, weights / weights.sum()


def imhof(q: float, weights: Sequence[float], df: Sequence[float] | None = None) -> float:
    """P(sum of weights times chi-squares > q) by numerical inversion of the characteristic function."""
    lam = np.asarray(weights, float)
    lam = lam[np.abs(lam) > 1e-12]
    if not len(lam):
        return float(q < 0)
    h = np.ones(len(lam)) if df is None else np.asarray(df, float)
    scale = np.abs(lam).max()
    lam, q = lam / scale, q / scale
    # substitute u = t / (1 - t) and integrate piecewise by Gauss-Legendre
    x, w = np.polynomial.legendre.leggauss(40)
    edges = 1 - np.geomspace(1.0, 1e-7, 400)
    mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
    t = (mid[:, None] + half[:, None] * x[None, :]).ravel()
    weight = (half[:, None] * w[None, :]).ravel()
    u = t / (1 - t)
    theta = 0.5 * (h * np.arctan(np.outer(u, lam))).sum(axis=1) - 0.5 * q * u
    rho = np.exp(0.25 * (h * np.log1p(np.outer(u, lam) ** 2)).sum(axis=1))
    total = float((weight * np.sin(theta) / (u * rho) / (1 - t) ** 2).sum())
    return min(1.0, max(0.0, 0.5 + total / math.pi))


def gradient(f: Callable[[np.ndarray], np.ndarray | float], x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central differences of f (scalar or vector valued); the last axis is the parameter."""
    out = []
    for j in range(len(x)):
        h = step * max(1.0, abs(x[j]))
        up, down = x.copy(), x.copy()
        up[j] += h
        down[j] -= h
        out.append((np.asarray(f(up), float) - np.asarray(f(down), float)) / (2 * h))
    return np.stack(out, axis=-1) if out else np.zeros(0)


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    h = gradient(lambda y: gradient(f, y, step), x, step)
    return (h + h.T) / 2


def newton(score: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], x: np.ndarray, *, rounds: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Maximise a concave function given (value, gradient, Hessian), halving steps that do not climb."""
    value, g, h = score(x)
    for _ in range(rounds):
        step = inverse(-h) @ g
        if not np.isfinite(step).all() or np.abs(step).max(initial=0) < tol:
            break
        size = 1.0
        while size > 1e-8:
            new = score(x + size * step)
            if np.isfinite(new[0]) and new[0] >= value - 1e-12:
                break
            size /= 2
        else:
            break
        x, (value, g, h) = x + size * step, new
    return x


def bfgs(f: Callable[[np.ndarray], float], x: np.ndarray, *, grad: Callable[[np.ndarray], np.ndarray] | None = None, rounds: int = 200, tol: float = 1e-7) -> np.ndarray:
    """Minimise f by BFGS with a backtracking line search."""
    grad = grad or (lambda y: gradient(f, y))
    value, g, b = f(x), grad(x), np.eye(len(x))
    for _ in range(rounds):
        if np.abs(g).max(initial=0) < tol:
            break
        step = -b @ g
        if step @ g >= 0:
            b, step = np.eye(len(x)), -g
        size = min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        while size > 1e-12 and not (f(x + size * step) <= value + 1e-4 * size * (step @ g)):
            size /= 2
        if size <= 1e-12:
            break
        new = x + size * step
        h = grad(new)
        s, y = new - x, h - g
        if s @ y > 1e-12:
            r = 1.0 / (s @ y)
            e = np.eye(len(x)) - r * np.outer(s, y)
            b = e @ b @ e.T + r * np.outer(s, s)
        x, value, g = new, f(new), h
    return x


def golden(f: Callable[[float], float], low: float, high: float, tol: float = 1e-9) -> float:
    """The minimiser of a unimodal function on an interval."""
    r = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol * (1 + abs(a) + abs(b)):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2
