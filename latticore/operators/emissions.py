"""Measurement families: per-class densities of a block of items, as numpy kernels for fitting and as columns for scoring.

Every family has the same five parts: starts, log-density (n x K), additive sufficient statistics, the update that turns
summed statistics into parameters (with prior pseudo-observations), and the density as Spark columns.  Missing cells (nan)
add nothing to a density and leave their item's statistics.  As statistics are additive, they may be summed over any partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticore.functions.special import EPS, golden, lgamma

Params = dict[str, np.ndarray]


class Emission:
    """A block of items of one family with K classes.  alpha: the prior's weight in observations over all classes."""

    name = ""

    def __init__(self, items: Sequence[str], k: int, alpha: float = 1.0):
        self.items, self.k, self.alpha = list(items), k, alpha

    def marginal(self, x: np.ndarray, w: np.ndarray) -> Params:
        """What priors and starts need of the whole table: weighted mean and variance of each item."""
        seen = ~np.isnan(x)
        total = np.maximum((seen * w[:, None]).sum(axis=0), EPS)
        mean = np.nansum(np.where(seen, x, 0) * w[:, None], axis=0) / total
        var = (np.where(seen, (x - mean) ** 2, 0) * w[:, None]).sum(axis=0) / total
        return {"mean": mean, "var": np.maximum(var, 1e-12)}

    def start(self, m: Params, rng: np.random.Generator) -> Params:
        raise NotImplementedError

    def loglik(self, x: np.ndarray, p: Params) -> np.ndarray:
        raise NotImplementedError

    def stats(self, x: np.ndarray, r: np.ndarray, p: Params) -> Params:
        """Sums over rows; r is n x K, posterior times weight."""
        seen = ~np.isnan(x)
        z = np.where(seen, x, 0.0)
        return {"n": r.T @ seen, "x": r.T @ z}

    def update(self, s: Params, m: Params, p: Params | None = None) -> Params:
        raise NotImplementedError

    def log_prior(self, p: Params, m: Params) -> float:
        return 0.0

    def n_params(self, m: Params | None = None) -> int:
        raise NotImplementedError

    def columns(self, p: Params) -> list[Column]:
        """The block's log-density in each class; null cells add nothing."""
        out = []
        for k in range(self.k):
            total = F.lit(0.0)
            for j, c in enumerate(self.items):
                total = total + F.coalesce(self.cell(F.col(f"`{c}`").cast("double"), p, k, j), F.lit(0.0))
            out.append(total)
        return out

    def cell(self, x: Column, p: Params, k: int, j: int) -> Column:
        raise NotImplementedError

    def free(self, p: Params) -> np.ndarray:
        """Unconstrained parameters."""
        raise NotImplementedError

    def fixed(self, theta: np.ndarray, p: Params) -> Params:
        """The inverse of free()."""
        raise NotImplementedError

    def permuted(self, p: Params, order: Sequence[int]) -> Params:
        return {n: v[list(order)] if v.ndim and len(v) == self.k and n != "alpha" else v for n, v in p.items()}

    def rows(self, p: Params) -> list[tuple]:
        """(item, parameter, category, class, estimate)."""
        return [(c, n, None, k + 1, float(v[k, j])) for n, v in p.items() if v.shape == (self.k, len(self.items)) for k in range(self.k) for j, c in enumerate(self.items)]


class Bernoulli(Emission):
    name = "binary"

    def start(self, m, rng):
        return {"p": rng.uniform(0.25, 0.75, (self.k, len(self.items)))}

    def loglik(self, x, p):
        q = np.clip(p["p"], EPS, 1 - EPS)
        seen = ~np.isnan(x)
        return np.where(seen, x, 0) @ (np.log(q) - np.log1p(-q)).T + seen @ np.log1p(-q).T

    def update(self, s, m, p=None):
        a = self.alpha / self.k
        return {"p": (s["x"] + a * m["mean"]) / np.maximum(s["n"] + a, EPS)}

    def log_prior(self, p, m):
        q = np.clip(p["p"], EPS, 1 - EPS)
        return float((self.alpha / self.k * (m["mean"] * np.log(q) + (1 - m["mean"]) * np.log1p(-q))).sum())

    def n_params(self, m=None):
        return self.k * len(self.items)

    def cell(self, x, p, k, j):
        q = min(max(float(p["p"][k, j]), EPS), 1 - EPS)
        return x * (math.log(q) - math.log1p(-q)) + math.log1p(-q)

    def free(self, p):
        q = np.clip(p["p"], EPS, 1 - EPS)
        return (np.log(q) - np.log1p(-q)).ravel()

    def fixed(self, theta, p):
        return {"p": 1 / (1 + np.exp(-np.clip(theta, -35, 35))).reshape(p["p"].shape)}


class Categorical(Emission):
    """Codes 1..C, ragged over items; ordinal items have the same likelihood, reported by thresholds."""

    name = "categorical"

    def __init__(self, items, k, alpha=1.0, cats: Sequence[int] = ()):
        super().__init__(items, k, alpha)
        self.cats = list(cats)
        self.top = max(self.cats, default=1)

    def marginal(self, x, w):
        if not self.cats:
            self.cats = [int(np.nanmax(x[:, j], initial=1)) for j in range(x.shape[1])]
            self.top = max(self.cats)
        out = np.zeros((len(self.items), self.top))
        for j in range(len(self.items)):
            seen = ~np.isnan(x[:, j])
            codes = x[seen, j].astype(int)
            if len(codes) and (codes.min() < 1 or codes.max() > self.cats[j]):
                raise ValueError(f"{self.items[j]}: codes must be 1 to {self.cats[j]}")
            out[j] = np.bincount(codes - 1, weights=w[seen], minlength=self.top)
        return {"share": out / np.maximum(out.sum(axis=1, keepdims=True), EPS)}

    def start(self, m, rng):
        p = rng.uniform(0.25, 0.75, (self.k, len(self.items), self.top))
        p *= np.arange(self.top)[None, None, :] < np.array(self.cats)[None, :, None]
        return {"p": p / p.sum(axis=2, keepdims=True)}

    def _codes(self, x):
        return np.where(np.isnan(x), 0, x).astype(int)

    def loglik(self, x, p):
        logs = np.log(np.clip(p["p"], EPS, 1.0))
        codes, out = self._codes(x), np.zeros((len(x), self.k))
        for j in range(len(self.items)):
            table = np.vstack([np.zeros(self.k), logs[:, j, :].T])  # code 0: missing
            out += table[codes[:, j]]
        return out

    def stats(self, x, r, p):
        codes, out = self._codes(x), np.zeros((self.k, len(self.items), self.top))
        for j in range(len(self.items)):
            for k in range(self.k):
                out[k, j] = np.bincount(codes[:, j], weights=r[:, k], minlength=self.top + 1)[1:]
        return {"c": out}

    def update(self, s, m, p=None):
        c = s["c"] + self.alpha / self.k * m["share"]
        return {"p": c / np.maximum(c.sum(axis=2, keepdims=True), EPS)}

    def log_prior(self, p, m):
        return float((self.alpha / self.k * m["share"] * np.log(np.clip(p["p"], EPS, 1.0))).sum())

    def n_params(self, m=None):
        return self.k * sum(c - 1 for c in self.cats)

    def cell(self, x, p, k, j):
        logs = [float(v) for v in np.log(np.clip(p["p"][k, j, : self.cats[j]], EPS, 1.0))]
        return F.when(x.isNotNull(), F.element_at(F.array(*map(F.lit, logs)), x.cast("int")))

    def free(self, p):
        parts = []
        for k in range(self.k):
            for j, c in enumerate(self.cats):
                q = np.clip(p["p"][k, j, :c], EPS, 1.0)
                parts.append(np.log(q[:-1]) - np.log(q[-1]))
        return np.concatenate(parts) if parts else np.zeros(0)

    def fixed(self, theta, p):
        out, at = np.zeros_like(p["p"]), 0
        for k in range(self.k):
            for j, c in enumerate(self.cats):
                e = np.exp(np.clip(np.append(theta[at : at + c - 1], 0.0), -35, 35))
                out[k, j, :c] = e / e.sum()
                at += c - 1
        return {"p": out}

    def rows(self, p):
        return [(c, "probability", v + 1, k + 1, float(p["p"][k, j, v])) for k in range(self.k) for j, c in enumerate(self.items) for v in range(self.cats[j])]

    def thresholds(self, p: Params) -> list[np.ndarray]:
        """Cumulative logits log P(x > c) / P(x <= c), K x (C - 1) for each item."""
        out = []
        for j, c in enumerate(self.cats):
            up = np.clip(p["p"][:, j, :c][:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:], EPS, 1 - EPS)
            out.append(np.log(up) - np.log1p(-up))
        return out


class Gaussian(Emission):
    """kind: unit (variance 1), class (own variance in each class) or equal (one over classes)."""

    name = "continuous"

    def __init__(self, items, k, alpha=1.0, kind: str = "class"):
        super().__init__(items, k, alpha)
        self.kind = kind

    def start(self, m, rng):
        sd = np.sqrt(m["var"])
        return {"mean": m["mean"] + rng.standard_normal((self.k, len(self.items))) * sd, "var": np.ones((self.k, len(self.items))) * (1.0 if self.kind == "unit" else m["var"])}

    def loglik(self, x, p):
        out = np.zeros((len(x), self.k))
        for k in range(self.k):
            v = p["var"][k]
            out[:, k] = np.nansum(-0.5 * ((x - p["mean"][k]) ** 2 / v + np.log(2 * math.pi * v)), axis=1)
        return out

    def stats(self, x, r, p):
        s = super().stats(x, r, p)
        return s | {"xx": r.T @ np.where(np.isnan(x), 0.0, x) ** 2}

    def update(self, s, m, p=None):
        n = np.maximum(s["n"], EPS)
        mean = s["x"] / n
        ss = np.maximum(s["xx"] - s["x"] * mean, 0.0)
        a = self.alpha / self.k
        if self.kind == "unit":
            var = np.ones_like(mean)
        elif self.kind == "equal":
            var = np.repeat(((ss.sum(axis=0) + self.alpha * m["var"]) / (s["n"].sum(axis=0) + self.alpha))[None, :], self.k, axis=0)
        else:
            var = (ss + a * m["var"]) / (s["n"] + a)
        return {"mean": mean, "var": np.maximum(var, 1e-12)}

    def log_prior(self, p, m):
        if self.kind == "unit":
            return 0.0
        return float((-0.5 * self.alpha / self.k * (np.log(p["var"]) + m["var"] / p["var"])).sum())

    def n_params(self, m=None):
        j = len(self.items)
        return self.k * j + {"unit": 0, "equal": j, "class": self.k * j}[self.kind]

    def cell(self, x, p, k, j):
        v, mu = float(p["var"][k, j]), float(p["mean"][k, j])
        return (x - mu) * (x - mu) * (-0.5 / v) - 0.5 * math.log(2 * math.pi * v)

    def free(self, p):
        if self.kind == "unit":
            return p["mean"].ravel()
        logs = np.log(p["var"])
        return np.concatenate([p["mean"].ravel(), (logs[0] if self.kind == "equal" else logs).ravel()])

    def fixed(self, theta, p):
        n = p["mean"].size
        mean = theta[:n].reshape(p["mean"].shape)
        if self.kind == "unit":
            return {"mean": mean, "var": p["var"]}
        var = np.exp(np.clip(theta[n:], -27, 100))
        return {"mean": mean, "var": np.repeat(var[None, :], self.k, axis=0) if self.kind == "equal" else var.reshape(mean.shape)}


class Poisson(Emission):
    name = "count"

    def start(self, m, rng):
        return {"rate": np.maximum(m["mean"] * rng.uniform(0.4, 1.8, (self.k, len(self.items))), 1e-3)}

    def loglik(self, x, p):
        seen, z = ~np.isnan(x), np.where(np.isnan(x), 0, x)
        rate = np.maximum(p["rate"], 1e-10)
        return z @ np.log(rate).T - seen @ rate.T - (seen * lgamma(z + 1)).sum(axis=1)[:, None]

    def update(self, s, m, p=None):
        a = self.alpha / self.k
        return {"rate": np.maximum((s["x"] + a) / (s["n"] + a / np.maximum(m["mean"], 1e-10)), 1e-10)}

    def log_prior(self, p, m):
        a = self.alpha / self.k
        return float((a * np.log(p["rate"]) - a / np.maximum(m["mean"], 1e-10) * p["rate"]).sum())

    def n_params(self, m=None):
        return self.k * len(self.items)

    def cell(self, x, p, k, j):
        rate = max(float(p["rate"][k, j]), 1e-10)
        return x * math.log(rate) - rate - log_factorial(x)

    def free(self, p):
        return np.log(p["rate"]).ravel()

    def fixed(self, theta, p):
        return {"rate": np.exp(np.clip(theta, -23, 30)).reshape(p["rate"].shape)}


class ZeroInflatedPoisson(Poisson):
    """With probability `zero` the count is 0, else Poisson."""

    name = "zip"

    def start(self, m, rng):
        return super().start(m, rng) | {"zero": rng.uniform(0.05, 0.4, (self.k, len(self.items)))}

    def loglik(self, x, p):
        seen, z = ~np.isnan(x), np.where(np.isnan(x), 0, x)
        rate, zero = np.maximum(p["rate"], 1e-10), np.clip(p["zero"], EPS, 1 - EPS)
        out = np.zeros((len(x), self.k))
        logs = lgamma(z + 1)
        for k in range(self.k):
            some = np.log1p(-zero[k]) + z * np.log(rate[k]) - rate[k] - logs
            none = np.log(zero[k] + (1 - zero[k]) * np.exp(-rate[k]))
            out[:, k] = np.where(seen, np.where(z == 0, none, some), 0).sum(axis=1)
        return out

    def stats(self, x, r, p):
        seen = ~np.isnan(x)
        at0 = seen & (x == 0)
        z = np.where(seen, x, 0)
        zero = p["zero"] / (p["zero"] + (1 - p["zero"]) * np.exp(-p["rate"]))  # of a zero, that it is inflated
        inflated = (r.T @ at0) * zero
        n = r.T @ seen
        return {"n": n - inflated, "x": r.T @ z, "inflated": inflated, "all": n}

    def update(self, s, m, p=None):
        a = self.alpha / self.k
        zero = (s["inflated"] + a / 2) / (s["all"] + a)
        return super().update(s, m) | {"zero": np.clip(zero, EPS, 1 - EPS)}

    def n_params(self, m=None):
        return 2 * self.k * len(self.items)

    def cell(self, x, p, k, j):
        zero, rate = min(max(float(p["zero"][k, j]), EPS), 1 - EPS), max(float(p["rate"][k, j]), 1e-10)
        return F.when(x == 0, math.log(zero + (1 - zero) * math.exp(-rate))).otherwise(math.log1p(-zero) + x * math.log(rate) - rate - log_factorial(x))

    def free(self, p):
        z = np.clip(p["zero"], EPS, 1 - EPS)
        return np.concatenate([np.log(p["rate"]).ravel(), (np.log(z) - np.log1p(-z)).ravel()])

    def fixed(self, theta, p):
        n = p["rate"].size
        return super().fixed(theta[:n], p) | {"zero": 1 / (1 + np.exp(-np.clip(theta[n:], -35, 35))).reshape(p["rate"].shape)}


class NegativeBinomial(Poisson):
    """Variance rate + alpha * rate^2; one alpha for each item, shared by classes.  Statistics are counts by value."""

    name = "negbin"

    def start(self, m, rng):
        over = np.clip((m["var"] - m["mean"]) / np.maximum(m["mean"], 1e-6) ** 2, 0.05, 10)
        return super().start(m, rng) | {"alpha": over}

    def loglik(self, x, p):
        seen, z = ~np.isnan(x), np.where(np.isnan(x), 0, x)
        size = 1 / np.maximum(p["alpha"], 1e-8)
        base = lgamma(z + size) - lgamma(size) - lgamma(z + 1)
        out = np.zeros((len(x), self.k))
        for k in range(self.k):
            rate = np.maximum(p["rate"][k], 1e-10)
            out[:, k] = (seen * (base + size * np.log(size / (size + rate)) + z * np.log(rate / (size + rate)))).sum(axis=1)
        return out

    def stats(self, x, r, p):
        s, top = super().stats(x, r, p), int(np.nanmax(x, initial=0)) + 1
        counts = np.zeros((self.k, len(self.items), top))
        for j in range(len(self.items)):
            seen = ~np.isnan(x[:, j])
            for k in range(self.k):
                counts[k, j] = np.bincount(x[seen, j].astype(int), weights=r[seen, k], minlength=top)
        return s | {"counts": counts}

    def update(self, s, m, p=None):
        new = super().update(s, m)
        y = np.arange(s["counts"].shape[2], dtype=float)
        alpha = np.empty(len(self.items))
        for j in range(len(self.items)):
            c, rate = s["counts"][:, j, :], new["rate"][:, j][:, None]

            def cost(log_alpha: float, c=c, rate=rate) -> float:
                size = math.exp(-log_alpha)
                base = lgamma(y + size) - math.lgamma(size)
                return -float((c * (base + size * np.log(size / (size + rate)) + y * np.log(rate / (size + rate)))).sum())

            alpha[j] = math.exp(golden(cost, math.log(1e-6), math.log(50.0), 1e-7))
        return new | {"alpha": alpha}

    def n_params(self, m=None):
        return self.k * len(self.items) + len(self.items)

    def cell(self, x, p, k, j):
        size, rate = 1 / max(float(p["alpha"][j]), 1e-8), max(float(p["rate"][k, j]), 1e-10)
        rising = F.aggregate(F.sequence(F.lit(0), F.greatest(x.cast("int") - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + F.log(i + size))
        return F.when(x == 0, 0.0).otherwise(rising) - log_factorial(x) + size * math.log(size / (size + rate)) + x * math.log(rate / (size + rate))

    def free(self, p):
        return np.concatenate([np.log(p["rate"]).ravel(), np.log(p["alpha"])])

    def fixed(self, theta, p):
        n = p["rate"].size
        return super().fixed(theta[:n], p) | {"alpha": np.exp(np.clip(theta[n:], -18, 6))}


def log_factorial(x: Column) -> Column:
    """log x! of a whole number: by table up to 20, then by Stirling's series (exact to double precision)."""
    n = x.cast("int")
    table = F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(21))), F.least(n, F.lit(20)) + 1)
    y = x + 1.0
    far = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return F.when(n <= 20, table).otherwise(far)


def build(family: str, items: Sequence[str], k: int, alpha: float = 1.0, **how) -> Emission:
    """The block of a family; continuous takes variances unit, class or equal, after a colon."""
    kind, _, more = family.partition(":")
    if kind == "binary":
        return Bernoulli(items, k, alpha)
    if kind in ("categorical", "ordinal"):
        return Categorical(items, k, alpha, how.get("cats", ()))
    if kind == "continuous":
        return Gaussian(items, k, alpha, more or how.get("kind", "class"))
    found = {"count": Poisson, "zip": ZeroInflatedPoisson, "negbin": NegativeBinomial}.get(kind)
    if found is None:
        raise ValueError(f"no such family: {family}")
    return found(items, k, alpha)
