"""Trajectory classes: growth curves fixed within classes (LCGA) and with random effects (GMM).

A panel of one outcome collapses to patterns over occasions.  LCGA's M-step is a weighted regression on T rows for each class,
GMM's the closed form of a structured normal with conditional moments of the random effects; binary growth with random effects
integrates over Gauss-Hermite nodes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, expit, gauss_hermite, golden, inverse, lgamma, logsumexp, pinv
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.plans import patterns as P
from latticore.sources import panel

FAMILIES = ("binomial", "gaussian", "poisson", "zip", "negbin")


def polynomial(scores: Sequence[float], degree: int) -> np.ndarray:
    return np.vander(np.asarray(scores, float), degree + 1, increasing=True)


@dataclass
class Growth:
    """A fitted growth mixture.  psi and theta are of GMM, dispersion of the other families."""

    family: str
    columns: list[str]
    design: np.ndarray
    pi: np.ndarray
    beta: np.ndarray  # K x (degree + 1)
    extra: dict
    loglik: float
    n_params: int
    n: float
    entropy: float
    converged: bool
    logliks: list[float] = field(default_factory=list)
    predictors: list[str] = field(default_factory=list)  # of the growth factors; extra["slopes"] is K x (degree + 1) x predictors
    by_class: bool = False  # slopes are a class's own

    @property
    def inputs(self) -> list[str]:
        """The columns a density is of: occasions, then predictors."""
        return [*self.columns, *self.predictors]

    def metrics(self) -> dict[str, float]:
        return M.information_criteria(self.loglik, self.n_params, self.n, self.entropy, len(self.pi))

    def curves(self, spark) -> DataFrame:
        """class, occasion, expected: the mean trajectory on the outcome's scale, where predictors are 0."""
        eta = self.beta @ self.design.T
        mean = {"binomial": expit(eta), "gaussian": eta}.get(self.family.partition("+")[0], np.exp(np.clip(eta, -30, 30)))
        if self.family == "zip":
            mean = mean * (1 - self.extra["zero"])
        return spark.createDataFrame([(c + 1, t + 1, float(mean[c, t])) for c in range(len(self.pi)) for t in range(mean.shape[1])], "class int, occasion int, expected double")

    def transform(self, df: DataFrame) -> DataFrame:
        """df with posterior, class and loglik; rows without a predictor have no expected curve and go."""
        g = self

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                y = f[g.inputs].to_numpy(float, na_value=np.nan)
                joint = np.log(g.pi + EPS) + _density(g.family, y, g.design, g.beta, g.extra)
                ll = logsumexp(joint)
                post = np.exp(joint - ll[:, None])
                yield f.assign(**{"posterior": [list(map(float, p)) for p in post], "class": post.argmax(axis=1).astype("int32") + 1, "loglik": ll})

        if g.predictors:
            df = df.dropna(subset=[f"`{c}`" for c in g.predictors])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, fields + ", posterior array<double>, class int, loglik double")


def _density(family: str, y: np.ndarray, x: np.ndarray, beta: np.ndarray, extra: dict) -> np.ndarray:
    """n x K log-densities; predictors of growth factors stand in y after the occasions."""
    if family == "gaussian+random" and "slopes" in extra:
        own, z = {n: v for n, v in extra.items() if n != "slopes"}, y[:, len(x) :]
        one = lambda k: {n: v[k : k + 1] for n, v in own.items()}
        return np.concatenate([_density(family, y[:, : len(x)] - z @ extra["slopes"][k].T @ x.T, x, beta[k : k + 1], one(k)) for k in range(len(beta))], axis=1)
    if family == "gaussian+random":
        return np.stack([_normal(y, x @ b, x[:, : len(p)] @ p @ x[:, : len(p)].T + np.diag(extra["theta"][k])) for k, (b, p) in enumerate(zip(beta, extra["psi"]))], axis=1)
    if family == "binomial+random":
        return _binary_random(y, x, beta, extra)[0]
    seen, z = ~np.isnan(y), np.where(np.isnan(y), 0, y)
    out = np.zeros((len(y), len(beta)))
    for k, b in enumerate(beta):
        eta = x @ b if family == "gaussian" else np.clip(x @ b, -30, 30)
        if family == "binomial":
            cell = z * eta - np.logaddexp(0, eta)
        elif family == "gaussian":
            v = extra["var"][k]
            cell = -0.5 * (np.log(2 * math.pi * v) + (z - eta) ** 2 / v)
        else:
            cell = z * eta - np.exp(eta) - lgamma(z + 1)
            if family == "zip":
                q = extra["zero"][k]
                cell = np.where(z == 0, np.log(q + (1 - q) * np.exp(-np.exp(eta))), math.log1p(-q) + cell)
            elif family == "negbin":
                size = 1 / extra["alpha"]
                cell = lgamma(z + size) - math.lgamma(size) - lgamma(z + 1) + size * np.log(size / (size + np.exp(eta))) + z * (eta - np.log(size + np.exp(eta)))
        out[:, k] = (cell * seen).sum(axis=1)
    return out


def _normal(y: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y))
    mask = np.isnan(y)
    for m, own in _by_missing(mask):
        s = ~m
        if not s.any():
            continue
        c = np.linalg.cholesky(cov[np.ix_(s, s)])
        d = np.linalg.solve(c, (y[own][:, s] - mean[s]).T)
        out[own] = -0.5 * (d**2).sum(axis=0) - np.log(np.diag(c)).sum() - 0.5 * s.sum() * math.log(2 * math.pi)
    return out


def _binary_random(y, x, beta, extra):
    """Log-densities and node posteriors of a random-intercept logistic curve."""
    nodes, weights = gauss_hermite(extra.get("nodes", 15))
    seen, z = ~np.isnan(y), np.where(np.isnan(y), 0, y)
    parts = []
    for k, b in enumerate(beta):
        eta = np.clip((x @ b)[None, :] + extra["sd"][k] * nodes[:, None], -30, 30)  # nodes x T
        parts.append(z @ eta.T - seen @ np.logaddexp(0, eta).T + np.log(weights))
    joint = np.stack(parts, axis=1)  # n x K x Q
    ll = logsumexp(joint, axis=2)
    return ll, np.exp(joint - ll[:, :, None]), nodes


def _wls(x, y, w):
    return inverse(x.T @ (x * w[:, None])) @ (x.T @ (w * y))


def _irls(family: str, x: np.ndarray, n: np.ndarray, s: np.ndarray, b: np.ndarray, alpha: float = 0.0, rounds: int = 50) -> np.ndarray:
    """Weighted GLM on T rows with n exposures and s summed outcomes (binomial, or log link with variance mu + alpha mu^2)."""
    def objective(b):
        eta = np.clip(x @ b, -30, 30)
        if family == "binomial":
            return float(s @ eta - n @ np.logaddexp(0, eta))
        mu = np.exp(eta)
        return float(s @ eta - n @ mu) if not alpha else float(s @ (eta - np.log1p(alpha * mu)) - n @ np.log1p(alpha * mu) / alpha)

    value = objective(b)
    for _ in range(rounds):
        eta = np.clip(x @ b, -30, 30)
        if family == "binomial":
            mu = expit(eta)
            g, h = s - n * mu, n * mu * (1 - mu)
        else:
            mu = np.exp(eta)
            g, h = (s - n * mu) / (1 + alpha * mu), mu * n / (1 + alpha * mu)
        step = pinv(x.T @ (x * np.maximum(h, 1e-12)[:, None]) + 1e-10 * np.eye(x.shape[1])) @ (x.T @ g)
        size = 1.0
        while size > 1e-6 and not objective(b + size * step) >= value - 1e-12:
            size /= 2
        b = b + size * step
        new = objective(b)
        if abs(new - value) < 1e-12 * (1 + abs(value)):
            break
        value = new
    return b


def _lcga_sums(family: str, y: np.ndarray, w: np.ndarray, x: np.ndarray, state: tuple) -> dict:
    """One pass over rows: what the update needs, by class and occasion."""
    pi, beta, extra = state
    k, seen, z = len(pi), ~np.isnan(y), np.where(np.isnan(y), 0, y)
    joint = np.log(pi + EPS) + _density(family, y, x, beta, extra)
    ll = logsumexp(joint)
    post = np.exp(joint - ll[:, None])
    r = post * w[:, None]
    out = {"ll": float(w @ ll), "entropy": -float((r * np.log(post + EPS)).sum()), "size": r.sum(axis=0), "n": r.T @ seen, "s": r.T @ z, "q": r.T @ z**2, "zero": r.T @ (seen & (y == 0))}
    if family == "negbin":
        top = int(z.max(initial=0)) + 1
        out["hist"] = np.stack([[np.bincount(z[seen[:, t], t].astype(int), weights=r[seen[:, t], c], minlength=top) for t in range(len(x))] for c in range(k)])
    return out


def _lcga_run(family, m, x, k, start, dispersion, max_iter, tol):
    """EM of curves as a run (see passes); m holds the outcome's overall mean and variance."""
    pi, beta, extra = start
    t_max, last, done = len(x), -math.inf, False
    mean = max(m["mean"], 1e-6)
    for it in range(max_iter + 1):
        a = yield pi, beta, extra
        value = a["ll"]
        done = it > 0 and value - last < tol * (1 + abs(value))
        if done or it == max_iter:
            break
        last = value
        pi = (a["size"] + 1.0 / k) / (a["size"].sum() + 1.0)
        n, s, beta = a["n"], a["s"], beta.copy()
        if family == "gaussian":
            for c in range(k):
                beta[c] = _wls(x, np.divide(s[c], n[c], out=np.zeros(t_max), where=n[c] > 0), n[c] / extra["var"][c])
            mu = beta @ x.T
            ss = np.maximum(a["q"] - 2 * mu * s + mu**2 * n, 0)
            if dispersion == "class":
                v = (ss.sum(axis=1) + m["var"] / k) / (n.sum(axis=1) + 1 / k)
                extra = {"var": np.repeat(v[:, None], t_max, axis=1)}
            else:
                v = (ss.sum(axis=0) + m["var"] / t_max) / (n.sum(axis=0) + 1 / t_max)
                extra = {"var": np.repeat(v[None, :], k, axis=0)}
        elif family == "binomial":
            for c in range(k):
                beta[c] = _irls("binomial", x, n[c] + 1 / (k * t_max), s[c] + m["mean"] / (k * t_max), beta[c])
        elif family == "zip":
            eta, zero = np.exp(np.clip(x @ beta.T, -30, 30)).T, extra["zero"].copy()
            for c in range(k):
                inflated = a["zero"][c] * (zero[c] / (zero[c] + (1 - zero[c]) * np.exp(-eta[c])))
                zero[c] = np.clip((inflated.sum() + 0.5 / k) / (n[c].sum() + 1 / k), 1e-12, 1 - 1e-12)
                beta[c] = _irls("poisson", x, n[c] - inflated + 1 / (k * t_max * mean), s[c] + 1 / (k * t_max), beta[c])
            extra = {"zero": zero}
        else:
            for c in range(k):
                beta[c] = _irls("poisson", x, n[c] + 1 / (k * t_max * mean), s[c] + 1 / (k * t_max), beta[c], extra.get("alpha", 0.0))
            if family == "negbin":
                hist, mu = a["hist"], np.exp(np.clip(beta @ x.T, -30, 30))[:, :, None]
                v = np.arange(hist.shape[2], dtype=float)

                def cost(log_alpha, hist=hist, mu=mu, v=v):
                    size = math.exp(-log_alpha)
                    return -float((hist * (lgamma(v + size) - math.lgamma(size) + size * np.log(size / (size + mu)) + v * np.log(mu / (size + mu)))).sum())

                extra = {"alpha": math.exp(golden(cost, math.log(1e-6), math.log(50.0), 1e-7))}
    return {"pi": pi, "beta": beta, "extra": extra, "ll": value, "entropy": a["entropy"], "converged": bool(done)}


def _by_missing(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each pattern of missing cells, in order, and its rows; patterns are read as binary numbers where they fit, which sort faster than rows do."""
    if not len(mask):
        return []
    if mask.shape[1] <= 62:
        code = mask @ (1 << np.arange(mask.shape[1], dtype=np.int64)[::-1])
    else:
        code = np.unique(mask, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(code, kind="stable")
    return [(mask[rows[0]], rows) for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1)]


def _gmm_sums(y: np.ndarray, w: np.ndarray, x: np.ndarray, q: int, state: tuple) -> dict:
    """One pass over rows of the structured normal: moments of the random effects and of what they leave of the outcome."""
    pi, beta, extra = state
    psi, theta, k, d, t_max = extra["psi"], extra["theta"], len(pi), x.shape[1], len(x)
    joint = np.log(pi + EPS) + _density("gaussian+random", y, x, beta, extra)
    y, given = y[:, :t_max], np.column_stack([np.ones(len(y)), y[:, t_max:]])
    z, mask, factors = x[:, :q], np.isnan(y), _factors(beta, extra)
    p = given.shape[1]
    ll = logsumexp(joint)
    post = np.exp(joint - ll[:, None])
    r = post * w[:, None]
    out = {"ll": float(w @ ll), "entropy": -float((r * np.log(post + EPS)).sum()), "size": r.sum(axis=0), "second": np.zeros((k, q, q)), "n": np.zeros((k, t_max, p, p)), "s1": np.zeros((k, t_max, p)), "s2": np.zeros((k, t_max)), "spread": np.zeros((k, t_max))}
    for m, rows in _by_missing(mask):
        s = ~m
        if not s.any():
            continue
        for c in range(k):
            zs = z[s]
            v = zs @ psi[c] @ zs.T + np.diag(theta[c][s])
            gain = psi[c] @ zs.T @ np.linalg.inv(v)
            left = psi[c] - gain @ zs @ psi[c]
            own = y[rows][:, s]
            u, rr = (own - given[rows] @ factors[c].T @ x[s].T) @ gain.T, r[rows, c]
            out["second"][c] += (u * rr[:, None]).T @ u + rr.sum() * left
            adj = own - u @ zs.T
            weighted = given[rows] * rr[:, None]
            out["n"][c, s] += weighted.T @ given[rows]
            out["s1"][c, s] += adj.T @ weighted
            out["s2"][c, s] += rr @ adj**2
            out["spread"][c, s] += rr.sum() * np.einsum("ti,ij,tj->t", zs, left, zs)
    return out


def _factors(beta: np.ndarray, extra: dict) -> np.ndarray:
    """K x (degree + 1) x (1 + predictors): what a growth factor is expected to be, by a constant and the predictors."""
    return np.concatenate([beta[:, :, None], extra["slopes"]], axis=2) if "slopes" in extra else beta[:, :, None]


def _gls(x: np.ndarray, n: np.ndarray, s: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The coefficients (columns of x by given variables) of sums over rows: n (T x p x p), s (T x p), residual variances theta."""
    h = sum(np.kron(np.outer(v, v), a) / t for v, a, t in zip(x, n, theta))
    return (inverse(h) @ sum(np.kron(v, a) / t for v, a, t in zip(x, s, theta))).reshape(x.shape[1], -1)


def _gmm_run(x, k, start, psi_equal, max_iter, tol, by_class=False, residual="occasion", residual_equal=True):
    """EM of the structured normal, as a run: psi equal or free over classes, theta by occasion or constant, equal or free over classes.

    Slopes equal over classes are updated after the curves at them, so a round still climbs.
    """
    pi, beta, extra = start
    psi, theta = extra["psi"], extra["theta"]
    slopes = {"slopes": extra["slopes"]} if "slopes" in extra else {}
    q, last, done = psi.shape[1], -math.inf, False
    for it in range(max_iter + 1):
        a = yield pi, beta, {"psi": psi, "theta": theta} | slopes
        value = a["ll"]
        done = it > 0 and value - last < tol * (1 + abs(value))
        if done or it == max_iter:
            break
        last, size, n, s1 = value, a["size"], a["n"], a["s1"]
        pi = (size + 1.0 / k) / (size.sum() + 1.0)
        if not slopes or by_class:
            both = np.stack([_gls(x, n[c], s1[c], theta[c]) for c in range(k)])
            beta = both[:, :, 0]
            slopes = {"slopes": both[:, :, 1:]} if slopes else {}
        else:
            shift = np.einsum("td,dj->tj", x, slopes["slopes"][0])
            beta = np.stack([_gls(x, n[c, :, :1, :1], s1[c, :, :1] - (shift * n[c, :, 1:, 0]).sum(axis=1, keepdims=True), theta[c])[:, 0] for c in range(k)])
            left = s1[:, :, 1:] - (beta @ x.T)[:, :, None] * n[:, :, 0, 1:]
            one = _gls(np.tile(x, (k, 1)), n[:, :, 1:, 1:].reshape(-1, n.shape[2] - 1, n.shape[2] - 1), left.reshape(-1, n.shape[2] - 1), theta.ravel())
            slopes = {"slopes": np.repeat(one[None], k, axis=0)}
        mu = np.einsum("td,kdj->ktj", x, _factors(beta, slopes))
        e2 = a["s2"] - 2 * (mu * s1).sum(axis=2) + np.einsum("kti,ktij,ktj->kt", mu, n, mu) + a["spread"]
        count = n[:, :, 0, 0]
        over = ((0,) if residual_equal else ()) + ((1,) if residual == "constant" else ())
        e2, count = (v.sum(axis=over, keepdims=True) if over else v for v in (e2, count))
        psi = np.repeat((a["second"].sum(axis=0) / size.sum())[None], k, axis=0) if psi_equal else (a["second"] + 1e-6 * np.eye(q)) / np.maximum(size, EPS)[:, None, None]
        theta = np.broadcast_to(np.maximum(e2 / np.maximum(count, EPS), 1e-8), (k, len(x))).copy()
    return {"pi": pi, "beta": beta, "extra": {"psi": psi, "theta": theta} | slopes, "ll": value, "entropy": a["entropy"], "converged": bool(done)}


def _binary_gmm_sums(y: np.ndarray, w: np.ndarray, x: np.ndarray, state: tuple) -> dict:
    """One pass over rows of binary growth: expected trials and successes by class, node and occasion."""
    pi, beta, extra = state
    seen, z = ~np.isnan(y), np.where(np.isnan(y), 0, y)
    dens, nodes, _ = _binary_random(y, x, beta, extra)
    joint = np.log(pi + EPS) + dens
    ll = logsumexp(joint)
    post = np.exp(joint - ll[:, None])
    r = post * w[:, None]
    mass = [(r[:, c][:, None] * nodes[:, c]).T for c in range(len(pi))]
    return {"ll": float(w @ ll), "entropy": -float((r * np.log(post + EPS)).sum()), "size": r.sum(axis=0), "n": np.stack([v @ seen for v in mass]), "s": np.stack([v @ z for v in mass])}


def _binary_gmm_run(x, k, nodes, start, max_iter, tol):
    pi, beta, extra = start
    sd, (q, _), last, done = extra["sd"].copy(), gauss_hermite(nodes), -math.inf, False
    rows = np.column_stack([np.tile(x, (len(q), 1)), np.repeat(q, len(x))])  # the node is a covariate with slope sd
    for it in range(max_iter + 1):
        a = yield pi, beta, {"sd": sd, "nodes": nodes}
        value = a["ll"]
        done = it > 0 and value - last < tol * (1 + abs(value))
        if done or it == max_iter:
            break
        last, beta, sd = value, beta.copy(), sd.copy()
        pi = (a["size"] + 1.0 / k) / (a["size"].sum() + 1.0)
        for c in range(k):
            b = _irls("binomial", rows, a["n"][c].ravel() + 1e-6, a["s"][c].ravel() + 5e-7, np.append(beta[c], sd[c]), rounds=3)
            beta[c], sd[c] = b[:-1], abs(b[-1])
    return {"pi": pi, "beta": beta, "extra": {"sd": sd, "nodes": nodes}, "ll": value, "entropy": a["entropy"], "converged": bool(done)}


def _added(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    if "hist" in a and a["hist"].shape != b["hist"].shape:
        top = max(a["hist"].shape[2], b["hist"].shape[2])
        a, b = (v | {"hist": np.pad(v["hist"], [(0, 0), (0, 0), (0, top - v["hist"].shape[2])])} for v in (a, b))
    return {n: a[n] + b[n] for n in a}


#: Patterns that starting values are drawn from.
START_PATTERNS = 10_000


def _fit(df: DataFrame, columns, sums, kernel, make_start, n_init, seed, weight, max_patterns):
    """A task for each start on a small pattern table; else passes over the weighted patterns that all starts share.

    sums(y, w, state) are additive statistics of rows; kernel(moments, state) is the EM loop, as a run.  Starts are drawn from at most START_PATTERNS
    patterns, the first by hash, wherever the fit is made.
    """
    df = panel.drop_empty(df, columns)
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    # aggregated once: counted, sampled, and passed over where they are too many for a task
    patterns = P.collapse(rows, columns, "_w" if weight else None, names=("_weight", "_rows")).drop("_rows").persist()
    found = patterns.count()
    if not found:
        raise ValueError("no row with an observed occasion")
    small = found <= max_patterns
    table = patterns.toPandas() if small else None
    sample = table if small and len(table) <= START_PATTERNS else patterns.orderBy(F.xxhash64(*(f"`{c}`" for c in columns)), *(f"`{c}`" for c in columns)).limit(START_PATTERNS).toPandas()
    ordered = lambda t: M.pattern_arrays(t.sort_values(columns, na_position="first", ignore_index=True), columns)
    y, w = ordered(sample)
    starts = [make_start(y, w, np.random.default_rng([seed, i])) for i in range(n_init)]
    m = {"mean": float(np.nanmean(y)), "var": float(np.nanvar(y))}
    if not small:
        total = patterns.agg(F.sum("_weight")).first()[0]
        runs = passes.together([kernel(m, s) for s in starts], patterns, columns, "_weight", sums, _added)
    else:
        y, w = ordered(table)
        total = w.sum()
        if n_init == 1 or len(w) * n_init < 2000:
            runs = [passes.alone(kernel(m, s), lambda state: sums(y, w, state)) for s in starts]
        else:
            spark = df.sparkSession
            shared = spark.sparkContext.broadcast((y, w, starts))

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                y, w, starts = shared.value
                for f in frames:
                    yield pd.DataFrame({"start": f["start"], "run": [pickle.dumps(passes.alone(kernel(m, starts[i]), lambda state: sums(y, w, state))) for i in f["start"]]})

            ids = spark.createDataFrame([(i,) for i in range(n_init)], "start int").repartition(n_init, "start")
            runs = [pickle.loads(r.run) for r in ids.mapInPandas(run, "start int, run binary").orderBy("start").collect()]
    patterns.unpersist()
    best = max(runs, key=lambda r: r["ll"])
    order = np.argsort(-best["pi"], kind="stable")
    k = len(order)
    extra = {n: (v[order] if isinstance(v, np.ndarray) and v.ndim and len(v) == k else v) for n, v in best["extra"].items()}
    return best | {"pi": best["pi"][order], "beta": best["beta"][order], "extra": extra}, float(total), [r["ll"] for r in runs]


def _check(columns, degree, scores):
    if degree + 1 >= len(columns):
        raise ValueError("a curve needs more occasions than coefficients")
    if scores is not None and len(scores) != len(columns):
        raise ValueError("a time score for each occasion")
    return polynomial(scores if scores is not None else range(len(columns)), degree)


def fit_lcga(df: DataFrame, columns: Sequence[str], n_classes: int = 2, *, degree: int = 1, family: str = "gaussian", dispersion: str = "occasion", time_scores: Sequence[float] | None = None, weight: str | None = None, n_init: int = 20, seed: int = 1, max_iter: int = 1000, tol: float = 1e-8, max_patterns: int = 200_000) -> Growth:
    """Classes of one curve each, in one of five families."""
    if family not in FAMILIES:
        raise ValueError(f"no such family: {family}")
    columns, x, k = list(columns), _check(columns, degree, time_scores), n_classes

    def make(y, w, rng):
        pick = rng.choice(len(y), k, p=w / w.sum(), replace=len(y) < k)
        mean = np.nanmean(y, axis=0)
        beta = []
        for i in pick:
            v = np.where(np.isnan(y[i]), mean, y[i])
            if family == "binomial":
                v = np.log((v + 0.5) / (1.5 - v))
            elif family != "gaussian":
                v = np.log(v + 0.5)
            beta.append(_wls(x, v, np.ones(len(x))) + 0.1 * rng.standard_normal(degree + 1) * (np.arange(degree + 1) == 0))
        extra = {"gaussian": {"var": np.full((k, len(x)), np.nanvar(y))}, "zip": {"zero": rng.uniform(0.1, 0.4, k)}, "negbin": {"alpha": 0.5}}.get(family, {})
        return rng.dirichlet(np.full(k, 5.0)), np.array(beta), extra

    best, n, lls = _fit(df, columns, lambda y, w, state: _lcga_sums(family, y, w, x, state), lambda m, s: _lcga_run(family, m, x, k, s, dispersion, max_iter, tol), make, n_init if k > 1 else 1, seed, weight, max_patterns)
    p = k - 1 + k * (degree + 1) + {"gaussian": k if dispersion == "class" else len(x), "zip": k, "negbin": 1}.get(family, 0)
    return Growth(family, columns, x, best["pi"], best["beta"], best["extra"], best["ll"], p, n, best["entropy"], best["converged"], lls)


def fit_gmm(df: DataFrame, columns: Sequence[str], n_classes: int = 2, *, degree: int = 1, random_effects: str = "intercept_slope", psi: str = "equal", residual: str = "occasion", residual_equal: bool = True, predictors: Sequence[str] = (), by_class: bool = False, family: str = "gaussian", n_quadrature: int = 15, time_scores: Sequence[float] | None = None, weight: str | None = None, n_init: int = 20, seed: int = 1, max_iter: int = 2000, tol: float = 1e-8, max_patterns: int = 200_000) -> Growth:
    """Classes of curves with random effects around them; binomial outcomes have a random intercept integrated by quadrature.

    Residual variances are by occasion or constant, equal over classes or free.  `predictors` shift a case's growth factors within its class, by slopes
    equal over classes or a class's own (`by_class`); rows without one of them take no part.
    """
    if residual not in ("occasion", "constant"):
        raise ValueError("residual is occasion or constant")
    if (predictors or residual != "occasion" or not residual_equal) and (family != "gaussian" or random_effects == "none"):
        raise ValueError("predictors and residuals are of gaussian curves with random effects")
    if family == "gaussian" and random_effects == "none":
        return fit_lcga(df, columns, n_classes, degree=degree, time_scores=time_scores, weight=weight, n_init=n_init, seed=seed)
    columns, x, k = list(columns), _check(columns, degree, time_scores), n_classes
    q = {"intercept": 1, "intercept_slope": 2, "all": degree + 1}[random_effects]
    if q > degree + 1:
        raise ValueError("more random effects than coefficients")
    if family == "binomial":
        def make(y, w, rng):
            base = np.log((np.nanmean(y, axis=0) + 0.05) / (1.05 - np.nanmean(y, axis=0)))
            b = _wls(x, base, np.ones(len(x)))
            return rng.dirichlet(np.full(k, 5.0)), b + rng.standard_normal((k, degree + 1)) * np.array([1.0] + [0.3] * degree), {"sd": np.full(k, 0.8), "nodes": n_quadrature}

        best, n, lls = _fit(df, columns, lambda y, w, state: _binary_gmm_sums(y, w, x, state), lambda m, s: _binary_gmm_run(x, k, n_quadrature, s, max_iter, tol), make, n_init if k > 1 else 1, seed, weight, max_patterns)
        return Growth("binomial+random", columns, x, best["pi"], best["beta"], best["extra"], best["ll"], k - 1 + k * (degree + 1) + k, n, best["entropy"], best["converged"], lls)

    if psi not in ("equal", "free"):
        raise ValueError("psi is equal or free")

    def make(y, w, rng):
        y = y[:, : len(x)]
        mean, var = np.nanmean(y, axis=0), np.nanvar(y, axis=0)
        pick = rng.choice(len(y), k, p=w / w.sum(), replace=len(y) < k)
        beta = np.array([_wls(x, np.where(np.isnan(y[i]), mean, y[i]), np.ones(len(x))) for i in pick])
        scale = np.diag([var.mean() / 3] + [var.mean() / 30] * (q - 1))
        return rng.dirichlet(np.full(k, 5.0)), beta, {"psi": np.repeat(scale[None], k, axis=0), "theta": np.repeat((var / 2)[None, :], k, axis=0)} | ({"slopes": np.zeros((k, degree + 1, len(predictors)))} if predictors else {})

    predictors = list(predictors)
    if predictors:
        df = panel.drop_empty(df, columns).dropna(subset=[f"`{c}`" for c in predictors])
    best, n, lls = _fit(df, [*columns, *predictors], lambda y, w, state: _gmm_sums(y, w, x, q, state), lambda m, s: _gmm_run(x, k, s, psi == "equal", max_iter, tol, by_class, residual, residual_equal), make, n_init if k > 1 else 1, seed, weight, max_patterns)
    p = k - 1 + k * (degree + 1) + q * (q + 1) // 2 * (1 if psi == "equal" else k) + (len(x) if residual == "occasion" else 1) * (1 if residual_equal else k) + len(predictors) * (degree + 1) * (k if by_class else 1)
    return Growth("gaussian+random", columns, x, best["pi"], best["beta"], best["extra"], best["ll"], p, n, best["entropy"], best["converged"], lls, predictors, by_class)


def growth_observed(scored: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """class, occasion, mean: posterior-weighted observed means, one aggregation."""
    cells, rows = [], []
    for c in range(k):
        for t, name in enumerate(columns):
            y, p = F.col(f"`{name}`").cast("double"), F.col("posterior")[c]
            cells += [F.sum(p * y).alias(f"s{c}_{t}"), F.sum(F.when(y.isNotNull(), p)).alias(f"n{c}_{t}")]
            rows.append(F.struct(F.lit(c + 1).alias("class"), F.lit(t + 1).alias("occasion"), (F.col(f"s{c}_{t}") / F.col(f"n{c}_{t}")).alias("mean")))
    return scored.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
