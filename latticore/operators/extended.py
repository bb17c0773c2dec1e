"""Extended models: groups, direct covariate effects, covariates and random intercepts on chains, mixtures of chains.

Chains with covariates pass over patterns where they are.  The others work on the pattern table (with group or covariate columns among its keys), which is
bounded and small; rows are only aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, expit, gauss_hermite, hessian, inverse, logsumexp, softmax, two_sided
from latticore.operators import growth as G
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.operators.curvature import family_scores
from latticore.plans import patterns as P
from latticore.sources import panel


def pattern_table(df: DataFrame, items: Sequence[str], extra: Sequence[str] = (), weight: str | None = None, most: int = 200_000) -> pd.DataFrame:
    """Distinct rows of items (coded already) and extra columns with _weight, on the driver; refused beyond `most` rows."""
    rows = panel.drop_empty(df, items).dropna(subset=[f"`{c}`" for c in extra]) if extra else panel.drop_empty(df, items)
    table = P.collapse(rows, items, weight, extra, names=("_weight", "_rows")).limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError(f"more than {most} patterns")
    if not len(table):
        raise ValueError("no row with an observed item")
    return table.sort_values([*items, *extra], na_position="first", ignore_index=True)


# ---------------------------------------------------------------- groups


def fit_groups(df: DataFrame, items: Sequence[str], group: str, n_classes: int, measurement="binary", *, measurement_equal: bool | Sequence[str] = False, prevalence_equal: bool = False, weight: str | None = None, n_init: int = 10, seed: int = 1, max_iter: int = 1000, tol: float = 1e-8, starts: list[tuple] | None = None) -> dict:
    """A mixture in several groups: measurement free, equal, or equal for named items; class shares free or equal.

    `starts`, (class shares by group, parameters of each block) with blocks as in `groups` of the result, are used in place of `n_init` random ones.
    Binary items of any two values are coded alike in all groups.
    """
    blocks = panel.normalize_measurement(items, measurement)
    df, coding = T.coded_items(df, blocks, list(items), None)
    equal = set(items) if measurement_equal is True else set(measurement_equal or ())
    parts = [(f + ":class" if f == "continuous" else f, own, same) for f, cols in blocks for same, own in ((True, [c for c in cols if c in equal]), (False, [c for c in cols if c not in equal])) if own]
    spec = M.Spec([(f, own) for f, own, _ in parts], n_classes)
    table = pattern_table(df, spec.items, [group], weight)
    x, w = M.pattern_arrays(table, spec.items)
    names = sorted(table[group].unique())
    rows = [np.flatnonzero(table[group].to_numpy() == g) for g in names]
    whole = [e.marginal(b, w) for e, b in zip(M._resolved(spec, x), spec.split(x))]
    m = [[mm if same else e.marginal(b, w[r]) for e, b, mm, (_, _, same) in zip(spec.emissions(), spec.split(x[r]), whole, parts)] for r in rows]
    best = None
    for i in range(len(starts) if starts else n_init if n_classes > 1 else 1):
        if starts:
            pi, one = np.asarray(starts[i][0], float), starts[i][1]
        else:
            rng = np.random.default_rng([seed, i])
            one = [e.start(mm, rng) for e, mm in zip(spec.emissions(), whole)]
            pi = np.repeat(rng.dirichlet(np.full(n_classes, 5.0))[None], len(names), axis=0)
        params, last, done = [one] * len(names), -math.inf, False
        for it in range(max_iter + 1):
            s = [M._statistics(spec, pi[g], params[g], x[r], w[r]) for g, r in enumerate(rows)]
            value = sum(t["ll"] for t in s) + sum(M._log_prior(spec, pi[g], params[g], m[g]) for g in range(len(names)))
            done = it > 0 and value - last < tol * (1 + abs(value))
            if done or it == max_iter:
                break
            last = value
            n = np.array([t["n"] for t in s]) + 1 / n_classes
            pi = np.repeat((n.sum(axis=0) / n.sum())[None], len(names), axis=0) if prevalence_equal else n / n.sum(axis=1, keepdims=True)
            new = [[] for _ in names]
            for b, (e, (_, _, same)) in enumerate(zip(spec.emissions(), parts)):
                if same:
                    total = s[0]["blocks"][b]
                    for t in s[1:]:
                        total = {k: total[k] + t["blocks"][b][k] for k in total}
                    shared = e.update(total, whole[b], params[0][b])
                    for g in range(len(names)):
                        new[g].append(shared)
                else:
                    for g in range(len(names)):
                        new[g].append(e.update(s[g]["blocks"][b], m[g][b], params[g][b]))
            params = new
        ll = sum(t["ll"] for t in s)
        if best is None or value > best["penalised"]:
            best = {"pi": pi, "params": params, "loglik": ll, "penalised": value, "converged": done, "entropy": sum(t["entropy"] for t in s)}
    p = (n_classes - 1) * (1 if prevalence_equal else len(names)) + sum(e.n_params(mm) * (1 if same else len(names)) for e, mm, (_, _, same) in zip(spec.emissions(), whole, parts))
    n = float(w.sum())
    fits = {g: M.Fit(spec, best["pi"][i], best["params"][i], math.nan, math.nan, 0, float(w[rows[i]].sum()), math.nan, 0, best["converged"], coding=coding) for i, g in enumerate(names)}
    return {"groups": fits, "loglik": best["loglik"], "n_params": p, "n": n} | M.information_criteria(best["loglik"], p, n, best["entropy"], n_classes)


# ---------------------------------------------------------------- direct effects


def fit_dif(df: DataFrame, items: Sequence[str], covariate: str, n_classes: int, *, dif_items: Sequence[str], by_class: bool = False, predict_class: bool = True, weight: str | None = None, n_init: int = 5, seed: int = 1, max_iter: int = 500, tol: float = 1e-8) -> dict:
    """Binary items of which some depend on a covariate within classes: logit p = theta_kj + beta_j z (or beta_kj z)."""
    df, coding = T.coded_items(df, [("binary", list(items))], list(items), None)
    table = pattern_table(df, items, [covariate], weight)
    x, w = M.pattern_arrays(table, items)
    z = table[covariate].to_numpy(float)
    k, j = n_classes, len(items)
    seen, xx = ~np.isnan(x), np.where(np.isnan(x), 0, x)
    design = np.column_stack([np.ones(len(z)), z if predict_class else np.zeros(len(z))])[:, : 2 if predict_class else 1]
    at = [items.index(c) for c in dif_items]

    def log_items(theta, beta):
        eta = np.clip(theta[None] + z[:, None, None] * beta[None], -30, 30)  # n x K x J
        return (seen[:, None] * (xx[:, None] * eta - np.logaddexp(0, eta))).sum(axis=2)

    best = None
    for i in range(n_init):
        rng = np.random.default_rng([seed, i])
        theta, beta, gamma = rng.normal(0, 1, (k, j)), np.zeros((k, j)), np.zeros((k - 1, design.shape[1]))
        last = -math.inf
        for _ in range(max_iter):
            p = softmax(np.column_stack([design @ gamma.T, np.zeros(len(z))]))
            joint = np.log(p + EPS) + log_items(theta, beta)
            ll = logsumexp(joint)
            value = float(w @ ll)
            if value - last < tol * (1 + abs(value)):
                break
            last = value
            r = np.exp(joint - ll[:, None]) * w[:, None]
            gamma, _ = S.fit_mnl(design, r + 1e-9)
            for c in range(j):
                if c not in at:
                    s, n = r.T @ xx[:, c], r.T @ seen[:, c]
                    q = np.clip((s + 0.5 / k) / (n + 1 / k), 1e-9, 1 - 1e-9)
                    theta[:, c] = np.log(q) - np.log1p(-q)
                    continue
                cols = 2 * k if by_class else k + 1
                for _ in range(4):
                    g, h = np.zeros(cols), np.eye(cols) * 1e-6
                    for a in range(k):
                        d = np.zeros((len(z), cols))
                        d[:, a] = 1.0
                        d[:, k + (a if by_class else 0)] = z
                        mu = expit(theta[a, c] + beta[a, c] * z)
                        own = r[:, a] * seen[:, c]
                        g += d.T @ (own * (xx[:, c] - mu))
                        h += d.T @ (d * (own * mu * (1 - mu))[:, None])
                    step = np.clip(np.linalg.solve(h, g), -2, 2)
                    theta[:, c] += step[:k]
                    beta[:, c] += step[k:] if by_class else step[k]
        if best is None or value > best["loglik"]:
            best = {"loglik": value, "theta": theta.copy(), "beta": beta.copy(), "gamma": gamma.copy()}

    def total(v):
        b = best["beta"].copy()
        for i, c in enumerate(at):
            b[:, c] = v[i * k : (i + 1) * k] if by_class else v[i]
        p = softmax(np.column_stack([design @ best["gamma"].T, np.zeros(len(z))]))
        return float(w @ logsumexp(np.log(p + EPS) + log_items(best["theta"], b)))

    point = np.concatenate([best["beta"][:, c] if by_class else best["beta"][:1, c] for c in at])
    se = np.sqrt(np.maximum(np.diag(inverse(-hessian(total, point))), 0))
    rows = [(items[c], covariate, a + 1 if by_class else None, best["beta"][a, c]) for c in at for a in (range(k) if by_class else [0])]
    effects = pd.DataFrame(rows, columns=["item", "covariate", "class", "estimate"]).assign(se=se)
    effects["z"] = effects["estimate"] / effects["se"]
    return best | {"effects": effects.assign(p=two_sided(effects["z"])), "n_params": k * j + len(point) + best["gamma"].size, "coding": coding}


# ---------------------------------------------------------------- chains with covariates


def forward_backward_rows(log_b: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """As T.forward_backward, with each row's own start (n x K) and moves (T - 1 x n x K x K)."""
    n, t_max, k = log_b.shape
    top = log_b.max(axis=2, keepdims=True)
    b = np.exp(log_b - top)
    alpha, scale = np.empty_like(b), np.empty((n, t_max))
    for t in range(t_max):
        a = b[:, t] * (start if t == 0 else np.einsum("na,nab->nb", alpha[:, t - 1], moves[t - 1]))
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / np.maximum(scale[:, t], 1e-300)[:, None]
    beta, xi = np.ones_like(b), np.zeros((n, t_max - 1, k, k))
    for t in range(t_max - 2, -1, -1):
        ahead = b[:, t + 1] * beta[:, t + 1] / np.maximum(scale[:, t + 1], 1e-300)[:, None]
        xi[:, t] = alpha[:, t, :, None] * moves[t] * ahead[:, None, :]
        beta[:, t] = np.einsum("nab,nb->na", moves[t], ahead)
    return (np.log(np.maximum(scale, 1e-300)) + top[:, :, 0]).sum(axis=1), alpha * beta, xi


def _covariate_sums(spec: M.Spec, t_max: int, initial: list[int], transition: list[int], x: np.ndarray, w: np.ndarray, state: dict) -> dict:
    """One pass of a chain whose start and moves depend on covariates (the columns after the items): log-likelihood, the measurement's statistics,
    gradient and information of each regression, and the products of the cases' scores."""
    j, k = len(spec.items), spec.k
    z = x[:, t_max * j :]
    one = np.ones((len(x), 1))
    zi, zt = np.hstack([one, z[:, initial]]), np.hstack([one, z[:, transition]])
    edge = np.zeros((len(x), 1))
    start = softmax(np.hstack([zi @ state["gamma"].T, edge]))
    moves = np.stack([np.stack([softmax(np.hstack([zt @ state["tau"][t, a].T, edge])) for a in range(k)], axis=1) for t in range(t_max - 1)]) if t_max > 1 else np.zeros((0, len(x), k, k))
    params = state["params"]
    ll, g, xi = forward_backward_rows(T._emissions(spec, [params] * t_max, x, t_max), start, moves)

    def regression(res, p, mass, d):
        """Scores by logits and covariates, and their information: mass is the rows' weight in the regression."""
        scores = (res[:, :-1, None] * d[:, None, :]).reshape(len(d), -1)
        inner = np.einsum("n,na,ab->nab", mass, p, np.eye(k)) - np.einsum("n,na,nb->nab", mass, p, p)
        size = scores.shape[1]
        return scores, np.einsum("nab,ni,nj->aibj", inner[:, :-1, :-1], d, d, optimize=True).reshape(size, size)

    first, info = regression(g[:, 0] - start, start, w, zi)
    out = {"ll": float(w @ ll), "n": float(w.sum()), "g:start": w @ first, "i:start": info}
    scores = [first]
    for t in range(t_max - 1):
        for a in range(k):
            own, info = regression(xi[:, t, a] - g[:, t, a, None] * moves[t][:, a], moves[t][:, a], w * g[:, t, a], zt)
            out |= {f"g:{t},{a}": w @ own, f"i:{t},{a}": info}
            scores.append(own)
    blocks = [spec.split(x[:, t * j : (t + 1) * j]) for t in range(t_max)]
    total = None
    for t in range(t_max):
        stats = [e.stats(b, g[:, t] * w[:, None], p) for e, b, p in zip(spec.emissions(), blocks[t], params)]
        total = stats if total is None else _pooled(total, stats)
    scores.append(sum(np.concatenate([family_scores(e, b, p, g[:, t]) for e, b, p in zip(spec.emissions(), blocks[t], params)], axis=1) for t in range(t_max)))
    every = np.concatenate(scores, axis=1)
    return out | {"outer": every.T @ (every * w[:, None]), "stats": total}


def _pooled(a: list, b: list) -> list:
    whole = lambda s: {"ll": 0, "entropy": 0, "n": 0, "blocks": s}
    return M._add(whole(a), whole(b))["blocks"]


def _covariate_added(a: dict | None, b: dict) -> dict:
    return b if a is None else {n: _pooled(a[n], b[n]) if n == "stats" else a[n] + b[n] for n in b}


def _covariate_run(spec: M.Spec, m: list, state: dict, max_iter: int, tol: float):
    """Generalised EM as a run (see passes): the measurement is maximised, each regression moves by a Newton step, by halves where the likelihood would fall."""
    prior = lambda s: sum(e.log_prior(p, mm) for e, p, mm in zip(spec.emissions(), s["params"], m))

    def moved(s, sums, share):
        step = lambda n: np.clip(inverse(sums[f"i:{n}"] + 1e-12 * np.eye(len(sums[f"i:{n}"]))) @ sums[f"g:{n}"], -5, 5) * share
        tau = s["tau"].copy()
        for t in range(len(tau)):
            for a in range(spec.k):
                tau[t, a] += step(f"{t},{a}").reshape(tau[t, a].shape)
        params = [e.update(b, mm, p) for e, b, mm, p in zip(spec.emissions(), sums["stats"], m, s["params"])]
        bounded = lambda v: np.clip(v, -25, 25)
        return {"gamma": bounded(s["gamma"] + step("start").reshape(s["gamma"].shape)), "tau": bounded(tau), "params": params}

    sums = yield state
    value, i, done = sums["ll"] + prior(state), 0, False
    for i in range(max_iter):
        share = 1.0
        while True:
            new = moved(state, sums, share)
            after = yield new
            risen = after["ll"] + prior(new)
            if risen >= value - 1e-10 * (1 + abs(value)) or share < 1e-4:
                break
            share /= 2
        done = risen - value < tol * (1 + abs(value))
        state, sums, value = new, after, risen
        if done:
            break
    return {"state": state, "sums": sums, "penalised": value, "iterations": i + 1, "converged": bool(done)}


def fit_lta_covariates(df: DataFrame, items: Sequence[str], times: Sequence, n_statuses: int, *, initial: Sequence[str] = (), transition: Sequence[str] = (), measurement="binary", weight: str | None = None, n_init: int = 5, seed: int = 1, max_iter: int = 500, tol: float = 1e-8, starts: list[tuple] | None = None) -> dict:
    """A chain whose first status and moves are multinomial logits of covariates (last status as reference); measurement equal over time.

    Rows collapse to patterns of items and covariates and stay in Spark, whatever their number; a round is a pass in which a partition returns one row of
    sums.  It starts where the chain without covariates ends, or follows each of `starts` (starting shares, moves, parameters of each block).  Rows with a null covariate go.
    Standard errors are those of the cases' scores.
    """
    k, t_max, extra = n_statuses, len(times), list(dict.fromkeys([*initial, *transition]))
    df = df.dropna(subset=[f"`{c}`" for c in extra]) if extra else df
    base = T.fit_lta(df, items, times, k, measurement=measurement, weight=weight, n_init=n_init, seed=seed, **({"starts": starts[:1], "max_iter": 0, "tol": -1} if starts else {}))
    spec, cols = base.spec, base.columns
    rows = panel.drop_empty(base.coded(df), cols).select(*(F.col(f"`{c}`").cast("double").alias(c) for c in [*cols, *extra]), *([F.col(f"`{weight}`").cast("double").alias("_in")] if weight else []))
    table = P.collapse(rows, [*cols, *extra], "_in" if weight else None, names=("_w", "_rows")).persist()
    m = M.marginals(panel.stack_occasions(table, spec.items, times, ["_w"]), spec, "_w")
    at = lambda names: [extra.index(c) for c in names]
    logits = lambda p: np.log(np.maximum(p[..., :-1], 1e-6)) - np.log(np.maximum(p[..., -1:], 1e-6))

    def opened(start, moves, params):
        gamma = np.column_stack([logits(np.asarray(start, float)), np.zeros((k - 1, len(initial)))])
        return {"gamma": gamma, "tau": np.concatenate([logits(np.asarray(moves, float))[..., None], np.zeros((t_max - 1, k, k - 1, len(transition)))], axis=3), "params": params}

    runs = [_covariate_run(spec, m, opened(*s), max_iter, tol) for s in starts or [(base.start, base.moves, base.params[0])]]
    found = passes.together(runs, table, [*cols, *extra], "_w", lambda x, w, s: _covariate_sums(spec, t_max, at(initial), at(transition), x, w, s), _covariate_added)
    table.unpersist()
    best = max(found, key=lambda r: r["penalised"])
    gamma, tau, sums = best["state"]["gamma"], best["state"]["tau"], best["sums"]
    v = inverse(sums["outer"])
    se = iter(np.sqrt(np.maximum(np.diag(v), 0)))
    coefficients = [("initial", None, None, c + 1, n, float(gamma[c, i]), float(next(se))) for c in range(k - 1) for i, n in enumerate(["(intercept)", *initial])]
    coefficients += [("transition", t + 1, a + 1, c + 1, n, float(tau[t, a, c, i]), float(next(se))) for t in range(t_max - 1) for a in range(k) for c in range(k - 1) for i, n in enumerate(["(intercept)", *transition])]
    n_params = gamma.size + tau.size + sum(e.n_params(mm) for e, mm in zip(spec.emissions(), m))
    table_of = pd.DataFrame(coefficients, columns=["part", "occasion", "from_status", "to_status", "term", "estimate", "se"])
    return {"loglik": sums["ll"], "coefficients": table_of, "params": best["state"]["params"], "gamma": gamma, "tau": tau, "vcov": v, "n_params": n_params, "n": sums["n"], "converged": best["converged"], "iterations": best["iterations"], "logliks": [r["sums"]["ll"] for r in found], "coding": base.coding}


# ---------------------------------------------------------------- random intercepts


def fit_ri_lta(df: DataFrame, items: Sequence[str], times: Sequence, n_statuses: int, *, random_intercept: str = "continuous", n_quadrature: int = 15, weight: str | None = None, n_init: int = 5, seed: int = 1, max_iter: int = 500, tol: float = 1e-7) -> dict:
    """Binary items with logit p = theta_kj + lambda_j u, u of a case constant over time: normal (by quadrature) or two-valued.  Each of `n_init` starts is followed to its end."""
    base = T.fit_lta(df, items, times, n_statuses, weight=weight, n_init=n_init, seed=seed)
    cols, k, t_max, j = panel.column_names(items, times), n_statuses, len(times), len(items)
    x, w = M.pattern_arrays(pattern_table(base.coded(df), cols, (), weight), cols)
    x = x.reshape(len(x), t_max, j)
    seen, xx = ~np.isnan(x), np.where(np.isnan(x), 0, x)
    nodes, mass = gauss_hermite(n_quadrature) if random_intercept == "continuous" else (np.array([-1.0, 1.0]), np.array([0.5, 0.5]))
    p = np.clip(base.params[0][0]["p"], 0.02, 0.98)
    first, found = np.log(p) - np.log1p(-p), []
    for i in range(n_init):  # the base chain with small loadings, then others around it
        rng = np.random.default_rng([seed, i])
        theta = first + (rng.normal(0, 0.7, first.shape) if i else 0)
        load = rng.uniform(0, 2, j) if i else np.full(j, 0.5)
        own = 0.7 * base.moves + 0.3 * rng.dirichlet(np.ones(k), (t_max - 1, k)) if i else base.moves.copy()
        found.append(_ri_climb(xx, seen, w, theta, load, base.start.copy(), own, nodes, mass, random_intercept == "binary", max_iter, tol))
    best = max(found, key=lambda r: r["loglik"])
    if best["loadings"].sum() < 0:  # the intercept's sign is free
        best |= {"loadings": -best["loadings"], "scores": -best["scores"], "mass": best["mass"][::-1]}
    return best | {"logliks": [r["loglik"] for r in found], "n_params": k - 1 + (t_max - 1) * k * (k - 1) + k * j + j + (random_intercept == "binary"), "coding": base.coding}


def _ri_climb(xx: np.ndarray, seen: np.ndarray, w: np.ndarray, theta: np.ndarray, load: np.ndarray, start: np.ndarray, moves: np.ndarray, nodes: np.ndarray, mass: np.ndarray, free_mass: bool, max_iter: int, tol: float) -> dict:
    """EM of a random-intercept chain from one start."""
    (k, j), q_max, last = theta.shape, len(nodes), -math.inf
    for _ in range(max_iter):
        lls, gammas, xis = [], [], []
        for u in nodes:
            eta = np.clip(theta + load[None] * u, -30, 30)
            lb = xx @ eta.T - seen @ np.logaddexp(0, eta).T
            ll, g, xi = T.forward_backward(lb, start, moves)
            lls.append(ll)
            gammas.append(g)
            xis.append(xi)
        joint = np.stack(lls, axis=1) + np.log(mass)
        ll = logsumexp(joint)
        value = float(w @ ll)
        if value - last < tol * (1 + abs(value)):
            break
        last = value
        post = np.exp(joint - ll[:, None]) * w[:, None]
        s = sum((gammas[q][:, 0] * post[:, q][:, None]).sum(axis=0) for q in range(q_max)) + 1 / k
        start = s / s.sum()
        counts = sum(np.einsum("n,ntab->tab", post[:, q], xis[q]) for q in range(q_max)) + 1 / (k * k)
        moves = counts / counts.sum(axis=2, keepdims=True)
        if free_mass:
            mass = post.sum(axis=0) / post.sum()
        n = np.stack([np.einsum("n,ntk,ntj->kj", post[:, q], gammas[q], seen) for q in range(q_max)])  # Q x K x J
        y = np.stack([np.einsum("n,ntk,ntj->kj", post[:, q], gammas[q], xx) for q in range(q_max)])
        for c in range(j):
            for _ in range(4):
                eta = np.clip(theta[None, :, c] + load[c] * nodes[:, None], -30, 30)
                mu = expit(eta)
                res, v = y[:, :, c] - n[:, :, c] * mu, n[:, :, c] * mu * (1 - mu)
                g = np.append(res.sum(axis=0), (res * nodes[:, None]).sum())
                h = np.diag(np.append(v.sum(axis=0), (v * nodes[:, None] ** 2).sum()) + 1e-6)
                h[:k, k] = h[k, :k] = (v * nodes[:, None]).sum(axis=0)
                step = np.clip(np.linalg.solve(h, g), -1.5, 1.5)
                theta[:, c] += step[:k]
                load[c] += step[k]
    return {"loglik": value, "theta": theta, "loadings": load, "start": start, "moves": moves, "nodes": nodes, "mass": mass, "scores": post / post.sum(axis=1, keepdims=True) @ nodes}


# ---------------------------------------------------------------- mixtures of chains


def fit_mixture_lta(df: DataFrame, items: Sequence[str], times: Sequence, n_statuses: int, *, n_classes: int = 2, mover_stayer: bool = False, weight: str | None = None, n_init: int = 5, seed: int = 1, max_iter: int = 500, tol: float = 1e-8) -> dict:
    """Classes of chains over one measurement; with mover_stayer the second class never moves."""
    cols, k, t_max, j = panel.column_names(items, times), n_statuses, len(times), len(items)
    base = T.fit_lta(df, items, times, k, weight=weight, n_init=n_init, seed=seed)
    spec = base.spec
    x, w = M.pattern_arrays(pattern_table(base.coded(df), cols, (), weight), cols)
    c_max, best = 2 if mover_stayer else n_classes, None
    m = [e.marginal(b, np.tile(w, t_max)) for e, b in zip(spec.emissions(), spec.split(np.concatenate([x[:, t * j : (t + 1) * j] for t in range(t_max)])))]
    for i in range(n_init):
        rng = np.random.default_rng([seed, i])
        share, starts = rng.dirichlet(np.full(c_max, 8.0)), [rng.dirichlet(np.full(k, 5.0)) for _ in range(c_max)]
        moves = [base.moves * 0.7 + 0.3 * rng.dirichlet(np.ones(k), (t_max - 1, k)) for _ in range(c_max)]
        if mover_stayer:
            moves[1] = np.repeat(np.eye(k)[None], t_max - 1, axis=0)
        params, last = base.params[0], -math.inf
        for _ in range(max_iter):
            lb = T._emissions(spec, [params] * t_max, x, t_max)
            runs = [T.forward_backward(lb, starts[c], moves[c]) for c in range(c_max)]
            joint = np.log(share + EPS) + np.stack([r[0] for r in runs], axis=1)
            ll = logsumexp(joint)
            value = float(w @ ll)
            if value - last < tol * (1 + abs(value)):
                break
            last = value
            post = np.exp(joint - ll[:, None]) * w[:, None]
            share = (post.sum(axis=0) + 1 / c_max) / (post.sum() + 1)
            mass = np.zeros((len(w), t_max, k))
            for c in range(c_max):
                s = post[:, c] @ runs[c][1][:, 0] + 1 / k
                starts[c] = s / s.sum()
                if not (mover_stayer and c == 1):
                    n = np.einsum("n,ntab->tab", post[:, c], runs[c][2]) + 1 / (k * k)
                    moves[c] = n / n.sum(axis=2, keepdims=True)
                mass += post[:, c][:, None, None] * runs[c][1]
            total = None
            for t in range(t_max):
                own = [e.stats(b, mass[:, t], p) for e, b, p in zip(spec.emissions(), spec.split(x[:, t * j : (t + 1) * j]), params)]
                total = own if total is None else [{n: a[n] + b[n] for n in a} for a, b in zip(total, own)]
            params = [e.update(b, mm, p) for e, b, mm, p in zip(spec.emissions(), total, m, params)]
        if best is None or value > best["loglik"]:
            best = {"loglik": value, "share": share, "starts": [s.copy() for s in starts], "moves": [v.copy() for v in moves], "params": params}
    per = (t_max - 1) * k * (k - 1)
    return best | {"n_params": c_max - 1 + c_max * (k - 1) + per * (1 if mover_stayer else c_max) + sum(e.n_params(mm) for e, mm in zip(spec.emissions(), m)), "coding": base.coding}


def compare_longitudinal(df: DataFrame, items: Sequence[str], times: Sequence, k_range: Sequence[int], *, model: str = "lta", **how) -> DataFrame:
    """The enumeration table of chains (lta), repeated-measures classes (rmlca), or curves of one item (lcga, gmm)."""
    fits = {"lta": T.fit_lta, "rmlca": T.fit_rmlca, "lcga": G.fit_lcga, "gmm": G.fit_gmm}
    if model not in fits:
        raise ValueError(f"no such model: {model}")
    curves = model in ("lcga", "gmm")
    if curves and len(items) != 1:
        raise ValueError("curves are fitted to one item")
    over = ([f"{items[0]}@{t}" for t in times],) if curves else (items, times)
    rows = []
    for k in k_range:
        f = fits[model](df, *over, k, **how)
        m = f.metrics()
        rows.append((k, m["loglik"], m["n_params"], m["aic"], m["bic"], m["sabic"], None if k == 1 else m["relative_entropy"]))
    return df.sparkSession.createDataFrame(rows, "classes int, ll double, params int, aic double, bic double, sabic double, entropy double")
