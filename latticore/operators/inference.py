"""Finishing and inference: Newton-type polish, accelerated EM, standard errors of chains and curves, fit under missing cells, outcomes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, bfgs, chi2_sf, gradient, hessian, inverse, logsumexp, pinv, two_sided
from latticore.operators import diagnostics as D
from latticore.operators import growth as G
from latticore.operators import mixture as M
from latticore.operators import structural as S
from latticore.operators import transition as T

# ---------------------------------------------------------------- finishing


def penalised(fit: M.Fit, x: np.ndarray, w: np.ndarray, theta: np.ndarray) -> float:
    pi, params = fit.at(theta)
    return float(w @ fit.case_logliks(x, theta)) + M._log_prior(fit.spec, pi, params, fit.marginals)


def polish(fit: M.Fit, x: np.ndarray, w: np.ndarray, *, rounds: int = 200) -> M.Fit:
    """The fit moved to the nearby maximum of the penalised likelihood by BFGS on free parameters."""
    theta = bfgs(lambda t: -penalised(fit, x, w, t) / w.sum(), fit.free(), rounds=rounds, tol=1e-8)
    if penalised(fit, x, w, theta) < fit.penalised:
        return fit
    pi, params = fit.at(theta)
    s = M._statistics(fit.spec, pi, params, x, w)
    return replace(fit, pi=pi, params=params, loglik=s["ll"], penalised=s["ll"] + M._log_prior(fit.spec, pi, params, fit.marginals), entropy=s["entropy"], converged=True)


def squared_em(fit: M.Fit, x: np.ndarray, w: np.ndarray, *, rounds: int = 200, tol: float = 1e-9) -> M.Fit:
    """EM with squared extrapolation of two steps; an extrapolated point that does not climb is given up for the plain step."""
    spec, m = fit.spec, fit.marginals

    def step(theta):
        pi, params = fit.at(theta)
        pi, params = M._maximised(spec, M._statistics(spec, pi, params, x, w), m, params)
        return M.with_parameters(spec, pi, params).free()

    theta = fit.free()
    value = penalised(fit, x, w, theta)
    for _ in range(rounds):
        one = step(theta)
        two = step(one)
        r, v = one - theta, two - 2 * one + theta
        size = -max(1.0, float(np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300)))
        far = theta - 2 * size * r + size * size * v
        new = far if np.isfinite(far).all() and penalised(fit, x, w, far) >= penalised(fit, x, w, two) else two
        after = penalised(fit, x, w, new)
        theta = new
        if after - value < tol * (1 + abs(after)):
            break
        value = after
    pi, params = fit.at(theta)
    s = M._statistics(spec, pi, params, x, w)
    return replace(fit, pi=pi, params=params, loglik=s["ll"], penalised=after, entropy=s["entropy"], converged=True)


def boundary(fit: M.Fit, near: float = 1e-3) -> pd.DataFrame:
    """Probabilities within `near` of 0 or 1 and variances at their floor: item, parameter, category, class, estimate."""
    rows = [r for e, p in zip(fit.spec.emissions(), fit.params) for r in e.rows(p) if r[1] in ("p", "probability", "zero") and (r[-1] < near or r[-1] > 1 - near) or r[1] == "var" and r[-1] < 1e-8]
    return pd.DataFrame(rows, columns=["item", "parameter", "category", "class", "estimate"])


# ---------------------------------------------------------------- fit under missing cells


def absolute_fit_mar(fit: M.Fit, x: np.ndarray, w: np.ndarray) -> dict:
    """G2 of the model against the saturated model, both under missing at random, and the test of missing completely at random."""
    levels = [[0, 1] if f == "binary" else list(range(1, fit.spec.cats[c] + 1)) for f, cols in fit.spec.blocks for c in cols]
    _, _, saturated = D.saturated_mar(x, w, levels)
    cells = math.prod(map(len, levels))
    g2, df = 2 * (saturated - float(w @ fit.case_logliks(x))), cells - fit.n_params - 1
    mcar = D.mcar_test(x, w, levels)
    return {"g2": g2, "df": df, "p_value": chi2_sf(g2, df), "ll_sat": saturated, "g2_mcar": mcar["stat"], "df_mcar": mcar["df"], "p_value_mcar": mcar["p_value"], "n_cells": cells}


def bvr_bootstrap(df: DataFrame, fit: M.Fit, *, n_reps: int = 50, seed: int = 1) -> pd.DataFrame:
    """Bivariate residuals of binary items with p-values from data simulated from the model and fitted again."""
    items = fit.spec.items

    def residuals(f, x, w):
        joint = M._joint(f.spec, f.pi, f.params, x)
        r = np.exp(joint - logsumexp(joint)[:, None]) * w[:, None]
        out = []
        for a, b in itertools.combinations(range(len(items)), 2):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            mass, stat = r[both].sum(axis=0), 0.0
            for u, v in itertools.product((0, 1), repeat=2):
                p = f.params[0]["p"]
                e = mass @ ((p[:, a] if u else 1 - p[:, a]) * (p[:, b] if v else 1 - p[:, b]))
                o = w[both][(x[both, a] == u) & (x[both, b] == v)].sum()
                stat += (o - e) ** 2 / e
            out.append(stat)
        return np.array(out)

    from latticore.plans import patterns as P

    table = P.collapse(fit.coded(df), items, fit.weight, names=("_weight", "_rows")).limit(100_001).toPandas()
    if len(table) > 100_000:
        raise ValueError("more than 100000 patterns")
    seen, sims = residuals(fit, *M.pattern_arrays(table, items)), []
    for i in range(n_reps):
        x, w = M.simulated_patterns(fit, int(round(fit.n)), seed + i)
        sims.append(residuals(M.fit_table(replace(fit.spec), x, w, starts=[(fit.pi, fit.params)], tol=1e-6), x, w))
    p = (np.sum(np.stack(sims) >= seen, axis=0) + 1) / (n_reps + 1) if sims else np.full(len(seen), math.nan)
    pairs = list(itertools.combinations(items, 2))
    return pd.DataFrame({"item_a": [a for a, _ in pairs], "item_b": [b for _, b in pairs], "bvr": seen, "p_value": p})


# ---------------------------------------------------------------- chains


def _chain_free(c: T.Chain) -> np.ndarray:
    """Log-odds against the last status, of the start and of the moves, then the measurement's free parameters."""
    lo = lambda p: (np.log(np.maximum(p[..., :-1], 1e-9)) - np.log(np.maximum(p[..., -1:], 1e-9))).ravel()
    return np.concatenate([lo(c.start), lo(c.moves), *(e.free(p) for e, p in zip(c.spec.emissions(), c.params[0]))])


def _chain_at(c: T.Chain, theta: np.ndarray) -> T.Chain:
    k, t = c.spec.k, len(c.moves)

    def soft(v):
        e = np.exp(np.clip(np.concatenate([v, np.zeros((*v.shape[:-1], 1))], axis=-1), -35, 35))
        return e / e.sum(axis=-1, keepdims=True)

    start, moves = soft(theta[: k - 1]), soft(theta[k - 1 : k - 1 + t * k * (k - 1)].reshape(t, k, k - 1))
    params, a = [], k - 1 + t * k * (k - 1)
    for e, p in zip(c.spec.emissions(), c.params[0]):
        n = len(e.free(p))
        params.append(e.fixed(theta[a : a + n], p))
        a += n
    return T.with_parameters(c.spec, c.times, start, moves, params)


def chain_estimates(c: T.Chain, x: np.ndarray, w: np.ndarray, kind: str = "robust") -> pd.DataFrame:
    """Start, moves and (time-invariant) measurement with standard errors: hessian, opg or robust."""
    theta = _chain_free(c)
    ll = lambda t: T.chain_loglik(_chain_at(c, t), x)
    scores = gradient(ll, theta)
    meat = scores.T @ (scores * w[:, None])
    bread = inverse(-hessian(lambda t: float(w @ ll(t)), theta)) if kind != "opg" else None
    v = inverse(meat) if kind == "opg" else bread if kind == "hessian" else bread @ meat @ bread

    def reported(t):
        d = _chain_at(c, t)
        return np.concatenate([d.start, d.moves.ravel(), [r[-1] for e, p in zip(d.spec.emissions(), d.params[0]) for r in e.rows(p)]])

    k, est, jac = c.spec.k, reported(theta), gradient(reported, theta)
    se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", jac, v, jac), 0))
    names = [("initial", str(a + 1)) for a in range(k)] + [("transition", f"{t + 1}:{a + 1}>{b + 1}") for t in range(len(c.moves)) for a in range(k) for b in range(k)] + [("measurement", f"{r[0]}|{r[3]}") for e, p in zip(c.spec.emissions(), c.params[0]) for r in e.rows(p)]
    return pd.DataFrame(names, columns=["part", "term"]).assign(estimate=est, se=se)


def lta_g2(c: T.Chain, x: np.ndarray, w: np.ndarray) -> dict:
    """G2 of complete patterns of binary items against the chain's expected counts."""
    full = ~np.isnan(x).any(axis=1)
    o, e = w[full], w[full].sum() * np.exp(T.chain_loglik(c, x[full]))
    g2, cells = float(2 * (o * np.log(o / e)).sum()), 2 ** x.shape[1]
    return {"g2": g2, "df": cells - c.n_params - 1, "p_value": chi2_sf(g2, cells - c.n_params - 1), "n_cells": cells, "n_patterns": int(full.sum())}


def lta_distal(scored: DataFrame, outcome: str, k: int) -> DataFrame:
    """Means of an outcome measured after the last occasion, by last status (posterior-weighted)."""
    return S.distal_means(scored.withColumn("_last", F.element_at("posteriors", -1)), outcome, k, column="_last")


def simulate_chain(c: T.Chain, n: int, seed: int = 1) -> pd.DataFrame:
    """n rows of binary items drawn from a chain, with their statuses."""
    rng = np.random.default_rng(seed)
    s = np.zeros((n, len(c.times)), int)
    s[:, 0] = rng.choice(c.spec.k, n, p=c.start / c.start.sum())
    for t in range(1, len(c.times)):
        s[:, t] = (rng.random(n)[:, None] > c.moves[t - 1][s[:, t - 1]].cumsum(axis=1)[:, :-1]).sum(axis=1)
    out = {}
    for t, name in enumerate(c.times):
        for j, item in enumerate(c.spec.items):
            out[f"{item}@{name}"] = (rng.random(n) < c.params[t][0]["p"][s[:, t], j]).astype(float)
    return pd.DataFrame(out | {f"status@{name}": s[:, t] + 1 for t, name in enumerate(c.times)})


def fit_rmlca_invariant(df: DataFrame, items: Sequence[str], times: Sequence, n_classes: int, **how) -> T.Chain:
    """Repeated-measures classes with one measurement for all occasions: a chain in which nobody moves."""
    stay = [(a + 1, b + 1) for a in range(n_classes) for b in range(n_classes) if a != b]
    return T.fit_lta(df, items, times, n_classes, forbidden=stay, **how)


# ---------------------------------------------------------------- curves


def growth_estimates(g: G.Growth, y: np.ndarray, w: np.ndarray, kind: str = "robust") -> pd.DataFrame:
    """Growth coefficients with standard errors; class shares are estimated with them, dispersions held."""
    ll, theta = _growth_density(g, y)
    scores = gradient(ll, theta)
    meat, bread = scores.T @ (scores * w[:, None]), inverse(-hessian(lambda t: float(w @ ll(t)), theta))
    v = inverse(meat) if kind == "opg" else bread if kind == "hessian" else bread @ meat @ bread
    return _growth_table(g, theta, v)


def growth_estimates_opg(g: G.Growth, df: DataFrame, weight: str | None = None) -> pd.DataFrame:
    """growth_estimates() from the outer products of scores, of which each partition returns the sum: for any number of rows."""
    cols = g.inputs
    size = len(_growth_density(g, np.zeros((0, len(cols))))[1])
    if g.predictors:
        df = df.dropna(subset=[f"`{c}`" for c in g.predictors])

    def run(frames):
        total = np.zeros((size, size))
        for f in frames:
            if len(f):
                w = f[weight].to_numpy(float) if weight else np.ones(len(f))
                s = _growth_scores(g, f[cols].to_numpy(float, na_value=np.nan))
                total += s.T @ (s * w[:, None])
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    rows = df.select(*(F.col(f"`{c}`") for c in cols), *([weight] if weight else [])).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    meat = np.zeros((size, size))
    for r in rows:
        meat[r.i, r.j] = r.v
    return _growth_table(g, _growth_density(g, np.zeros((0, len(g.inputs))))[1], inverse(meat))


def _growth_scores(g: G.Growth, y: np.ndarray) -> np.ndarray:
    return gradient(*_growth_density(g, y))


def _growth_density(g: G.Growth, y: np.ndarray):
    """Log-likelihoods of rows as a function of class logits, curves and predictors' slopes, and where these are."""
    k, d = g.beta.shape
    slopes = g.extra.get("slopes", np.zeros((k, d, 0)))
    at = k - 1 + k * d

    def ll(t):
        e, extra = np.exp(np.append(t[: k - 1], 0.0)), g.extra
        if g.predictors:
            own = t[at:].reshape(-1, d, len(g.predictors))
            extra = extra | {"slopes": own if g.by_class else np.repeat(own, k, axis=0)}
        return logsumexp(np.log(e / e.sum() + EPS) + G._density(g.family, y, g.design, t[k - 1 : at].reshape(k, d), extra))

    return ll, np.concatenate([np.log(g.pi[:-1] / g.pi[-1]), g.beta.ravel(), (slopes if g.by_class else slopes[:1]).ravel()])


def _growth_table(g: G.Growth, theta: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """class, degree, estimate, se, z, p_value; with predictors their slopes follow, by a column `term` (class 0: equal over classes)."""
    k, d = g.beta.shape
    rows = [(c + 1, j, "(intercept)") for c in range(k) for j in range(d)]
    rows += [(c, j, n) for c in (range(1, k + 1) if g.by_class else [0]) for j in range(d) for n in g.predictors]
    out = pd.DataFrame(rows, columns=["class", "degree", "term"]).assign(estimate=theta[k - 1 :], se=np.sqrt(np.maximum(np.diag(v)[k - 1 :], 0)))
    out = out.assign(z=out["estimate"] / out["se"], p_value=two_sided(out["estimate"] / out["se"]))
    return out if g.predictors else out.drop(columns="term")


def simulate_growth(g: G.Growth, n: int, seed: int = 1) -> pd.DataFrame:
    """n complete rows drawn from a growth model, with their class."""
    rng = np.random.default_rng(seed)
    c = rng.choice(len(g.pi), n, p=g.pi / g.pi.sum())
    if g.predictors:
        raise ValueError("rows of a model with predictors are drawn given the predictors, which are not at hand")
    eta = g.beta[c] @ g.design.T
    if g.family == "gaussian+random":
        q = g.extra["psi"].shape[1]
        root = np.stack([np.linalg.cholesky(p + 1e-12 * np.eye(q)) for p in g.extra["psi"]])
        u = np.einsum("nij,nj->ni", root[c], rng.standard_normal((n, q)))
        y = eta + u @ g.design[:, :q].T + np.sqrt(g.extra["theta"][c]) * rng.standard_normal(eta.shape)
    elif g.family == "gaussian":
        y = eta + np.sqrt(g.extra["var"][c]) * rng.standard_normal(eta.shape)
    elif g.family.startswith("binomial"):
        u = g.extra["sd"][c][:, None] * rng.standard_normal((n, 1)) if "sd" in g.extra else 0.0
        y = (rng.random(eta.shape) < 1 / (1 + np.exp(-(eta + u)))).astype(float)
    else:
        mu = np.exp(np.clip(eta, -30, 30))
        if g.family == "negbin":
            mu = mu * rng.gamma(1 / g.extra["alpha"], g.extra["alpha"], mu.shape)
        y = rng.poisson(mu).astype(float)
        if g.family == "zip":
            y[rng.random(y.shape) < g.extra["zero"][c][:, None]] = 0.0
    return pd.DataFrame(y, columns=g.columns).assign(**{"class": c + 1})


# ---------------------------------------------------------------- outcomes and terms


def add_outcome(scored: DataFrame, outcome: str, k: int, *, outcome_type: str = "auto", correction: str = "auto", variances: str = "equal", weight: str | None = None) -> dict:
    """A distal outcome by class: means with BCH weights, or shares by maximum likelihood; with the omnibus test of means."""
    if outcome_type == "auto":
        kind = dict(scored.dtypes)[outcome]
        few = scored.agg(F.approx_count_distinct(outcome)).first()[0] <= 10
        outcome_type = "categorical" if kind in ("string", "boolean") or few else "continuous"
    if correction == "auto":
        correction = "BCH" if outcome_type == "continuous" else "ML"
    if outcome_type == "categorical" and correction == "ML":
        return {"type": outcome_type, "estimates": S.ml_outcome(scored, outcome, k, weight=weight)}
    weighted, column = (S.with_bch_weights(scored, S.classification_error(scored, k, weight=weight)), "bch") if correction == "BCH" else (scored, "posterior")
    if outcome_type == "categorical":
        return {"type": outcome_type, "estimates": S.distal_shares(weighted, outcome, k, column=column, weight=weight).toPandas()}
    m = S.distal_means(weighted, outcome, k, column=column, weight=weight, equal_variances=variances == "equal").orderBy("class").toPandas()
    v = S.distal_vcov(weighted, outcome, m["mean"].tolist(), column=column, weight=weight)
    return {"type": outcome_type, "estimates": m.assign(se=np.sqrt(np.maximum(np.diag(v), 0))), "vcov": v, "omnibus": S.omnibus_wald(m["mean"].to_numpy(), v), "contrasts": D.contrasts(m["mean"].tolist(), v, variances=m["variance"].tolist())}


def term_wald(beta: np.ndarray, vcov: np.ndarray, columns: Sequence[int]) -> dict:
    """Whether a term's coefficients (its columns) are zero in all classes; beta: (K - 1) x D."""
    d = beta.shape[1]
    at = [c * d + j for c in range(len(beta)) for j in columns]
    b, v = beta.ravel()[at], vcov[np.ix_(at, at)]
    stat = float(b @ pinv(v) @ b)
    return {"wald_chi2": stat, "df": len(at), "p_value": chi2_sf(stat, len(at))}
