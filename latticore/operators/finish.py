"""Newton finish of a mixture by analytic case scores, and standard errors of later steps that carry the measurement's uncertainty.

A case's score is its posterior's mean of the classes' own scores (Fisher's identity), so each family only gives the derivatives of its
log-density.  Scores, their products and derivatives add up over rows: over arrays, or over the partitions of a table in one pass a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import gradient, inverse, logsumexp, two_sided
from latticore.operators import curvature as V
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.operators.curvature import added, family_scores
from latticore.plans import patterns as P
from latticore.sources import panel

#: A logit or log-rate beyond this is at its bound and held there.
HELD = 15.0


def case_scores(fit: M.Fit, x: np.ndarray, theta: np.ndarray | None = None) -> np.ndarray:
    """The derivative of each row's log-likelihood by the free parameters (Fit.free)."""
    pi, params = (fit.pi, fit.params) if theta is None else fit.at(theta)
    joint = M._joint(fit.spec, pi, params, x)
    r = np.exp(joint - logsumexp(joint)[:, None])
    return np.concatenate([r[:, :-1] - pi[:-1], *(family_scores(e, b, p, r) for e, b, p in zip(fit.spec.emissions(), fit.spec.split(x), params))], axis=1)


def score_sums(fit: M.Fit, x: np.ndarray, w: np.ndarray, theta: np.ndarray) -> dict:
    """Log-likelihood, gradient, squared scores and Hessian, summed over rows; all analytic."""
    return V.mixture_sums(fit.spec, *fit.at(theta), x, w)


def climb(theta: np.ndarray, prior, n: float, *, rounds: int = 50, tol: float = 1e-10, near: float = 1e-3):
    """Steps to the maximum of the penalised log-likelihood, as a run (see passes), until its gradient per unit of weight is under tol.

    While the gradient is over `near` the squared scores stand for the curvature (BHHH), then the Hessian does (Newton).  prior(theta)
    gives value, gradient and Hessian.  Parameters at a bound are held there; a step is capped at 1 in every parameter and halved while it doesn't climb.
    """
    s = yield theta
    pv, pg, ph = prior(theta)
    value, i, kinds = s["ll"] + pv, 0, []
    for i in range(rounds):
        g = s["g"] + pg
        bound = (np.abs(theta) > HELD) & (theta * g >= 0)
        steep = np.abs(np.where(bound, 0, g)).max(initial=0) / n
        if steep < tol:
            break
        kinds.append("bhhh" if steep > near else "newton")
        h = (-s["outer"] if steep > near else s["h"]) + ph
        h = (h + h.T) / 2
        free = np.flatnonzero(~bound)
        values, vectors = np.linalg.eigh(h[np.ix_(free, free)])
        values = -np.maximum(np.abs(values), 1e-8 * np.abs(values).max(initial=1e-300))  # uphill, whatever the curvature
        step = np.zeros(len(theta))
        step[free] = -vectors @ ((vectors.T @ g[free]) / values)
        step *= min(1.0, 1.0 / max(np.abs(step).max(initial=0), 1e-300))
        share = 1.0
        while share > 1e-6:
            new = yield theta + share * step
            own = prior(theta + share * step)
            if np.isfinite(new["ll"]) and new["ll"] + own[0] >= value - 1e-12 * (1 + abs(value)):
                break
            share /= 2
        else:
            break
        theta, s, (pv, pg, ph) = theta + share * step, new, own
        value = s["ll"] + pv
    g = s["g"] + pg
    bound = (np.abs(theta) > HELD) & (theta * g >= 0)
    return {"theta": theta, "ll": s["ll"], "penalised": value, "gradient": float(np.abs(np.where(bound, 0, g)).max(initial=0) / n), "h": s["h"], "outer": s["outer"], "held": bound, "steps": len(kinds), "kinds": kinds}


def newton_run(fit: M.Fit, n: float, **how):
    """climb() of a mixture."""
    emissions = fit.spec.emissions()

    def prior(theta):
        pi, params = fit.at(theta)
        a = fit.spec.alpha.get("latent", 1.0)
        parts = [V.family_prior(e, p, m) for e, p, m in zip(emissions, params, fit.marginals)]
        g = np.concatenate([a / fit.spec.k * (1 - fit.spec.k * pi)[:-1], *(d for d, _ in parts)])
        return M._log_prior(fit.spec, pi, params, fit.marginals), g, V._blocks([V._softmax_curvature(pi, a), *(d for _, d in parts)])

    return climb(fit.free(), prior, n, **how)


def _finished(fit: M.Fit, r: dict, entropy: float) -> M.Fit:
    pi, params = fit.at(r["theta"])
    return replace(fit, pi=pi, params=params, loglik=r["ll"], penalised=r["penalised"], entropy=entropy, converged=True)


def newton_finish(fit: M.Fit, x: np.ndarray, w: np.ndarray, **how) -> M.Fit:
    """The fit moved to the maximum nearby, on a pattern table."""
    r = passes.alone(newton_run(fit, float(w.sum()), **how), lambda t: score_sums(fit, x, w, t))
    return _finished(fit, r, M._statistics(fit.spec, *fit.at(r["theta"]), x, w)["entropy"])


def newton_finish_table(fit: M.Fit, df: DataFrame, weight: str | None = None, **how) -> M.Fit:
    """The same on the rows of a table: they collapse to patterns, which stay where they are, and each step is one pass over them."""
    items = fit.spec.items
    rows = panel.drop_empty(fit.coded(df), items).select(*(F.col(f"`{c}`").cast("double").alias(c) for c in items), *([F.col(weight).cast("double").alias("_in")] if weight else []))
    table = P.collapse(rows, items, "_in" if weight else None, names=("_w", "_rows")).persist()
    r = passes.together([newton_run(fit, fit.n, **how)], table, items, "_w", lambda x, w, t: score_sums(fit, x, w, t), added)[0]
    done = _finished(fit, r, fit.entropy)
    p = F.col("posterior")
    entropy = replace(done, coding={}).transform(table).agg(F.sum(F.col("_w") * -sum((p[k] * F.log(p[k] + F.lit(1e-15)) for k in range(fit.spec.k)), F.lit(0.0)))).first()[0]
    table.unpersist()
    return replace(done, entropy=float(entropy))


# ---------------------------------------------------------------- chains


def finish_chain(chain: T.Chain, df: DataFrame, *, weight: str | None = None, alpha: float = 1.0, same_moves: bool = False, **how) -> tuple[T.Chain, dict]:
    """The chain moved to the maximum nearby, and a report: theta, names, gradient per unit weight, steps, their kinds, and vcov by kind.

    Rows collapse to patterns, which stay where they are; each step is one pass over them, in which a partition returns one row of sums.  Moves that are
    0 stay so; `same_moves` keeps those of all occasions equal; `alpha` is the fit's.
    """
    cols, spec = chain.columns, chain.spec
    rows = panel.drop_empty(chain.coded(df), cols).select(*(F.col(f"`{c}`").cast("double").alias(c) for c in cols), *([F.col(weight).cast("double").alias("_in")] if weight else []))
    table = P.collapse(rows, cols, "_in" if weight else None, names=("_w", "_rows")).persist()
    long = panel.stack_occasions(table, spec.items, chain.times, ["_w"])
    whole = M.marginals(long, spec, "_w")
    packing = V.Packing(chain, same_moves)
    m = [whole] if packing.equal else [M.marginals(long.where(F.col("occasion") == t + 1), spec, "_w") for t in range(len(chain.times))]
    n = float(table.agg(F.sum("_w")).first()[0])
    run = climb(packing.free(), lambda t: packing.prior(t, alpha, m), n, **how)
    r = passes.together([run], table, cols, "_w", packing.sums, added)[0]
    start, moves, params = packing.at(r["theta"])
    done = replace(chain, start=start, moves=moves, params=params, loglik=r["ll"], penalised=r["penalised"], converged=True)
    entropy = passes.together([_once((start, moves, params))], table, cols, "_w", lambda x, w, s: {"entropy": T._chain_sums(spec, len(chain.times), x, w, s)["entropy"]}, added)[0]["entropy"]
    table.unpersist()
    free = ~r["held"]
    keep = np.ix_(free, free)
    bread, meat = inverse(-r["h"][keep]), r["outer"][keep]
    whole_v = lambda v: _spread(v, keep, packing.size)
    vcov = {"hessian": whole_v(bread), "opg": whole_v(inverse(meat)), "robust": whole_v(bread @ meat @ bread)}
    return replace(done, entropy=entropy), {**{k: r[k] for k in ("theta", "gradient", "steps", "kinds")}, "vcov": vcov, "packing": packing}


def _once(state):
    s = yield state
    return s


def _spread(v: np.ndarray, keep, size: int) -> np.ndarray:
    """v in the rows and columns kept; held parameters have no variance."""
    out = np.zeros((size, size))
    out[keep] = v
    return out


def chain_errors(chain: T.Chain, report: dict, kind: str = "robust") -> pd.DataFrame:
    """part, term, estimate and se of a finished chain, on the scale of probabilities (start, moves) and of reported parameters."""
    packing, v, out = report["packing"], report["vcov"][kind], []
    for t, a, states, at in packing.rows:
        p = (chain.start if a is None else chain.moves[t, a])[states]
        jac = (np.diag(p) - np.outer(p, p))[:, :-1]
        own = slice(at, at + len(p) - 1)
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", jac, v[own, own], jac), 0))
        names = [("initial", str(s + 1)) if a is None else ("transition", f"{t + 1}:{a + 1}>{s + 1}") for s in states]
        out += [(*name, float(e), float(d)) for name, e, d in zip(names, p, se)]
    for i, params in enumerate(chain.params[: len(packing.measured) - 1]):
        at = packing.measured[i]
        for e, p in zip(packing.emissions, params):
            theta = e.free(p)
            own = slice(at, at + len(theta))
            reported = lambda t, e=e, p=p: np.array([r[-1] for r in e.rows(e.fixed(t, p))])
            jac = gradient(reported, theta)
            se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", jac, v[own, own], jac), 0))
            when = "" if packing.equal else f"@{i + 1}"
            out += [("measurement", f"{r[0]}{when}|{r[1]}|{r[2] or ''}|{r[3]}", float(r[4]), float(d)) for r, d in zip(e.rows(p), se)]
            at += len(theta)
    return pd.DataFrame(out, columns=["part", "term", "estimate", "se"])


# ---------------------------------------------------------------- later steps


def later_step(fit: M.Fit, df: DataFrame, columns: Sequence[str], *, correction: str = "ML", weight: str | None = None, kind: str = "robust", max_rows: int = 200_000) -> pd.DataFrame:
    """Regression of the class on covariates whose standard errors carry the measurement's: class, term, estimate, se, se_step, z, p.

    correction: ML, BCH, none (three steps) or two-step.  The variance is that of the step itself plus J V J', with V the
    covariance of the measurement's free parameters (`kind`) and J the derivative of the step's estimates by them.  The table of patterns and
    covariate values has at most `max_rows` rows, and is refused beyond them.
    """
    if correction not in ("ML", "BCH", "none", "two-step"):
        raise ValueError("correction is ML, BCH, none or two-step")
    items, k = fit.spec.items, fit.spec.k
    rows = panel.drop_empty(fit.coded(df), items).dropna(subset=[f"`{c}`" for c in columns])
    table = P.collapse(rows, [*items, *columns], weight, names=("_weight", "_rows")).limit(max_rows + 1).toPandas()
    if len(table) > max_rows:
        raise ValueError(f"more than {max_rows} patterns with covariates")
    x, w = M.pattern_arrays(table, items)
    z = np.column_stack([np.ones(len(table)), table[list(columns)].to_numpy(float)])
    patterns, back = np.unique(np.where(np.isnan(x), -1e300, x), axis=0, return_inverse=True)
    patterns = np.where(patterns == -1e300, np.nan, patterns)
    total = np.bincount(back.ravel(), weights=w)

    def estimate(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = M._joint(fit.spec, *fit.at(theta), x)
        post = np.exp(joint - logsumexp(joint)[:, None])
        if correction == "two-step":
            return S.two_step_arrays(z, np.exp(joint - joint.max(axis=1, keepdims=True)) / fit.at(theta)[0], w)
        error = (post * w[:, None]).T @ post
        error = error / error.sum(axis=0)
        counts = post * w[:, None]
        if correction == "none":
            return S.fit_mnl(z, counts)
        if correction == "BCH":
            return S.fit_mnl(z, counts @ inverse(error).T)
        return S.ml_covariates(z, counts, error)

    beta, own = estimate(fit.free())
    jac = gradient(lambda t: estimate(t)[0].ravel(), fit.free(), 1e-4)
    v = own + jac @ fit.vcov(patterns, total, kind) @ jac.T
    names, out = ["(intercept)", *columns], []
    for c in range(k - 1):
        for j, t in enumerate(names):
            i = c * len(names) + j
            se = float(np.sqrt(max(v[i, i], 0.0)))
            zz = beta[c, j] / se if se else np.nan
            out.append((c + 1, t, float(beta[c, j]), se, float(np.sqrt(max(own[i, i], 0.0))), float(zz), float(two_sided(np.nan_to_num(zz)))))
    return pd.DataFrame(out, columns=["class", "term", "estimate", "se", "se_step", "z", "p"])


def outcome_slopes_categorical(weighted: DataFrame, outcome: str, columns: Sequence[str], k: int, *, column: str = "bch", weight: str | None = None, max_levels: int = 100) -> pd.DataFrame:
    """A multinomial regression of a categorical outcome in each class, under class weights (an array column): class, category, term,
    estimate, se, z, p; the last category is the reference."""
    y = F.col(f"`{outcome}`").cast("string")
    held = weighted.where(y.isNotNull() & F.col(column).isNotNull()).dropna(subset=[f"`{c}`" for c in columns])
    levels = sorted(r[0] for r in held.select(y).distinct().limit(max_levels + 1).collect())
    if len(levels) > max_levels:
        raise ValueError(f"more than {max_levels} categories")
    names = [f"_o{c}_{v}" for c in range(k) for v in range(len(levels))]
    table = S.design_table(held, columns, [F.when(y == v, F.col(column)[c]).otherwise(0.0) for c in range(k) for v in levels], names, weight=weight)
    x, terms, out = S._design(table, len(columns)), ["(intercept)", *columns], []
    for c in range(k):
        beta, v = S.fit_mnl(x, table[[f"_o{c}_{i}" for i in range(len(levels))]].to_numpy(float))
        for i, level in enumerate(levels[:-1]):
            for j, t in enumerate(terms):
                se = float(np.sqrt(max(v[i * len(terms) + j, i * len(terms) + j], 0.0)))
                z = beta[i, j] / se if se else np.nan
                out.append((c + 1, level, t, float(beta[i, j]), se, float(z), float(two_sided(np.nan_to_num(z)))))
    return pd.DataFrame(out, columns=["class", "category", "term", "estimate", "se", "z", "p"])
