"""One-step models of several parts: chains in groups, and two latent variables with a table of joint shares.

Rows become patterns (with the group's number among the keys).  A small table is fitted as arrays; a larger one stays distributed and all starts
share each pass over it, in which a partition returns one row of sums.  Where it is fitted makes no other difference.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, inverse, logsumexp, two_sided
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import transition as T
from latticore.operators.curvature import family_scores
from latticore.plans import patterns as P
from latticore.sources import panel


def _pooled(a: list | None, b: list) -> list:
    """Statistics of blocks, added."""
    whole = lambda s: {"ll": 0, "entropy": 0, "n": 0, "blocks": s}
    return b if a is None else M._add(whole(a), whole(b))["blocks"]


def _spec(items: Sequence[str], measurement, k: int, alpha: float) -> M.Spec:
    blocks = [(f + ":class" if f == "continuous" else f, c) for f, c in panel.normalize_measurement(items, measurement)]
    return M.Spec(blocks, k, {n: alpha for n in ("latent", "categorical", "poisson", "variances")})


def _top_categories(df: DataFrame, spec: M.Spec) -> dict[str, int]:
    named = [c for f, own in spec.blocks if f in ("categorical", "ordinal") for c in own]
    return {c: int(v) for c, v in df.agg(*(F.max(f"`{c}`").alias(c) for c in named)).first().asDict().items()} if named else {}


# ---------------------------------------------------------------- chains in groups


def _group_sums(spec: M.Spec, t_max: int, x: np.ndarray, w: np.ndarray, state: tuple) -> list:
    """The sums of T._chain_sums for each group (None for a group without rows); the last column is the group's number."""
    out = []
    for g, one in enumerate(zip(*state)):
        at = x[:, -1] == g
        out.append(T._chain_sums(spec, t_max, x[at, :-1], w[at], one) if at.any() else None)
    return out


def _groups_added(a: list | None, b: list) -> list:
    return b if a is None else [u if v is None else T._added(u, v) for u, v in zip(a, b)]


def tied(e, stats: dict, m: dict, params: dict, equal: str) -> dict:
    """Continuous items whose means or variances are equal over blocks (of groups or occasions), by conditional maximisation.

    Equal means are weighed by the blocks' present variances, and each block's variances are then taken about them; equal variances pool the
    squares about each block's own means.  Arguments are by block; the log-prior is that of each block.
    """
    a = e.alpha / e.k
    n = {p: np.maximum(s["n"], EPS) for p, s in stats.items()}
    if equal == "means":
        mean = sum(s["x"] / params[p]["var"] for p, s in stats.items()) / sum(n[p] / params[p]["var"] for p in stats)
        about = {p: np.maximum(s["xx"] - 2 * mean * s["x"] + s["n"] * mean**2, 0.0) for p, s in stats.items()}
        return {p: {"mean": mean, "var": np.maximum((about[p] + a * m[p]["var"]) / (s["n"] + a), 1e-12)} for p, s in stats.items()}
    means = {p: s["x"] / n[p] for p, s in stats.items()}
    squares = sum(np.maximum(s["xx"] - s["x"] * means[p], 0.0) + a * m[p]["var"] for p, s in stats.items())
    var = np.maximum(squares / sum(s["n"] + a for s in stats.values()), 1e-12)
    return {p: {"mean": means[p], "var": var} for p in stats}


def _updated(spec: M.Spec, totals: dict, m: dict, held: dict, equal: str | None) -> dict:
    """Each pool's parameters from its statistics."""
    new: dict = {p: [] for p in held}
    for b, e in enumerate(spec.emissions()):
        if equal and e.name == "continuous":
            own = tied(e, *({p: v[p][b] for p in held} for v in (totals, m, held)), equal)
        else:
            own = {p: e.update(totals[p][b], m[p][b], held[p][b]) for p in held}
        for p in held:
            new[p].append(own[p])
    return new


def _groups_run(spec: M.Spec, pools: dict, m: dict, state: tuple, *, equal: str | None = None, start_equal: bool, moves_equal: bool, allowed: np.ndarray, alpha: float, max_iter: int, tol: float):
    """EM as a run; pools: (group, occasion) to the measurement it shares."""
    starts, moves, params = state
    k, g_max, last, done = spec.k, len(starts), -math.inf, False
    room = alpha / (k * np.maximum(allowed.sum(axis=2, keepdims=True), 1))
    for i in range(max_iter + 1):
        s = yield starts, moves, params
        held = {p: params[g][t] for (g, t), p in pools.items()}
        prior = alpha / k * np.log(starts[: 1 if start_equal else g_max] + EPS).sum() + sum((room * np.where(allowed, np.log(v + EPS), 0)).sum() for v in moves[: 1 if moves_equal else g_max])
        prior += sum(e.log_prior(own, mm) for p, ps in held.items() for e, own, mm in zip(spec.emissions(), ps, m[p]))
        value = sum(a["ll"] for a in s) + float(prior)
        done = i > 0 and value - last < tol * (1 + abs(value))
        if done or i == max_iter:
            break
        last = value
        first, counts = np.array([a["start"] for a in s]), np.array([a["moves"] for a in s])
        first = (np.repeat(first.sum(axis=0, keepdims=True), g_max, axis=0) if start_equal else first) + alpha / k
        starts = first / first.sum(axis=1, keepdims=True)
        counts = np.where(allowed, (np.repeat(counts.sum(axis=0, keepdims=True), g_max, axis=0) if moves_equal else counts) + room, 0.0)
        moves = counts / np.maximum(counts.sum(axis=3, keepdims=True), EPS)
        totals: dict = {}
        for (g, t), p in pools.items():
            totals[p] = _pooled(totals.get(p), s[g]["stats"][t])
        new = _updated(spec, totals, m, held, equal)
        params = [[new[pools[g, t]] for t in range(len(params[g]))] for g in range(g_max)]
    return {"state": (starts, moves, params), "ll": [a["ll"] for a in s], "penalised": value, "entropy": [a["entropy"] for a in s], "n": [a["n"] for a in s], "converged": bool(done)}


def fit_lta_groups(df: DataFrame, items: Sequence[str], times: Sequence, group: str, n_statuses: int = 2, *, measurement="binary", invariance: str = "full", measurement_equal: bool = True, equal: str | None = None, start_equal: bool = False, moves_equal: bool = False, forbidden: Sequence[tuple[int, int]] = (), weight: str | None = None, n_init: int = 10, alpha: float = 1.0, max_iter: int = 1000, tol: float = 1e-8, seed: int = 1, starts: list[tuple] | None = None, max_patterns: int = 100_000, max_groups: int = 100) -> dict:
    """Hidden Markov chains in groups: measurement, starting shares and moves equal over groups or free.

    Gives the group's chains by name, the log-likelihood, number of parameters and criteria.  Rows of a null group or without an observed item take
    no part; more than `max_groups` groups are refused.  Statuses are ordered by their starting shares over all groups.  `starts`, (starting shares,
    moves, parameters of each block), serve all groups in place of `n_init` random ones.

    Where measurement is free over groups or occasions, `equal` ("means" or "variances") keeps those of the continuous items equal over all of them.
    One occasion makes it a mixture in groups.
    """
    if equal not in (None, "means", "variances"):
        raise ValueError("equal is means or variances")
    spec, k, t_max, j = _spec(items, measurement, n_statuses, alpha), n_statuses, len(times), len(items)
    cols = panel.column_names(spec.items, times)
    df, coding = T.coded_items(df, spec.blocks, spec.items, times)
    df = panel.drop_empty(df, cols).where(F.col(f"`{group}`").isNotNull())
    names = sorted(r[0] for r in df.select(F.col(f"`{group}`")).distinct().limit(max_groups + 1).collect())
    if not names:
        raise ValueError("no row with an observed item and a group")
    if len(names) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    number = (F.array_position(F.array(*(F.lit(v) for v in names)), F.col(f"`{group}`")) - 1).cast("double")
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in cols), number.alias("_group"), *([F.col(f"`{weight}`").cast("double").alias("_w")] if weight else []))
    keys, w_col, g_max, invariant = [*cols, "_group"], "_w" if weight else None, len(names), invariance == "full"
    pools = {(g, t): (0 if measurement_equal else g, 0 if invariant else t) for g in range(g_max) for t in range(t_max)}
    # the pattern table comes to the driver only where it is small; a larger one stays, and passes go over its weighted patterns
    table = P.collapse(rows, keys, w_col, names=("_weight", "_rows")).drop("_rows").persist()
    small = table.count() <= max_patterns
    if small:
        x, w = M.pattern_arrays(table.toPandas().sort_values(keys, na_position="first", ignore_index=True), keys)

        def of(chosen: list[tuple[int, int]]) -> list:
            at = [(x[:, -1] == g, t) for g, t in chosen]
            own, weights = np.concatenate([x[a, t * j : (t + 1) * j] for a, t in at]), np.concatenate([w[a] for a, _ in at])
            return [e.marginal(b, weights) for e, b in zip(M._resolved(spec, own), spec.split(own))]

        whole = of(list(pools))
        m = {p: of([c for c, q in pools.items() if q == p]) for p in set(pools.values())}
    else:  # the table stays where it is
        w_col = "_weight"
        long = panel.stack_occasions(table, spec.items, times, ["_group", w_col])
        spec.cats = _top_categories(long, spec)
        whole = M.marginals(long, spec, w_col)
        m = {p: M.marginals(long.where((F.lit(measurement_equal) | (F.col("_group") == p[0])) & (F.lit(invariant) | (F.col("occasion") == p[1] + 1))), spec, w_col) for p in set(pools.values())}
    allowed = np.ones((max(t_max - 1, 0), k, k), bool)
    for a, b in forbidden:
        allowed[:, a - 1, b - 1] = False
    if not allowed.any(axis=2).all():
        raise ValueError("a status without any allowed move")
    given = [(np.asarray(a, float), np.asarray(b, float), p) for a, b, p in starts or []]
    for i in range(0 if starts else n_init if k > 1 else 1):
        rng = np.random.default_rng([seed, i])
        mv = np.where(allowed, rng.dirichlet(np.ones(k), (max(t_max - 1, 0), k)) + np.eye(k), 0)
        one = [e.start(mm, rng) for e, mm in zip(spec.emissions(), whole)]
        given.append((rng.dirichlet(np.full(k, 5.0)), mv / np.maximum(mv.sum(axis=2, keepdims=True), EPS), one))
    states = [(np.repeat(a[None], g_max, axis=0), np.repeat(b[None], g_max, axis=0), [[p] * t_max for _ in names]) for a, b, p in given]
    sums = lambda x, w, s: _group_sums(spec, t_max, x, w, s)
    runs = [_groups_run(spec, pools, m, s, equal=equal, start_equal=start_equal, moves_equal=moves_equal, allowed=allowed, alpha=alpha, max_iter=max_iter, tol=tol) for s in states]
    if small:
        found = [passes.alone(r, lambda s: sums(x, w, s)) for r in runs]
    else:
        found = passes.together(runs, table, keys, w_col, sums, _groups_added)
    table.unpersist()
    best = max(found, key=lambda r: r["penalised"])
    first, moves, params = best["state"]
    order = np.argsort(-(np.array(best["n"]) @ first), kind="stable")
    chains = {}
    for g, name in enumerate(names):
        own = [[e.permuted(p, order) for e, p in zip(spec.emissions(), ps)] for ps in params[g]]
        chains[name] = T.Chain(spec, list(times), first[g][order], moves[g][:, order][:, :, order], own, best["ll"][g], math.nan, 0, best["n"][g], best["entropy"][g], best["converged"], [], coding)
    n_moves = int((allowed.sum(axis=2) - 1).sum())
    p = (k - 1) * (1 if start_equal else g_max) + n_moves * (1 if moves_equal else g_max) + sum(e.n_params(mm) for ms in m.values() for e, mm in zip(spec.emissions(), ms))
    if equal:
        p -= (len(m) - 1) * sum(k * len(e.items) for e in spec.emissions() if e.name == "continuous")
    ll, n = float(sum(best["ll"])), float(sum(best["n"]))
    return {"groups": chains, "loglik": ll, "n_params": p, "n": n, "converged": best["converged"], "logliks": [float(sum(r["ll"])) for r in found]} | M.information_criteria(ll, p, n, float(sum(best["entropy"])), k)


def score_groups(fit: dict, df: DataFrame, group: str, kind: str = "modal") -> DataFrame:
    """Rows with the statuses and posteriors of their group's chain; rows of other groups, or of none, have no chain and go."""
    return reduce(DataFrame.unionByName, (c.transform(df.where(F.col(f"`{group}`") == F.lit(name)), kind) for name, c in fit["groups"].items()))


# ---------------------------------------------------------------- two latent variables


def _joint_posterior(sx: M.Spec, sy: M.Spec, x: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray]:
    pi, px, py = state
    j = len(sx.items)
    lx = sum(e.loglik(b, p) for e, p, b in zip(sx.emissions(), px, sx.split(x[:, :j])))
    ly = sum(e.loglik(b, p) for e, p, b in zip(sy.emissions(), py, sy.split(x[:, j:])))
    joint = np.log(pi + EPS)[None] + lx[:, :, None] + ly[:, None, :]
    ll = logsumexp(joint.reshape(len(x), -1))
    return ll, np.exp(joint - ll[:, None, None])


def _joint_sums(sx: M.Spec, sy: M.Spec, x: np.ndarray, w: np.ndarray, state: tuple) -> dict:
    ll, post = _joint_posterior(sx, sy, x, state)
    r, j = post * w[:, None, None], len(sx.items)
    sides = [[e.stats(b, own, p) for e, p, b in zip(s.emissions(), ps, s.split(part))] for s, ps, part, own in ((sx, state[1], x[:, :j], r.sum(axis=2)), (sy, state[2], x[:, j:], r.sum(axis=1)))]
    return {"ll": float(w @ ll), "entropy": -float((r * np.log(post + EPS)).sum()), "n": r.sum(axis=0), "sides": sides}


def _joint_added(a: dict | None, b: dict) -> dict:
    return b if a is None else {n: a[n] + b[n] for n in ("ll", "entropy", "n")} | {"sides": [_pooled(u, v) for u, v in zip(a["sides"], b["sides"])]}


def _joint_products(sx: M.Spec, sy: M.Spec, x: np.ndarray, w: np.ndarray, state: tuple) -> np.ndarray:
    """Products of case scores, summed: by the cells' logits (the last cell as reference), then the measurement of x and of y."""
    _, post = _joint_posterior(sx, sy, x, state)
    j = len(sx.items)
    g = [post.reshape(len(x), -1)[:, :-1] - state[0].ravel()[:-1]]
    for s, ps, part, own in ((sx, state[1], x[:, :j], post.sum(axis=2)), (sy, state[2], x[:, j:], post.sum(axis=1))):
        g += [family_scores(e, b, p, own) for e, p, b in zip(s.emissions(), ps, s.split(part))]
    scores = np.concatenate(g, axis=1)
    return scores.T @ (scores * w[:, None])


def _once(state: tuple):
    """A run of one pass: the sums at a state."""
    s = yield state
    return {"sums": s}


def _joint_run(sx: M.Spec, sy: M.Spec, m: tuple, state: tuple, *, alpha: float, max_iter: int, tol: float):
    pi, px, py = state
    last, done = -math.inf, False
    for i in range(max_iter + 1):
        s = yield pi, px, py
        value = s["ll"] + alpha / pi.size * float(np.log(pi + EPS).sum()) + sum(float(e.log_prior(p, mm)) for sp, ps, ms in ((sx, px, m[0]), (sy, py, m[1])) for e, p, mm in zip(sp.emissions(), ps, ms))
        done = i > 0 and value - last < tol * (1 + abs(value))
        if done or i == max_iter:
            break
        last = value
        pi = s["n"] + alpha / pi.size
        pi = pi / pi.sum()
        px, py = ([e.update(b, mm, p) for e, b, mm, p in zip(sp.emissions(), own, ms, ps)] for sp, own, ms, ps in ((sx, s["sides"][0], m[0], px), (sy, s["sides"][1], m[1], py)))
    return {"state": (pi, px, py), "ll": s["ll"], "penalised": value, "entropy": s["entropy"], "n": float(s["n"].sum()), "converged": bool(done)}


def fit_two_latent(df: DataFrame, x_items: Sequence[str], y_items: Sequence[str], n_x: int, n_y: int, *, measurement_x="binary", measurement_y="binary", weight: str | None = None, n_init: int = 10, alpha: float = 1.0, max_iter: int = 1000, tol: float = 1e-8, seed: int = 1, starts: list[tuple] | None = None, max_patterns: int = 50_000) -> dict:
    """Two latent variables in one likelihood: a table of joint shares, and each variable's own items.

    Gives `joint` (n_x by n_y shares), `y_given_x`, `params` of both, and `coefficients`: the logits of y's class (the last as reference) by x's
    class (the last as reference) with standard errors from the products of all parameters' scores.  Classes are ordered by their size.
    """
    if set(x_items) & set(y_items):
        raise ValueError("an item of both variables")
    sx, sy = _spec(x_items, measurement_x, n_x, alpha), _spec(y_items, measurement_y, n_y, alpha)
    cols = [*sx.items, *sy.items]
    df, coding = T.coded_items(df, [*sx.blocks, *sy.blocks], cols, None)
    rows = panel.drop_empty(df, cols).select(*(F.col(f"`{c}`").cast("double").alias(c) for c in cols), *([F.col(f"`{weight}`").cast("double").alias("_w")] if weight else []))
    w_col = "_w" if weight else None
    table = P.collapse(rows, cols, w_col, names=("_weight", "_rows")).limit(max_patterns + 1).toPandas()
    if not len(table):
        raise ValueError("no row with an observed item")
    small = len(table) <= max_patterns
    if small:
        x, w = M.pattern_arrays(table.sort_values(cols, na_position="first", ignore_index=True), cols)
        m = tuple([e.marginal(b, w) for e, b in zip(M._resolved(s, part), s.split(part))] for s, part in ((sx, x[:, : len(sx.items)]), (sy, x[:, len(sx.items) :])))
    else:
        rows = rows.persist()
        for s in (sx, sy):
            s.cats = _top_categories(rows, s)
        m = (M.marginals(rows, sx, w_col), M.marginals(rows, sy, w_col))
    states = [(np.asarray(a, float), list(b), list(c)) for a, b, c in starts or []]
    for i in range(0 if starts else n_init if n_x * n_y > 1 else 1):
        rng = np.random.default_rng([seed, i])
        states.append((rng.dirichlet(np.full(n_x * n_y, 5.0)).reshape(n_x, n_y), *([e.start(mm, rng) for e, mm in zip(s.emissions(), ms)] for s, ms in ((sx, m[0]), (sy, m[1])))))

    def results(runs: list, sums, add) -> list[dict]:
        if small:
            return [passes.alone(r, lambda s: sums(sx, sy, x, w, s)) for r in runs]
        return passes.together(runs, rows, cols, w_col, lambda x, w, s: sums(sx, sy, x, w, s), add)

    found = results([_joint_run(sx, sy, m, s, alpha=alpha, max_iter=max_iter, tol=tol) for s in states], _joint_sums, _joint_added)
    best = max(found, key=lambda r: r["penalised"])
    pi, px, py = best["state"]
    ox, oy = np.argsort(-pi.sum(axis=1), kind="stable"), np.argsort(-pi.sum(axis=0), kind="stable")
    pi, px, py = pi[ox][:, oy], [e.permuted(p, ox) for e, p in zip(sx.emissions(), px)], [e.permuted(p, oy) for e, p in zip(sy.emissions(), py)]
    products = results([_once((pi, px, py))], _joint_products, lambda a, b: b if a is None else a + b)[0]["sums"]
    if not small:
        rows.unpersist()
    cells = pi.size - 1
    cov, logs, effects = inverse(products)[:cells, :cells], np.log(np.maximum(pi, 1e-300)), []
    for a in range(n_x - 1):
        for b in range(n_y - 1):
            by = np.zeros(pi.shape)
            by[a, b], by[a, -1], by[-1, b], by[-1, -1] = 1, -1, -1, 1
            effects.append((a + 1, b + 1, float((by * logs).sum()), math.sqrt(max(float(by.ravel()[:-1] @ cov @ by.ravel()[:-1]), 0.0))))
    coefficients = pd.DataFrame(effects, columns=["class_x", "class_y", "estimate", "se"])
    coefficients["p"] = two_sided(coefficients["estimate"] / coefficients["se"].replace(0, np.nan))
    p = cells + sum(e.n_params(mm) for s, ms in ((sx, m[0]), (sy, m[1])) for e, mm in zip(s.emissions(), ms))
    shared = {"joint": pi, "y_given_x": pi / np.maximum(pi.sum(axis=1, keepdims=True), EPS), "params": (px, py), "coefficients": coefficients, "coding": coding, "loglik": best["ll"], "n_params": p, "n": best["n"], "converged": best["converged"], "logliks": [r["ll"] for r in found]}
    return shared | M.information_criteria(best["ll"], p, best["n"], best["entropy"], pi.size)
