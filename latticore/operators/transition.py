"""Latent transition models: hidden Markov chains over a panel's occasions, and repeated-measures classes.

Rows collapse to patterns of items over all occasions; forward-backward, Viterbi and Baum-Welch run vectorised over the pattern
table, a task for each random start.  Decoding rows is an Arrow pass (one row is one chain), on batch and streams alike.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, logsumexp
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators.emissions import Params
from latticore.plans import patterns as P
from latticore.sources import panel


def forward_backward(log_b: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log_b: n x T x K emission log-densities; moves: (T - 1) x K x K.  Gives loglik, gamma (n x T x K), xi (n x T-1 x K x K).

    Probabilities are scaled at each step; emissions enter relative to their greatest, so nothing underflows.
    """
    n, t_max, k = log_b.shape
    top = log_b.max(axis=2, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    b = np.exp(log_b - top)
    alpha, scale = np.empty_like(b), np.empty((n, t_max))
    for t in range(t_max):
        a = b[:, t] * (start if t == 0 else alpha[:, t - 1] @ moves[t - 1])
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / np.maximum(scale[:, t], 1e-300)[:, None]
    beta = np.ones_like(b)
    xi = np.zeros((n, max(t_max - 1, 0), k, k))
    for t in range(t_max - 2, -1, -1):
        ahead = b[:, t + 1] * beta[:, t + 1] / np.maximum(scale[:, t + 1], 1e-300)[:, None]
        xi[:, t] = alpha[:, t, :, None] * moves[t][None] * ahead[:, None, :]
        beta[:, t] = ahead @ moves[t].T
    gamma = alpha * beta
    return (np.log(np.maximum(scale, 1e-300)) + top[:, :, 0]).sum(axis=1), gamma, xi


def viterbi(log_b: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest path of each row (n x T, states from 0; ties to the first)."""
    n, t_max, k = log_b.shape
    with np.errstate(divide="ignore"):
        best, lm = np.log(start) + log_b[:, 0], np.log(moves)
    back = np.zeros((n, t_max, k), int)
    for t in range(1, t_max):
        score = best[:, :, None] + lm[t - 1][None]
        back[:, t] = score.argmax(axis=1)
        best = score.max(axis=1) + log_b[:, t]
    path = np.zeros((n, t_max), int)
    path[:, -1] = best.argmax(axis=1)
    for t in range(t_max - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t][:, None], axis=1)[:, 0]
    return path


@dataclass
class Chain:
    """A fitted chain: starting and moving probabilities and each occasion's (or the shared) measurement."""

    spec: M.Spec  # of one occasion's items, k statuses
    times: list
    start: np.ndarray
    moves: np.ndarray  # (T - 1) x K x K
    params: list[list[Params]]  # one list for each occasion (the same object where invariant)
    loglik: float
    penalised: float
    n_params: int
    n: float
    entropy: float
    converged: bool
    logliks: list[float] = field(default_factory=list)
    coding: dict[str, tuple] = field(default_factory=dict)  # (low, high) of columns of binary items that are not 0 and 1

    def coded(self, df: DataFrame) -> DataFrame:
        """df with the items as the fit has them: binary ones as 0 and 1."""
        return panel.coded(df, self.coding)

    @property
    def columns(self) -> list[str]:
        return panel.column_names(self.spec.items, self.times)

    def metrics(self) -> dict[str, float]:
        return M.information_criteria(self.loglik, self.n_params, self.n, self.entropy, self.spec.k)

    def log_b(self, x: np.ndarray) -> np.ndarray:
        return _emissions(self.spec, self.params, x, len(self.times))

    def prevalences(self) -> np.ndarray:
        """Model-implied status shares, T x K."""
        out = [self.start]
        for m in self.moves:
            out.append(out[-1] @ m)
        return np.array(out)

    def transition_matrix(self, spark) -> DataFrame:
        rows = [(t + 1, a + 1, b + 1, float(self.moves[t, a, b])) for t in range(len(self.moves)) for a in range(self.spec.k) for b in range(self.spec.k)]
        return spark.createDataFrame(rows, "occasion int, from_status int, to_status int, probability double")

    def transform(self, df: DataFrame, kind: str = "modal") -> DataFrame:
        """df with statuses (array over occasions): modal posterior, or viterbi; and posteriors (array of arrays) and loglik."""
        chain, cols = self, [f"_item_{i}" for i in range(len(self.columns))]
        coded = panel.coded(df.withColumns({n: F.col(f"`{c}`") for n, c in zip(cols, self.columns)}), {n: self.coding[c] for n, c in zip(cols, self.columns) if c in self.coding})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                lb = chain.log_b(f[cols].to_numpy(float, na_value=np.nan))
                f = f.drop(columns=cols)
                ll, gamma, _ = forward_backward(lb, chain.start, chain.moves)
                path = viterbi(lb, chain.start, chain.moves) if kind == "viterbi" else gamma.argmax(axis=2)
                yield f.assign(statuses=list(path + 1), posteriors=[list(map(list, g)) for g in gamma], loglik=ll)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return coded.mapInPandas(run, fields + ", statuses array<int>, posteriors array<array<double>>, loglik double")

    def transition_patterns(self, spark, kind: str = "model", df: DataFrame | None = None) -> DataFrame:
        """status_1..status_T, count, proportion of every path (refused over 10000 paths)."""
        k, t = self.spec.k, len(self.times)
        if k**t > 10_000:
            raise ValueError("more than 10000 paths")
        paths = list(itertools.product(range(k), repeat=t))
        if kind == "model":
            p = np.array([self.start[q[0]] * math.prod(self.moves[i, q[i], q[i + 1]] for i in range(t - 1)) for q in paths])
        else:
            found = self.transform(df).groupBy("statuses").count().collect()
            by = {tuple(r.statuses): r["count"] for r in found}
            p = np.array([by.get(tuple(s + 1 for s in q), 0) for q in paths], float)
            p /= max(p.sum(), 1.0)
        cols = ", ".join(f"status_{i + 1} int" for i in range(t))
        return spark.createDataFrame([(*(s + 1 for s in q), float(v * self.n), float(v)) for q, v in zip(paths, p)], cols + ", count double, proportion double")


def _emissions(spec: M.Spec, params: list[list[Params]], x: np.ndarray, t_max: int) -> np.ndarray:
    j = len(spec.items)
    out = np.zeros((len(x), t_max, spec.k))
    for t in range(t_max):
        for e, p, b in zip(spec.emissions(), params[t], spec.split(x[:, t * j : (t + 1) * j])):
            out[:, t] += e.loglik(b, p)
    return out


def _chain_sums(spec: M.Spec, t_max: int, x: np.ndarray, w: np.ndarray, state: tuple) -> dict:
    """One pass over rows: log-likelihood, expected starts and moves, each occasion's statistics, entropy and weight."""
    start, moves, params = state
    j = len(spec.items)
    ll, gamma, xi = forward_backward(_emissions(spec, params, x, t_max), start, moves)
    stats = [[e.stats(b, gamma[:, t] * w[:, None], p) for e, b, p in zip(spec.emissions(), spec.split(x[:, t * j : (t + 1) * j]), params[t])] for t in range(t_max)]
    return {"ll": float(w @ ll), "start": (gamma[:, 0] * w[:, None]).sum(axis=0), "moves": np.einsum("n,ntab->tab", w, xi), "stats": stats, "entropy": -float((w[:, None, None] * gamma * np.log(gamma + EPS)).sum()) / t_max, "n": float(w.sum())}


def _added(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("ll", "start", "moves", "entropy", "n")}
    return out | {"stats": [M._add({"ll": 0, "entropy": 0, "n": 0, "blocks": s}, {"ll": 0, "entropy": 0, "n": 0, "blocks": t})["blocks"] for s, t in zip(a["stats"], b["stats"])]}


def _chain_run(spec: M.Spec, t_max: int, m, state, *, invariant: bool, same_moves: bool, allowed: np.ndarray, alpha: float, max_iter: int, tol: float):
    """EM as a run (see passes): it is sent the sums of _chain_sums."""
    start, moves, params = state
    k, last, done = spec.k, -math.inf, False
    for i in range(max_iter + 1):
        s = yield start, moves, params
        prior = alpha / k * np.log(start + EPS).sum() + sum((alpha / (k * allowed[t].sum(axis=1, keepdims=True)) * np.where(allowed[t], np.log(moves[t] + EPS), 0)).sum() for t in range(1 if same_moves else t_max - 1)) + sum(e.log_prior(p, mm) for t in range(1 if invariant else t_max) for e, p, mm in zip(spec.emissions(), params[t], m[t]))
        value = s["ll"] + float(prior)
        done = i > 0 and value - last < tol * (1 + abs(value))
        if done or i == max_iter:
            break
        last = value
        first = s["start"] + alpha / k
        start = first / first.sum()
        counts = s["moves"]
        if same_moves and len(counts):
            counts = np.repeat(counts.sum(axis=0, keepdims=True), len(counts), axis=0)
        counts = np.where(allowed, counts + alpha / (k * np.maximum(allowed.sum(axis=2, keepdims=True), 1)), 0.0)
        moves = counts / np.maximum(counts.sum(axis=2, keepdims=True), EPS)
        stats = s["stats"]
        if invariant:
            total = stats[0]
            for more in stats[1:]:
                total = M._add({"ll": 0, "entropy": 0, "n": 0, "blocks": total}, {"ll": 0, "entropy": 0, "n": 0, "blocks": more})["blocks"]
            one = [e.update(b, mm, p) for e, b, mm, p in zip(spec.emissions(), total, m[0], params[0])]
            params = [one] * t_max
        else:
            params = [[e.update(b, mm, p) for e, b, mm, p in zip(spec.emissions(), stats[t], m[t], params[t])] for t in range(t_max)]
    return {"start": start, "moves": moves, "params": params, "ll": s["ll"], "penalised": value, "entropy": s["entropy"], "n": s["n"], "converged": bool(done)}


def coded_items(df: DataFrame, blocks: Sequence[tuple], items: Sequence[str], times: Sequence | None) -> tuple[DataFrame, dict[str, tuple]]:
    """df with binary items as 0 and 1, and their coding by column; counts and categories are checked.  An item's occasions share its coding."""
    cols = panel.column_names(items, times) if times is not None else list(items)
    of = {c: [cols[t * len(items) + i] for t in range(len(cols) // len(items))] for i, c in enumerate(items)}
    binary = {c: of[c] for f, own in blocks if f == "binary" for c in own}
    coding: dict[str, tuple] = {}
    if binary:
        df, found = panel.recode_binary(df, [], binary)
        coding = panel.columns_coding(found, binary)
    for check, kinds in ((panel.check_counts, ("count", "zip", "negbin")), (panel.check_categories, ("categorical", "ordinal"))):
        own = [c for f, named in blocks if f in kinds for i in named for c in of[i]]
        if own:
            check(df, own)
    return df, coding


def fit_lta(df: DataFrame, items: Sequence[str], times: Sequence, n_statuses: int = 2, *, measurement="binary", invariance: str = "full", transition_invariance: str = "none", forbidden: Sequence[tuple[int, int]] = (), weight: str | None = None, n_init: int = 20, alpha: float = 1.0, max_iter: int = 1000, tol: float = 1e-8, seed: int = 1, starts: list[tuple] | None = None, max_patterns: int = 100_000) -> Chain:
    """A hidden Markov model of columns item@time; `forbidden` are moves (from, to) that never happen.

    `starts`, (starting shares, moves, parameters of each block), are used in place of `n_init` random ones.  `max_patterns` only says where the
    table is fitted.
    """
    blocks = panel.normalize_measurement(items, measurement)
    blocks = [(f + ":class" if f == "continuous" else f, c) for f, c in blocks]
    spec = M.Spec(blocks, n_statuses, {n: alpha for n in ("latent", "categorical", "poisson", "variances")})
    cols, k, t_max = panel.column_names(spec.items, times), n_statuses, len(times)
    df, coding = coded_items(df, blocks, spec.items, times)
    df = panel.drop_empty(df, cols)
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in cols), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    full = P.collapse(rows, cols, "_w" if weight else None, names=("_weight", "_rows")).drop("_rows").persist()
    table = full.limit(max_patterns + 1).toPandas()
    if not len(table):
        raise ValueError("no row with an observed item")
    invariant, small = invariance == "full", len(table) <= max_patterns
    j = len(spec.items)
    if small:
        table = table.sort_values(cols, na_position="first", ignore_index=True)
        x, w = M.pattern_arrays(table, cols)
        stacked = np.concatenate([x[:, t * j : (t + 1) * j] for t in range(t_max)])
        M._resolved(spec, stacked)
        whole = [e.marginal(b, np.tile(w, t_max)) for e, b in zip(spec.emissions(), spec.split(stacked))]
        m = [whole if invariant else [e.marginal(b, w) for e, b in zip(spec.emissions(), spec.split(x[:, t * j : (t + 1) * j]))] for t in range(t_max)]
    else:  # the table stays where it is
        long = panel.stack_occasions(full, spec.items, times, ["_weight"])
        named = [c for f, own in spec.blocks if f in ("categorical", "ordinal") for c in own]
        spec.cats = {c: int(v) for c, v in long.agg(*(F.max(f"`{c}`").alias(c) for c in named)).first().asDict().items()} if named else {}
        whole = M.marginals(long, spec, "_weight")
        m = [whole if invariant else M.marginals(long.where(F.col("occasion") == t + 1), spec, "_weight") for t in range(t_max)]
    allowed = np.ones((max(t_max - 1, 0), k, k), bool)
    for a, b in forbidden:
        allowed[:, a - 1, b - 1] = False
    if not allowed.any(axis=2).all():
        raise ValueError("a status without any allowed move")
    states = [(np.asarray(a, float), np.asarray(b, float), [p] * t_max) for a, b, p in starts or []]
    for i in range(0 if starts else n_init if k > 1 else 1):
        rng = np.random.default_rng([seed, i])
        mv = np.where(allowed, rng.dirichlet(np.ones(k), (max(t_max - 1, 0), k)) + np.eye(k), 0)
        if transition_invariance == "full" and len(mv):
            mv = np.repeat(mv[:1], len(mv), axis=0)
        one = [e.start(mm, rng) for e, mm in zip(spec.emissions(), whole)]
        states.append((rng.dirichlet(np.full(k, 5.0)), mv / np.maximum(mv.sum(axis=2, keepdims=True), EPS), [one] * t_max if invariant else [one] + [[{n: v.copy() for n, v in p.items()} for p in one] for _ in range(t_max - 1)]))
    how = {"invariant": invariant, "same_moves": transition_invariance == "full", "allowed": allowed, "alpha": alpha, "max_iter": max_iter, "tol": tol}
    if not small:
        runs = passes.together([_chain_run(spec, t_max, m, s, **how) for s in states], full, cols, "_weight", lambda x, w, s: _chain_sums(spec, t_max, x, w, s), _added)
    elif len(states) == 1 or len(w) * t_max * len(states) < 2000:
        runs = [passes.alone(_chain_run(spec, t_max, m, s, **how), lambda s: _chain_sums(spec, t_max, x, w, s)) for s in states]
    else:
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast((spec, t_max, x, w, m, states, how))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            spec, t_max, x, w, m, states, how = shared.value
            for f in frames:
                yield pd.DataFrame({"start": f["start"], "run": [pickle.dumps(passes.alone(_chain_run(spec, t_max, m, states[i], **how), lambda s: _chain_sums(spec, t_max, x, w, s))) for i in f["start"]]})

        ids = spark.createDataFrame([(i,) for i in range(len(states))], "start int").repartition(len(states), "start")
        runs = [pickle.loads(r.run) for r in ids.mapInPandas(run, "start int, run binary").orderBy("start").collect()]
    full.unpersist()
    best = max(runs, key=lambda r: r["penalised"])
    order = np.argsort(-best["start"], kind="stable")
    moves = best["moves"][:, order][:, :, order] if t_max > 1 else best["moves"]
    params = [[e.permuted(p, order) for e, p in zip(spec.emissions(), ps)] for ps in best["params"]]
    per = sum(e.n_params(mm) for e, mm in zip(spec.emissions(), whole))
    n_moves = int((allowed.sum(axis=2) - 1).sum()) // (max(t_max - 1, 1) if transition_invariance == "full" else 1)
    return Chain(spec, list(times), best["start"][order], moves, params, best["ll"], best["penalised"], k - 1 + n_moves + per * (1 if invariant else t_max), best["n"], best["entropy"], best["converged"], [r["ll"] for r in runs], coding)


def fit_rmlca(df: DataFrame, items: Sequence[str], times: Sequence, n_classes: int = 2, *, measurement: str = "binary", **how) -> M.Fit:
    """One class over all occasions, with each occasion's own probabilities; an item's occasions share one coding."""
    cols = panel.column_names(items, times)
    return M.fit_mixture(df, cols, n_classes, measurement, same_coding={c: [x for x in cols if x in panel.column_names([c], times)] for c in items}, **how)


def fit_joint_classes(df: DataFrame, x_items: Sequence[str], y_items: Sequence[str], n_x: int, n_y: int, **how) -> dict:
    """Two latent variables: a model for each set of items, linked by the classification errors of both.

    The input is aggregated once, to the patterns of all items; fits, errors and the link are of these.
    """
    from latticore.operators import structural as S

    table = P.collapse(df, list(dict.fromkeys([*x_items, *y_items])), names=("_weight", "_rows")).drop("_rows").persist()
    source, given = (df, how) if how.get("weight") else (table, how | {"weight": "_weight", "weight_type": "frequency"})
    fx, fy = (replace(M.fit_mixture(source, c, n, "binary", **given), weight=how.get("weight")) for c, n in ((x_items, n_x), (y_items, n_y)))
    scored = fy.transform(fx.transform(table).withColumnsRenamed({"class": "class_x", "probability": "probability_x", "loglik": "loglik_x", "posterior": "posterior_x"}))
    ex = S.classification_error(scored.select("_weight", F.col("posterior_x").alias("posterior"), F.col("class_x").alias("class")), n_x, weight="_weight")
    ey = S.classification_error(scored, n_y, weight="_weight")
    out = S.link_models(scored, "class_x", "class", ex, ey, weight="_weight") | {"x": fx, "y": fy}
    table.unpersist()
    return out


def chain_loglik(chain: Chain, x: np.ndarray) -> np.ndarray:
    return forward_backward(chain.log_b(x), chain.start, chain.moves)[0]


def path_enumeration(log_b: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-likelihoods by summing all paths: for checking small cases."""
    n, t_max, k = log_b.shape
    parts = []
    for q in itertools.product(range(k), repeat=t_max):
        with np.errstate(divide="ignore"):
            v = np.log(start[q[0]]) + sum(np.log(moves[t, q[t], q[t + 1]]) for t in range(t_max - 1))
        parts.append(v + sum(log_b[:, t, q[t]] for t in range(t_max)))
    return logsumexp(np.stack(parts, axis=1))


def transition_counts(chain: Chain, df: DataFrame, weight: str | None = None) -> DataFrame:
    """occasion, from_status, to_status, count: expected moves, summed in each partition and then across."""
    cols, k, t_max = chain.columns, chain.spec.k, len(chain.times)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((t_max - 1, k, k))
        for f in frames:
            if len(f):
                w = f[weight].to_numpy(float) if weight else np.ones(len(f))
                xi = forward_backward(chain.log_b(f[cols].to_numpy(float, na_value=np.nan)), chain.start, chain.moves)[2]
                total += np.einsum("n,ntab->tab", w, xi)
        t, a, b = np.indices(total.shape)
        yield pd.DataFrame({"occasion": t.ravel() + 1, "from_status": a.ravel() + 1, "to_status": b.ravel() + 1, "count": total.ravel()})

    part = chain.coded(df).select(*(F.col(f"`{c}`") for c in cols), *([weight] if weight else [])).mapInPandas(run, "occasion int, from_status int, to_status int, count double")
    return part.groupBy("occasion", "from_status", "to_status").agg(F.sum("count").alias("count"))


def status_prevalences(chain: Chain, scored: DataFrame) -> DataFrame:
    """occasion, status, model (implied) and posterior (mean) shares."""
    k, t_max, p = chain.spec.k, len(chain.times), chain.prevalences()
    by = scored.agg(*(F.avg(F.col("posteriors")[t][c]).alias(f"g{t}_{c}") for t in range(t_max) for c in range(k)))
    rows = [F.struct(F.lit(t + 1).alias("occasion"), F.lit(c + 1).alias("status"), F.lit(float(p[t, c])).alias("model"), F.col(f"g{t}_{c}").alias("posterior")) for t in range(t_max) for c in range(k)]
    return by.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_parameters(spec: M.Spec, times, start, moves, params) -> Chain:
    """A chain of given parameters, the same measurement at each occasion."""
    return Chain(spec, list(times), np.asarray(start, float), np.asarray(moves, float), [params] * len(times), math.nan, math.nan, 0, math.nan, math.nan, True)
