"""Direct effects: categorical items that depend on covariates within classes, by cumulative logits, with class shares that depend on them too.

logit P(x > c) = threshold_kc + slopes_k . z, so the thresholds of a class fall in c; a binary item has one.  Items without effects keep free
shares in each class.  Rows collapse to patterns of items and covariates and stay in Spark.  One pass a round gives the expected counts
of the free items and, of class shares and items with effects, gradient and Fisher information of the expected log-likelihood at the present
parameters: a scoring step each (generalised EM), taken back by halves where the likelihood would fall.  Standard errors are those of the cases' scores.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, expit, inverse, logsumexp, softmax, two_sided
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import transition as T
from latticore.plans import patterns as P
from latticore.sources import panel


@dataclass
class Design:
    """Items with their categories, which covariates (by number) act on which items, and which on the classes."""

    items: list[str]
    cats: list[int]
    covariates: list[str]
    k: int
    effects: dict[int, list[int]]
    by_class: bool
    predictors: list[int]
    binary: bool

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes from 1 (0: missing), and covariates."""
        codes = x[:, : len(self.items)] + (1 if self.binary else 0)
        return np.where(np.isnan(codes), 0, codes).astype(int), x[:, len(self.items) :]

    def classes(self, z: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(z)), z[:, self.predictors]])

    def width(self, j: int) -> int:
        """Parameters of an item with effects."""
        d = len(self.effects[j])
        return self.k * (self.cats[j] - 1) + (self.k * d if self.by_class else d)


def cumulative(theta: np.ndarray, k: int, c: int, d: int, by_class: bool) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (K x C - 1) and slopes (K x d) of packed parameters."""
    n = k * (c - 1)
    return theta[:n].reshape(k, c - 1), theta[n:].reshape(k, d) if by_class else np.repeat(theta[n:][None], k, axis=0)


def category_shares(tau: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(x = c) of each row (n x C) in one class, and its derivatives by the cumulative logits (n x C x C - 1)."""
    up = expit(np.clip(tau[None] + eta[:, None], -35, 35))  # P(x > c)
    edge = np.ones((len(eta), 1))
    p = np.hstack([edge, up]) - np.hstack([up, 0 * edge])
    f = up * (1 - up)
    c = tau.shape[0]
    d = np.zeros((len(eta), c + 1, c))
    at = np.arange(c)
    d[:, at, at] = -f
    d[:, at + 1, at] = f
    return np.maximum(p, 1e-300), d


def _pass(design: Design, x: np.ndarray, w: np.ndarray, state: dict) -> dict:
    """Sums over rows at a state: log-likelihood, counts, and gradient, information and squared scores."""
    codes, z = design.split(x)
    k, zc = design.k, design.classes(z)
    share = softmax(np.column_stack([zc @ state["gamma"].T, np.zeros(len(z))]))
    joint, parts = np.log(share + EPS), {}
    for j, c in enumerate(design.cats):
        seen = codes[:, j] > 0
        at = np.maximum(codes[:, j] - 1, 0)
        if j not in design.effects:
            joint = joint + np.where(seen[:, None], np.log(np.maximum(state["free"][j][:, at].T, EPS)), 0.0)
            continue
        tau, slope = cumulative(state["own"][j], k, c, len(design.effects[j]), design.by_class)
        zj = z[:, design.effects[j]]
        parts[j] = [category_shares(tau[a], zj @ slope[a]) for a in range(k)]
        joint = joint + np.stack([np.where(seen, np.log(p[np.arange(len(z)), at]), 0.0) for p, _ in parts[j]], axis=1)
    ll = logsumexp(joint)
    post = np.exp(joint - ll[:, None])
    r = post * w[:, None]
    out = {"ll": float(w @ ll), "n": float(w.sum()), "entropy": float(-(r * np.log(post + EPS)).sum())}
    scores = [((post - share)[:, :-1, None] * zc[:, None, :]).reshape(len(z), -1)]
    out["g:class"] = w @ scores[0]
    inner = np.einsum("n,na,ab->nab", w, share, np.eye(k)) - np.einsum("n,na,nb->nab", w, share, share)
    size = scores[0].shape[1]
    out["i:class"] = np.einsum("nab,ni,nj->aibj", inner[:, :-1, :-1], zc, zc, optimize=True).reshape(size, size)
    for j, c in enumerate(design.cats):
        seen = codes[:, j] > 0
        hot = np.where(seen[:, None], codes[:, j : j + 1] == np.arange(1, c + 1), False)
        if j not in design.effects:
            out[f"c:{j}"] = r.T @ hot
            scores.append(np.concatenate([post[:, a : a + 1] * np.where(seen[:, None], hot[:, :-1] - state["free"][j][a, :-1], 0.0) for a in range(k)], axis=1))
            continue
        zj, d = z[:, design.effects[j]], len(design.effects[j])
        own, info = np.zeros((len(z), design.width(j))), np.zeros((design.width(j),) * 2)
        for a, (p, deriv) in enumerate(parts[j]):
            # from cumulative logits to thresholds and slopes
            jac = np.zeros((len(z), c - 1, design.width(j)))
            jac[:, np.arange(c - 1), a * (c - 1) + np.arange(c - 1)] = 1.0
            first = k * (c - 1) + (a * d if design.by_class else 0)
            jac[:, :, first : first + d] = zj[:, None, :]
            by = np.einsum("ncs,nsp->ncp", deriv, jac)
            own += (post[:, a] * seen)[:, None] * np.einsum("nc,ncp->np", hot / p, by)
            info += np.einsum("nc,ncp,ncq->pq", (r[:, a] * seen)[:, None] / p, by, by, optimize=True)
        out[f"g:{j}"], out[f"i:{j}"] = w @ own, info
        scores.append(own)
    every = np.concatenate(scores, axis=1)
    return out | {"outer": every.T @ (every * w[:, None])}


def _added(a: dict | None, b: dict) -> dict:
    return b if a is None else {k: a[k] + b[k] for k in b}


def _run(design: Design, state: dict, marginal: dict[int, np.ndarray], alpha: float, max_iter: int, tol: float):
    """Generalised EM as a run (see passes)."""
    k = design.k

    def prior(s):
        return sum(float((alpha / k * marginal[j] * np.log(np.maximum(p, EPS))).sum()) for j, p in s["free"].items())

    def moved(s, sums, share):
        """A step from s: free items at once, the others by `share` of a scoring step."""
        step = lambda g, i: np.clip(inverse(i + 1e-9 * np.trace(i) / max(len(i), 1) * np.eye(len(i)) + 1e-12 * np.eye(len(i))) @ g, -2, 2) * share
        free = {j: (sums[f"c:{j}"] + alpha / k * marginal[j]) / (sums[f"c:{j}"].sum(axis=1, keepdims=True) + alpha / k * marginal[j].sum() + EPS) for j in s["free"]}
        own = {}
        for j, theta in s["own"].items():
            new = theta + step(sums[f"g:{j}"], sums[f"i:{j}"])
            while not _falling(design, j, new):
                new = theta + (new - theta) / 2
            own[j] = new
        return {"gamma": s["gamma"] + step(sums["g:class"], sums["i:class"]).reshape(s["gamma"].shape), "free": free, "own": own}

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


def _falling(design: Design, j: int, theta: np.ndarray) -> bool:
    tau = theta[: design.k * (design.cats[j] - 1)].reshape(design.k, -1)
    return bool((np.diff(tau, axis=1) < 0).all())


@dataclass
class DirectFit:
    """Parameters, their covariance (from the cases' scores), and scoring."""

    design: Design
    gamma: np.ndarray  # K - 1 x (1 + predictors): logits against the last class
    shares: dict[str, np.ndarray]  # of items without effects: K x C
    thresholds: dict[str, np.ndarray]  # of items with effects: K x C - 1
    slopes: dict[str, np.ndarray]  # K x covariates of the item
    estimates: pd.DataFrame
    vcov: np.ndarray
    loglik: float
    penalised: float
    n_params: int
    n: float
    entropy: float
    iterations: int
    converged: bool
    logliks: list[float] = field(default_factory=list)
    coding: dict[str, tuple] = field(default_factory=dict)

    def metrics(self) -> dict[str, float]:
        return M.information_criteria(self.loglik, self.n_params, self.n, self.entropy, self.design.k)

    def log_densities(self) -> list[Column]:
        """log share_k + log f_k of each class as columns of coded items and covariates."""
        d = self.design
        z = [F.col(f"`{c}`").cast("double") for c in d.covariates]
        linear = [sum((float(g[1 + i]) * z[p] for i, p in enumerate(d.predictors)), F.lit(float(g[0]))) for g in self.gamma] + [F.lit(0.0)]
        top = F.greatest(*linear) if len(linear) > 1 else linear[0]
        norm = top + F.log(sum((F.exp(v - top) for v in linear), F.lit(0.0)))
        out = [v - norm for v in linear]
        for j, item in enumerate(d.items):
            code = F.col(f"`{item}`").cast("int") + (1 if d.binary else 0)
            for k in range(d.k):
                if j not in d.effects:
                    logs = [F.lit(float(math.log(max(p, EPS)))) for p in self.shares[item][k]]
                else:
                    eta = sum((float(b) * z[p] for b, p in zip(self.slopes[item][k], d.effects[j])), F.lit(0.0))
                    up = [F.lit(1.0), *(1 / (1 + F.exp(-(eta + float(t)))) for t in self.thresholds[item][k]), F.lit(0.0)]
                    logs = [F.log(F.greatest(a - b, F.lit(1e-300))) for a, b in zip(up, up[1:])]
                out[k] = out[k] + F.when(code.isNotNull(), F.element_at(F.array(*logs), code)).otherwise(0.0)
        return out

    def transform(self, df: DataFrame, posterior: str = "posterior") -> DataFrame:
        """df with posterior, class, probability and loglik, by DataFrame functions; a row without an observed item or with a null covariate has nulls."""
        d, kept = self.design, {f"_as_is_{i}": F.col(f"`{c}`") for i, c in enumerate(self.coding)}
        rows = panel.coded(df.withColumns(kept), self.coding) if kept else df
        seen = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in d.items)).isNotNull()
        for c in d.covariates:
            seen = seen & F.col(f"`{c}`").isNotNull()
        out = rows.withColumn("_log", F.when(seen, F.array(*self.log_densities()))).withColumn("_top", F.array_max("_log"))
        out = out.withColumn("_sum", F.aggregate("_log", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top"))))
        out = out.withColumn(posterior, F.transform("_log", lambda v: F.exp(v - F.col("_top")) / F.col("_sum")))
        out = out.withColumns({"loglik": F.col("_top") + F.log("_sum"), "class": F.array_position(F.col(posterior), F.array_max(posterior)).cast("int"), "probability": F.array_max(posterior)}).drop("_log", "_top", "_sum")
        return out.withColumns({c: F.col(n) for n, c in zip(kept, self.coding)}).drop(*kept) if kept else out


def fit_direct_effects(
    df: DataFrame, items: Sequence[str], covariates: Sequence[str], n_classes: int, *, effects: Mapping[str, Sequence[str]], measurement: str = "ordinal", by_class: bool = False, predictors: Sequence[str] | None = None,
    weight: str | None = None, n_init: int = 10, seed: int = 1, max_iter: int = 500, tol: float = 1e-9, alpha: float = 1.0, starts: list[tuple[np.ndarray, list[dict]]] | None = None,
) -> DirectFit:
    """Classes of ordinal (or binary) items of which those of `effects` depend on covariates within classes, with one slope or (`by_class`) one in each class.

    `predictors` (default: all covariates) act on class membership.  The start is a model without covariates of `n_init` random starts; or each of `starts`
    (class shares, [{"p": probabilities}]) is followed, all in the same passes.  Rows with a null covariate go.  Items with effects have no prior.
    """
    if measurement not in ("ordinal", "binary"):
        raise ValueError("direct effects are on ordinal or binary items")
    items, covariates = list(items), list(covariates)
    strange = [c for c in effects if c not in items] + [c for own in effects.values() for c in own if c not in covariates] + [c for c in predictors or () if c not in covariates]
    if strange or not all(effects.values()):
        raise ValueError("effects name an item or covariate that is not there, or none: " + ", ".join(strange))
    # the input is aggregated once; checks and codings are of its patterns
    number = lambda c: F.col(f"`{c}`").cast("double").alias(c)
    rows = panel.drop_empty(df.dropna(subset=[f"`{c}`" for c in covariates]), items).select(*(F.col(f"`{c}`") if measurement == "binary" else number(c) for c in items), *map(number, covariates), *([F.col(f"`{weight}`").cast("double").alias("_in")] if weight else []))
    held = P.collapse(rows, [*items, *covariates], "_in" if weight else None, names=("_w", "_rows")).persist()
    table, coding = T.coded_items(held, [(measurement, items)], items, None)
    table = table.select(*map(number, [*items, *covariates]), "_w", "_rows")
    if not starts:
        base = M.fit_mixture(table.drop("_rows"), items, n_classes, measurement, weight="_w", weight_type="frequency", n_init=n_init, seed=seed)
        starts = [(base.pi, base.params)]
    cats = [2] * len(items) if measurement == "binary" else [int(v) for v in table.agg(*(F.max(f"`{c}`").alias(c) for c in items)).first()]
    design = Design(
        items, cats, covariates, n_classes, {items.index(c): [covariates.index(v) for v in own] for c, own in effects.items()}, by_class,
        [covariates.index(c) for c in (covariates if predictors is None else predictors)] if n_classes > 1 else [], measurement == "binary",
    )
    free_items = [j for j in range(len(items)) if j not in design.effects]
    counts = table.agg(*(F.sum(F.when(F.col(f"`{items[j]}`") == v + (0 if design.binary else 1), F.col("_w")).otherwise(0.0)).alias(f"{j}_{v}") for j in free_items for v in range(cats[j])), F.count(F.lit(1))).first()
    marginal = {j: np.array([counts[f"{j}_{v}"] or 0.0 for v in range(cats[j])]) for j in free_items}
    marginal = {j: v / max(v.sum(), EPS) for j, v in marginal.items()}

    def opened(pi, params):
        p = params[0]["p"]
        full = np.stack([1 - p, p], axis=2) if design.binary else p
        pi = np.asarray(pi, float)
        gamma = np.zeros((n_classes - 1, 1 + len(design.predictors)))
        gamma[:, 0] = np.log(pi[:-1] + EPS) - np.log(pi[-1] + EPS)
        own = {}
        for j in design.effects:
            q = np.maximum(full[:, j, : cats[j]], 1e-4)
            up = (q / q.sum(axis=1, keepdims=True))[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
            own[j] = np.concatenate([(np.log(up) - np.log1p(-up)).ravel(), np.zeros(design.width(j) - n_classes * (cats[j] - 1))])
        return {"gamma": gamma, "free": {j: full[:, j, : cats[j]] for j in free_items}, "own": own}

    runs = [_run(design, opened(*s), marginal, alpha, max_iter, tol) for s in starts]
    found = passes.together(runs, table, [*items, *covariates], "_w", lambda x, w, s: _pass(design, x, w, s), _added)
    held.unpersist()
    return _result(design, max(found, key=lambda r: r["penalised"]), [r["sums"]["ll"] for r in found], coding)


def _result(design: Design, r: dict, logliks: list[float], coding: dict) -> DirectFit:
    s, sums, k = r["state"], r["sums"], design.k
    v = inverse(sums["outer"])
    se = np.sqrt(np.maximum(np.diag(v), 0))
    terms = ["(intercept)", *(design.covariates[p] for p in design.predictors)]
    rows = [("class", None, str(a + 1), t, s["gamma"][a, i]) for a in range(k - 1) for i, t in enumerate(terms)]
    for j, c in enumerate(design.cats):
        name = design.items[j]
        if j not in design.effects:
            p = np.maximum(s["free"][j], EPS)
            rows += [("item", name, str(a + 1), f"log odds {v + 1}", math.log(p[a, v] / p[a, -1])) for a in range(k) for v in range(c - 1)]
            continue
        theta, d = s["own"][j], design.effects[j]
        rows += [("threshold", name, str(a + 1), f"> {v + (0 if design.binary else 1)}", theta[a * (c - 1) + v]) for a in range(k) for v in range(c - 1)]
        n = k * (c - 1)
        rows += [("effect", name, str(a + 1) if design.by_class else "all", design.covariates[p], theta[n + a * len(d) + i]) for a in range(k if design.by_class else 1) for i, p in enumerate(d)]
    est = pd.DataFrame(rows, columns=["part", "item", "class", "term", "estimate"]).assign(se=se)
    with np.errstate(divide="ignore", invalid="ignore"):
        est["z"] = est["estimate"] / est["se"]
    est["p"] = two_sided(np.nan_to_num(est["z"]))
    own = {j: cumulative(t, k, design.cats[j], len(design.effects[j]), design.by_class) for j, t in s["own"].items()}
    name = design.items
    return DirectFit(
        design, s["gamma"], {name[j]: p for j, p in s["free"].items()}, {name[j]: t for j, (t, _) in own.items()}, {name[j]: b for j, (_, b) in own.items()}, est, v,
        sums["ll"], r["penalised"], len(rows), sums["n"], sums["entropy"], r["iterations"], r["converged"], logliks, coding,
    )
