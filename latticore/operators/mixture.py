"""Latent class and profile models: expectation-maximisation over pattern tables or over partitions.

Rows become response patterns by one aggregation.  A table of at most `max_patterns` patterns is fitted in a task for each random
start, all starts at once; a larger one (continuous items, mostly) stays distributed, and each iteration is one pass in which
every partition returns one row of sufficient statistics.  Starts are drawn on the driver, so results do not depend on
the number of tasks.  Scoring is a projection of columns: it runs on batch and streaming frames alike.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, gradient, inverse, logsumexp, two_sided
from latticore.operators.emissions import Emission, Params, build
from latticore.operators import passes
from latticore.plans import patterns as P
from latticore.sources import panel


@dataclass
class Spec:
    """Blocks of items and their families, with K classes and prior weights."""

    blocks: list[tuple[str, list[str]]]
    k: int
    alpha: Mapping[str, float] = field(default_factory=dict)
    cats: Mapping[str, int] = field(default_factory=dict)

    @property
    def items(self) -> list[str]:
        return [c for _, cols in self.blocks for c in cols]

    def emissions(self) -> list[Emission]:
        kind = {"binary": "categorical", "categorical": "categorical", "ordinal": "categorical", "continuous": "variances"}
        return [build(f, cols, self.k, self.alpha.get(kind.get(f.partition(":")[0], "poisson"), 1.0), cats=[self.cats[c] for c in cols if c in self.cats]) for f, cols in self.blocks]

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([len(cols) for _, cols in self.blocks])
        return np.split(x, ends[:-1], axis=1)


@dataclass
class Fit:
    """Parameters and what is known of the fit."""

    spec: Spec
    pi: np.ndarray
    params: list[Params]
    loglik: float
    penalised: float
    n_params: int
    n: float
    entropy: float
    iterations: int
    converged: bool
    logliks: list[float] = field(default_factory=list)
    marginals: list[Params] = field(default_factory=list)
    weight: str | None = None
    coding: dict[str, tuple] = field(default_factory=dict)  # (low, high) of binary items that are not 0 and 1

    # -------------------------------------------------- numbers

    @property
    def replicated(self) -> int:
        """How many starts came within 0.01 of the best log-likelihood."""
        return sum(x > max(self.logliks) - 0.01 for x in self.logliks) if self.logliks else 1

    def metrics(self) -> dict[str, float]:
        return information_criteria(self.loglik, self.n_params, self.n, self.entropy, self.spec.k) | {"replicated": self.replicated}

    # -------------------------------------------------- columns

    def log_densities(self) -> list[Column]:
        """log pi_k + log f_k of each class."""
        parts = [e.columns(p) for e, p in zip(self.spec.emissions(), self.params)]
        return [sum((b[k] for b in parts), F.lit(math.log(float(self.pi[k]) + EPS))) for k in range(self.spec.k)]

    def coded(self, df: DataFrame) -> DataFrame:
        """df with the items as the fit has them: binary ones as 0 and 1."""
        return panel.coded(df, self.coding)

    def transform(self, df: DataFrame, posterior: str = "posterior") -> DataFrame:
        """df with posterior (array), modal class (first of ties), its probability and the row's log-likelihood; batch or stream.

        Items are coded as in the fit, and handed on as they are.  A row without an observed item has nulls.
        """
        if self.coding:
            kept = {f"_as_is_{i}": F.col(f"`{c}`") for i, c in enumerate(self.coding)}
            out = self._scored(self.coded(df.withColumns(kept)), posterior)
            return out.withColumns({c: F.col(n) for n, c in zip(kept, self.coding)}).drop(*kept)
        return self._scored(df, posterior)

    def _scored(self, df: DataFrame, posterior: str) -> DataFrame:
        seen = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in self.spec.items)).isNotNull()
        out = df.withColumn("_log", F.when(seen, F.array(*self.log_densities()))).withColumn("_top", F.array_max("_log"))
        out = out.withColumn("_sum", F.aggregate("_log", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top"))))
        out = out.withColumn(posterior, F.transform("_log", lambda v: F.exp(v - F.col("_top")) / F.col("_sum")))
        return out.withColumns({"loglik": F.col("_top") + F.log("_sum"), "class": F.array_position(F.col(posterior), F.array_max(posterior)).cast("int"), "probability": F.array_max(posterior)}).drop("_log", "_top", "_sum")

    def class_sizes(self, df: DataFrame) -> DataFrame:
        """class, proportion, n_expected, n_modal."""
        spark, w = df.sparkSession, F.col(self.weight) if self.weight else F.lit(1.0)
        scored = self.transform(df).where(F.col("class").isNotNull())
        own = scored.agg(*(F.sum(w * F.col("posterior")[k]).alias(f"e{k}") for k in range(self.spec.k)), *(F.sum(F.when(F.col("class") == k + 1, w).otherwise(0.0)).alias(f"m{k}") for k in range(self.spec.k))).first()
        return spark.createDataFrame([(k + 1, float(self.pi[k]), float(own[f"e{k}"] or 0), float(own[f"m{k}"] or 0)) for k in range(self.spec.k)], "class int, proportion double, n_expected double, n_modal double")

    def measurement_summary(self, spark) -> DataFrame:
        """block, parameter, item, category, class, estimate, overall."""
        rows = []
        for b, (e, p) in enumerate(zip(self.spec.emissions(), self.params)):
            own = [(f"{b + 1}:{e.name}", par, c, v, k, est) for c, par, v, k, est in e.rows(p)]
            mean: dict = {}
            for *key, k, est in own:
                mean[tuple(key)] = mean.get(tuple(key), 0.0) + float(self.pi[k - 1]) * est
            rows += [(*key, k, est, mean[tuple(key)]) for *key, k, est in own]
        return spark.createDataFrame(rows, "block string, parameter string, item string, category int, class int, estimate double, overall double")

    # -------------------------------------------------- packed parameters

    def free(self) -> np.ndarray:
        logits = np.log(self.pi[:-1] + EPS) - np.log(self.pi[-1] + EPS)
        return np.concatenate([logits, *(e.free(p) for e, p in zip(self.spec.emissions(), self.params))])

    def at(self, theta: np.ndarray) -> tuple[np.ndarray, list[Params]]:
        e = np.exp(np.clip(np.append(theta[: self.spec.k - 1], 0.0), -35, 35))
        out, a = [], self.spec.k - 1
        for em, p in zip(self.spec.emissions(), self.params):
            n = len(em.free(p))
            out.append(em.fixed(theta[a : a + n], p))
            a += n
        return e / e.sum(), out

    def case_logliks(self, x: np.ndarray, theta: np.ndarray | None = None) -> np.ndarray:
        pi, params = (self.pi, self.params) if theta is None else self.at(theta)
        return logsumexp(_joint(self.spec, pi, params, x))

    def vcov(self, x: np.ndarray, w: np.ndarray, kind: str = "robust") -> np.ndarray:
        """The free parameters' covariance on a pattern table: hessian, opg or robust (sandwich)."""
        from latticore.operators.curvature import mixture_sums

        s = mixture_sums(self.spec, self.pi, self.params, x, w)
        if kind == "opg":
            return inverse(s["outer"])
        bread = inverse(-s["h"])
        return bread if kind == "hessian" else bread @ s["outer"] @ bread

    def measurement_estimates(self, x: np.ndarray, w: np.ndarray, kind: str = "robust") -> pd.DataFrame:
        """Parameters on the reported scale with standard errors by the delta method."""
        theta, v = self.free(), self.vcov(x, w, kind)

        def reported(t):
            _, params = self.at(t)
            return np.array([r[-1] for e, p in zip(self.spec.emissions(), params) for r in e.rows(p)])

        est, jac = reported(theta), gradient(reported, theta)
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", jac, v, jac), 0))
        names = [r[:-1] for e, p in zip(self.spec.emissions(), self.params) for r in e.rows(p)]
        out = pd.DataFrame(names, columns=["item", "parameter", "category", "class"])
        with np.errstate(divide="ignore", invalid="ignore"):
            z = est / se
        return out.assign(estimate=est, se=se, z=z, p_value=two_sided(np.nan_to_num(z)))


def information_criteria(ll: float, p: int, n: float, entropy: float, k: int) -> dict[str, float]:
    """AIC, BIC, CAIC, AWE, AIC3, SABIC, ICL and relative entropy (1 for one class)."""
    log_n = math.log(n) if n > 0 else 0.0
    bic = -2 * ll + log_n * p
    rel = 1.0 if k == 1 else min(1.0, max(0.0, 1 - entropy / (n * math.log(k)))) if n > 0 else 1.0
    return {"loglik": ll, "n_params": p, "aic": -2 * ll + 2 * p, "bic": bic, "caic": bic + p, "awe": -2 * ll + 2 * p * (log_n + 1.5), "aic3": -2 * ll + 3 * p, "sabic": -2 * ll + p * math.log((n + 2) / 24), "icl": bic + 2 * entropy, "relative_entropy": rel}


# ---------------------------------------------------------------- kernels


def _joint(spec: Spec, pi: np.ndarray, params: list[Params], x: np.ndarray) -> np.ndarray:
    out = np.log(pi + EPS)[None, :] + np.zeros((len(x), 1))
    for e, p, b in zip(spec.emissions(), params, spec.split(x)):
        out = out + e.loglik(b, p)
    return out


def _statistics(spec: Spec, pi: np.ndarray, params: list[Params], x: np.ndarray, w: np.ndarray) -> dict:
    """One pass over rows: log-likelihood, entropy, class totals and each block's statistics."""
    joint = _joint(spec, pi, params, x)
    ll = logsumexp(joint)
    post = np.exp(joint - ll[:, None])
    r = post * w[:, None]
    return {"ll": float(w @ ll), "entropy": float(-(r * np.log(post + EPS)).sum()), "n": r.sum(axis=0), "blocks": [e.stats(b, r, p) for e, p, b in zip(spec.emissions(), params, spec.split(x))]}


def _add(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    def both(s: Params, t: Params) -> Params:
        out = {}
        for k in s:
            u, v = s[k], t[k]
            if u.shape != v.shape:  # counts by value: the longer one wins
                top = max(u.shape[-1], v.shape[-1])
                u, v = (np.pad(z, [(0, 0)] * (z.ndim - 1) + [(0, top - z.shape[-1])]) for z in (u, v))
            out[k] = u + v
        return out

    return {"ll": a["ll"] + b["ll"], "entropy": a["entropy"] + b["entropy"], "n": a["n"] + b["n"], "blocks": [both(s, t) for s, t in zip(a["blocks"], b["blocks"])]}


def _maximised(spec: Spec, s: dict, m: list[Params], params: list[Params]) -> tuple[np.ndarray, list[Params]]:
    a = spec.alpha.get("latent", 1.0)
    n = s["n"] + a / spec.k
    return n / n.sum(), [e.update(b, mm, p) for e, b, mm, p in zip(spec.emissions(), s["blocks"], m, params)]


def _log_prior(spec: Spec, pi: np.ndarray, params: list[Params], m: list[Params]) -> float:
    a = spec.alpha.get("latent", 1.0)
    return float(a / spec.k * np.log(pi + EPS).sum()) + sum(e.log_prior(p, mm) for e, p, mm in zip(spec.emissions(), params, m))


def run_em(step, spec: Spec, pi, params, m, *, max_iter: int = 1000, tol: float = 1e-8) -> dict:
    """EM with `step(pi, params)` giving summed statistics, until the penalised log-likelihood moves by less than tol relatively."""
    last, s, done = -math.inf, None, False
    for i in range(max_iter + 1):
        s = step(pi, params)
        value = s["ll"] + _log_prior(spec, pi, params, m)
        done = value - last < tol * (1 + abs(value)) and i > 0
        if done or i == max_iter:
            break
        last = value
        pi, params = _maximised(spec, s, m, params)
    return {"pi": pi, "params": params, "ll": s["ll"], "penalised": value, "entropy": s["entropy"], "n": float(s["n"].sum()), "iterations": i, "converged": bool(done)}


def degenerate(spec: Spec, res: dict, x: np.ndarray, w: np.ndarray) -> bool:
    """A class of which over 90 % sits on one value of a continuous item with its own variance."""
    r = None
    for (f, _), e, b in zip(spec.blocks, spec.emissions(), spec.split(x)):
        if not f.startswith("continuous") or getattr(e, "kind", "") != "class":
            continue
        if r is None:
            joint = _joint(spec, res["pi"], res["params"], x)
            r = np.exp(joint - logsumexp(joint)[:, None]) * w[:, None]
        for j in range(b.shape[1]):
            seen = ~np.isnan(b[:, j])
            _, back = np.unique(b[seen, j], return_inverse=True)
            for k in range(spec.k):
                own = np.bincount(back, weights=r[seen, k])
                if own.sum() > 0 and own.max() > 0.9 * own.sum() and len(own) > 1:
                    return True
    return False


def _starts(spec: Spec, m: list[Params], n: int, seed: int) -> list[tuple]:
    out = []
    for i in range(n):
        rng = np.random.default_rng([seed, i])
        pi = rng.dirichlet(np.full(spec.k, 5.0))
        out.append((pi, [e.start(mm, rng) for e, mm in zip(spec.emissions(), m)]))
    return out


def _sorted(spec: Spec, res: dict) -> dict:
    order = np.argsort(-res["pi"], kind="stable")
    return res | {"pi": res["pi"][order], "params": [e.permuted(p, order) for e, p in zip(spec.emissions(), res["params"])]}


def fit_table(spec: Spec, x: np.ndarray, w: np.ndarray, *, n_init: int = 20, seed: int = 1, max_iter: int = 1000, tol: float = 1e-8, starts: list | None = None) -> Fit:
    """The best of several starts on an in-memory pattern table."""
    m = [e.marginal(b, w) for e, b in zip(_resolved(spec, x), spec.split(x))]
    runs = [run_em(lambda pi, ps: _statistics(spec, pi, ps, x, w), spec, *s, m, max_iter=max_iter, tol=tol) for s in (starts or _starts(spec, m, n_init, seed))]
    return _best(spec, runs, m, lambda r: degenerate(spec, r, x, w))


def _resolved(spec: Spec, x: np.ndarray) -> list[Emission]:
    """Emissions, with category counts settled from the table."""
    cats = dict(spec.cats)
    for (f, cols), b in zip(spec.blocks, spec.split(x)):
        if f in ("categorical", "ordinal"):
            for j, c in enumerate(cols):
                cats.setdefault(c, int(np.nanmax(b[:, j], initial=1)))
    spec.cats = cats
    return spec.emissions()


def _best(spec: Spec, runs: list[dict], m: list[Params], bad) -> Fit:
    ranked = sorted(runs, key=lambda r: -r["penalised"])
    best = next((r for r in ranked if not bad(r)), ranked[0])
    best = _sorted(spec, best)
    p = spec.k - 1 + sum(e.n_params(mm) for e, mm in zip(spec.emissions(), m))
    return Fit(spec, best["pi"], best["params"], best["ll"], best["penalised"], p, best["n"], best["entropy"], best["iterations"], best["converged"], [r["ll"] for r in runs], m)


# ---------------------------------------------------------------- Spark


def pattern_arrays(pdf: pd.DataFrame, items: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return pdf[list(items)].to_numpy(dtype=float, na_value=np.nan), pdf["_weight"].to_numpy(float)


def weighed_patterns(df: DataFrame, items: Sequence[str], weight: str | None, weight_type: str = "sampling", as_is: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The distinct rows with an observed item: items as numbers, those of `as_is` as they are, _weight and _rows; and the persisted table behind them.

    One aggregation of df.  Sampling weights sum to the number of rows; frequency weights stay.  Null or negative weights are refused.
    """
    if weight and weight_type not in ("sampling", "frequency"):
        raise ValueError("weights are sampling or frequency weights")
    keys = [F.col(f"`{c}`") if c in as_is else F.col(f"`{c}`").cast("double").alias(c) for c in items]
    seen = panel.drop_empty(df, items)
    if not weight:
        table = P.collapse(seen.select(*keys), items, names=("_weight", "_rows")).persist()
        return table, table
    own = seen.select(*keys, F.col(f"`{weight}`").alias("_w"))
    w = F.col("_w")
    table = own.groupBy(*(F.col(f"`{c}`") for c in items)).agg(F.sum(w).cast("double").alias("_weight"), F.count(F.lit(1)).alias("_rows"), F.min(w).alias("_least"), F.count(w).alias("_known")).persist()
    row = table.agg(F.sum("_weight").alias("s"), F.sum("_rows").alias("n"), F.min("_least").alias("lo"), F.sum(F.col("_rows") - F.col("_known")).alias("nulls")).first()
    if row.n and (row.nulls or row.lo < 0 or not row.s):
        table.unpersist()
        raise ValueError("weights must be at least 0, not all 0, and not null")
    scale = row.n / row.s if row.n and weight_type == "sampling" else 1.0
    return table.select(*(F.col(f"`{c}`") for c in items), (F.col("_weight") * scale).alias("_weight"), "_rows"), table


def fit_mixture(df: DataFrame, items: Sequence[str], n_classes: int, measurement, *, weight: str | None = None, weight_type: str = "sampling", n_init: int = 20, max_iter: int = 1000, tol: float = 1e-8, seed: int = 1, alpha: Mapping[str, float] | None = None, variances_equal: bool | None = None, cats: Mapping[str, int] | None = None, same_coding: Mapping[str, Sequence[str]] | None = None, starts: list[tuple[np.ndarray, list[Params]]] | None = None, max_patterns: int = 50_000) -> Fit:
    """A latent class, profile or mixed model of the rows of df; missing cells stay in the likelihood, empty rows go.

    Binary items of any two values are coded as 0 and 1, and the coding is kept for scoring; `same_coding` names sets of items that share
    one.  `starts`, (class shares, parameters of each block), are used in place of `n_init` random ones.  `max_patterns` only says where the table is fitted: starts, rounds, refusals and the choice among runs are the same.
    """
    if n_classes < 1:
        raise ValueError("at least one class")
    blocks = panel.normalize_measurement(items, measurement)
    if variances_equal is None:
        variances_equal = all(f.startswith("continuous") for f, _ in blocks)
    blocks = [(f"continuous:{'equal' if variances_equal else 'class'}" if f == "continuous" else f, cols) for f, cols in blocks]
    spec = Spec(blocks, n_classes, alpha or {}, cats or {})
    binary = [c for f, cols in blocks if f == "binary" for c in cols]
    # the input is aggregated once; checks and codings are of its patterns
    table, held = weighed_patterns(df, spec.items, weight, weight_type, as_is=binary)
    counts = [c for f, cols in blocks if f in ("count", "zip", "negbin") for c in cols]
    if counts:
        panel.check_counts(table, counts)
    groups = {g: [c for c in cols if c in binary] for g, cols in (same_coding or {}).items()}
    groups |= {c: [c] for c in binary if not any(c in cols for cols in groups.values())}
    coding: dict[str, tuple] = {}
    if binary:
        table, found = panel.recode_binary(table, binary, groups)
        coding = panel.columns_coding(found, groups)
    categorical = [c for f, cols in blocks if f in ("categorical", "ordinal") for c in cols]
    if categorical:
        panel.check_categories(table, categorical)
    table = table.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in spec.items), "_weight")
    # the pattern table comes to the driver only where it is small; a larger one stays, and passes go over its weighted patterns
    n = table.count()
    if not n:
        raise ValueError("no row with an observed item")
    if n <= max_patterns:
        head = table.toPandas().sort_values(spec.items, na_position="first", ignore_index=True)
        fit = _fit_tasks(df, spec, head, n_init=n_init, seed=seed, max_iter=max_iter, tol=tol, starts=starts)
    else:
        fit = _fit_partitions(table, spec, "_weight", n_init=n_init, seed=seed, max_iter=max_iter, tol=tol, starts=starts)
    held.unpersist()
    fit.weight, fit.coding = weight, coding
    return fit


def _fit_tasks(df: DataFrame, spec: Spec, table: pd.DataFrame, *, n_init, seed, max_iter, tol, starts=None) -> Fit:
    """A task for each start, each with the whole (small) pattern table."""
    x, w = pattern_arrays(table, spec.items)
    m = [e.marginal(b, w) for e, b in zip(_resolved(spec, x), spec.split(x))]
    starts = starts or _starts(spec, m, n_init if spec.k > 1 else 1, seed)
    if len(starts) == 1 or len(w) * len(starts) < 2000:
        runs = [run_em(lambda pi, ps: _statistics(spec, pi, ps, x, w), spec, *s, m, max_iter=max_iter, tol=tol) for s in starts]
    else:
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast((spec, x, w, m, starts))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            spec, x, w, m, starts = shared.value
            for f in frames:
                out = [run_em(lambda pi, ps: _statistics(spec, pi, ps, x, w), spec, *starts[i], m, max_iter=max_iter, tol=tol) for i in f["start"]]
                yield pd.DataFrame({"start": f["start"], "run": [pickle.dumps(r) for r in out]})

        ids = spark.createDataFrame([(i,) for i in range(len(starts))], "start int").repartition(len(starts), "start")
        runs = [pickle.loads(r.run) for r in ids.mapInPandas(run, "start int, run binary").orderBy("start").collect()]
    return _best(spec, runs, m, lambda r: degenerate(spec, r, x, w))


def _fit_partitions(rows: DataFrame, spec: Spec, weight: str | None, *, n_init, seed, max_iter, tol, starts=None) -> Fit:
    """One pass over the (persisted) rows in each iteration; all live starts share it.  A partition returns one row of statistics."""
    spark, items = rows.sparkSession, spec.items
    (dealt, tasks), size = passes.dealt(rows), [None]
    cells = []
    w = F.col(weight) if weight else F.lit(1.0)
    for c in items:
        seen = F.when(F.col(f"`{c}`").isNotNull(), w)
        cells += [F.sum(seen).alias(f"n:{c}"), F.sum(w * F.col(f"`{c}`")).alias(f"x:{c}"), F.sum(w * F.col(f"`{c}`") * F.col(f"`{c}`")).alias(f"xx:{c}"), F.max(f"`{c}`").alias(f"top:{c}")]
    row = rows.agg(*cells).first()
    spec.cats = {c: int(row[f"top:{c}"] or 1) for f, cols in spec.blocks if f in ("categorical", "ordinal") for c in cols} | dict(spec.cats)
    m = []
    for f, cols in spec.blocks:
        if f in ("categorical", "ordinal"):
            by = np.zeros((len(cols), max(spec.cats[c] for c in cols)))
            for j, c in enumerate(cols):
                for r in rows.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.sum(w).alias("s")).collect():
                    by[j, int(r.v) - 1] = r.s
            m.append({"share": by / np.maximum(by.sum(axis=1, keepdims=True), EPS)})
        else:
            n = np.array([row[f"n:{c}"] or EPS for c in cols])
            mean = np.array([row[f"x:{c}"] or 0.0 for c in cols]) / n
            m.append({"mean": mean, "var": np.maximum(np.array([row[f"xx:{c}"] or 0.0 for c in cols]) / n - mean**2, 1e-12)})

    def step_all(states: list[tuple]) -> list[dict]:
        shared = spark.sparkContext.broadcast((spec, states))
        out, size[0] = passes.summed(dealt, tasks, of_frame, _add, shared, size[0])
        shared.unpersist()
        return out

    def of_frame(f: pd.DataFrame, value: tuple) -> list[dict]:
        spec, states = value
        x = f[items].to_numpy(float, na_value=np.nan)
        w = f[weight].to_numpy(float) if weight else np.ones(len(f))
        return [_statistics(spec, *s, x, w) for s in states]

    live = [{"state": s, "last": -math.inf, "done": False, "i": 0} for s in starts or _starts(spec, m, n_init if spec.k > 1 else 1, seed)]
    for i in range(max_iter + 1):
        open_ = [r for r in live if not r["done"]]
        if not open_:
            break
        for r, s in zip(open_, step_all([r["state"] for r in open_])):
            value = s["ll"] + _log_prior(spec, *r["state"], m)
            r |= {"ll": s["ll"], "penalised": value, "entropy": s["entropy"], "n": float(s["n"].sum()), "iterations": i, "converged": False}
            if value - r["last"] < tol * (1 + abs(value)) and i > 0:
                r |= {"done": True, "converged": True}
            elif i < max_iter:
                r["last"], r["state"] = value, _maximised(spec, s, m, r["state"][1])
    runs = [r | {"pi": r["state"][0], "params": r["state"][1]} for r in live]
    fit = _best(spec, runs, m, lambda r: degenerate_rows(spec, r, rows, weight))
    return fit


def degenerate_rows(spec: Spec, res: dict, rows: DataFrame, weight: str | None) -> bool:
    """degenerate() of a table that stays where it is: one pass over the rows, whatever the items, and one aggregation by value."""
    own = [(f.startswith("continuous") and getattr(e, "kind", "") == "class", len(cols)) for (f, cols), e in zip(spec.blocks, spec.emissions())]
    at = [j for j, chosen in enumerate(np.repeat([c for c, _ in own], [n for _, n in own])) if chosen]
    if not at:
        return False
    items, pi, params = list(spec.items), res["pi"], res["params"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = f[items].to_numpy(float, na_value=np.nan)
            joint = _joint(spec, pi, params, x)
            r = np.exp(joint - logsumexp(joint)[:, None]) * (f[weight].to_numpy(float)[:, None] if weight else 1.0)
            for j in at:
                seen = ~np.isnan(x[:, j])
                value, back = np.unique(x[seen, j], return_inverse=True)
                yield pd.DataFrame({"item": j, "value": value, **{f"s{k}": np.bincount(back, weights=r[seen, k], minlength=len(value)) for k in range(spec.k)}})

    named = [f"s{k}" for k in range(spec.k)]
    dealt, _ = passes.dealt(rows)
    by = dealt.mapInPandas(run, "item int, value double, " + ", ".join(f"{n} double" for n in named)).groupBy("item", "value").agg(*(F.sum(n).alias(n) for n in named))
    tops = by.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *(f(n).alias(f"{kind}:{n}") for n in named for kind, f in (("top", F.max), ("all", F.sum)))).collect()
    return any(t.n > 1 and (t[f"all:{n}"] or 0) > 0 and t[f"top:{n}"] > 0.9 * t[f"all:{n}"] for t in tops for n in named)


def compare_mixtures(df: DataFrame, items: Sequence[str], k_range: Sequence[int], measurement, **how) -> tuple[DataFrame, dict[int, Fit]]:
    """The enumeration table: one row per number of classes, with Bayes factors against the next and correct-model probabilities."""
    fits = {k: fit_mixture(df, items, k, measurement, **how) for k in k_range}
    rows = [(k, f.metrics()) for k, f in fits.items()]
    sic = np.array([-m["bic"] / 2 for _, m in rows])
    cmp_ = np.exp(sic - sic.max())
    cmp_ /= cmp_.sum()
    out = []
    for i, (k, m) in enumerate(rows):
        bf = math.exp(min(700.0, sic[i] - sic[i + 1])) if i + 1 < len(rows) else None
        out.append((k, m["loglik"], m["n_params"], m["aic"], m["bic"], m["caic"], m["awe"], m["aic3"], m["icl"], m["sabic"], m["relative_entropy"], bool(k > 1 and m["replicated"] < 2), bf, float(cmp_[i])))
    schema = "classes int, ll double, params int, aic double, bic double, caic double, awe double, aic3 double, icl double, sabic double, entropy double, unreplicated boolean, bf double, cmp double"
    return df.sparkSession.createDataFrame(out, schema), fits


def simulate(fit: Fit, n: int, seed: int = 1) -> pd.DataFrame:
    """n complete rows drawn from the model, with their class."""
    rng = np.random.default_rng(seed)
    c = rng.choice(fit.spec.k, n, p=fit.pi / fit.pi.sum())
    out = {}
    for (f, cols), p in zip(fit.spec.blocks, fit.params):
        kind = f.partition(":")[0]
        for j, name in enumerate(cols):
            if kind == "binary":
                v = (rng.random(n) < p["p"][c, j]).astype(float)
            elif kind in ("categorical", "ordinal"):
                q = p["p"][c, j, :].cumsum(axis=1)
                v = 1.0 + (rng.random(n)[:, None] > q[:, : fit.spec.cats[name] - 1]).sum(axis=1)
            elif kind == "continuous":
                v = p["mean"][c, j] + np.sqrt(p["var"][c, j]) * rng.standard_normal(n)
            elif kind == "negbin":
                v = rng.poisson(rng.gamma(1 / p["alpha"][j], p["alpha"][j] * p["rate"][c, j])).astype(float)
            else:
                v = rng.poisson(p["rate"][c, j]).astype(float)
                if kind == "zip":
                    v[rng.random(n) < p["zero"][c, j]] = 0.0
            out[name] = np.where(v == 1, fit.coding[name][1], fit.coding[name][0]) if name in fit.coding else v
    return pd.DataFrame(out).assign(**{"class": c + 1})


#: Patterns whose probabilities are listed, so that a simulated table costs by patterns, not by rows.
LISTED = 1 << 17


def simulated_patterns(fit: Fit, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The pattern table (items as coded, weights) of n rows drawn from the model: multinomial counts of all patterns where their
    number allows it, else by drawing the rows."""
    levels = []
    for f, cols in fit.spec.blocks:
        levels += [np.arange(2.0) if f == "binary" else np.arange(1.0, fit.spec.cats[c] + 1) if f in ("categorical", "ordinal") else None for c in cols]
    if all(v is not None for v in levels) and math.prod(len(v) for v in levels) <= LISTED:
        x = np.stack([g.ravel() for g in np.meshgrid(*levels, indexing="ij")], axis=1)
        p = np.exp(logsumexp(_joint(fit.spec, fit.pi, fit.params, x)))
        counts = np.random.default_rng(seed).multinomial(n, p / p.sum())
        return x[counts > 0], counts[counts > 0].astype(float)
    rows = simulate(replace(fit, coding={}), n, seed)[fit.spec.items]
    return pattern_arrays(rows.groupby(fit.spec.items, sort=True).size().reset_index(name="_weight"), fit.spec.items)


# ---------------------------------------------------------------- one iteration as a query


def m_step(scored: DataFrame, spec: Spec, params: list[Params], marginals: list[Params], weight: str | None = None) -> tuple[np.ndarray, list[Params]]:
    """The update from scored rows (posterior array) by one aggregation in SQL functions."""
    w, k = F.col(weight) if weight else F.lit(1.0), spec.k
    cells, plan = [F.sum(w * F.col("posterior")[c]).alias(f"n{c}") for c in range(k)], []
    for b, (f, cols) in enumerate(spec.blocks):
        for j, name in enumerate(cols):
            x = F.col(f"`{name}`").cast("double")
            for c in range(k):
                r, at = w * F.col("posterior")[c], f"{b}_{j}_{c}"
                if f in ("categorical", "ordinal"):
                    for v in range(spec.cats[name]):
                        cells.append(F.sum(F.when(x == v + 1, r).otherwise(0.0)).alias(f"c{at}_{v}"))
                    continue
                cells += [F.sum(F.when(x.isNotNull(), r).otherwise(0.0)).alias(f"s{at}"), F.sum(F.coalesce(r * x, F.lit(0.0))).alias(f"x{at}")]
                if f.startswith("continuous"):
                    cells.append(F.sum(F.coalesce(r * x * x, F.lit(0.0))).alias(f"q{at}"))
                if f == "zip":
                    cells.append(F.sum(F.when(x == 0, r).otherwise(0.0)).alias(f"z{at}"))
    row = scored.where(F.col("posterior").isNotNull()).agg(*cells).first()
    for b, ((f, cols), p) in enumerate(zip(spec.blocks, params)):
        get = lambda n, b=b, cols=cols: np.array([[row[f"{n}{b}_{j}_{c}"] or 0.0 for j in range(len(cols))] for c in range(k)])
        if f in ("categorical", "ordinal"):
            top = max(spec.cats[c] for c in cols)
            plan.append({"c": np.array([[[row[f"c{b}_{j}_{c}_{v}"] or 0.0 if v < spec.cats[name] else 0.0 for v in range(top)] for j, name in enumerate(cols)] for c in range(k)])})
        elif f == "zip":
            inflated = get("z") * (p["zero"] / (p["zero"] + (1 - p["zero"]) * np.exp(-p["rate"])))
            plan.append({"n": get("s") - inflated, "x": get("x"), "inflated": inflated, "all": get("s")})
        else:
            plan.append({"n": get("s"), "x": get("x")} | ({"xx": get("q")} if f.startswith("continuous") else {}))
    return _maximised(spec, {"n": np.array([row[f"n{c}"] or 0.0 for c in range(k)]), "blocks": plan}, marginals, params)


def marginals(df: DataFrame, spec: Spec, weight: str | None = None) -> list[Params]:
    """Weighted means and variances (or category shares) of the items, by one aggregation."""
    w, cells = F.col(weight) if weight else F.lit(1.0), []
    for b, (f, cols) in enumerate(spec.blocks):
        for j, name in enumerate(cols):
            x = F.col(f"`{name}`").cast("double")
            if f in ("categorical", "ordinal"):
                cells += [F.sum(F.when(x == v + 1, w).otherwise(0.0)).alias(f"c{b}_{j}_{v}") for v in range(spec.cats[name])]
            else:
                cells += [F.sum(F.when(x.isNotNull(), w)).alias(f"n{b}_{j}"), F.sum(w * x).alias(f"x{b}_{j}"), F.sum(w * x * x).alias(f"q{b}_{j}")]
    row, out = df.agg(*cells).first(), []
    for b, (f, cols) in enumerate(spec.blocks):
        if f in ("categorical", "ordinal"):
            top = max(spec.cats[c] for c in cols)
            s = np.array([[row[f"c{b}_{j}_{v}"] or 0.0 if v < spec.cats[name] else 0.0 for v in range(top)] for j, name in enumerate(cols)])
            out.append({"share": s / np.maximum(s.sum(axis=1, keepdims=True), EPS)})
        else:
            n = np.array([row[f"n{b}_{j}"] or EPS for j in range(len(cols))])
            mean = np.array([row[f"x{b}_{j}"] or 0.0 for j in range(len(cols))]) / n
            out.append({"mean": mean, "var": np.maximum(np.array([row[f"q{b}_{j}"] or 0.0 for j in range(len(cols))]) / n - mean**2, 1e-12)})
    return out


def with_parameters(spec: Spec, pi: np.ndarray, params: list[Params], loglik: float = math.nan, n: float = math.nan) -> Fit:
    """A model of given parameters, for scoring."""
    return Fit(spec, np.asarray(pi, float), params, loglik, loglik, 0, n, math.nan, 0, True)


def em_rounds(table: DataFrame, spec: Spec, pi: np.ndarray, params: list[Params], rounds: int, weight: str | None = "w") -> Fit:
    """A fixed number of iterations, each an aggregation over the (persisted) table in SQL functions."""
    table = table.persist()
    m = marginals(table, spec, weight)
    for _ in range(rounds):
        pi, params = m_step(with_parameters(spec, pi, params).transform(table), spec, params, m, weight)
    table.unpersist()
    return with_parameters(spec, pi, params)
