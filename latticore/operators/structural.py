"""Regressions of and on the latent class: one, two and three steps, with BCH and ML corrections and survey variances.

Rows meet the model in one aggregation (cross tables, weighted moments, counts by design row); Newton steps run on those
small tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, chi2_sf, gradient, hessian, inverse, newton, pinv, softmax, two_sided


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1.0)


# ---------------------------------------------------------------- classification error


def classification_error(scored: DataFrame, k: int, *, assignment: str = "modal", weight: str | None = None, floor: float = 1e-6) -> np.ndarray:
    """P(assigned | true), columns true classes: one aggregation of the posterior array."""
    w, p = _w(weight), [F.col("posterior")[c] for c in range(k)]
    own = [(F.col("class") == s + 1).cast("double") for s in range(k)] if assignment == "modal" else p
    return _error_table(scored.where(F.col("class").isNotNull()).agg(*(F.sum(w * own[s] * p[t]).alias(f"d{s}_{t}") for s in range(k) for t in range(k))).first(), k, floor)


def _error_table(row, k: int, floor: float = 1e-6) -> np.ndarray:
    d = np.array([[row[f"d{s}_{t}"] or 0.0 for t in range(k)] for s in range(k)])
    d = np.maximum(d / np.maximum(d.sum(axis=0), EPS), floor)
    return d / d.sum(axis=0)


def with_bch_weights(scored: DataFrame, error: np.ndarray, *, assignment: str = "modal") -> DataFrame:
    """scored with bch (array): the assignment times the inverse of the error table; weights may be negative."""
    k, inv = len(error), pinv(error)
    own = [(F.col("class") == s + 1).cast("double") for s in range(k)] if assignment == "modal" else [F.col("posterior")[s] for s in range(k)]
    return scored.withColumn("bch", F.array(*(sum((own[s] * float(inv[t, s]) for s in range(k)), F.lit(0.0)) for t in range(k))))


def distal_means(weighted: DataFrame, outcome: str, k: int, *, column: str = "bch", weight: str | None = None, equal_variances: bool = True) -> DataFrame:
    """class, n, mean, variance of a continuous outcome under class weights (an array column); one aggregation."""
    w, y = _w(weight), F.col(outcome).cast("double")
    seen = weighted.where(y.isNotNull() & F.col(column).isNotNull())
    cells = []
    for c in range(k):
        r = w * F.col(column)[c]
        cells += [F.sum(r).alias(f"n{c}"), F.sum(r * y).alias(f"s{c}"), F.sum(r * y * y).alias(f"q{c}")]
    mean = lambda c: F.col(f"s{c}") / F.col(f"n{c}")
    ss = lambda c: F.col(f"q{c}") - F.col(f"s{c}") * mean(c)
    pooled = sum((ss(c) for c in range(k)), F.lit(0.0)) / sum((F.col(f"n{c}") for c in range(k)), F.lit(0.0))
    rows = [F.struct(F.lit(c + 1).alias("class"), F.col(f"n{c}").alias("n"), mean(c).alias("mean"), F.greatest(pooled if equal_variances else ss(c) / F.col(f"n{c}"), F.lit(1e-5)).alias("variance")) for c in range(k)]
    return seen.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def distal_vcov(weighted: DataFrame, outcome: str, means: Sequence[float], *, column: str = "bch", weight: str | None = None) -> np.ndarray:
    """Sandwich covariance of the class means: sums of products of scores."""
    k, w, y = len(means), _w(weight), F.col(outcome).cast("double")
    s = [w * F.col(column)[c] * (y - float(means[c])) for c in range(k)]
    row = weighted.where(y.isNotNull() & F.col(column).isNotNull()).agg(*(F.sum(w * F.col(column)[c]).alias(f"n{c}") for c in range(k)), *(F.sum(s[a] * s[b]).alias(f"s{a}_{b}") for a in range(k) for b in range(a, k))).first()
    n = np.array([row[f"n{c}"] for c in range(k)])
    m = np.array([[row[f"s{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
    return m / np.outer(n, n)


def distal_shares(weighted: DataFrame, outcome: str, k: int, *, column: str = "bch", weight: str | None = None) -> DataFrame:
    """category, class, n, proportion of a categorical outcome under class weights."""
    w = _w(weight)
    by = weighted.where(F.col(outcome).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(outcome).cast("string").alias("category")).agg(*(F.sum(w * F.col(column)[c]).alias(f"n{c}") for c in range(k)))
    total = by.agg(*(F.sum(f"n{c}").alias(f"t{c}") for c in range(k)))
    rows = F.array(*(F.struct(F.lit(c + 1).alias("class"), F.col(f"n{c}").alias("n"), (F.col(f"n{c}") / F.col(f"t{c}")).alias("proportion")) for c in range(k)))
    return by.crossJoin(F.broadcast(total)).select("category", F.explode(rows).alias("r")).select("category", "r.*")


# ---------------------------------------------------------------- design tables


def design_table(scored: DataFrame, columns: Sequence[str], values: Sequence[Column], names: Sequence[str], *, weight: str | None = None, max_rows: int = 200_000) -> pd.DataFrame:
    """Summed `values` by distinct design row; the regressions below work on this table."""
    w = _w(weight)
    table = scored.dropna(subset=[f"`{c}`" for c in columns]).groupBy(*(F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(columns))).agg(*(F.sum(w * v).alias(n) for n, v in zip(names, values))).limit(max_rows + 1).toPandas()
    if len(table) > max_rows:
        raise ValueError(f"more than {max_rows} design rows")
    return table.sort_values([f"_x{j}" for j in range(len(columns))], ignore_index=True)


def _design(table: pd.DataFrame, d: int) -> np.ndarray:
    return np.column_stack([np.ones(len(table)), *(table[f"_x{j}"] for j in range(d))])


def mnl_score(beta: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian of a multinomial logit with the last category as reference; counts: rows x K."""
    k = counts.shape[1]
    p = softmax(np.column_stack([x @ beta.reshape(k - 1, -1).T, np.zeros(len(x))]))
    n = counts.sum(axis=1)
    g = ((counts - n[:, None] * p)[:, :-1].T @ x).ravel()
    d = x.shape[1]
    h = np.zeros((len(beta), len(beta)))
    for a in range(k - 1):
        for b in range(k - 1):
            v = -n * p[:, a] * ((a == b) - p[:, b])
            h[a * d : (a + 1) * d, b * d : (b + 1) * d] = x.T @ (x * v[:, None])
    return float((counts * np.log(np.maximum(p, 1e-300))).sum()), g, h


def fit_mnl(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(K - 1) x D coefficients against the last category, and their covariance."""
    k, d = counts.shape[1], x.shape[1]
    beta = newton(lambda b: mnl_score(b, x, counts), np.zeros((k - 1) * d))
    return beta.reshape(k - 1, d), inverse(-mnl_score(beta, x, counts)[2])


def add_covariates(scored: DataFrame, columns: Sequence[str], k: int, *, correction: str = "ML", assignment: str = "proportional", weight: str | None = None) -> pd.DataFrame:
    """Three-step regression of the class on covariates: class, term, estimate, odds_ratio, se, z, p (the last class as reference)."""
    return compare_corrections(scored, columns, k, [correction], assignment=assignment, weight=weight)[correction]


def compare_corrections(scored: DataFrame, columns: Sequence[str], k: int, corrections: Sequence[str] = ("ML", "BCH", "none"), *, assignment: str = "proportional", weight: str | None = None, max_rows: int = 200_000) -> dict[str, pd.DataFrame]:
    """add_covariates() by several corrections: scored is read once, and its sums by covariates give the error table and the design."""
    if any(c not in ("ML", "BCH", "none") for c in corrections):
        raise ValueError("correction is ML, BCH or none")
    w, p = _w(weight), [F.col("posterior")[t] for t in range(k)]
    own = [(F.col("class") == s + 1).cast("double") for s in range(k)] if assignment == "modal" else p
    sums = [F.sum(w * own[s]).alias(f"_a{s}") for s in range(k)] + [F.sum(w * own[s] * p[t]).alias(f"_d{s}_{t}") for s in range(k) for t in range(k)]
    cells = scored.where(F.col("class").isNotNull()).groupBy(*(F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(columns))).agg(*sums).persist()
    # rows without a covariate count in the error table only
    row = cells.agg(*(F.sum(f"_d{s}_{t}").alias(f"d{s}_{t}") for s in range(k) for t in range(k))).first()
    error = _error_table(row, k)
    keys, assigned = [f"_x{j}" for j in range(len(columns))], [f"_a{s}" for s in range(k)]
    table = cells.dropna(subset=keys).select(*keys, *assigned).limit(max_rows + 1).toPandas()
    cells.unpersist()
    if len(table) > max_rows:
        raise ValueError(f"more than {max_rows} design rows")
    table = table.sort_values(keys, ignore_index=True)
    x, a = _design(table, len(columns)), table[assigned].to_numpy()
    return {c: _covariate_step(x, a, error, columns, c) for c in corrections}


def _covariate_step(x: np.ndarray, a: np.ndarray, error: np.ndarray, columns: Sequence[str], correction: str) -> pd.DataFrame:
    k = len(error)
    if correction == "none":
        beta, v = fit_mnl(x, a)
    elif correction == "BCH":
        beta, v = fit_mnl(x, a @ pinv(error).T)
    else:
        beta, v = ml_covariates(x, a, error)
    names = ["(intercept)", *columns]
    rows = []
    for c in range(k - 1):
        for j, t in enumerate(names):
            se = math.sqrt(max(0.0, v[c * len(names) + j, c * len(names) + j]))
            z = beta[c, j] / se if se else math.nan
            rows.append((c + 1, t, beta[c, j], math.exp(min(700.0, beta[c, j])), se, z, float(two_sided(z)) if se else math.nan))
    return pd.DataFrame(rows, columns=["class", "term", "estimate", "odds_ratio", "se", "z", "p"])


def _newton_finish(ll, score, beta: np.ndarray, *, rounds: int = 30, tol: float = 1e-9) -> np.ndarray:
    """Newton steps from where EM stopped to a zero of the score; a step that does not raise the log-likelihood is halved, then given up."""
    now, size = ll(beta), 1.0 + abs(ll(beta))
    for _ in range(rounds):
        g = score(beta)
        if np.abs(g).max() < tol * size:
            break
        step, share = inverse(-hessian(ll, beta)) @ g, 1.0
        while share > 1e-3 and not ll(beta + share * step) >= now - 1e-12 * size:
            share /= 2
        if share <= 1e-3:
            break
        beta = beta + share * step
        now = ll(beta)
    return beta


def ml_covariates(x: np.ndarray, assigned: np.ndarray, error: np.ndarray, *, rounds: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of assigned classes given the fixed error table: EM over true classes, then the observed information."""
    k, d = error.shape[0], x.shape[1]
    beta, last = np.zeros((k - 1, d)), -math.inf

    def ll(b):
        p = softmax(np.column_stack([x @ b.reshape(k - 1, d).T, np.zeros(len(x))]))
        return float((assigned * np.log(np.maximum(p @ error.T, 1e-300))).sum())

    for _ in range(rounds):
        p = softmax(np.column_stack([x @ beta.T, np.zeros(len(x))]))
        joint = p[:, None, :] * error[None, :, :]  # rows x assigned x true
        post = joint / np.maximum(joint.sum(axis=2, keepdims=True), 1e-300)
        beta, _ = fit_mnl(x, (assigned[:, :, None] * post).sum(axis=1))
        now = ll(beta)
        if now - last < tol * (1 + abs(now)):
            break
        last = now

    def score(b):
        p = softmax(np.column_stack([x @ b.reshape(k - 1, d).T, np.zeros(len(x))]))
        joint = p[:, None, :] * error[None, :, :]
        expected = (assigned[:, :, None] * joint / np.maximum(joint.sum(axis=2, keepdims=True), 1e-300)).sum(axis=1)
        return ((expected - assigned.sum(axis=1, keepdims=True) * p)[:, : k - 1].T @ x).ravel()

    beta = _newton_finish(ll, score, beta.ravel()).reshape(k - 1, d)
    return beta, inverse(-hessian(ll, beta.ravel()))


def ml_outcome(scored: DataFrame, outcome: str, k: int, *, assignment: str = "modal", weight: str | None = None, rounds: int = 500, tol: float = 1e-9) -> pd.DataFrame:
    """Class shares of a categorical outcome by maximum likelihood over the error table: class, category, proportion."""
    w, p = _w(weight), [F.col("posterior")[c] for c in range(k)]
    own = [(F.col("class") == s + 1).cast("double") for s in range(k)] if assignment == "modal" else p
    # one aggregation gives both the counts and, over all categories and rows without one, the error table
    pairs = [(s, t) for s in range(k) for t in range(k)]
    by = scored.where(F.col("class").isNotNull()).groupBy(F.col(outcome).cast("string").alias("category")).agg(*(F.sum(w * own[s]).alias(f"a{s}") for s in range(k)), *(F.sum(w * own[s] * p[t]).alias(f"d{s}_{t}") for s, t in pairs)).toPandas()
    error = _error_table(by[[f"d{s}_{t}" for s, t in pairs]].sum(), k)
    by = by[by["category"].notna()].sort_values("category", ignore_index=True)
    n = by[[f"a{s}" for s in range(k)]].to_numpy()  # categories x assigned
    pi, rho, last = np.full(k, 1 / k), np.repeat((n.sum(axis=1) / n.sum())[:, None], k, axis=1) + np.linspace(0, 1e-3, k)[None, :], -math.inf
    rho /= rho.sum(axis=0)
    rho = np.abs(n @ pinv(error).T) + 1e-9
    pi, rho = rho.sum(axis=0) / rho.sum(), rho / rho.sum(axis=0)
    for _ in range(rounds):
        joint = pi[None, None, :] * rho[:, None, :] * error[None, :, :]
        total = joint.sum(axis=2, keepdims=True)
        now = float((n * np.log(np.maximum(total[:, :, 0], 1e-300))).sum())
        m = (n[:, :, None] * joint / np.maximum(total, 1e-300)).sum(axis=1)
        pi, rho = m.sum(axis=0) / m.sum(), m / np.maximum(m.sum(axis=0), 1e-300)
        if now - last < tol * (1 + abs(now)):
            break
        last = now
    return pd.DataFrame([(c + 1, v, rho[i, c]) for c in range(k) for i, v in enumerate(by["category"])], columns=["class", "category", "proportion"])


def two_step_arrays(x: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance of a class regression given each row's densities f (rows x classes, up to a factor) and weight n."""
    k, d = f.shape[1], x.shape[1] - 1
    beta = np.zeros((k - 1, d + 1))

    def ll(b):
        p = softmax(np.column_stack([x @ b.reshape(k - 1, d + 1).T, np.zeros(len(x))]))
        return float(n @ np.log(np.maximum((p * f).sum(axis=1), 1e-300)))

    last = -math.inf
    for _ in range(500):
        p = softmax(np.column_stack([x @ beta.T, np.zeros(len(x))])) * f
        r = p / p.sum(axis=1, keepdims=True)
        beta, _ = fit_mnl(x, r * n[:, None])
        now = ll(beta)
        if now - last < 1e-10 * (1 + abs(now)):
            break
        last = now

    def score(b):
        p = softmax(np.column_stack([x @ b.reshape(k - 1, d + 1).T, np.zeros(len(x))]))
        own = p * f
        return ((n[:, None] * (own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300) - p))[:, : k - 1].T @ x).ravel()

    beta = _newton_finish(ll, score, beta.ravel()).reshape(k - 1, d + 1)
    return beta, inverse(-hessian(ll, beta.ravel()))


def two_step_covariates(scored: DataFrame, columns: Sequence[str], pi: Sequence[float], *, weight: str | None = None, max_rows: int = 200_000) -> pd.DataFrame:
    """Class regression with the measurement part held: densities enter through posterior / prior, by design row and pattern."""
    k = len(pi)
    keys = [f"_f{c}" for c in range(k)]
    dens = scored.where(F.col("posterior").isNotNull()).withColumns({f: F.round(F.col("posterior")[c] / float(pi[c]), 12) for c, f in enumerate(keys)})
    table = design_table(dens, [*columns, *keys], [F.lit(1.0)], ["_n"], weight=weight, max_rows=max_rows)
    d = len(columns)
    beta, v = two_step_arrays(_design(table, d), table[[f"_x{d + c}" for c in range(k)]].to_numpy(), table["_n"].to_numpy())
    names, rows = ["(intercept)", *columns], []
    for c in range(k - 1):
        for j, t in enumerate(names):
            se = math.sqrt(max(0.0, v[c * (d + 1) + j, c * (d + 1) + j]))
            rows.append((c + 1, t, beta[c, j], se, beta[c, j] / se if se else math.nan))
    return pd.DataFrame(rows, columns=["class", "term", "estimate", "se", "z"])


def normal_equations(weighted: DataFrame, outcome: str, columns: Sequence[str], k: int, *, column: str = "posterior", weight: str | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """X'WX, X'Wy and y'Wy of each class, all in one aggregation."""
    w, y = _w(weight), F.col(outcome).cast("double")
    x = [F.lit(1.0), *(F.col(f"`{c}`").cast("double") for c in columns)]
    d, cells = len(x), []
    seen = weighted.dropna(subset=[f"`{c}`" for c in [outcome, *columns]])
    for c in range(k):
        r = w * F.col(column)[c]
        cells += [F.sum(r * x[a] * x[b]).alias(f"a{c}_{a}_{b}") for a in range(d) for b in range(a, d)] + [F.sum(r * x[a] * y).alias(f"b{c}_{a}") for a in range(d)] + [F.sum(r * y * y).alias(f"y{c}")]
    row = seen.agg(*cells).first()
    return {c + 1: (np.array([[row[f"a{c}_{min(a, b)}_{max(a, b)}"] for b in range(d)] for a in range(d)]), np.array([row[f"b{c}_{a}"] for a in range(d)]), row[f"y{c}"]) for c in range(k)}


def outcome_regression(weighted: DataFrame, outcome: str, columns: Sequence[str], k: int, *, slopes: str = "class", column: str = "bch", weight: str | None = None) -> pd.DataFrame:
    """A continuous outcome on covariates in each class: own slopes, or slopes pooled over classes."""
    eq, names = normal_equations(weighted, outcome, columns, k, column=column, weight=weight), ["(intercept)", *columns]
    rows = []
    if slopes == "class":
        for c, (a, b, yy) in eq.items():
            beta = inverse(a) @ b
            var = max(1e-5, (yy - b @ beta) / max(a[0, 0], EPS))
            se = np.sqrt(np.maximum(var * np.diag(inverse(a)), 0))
            rows += [(c, t, beta[j], se[j]) for j, t in enumerate(names)]
    else:
        d = len(columns)
        a, b = np.zeros((k + d, k + d)), np.zeros(k + d)
        for c, (aa, bb, _) in eq.items():
            at = [c - 1, *range(k, k + d)]
            a[np.ix_(at, at)] += aa
            b[at] += bb
        beta = inverse(a) @ b
        var = max(1e-5, (sum(v[2] for v in eq.values()) - b @ beta) / max(sum(v[0][0, 0] for v in eq.values()), EPS))
        se = np.sqrt(np.maximum(var * np.diag(inverse(a)), 0))
        rows = [(c + 1, "(intercept)", beta[c], se[c]) for c in range(k)] + [(None, t, beta[k + j], se[k + j]) for j, t in enumerate(columns)]
    return pd.DataFrame(rows, columns=["class", "term", "estimate", "se"])


def omnibus_wald(estimates: np.ndarray, vcov: np.ndarray) -> dict:
    """Whether all class values are equal."""
    k = len(estimates)
    c = np.hstack([np.eye(k - 1), -np.ones((k - 1, 1))])
    d, v = c @ estimates, c @ vcov @ c.T
    stat = float(d @ pinv(v) @ d)
    return {"wald_chi2": stat, "df": k - 1, "p_value": chi2_sf(stat, k - 1)}


# ---------------------------------------------------------------- surveys


def survey_meat(scores: DataFrame, columns: Sequence[str], *, stratum: str | None, psu: str) -> DataFrame:
    """row, col, value of the design-based sum of score products.

    Scores are summed by primary unit, centred in their stratum (at the grand mean where a stratum has one unit), and
    scaled by C / (C - 1): two aggregations and a broadcastable join.
    """
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    units = scores.groupBy(s.alias("_s"), F.col(psu).alias("_p")).agg(*(F.sum(c).alias(c) for c in columns))
    strata = units.groupBy("_s").agg(F.count(F.lit(1)).alias("_c"), *(F.avg(c).alias(f"_m{j}") for j, c in enumerate(columns)))
    grand = units.agg(*(F.avg(c).alias(f"_g{j}") for j, c in enumerate(columns)))
    d = [F.col(c) - F.when(F.col("_c") > 1, F.col(f"_m{j}")).otherwise(F.col(f"_g{j}")) for j, c in enumerate(columns)]
    scale = F.when(F.col("_c") > 1, F.col("_c") / (F.col("_c") - 1)).otherwise(1.0)
    pairs = [(a, b) for a in range(len(columns)) for b in range(len(columns))]
    sums = units.join(strata, "_s").crossJoin(F.broadcast(grand)).agg(*(F.sum(scale * d[a] * d[b]).alias(f"v{a}_{b}") for a, b in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(columns[a]).alias("row"), F.lit(columns[b]).alias("col"), F.col(f"v{a}_{b}").alias("value")) for a, b in pairs))).alias("r")).select("r.*")


# ---------------------------------------------------------------- two latent variables


def link_models(assigned: DataFrame, first: str, second: str, error_1: np.ndarray, error_2: np.ndarray, *, weight: str | None = None, rounds: int = 2000, tol: float = 1e-11) -> dict:
    """Transitions between the classes of two fitted models, from modal classes and their known error tables."""
    k1, k2 = len(error_1), len(error_2)
    n = np.zeros((k1, k2))
    for r in assigned.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(first, second).agg(F.sum(_w(weight)).alias("n")).collect():
        n[r[0] - 1, r[1] - 1] = r["n"]
    init, move, last = np.full(k1, 1 / k1), np.full((k1, k2), 1 / k2) + 0.01 * np.eye(k1, k2), -math.inf
    move /= move.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = (init[:, None] * move)[None, None] * error_1[:, None, :, None] * error_2[None, :, None, :]
        total = joint.sum(axis=(2, 3))
        now = float((n * np.log(np.maximum(total, 1e-300))).sum())
        m = (n / np.maximum(total, 1e-300))[:, :, None, None] * joint
        m = m.sum(axis=(0, 1))
        init, move = m.sum(axis=1) / m.sum(), m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        if now - last < tol * (1 + abs(now)):
            break
        last = now
    p = k1 - 1 + k1 * (k2 - 1)
    return {"loglik": now, "n_parameters": p, "n_obs": float(n.sum()), "bic": -2 * now + p * math.log(max(n.sum(), 1.0)), "initial": init, "transitions": move, "modal": n}


def bootstrap_covariates(scored: DataFrame, columns: Sequence[str], k: int, *, n_reps: int = 100, seed: int = 123, **how) -> pd.DataFrame:
    """Standard errors of three-step coefficients from Poisson-weighted resamples (one aggregation pass each)."""
    first, reps = add_covariates(scored, columns, k, **how), []
    for i in range(n_reps):
        u = F.rand(seed + i)
        draws = F.lit(0.0)
        total = math.exp(-1.0)
        term = total
        for n in range(1, 9):  # the Poisson(1) quantile of u
            draws = draws + F.when(u > total, 1.0).otherwise(0.0)
            term /= n
            total += term
        reps.append(add_covariates(scored.withColumn("_boot", draws), columns, k, **(how | {"weight": "_boot"}))["estimate"].to_numpy())
    b = np.stack(reps)
    return first.assign(se=b.std(axis=0, ddof=1))


def numeric_scores(case_ll, theta: np.ndarray) -> np.ndarray:
    """Case-wise scores by central differences."""
    return gradient(case_ll, theta)
