"""Fit statistics, classification quality and tests of fitted mixtures.

What runs over rows is one aggregation of scored rows (posterior array, modal class); what remains is arithmetic on K x K
tables or on the pattern table, which is small.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticore.functions.special import EPS, adjust_p, chi2_sf, gradient, imhof, logsumexp, normal_quantile, pinv, two_sided
from latticore.operators import mixture as M
from latticore.plans import patterns as P


def _weight(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1.0)


# ---------------------------------------------------------------- classification


def classification_table(scored: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """class (expected), modal_1 .. modal_K: weighted counts of posterior mass by modal class."""
    w = _weight(weight)
    cells = [F.sum(F.when(F.col("class") == m + 1, w * F.col("posterior")[c]).otherwise(0.0)).alias(f"c{c}_{m}") for c in range(k) for m in range(k)]
    row = F.array(*(F.struct(F.lit(c + 1).alias("class"), *(F.col(f"c{c}_{m}").alias(f"modal_{m + 1}") for m in range(k))) for c in range(k)))
    return scored.where(F.col("class").isNotNull()).agg(*cells).select(F.explode(row).alias("r")).select("r.*")


def classification_error_rate(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """error: the expected share of rows outside their modal class."""
    w = _weight(weight)
    return scored.where(F.col("class").isNotNull()).agg((F.sum(w * (1 - F.col("probability"))) / F.sum(w)).alias("error"))


def classification_quality(scored: DataFrame, pi: Sequence[float], weight: str | None = None) -> DataFrame:
    """class, proportion, mcap (modal share), avepp (mean posterior of the modal class) and occ (odds of correct classification)."""
    w, k = _weight(weight), len(pi)
    by = scored.where(F.col("class").isNotNull()).agg(F.sum(w).alias("n"), *(F.sum(F.when(F.col("class") == c + 1, w).otherwise(0.0)).alias(f"m{c}") for c in range(k)), *(F.sum(F.when(F.col("class") == c + 1, w * F.col("probability")).otherwise(0.0)).alias(f"p{c}") for c in range(k)))
    rows = []
    for c in range(k):
        ave = F.col(f"p{c}") / F.nullif(F.col(f"m{c}"), F.lit(0.0))
        odds = float(pi[c]) / (1 - float(pi[c])) if pi[c] < 1 else None
        rows.append(F.struct(F.lit(c + 1).alias("class"), F.lit(float(pi[c])).alias("proportion"), (F.col(f"m{c}") / F.col("n")).alias("mcap"), ave.alias("avepp"), (F.when(ave < 1, ave / (1 - ave)) / F.lit(odds)).alias("occ")))
    return by.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def entropy(scored: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """entropy and relative_entropy (held in 0..1; 1 for one class)."""
    w = _weight(weight)
    own = F.aggregate("posterior", F.lit(0.0), lambda a, p: a - p * F.log(p + EPS))
    out = scored.where(F.col("class").isNotNull()).agg(F.sum(w * own).alias("entropy"), F.sum(w).alias("n"))
    rel = F.lit(1.0) if k == 1 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("entropy") / (F.col("n") * math.log(k))))
    return out.select("entropy", rel.alias("relative_entropy"))


def class_separation(fit: M.Fit, spark) -> DataFrame:
    """For each pair of classes and item with a mean: the difference, and for continuous items in pooled standard deviations."""
    rows = []
    for e, p in zip(fit.spec.emissions(), fit.params):
        mean = p.get("mean", p.get("rate", p.get("p") if p.get("p", np.zeros(0)).ndim == 2 else None))
        if mean is None:
            continue
        for a, b in itertools.combinations(range(fit.spec.k), 2):
            for j, c in enumerate(e.items):
                d = float(mean[a, j] - mean[b, j])
                sd = math.sqrt((p["var"][a, j] + p["var"][b, j]) / 2) if "var" in p else None
                rows.append((a + 1, b + 1, c, d, d / sd if sd else None))
    return spark.createDataFrame(rows, "class_a int, class_b int, item string, difference double, d double")


def profile_shift(scored: DataFrame, items: Sequence[str], k: int, weight: str | None = None) -> DataFrame:
    """class, item, soft (posterior-weighted mean) and hard (mean of the modal class): how much assignment moves profiles."""
    w = _weight(weight)
    cells, rows = [], []
    for c in range(k):
        for j, name in enumerate(items):
            x, p, own = F.col(f"`{name}`").cast("double"), F.col("posterior")[c], F.col("class") == c + 1
            seen = x.isNotNull()
            cells += [F.sum(F.when(seen, w * p * x)).alias(f"a{c}_{j}"), F.sum(F.when(seen, w * p)).alias(f"b{c}_{j}"), F.sum(F.when(seen & own, w * x)).alias(f"x{c}_{j}"), F.sum(F.when(seen & own, w)).alias(f"y{c}_{j}")]
            rows.append(F.struct(F.lit(c + 1).alias("class"), F.lit(name).alias("item"), (F.col(f"a{c}_{j}") / F.col(f"b{c}_{j}")).alias("soft"), (F.col(f"x{c}_{j}") / F.col(f"y{c}_{j}")).alias("hard")))
    return scored.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merge_path(posterior: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """Classes merged two by two so that entropy falls most: k, merged, merge_entropy, entropy_drop, cases_merged."""
    if posterior.shape[1] < 2:
        raise ValueError("one class cannot be merged")
    xlogx = lambda p: np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0.0)
    groups = [(k + 1,) for k in range(posterior.shape[1])]
    post, rows = posterior.copy(), []
    now = -float(w @ xlogx(post).sum(axis=1))
    rows.append((post.shape[1], "", now, 0.0, 0.0))
    while post.shape[1] > 1:
        best = None
        for a, b in itertools.combinations(range(post.shape[1]), 2):
            drop = float(w @ (xlogx(post[:, a] + post[:, b]) - xlogx(post[:, a]) - xlogx(post[:, b])))
            if best is None or drop > best[0] + 1e-12:
                best = (drop, a, b)
        drop, a, b = best
        moved = float(w @ (post[:, a] + post[:, b]))
        post[:, a] += post[:, b]
        post = np.delete(post, b, axis=1)
        groups[a] += groups.pop(b)
        now -= drop
        rows.append((post.shape[1], "+".join(map(str, groups[a])), now, drop, moved))
    return pd.DataFrame(rows, columns=["k", "merged", "merge_entropy", "entropy_drop", "cases_merged"])


def merge_gains(scored: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """class_a, class_b, entropy_drop: what merging each pair of classes takes off the entropy (one aggregation)."""
    w = _weight(weight)
    xlogx = lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)
    pairs = list(itertools.combinations(range(k), 2))
    p = [F.col("posterior")[c] for c in range(k)]
    cells = [F.sum(w * (xlogx(p[a] + p[b]) - xlogx(p[a]) - xlogx(p[b]))).alias(f"g{a}_{b}") for a, b in pairs]
    rows = [F.struct(F.lit(a + 1).alias("class_a"), F.lit(b + 1).alias("class_b"), F.col(f"g{a}_{b}").alias("entropy_drop")) for a, b in pairs]
    return scored.where(F.col("class").isNotNull()).agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- absolute fit


def absolute_fit(observed: DataFrame, n_cells: int, n_params: int) -> DataFrame:
    """From patterns with o (observed) and e (expected counts): g2, x2, cressie_read, dissimilarity, df, n_cells, n_patterns.

    Cells nobody fills are closed by max(N - sum e, 0).
    """
    o, e = F.col("o"), F.col("e")
    a = observed.agg(
        F.sum(F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)).alias("g2"), F.sum((o - e) * (o - e) / e).alias("x2"), F.sum(F.when(o > 0, o * (F.pow(o / e, F.lit(2 / 3)) - 1)).otherwise(0.0)).alias("cr"),
        F.sum(F.abs(o - e)).alias("d"), F.sum(o).alias("n"), F.sum(e).alias("s"), F.count(F.lit(1)).alias("n_patterns"),
    )
    rest = F.greatest(F.col("n") - F.col("s"), F.lit(0.0))
    return a.select("g2", (F.col("x2") + rest).alias("x2"), (F.col("cr") * 2 / (2 / 3 * (2 / 3 + 1))).alias("cressie_read"), ((F.col("d") + rest) / (2 * F.col("n"))).alias("dissimilarity"), F.lit(n_cells - n_params - 1).cast("bigint").alias("df"), F.lit(n_cells).cast("bigint").alias("n_cells"), "n_patterns")


def expected_patterns(fit: M.Fit, df: DataFrame, weight: str | None = None) -> DataFrame:
    """Complete patterns of categorical items with o and e."""
    table = P.collapse(fit.coded(df).dropna(subset=[f"`{c}`" for c in fit.spec.items]), fit.spec.items, weight, names=("o", "_n"))
    n = table.agg(F.sum("o")).first()[0] or 0.0
    return replace(fit, coding={}).transform(table).select(*(f"`{c}`" for c in fit.spec.items), "o", (F.exp("loglik") * float(n)).alias("e"))


def fit_absolute(fit: M.Fit, df: DataFrame, weight: str | None = None) -> dict:
    """absolute_fit() of a categorical model, with p-values; None for other families."""
    if not all(f in ("binary", "categorical", "ordinal") for f, _ in fit.spec.blocks):
        return None
    cells = math.prod(2 if f == "binary" else fit.spec.cats[c] for f, cols in fit.spec.blocks for c in cols)
    row = absolute_fit(expected_patterns(fit, df, weight), cells, fit.n_params).first().asDict()
    return row | {"p_value": chi2_sf(row["g2"], row["df"]), "p_value_x2": chi2_sf(row["x2"], row["df"]), "p_value_cressie_read": chi2_sf(row["cressie_read"], row["df"])}


def fit_absolute_groups(fits: dict[str, M.Fit], df: DataFrame, group: str, n_params: int, weight: str | None = None) -> dict:
    """absolute_fit() over groups, each with its own model: the table of groups by patterns, whose group sizes are given."""
    spec = next(iter(fits.values())).spec
    cells = math.prod(2 if f == "binary" else spec.cats[c] for f, cols in spec.blocks for c in cols)
    parts = [expected_patterns(fit, df.where(F.col(group).cast("string") == str(g)), weight).select("o", "e") for g, fit in fits.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    row = absolute_fit(whole, cells * len(fits), n_params + len(fits) - 1).first().asDict()
    return row | {"p_value": chi2_sf(row["g2"], row["df"]) if row["df"] > 0 else math.nan}


def saturated_mar(x: np.ndarray, w: np.ndarray, levels: Sequence[Sequence[float]], *, rounds: int = 2000, tol: float = 1e-10, most: int = 100_000) -> tuple[np.ndarray, np.ndarray, float]:
    """The saturated model under missing at random: (cells, probabilities, log-likelihood) by EM on the cell grid."""
    if math.prod(map(len, levels)) > most:
        raise ValueError(f"more than {most} cells")
    cells = np.array(list(itertools.product(*levels)), float)
    fits = [np.flatnonzero(np.all(np.isnan(r) | (cells == r), axis=1)) for r in x]
    p, last = np.full(len(cells), 1 / len(cells)), -math.inf
    for _ in range(rounds):
        new, ll = np.zeros(len(cells)), 0.0
        for f, c in zip(fits, w):
            s = p[f].sum()
            ll += c * math.log(max(s, 1e-300))
            new[f] += c * p[f] / max(s, 1e-300)
        p = new / new.sum()
        if ll - last < tol * (1 + abs(ll)):
            break
        last = ll
    return cells, p, ll


def mcar_test(x: np.ndarray, w: np.ndarray, levels: Sequence[Sequence[float]]) -> dict:
    """Whether cells are missing completely at random: likelihood ratio of patterns of missingness against the saturated model."""
    cells, p, _ = saturated_mar(x, w, levels)
    mask = np.isnan(x)
    stat, df = 0.0, -(math.prod(map(len, levels)) - 1)
    for m in np.unique(mask, axis=0):
        own = (mask == m).all(axis=1)
        n = w[own].sum()
        rows, back = np.unique(np.where(mask[own], 0.0, x[own]), axis=0, return_inverse=True)
        seen = np.bincount(back.ravel(), weights=w[own])
        free = ~m
        for r, o in zip(rows, seen):
            e = n * p[np.all(cells[:, free] == r[free], axis=1)].sum()
            if o > 0 and e > 0:
                stat += 2 * o * math.log(o / e)
        df += math.prod(len(levels[j]) for j in np.flatnonzero(free)) - 1
    return {"stat": stat, "df": df, "p_value": chi2_sf(stat, df)}


def bivariate_residuals(scored: DataFrame, items: Sequence[str], probs: np.ndarray, weight: str | None = None) -> DataFrame:
    """item_a, item_b, bvr of binary items: Pearson X2 of each pair's 2 x 2 table over rows observing both (one aggregation).

    probs: K x J.
    """
    w, k = _weight(weight), len(probs)
    cells, rows = [], []
    for a, b in itertools.combinations(range(len(items)), 2):
        x, y = F.col(f"`{items[a]}`").cast("double"), F.col(f"`{items[b]}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        cells += [F.sum(F.when(both & (x == u) & (y == v), w).otherwise(0.0)).alias(f"o{a}_{b}_{u}{v}") for u in (0, 1) for v in (0, 1)]
        cells += [F.sum(F.when(both, w * F.col("posterior")[c]).otherwise(0.0)).alias(f"r{a}_{b}_{c}") for c in range(k)]
        stat = F.lit(0.0)
        for u in (0, 1):
            for v in (0, 1):
                e = F.lit(0.0)
                for c in range(k):
                    pa, pb = float(probs[c, a]), float(probs[c, b])
                    e = e + F.col(f"r{a}_{b}_{c}") * ((pa if u else 1 - pa) * (pb if v else 1 - pb))
                o = F.col(f"o{a}_{b}_{u}{v}")
                stat = stat + (o - e) * (o - e) / e
        rows.append(F.struct(F.lit(items[a]).alias("item_a"), F.lit(items[b]).alias("item_b"), stat.alias("bvr")))
    return scored.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def k_deleted_loglik(scored: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """removed (0..k) and the log-likelihood without the rows of greatest contribution; only the top k rows are ever sorted."""
    w = _weight(weight)
    total = scored.agg(F.sum(w * F.col("loglik")).alias("total"))
    top = scored.select((w * F.col("loglik")).alias("ll"), F.col("loglik").alias("_l")).orderBy(F.desc("_l"), F.desc("ll")).limit(k)
    run = top.select(F.row_number().over(Window.orderBy(F.desc("_l"), F.desc("ll"))).alias("removed"), F.sum("ll").over(Window.orderBy(F.desc("_l"), F.desc("ll")).rowsBetween(Window.unboundedPreceding, 0)).alias("off"))
    none = scored.sparkSession.createDataFrame([(0, 0.0)], "removed int, off double")
    return none.unionByName(run).crossJoin(F.broadcast(total)).select("removed", (F.col("total") - F.col("off")).alias("loglik"))


# ---------------------------------------------------------------- tests between models


def lr_test(restricted: M.Fit, full: M.Fit, scaling: tuple[float, float] | None = None) -> dict:
    """-2 times the difference of log-likelihoods; `scaling` (c of each model) divides it as under sampling weights."""
    df = full.n_params - restricted.n_params
    if df <= 0:
        raise ValueError("the full model has no more parameters")
    raw, factor = 2 * (full.loglik - restricted.loglik), 1.0
    if scaling:
        factor = (full.n_params * scaling[1] - restricted.n_params * scaling[0]) / df
    stat = raw / factor
    return {"statistic": stat, "df": df, "p_value": chi2_sf(stat, df), "ll_restricted": restricted.loglik, "ll_full": full.loglik, "params_restricted": restricted.n_params, "params_full": full.n_params, "scaled": scaling is not None, "statistic_raw": raw, "scaling_factor": factor}


def scaling_factor(fit: M.Fit, x: np.ndarray, w: np.ndarray) -> float:
    """tr(H^-1 S) / p with squared weights in the scores' sum."""
    theta = fit.free()
    s = gradient(lambda t: fit.case_logliks(x, t), theta)
    from latticore.functions.special import hessian

    h = -hessian(lambda t: float(w @ fit.case_logliks(x, t)), theta)
    return float(np.trace(pinv(h) @ (s.T @ (s * (w**2)[:, None]))) / len(theta))


def vlmr_test(restricted: M.Fit, full: M.Fit, x: np.ndarray, w: np.ndarray) -> dict:
    """Likelihood ratio against a weighted sum of chi-squares (k - 1 against k classes), with the adjusted form."""
    if len(full.free()) > 200:
        raise ValueError("more than 200 parameters")
    lr = 2 * (full.loglik - restricted.loglik)
    pieces = []
    from latticore.functions.special import hessian

    for f in (full, restricted):
        theta = f.free()
        s = gradient(lambda t, f=f: f.case_logliks(x, t), theta)
        pieces.append((s, pinv(-hessian(lambda t, f=f: float(w @ f.case_logliks(x, t)), theta))))
    (sf, hf), (sr, hr) = pieces
    b_ff, b_fr, b_rr = sf.T @ (sf * w[:, None]), sf.T @ (sr * w[:, None]), sr.T @ (sr * w[:, None])
    weights = np.linalg.eigvals(np.block([[b_ff @ hf, b_fr @ hr], [-b_fr.T @ hf, -b_rr @ hr]])).real
    df, n = full.n_params - restricted.n_params, float(w.sum())
    adjusted = lr / (1 + 1 / (df * math.log(n)))
    return {"statistic": lr, "df": df, "mean": float(weights.sum()), "sd": math.sqrt(max(0.0, 2 * float((weights**2).sum()))), "p_value": imhof(lr, weights), "adjusted": adjusted, "p_adjusted": imhof(adjusted, weights), "n": n}


def blrt(df: DataFrame, small: M.Fit, large: M.Fit, *, n_reps: int = 99, n_init: int = 5, seed: int = 1, tol: float = 1e-7) -> dict:
    """Parametric bootstrap of the likelihood ratio: a task for each replicate; p = (replicates at least as great + 1) / (R + 1)."""
    spark, n = df.sparkSession, int(round(small.n))
    shared = spark.sparkContext.broadcast((small, large.spec, n))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        small, spec, n = shared.value
        for f in frames:
            out = []
            for i in f["rep"]:
                x, w = M.simulated_patterns(small, n, seed * 1_000_003 + int(i))
                null = M.fit_table(pickle.loads(pickle.dumps(small.spec)), x, w, starts=[(small.pi, small.params)], tol=tol)
                alt = M.fit_table(pickle.loads(pickle.dumps(spec)), x, w, n_init=2 * n_init, seed=int(i), tol=tol)
                out.append(2 * (alt.loglik - null.loglik))
            yield pd.DataFrame({"diff": out})

    reps = spark.createDataFrame([(i,) for i in range(n_reps)], "rep int").repartition(min(n_reps, 64), "rep")
    null = sorted(r["diff"] for r in reps.mapInPandas(run, "diff double").collect())
    obs = 2 * (large.loglik - small.loglik)
    return {"p_value": (sum(d >= obs for d in null) + 1) / (n_reps + 1), "obs_diff": obs, "null_dist": null, "k_small": small.spec.k, "k_large": large.spec.k, "n_reps": n_reps, "n_negative": sum(d < 0 for d in null)}


def wald_test(theta: np.ndarray, vcov: np.ndarray, constraints: np.ndarray, rhs: float | np.ndarray = 0.0) -> dict:
    """Chi-square of C theta = rhs."""
    c = np.atleast_2d(constraints)
    d = c @ theta - rhs
    v = c @ vcov @ c.T
    stat, df = float(d @ pinv(v) @ d), int(np.linalg.matrix_rank(v))
    return {"wald_chi2": stat, "df": df, "p_value": chi2_sf(stat, df)}


def derived_estimates(theta: np.ndarray, vcov: np.ndarray, expressions: dict, level: float = 0.95) -> pd.DataFrame:
    """Smooth functions of the parameters with standard errors by the delta method."""
    z = normal_quantile(0.5 + level / 2)
    rows = []
    for name, f in expressions.items():
        est, g = float(f(theta)), gradient(lambda t, f=f: float(f(t)), theta)
        se = math.sqrt(max(0.0, float(g @ vcov @ g)))
        rows.append((name, est, se, est / se if se else math.nan, float(two_sided(est / se)) if se else math.nan, est - z * se, est + z * se))
    return pd.DataFrame(rows, columns=["parameter", "estimate", "se", "z", "p", "lower", "upper"])


def contrasts(estimates: Sequence[float], vcov: np.ndarray, ref: int | None = None, adjust: str = "none", level: float = 0.95, variances: Sequence[float] | None = None) -> pd.DataFrame:
    """Class means against each other (or the class `ref`), with adjusted p-values and, given variances, effect sizes d."""
    est, k, z = np.asarray(estimates, float), len(estimates), normal_quantile(0.5 + level / 2)
    pairs = [(a, b) for a in range(k) for b in range(a)] if ref is None else [(a, ref - 1) for a in range(k) if a != ref - 1]
    rows = []
    for a, b in pairs:
        d, se = est[a] - est[b], math.sqrt(max(0.0, vcov[a, a] + vcov[b, b] - 2 * vcov[a, b]))
        t = d / se if se else math.nan
        size = d / math.sqrt((variances[a] + variances[b]) / 2) if variances is not None else math.nan
        rows.append((a + 1, b + 1, d, se, d - z * se, d + z * se, t, float(two_sided(t)) if se else math.nan, size))
    out = pd.DataFrame(rows, columns=["class", "reference", "estimate", "se", "lower", "upper", "z", "p", "d"])
    return out.assign(p_adj=adjust_p(out["p"], adjust))


def skew_kurtosis(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """item, skewness, kurtosis (moments about the mean over powers of the variance, denominator n); one aggregation."""
    first = df.agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{j}") for j, c in enumerate(items)))
    rows = df.crossJoin(F.broadcast(first))
    cells, out = [], []
    for j, c in enumerate(items):
        d = F.col(f"`{c}`").cast("double") - F.col(f"m{j}")
        cells += [F.avg(F.pow(d, F.lit(float(e)))).alias(f"p{j}_{e}") for e in (2, 3, 4)]
        out.append(F.struct(F.lit(c).alias("item"), (F.col(f"p{j}_3") / F.pow(F.col(f"p{j}_2"), F.lit(1.5))).alias("skewness"), (F.col(f"p{j}_4") / F.pow(F.col(f"p{j}_2"), F.lit(2.0))).alias("kurtosis")))
    return rows.agg(*cells).select(F.explode(F.array(*out)).alias("r")).select("r.*")


def mardia(x: np.ndarray) -> dict:
    """Multivariate skewness and kurtosis; skewness by third-moment tensors, so the cost is linear in rows."""
    z = x - x.mean(axis=0)
    root = np.linalg.cholesky(np.linalg.inv(z.T @ z / len(z)))
    y = z @ root
    third = np.einsum("ni,nj,nk->ijk", y, y, y) / len(y)
    return {"skewness": float((third**2).sum()), "kurtosis": float(((y**2).sum(axis=1) ** 2).mean())}


def skew_kurtosis_test(fit: M.Fit, x: np.ndarray, *, nsim: int = 100, seed: int = 1) -> pd.DataFrame:
    """Observed Mardia statistics against those of data simulated from the model."""
    seen = mardia(x)
    sims = [mardia(M.simulate(fit, len(x), seed + i)[fit.spec.items].to_numpy()) for i in range(nsim)]
    rows = []
    for name, value in seen.items():
        v = np.array([s[name] for s in sims])
        rows.append((name, value, v.mean(), v.std(ddof=1), (np.sum(np.abs(v - v.mean()) >= abs(value - v.mean())) + 1) / (nsim + 1)))
    return pd.DataFrame(rows, columns=["statistic", "sample", "mean", "sd", "p_value"])


def local_dependence(scored: DataFrame, fit: M.Fit, weight: str | None = None) -> DataFrame:
    """class, item_a, item_b, residual_cov, residual_cor and mi (n r^2) of continuous items within classes: one aggregation."""
    (f, cols), p, w = fit.spec.blocks[0], fit.params[0], _weight(weight)
    if len(fit.spec.blocks) > 1 or not f.startswith("continuous"):
        raise ValueError("only for models of continuous items")
    cells, rows = [], []
    for k in range(fit.spec.k):
        r = w * F.col("posterior")[k]
        for a, b in itertools.combinations(range(len(cols)), 2):
            d = (F.col(f"`{cols[a]}`") - float(p["mean"][k, a])) * (F.col(f"`{cols[b]}`") - float(p["mean"][k, b]))
            at = f"{k}_{a}_{b}"
            cells += [F.sum(r * d).alias(f"s{at}"), F.sum(F.when(d.isNotNull(), r)).alias(f"n{at}")]
            cov = F.col(f"s{at}") / F.col(f"n{at}")
            cor = cov / math.sqrt(p["var"][k, a] * p["var"][k, b])
            rows.append(F.struct(F.lit(k + 1).alias("class"), F.lit(cols[a]).alias("item_a"), F.lit(cols[b]).alias("item_b"), cov.alias("residual_cov"), cor.alias("residual_cor"), (F.col(f"n{at}") * cor * cor).alias("mi")))
    return scored.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def align_classes(reference: np.ndarray, other: np.ndarray) -> list[int]:
    """The order of other's rows nearest to reference's by the sum of squared distances: exact for any number, by shortest augmenting paths."""
    cost = ((reference[:, None, :] - other[None, :, :]) ** 2).sum(axis=2)
    k = len(cost)
    of = np.full(k, -1)  # the row that a column is given to
    u, v = np.zeros(k), np.zeros(k)
    for row in range(k):
        best, before, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        i, last = row, -1
        length = 0.0
        while i >= 0:  # the nearest column by reduced costs, until one is free
            reach = length + cost[i] - u[i] - v
            nearer = ~done & (reach < best)
            best[nearer], before[nearer] = reach[nearer], last
            last = int(np.where(done, np.inf, best).argmin())
            length = best[last]
            done[last] = True
            i = int(of[last])
        reached = done & (of >= 0)
        u[of[reached]] += length - best[reached]
        u[row] += length
        v[done] -= length - best[done]
        while last >= 0:  # columns along the path change hands
            to = int(before[last])
            of[last] = of[to] if to >= 0 else row
            last = to
    return [int(np.flatnonzero(of == i)[0]) for i in range(k)]
