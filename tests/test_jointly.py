"""Chains in groups and two latent variables: identities, recovery, and the same fits wherever the table stands."""

import numpy as np
import pandas as pd
import pytest
from latticore.operators import jointly as J
from latticore.operators import mixture as M
from latticore.operators import transition as T
from pyspark.sql import functions as F

ITEMS, TIMES = list("abc"), [0, 1, 2]
RHO = np.array([[0.9, 0.85, 0.8], [0.1, 0.2, 0.15]])


@pytest.fixture(scope="module")
def chains(spark):
    rng = np.random.default_rng(4)
    g = np.repeat([0, 1], 1500)
    s = (rng.random(3000) > np.where(g == 0, 0.7, 0.3)).astype(int)
    cols = {"grp": np.where(g == 0, "left", "right")}
    for t in TIMES:
        if t:
            s = np.where(rng.random(3000) < np.where(g == 0, 0.1, 0.35), 1 - s, s)
        for j, c in enumerate(ITEMS):
            v = (rng.random(3000) < RHO[s, j]).astype(float)
            v[rng.random(3000) < 0.03] = np.nan
            cols[f"{c}@{t}"] = v
    return spark.createDataFrame(pd.DataFrame(cols)).replace(float("nan"), None).cache()


def test_free_groups_are_separate_chains(chains):
    fit = J.fit_lta_groups(chains, ITEMS, TIMES, "grp", 2, measurement_equal=False, n_init=3, tol=1e-10)
    alone = [T.fit_lta(chains.where(F.col("grp") == g), ITEMS, TIMES, 2, n_init=3, tol=1e-10) for g in ("left", "right")]
    assert fit["loglik"] == pytest.approx(sum(c.loglik for c in alone), abs=1e-2)
    assert fit["n_params"] == sum(c.n_params for c in alone)


def test_equal_groups_are_one_chain(chains):
    start = [(np.array([0.6, 0.4]), np.full((2, 2, 2), 0.5), [{"p": np.clip(RHO, 0.2, 0.8)}])]
    fit = J.fit_lta_groups(chains, ITEMS, TIMES, "grp", 2, start_equal=True, moves_equal=True, starts=start, max_iter=30, tol=-1)
    one = T.fit_lta(chains, ITEMS, TIMES, 2, starts=start, max_iter=30, tol=-1)
    assert fit["loglik"] == pytest.approx(one.loglik, abs=1e-6) and fit["n_params"] == one.n_params
    for c in fit["groups"].values():
        assert np.allclose(c.moves, one.moves) and np.allclose(c.params[0][0]["p"], one.params[0][0]["p"])


def test_groups_differ_and_partitions_agree(chains):
    how = {"n_init": 2, "max_iter": 12, "tol": -1}
    fit = J.fit_lta_groups(chains, ITEMS, TIMES, "grp", 2, **how)
    spread = J.fit_lta_groups(chains.repartition(3), ITEMS, TIMES, "grp", 2, max_patterns=5, **how)
    assert fit["logliks"] == pytest.approx(spread["logliks"], abs=1e-5) and fit["n_params"] == spread["n_params"] == 2 + 8 + 6
    full = J.fit_lta_groups(chains, ITEMS, TIMES, "grp", 2, n_init=3)
    left, right = full["groups"]["left"], full["groups"]["right"]
    assert left.params[0][0]["p"] is right.params[0][0]["p"] or np.array_equal(left.params[0][0]["p"], right.params[0][0]["p"])
    assert np.abs(np.diagonal(left.moves, axis1=1, axis2=2) - 0.9).max() < 0.06 and np.abs(np.diagonal(right.moves, axis1=1, axis2=2) - 0.65).max() < 0.08
    scored = J.score_groups(full, chains, "grp")
    assert scored.count() == 3000 and scored.agg(F.sum("loglik")).first()[0] == pytest.approx(full["loglik"], abs=1e-4)


def test_groups_by_occasion_codes_and_refusals(chains, spark):
    how = {"n_init": 2, "max_iter": 10, "tol": -1, "invariance": "none", "measurement_equal": False}
    fit = J.fit_lta_groups(chains, ITEMS, TIMES, "grp", 2, **how)
    coded = chains.select("grp", *((F.col(f"`{c}@{t}`") + 1).alias(f"{c}@{t}") for t in TIMES for c in ITEMS))
    assert J.fit_lta_groups(coded, ITEMS, TIMES, "grp", 2, **how)["loglik"] == pytest.approx(fit["loglik"], abs=1e-8)
    assert fit["n_params"] == 2 + 8 + 2 * 3 * 6
    with_null = chains.withColumn("grp", F.when(F.col("grp") == "left", F.col("grp")))
    assert list(J.fit_lta_groups(with_null, ITEMS, TIMES, "grp", 2, n_init=1, max_iter=2, tol=-1)["groups"]) == ["left"]
    with pytest.raises(ValueError, match="groups"):
        J.fit_lta_groups(chains, ITEMS, TIMES, "grp", 2, max_groups=1)
    with pytest.raises(ValueError, match="no row"):
        J.fit_lta_groups(chains.limit(0), ITEMS, TIMES, "grp", 2)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(8)
    x = (rng.random(6000) < 0.4).astype(int)
    y = (rng.random(6000) < np.where(x == 1, 0.75, 0.2)).astype(int)
    cols = {c: (rng.random(6000) < np.where(x == 1, 0.85, 0.15)).astype(float) for c in "abcd"} | {c: (rng.random(6000) < np.where(y == 1, 0.8, 0.1)).astype(float) for c in "efgh"}
    cols["a"][rng.random(6000) < 0.05] = np.nan
    return spark.createDataFrame(pd.DataFrame(cols)).replace(float("nan"), None).cache()


def test_two_latent_recovers_and_partitions_agree(pairs):
    fit = J.fit_two_latent(pairs, "abcd", "efgh", 2, 2, n_init=3)
    assert np.abs(fit["joint"] - [[0.48, 0.12], [0.1, 0.3]]).max() < 0.03
    effect = fit["coefficients"].iloc[0]
    assert abs(effect["estimate"] - np.log(0.48 * 0.3 / (0.12 * 0.1))) < 3 * effect["se"] and 0.05 < effect["se"] < 0.2 and effect["p"] < 1e-6
    assert fit["n_params"] == 3 + 16
    spread = J.fit_two_latent(pairs.repartition(3), "abcd", "efgh", 2, 2, n_init=3, max_patterns=5)
    assert spread["loglik"] == pytest.approx(fit["loglik"], abs=1e-4) and spread["coefficients"]["se"][0] == pytest.approx(effect["se"], rel=1e-3)


def test_one_class_beside_is_a_mixture(pairs):
    start = np.clip(np.array([[0.3] * 4, [0.7] * 4]), 0, 1)
    fit = J.fit_two_latent(pairs, "abcd", "efgh", 2, 1, starts=[(np.array([[0.6], [0.4]]), [{"p": start}], [{"p": np.full((1, 4), 0.4)}])], max_iter=200, tol=1e-12)
    own = M.fit_mixture(pairs, list("abcd"), 2, "binary", starts=[(np.array([0.6, 0.4]), [{"p": start}])], max_iter=200, tol=1e-12)
    rest = M.fit_mixture(pairs, list("efgh"), 1, "binary")
    assert fit["loglik"] == pytest.approx(own.loglik + rest.loglik, abs=1e-4) and not len(fit["coefficients"])
    with pytest.raises(ValueError, match="both"):
        J.fit_two_latent(pairs, "abc", "cd", 2, 2)
    with pytest.raises(ValueError, match="no row"):
        J.fit_two_latent(pairs.limit(0), "abcd", "efgh", 2, 2)


@pytest.mark.parametrize("equal", ["means", "variances"])
@pytest.mark.parametrize("max_patterns", [100_000, 10])
def test_equal_means_or_variances_over_groups_and_occasions(spark, equal, max_patterns):
    """What is equal is equal, EM climbs, both places of fitting agree, and the true values are recovered."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(1500):
        g, s = i % 2, int(rng.random() < 0.4)
        row = [g]
        for t in range(2):
            mean = (0.0, 4.0)[s] + (0.0 if equal == "means" else g + t)
            sd = 1.0 + (0.5 * g + 0.3 * t if equal == "means" else 0.0)
            row.append(float(rng.normal(mean, sd)) if rng.random() > 0.05 else None)
            s = s if rng.random() < 0.8 else 1 - s
        out.append(tuple(row))
    df = spark.createDataFrame(out, "g int, `y@0` double, `y@1` double").repartition(3)
    how = {"measurement": "continuous", "measurement_equal": False, "invariance": "none", "equal": equal, "n_init": 1, "seed": 3, "max_patterns": max_patterns}
    start = [(np.array([0.6, 0.4]), np.array([[[0.8, 0.2], [0.2, 0.8]]]), [{"mean": np.array([[0.5], [3.5]]), "var": np.array([[1.0], [1.0]])}])]
    lls = [J.fit_lta_groups(df, ["y"], [0, 1], "g", 2, starts=start, max_iter=n, tol=-1, **how)["loglik"] for n in (2, 12)]
    fit = J.fit_lta_groups(df, ["y"], [0, 1], "g", 2, starts=start, max_iter=60, **how)
    params = [p[0] for c in fit["groups"].values() for p in c.params]
    key, other = ("mean", "var") if equal == "means" else ("var", "mean")
    assert all(np.allclose(p[key], params[0][key]) for p in params) and not np.allclose(params[0][other], params[1][other], atol=1e-3)
    assert lls[0] < lls[1] <= fit["loglik"] + 1e-6
    assert fit["n_params"] == 2 * (1 + 2) + 4 * 4 - 3 * 2
    want = np.array([0.0, 4.0]) if equal == "means" else np.array([1.0, 1.0])
    assert np.allclose(np.sort(params[0][key].ravel()), want, atol=0.3)


def test_equal_is_means_or_variances(spark):
    with pytest.raises(ValueError, match="means or variances"):
        J.fit_lta_groups(spark.createDataFrame([(1, 0.5)], "g int, `y@0` double"), ["y"], [0], "g", 1, measurement="continuous", equal="covariances")
