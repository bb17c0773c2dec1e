"""Direct effects on ordinal and binary items: derivatives, recovery, scoring, and the case that equals separate fits."""

import numpy as np
import pytest
from latticore.functions.special import gradient
from latticore.operators import direct as D
from latticore.operators import mixture as M
from pyspark.sql import functions as F


def test_pass_against_differences():
    rng = np.random.default_rng(2)
    design = D.Design(["a", "b", "c"], [3, 4, 2], ["z", "u"], 2, {0: [0], 1: [0, 1]}, True, [0], False)
    x = np.column_stack([rng.integers(1, 4, 60), rng.integers(1, 5, 60), rng.integers(1, 3, 60), rng.normal(size=60), rng.integers(0, 2, 60)]).astype(float)
    x[:5, 0] = x[3:9, 1] = x[8:12, 2] = np.nan
    w = rng.integers(1, 4, 60).astype(float)
    state = {"gamma": np.array([[0.3, -0.2]]), "free": {2: np.array([[0.3, 0.7], [0.6, 0.4]])}, "own": {0: np.array([1.0, -0.5, 0.4, -1, 0.3, -0.6]), 1: np.array([1.5, 0.2, -1, 0.7, 0, -0.7, 0.2, 0.1, -0.3, 0.5])}}
    s = D._pass(design, x, w, state)

    def at(theta):
        g, a, b, f = np.split(theta, [2, 8, 18])
        e = np.exp(np.column_stack([f, np.zeros(2)]))
        return state | {"gamma": g[None], "own": {0: a, 1: b}, "free": {2: e / e.sum(axis=1, keepdims=True)}}

    free = np.log(state["free"][2][:, 0] / state["free"][2][:, 1])
    theta = np.concatenate([state["gamma"].ravel(), state["own"][0], state["own"][1], free])
    want = gradient(lambda t: D._pass(design, x, w, at(t))["ll"], theta)
    assert np.allclose(np.concatenate([s["g:class"], s["g:0"], s["g:1"]]), want[:18], atol=1e-5)
    each = np.stack([gradient(lambda t, i=i: D._pass(design, x[i : i + 1], np.ones(1), at(t))["ll"], theta) for i in range(60)])
    assert np.allclose(s["outer"], each.T @ (each * w[:, None]), atol=1e-4)  # class, items in order
    p, _ = D.category_shares(np.array([1.0, -0.5]), np.array([0.3, -2.0]))
    assert np.allclose(p.sum(axis=1), 1)


@pytest.fixture(scope="module")
def ordinal(spark):
    """Two classes, four items of three categories; the first shifts by 0.9 z within classes, and classes depend on z."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(6000):
        z = float(rng.integers(0, 3) - 1)
        c = int(rng.random() < 1 / (1 + np.exp(-(0.2 + 0.7 * z))))
        row = [i, z]
        for j in range(4):
            tau = np.array([2.0, 0.4]) if c else np.array([-0.3, -2.2])
            up = 1 / (1 + np.exp(-(tau + (0.9 * z if j == 0 else 0))))
            u = rng.random()
            row.append(None if rng.random() < 0.03 else 1 + int(u < up[0]) + int(u < up[1]))
        out.append(tuple(row))
    return spark.createDataFrame(out, "id int, z double, a int, b int, c int, d int").repartition(3).cache()


def test_ordinal_effects_are_recovered(ordinal):
    fit = D.fit_direct_effects(ordinal, list("abcd"), ["z"], 2, effects={"a": ["z"], "b": ["z"]}, n_init=4)
    e = fit.estimates.set_index(["part", "item", "class", "term"])
    effect = e.loc[("effect", "a", "all", "z")]
    assert fit.converged and abs(effect["estimate"] - 0.9) < 3.5 * effect["se"] and 0.01 < effect["se"] < 0.1
    none = e.loc[("effect", "b", "all", "z")]
    assert abs(none["estimate"]) < 3.5 * none["se"]
    high = int(np.argmax(fit.thresholds["a"][:, 0]))
    assert np.allclose(fit.thresholds["a"][high], [2.0, 0.4], atol=0.35) and fit.n_params == 2 + 2 * (4 + 1) + 2 * 4
    slope = fit.gamma[0, 1] * (1 if high == 0 else -1)
    assert abs(slope - 0.7) < 0.25
    scored = fit.transform(ordinal)
    total = scored.agg(F.sum("loglik")).first()[0]
    assert total == pytest.approx(fit.loglik, rel=1e-9)
    assert scored.where(F.col("class").isNull()).count() == 0


def test_effects_of_zero_are_the_model_without(ordinal):
    """With effects on nothing but a constant covariate the fit is the plain one."""
    constant = ordinal.withColumn("z", F.lit(0.0))
    plain = M.fit_mixture(ordinal, list("abcd"), 2, "ordinal", n_init=3)
    fit = D.fit_direct_effects(constant, list("abcd"), ["z"], 2, effects={"a": ["z"]}, predictors=[], starts=[(plain.pi, plain.params)], tol=1e-11)
    assert fit.loglik == pytest.approx(plain.loglik, abs=0.5) and np.allclose(fit.slopes["a"], 0)


def test_by_class_effects_of_a_two_valued_covariate_are_two_fits(ordinal):
    """Binary items: all effects free in both halves, so each half has the likelihood of its own fit (no priors)."""
    df = ordinal.where("z <> 0").withColumns({c: F.when(F.col(c).isNotNull(), F.when(F.col(c) > 1, "yes").otherwise("no")) for c in "abcd"}).withColumn("wt", F.lit(2.0))
    items, start = list("abcd"), [(np.array([0.5, 0.5]), [{"p": np.array([[0.4] * 4, [0.8] * 4])}])]
    fit = D.fit_direct_effects(df, items, ["z"], 2, measurement="binary", by_class=True, effects={c: ["z"] for c in items}, starts=start, weight="wt", tol=1e-12, max_iter=3000)
    halves = [M.fit_mixture(df.where(F.col("z") == v), items, 2, "binary", starts=start, alpha={"latent": 0.0, "categorical": 0.0}, tol=1e-13, max_iter=5000) for v in (-1, 1)]
    assert fit.loglik == pytest.approx(2 * sum(h.loglik for h in halves), abs=1e-3)
    scored = fit.transform(df)
    assert scored.agg(F.sum(2 * F.col("loglik"))).first()[0] == pytest.approx(fit.loglik, rel=1e-8) and scored.select("a").first().a in ("yes", "no", None)


def test_refusals(ordinal):
    with pytest.raises(ValueError, match="not there"):
        D.fit_direct_effects(ordinal, list("abcd"), ["z"], 2, effects={"e": ["z"]})
    with pytest.raises(ValueError, match="ordinal or binary"):
        D.fit_direct_effects(ordinal, list("abcd"), ["z"], 2, effects={"a": ["z"]}, measurement="continuous")
