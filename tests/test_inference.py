"""Finishing and inference on simulated data."""

import math

import numpy as np
import pandas as pd
import pytest
from latticore.operators import growth as G
from latticore.operators import inference as I
from latticore.operators import mixture as M
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.plans import patterns as P
from pyspark.sql import functions as F

ITEMS = list("abcd")
PROB = np.array([[0.9, 0.8, 0.85, 0.2], [0.1, 0.2, 0.3, 0.9]])


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(31)
    c = (rng.random(1500) < 0.4).astype(int)
    x = (rng.random((1500, 4)) < PROB[c]) * 1.0
    x[rng.random(x.shape) < 0.04] = np.nan
    y = np.array([1.0, 3.0])[c] + rng.standard_normal(1500)
    df = spark.createDataFrame(pd.DataFrame(x, columns=ITEMS).assign(y=y, o=np.where(rng.random(1500) < np.array([0.2, 0.7])[c], "u", "v"))).replace(float("nan"), None).cache()
    f = M.fit_mixture(df, ITEMS, 2, "binary", n_init=4, tol=1e-6)
    return df, f, M.pattern_arrays(P.collapse(df, ITEMS, names=("_weight", "_rows")).toPandas(), ITEMS)


def test_polish_and_acceleration_reach_the_maximum(fitted):
    _, f, (x, w) = fitted
    for g in (I.polish(f, x, w), I.squared_em(f, x, w)):
        assert g.penalised >= f.penalised - 1e-9
        slope = np.array([(I.penalised(g, x, w, g.free() + h) - I.penalised(g, x, w, g.free() - h)) / 2e-4 for h in np.eye(len(g.free())) * 1e-4])
        assert np.abs(slope).max() < 0.05
    assert len(I.boundary(f)) == 0


def test_fit_under_missing_cells(fitted):
    df, f, (x, w) = fitted
    t = I.absolute_fit_mar(f, x, w)
    assert t["df"] == 16 - 9 - 1 and t["g2"] > 0 and t["p_value"] > 1e-4 and t["p_value_mcar"] > 1e-4
    b = I.bvr_bootstrap(df.dropna(), f, n_reps=9)
    assert len(b) == 6 and ((b["p_value"] > 0) & (b["p_value"] <= 1)).all()


def test_outcomes(fitted):
    df, f, _ = fitted
    scored = f.transform(df)
    m = I.add_outcome(scored, "y", 2)
    assert m["type"] == "continuous" and m["estimates"]["mean"].to_numpy() == pytest.approx([1, 3], abs=0.25) and m["omnibus"]["p_value"] < 1e-10
    s = I.add_outcome(scored, "o", 2)
    assert s["type"] == "categorical" and s["estimates"].query("category == 'u'")["proportion"].to_numpy() == pytest.approx([0.2, 0.7], abs=0.1)
    beta = np.array([[0.3, 1.0]])
    assert I.term_wald(beta, np.diag([0.1, 0.25]), [1])["wald_chi2"] == pytest.approx(4.0)
    assert S.classification_error(scored, 2).shape == (2, 2)


def test_chain_inference(spark):
    spec = M.Spec([("binary", ITEMS)], 2)
    true = T.with_parameters(spec, [0, 1, 2], [0.6, 0.4], [[[0.8, 0.2], [0.1, 0.9]]] * 2, [{"p": PROB}])
    rows = I.simulate_chain(true, 2500, seed=3)
    df = spark.createDataFrame(rows.drop(columns=[c for c in rows if c.startswith("status")]).assign(y=rows["status@2"] * 1.0))
    c = T.fit_lta(df, ITEMS, [0, 1, 2], 2, n_init=3)
    x, w = M.pattern_arrays(P.collapse(df, c.columns, names=("_weight", "_rows")).toPandas(), c.columns)
    e = I.chain_estimates(c, x, w, "opg")
    want = np.concatenate([true.start, np.ravel(true.moves), [PROB[k, j] for k in range(2) for j in range(4)]])
    assert len(e) == 2 + 8 + 8 and (np.abs(e["estimate"] - want) < 5 * e["se"] + 0.01).all() and (e["se"] < 0.06).all()
    assert I.lta_g2(c, x, w)["df"] == 4096 - c.n_params - 1
    means = I.lta_distal(c.transform(df), "y", 2).orderBy("class").toPandas()["mean"]
    assert means.to_numpy() == pytest.approx([1, 2], abs=0.15)
    still = I.fit_rmlca_invariant(df, ITEMS, [0, 1, 2], 2, n_init=2)
    assert still.moves == pytest.approx(np.repeat(np.eye(2)[None], 2, axis=0)) and still.loglik < c.loglik


@pytest.mark.parametrize("family", ["gaussian", "poisson", "gaussian+random"])
def test_growth_inference(spark, family):
    cols, design = [f"y{t}" for t in range(5)], G.polynomial(range(5), 1)
    extra = {"gaussian": {"var": np.full((2, 5), 0.5)}, "poisson": {}, "gaussian+random": {"psi": np.repeat(np.diag([0.5, 0.05])[None], 2, axis=0), "theta": np.full((2, 5), 0.4)}}[family]
    true = G.Growth(family, cols, design, np.array([0.6, 0.4]), np.array([[0.5, 0.3], [2.0, -0.3]]), extra, math.nan, 0, math.nan, math.nan, True)
    rows = I.simulate_growth(true, 1500, seed=4)
    e = I.growth_estimates(true, rows[cols].to_numpy(), np.ones(1500))
    assert len(e) == 4 and ((e["se"] > 0) & (e["se"] < 0.2)).all()
    df = spark.createDataFrame(rows[cols])
    assert I.growth_estimates_opg(true, df)["se"].to_numpy() == pytest.approx(I.growth_estimates(true, rows[cols].to_numpy(), np.ones(1500), "opg")["se"].to_numpy())
    g = (G.fit_gmm if family.endswith("random") else lambda *a, **k: G.fit_lcga(*a, family=family, **k))(df, cols, 2, n_init=3, tol=1e-6)
    assert g.beta == pytest.approx(true.beta, abs=0.25)
    assert true.transform(df).select(F.sum("loglik")).first()[0] <= g.loglik + 5
