"""Predictors of growth factors and residuals of growth mixtures."""

import numpy as np
import pandas as pd
import pytest
from latticore.operators import growth as G
from latticore.operators import inference as I
from pyspark.sql import functions as F

COLS = ["y1", "y2", "y3", "y4"]
SLOPES = np.array([0.8, -0.3])


@pytest.fixture(scope="module")
def curves(spark):
    rng = np.random.default_rng(21)
    n, t = 2400, np.arange(4.0)
    c = (rng.random(n) < 0.4).astype(int)
    z = rng.integers(-2, 3, n).astype(float)
    b = np.array([[0.0, 1.0], [6.0, -0.5]])[c] + z[:, None] * SLOPES + rng.standard_normal((n, 2)) * [0.8, 0.3]
    y = b[:, :1] + b[:, 1:] * t + rng.standard_normal((n, 4)) * np.array([0.5, 1.0])[c][:, None]
    y[rng.random(y.shape) < 0.05] = np.nan
    return spark.createDataFrame(pd.DataFrame({**{k: y[:, i] for i, k in enumerate(COLS)}, "z": z})).replace(float("nan"), None).cache()


def test_slopes_are_found(curves, spark):
    fit = G.fit_gmm(curves, COLS, 2, predictors=["z"], n_init=3, tol=1e-7)
    assert fit.extra["slopes"][0, :, 0] == pytest.approx(SLOPES, abs=0.06) and np.array_equal(fit.extra["slopes"][0], fit.extra["slopes"][1])
    assert fit.beta == pytest.approx(np.array([[0, 1], [6, -0.5]]), abs=0.2) and fit.n_params == 1 + 4 + 3 + 4 + 2
    plain = G.fit_gmm(curves, COLS, 2, n_init=3, tol=1e-7)
    own = G.fit_gmm(curves, COLS, 2, predictors=["z"], by_class=True, n_init=3, tol=1e-7)
    assert plain.loglik < fit.loglik - 500 and fit.loglik - 1e-3 <= own.loglik and own.n_params == fit.n_params + 2
    scored = fit.transform(curves)
    assert scored.agg(F.sum("loglik")).first()[0] == pytest.approx(fit.loglik, abs=1e-3)
    spread = G.fit_gmm(curves.repartition(3), COLS, 2, predictors=["z"], n_init=3, tol=1e-7, max_patterns=50)
    assert spread.loglik == pytest.approx(fit.loglik, abs=1e-3)
    table = I.growth_estimates_opg(fit, curves)
    assert list(table["term"][4:]) == ["z", "z"] and list(table["class"][4:]) == [0, 0] and (table["se"][4:] < 0.05).all() and (table["se"] > 0).all()
    with pytest.raises(ValueError, match="predictors"):
        I.simulate_growth(fit, 5)
    with pytest.raises(ValueError, match="gaussian"):
        G.fit_gmm(curves, COLS, 2, predictors=["z"], random_effects="none")


def test_one_class_is_generalised_least_squares(curves):
    fit = G.fit_gmm(curves, COLS, 1, predictors=["z"], random_effects="intercept", tol=1e-13, max_iter=4000)
    f = curves.toPandas()
    x = np.vander(np.arange(4.0), 2, increasing=True)
    h, g = np.zeros((4, 4)), np.zeros(4)
    for row in f[[*COLS, "z"]].to_numpy(float):
        seen = ~np.isnan(row[:4])
        if seen.any():
            d = np.concatenate([x[seen], x[seen] * row[4]], axis=1)
            v = np.linalg.inv(fit.extra["psi"][0, 0, 0] + np.diag(fit.extra["theta"][0][seen]))
            h, g = h + d.T @ v @ d, g + d.T @ v @ row[:4][seen]
    assert np.concatenate([fit.beta[0], fit.extra["slopes"][0, :, 0]]) == pytest.approx(np.linalg.solve(h, g), abs=1e-4)


def test_residuals(curves):
    how = {"n_init": 3, "tol": 1e-7, "predictors": ["z"]}
    free = G.fit_gmm(curves, COLS, 2, residual="constant", residual_equal=False, **how)
    assert np.sqrt(free.extra["theta"]) == pytest.approx(np.repeat([[0.5], [1.0]], 4, axis=1), abs=0.12) and free.n_params == 1 + 4 + 3 + 2 + 2
    flat = G.fit_gmm(curves, COLS, 2, residual="constant", **how)
    assert np.ptp(flat.extra["theta"]) == 0 and flat.loglik < free.loglik and flat.n_params == free.n_params - 1
    with_gaps = curves.withColumn("z", F.when(F.rand(3) > 0.1, F.col("z")))
    assert G.fit_gmm(with_gaps, COLS, 1, predictors=["z"], max_iter=3).n < 2400
    with pytest.raises(ValueError, match="residual"):
        G.fit_gmm(curves, COLS, 2, residual="other")
