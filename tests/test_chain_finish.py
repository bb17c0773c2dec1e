"""Analytic scores and Hessians against differences, the distributed finish of chains, and binary codings in every fit."""

import itertools

import numpy as np
import pytest
from latticore.functions.special import gradient
from latticore.operators import curvature as V
from latticore.operators import extended as X
from latticore.operators import finish as FN
from latticore.operators import inference as I
from latticore.operators import jointly as J
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import threestep as TS
from latticore.operators import transition as T
from latticore.plans import patterns as P
from pyspark.sql import functions as F

FAMILIES = {
    "binary": [("binary", ["a", "b"])],
    "categorical": [("categorical", ["a"]), ("binary", ["b"])],
    "class": [("continuous:class", ["a", "b"])],
    "equal": [("continuous:equal", ["a", "b"])],
    "unit": [("continuous:unit", ["a", "b"])],
    "count": [("count", ["a"]), ("zip", ["b"])],
}


def made(kind, t_max, n=30, k=2, seed=3):
    """A spec, rows with missing cells, weights, and parameters for each occasion."""
    rng = np.random.default_rng(seed)
    spec = M.Spec(FAMILIES[kind], k, {}, {"a": 3} if kind == "categorical" else {})
    cell = {"binary": lambda: rng.integers(0, 2), "categorical": lambda: rng.integers(1, 4), "count": lambda: rng.poisson(2), "zip": lambda: rng.poisson(1)}
    of = [f for f, cols in spec.blocks for _ in cols]
    x = np.array([[float(cell.get(of[j % 2], rng.normal)()) for j in range(2 * t_max)] for _ in range(n)])
    x[rng.random(x.shape) < 0.15] = np.nan
    w = rng.integers(1, 4, n).astype(float)
    stacked = np.concatenate([x[:, 2 * t : 2 * t + 2] for t in range(t_max)])
    m = [e.marginal(b, np.ones(len(stacked))) for e, b in zip(spec.emissions(), spec.split(stacked))]
    return spec, x, w, m, lambda: [e.start(mm, rng) for e, mm in zip(spec.emissions(), m)], rng


@pytest.mark.parametrize("kind", FAMILIES)
def test_mixture_sums_against_differences(kind):
    spec, x, w, m, params, rng = made(kind, 1)
    fit = M.with_parameters(spec, np.array([0.6, 0.4]), params())
    theta, total = fit.free(), lambda t: w @ fit.case_logliks(x, t)
    s = V.mixture_sums(spec, fit.pi, fit.params, x, w)
    each = gradient(lambda t: fit.case_logliks(x, t), theta)
    assert s["ll"] == pytest.approx(total(theta)) and np.allclose(s["g"], w @ each, atol=1e-5) and np.allclose(s["outer"], each.T @ (each * w[:, None]), atol=1e-4)
    want = gradient(lambda t: V.mixture_sums(spec, *fit.at(t), x, w)["g"], theta, 1e-5)
    assert np.allclose(s["h"], want, atol=1e-4 * max(1, np.abs(want).max()))


@pytest.mark.parametrize("kind,equal,same,forbid", [("binary", True, False, False), ("categorical", False, False, True), ("class", True, True, False), ("equal", False, True, True), ("count", True, False, True)])
def test_chain_sums_against_differences(kind, equal, same, forbid):
    t_max, k = 4, 2
    spec, x, w, m, params, rng = made(kind, t_max)
    moves = np.repeat(rng.dirichlet(np.ones(k), (1, k)), 3, axis=0) if same else rng.dirichlet(np.ones(k), (3, k))
    if forbid:
        moves[:, 1] = [0.0, 1.0]
    one = params()
    chain = T.with_parameters(spec, range(t_max), np.array([0.7, 0.3]), moves, one)
    if not equal:
        chain.params = [params() for _ in range(t_max)]
    p = V.Packing(chain, same)
    theta = p.free()
    again = p.at(theta)
    assert np.allclose(again[0], chain.start) and np.allclose(again[1], moves)

    def lls(t):
        start, mv, ps = p.at(t)
        return T.forward_backward(T._emissions(spec, ps, x, t_max), start, mv)[0]

    s = p.sums(x, w, theta)
    each = gradient(lls, theta)
    assert s["ll"] == pytest.approx(w @ lls(theta)) and np.allclose(s["g"], w @ each, atol=1e-5) and np.allclose(s["outer"], each.T @ (each * w[:, None]), atol=1e-4)
    want = gradient(lambda t: p.sums(x, w, t)["g"], theta, 1e-5)
    assert np.allclose(s["h"], want, atol=1e-4 * max(1, np.abs(want).max()))
    ms = [m] if equal else [m] * t_max
    value, g, h = p.prior(theta, 1.0, ms)
    assert np.allclose(g, gradient(lambda t: p.prior(t, 1.0, ms)[0], theta), atol=1e-5)
    assert np.allclose(h, gradient(lambda t: p.prior(t, 1.0, ms)[1], theta, 1e-5), atol=1e-4)


def test_sweeps_add_up(monkeypatch):
    spec, x, w, m, params, rng = made("binary", 3)
    p = V.Packing(T.with_parameters(spec, range(3), np.array([0.5, 0.5]), rng.dirichlet(np.ones(2), (2, 2)), params()))
    whole = p.sums(x, w, p.free())
    monkeypatch.setattr(V, "SWEEP", 7)
    parts = p.sums(x, w, p.free())
    assert all(np.allclose(whole[k], parts[k]) for k in whole)


# ---------------------------------------------------------------- finish


@pytest.fixture(scope="module")
def panel_rows(spark):
    rng = np.random.default_rng(7)
    start, moves, p = np.array([0.65, 0.35]), np.array([[0.85, 0.15], [0.25, 0.75]]), np.array([[0.15, 0.2, 0.1], [0.85, 0.7, 0.9]])
    out = []
    for i in range(900):
        s, row = rng.choice(2, p=start), [i, float(rng.integers(0, 2))]
        for t in range(3):
            row += [None if rng.random() < 0.05 else int(rng.random() < q) for q in p[s]]
            s = rng.choice(2, p=moves[s])
        out.append(tuple(row))
    cols = ", ".join(f"`{n}@{t}` int" for t in range(3) for n in "abc")
    return spark.createDataFrame(out, f"id int, z double, {cols}").repartition(3).cache()


def test_finish_of_a_chain_is_em_gone_on(spark, panel_rows):
    short = T.fit_lta(panel_rows, list("abc"), range(3), 2, n_init=2, seed=2, max_iter=25, tol=-1)
    long = T.fit_lta(panel_rows, list("abc"), range(3), 2, starts=[(short.start, short.moves, short.params[0])], max_iter=6000, tol=1e-14)
    done, report = FN.finish_chain(short, panel_rows)
    assert report["gradient"] < 1e-10 and "newton" in report["kinds"] and report["steps"] < 25
    assert done.penalised >= long.penalised - 1e-7
    assert np.allclose(done.start, long.start, atol=1e-4) and np.allclose(done.moves, long.moves, atol=1e-4) and np.allclose(done.params[0][0]["p"], long.params[0][0]["p"], atol=1e-4)
    errors = FN.chain_errors(done, report, "hessian")
    x, w = M.pattern_arrays(P.collapse(panel_rows, done.columns, names=("_weight", "_rows")).toPandas(), done.columns)
    by_differences = I.chain_estimates(done, x, w, "hessian")
    assert np.allclose(errors["se"], by_differences["se"], rtol=1e-3) and np.allclose(errors["estimate"], by_differences["estimate"])


def test_finish_keeps_forbidden_moves_weights_and_codes(spark, panel_rows):
    coded = panel_rows.withColumns({f"{n}@{t}": F.when(F.col(f"`{n}@{t}`") == 1, "yes").when(F.col(f"`{n}@{t}`") == 0, "no") for n in "abc" for t in range(3)}).withColumn("wt", F.lit(2.0))
    short = T.fit_lta(panel_rows, list("abc"), range(3), 2, n_init=1, seed=2, max_iter=20, tol=-1, forbidden=[(2, 1)], transition_invariance="full")
    same = T.fit_lta(coded, list("abc"), range(3), 2, n_init=1, seed=2, max_iter=20, tol=-1, forbidden=[(2, 1)], transition_invariance="full", weight="wt")
    a, ra = FN.finish_chain(short, panel_rows, same_moves=True)
    b, rb = FN.finish_chain(short.__class__(**{**short.__dict__, "coding": same.coding}), coded, weight="wt", same_moves=True, alpha=2.0)  # twice the rows and twice the prior
    assert np.allclose(a.moves[0], a.moves[1]) and (a.moves == 0).any() and ra["gradient"] < 1e-10
    assert b.loglik == pytest.approx(2 * a.loglik, abs=0.5) and np.allclose(a.moves, b.moves, atol=5e-3)


def test_vcov_of_a_mixture_is_analytic():
    spec, x, w, m, params, rng = made("binary", 1, n=60)
    fit = M.fit_table(spec, x, w, n_init=2)
    theta = fit.free()
    h = gradient(lambda t: gradient(lambda u: w @ fit.case_logliks(x, u), t, 1e-4), theta, 1e-4)
    assert np.allclose(np.linalg.inv(fit.vcov(x, w, "hessian")), -h, atol=1e-2 * np.abs(h).max())


# ---------------------------------------------------------------- binary codings

CODES = {"0/1": (0, 1), "1/2": (1, 2), "text": ("no", "yes")}


def recoded(df, cols, low, high):
    return df.withColumns({c: F.when(F.col(f"`{c}`") == 1, F.lit(high)).when(F.col(f"`{c}`") == 0, F.lit(low)) for c in cols})


def wide_fits(df):
    items = ["a@0", "b@0", "c@0", "a@1"]
    small = {"n_init": 2, "seed": 1, "max_iter": 30}
    base = M.fit_mixture(df, items, 2, "binary", **small)
    x, w = M.pattern_arrays(P.collapse(base.coded(df), items, names=("_weight", "_rows")).toPandas(), items)
    score = lambda f: sum(r.loglik for r in f.transform(df.where(F.coalesce(*(F.col(f"`{c}`") for c in items)).isNotNull())).select("loglik").collect())
    groups = X.fit_groups(df, items, "z", 2, **small)
    return {
        "mixture": (base.loglik, score(base)), "polish": (lambda f: (f.loglik, score(f)))(I.polish(base, x, w)), "squared_em": (lambda f: (f.loglik, score(f)))(I.squared_em(base, x, w)),
        "newton": (lambda f: (f.loglik, score(f)))(FN.newton_finish_table(base, df)),
        "groups": (groups["loglik"], sum(r.loglik for g, f in groups["groups"].items() for r in f.transform(df.where(F.col("z") == g).where(F.coalesce(*(F.col(f"`{c}`") for c in items)).isNotNull())).select("loglik").collect())),
        "dif": (X.fit_dif(df, items, "z", 2, dif_items=["a@0"], n_init=1, max_iter=20)["loglik"],),
    }


def chain_fits(df):
    items, times, small = list("abc"), range(3), {"n_init": 1, "seed": 1}
    chain = T.fit_lta(df, items, times, 2, max_iter=30, **small)
    return {
        "lta": (chain.loglik, sum(r.loglik for r in chain.transform(df).select("loglik").collect())),
        "finish": (FN.finish_chain(chain, df)[0].loglik,),
        "rmlca": (T.fit_rmlca(df, items, times, 2, max_iter=30, **small).loglik,),
        "covariates": (X.fit_lta_covariates(df, items, times, 2, initial=["z"], max_iter=15, **small)["loglik"],),
        "random intercept": (X.fit_ri_lta(df, items, times, 2, n_quadrature=5, max_iter=10, **small)["loglik"],),
        "mixture of chains": (X.fit_mixture_lta(df, items, times, 2, max_iter=10, **small)["loglik"],),
        "three steps": (TS.fit_three_step_lta(df, items, times, 2, max_iter=50, **small)["loglik"],),
        "groups": (J.fit_lta_groups(df, items, times, "z", 2, max_iter=15, **small)["loglik"],),
    }


@pytest.fixture(scope="module")
def plain(panel_rows):
    return wide_fits(panel_rows), chain_fits(panel_rows)


@pytest.mark.parametrize("codes", ["1/2", "text"])
def test_every_fit_is_the_same_under_any_two_codes(panel_rows, plain, codes):
    cols = [f"{n}@{t}" for n in "abc" for t in range(3)]
    df = recoded(panel_rows, cols, *CODES[codes]).cache()
    for want, got in zip(plain, (wide_fits(df), chain_fits(df))):
        for name in want:
            assert got[name] == pytest.approx(want[name], rel=1e-9), name
            assert want[name][0] < 0
            if len(want[name]) == 2:
                assert want[name][1] == pytest.approx(want[name][0], rel=1e-6), name


# ---------------------------------------------------------------- chains with covariates


def test_covariate_pass_against_differences():
    t_max, k = 3, 2
    spec, x, w, m, params, rng = made("categorical", t_max)
    z = np.column_stack([rng.normal(size=len(x)), rng.integers(0, 2, len(x))])
    x = np.hstack([x, z])
    state = {"gamma": rng.normal(size=(1, 2)), "tau": rng.normal(size=(2, 2, 1, 3)), "params": params()}
    s = X._covariate_sums(spec, t_max, [0], [0, 1], x, w, state)

    def at(theta):
        return state | {"gamma": theta[:2].reshape(1, 2), "tau": theta[2:].reshape(2, 2, 1, 3)}

    theta = np.concatenate([state["gamma"].ravel(), state["tau"].ravel()])
    want = gradient(lambda t: X._covariate_sums(spec, t_max, [0], [0, 1], x, w, at(t))["ll"], theta)
    got = np.concatenate([s["g:start"], *(s[f"g:{t},{a}"] for t in range(2) for a in range(2))])
    assert np.allclose(got, want, atol=1e-5)
    each = np.stack([gradient(lambda t, i=i: X._covariate_sums(spec, t_max, [0], [0, 1], x[i : i + 1], np.ones(1), at(t))["ll"], theta) for i in range(len(x))])
    assert np.allclose(s["outer"][:14, :14], each.T @ (each * w[:, None]), atol=1e-4)


def test_chain_covariates_without_effect_are_the_chain_without(spark, panel_rows):
    """A covariate that says nothing leaves the likelihood nearly where it is; errors are finite, and rows without it go."""
    plain = T.fit_lta(panel_rows, list("abc"), range(3), 2, n_init=2, seed=1)
    fit = X.fit_lta_covariates(panel_rows, list("abc"), range(3), 2, initial=["z"], transition=["z"], n_init=2, seed=1, max_iter=60)
    assert 0 <= fit["loglik"] - plain.loglik < 12 and fit["n_params"] == plain.n_params + 5
    slopes = fit["coefficients"].query("term == 'z'")
    assert np.isfinite(fit["coefficients"]["se"]).all() and (slopes["estimate"].abs() < 4 * slopes["se"]).all()
    some = panel_rows.withColumn("z", F.when(F.col("id") % 3 > 0, F.col("z")))
    assert X.fit_lta_covariates(some, list("abc"), range(3), 2, initial=["z"], n_init=1, max_iter=3)["n"] == 600


def test_chain_covariates_are_recovered(spark):
    rng = np.random.default_rng(9)
    out = []
    for i in range(1500):
        z, row = float(rng.integers(0, 2)), []
        s = int(rng.random() < 1 / (1 + np.exp(-(-0.8 + 1.2 * z))))  # status 1 of (0, 1)
        for _ in range(2):
            row += [int(rng.random() < (0.9 if s else 0.1)) for _ in range(4)]
            s = int(rng.random() < ((0.8 if s else 0.15) if z == 0 else (0.8 if s else 0.6)))
        out.append((z, *row))
    df = spark.createDataFrame(out, "z double, " + ", ".join(f"`{n}@{t}` int" for t in range(2) for n in "abcd")).repartition(3)
    fit = X.fit_lta_covariates(df, list("abcd"), range(2), 2, initial=["z"], transition=["z"], n_init=2, max_iter=100)
    high = int(np.argmax(fit["params"][0]["p"][:, 0]))
    c = fit["coefficients"].set_index(["part", "from_status", "term"])
    first, move = c.loc[("initial", np.nan, "z")], c.loc[("transition", 2 - high, "z")]  # moves out of the low status
    sign = 1 if high == 0 else -1
    logit = lambda p: np.log(p / (1 - p))
    assert abs(sign * float(first["estimate"].iloc[0] if hasattr(first["estimate"], "iloc") else first["estimate"]) - 1.2) < 0.5
    assert abs(sign * float(move["estimate"].iloc[0] if hasattr(move["estimate"], "iloc") else move["estimate"]) - (logit(0.6) - logit(0.15))) < 0.7
