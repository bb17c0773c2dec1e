"""The engine on simulated data of known structure: recovery, identities and invariances."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from latticore.functions import special as Z
from latticore.operators import diagnostics as D
from latticore.operators import emissions as E
from latticore.operators import extended as X
from latticore.operators import growth as G
from latticore.operators import mixture as M
from latticore.operators import report as R
from latticore.operators import structural as S
from latticore.operators import threestep as TS
from latticore.operators import transition as T
from latticore.plans import patterns as P
from latticore.sources import panel
from latticore.streaming import scoring
from pyspark.sql import functions as F

ITEMS = list("abcde")
PROB = np.array([[0.9, 0.8, 0.1, 0.2, 0.9], [0.1, 0.2, 0.8, 0.9, 0.1], [0.5, 0.9, 0.9, 0.1, 0.1]])
SHARE = [0.5, 0.3, 0.2]


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols)).replace(float("nan"), None)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    c = rng.choice(3, 4000, p=SHARE)
    x = (rng.random((4000, 5)) < PROB[c]).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    g = np.array([[0, 0], [3, 1], [-2, 4.0]])[c] + rng.standard_normal((4000, 2))
    n = rng.poisson(np.array([1, 4, 9])[c]).astype(float)
    z = (rng.random(4000) < np.array([0.2, 0.5, 0.8])[c]).astype(float)
    y = np.array([10.0, 12.0, 15.0])[c] + rng.standard_normal(4000)
    return {"c": c, "x": x, "g": g, "n": n, "z": z, "y": y}


@pytest.fixture(scope="module")
def df(spark, data):
    return frame(spark, **{k: data["x"][:, j] for j, k in enumerate(ITEMS)}, g=data["g"][:, 0], h=data["g"][:, 1], n=data["n"], z=data["z"], y=data["y"]).cache()


@pytest.fixture(scope="module")
def lca(df):
    return M.fit_mixture(df, ITEMS, 3, "binary", n_init=6)


# ---------------------------------------------------------------- functions


def test_special_functions():
    assert Z.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert Z.chi2_sf(100, 80) == pytest.approx(0.06457036, rel=1e-6)
    assert Z.chi2_sf(0, 3) == 1.0 and math.isnan(Z.chi2_sf(1, 0))
    assert Z.imhof(7.0, [1, 2, 0.5]) == pytest.approx(0.12001, abs=5e-4)
    assert float(Z.normal_cdf(1.959964)) == pytest.approx(0.975, abs=1e-6)
    assert Z.adjust_p([0.01, 0.02, 0.03], "BH").tolist() == pytest.approx([0.03, 0.03, 0.03])
    assert Z.adjust_p([0.03, 0.01, 0.02], "holm").tolist() == pytest.approx([0.04, 0.03, 0.04])
    x, w = Z.gauss_hermite(9)
    assert w.sum() == pytest.approx(1) and (w * x**4).sum() == pytest.approx(3) and Z.gauss_hermite(1)[0].tolist() == [0.0]
    assert Z.bfgs(lambda v: (v[0] - 1) ** 2 + 10 * (v[1] - v[0] ** 2) ** 2, np.array([-1.0, 1.0])) == pytest.approx([1, 1], abs=1e-4)
    assert Z.inverse(np.array([[4.0, 2e5], [2e5, 2e10]])) @ np.array([[4.0, 2e5], [2e5, 2e10]]) == pytest.approx(np.eye(2), abs=1e-6)


# ---------------------------------------------------------------- ingestion


def test_panels(spark):
    long = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 1.0, 2), (1, 2, 5.0, 3), (2, 2, 7.0, 4)], "id int, t int, v double, seq int")
    wide = panel.long_to_wide(long, id="id", time="t", items=["v"], order="seq")
    assert sorted(map(tuple, wide.collect())) == [(1, 0.0, 5.0), (2, None, 7.0)]
    stacked = panel.stack_occasions(wide, ["v"], [1, 2], ["id"])
    assert sorted(map(tuple, stacked.collect()), key=str) == sorted([(1, 1, 1, 0.0), (1, 2, 2, 5.0), (2, 1, 1, None), (2, 2, 2, 7.0)], key=str)
    miss = panel.wave_missing(wide, ["v"], [1, 2]).orderBy("id").collect()
    assert [(r["missing@1"], r["missing@2"]) for r in miss] == [(False, False), (True, False)]
    assert panel.drop_empty(wide, ["v@1"]).count() == 1
    item_major = spark.createDataFrame([(1, 2, 3, 4)], "a1 int, a2 int, b1 int, b2 int")
    assert tuple(panel.wide_to_panel(item_major, ["a1", "a2", "b1", "b2"], ["a", "b"], [1, 2], "item_major").first()) == (1, 3, 2, 4)


def test_specs_and_guards(spark, df):
    assert panel.measurement_hint(df, ["a", "g", "n"]) == {"a": "binary", "g": "continuous", "n": "count"}
    with pytest.raises(ValueError, match="must be given"):
        panel.normalize_measurement(["a"], None)
    with pytest.raises(ValueError, match="two families"):
        panel.normalize_measurement(["a", "b"], {"binary": ["a"], "count": ["a", "b"]})
    with pytest.raises(ValueError):
        panel.recode_binary(df, ["n"])
    with pytest.raises(ValueError):
        panel.check_counts(df, ["g"])
    with pytest.raises(ValueError):
        M.fit_mixture(df, ["a"], 0, "binary")
    coded, how = panel.recode_binary(spark.createDataFrame([("no",), ("yes",), (None,)], "v string"), ["v"])
    assert [r.v for r in coded.collect()] == [0, 1, None] and how == {"v": ("no", "yes")}
    w = panel.rescale_weights(spark.createDataFrame([(1.0,), (3.0,)], "w0 double"), "w0").collect()
    assert [r.w for r in w] == [0.5, 1.5]
    with pytest.raises(ValueError):
        panel.rescale_weights(spark.createDataFrame([(-1.0,)], "w0 double"), "w0")


def test_imputation_is_the_conditional_mean(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal(400)
    b = 2 * a + rng.standard_normal(400)
    got = panel.impute_conditional_means(frame(spark, i=np.arange(400), a=a, b=np.where(np.arange(400) < 50, np.nan, b)), ["a", "b"]).orderBy("i").toPandas()
    slope = np.cov(a[50:], b[50:])[0, 1] / (np.var(a, ddof=1) + 1e-6)
    assert got["b"][:50].to_numpy() == pytest.approx(b[50:].mean() + slope * (a[:50] - a.mean()), abs=1e-6)


def test_patterns(spark, df):
    table = P.collapse(df, ITEMS)
    assert table.agg(F.sum("w"), F.sum("n")).first()[:] == (4000.0, 4000) and table.count() <= 3**5
    back = P.expand(df, table, ITEMS, ["n"])
    assert back.count() == 4000 and back.where("n is null").isEmpty()
    assert P.worth_collapsing(df, ITEMS) and not P.worth_collapsing(df, ["g"])


# ---------------------------------------------------------------- families

FAMILIES = ["binary", "categorical", "continuous:class", "continuous:equal", "continuous:unit", "count", "zip", "negbin"]


@pytest.mark.parametrize("family", FAMILIES)
def test_family(spark, family):
    rng = np.random.default_rng(5)
    c = rng.integers(0, 2, 300)
    x = {"binary": (rng.random((300, 3)) < np.where(c, 0.8, 0.2)[:, None]) * 1.0, "categorical": 1.0 + rng.integers(0, 3, (300, 3))}.get(family)
    if x is None:
        x = rng.standard_normal((300, 3)) + 3 * c[:, None] if family.startswith("cont") else rng.poisson(np.where(c, 6, 1)[:, None], (300, 3)) * 1.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0] = np.nan
    items, w = ["u", "v", "x"], rng.uniform(0.5, 2, 300)
    spec = M.Spec([(family, items)], 2, cats=dict.fromkeys(items, 3) if family == "categorical" else {})
    e = spec.emissions()[0]
    m = [e.marginal(x, w)]
    pi, params = M._starts(spec, m, 1, 1)[0]
    assert e.loglik(x, params[0])[0].tolist() == [0.0, 0.0]  # nothing observed, nothing added
    last = -math.inf
    for _ in range(30):  # every iteration climbs the penalised likelihood
        s = M._statistics(spec, pi, params, x, w)
        value = s["ll"] + M._log_prior(spec, pi, params, m)
        assert value >= last - (1e-6 if family not in ("zip", "negbin") else 0.5)
        last = value
        pi, params = M._maximised(spec, s, m, params)
    e, p = spec.emissions()[0], params[0]
    again = e.fixed(e.free(p), p)
    assert e.loglik(x, again) == pytest.approx(e.loglik(x, p), abs=1e-6)
    halves = [M._statistics(spec, pi, params, x[a:b], w[a:b]) for a, b in ((0, 120), (120, 300))]
    both, one = M._add(*halves), M._statistics(spec, pi, params, x, w)
    assert both["ll"] == pytest.approx(one["ll"]) and both["n"] == pytest.approx(one["n"])
    scored = M.with_parameters(spec, pi, params).transform(frame(spark, i=np.arange(300), u=x[:, 0], v=x[:, 1], x=x[:, 2])).orderBy("i").toPandas()
    joint = M._joint(spec, pi, params, x)
    some = ~np.isnan(x).all(axis=1)
    assert scored["loglik"].to_numpy(float)[some] == pytest.approx(Z.logsumexp(joint)[some], abs=1e-8)
    assert scored["loglik"].isna()[~some].all() and scored["class"].isna()[0]
    for got, want in zip(e.columns(p), e.loglik(x, p).T):
        assert frame(spark, i=np.arange(300), u=x[:, 0], v=x[:, 1], x=x[:, 2]).orderBy("i").select(got.alias("l")).toPandas()["l"].to_numpy() == pytest.approx(want, abs=1e-8)
    if family == "count":
        table = frame(spark, k=np.arange(60.0)).select(E.log_factorial(F.col("k")).alias("f")).toPandas()["f"]
        assert table.to_numpy() == pytest.approx([math.lgamma(k + 1) for k in range(60)], rel=1e-12)


# ---------------------------------------------------------------- mixtures


def test_lca_recovers_classes(lca, df, data):
    assert lca.converged and lca.replicated >= 3
    assert lca.pi == pytest.approx(SHARE, abs=0.04)
    assert lca.params[0]["p"] == pytest.approx(PROB, abs=0.08)
    sizes = lca.class_sizes(df).toPandas()
    assert sizes["n_expected"].sum() == pytest.approx(4000) and sizes["n_modal"].sum() == 4000
    got = df.transform(lca.transform).agg(F.sum("loglik")).first()[0]
    assert got == pytest.approx(lca.loglik)
    assert R.report_methods(lca).startswith("A mixture model with 3 classes")


def test_partitions_give_what_tasks_give(df):
    a = M.fit_mixture(df, ["g", "h"], 3, "continuous", n_init=4, tol=1e-9)
    b = M.fit_mixture(df, ["g", "h"], 3, "continuous", n_init=4, tol=1e-9, max_patterns=100)
    assert a.loglik == pytest.approx(b.loglik, abs=1e-3) and a.params[0]["mean"] == pytest.approx(b.params[0]["mean"], abs=1e-3)


def test_mixed_families(df):
    f = M.fit_mixture(df, [*ITEMS, "g", "h", "n"], 3, {"binary": ITEMS, "continuous": ["g", "h"], "count": ["n"]}, n_init=4)
    assert f.pi == pytest.approx(SHARE, abs=0.03) and f.params[2]["rate"][:, 0] == pytest.approx([1, 4, 9], abs=0.4)


def test_weights_are_row_copies(spark):
    rng = np.random.default_rng(8)
    x, k = (rng.random((60, 4)) < 0.5) * 1.0, rng.integers(1, 5, 60)
    cols = {f"v{j}": x[:, j] for j in range(4)}
    one = M.fit_mixture(frame(spark, **cols, k=k.astype(float)), list(cols), 2, "binary", weight="k", weight_type="frequency", n_init=3)
    two = M.fit_mixture(frame(spark, **{c: np.repeat(v, k) for c, v in cols.items()}), list(cols), 2, "binary", n_init=3)
    assert one.loglik == pytest.approx(two.loglik, abs=1e-4) and one.n == two.n


def test_enumeration_and_tests(df, lca, data):
    table, fits = M.compare_mixtures(df, ITEMS, [1, 2, 3, 4], "binary", n_init=5)
    rows = table.orderBy("classes").collect()
    assert min(rows, key=lambda r: r.bic).classes == 3 and sum(r.cmp for r in rows) == pytest.approx(1) and rows[-1].bf is None
    t = D.lr_test(fits[2], fits[3])
    assert t["df"] == 6 and t["p_value"] < 1e-10
    with pytest.raises(ValueError):
        D.lr_test(fits[3], fits[2])
    b = D.blrt(df.limit(600), *(M.fit_mixture(df.limit(600).dropna(), ITEMS, k, "binary", n_init=4) for k in (1, 2)), n_reps=9, n_init=1, tol=1e-5)
    assert b["p_value"] == pytest.approx(0.1) and len(b["null_dist"]) == 9
    pt = P.collapse(df, ITEMS, names=("_weight", "_rows")).toPandas()
    x, w = M.pattern_arrays(pt, ITEMS)
    v = D.vlmr_test(fits[1], fits[2], x, w)
    assert v["df"] == 6 and v["p_value"] < 0.001 and v["adjusted"] < v["statistic"]
    est = fits[3].measurement_estimates(x, w)
    assert len(est) == 15 and (est["se"] > 0).all() and (est["se"] < 0.2).all()
    c = R.confint(fits[3], x, w)
    assert ((c["lower"] <= c["estimate"]) & (c["estimate"] <= c["upper"])).all()


def test_degenerate_start_is_known():
    x = np.concatenate([np.zeros(50), np.random.default_rng(0).normal(5, 1, 50)])[:, None]
    spec = M.Spec([("continuous:class", ["v"])], 2)
    res = {"pi": np.array([0.5, 0.5]), "params": [{"mean": np.array([[0.0], [5.0]]), "var": np.array([[1e-6], [1.0]])}]}
    assert M.degenerate(spec, res, x, np.ones(100))


def test_simulate_and_refit(lca, spark):
    s = M.simulate(lca, 5000, seed=2)
    f = M.fit_mixture(spark.createDataFrame(s), ITEMS, 3, "binary", n_init=4)
    assert f.params[0]["p"] == pytest.approx(lca.params[0]["p"], abs=0.08)


# ---------------------------------------------------------------- diagnostics


def test_classification(lca, df):
    scored = lca.transform(df)
    t = D.classification_table(scored, 3).toPandas().set_index("class").to_numpy()
    assert t.sum() == pytest.approx(4000) and t.sum(axis=1) / 4000 == pytest.approx(lca.pi, abs=0.01)
    q = D.classification_quality(scored, lca.pi).toPandas()
    assert (q["avepp"] > 0.7).all() and (q["occ"] > 3).all()
    assert 0.4 < D.entropy(scored, 3).first().relative_entropy < 1
    post = np.stack(scored.select("posterior").toPandas()["posterior"].to_numpy())
    path = D.merge_path(post, np.ones(len(post)))
    assert path["k"].tolist() == [3, 2, 1] and path["merge_entropy"].iloc[-1] == pytest.approx(0, abs=1e-6)
    gains = D.merge_gains(scored, 3).toPandas()
    assert gains["entropy_drop"].max() == pytest.approx(path["entropy_drop"].iloc[1], rel=1e-9)
    with pytest.raises(ValueError):
        D.merge_path(np.ones((3, 1)), np.ones(3))


def test_absolute_fit_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((500, 3)) < 0.5) * 1.0
    f = M.fit_mixture(frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2]), list("abc"), 1, "binary")
    got = D.fit_absolute(f, frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2]))
    p, g2 = f.params[0]["p"][0], 0.0
    for cell in itertools.product((0, 1), repeat=3):
        o = (x == cell).all(axis=1).sum()
        e = 500 * np.prod(np.where(cell, p, 1 - p))
        g2 += 2 * o * math.log(o / e) if o else 0
    assert got["g2"] == pytest.approx(g2) and got["df"] == 4 and 0 <= got["p_value"] <= 1


def test_mcar(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((3000, 2)) < 0.5) * 1.0
    random, not_random = x.copy(), x.copy()
    random[rng.random(3000) < 0.3, 1] = np.nan
    not_random[(x[:, 0] == 1) & (rng.random(3000) < 0.6), 1] = np.nan
    ones = np.ones(3000)
    assert D.mcar_test(random, ones, [[0, 1]] * 2)["p_value"] > 0.001
    assert D.mcar_test(not_random, ones, [[0, 1]] * 2)["p_value"] < 1e-6


def test_wald_contrasts_and_moments(spark):
    w = D.wald_test(np.array([1.0, 2.0]), np.diag([0.25, 0.25]), np.eye(2))
    assert w["wald_chi2"] == pytest.approx(20) and w["df"] == 2
    c = D.contrasts([1.0, 3.0], np.diag([0.5, 0.5]), ref=1, adjust="holm")
    assert c["estimate"].tolist() == [2.0] and c["z"].tolist() == [2.0]
    d = D.derived_estimates(np.array([2.0]), np.array([[0.01]]), {"square": lambda t: t[0] ** 2})
    assert d["se"].tolist() == pytest.approx([0.4])
    v = np.random.default_rng(0).exponential(1, 500)
    got = D.skew_kurtosis(frame(spark, v=v), ["v"]).first()
    s = v - v.mean()
    assert got.skewness == pytest.approx((s**3).mean() / (s**2).mean() ** 1.5)
    m = D.mardia(np.random.default_rng(1).standard_normal((4000, 2)))
    assert m["kurtosis"] == pytest.approx(8, abs=0.6) and m["skewness"] < 0.1
    assert D.align_classes(np.array([[0.0], [1.0], [2.0]]), np.array([[2.1], [0.1], [1.1]])) == [1, 2, 0]


# ---------------------------------------------------------------- structural


def test_three_steps(lca, df):
    scored = lca.transform(df).cache()
    e = S.classification_error(scored, 3)
    assert e.sum(axis=0) == pytest.approx(np.ones(3)) and (np.diag(e) > 0.6).all()
    true = [math.log(a * b / (0.2 * c)) for a, b, c in ((0.5, 0.8, 0.2), (0.3, 0.5, 0.5))]  # log odds at z = 0 against class 3
    for how in ({"correction": "ML"}, {"correction": "BCH"}, {"correction": "ML", "assignment": "modal"}):
        t = S.add_covariates(scored, ["z"], 3, **how).set_index(["class", "term"])["estimate"]
        slopes = [t[1, "z"], t[2, "z"]]
        assert slopes == pytest.approx([math.log((0.2 / 0.8) / (0.8 / 0.2)), math.log((0.5 / 0.5) / (0.8 / 0.2))], abs=0.5)
    naive = S.add_covariates(scored, ["z"], 3, correction="none").set_index(["class", "term"])["estimate"]
    assert abs(naive[1, "z"]) < abs(slopes[0])
    two = S.two_step_covariates(scored, ["z"], lca.pi).set_index(["class", "term"])["estimate"]
    assert two[1, "z"] == pytest.approx(slopes[0], abs=0.4) and len(true) == 2
    with pytest.raises(ValueError):
        S.add_covariates(scored, ["z"], 3, correction="other")


def test_distal_outcomes(lca, df):
    scored = S.with_bch_weights(lca.transform(df), S.classification_error(lca.transform(df), 3))
    m = S.distal_means(scored, "y", 3).orderBy("class").toPandas()
    assert m["mean"].to_numpy() == pytest.approx([10, 12, 15], abs=0.35) and m["variance"].nunique() == 1
    v = S.distal_vcov(scored, "y", m["mean"])
    assert S.omnibus_wald(m["mean"].to_numpy(), v)["p_value"] < 1e-10
    shares = S.ml_outcome(lca.transform(df).withColumn("o", F.col("z").cast("int")), "o", 3)
    assert shares[shares["category"] == "1"]["proportion"].to_numpy() == pytest.approx([0.2, 0.5, 0.8], abs=0.12)
    pooled = S.outcome_regression(scored, "y", ["z"], 3, slopes="pooled")
    assert abs(pooled.iloc[-1]["estimate"]) < 0.4


def test_mnl_gradient_is_the_numerical_one():
    rng = np.random.default_rng(2)
    x, n = np.column_stack([np.ones(20), rng.standard_normal(20)]), rng.random((20, 3))
    b = rng.standard_normal(4)
    v, g, h = S.mnl_score(b, x, n)
    assert g == pytest.approx(Z.gradient(lambda t: S.mnl_score(t, x, n)[0], b), abs=1e-5)
    assert h == pytest.approx(Z.gradient(lambda t: S.mnl_score(t, x, n)[1], b), abs=1e-5)


def test_survey_meat_of_single_units(spark):
    rows = [("s1", 1, 1.0), ("s1", 2, 3.0), ("s2", 3, 5.0)]
    got = S.survey_meat(spark.createDataFrame(rows, "st string, psu int, u double"), ["u"], stratum="st", psu="psu").first().value
    assert got == pytest.approx(2 * ((1 - 2) ** 2 + (3 - 2) ** 2) + (5 - 3) ** 2)


# ---------------------------------------------------------------- chains

START, MOVES = np.array([0.6, 0.4]), np.array([[[0.8, 0.2], [0.1, 0.9]]] * 2)
RHO = np.array([[0.9, 0.8, 0.85, 0.2], [0.1, 0.2, 0.3, 0.9]])


@pytest.fixture(scope="module")
def chains():
    rng = np.random.default_rng(11)
    s = np.zeros((2000, 3), int)
    s[:, 0] = rng.random(2000) < 0.4
    for t in (1, 2):
        s[:, t] = rng.random(2000) < MOVES[0][s[:, t - 1], 1]
    x = np.concatenate([rng.random((2000, 4)) < RHO[s[:, t]] for t in range(3)], axis=1).astype(float)
    x[rng.random(x.shape) < 0.03] = np.nan
    return s, x


def wide(spark, x, items=4):
    return frame(spark, **{f"i{j}@{t}": x[:, t * items + j] for t in range(x.shape[1] // items) for j in range(items)})


@pytest.mark.parametrize(("k", "t_max"), [(2, 1), (2, 4), (3, 3)])
def test_forward_backward_against_paths(k, t_max):
    rng = np.random.default_rng(k * 10 + t_max)
    lb, start, moves = rng.normal(-3, 2, (7, t_max, k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), (t_max - 1, k))
    lb[0] -= 800  # would underflow without scaling
    ll, gamma, xi = T.forward_backward(lb, start, moves)
    assert ll == pytest.approx(T.path_enumeration(lb, start, moves))
    assert gamma.sum(axis=2) == pytest.approx(np.ones((7, t_max)))
    if t_max > 1:
        assert xi.sum(axis=3) == pytest.approx(gamma[:, :-1])
    best = T.viterbi(lb, start, moves)
    for i in range(7):
        score = {q: np.log(start[q[0]]) + sum(np.log(moves[t, q[t], q[t + 1]]) for t in range(t_max - 1)) + sum(lb[i, t, q[t]] for t in range(t_max)) for q in itertools.product(range(k), repeat=t_max)}
        assert score[tuple(best[i])] == pytest.approx(max(score.values()))
    same = X.forward_backward_rows(lb, np.repeat(start[None], 7, axis=0), np.repeat(moves[:, None], 7, axis=1))
    assert same[0] == pytest.approx(ll) and same[1] == pytest.approx(gamma)


def test_lta_recovers_the_chain(spark, chains):
    s, x = chains
    df = wide(spark, x)
    c = T.fit_lta(df, [f"i{j}" for j in range(4)], [0, 1, 2], 2, n_init=4)
    assert c.start == pytest.approx(START, abs=0.04) and c.moves == pytest.approx(MOVES, abs=0.06) and c.params[0][0]["p"] == pytest.approx(RHO, abs=0.04)
    assert c.n_params == 1 + 4 + 8
    scored = c.transform(df, "viterbi")
    got = np.stack(scored.select("statuses").toPandas()["statuses"].to_numpy()) - 1
    assert (got == s).mean() > 0.9
    assert T.transition_counts(c, df).agg(F.sum("count")).first()[0] == pytest.approx(2 * 2000)
    assert c.transition_patterns(spark).agg(F.sum("proportion")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError, match="10000"):
        T.with_parameters(c.spec, range(14), START, np.repeat(MOVES[:1], 13, axis=0), c.params[0]).transition_patterns(spark)
    closed = T.fit_lta(df, [f"i{j}" for j in range(4)], [0, 1, 2], 2, n_init=2, forbidden=[(2, 1)], transition_invariance="full")
    assert (closed.moves[:, 1, 0] == 0).all() and closed.n_params == 1 + 1 + 8 and closed.moves[0] == pytest.approx(closed.moves[1])
    with pytest.raises(ValueError):
        T.fit_lta(df, [f"i{j}" for j in range(4)], [0, 1, 2], 2, forbidden=[(1, 1), (1, 2)])


def test_chain_over_partitions_is_the_chain_over_patterns(spark, chains):
    df = wide(spark, chains[1]).repartition(3)
    a, b = (T.fit_lta(df, [f"i{j}" for j in range(4)], [0, 1, 2], 2, n_init=4, tol=1e-7, max_patterns=m) for m in (100_000, 10))
    assert a.loglik == pytest.approx(b.loglik, abs=0.05) and a.moves == pytest.approx(b.moves, abs=5e-3) and a.n_params == b.n_params


def test_chain_extensions(spark, chains):
    s, x = chains
    rng = np.random.default_rng(12)
    items = [f"i{j}" for j in range(4)]
    three = TS.fit_three_step_lta(wide(spark, x), items, [0, 1, 2], 2, n_init=3)
    order = np.argsort(-three["params"][0]["p"][:, 0])
    assert three["moves"][:, order][:, :, order] == pytest.approx(MOVES, abs=0.1)
    mover = X.fit_mixture_lta(wide(spark, x), items, [0, 1, 2], 2, mover_stayer=True, n_init=2, tol=1e-6)
    assert mover["moves"][1] == pytest.approx(np.repeat(np.eye(2)[None], 2, axis=0)) and mover["loglik"] > -1e5
    u = rng.standard_normal((2000, 1))
    logits = np.log(RHO / (1 - RHO))
    y = np.concatenate([rng.random((2000, 4)) < Z.expit(logits[s[:, t]] + 1.0 * u) for t in range(3)], axis=1).astype(float)
    ri = X.fit_ri_lta(wide(spark, y), items, [0, 1, 2], 2, n_init=2, n_quadrature=9, tol=1e-6)
    assert ri["loadings"] == pytest.approx(np.ones(4), abs=0.3)
    assert len(ri["logliks"]) == 2 and ri["loglik"] == max(ri["logliks"])
    assert ri["loglik"] > T.fit_lta(wide(spark, y), items, [0, 1, 2], 2, n_init=2).loglik


def test_groups_and_direct_effects(spark):
    rng = np.random.default_rng(13)
    z = rng.integers(0, 2, 2500)
    c = (rng.random(2500) < np.where(z, 0.7, 0.3)).astype(int)
    logits = np.log(PROB[:2] / (1 - PROB[:2]))[c]
    logits[:, 2] += 1.2 * z
    y = (rng.random(logits.shape) < Z.expit(logits)) * 1.0
    df = frame(spark, **{k: y[:, j] for j, k in enumerate(ITEMS)}, z=z.astype(float), g=np.where(z, "x", "y"))
    same = X.fit_groups(df, ITEMS, "g", 2, measurement_equal=True, prevalence_equal=True, n_init=3)
    pooled = M.fit_mixture(df, ITEMS, 2, "binary", n_init=3)
    assert same["loglik"] == pytest.approx(pooled.loglik, abs=0.3) and same["n_params"] == pooled.n_params
    free = X.fit_groups(df, ITEMS, "g", 2, measurement_equal=[c for c in ITEMS if c != "c"], n_init=3)
    dif = X.fit_dif(df, ITEMS, "z", 2, dif_items=["c"], by_class=True, n_init=2)
    assert free["loglik"] == pytest.approx(dif["loglik"], abs=0.5)  # one saturated model, two ways
    assert X.fit_dif(df, ITEMS, "z", 2, dif_items=["c"], n_init=2)["effects"]["estimate"][0] == pytest.approx(1.2, abs=0.35)


# ---------------------------------------------------------------- growth

TIMES = np.arange(5)
ETA = np.array([1 + 0.2 * TIMES, 2 - 0.4 * TIMES])


@pytest.mark.parametrize("family", G.FAMILIES)
def test_lcga(spark, family):
    rng = np.random.default_rng(21)
    c = rng.choice(2, 1500, p=[0.6, 0.4])
    eta = ETA[c]
    y = {"gaussian": eta + 0.7 * rng.standard_normal(eta.shape), "poisson": rng.poisson(np.exp(eta)), "binomial": rng.random(eta.shape) < Z.expit((eta - 1.5) * 2), "zip": rng.poisson(np.exp(eta)) * (rng.random(eta.shape) > 0.3), "negbin": rng.poisson(np.exp(eta) * rng.gamma(2, 0.5, eta.shape))}[family].astype(float)
    y[rng.random(y.shape) < 0.03] = np.nan
    cols = [f"y{t}" for t in TIMES]
    df = frame(spark, **{c: y[:, t] for t, c in enumerate(cols)})
    g = G.fit_lcga(df, cols, 2, family=family, n_init=4)
    want = np.array([[1, 0.2], [2, -0.4]]) if family != "binomial" else np.array([[-1, 0.4], [1, -0.8]])
    assert g.beta == pytest.approx(want, abs=0.3) and g.pi[0] == pytest.approx(0.6, abs=0.1 if family == "binomial" else 0.06)
    ll = g.transform(df).agg(F.sum("loglik")).first()[0]
    assert ll == pytest.approx(g.loglik, rel=1e-6)


@pytest.mark.parametrize("family", ["gaussian", "negbin"])
def test_growth_over_partitions_is_growth_over_patterns(spark, family):
    rng = np.random.default_rng(23)
    eta = ETA[rng.choice(2, 600, p=[0.6, 0.4])]
    y = rng.poisson(np.exp(eta) * rng.gamma(2, 0.5, eta.shape)) * 1.0 if family == "negbin" else eta + 0.5 * rng.standard_normal(eta.shape)
    y[rng.random(y.shape) < 0.03] = np.nan
    df = frame(spark, **{f"y{t}": y[:, t] for t in TIMES}).repartition(3)
    cols = [f"y{t}" for t in TIMES]
    fit = lambda m: G.fit_lcga(df, cols, 2, family=family, n_init=1, tol=1e-7, max_iter=100, max_patterns=m)
    a, b = fit(200_000), fit(10)
    assert a.loglik == pytest.approx(b.loglik, abs=0.5) and a.beta == pytest.approx(b.beta, abs=0.1) and a.n == b.n == (~np.isnan(y).all(axis=1)).sum()


def test_random_effect_sums_add_up():
    rng = np.random.default_rng(24)
    x, w = G.polynomial(TIMES, 1), rng.uniform(0.5, 2, 300)
    y = rng.standard_normal((300, 5))
    y[rng.random(y.shape) < 0.1] = np.nan
    state = (np.array([0.6, 0.4]), ETA[:, :2].copy(), {"psi": np.repeat(np.diag([1.0, 0.1])[None], 2, axis=0), "theta": np.full((2, 5), 0.5)})
    binary = (state[0], state[1], {"sd": np.array([0.5, 1.0]), "nodes": 7})
    for sums in (lambda y, w: G._gmm_sums(y, w, x, 2, state), lambda y, w: G._binary_gmm_sums((y > 0) * 1.0, w, x, binary)):
        whole, parts = sums(y, w), G._added(sums(y[:110], w[:110]), sums(y[110:], w[110:]))
        assert set(whole) == set(parts) and all(parts[k] == pytest.approx(whole[k]) for k in whole)


def test_growth_mixtures(spark):
    rng = np.random.default_rng(22)
    c = rng.choice(2, 1200, p=[0.6, 0.4])
    u = rng.standard_normal((1200, 2)) * [1, 0.3]
    mean = np.array([1 + 0.2 * TIMES, 6 - 0.8 * TIMES])[c] + u[:, :1] + u[:, 1:] * TIMES
    cols = [f"y{t}" for t in TIMES]
    y = mean + 0.5 * rng.standard_normal(mean.shape)
    g = G.fit_gmm(frame(spark, **{k: y[:, t] for t, k in enumerate(cols)}), cols, 2, n_init=3, tol=1e-7)
    assert g.beta == pytest.approx(np.array([[1, 0.2], [6, -0.8]]), abs=0.3) and np.diag(g.extra["psi"][0]) == pytest.approx([1, 0.09], abs=0.2)
    b = (rng.random(mean.shape) < Z.expit(np.array([-2 + 0.8 * TIMES, 2 - 0.8 * TIMES])[c] + u[:, :1])) * 1.0
    g = G.fit_gmm(frame(spark, **{k: b[:, t] for t, k in enumerate(cols)}), cols, 2, family="binomial", random_effects="intercept", n_init=2, tol=1e-6)
    assert np.sort(g.beta[:, 1]) == pytest.approx([-0.8, 0.8], abs=0.3)
    with pytest.raises(ValueError):
        G.fit_lcga(frame(spark, y0=[1.0], y1=[2.0]), ["y0", "y1"], 2, degree=1)


# ---------------------------------------------------------------- streams


def test_stream_scores_what_batch_scores(spark, lca, df, tmp_path):
    df.select(*ITEMS).withColumn("i", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/t.parquet")
    stream = scoring.read_stream(spark, str(tmp_path), "t.parquet")
    a = scoring.run_available(scoring.score_stream(lca, stream).select("i", "loglik", "class")).orderBy("i").toPandas()
    b = lca.transform(spark.read.parquet(f"{tmp_path}/t.parquet")).select("i", "loglik", "class").orderBy("i").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_compare_longitudinal_dispatches(spark):
    rng = np.random.default_rng(3)
    y = np.where(rng.random(200) < 0.5, 0.0, 4.0)[:, None] + rng.normal(0, 1, (200, 3)) + rng.normal(0, 0.7, (200, 1))
    cols = [f"v@{t}" for t in range(3)]
    df = spark.createDataFrame(pd.DataFrame(y, columns=cols))
    for model, fit in (("lcga", G.fit_lcga), ("gmm", G.fit_gmm)):
        how = {"n_init": 1, "tol": 1e-5, "max_iter": 50}
        row, = X.compare_longitudinal(df, ["v"], range(3), [2], model=model, **how).collect()
        own = fit(df, cols, 2, **how)
        assert row.ll == pytest.approx(own.loglik) and row.params == own.n_params
    with pytest.raises(ValueError):
        X.compare_longitudinal(df, ["v"], range(3), [2], model="lgca")
    with pytest.raises(ValueError):
        X.compare_longitudinal(df, ["v", "w"], range(3), [2], model="gmm")
