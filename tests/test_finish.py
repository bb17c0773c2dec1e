"""Codings, agreement of the places where a table is fitted, analytic scores, Newton finish, later steps."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from latticore.functions.special import gradient
from latticore.operators import diagnostics as D
from latticore.operators import finish
from latticore.operators import growth as G
from latticore.operators import mixture as M
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.plans import patterns as P
from latticore.sources import panel
from pyspark.sql import functions as F


def two_classes(n=600, seed=3, items=5):
    rng = np.random.default_rng(seed)
    c = rng.random(n) < 0.4
    p = np.where(c[:, None], 0.85, 0.2)
    x = (rng.random((n, items)) < p).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    return pd.DataFrame(x, columns=[f"i{j}" for j in range(items)]).assign(z=(rng.random(n) < np.where(c, 0.7, 0.3)).astype(float), row=range(n))


def frame(spark, pdf):
    pdf = pdf.astype(float)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` double" for c in pdf.columns))


ITEMS = [f"i{j}" for j in range(5)]


def test_codings_are_replayed(spark):
    pdf = two_classes()
    df = frame(spark, pdf)
    raw = df.withColumns({c: F.col(c) * 3 + 2 for c in ITEMS})  # 2 and 5
    a, b = (M.fit_mixture(x, ITEMS, 2, "binary", n_init=3, tol=1e-7) for x in (df, raw))
    assert a.coding == {} and b.coding == {c: (2.0, 5.0) for c in ITEMS}
    assert a.loglik == pytest.approx(b.loglik) and np.allclose(a.params[0]["p"], b.params[0]["p"])
    out = b.transform(raw)
    assert out.columns[: len(raw.columns)] == raw.columns
    left, right = (x.orderBy("row").select("loglik", "class", "posterior").collect() for x in (a.transform(df), out))
    assert all(p["class"] == q["class"] and (p.loglik is None) == (q.loglik is None) and (p.loglik is None or p.loglik == pytest.approx(q.loglik)) for p, q in zip(left, right))
    assert out.agg(F.sum("loglik")).first()[0] == pytest.approx(b.loglik, rel=1e-6)
    assert {r[0] for r in out.select("i0").distinct().collect()} == {2.0, 5.0, None}
    assert np.allclose([tuple(r) for r in a.class_sizes(df).collect()], [tuple(r) for r in b.class_sizes(raw).collect()])
    assert set(np.unique(M.simulate(b, 50)[ITEMS])) == {2.0, 5.0}
    assert D.fit_absolute(a, df)["g2"] == pytest.approx(D.fit_absolute(b, raw)["g2"])
    with pytest.raises(Exception, match="not seen"):
        b.transform(raw.withColumn("i0", F.lit(7.0))).collect()


def waves(seed=5, n=300):
    rng = np.random.default_rng(seed)
    s = (rng.random(n) < 0.5).astype(int)
    out = {}
    for t in range(3):
        for i in "ab":
            out[f"{i}@{t}"] = (rng.random(n) < np.where(s == 1, 0.85, 0.15)).astype(float)
        s = np.where(rng.random(n) < 0.85, s, 1 - s)
    return pd.DataFrame(out)


def test_chains_code_an_item_over_all_occasions(spark):
    pdf = waves()
    pdf["a@0"] = 1.0  # one value only at this occasion: its code comes from the others
    df = frame(spark, pdf)
    raw = df.withColumns({c: F.col(f"`{c}`") + 1 for c in pdf.columns})
    a, b = (T.fit_lta(x, ["a", "b"], [0, 1, 2], 2, n_init=2, tol=1e-7) for x in (df, raw))
    assert a.loglik == pytest.approx(b.loglik) and 0 <= b.params[0][0]["p"].min() and b.params[0][0]["p"].max() <= 1
    left, right = (x.transform(y).agg(F.sum("loglik")).first()[0] for x, y in ((a, df), (b, raw)))
    assert left == pytest.approx(right) and left == pytest.approx(a.loglik, rel=1e-6)
    assert b.transform(raw).columns[: len(raw.columns)] == raw.columns
    c, d = (T.fit_rmlca(x, ["a", "b"], [0, 1, 2], 2, n_init=2, tol=1e-7) for x in (df, raw))
    assert c.loglik == pytest.approx(d.loglik) and d.coding["a@0"] == (1.0, 2.0)


def test_tables_of_any_size_are_fitted_alike(spark):
    pdf = two_classes(300)
    df = frame(spark, pdf).repartition(3)
    a, b = (M.fit_mixture(df, ITEMS, 2, "binary", n_init=6, tol=1e-7, max_patterns=m) for m in (50_000, 5))
    assert len(a.logliks) == len(b.logliks) == 6 and np.allclose(a.logliks, b.logliks, rtol=1e-6)
    assert np.allclose(a.params[0]["p"], b.params[0]["p"], atol=1e-5)
    for m in (50_000, 5):
        with pytest.raises(ValueError, match="from 1"):
            M.fit_mixture(df, ITEMS, 2, "categorical", n_init=1, max_patterns=m)
    wide = frame(spark, waves(n=120)).repartition(3)
    a, b = (T.fit_lta(wide, ["a", "b"], [0, 1, 2], 2, n_init=5, tol=1e-7, max_patterns=m) for m in (100_000, 5))
    assert len(a.logliks) == len(b.logliks) == 5 and np.allclose(a.logliks, b.logliks, rtol=1e-6)
    rng = np.random.default_rng(8)
    y = frame(spark, pd.DataFrame(rng.normal(size=(200, 4)) + np.where(rng.random(200) < 0.5, 0, 4)[:, None], columns=list("wxyz")))
    runs = [G.fit_lcga(y.repartition(p), list("wxyz"), 2, n_init=3, tol=1e-8, max_patterns=m) for p, m in ((1, 200_000), (1, 20), (5, 20))]
    assert all(np.allclose(r.logliks, runs[0].logliks, rtol=1e-7) for r in runs)


def test_degenerate_runs_are_left_out_wherever_they_are(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"u": np.concatenate([np.full(60, 3.0), rng.normal(size=140)])})
    df = frame(spark, pdf)
    starts = [(np.array([0.3, 0.7]), [{"mean": np.array([[3.0], [0.0]]), "var": np.array([[1e-4], [1.0]])}]), (np.array([0.5, 0.5]), [{"mean": np.array([[2.0], [0.0]]), "var": np.array([[4.0], [1.0]])}])]
    fits = [M.fit_mixture(df, ["u"], 2, "continuous", variances_equal=False, starts=starts, max_iter=3, tol=-1, max_patterns=m) for m in (50_000, 5)]
    assert fits[0].loglik == pytest.approx(fits[1].loglik) and np.allclose(fits[0].pi, fits[1].pi)


def test_alignment_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(100):
        k = int(rng.integers(1, 7))
        a, b = rng.random((k, 3)).round(1), rng.random((k, 3)).round(1)
        cost = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        got = D.align_classes(a, b)
        assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(o)) for o in itertools.permutations(range(k))))
    a = rng.random((30, 4))
    order = rng.permutation(30)
    assert D.align_classes(a[order], a) == order.tolist()


def test_simulated_patterns_cost_by_patterns(spark):
    fit = M.fit_mixture(frame(spark, two_classes()), ITEMS, 2, "binary", n_init=2, tol=1e-6)
    x, w = M.simulated_patterns(fit, 10**12, 3)
    assert len(x) == 32 and w.sum() == 10**12
    mean = fit.pi @ fit.params[0]["p"]
    assert np.allclose((w @ x) / w.sum(), mean, atol=1e-4)


def test_patterns_are_numbered_in_order(spark):
    rows = [(a, b, c) for a in (None, 0, 1) for b in (0, 1) for c in (None, 2, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(4)
    got = {tuple(r)[:3]: r.pattern_id for r in P.numbered(df, ["a", "b", "c"]).collect()}
    key = lambda r: [(v is not None, v or 0) for v in r]
    assert got == {r: i + 1 for i, r in enumerate(sorted(rows, key=key))}


BLOCKS = [("binary", ["a", "b"]), ("categorical", ["c"]), ("continuous:class", ["d"]), ("continuous:equal", ["e"]), ("count", ["f"]), ("zip", ["g"]), ("negbin", ["h"])]


def mixed(k=3):
    rng = np.random.default_rng(9)
    spec = M.Spec(BLOCKS, k, cats={"c": 4})
    x = np.column_stack([rng.integers(0, 2, (40, 2)), rng.integers(1, 5, 40), rng.normal(size=(40, 2)), rng.poisson(2, (40, 3))]).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    m = [e.marginal(b, np.ones(40)) for e, b in zip(spec.emissions(), spec.split(x))]
    pi, params = M._starts(spec, m, 1, 2)[0]
    return M.Fit(spec, pi, params, 0, 0, 0, 40.0, 0, 0, True, [], m), x


def test_scores_are_the_derivatives():
    fit, x = mixed()
    want = gradient(lambda t: fit.case_logliks(x, t), fit.free())
    assert np.allclose(finish.case_scores(fit, x), want, atol=1e-6)


def test_newton_finish_ends_at_a_maximum(spark):
    pdf = two_classes(400)
    df = frame(spark, pdf).repartition(3)
    short = M.fit_mixture(df, ITEMS, 2, "binary", n_init=2, max_iter=8, tol=-1)
    t = P.collapse(panel.drop_empty(df, ITEMS), ITEMS, names=("_weight", "_rows")).toPandas()
    x, w = M.pattern_arrays(t, ITEMS)
    one, two = finish.newton_finish(short, x, w), finish.newton_finish_table(short, df)
    long = M.fit_mixture(df, ITEMS, 2, "binary", starts=[(short.pi, short.params)], max_iter=4000, tol=1e-14)
    assert one.penalised >= long.penalised - 1e-7 and one.penalised == pytest.approx(two.penalised, abs=1e-7)
    assert np.allclose(one.params[0]["p"], long.params[0]["p"], atol=1e-4) and np.allclose(one.params[0]["p"], two.params[0]["p"], atol=1e-6)
    assert one.entropy == pytest.approx(two.entropy, rel=1e-6)
    g = w @ finish.case_scores(one, x) + gradient(lambda s: M._log_prior(one.spec, *one.at(s), one.marginals), one.free())
    assert np.abs(g).max() < 1e-5


def test_later_steps_carry_the_measurements_errors(spark):
    pdf = two_classes(800)
    df = frame(spark, pdf)
    fit = M.fit_mixture(df, ITEMS, 2, "binary", n_init=3, tol=1e-9)
    scored = fit.transform(df)
    for c in ("ML", "BCH", "none"):
        got, plain = finish.later_step(fit, df, ["z"], correction=c), S.add_covariates(scored, ["z"], 2, correction=c)
        if c != "none":
            assert (got["se"] >= got["se_step"]).all() and got["se"].iloc[1] < 2 * got["se_step"].iloc[1]
        if c == "none":
            assert np.allclose(got["estimate"], plain["estimate"], atol=1e-5)
    two = finish.later_step(fit, df, ["z"], correction="two-step")
    held = S.two_step_covariates(scored, ["z"], fit.pi)
    assert np.allclose(two["estimate"], held["estimate"], atol=1e-3) and (two["se"] > two["se_step"]).all()
    # the truth: log odds of the larger class fall (or rise) by log(0.7 0.7 / 0.3 0.3) with z
    assert abs(abs(two["estimate"].iloc[1]) - 2 * math.log(7 / 3)) < 3 * two["se"].iloc[1]
    with pytest.raises(ValueError):
        finish.later_step(fit, df, ["z"], max_rows=3)


def test_rows_align_and_levels_have_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k long, v string")
    coded, labels = panel.encode_levels(df, ["v"])
    assert labels == {"v": ["a", "b"]} and [r.v for r in coded.orderBy("k").collect()] == [2, None, 1]
    with pytest.raises(Exception, match="not known"):
        panel.encode_levels(df, ["v"], {"v": ["a"]})[0].collect()
    fitted = df.where("k > 1").select("k")
    assert sorted(r.k for r in panel.align_rows(df, fitted, "k").collect()) == [2, 3]
    for rows in (df.where("k < 3"), df.unionByName(df)):
        with pytest.raises(ValueError):
            panel.align_rows(rows, fitted, "k")
