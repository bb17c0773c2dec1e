"""Queries that need several sums of one aggregated table aggregate it once, and passes go over patterns."""

import numpy as np
import pytest
from latticore import registry
from latticore.operators import growth as G
from latticore.operators import jointly as J
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import structural as S
from latticore.plans import queries_data
from pyspark.sql import functions as F


def test_update_aggregates_its_pattern_table_once(spark, sf, monkeypatch):
    seen, own = [], M.marginals

    def marginals(df, *how):
        seen.append(df.storageLevel.useMemory)
        return own(df, *how)

    monkeypatch.setattr(queries_data.M, "marginals", marginals)
    registry.QUERIES["mstep_bernoulli"](spark, sf)
    assert seen == [True]


@pytest.mark.parametrize("assignment", ["proportional", "modal"])
def test_covariate_step_reads_scores_once(spark, assignment):
    """Rows without a covariate count in the error table only."""
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    p = F.when(F.col("id") % 10 < 4, 0.9).otherwise(0.2)
    df = spark.range(400).select(F.array(p, 1 - p).alias("posterior"), F.when(p > 0.5, 1).otherwise(2).alias("class"), F.when(F.col("id") % 9 > 0, (F.col("id") % 10 % 3 > 0).cast("double")).alias("z"))
    one = S.add_covariates(df.mapInPandas(counted, df.schema), ["z"], 2, assignment=assignment)
    assert read.value == 400
    error = S.classification_error(df, 2, assignment=assignment)
    own = [(F.col("class") == c + 1).cast("double") if assignment == "modal" else F.col("posterior")[c] for c in range(2)]
    t = S.design_table(df, ["z"], own, ["a", "b"])
    beta, _ = S.ml_covariates(S._design(t, 1), t[["a", "b"]].to_numpy(), error)
    assert np.allclose(one["estimate"], beta[0], atol=1e-6)


def passed(monkeypatch):
    """Row counts of the tables that passes go over."""
    seen, own = [], passes.together

    def together(runs, rows, *how):
        seen.append(rows.count())
        return own(runs, rows, *how)

    monkeypatch.setattr(passes, "together", together)
    return seen


def test_groups_pass_over_patterns(spark, monkeypatch):
    seen = passed(monkeypatch)
    df = spark.range(4000).select((F.col("id") % 5).alias("a@0"), (F.col("id") % 8 % 3).alias("b@0"), (F.col("id") % 2).alias("g"))
    start = [(np.array([0.5, 0.5]), np.zeros((0, 2, 2)), [{"mean": np.array([[1.0, 0.5], [3.0, 1.5]]), "var": np.ones((2, 2))}])]
    fits = [J.fit_lta_groups(df, ["a", "b"], [0], "g", 2, measurement="continuous", measurement_equal=False, equal="means", starts=start, max_iter=5, tol=-1, max_patterns=m) for m in (1, 1000)]
    assert seen == [df.distinct().count()]
    assert fits[0]["loglik"] == pytest.approx(fits[1]["loglik"], rel=1e-10) and fits[0]["n"] == pytest.approx(fits[1]["n"])


def test_curves_pass_over_patterns(spark, monkeypatch):
    seen = passed(monkeypatch)
    df = spark.range(3000).select(*(((F.col("id") % 7) * (t + 1) + F.col("id") % 3).cast("double").alias(f"y{t}") for t in range(4)))
    how = {"random_effects": "intercept", "n_init": 2, "max_iter": 8, "tol": -1}
    far, near = (G.fit_gmm(df, [f"y{t}" for t in range(4)], 2, max_patterns=m, **how) for m in (1, 1000))
    assert seen == [21]
    assert far.loglik == pytest.approx(near.loglik, rel=1e-9) and far.n == near.n == 3000


@pytest.mark.parametrize("occasions", [1, 4, 70])
def test_rows_by_missing_cells(occasions):
    mask = np.random.default_rng(occasions).random((200, occasions)) < 0.1
    want = [(m, np.flatnonzero((mask == m).all(axis=1))) for m in np.unique(mask, axis=0)]
    got = G._by_missing(mask)
    assert len(got) == len(want) and all(np.array_equal(a, c) and np.array_equal(b, d) for (a, b), (c, d) in zip(got, want))
    assert G._by_missing(mask[:0]) == []
