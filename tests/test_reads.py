"""Fits read their input once: checks, codings, errors and links are of its patterns."""

import numpy as np
import pytest
from latticore import registry
from latticore.operators import direct as D
from latticore.operators import finish
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.plans import queries_data as Q
from pyspark.sql import functions as F


@pytest.fixture
def counted(spark):
    """A function that gives a frame as one that counts the rows read of it."""
    read = spark.sparkContext.accumulator(0)

    def of(df):
        def count(frames):
            for f in frames:
                read.add(len(f))
                yield f

        return df.mapInPandas(count, df.schema)

    of.read = read
    return of


@pytest.fixture(scope="module")
def rows(spark):
    """Three items of two values, any two, with gaps; an empty row; and weights."""
    bit = lambda n, m: (F.col("id") * n % 101 % m < 2)
    return spark.range(3000).select(F.when(F.col("id") % 11 > 0, F.when(bit(7, 5), "yes").otherwise("no")).alias("a"), F.when(F.col("id") % 11 > 0, bit(7, 4).cast("int") + 1).alias("b"), F.when(F.col("id") % 11 > 1, bit(13, 3).cast("int")).alias("c"), (F.col("id") % 3 + 1).alias("w")).persist()


def test_weights_and_codings_are_of_the_patterns(counted, rows):
    how = {"n_init": 2, "tol": 1e-7}
    plain = M.fit_mixture(counted(rows), ["a", "b", "c"], 2, "binary", **how)
    assert counted.read.value == rows.count()
    copies = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("w")))).drop("_n", "w")
    repeated = M.fit_mixture(copies, ["a", "b", "c"], 2, "binary", **how)
    frequent = M.fit_mixture(rows, ["a", "b", "c"], 2, "binary", weight="w", weight_type="frequency", **how)
    sampled = M.fit_mixture(rows, ["a", "b", "c"], 2, "binary", weight="w", **how)
    assert plain.coding["a"] == ("no", "yes") and plain.coding["b"] == (1, 2)
    assert frequent.n == pytest.approx(repeated.n) and frequent.loglik == pytest.approx(repeated.loglik, rel=1e-9)
    assert sampled.n == pytest.approx(plain.n) and sampled.n == pytest.approx(rows.dropna(how="all", subset=["a", "b", "c"]).count())
    for w in (F.when(F.col("c") == 1, -1).otherwise(1), F.when(F.col("c") == 1, 1), F.lit(0)):
        with pytest.raises(ValueError, match="weights must be"):
            M.fit_mixture(rows.withColumn("w", w), ["a", "b", "c"], 1, "binary", weight="w")


def test_joint_classes_read_rows_once(counted, rows):
    how = {"n_init": 2, "tol": 1e-7}
    r = T.fit_joint_classes(counted(rows), ["a", "b"], ["b", "c"], 2, 2, **how)
    assert counted.read.value == rows.count()
    fx, fy = M.fit_mixture(rows, ["a", "b"], 2, "binary", **how), M.fit_mixture(rows, ["b", "c"], 2, "binary", **how)
    both = fy.transform(fx.transform(rows).withColumnsRenamed({"class": "first", "posterior": "pa", "probability": "_1", "loglik": "_2"}))
    e = [S.classification_error(both.select(F.col(p).alias("posterior"), F.col(c).alias("class")), 2) for p, c in (("pa", "first"), ("posterior", "class"))]
    want = S.link_models(both, "first", "class", *e)
    assert np.allclose(r["transitions"], want["transitions"], atol=1e-6) and r["n_obs"] == pytest.approx(want["n_obs"]) and r["x"].weight is None
    weighted = T.fit_joint_classes(rows, ["a", "b"], ["b", "c"], 2, 2, weight="w", **how)
    assert weighted["x"].weight == "w" and weighted["n_obs"] == pytest.approx(want["n_obs"])


def test_finish_passes_over_patterns(rows, monkeypatch):
    seen, own = [], passes.together
    monkeypatch.setattr(passes, "together", lambda runs, table, *how: seen.append(table.count()) or own(runs, table, *how))
    fit = M.fit_mixture(rows, ["a", "b", "c"], 2, "binary", n_init=1, max_iter=30, tol=-1)
    done = finish.newton_finish_table(fit, rows)
    assert seen == [rows.dropna(how="all", subset=["a", "b", "c"]).select("a", "b", "c").distinct().count()]
    table = fit.coded(rows).dropna(how="all", subset=["a", "b", "c"]).groupBy("a", "b", "c").count().toPandas()
    here = finish.newton_finish(fit, table[["a", "b", "c"]].to_numpy(float, na_value=np.nan), table["count"].to_numpy(float))
    assert done.loglik == pytest.approx(here.loglik, rel=1e-10) and done.entropy == pytest.approx(here.entropy, rel=1e-6)


def test_direct_effects_read_rows_once(counted, rows):
    df = rows.select("a", "b", "c", (F.col("w") > 1).cast("int").alias("z"))
    fit = D.fit_direct_effects(counted(df), ["a", "b"], ["z"], 1, effects={"a": ["z"]}, measurement="binary")
    assert counted.read.value == df.count() and fit.coding["a"] == ("no", "yes")
    seen = df.where("a is not null").groupBy("z").agg(F.avg((F.col("a") == "yes").cast("int")).alias("p")).toPandas().set_index("z")["p"]
    logit = np.log(seen / (1 - seen))
    est = fit.estimates[fit.estimates["item"] == "a"].set_index("part")["estimate"]
    assert est["effect"] == pytest.approx(logit[1] - logit[0], abs=1e-5)


@pytest.mark.parametrize("assignment", ["modal", "proportional"])
def test_outcome_shares_read_scores_once(spark, counted, assignment):
    """Rows without an outcome count in the error table only."""
    p = F.when(F.col("id") % 10 < 4, 0.9).otherwise(0.2)
    df = spark.range(400).select(F.array(p, 1 - p).alias("posterior"), F.when(p > 0.5, 1).otherwise(2).alias("class"), F.when(F.col("id") % 9 > 0, F.when(F.col("id") % 10 % 3 > 0, "u").otherwise("v")).alias("y"))
    got = S.ml_outcome(counted(df), "y", 2, assignment=assignment)
    assert counted.read.value == 400
    assert got[["class", "category"]].values.tolist() == [[1, "u"], [1, "v"], [2, "u"], [2, "v"]]
    error = S.classification_error(df, 2, assignment=assignment)
    own = [(F.col("class") == c + 1).cast("double") if assignment == "modal" else F.col("posterior")[c] for c in range(2)]
    n = df.where("y is not null").groupBy("y").agg(*(F.sum(v).alias(str(c)) for c, v in enumerate(own))).orderBy("y").toPandas()[["0", "1"]].to_numpy()
    share = n @ np.linalg.inv(error).T
    if (share > 0).all():
        assert np.allclose(got["proportion"].to_numpy().reshape(2, 2).T, share / share.sum(axis=0), atol=1e-3)


@pytest.mark.parametrize("name", ["joint_classes", "link_models", "lca_newton_finish", "direct_effects_saturated"])
def test_queries_read_flags_once(spark, sf, counted, monkeypatch, name):
    flags = Q.flags(spark, sf).persist()
    monkeypatch.setattr(Q, "flags", lambda *_: counted(flags))
    registry.QUERIES[name](spark, sf)
    assert counted.read.value == flags.count()


@pytest.mark.parametrize("name", ["ml_outcome_saturated", "ml_outcome"])
def test_outcome_queries_read_orders_once(spark, sf, counted, monkeypatch, name):
    coded = Q.coded(spark, sf).persist()
    monkeypatch.setattr(Q, "coded", lambda *_: counted(coded))
    registry.QUERIES[name](spark, sf)
    assert counted.read.value == coded.count()


@pytest.mark.parametrize("heap", [0, 2700])
def test_degenerate_classes_are_found_in_one_read(spark, counted, heap):
    """A class that sits on one value, or none; items without own variances and missing cells stand beside."""
    id_ = F.col("id")
    x = F.when(id_ < heap, 50.0).otherwise((id_ * 7919 % 3000) / 300.0)
    table = spark.range(3000).select((id_ % 2).cast("double").alias("b"), F.when(id_ % 9 > 0, x).alias("x"), (id_ * 31 % 1000 / 100.0).alias("y"), (id_ % 4 + 1).cast("double").alias("_weight"))
    spec = M.Spec([("binary", ["b"]), ("continuous:class", ["x", "y"])], 2)
    res = {"pi": np.array([0.5, 0.5]), "params": [{"p": np.full((2, 1), 0.5)}, {"mean": np.array([[5.0, 5.0], [50.0, 5.0]]), "var": np.array([[9.0, 9.0], [1.0, 9.0]])}]}
    assert M.degenerate_rows(spec, res, counted(table).persist(), "_weight") == (heap > 0)
    assert counted.read.value == 3000
    assert M.degenerate(spec, res, *M.pattern_arrays(table.toPandas(), spec.items)) == (heap > 0)


def test_degenerate_classes_take_the_same_jobs_for_more_items(spark):
    table = spark.range(500).select(*((F.col("id") * n % 499 / 10.0).alias(f"x{n}") for n in (1, 2, 3)), F.lit(1.0).alias("_weight")).persist()
    table.count()
    jobs = []
    for n in (1, 3):
        spec = M.Spec([("continuous:class", [f"x{i + 1}" for i in range(n)])], 2)
        res = {"pi": np.array([0.5, 0.5]), "params": [{"mean": np.array([[10.0] * n, [40.0] * n]), "var": np.full((2, n), 90.0)}]}
        spark.sparkContext.setJobGroup(f"degenerate-{n}", "")
        try:
            assert not M.degenerate_rows(spec, res, table, "_weight")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"degenerate-{n}")))
    assert jobs[0] == jobs[1] > 0
