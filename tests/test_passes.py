"""Passes over distributed tables: one job each, in as many tasks as the rows are worth, with the same sums."""

import numpy as np
import pytest
from latticore.operators import mixture as M
from latticore.operators import passes
from pyspark.sql import functions as F


def moments(rounds):
    """A run of some passes that asks for sums about a centre."""
    centre, seen = 0.0, []
    for _ in range(rounds):
        s = yield centre
        seen.append((s["n"], s["x"], s["xx"]))
        centre = float(s["x"] / s["n"])
    return {"seen": seen, "centre": centre}


def statistics():
    """What workers are sent by value."""

    def sums(x, w, centre):
        return {"n": w.sum(), "x": w @ x[:, 0], "xx": w @ (x[:, 0] - centre) ** 2}

    return sums, lambda a, b: b if a is None else {k: a[k] + b[k] for k in b}


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 30_000, 1, 24).select((F.col("id") % 101).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("w")).persist()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_a_pass_is_one_job_whatever_the_partitions(spark, rows, monkeypatch, most):
    monkeypatch.setattr(passes, "SUM_BYTES", most)
    rows.count()
    sums, added = statistics()
    found, n = jobs(spark, f"passes-{most}", lambda: passes.together([moments(4), moments(2)], rows, ["x"], "w", sums, added))
    own = rows.toPandas()
    alone = passes.alone(moments(4), lambda s: sums(own[["x"]].to_numpy(), own["w"].to_numpy(), s))
    assert found[0]["centre"] == pytest.approx(alone["centre"]) and np.allclose(found[0]["seen"], alone["seen"]) and len(found[1]["seen"]) == 2
    assert n <= 2 * 4 + 2  # a shuffle in a pass may count as a job of its own; a job for each partition would be 24 a pass


def test_partitions_follow_the_rows(spark, rows):
    assert passes.dealt(rows)[0].rdd.getNumPartitions() == passes.dealt(rows)[1] == 6
    assert passes.dealt(rows.limit(10))[1] == 1


def test_mixture_over_partitions_takes_one_job_a_pass(spark, rows):
    few = rows.groupBy("x").agg(F.sum("w").alias("w")).select((F.col("x") * 1.0).alias("a"), F.sqrt("x").alias("b"), "w")
    spec = [(np.array([0.5, 0.5]), [{"mean": np.array([[20.0, 4.0], [70.0, 8.0]]), "var": np.array([[300.0, 4.0], [300.0, 4.0]])}])]
    how = {"weight": "w", "starts": spec, "tol": -1}
    (short, a), (long, b) = (jobs(spark, f"mixture-{i}", lambda i=i: M.fit_mixture(few, ["a", "b"], 2, "continuous", max_iter=i, max_patterns=1, **how)) for i in (2, 12))
    task = M.fit_mixture(few, ["a", "b"], 2, "continuous", max_iter=12, **how)
    assert long.loglik == pytest.approx(task.loglik, rel=1e-10)
    assert b - a <= 10


def test_sums_of_no_rows(spark, rows):
    with pytest.raises(ValueError, match="no row"):
        M.fit_mixture(rows.where("x < 0"), ["x"], 1, "continuous")
