"""Registered queries of the extended models and reports; they iterate to convergence and have no SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from latticore.operators import diagnostics as D
from latticore.operators import extended as X
from latticore.operators import inference as I
from latticore.operators import mixture as M
from latticore.operators import report as R
from latticore.operators import structural as S
from latticore.operators import threestep as TS
from latticore.plans import patterns as P
from latticore.plans import queries_data as Q
from latticore.plans import queries_model as QM
from latticore.plans.queries_data import table
from latticore.registry import query


def _grouped(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") > 150000).cast("string").alias("dear"), F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("z"))
    return Q.flags(spark, sf).join(o, "l_orderkey")


@query("fit_groups")
def fit_groups(spark, sf):
    r = X.fit_groups(_grouped(spark, sf), Q.FLAGS, "dear", 2, measurement_equal=True, n_init=3, tol=1e-7)
    return spark.createDataFrame([(g, k + 1, float(v)) for g, f in r["groups"].items() for k, v in enumerate(f.pi)], "dear string, class int, proportion double")


@query("fit_dif")
def fit_dif(spark, sf):
    r = X.fit_dif(_grouped(spark, sf), Q.FLAGS, "z", 2, dif_items=["bulk"], n_init=2, tol=1e-6)
    return spark.createDataFrame(r["effects"][["item", "covariate", "estimate", "se", "z", "p"]])


def _panel(spark, sf):
    return QM.states(spark, sf).withColumn("z", (F.col("user_id") % 2).cast("double"))


@query("fit_lta_covariates")
def fit_lta_covariates(spark, sf):
    r = X.fit_lta_covariates(_panel(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, initial=["z"], transition=["z"], n_init=2, tol=1e-6, max_iter=200)
    return spark.createDataFrame(r["coefficients"][["part", "term", "estimate"]])


@query("fit_ri_lta")
def fit_ri_lta(spark, sf):
    r = X.fit_ri_lta(_panel(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, n_init=2, n_quadrature=7, tol=1e-5, max_iter=200)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(QM.LTA_ITEMS, r["loadings"])], "item string, loading double")


@query("fit_mover_stayer")
def fit_mover_stayer(spark, sf):
    r = X.fit_mixture_lta(_panel(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, mover_stayer=True, n_init=2, tol=1e-6, max_iter=200)
    return spark.createDataFrame([("mover", float(r["share"][0])), ("stayer", float(r["share"][1]))], "class string, proportion double")


@query("fit_three_step_lta")
def fit_three_step_lta(spark, sf):
    r = TS.fit_three_step_lta(_panel(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, n_init=3)
    return spark.createDataFrame([(t + 1, a + 1, b + 1, float(r["moves"][t, a, b])) for t in range(3) for a in range(2) for b in range(2)], "occasion int, from_status int, to_status int, probability double")


@query("compare_longitudinal")
def compare_longitudinal(spark, sf):
    return X.compare_longitudinal(_panel(spark, sf), QM.LTA_ITEMS, QM.TIMES, [1, 2], n_init=2)


@query("report_profile_data")
def report_profile_data(spark, sf):
    return R.profile_data(Q.returns_fit(spark, sf), spark)


@query("report_checklist")
def report_checklist(spark, sf):
    return R.checklist(M.fit_mixture(Q.flags(spark, sf), Q.FLAGS, 2, "binary", n_init=3, tol=1e-6), spark)


@query("report_methods")
def report_methods(spark, sf):
    return spark.createDataFrame([(R.report_methods(M.fit_mixture(Q.flags(spark, sf), Q.FLAGS, 2, "binary", n_init=3, tol=1e-6)),)], "paragraph string")


@query("confint")
def confint(spark, sf):
    df = Q.flags(spark, sf)
    t = P.collapse(df, Q.FLAGS, names=("_weight", "_rows")).toPandas()  # at most 2^5 patterns
    return spark.createDataFrame(R.confint(M.fit_mixture(df, Q.FLAGS, 2, "binary", n_init=3, tol=1e-8), *M.pattern_arrays(t, Q.FLAGS)).drop(columns="category"))


def local_sql() -> str:
    out = []
    for c in range(2):
        (ma, mb), (va, vb) = Q.GAUSS["mean"][c], Q.GAUSS["var"][c]
        cov = f"(sum(p{c + 1} * (quantity - {Q.num(ma)}) * (discount - {Q.num(mb)})) / sum(p{c + 1}))"
        cor = f"({cov} / {Q.num(float(np.sqrt(va * vb)))})"
        out.append(f"SELECT {c + 1} AS class, 'quantity' AS item_a, 'discount' AS item_b, round({cov}, 6) AS residual_cov, round({cor}, 6) AS residual_cor, round(sum(p{c + 1}) * {cor} * {cor}, 4) AS mi FROM post")
    return f"WITH {Q.SQL_LPA} " + " UNION ALL ".join(out)


@query("local_dependence", local_sql())
def local_dependence(spark, sf):
    t = D.local_dependence(Q.lpa_scored(spark, sf), M.with_parameters(Q.LPA, np.array([0.55, 0.45]), [Q.GAUSS]))
    return t.select(F.col("class").cast("bigint").alias("class"), "item_a", "item_b", F.round("residual_cov", 6).alias("residual_cov"), F.round("residual_cor", 6).alias("residual_cor"), F.round("mi", 4).alias("mi"))


@query("link_models")
def link_models(spark, sf):
    o = P.collapse(Q.flags(spark, sf), Q.FLAGS, names=("_weight", "_rows")).persist()  # at most 2^5 patterns
    a, b = (M.fit_mixture(o, c, 2, "binary", weight="_weight", weight_type="frequency", n_init=3, tol=1e-6) for c in (Q.FLAGS[:3], Q.FLAGS[2:]))
    both = b.transform(a.transform(o).withColumnsRenamed({"class": "first", "posterior": "pa", "probability": "_1", "loglik": "_2"}))
    ea, eb = (S.classification_error(t, 2, weight="_weight") for t in (both.select("_weight", F.col("pa").alias("posterior"), F.col("first").alias("class")), both))
    r = S.link_models(both, "first", "class", ea, eb, weight="_weight")
    o.unpersist()
    return spark.createDataFrame(pd.DataFrame([{"loglik": r["loglik"], "n_parameters": r["n_parameters"], "bic": r["bic"]}]))


# ---------------------------------------------------------------- finishing and inference


def _patterns(df, items):
    return M.pattern_arrays(P.collapse(df, items, names=("_weight", "_rows")).toPandas(), items)  # a few items: few patterns


@query("absolute_fit_mar")
def absolute_fit_mar(spark, sf):
    df = Q.gaps(Q.flags(spark, sf))
    return spark.createDataFrame(pd.DataFrame([I.absolute_fit_mar(M.fit_mixture(df, Q.FLAGS, 2, "binary", n_init=3, tol=1e-8), *_patterns(df, Q.FLAGS))]))


@query("bvr_bootstrap")
def bvr_bootstrap(spark, sf):
    df = Q.flags(spark, sf)
    return spark.createDataFrame(I.bvr_bootstrap(df, M.fit_mixture(df, Q.FLAGS, 2, "binary", n_init=3, tol=1e-6), n_reps=19))


@query("polish")
def polish(spark, sf):
    df = Q.flags(spark, sf)
    f = M.fit_mixture(df, Q.FLAGS, 2, "binary", n_init=3, tol=1e-4)
    return I.polish(f, *_patterns(df, Q.FLAGS)).measurement_summary(spark)


@query("chain_estimates")
def chain_estimates(spark, sf):
    df = QM.states(spark, sf)
    c = QM.chain()
    return spark.createDataFrame(I.chain_estimates(c, *_patterns(df, c.columns), "opg"))


SQL_COMPLETE = " AND ".join(f"{n}{t} IS NOT NULL" for t in QM.TIMES for n in QM.LTA_ITEMS)
SQL_KEYS = ", ".join(f"{n}{t}" for t in QM.TIMES for n in QM.LTA_ITEMS)


@query("lta_g2", f"WITH {QM.SQL_PATHS}, c AS (SELECT {SQL_KEYS}, count(*) AS o, any_value(total.ll) AS ll FROM states JOIN total USING (user_id) WHERE {SQL_COMPLETE} GROUP BY {SQL_KEYS}) SELECT round(sum(2 * o * (ln(o) - ln((SELECT sum(o) FROM c)) - ll)), 4) AS g2, count(*) AS n_patterns FROM c")
def lta_g2(spark, sf):
    c = QM.chain()
    t = I.lta_g2(c, *_patterns(QM.states(spark, sf), c.columns))
    return spark.createDataFrame([(round(t["g2"], 4), t["n_patterns"])], "g2 double, n_patterns bigint")


@query("lta_distal", f"WITH {QM.SQL_PATHS}, y AS (SELECT user_id, avg(value) AS y FROM events GROUP BY user_id) SELECT s3 AS class, round(sum(p), 6) AS n, round(sum(p * y) / sum(p), 6) AS mean FROM pp JOIN y USING (user_id) GROUP BY s3")
def lta_distal(spark, sf):
    y = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("y"))
    m = I.lta_distal(QM.chain().transform(QM.states(spark, sf)).join(y, "user_id"), "y", 2)
    return Q.rounded(m.select("class", "n", "mean"))


@query("add_outcome")
def add_outcome(spark, sf):
    return spark.createDataFrame(I.add_outcome(QM.priced(spark, sf), "y", 2)["estimates"])


@query("growth_estimates")
def growth_estimates(spark, sf):
    return spark.createDataFrame(I.growth_estimates_opg(QM.lcga_fit(), QM.trajectories(spark, sf)))


@query("fit_rmlca_invariant")
def fit_rmlca_invariant(spark, sf):
    return I.fit_rmlca_invariant(QM.states(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, n_init=3, tol=1e-7).transition_matrix(spark)
