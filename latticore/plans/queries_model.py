"""Registered queries: structural models, transitions, growth, tests, streaming, and whole fits.

Whole fits iterate to convergence and have no SQL; the others have theirs written out from the formulas.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import chi2_sf, gauss_hermite
from latticore.operators import diagnostics as D
from latticore.operators import growth as G
from latticore.operators import mixture as M
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.plans import queries_data as Q
from latticore.plans.queries_data import num, rounded, table
from latticore.registry import query
from latticore.sources import panel
from latticore.streaming import scoring

# ---------------------------------------------------------------- structural


@query("classification_error", f"WITH {Q.SQL_LCA} " + " UNION ALL ".join(f"SELECT {s + 1} AS assigned, {t + 1} AS class, round(sum(CASE WHEN class = {s + 1} THEN p{t + 1} ELSE 0 END) / sum(p{t + 1}), 6) AS probability FROM post" for s in range(3) for t in range(3)))
def classification_error(spark, sf):
    e = S.classification_error(Q.lca_scored(spark, sf), 3)
    return rounded(spark.createDataFrame([(s + 1, t + 1, float(e[s, t])) for s in range(3) for t in range(3)], "assigned bigint, class bigint, probability double"))


SQL_ERR2 = ", d AS (SELECT sum(CASE WHEN class = 1 THEN p1 ELSE 0 END) / sum(p1) AS a, sum(CASE WHEN class = 1 THEN p2 ELSE 0 END) / sum(p2) AS b FROM post), bch AS (SELECT post.*, (CASE WHEN class = 1 THEN 1 - b ELSE -b END) / (a - b) AS w1, (CASE WHEN class = 1 THEN a - 1 ELSE a END) / (a - b) AS w2 FROM post, d)"


def bch_scored(spark, sf) -> DataFrame:
    scored = Q.cat_scored(spark, sf)
    return S.with_bch_weights(scored, S.classification_error(scored, 2))


@query("bch_weights", f"WITH {Q.SQL_CAT}{SQL_ERR2} SELECT o_orderkey, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM bch")
def bch_weights(spark, sf):
    return rounded(bch_scored(spark, sf).select("o_orderkey", F.col("bch")[0].alias("w1"), F.col("bch")[1].alias("w2")))


SQL_PRICED = f"{Q.SQL_CAT}{SQL_ERR2}, priced AS (SELECT bch.*, o_totalprice AS y, c_acctbal AS x, c_mktsegment AS segment, c_custkey FROM bch JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey)"


def priced(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("segment"))
    return bch_scored(spark, sf).join(o, "o_orderkey").join(c, "o_custkey")


@query("distal_means_bch", f"WITH {SQL_PRICED}, s AS (SELECT sum(w1) AS n1, sum(w2) AS n2, sum(w1 * y) / sum(w1) AS m1, sum(w2 * y) / sum(w2) AS m2, (sum(w1 * y * y) - sum(w1 * y) * sum(w1 * y) / sum(w1) + sum(w2 * y * y) - sum(w2 * y) * sum(w2 * y) / sum(w2)) / (sum(w1) + sum(w2)) AS v FROM priced) SELECT 1 AS class, round(n1, 4) AS n, round(m1, 4) AS mean, round(v / 1e6, 3) AS variance FROM s UNION ALL SELECT 2, round(n2, 4), round(m2, 4), round(v / 1e6, 3) FROM s")
def distal_means_bch(spark, sf):
    m = S.distal_means(priced(spark, sf), "y", 2)
    return m.select(F.col("class").cast("bigint").alias("class"), F.round("n", 4).alias("n"), F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1e6, 3).alias("variance"))


@query("distal_shares_bch", f"WITH {SQL_PRICED}, s AS (SELECT segment AS category, sum(w1) AS n1, sum(w2) AS n2 FROM priced GROUP BY 1) SELECT category, 1 AS class, round(n1, 6) AS n, round(n1 / (SELECT sum(n1) FROM s), 6) AS proportion FROM s UNION ALL SELECT category, 2, round(n2, 6), round(n2 / (SELECT sum(n2) FROM s), 6) FROM s")
def distal_shares_bch(spark, sf):
    return rounded(S.distal_shares(priced(spark, sf), "segment", 2))


@query("normal_equations", f"WITH {SQL_PRICED} " + " UNION ALL ".join(f"SELECT {c} AS class, '{n}' AS term, round({e} / 1e9, 6) AS value FROM priced" for c in (1, 2) for n, e in (("xx", f"sum(p{c} * x * x)"), ("x1", f"sum(p{c} * x)"), ("xy", f"sum(p{c} * x * y)"), ("y1", f"sum(p{c} * y)"))))
def normal_equations(spark, sf):
    eq = S.normal_equations(priced(spark, sf), "y", ["x"], 2)
    rows = [(c, n, float(v) / 1e9) for c, (a, b, _) in eq.items() for n, v in (("xx", a[1, 1]), ("x1", a[0, 1]), ("xy", b[1]), ("y1", b[0]))]
    return rounded(spark.createDataFrame(rows, "class bigint, term string, value double"))


@query("outcome_slopes", f"WITH {SQL_PRICED} SELECT class, round(intercept, 3) AS intercept, round(slope, 6) AS slope FROM (" + " UNION ALL ".join(f"SELECT {c} AS class, (sum(w{c} * y) - (sum(w{c}) * sum(w{c} * x * y) - sum(w{c} * x) * sum(w{c} * y)) / (sum(w{c}) * sum(w{c} * x * x) - sum(w{c} * x) * sum(w{c} * x)) * sum(w{c} * x)) / sum(w{c}) AS intercept, (sum(w{c}) * sum(w{c} * x * y) - sum(w{c} * x) * sum(w{c} * y)) / (sum(w{c}) * sum(w{c} * x * x) - sum(w{c} * x) * sum(w{c} * x)) AS slope FROM priced" for c in (1, 2)) + ")")
def outcome_slopes(spark, sf):
    t = S.outcome_regression(priced(spark, sf), "y", ["x"], 2).pivot(index="class", columns="term", values="estimate")
    return spark.createDataFrame([(int(c), round(float(r["(intercept)"]), 3), round(float(r["x"]), 6)) for c, r in t.iterrows()], "class bigint, intercept double, slope double")


@query("mnl_gradient", f"WITH {Q.SQL_LCA}, z AS (SELECT post.*, CASE WHEN o_totalprice > 150000 THEN 1.0e0 ELSE 0.0e0 END AS dear FROM post JOIN orders ON l_orderkey = o_orderkey) " + " UNION ALL ".join(f"SELECT {c} AS class, '{n}' AS term, round(sum((p{c} - 1.0e0 / 3) * {x}), 6) AS gradient FROM z" for c in (1, 2) for n, x in (("(intercept)", "1"), ("dear", "dear"))))
def mnl_gradient(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("dear"))
    t = S.design_table(Q.lca_scored(spark, sf).join(o, "l_orderkey"), ["dear"], [F.col("posterior")[c] for c in range(3)], ["a", "b", "c"])
    _, g, _ = S.mnl_score(np.zeros(4), S._design(t, 1), t[["a", "b", "c"]].to_numpy())
    return rounded(spark.createDataFrame([(c + 1, n, float(g[2 * c + j])) for c in range(2) for j, n in enumerate(("(intercept)", "dear"))], "class bigint, term string, gradient double"))


@query("survey_meat", """WITH s AS (SELECT n_regionkey AS st, c_nationkey AS psu, c_acctbal / 1000 AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0e0 ELSE -0.25e0 END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
u AS (SELECT st, psu, sum(a) AS a, sum(b) AS b FROM s GROUP BY 1, 2), g AS (SELECT avg(a) AS ga, avg(b) AS gb FROM u),
c AS (SELECT u.*, count(*) OVER (PARTITION BY st) AS n, avg(a) OVER (PARTITION BY st) AS ma, avg(b) OVER (PARTITION BY st) AS mb FROM u),
d AS (SELECT CASE WHEN n > 1 THEN a - ma ELSE a - ga END AS a, CASE WHEN n > 1 THEN b - mb ELSE b - gb END AS b, CASE WHEN n > 1 THEN n / (n - 1.0e0) ELSE 1 END AS f FROM c, g)
SELECT 'a' AS "row", 'a' AS col, round(sum(f * a * a), 4) AS value FROM d UNION ALL SELECT 'a', 'b', round(sum(f * a * b), 4) FROM d UNION ALL SELECT 'b', 'a', round(sum(f * a * b), 4) FROM d UNION ALL SELECT 'b', 'b', round(sum(f * b * b), 4) FROM d""")
def survey_meat(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    s = c.select(F.col("n_regionkey").alias("st"), F.col("c_nationkey").alias("psu"), (F.col("c_acctbal") / 1000).alias("a"), F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(-0.25).alias("b"))
    return rounded(S.survey_meat(s, ["a", "b"], stratum="st", psu="psu"), 4)


# ---------------------------------------------------------------- tests

SQL_TESTS = """b AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END) AS f FROM orders GROUP BY 1),
a AS (SELECT sum(f) / sum(n) AS s FROM b),
tests AS (SELECT i, n * (f / n - s) * (f / n - s) / (s * (1 - s)) AS x FROM b, a)"""


def priority_tests(spark, sf):
    """i, x: for each of the five priorities, how far its share of finished orders is from that of all, as a chi-squared statistic."""
    finished = F.sum((F.col("o_orderstatus") == "F").cast("double"))
    t = table(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"), finished.alias("f")).toPandas().sort_values("i")
    share = t["f"].sum() / t["n"].sum()
    return t.assign(x=t["n"] * (t["f"] / t["n"] - share) ** 2 / (share * (1 - share)))[["i", "x"]]


@query("p_adjust", f"WITH {SQL_TESTS}, r AS (SELECT i, exp(-x / 2) AS p, row_number() OVER (ORDER BY exp(-x / 2), i) AS k FROM tests) SELECT i, round(least(1, 5 * p), 6) AS bonferroni, round(max(least(1, (6 - k) * p)) OVER (ORDER BY k), 6) AS holm, round(min(least(1, 5 * p / k)) OVER (ORDER BY k DESC), 6) AS bh FROM r")
def p_adjust(spark, sf):
    from latticore.functions.special import adjust_p

    t = priority_tests(spark, sf)
    p = [chi2_sf(float(x), 2) for x in t["x"]]
    v = [adjust_p(p, m) for m in ("bonferroni", "holm", "BH")]
    return rounded(spark.createDataFrame([(int(i), *(float(u) for u in row)) for i, *row in zip(t["i"], *v)], "i bigint, bonferroni double, holm double, bh double"))


@query("chi2_tail", f"WITH {SQL_TESTS} SELECT round(x, 9) AS x, round(exp(-x / 2), 9) AS df2, round(exp(-x / 2) * (1 + x / 2), 9) AS df4, round(exp(-x / 2) * (1 + x / 2 + x * x / 8 + x * x * x / 48), 9) AS df8 FROM tests")
def chi2_tail(spark, sf):
    return rounded(spark.createDataFrame([(float(x), *(chi2_sf(float(x), d) for d in (2, 4, 8))) for x in priority_tests(spark, sf)["x"]], "x double, df2 double, df4 double, df8 double"), 9)


STATUSES = ["F", "O", "P"]
SQL_PRICES = "prices AS (SELECT o_orderstatus AS s, avg(o_totalprice / 100000.0e0) AS m, var_pop(o_totalprice / 100000.0e0) AS v, count(*) AS n FROM orders GROUP BY 1)"


def prices(spark, sf):
    """Means of the price by status, their covariance and the variances."""
    y = F.col("o_totalprice") / 100000.0
    rows = {r.s: r for r in table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    m, v, n = (np.array([float(rows[s][c]) for s in STATUSES]) for c in ("m", "v", "n"))
    return m, np.diag(v / n), v


def contrast_sql(a: int, b: int) -> str:
    return f"SELECT {a + 1} AS class, {b + 1} AS reference, round(a.m - b.m, 6) AS estimate, round(sqrt(a.v / a.n + b.v / b.n), 6) AS se, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS z, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS d FROM prices a, prices b WHERE a.s = '{STATUSES[a]}' AND b.s = '{STATUSES[b]}'"


@query("outcome_contrasts", f"WITH {SQL_PRICES} " + " UNION ALL ".join(contrast_sql(a, b) for a in range(3) for b in range(a)))
def outcome_contrasts(spark, sf):
    m, vc, v = prices(spark, sf)
    return rounded(spark.createDataFrame(D.contrasts(m.tolist(), vc, variances=v.tolist())[["class", "reference", "estimate", "se", "z", "d"]]))


@query("wald_statistic", f"WITH {SQL_PRICES} SELECT round((a.m - b.m) * (a.m - b.m) / (a.v / a.n + b.v / b.n), 6) AS wald_chi2, 1 AS df FROM prices a, prices b WHERE a.s = 'F' AND b.s = 'O'")
def wald_statistic(spark, sf):
    m, vc, _ = prices(spark, sf)
    w = D.wald_test(m, vc, np.array([1.0, -1.0, 0.0]))
    return rounded(spark.createDataFrame([(w["wald_chi2"], w["df"])], "wald_chi2 double, df bigint"))


def nested(spark, sf):
    """Fixed parameters of two and three classes on the same rows."""
    df = Q.flags(spark, sf)
    two = M.with_parameters(M.Spec([("binary", Q.FLAGS)], 2), np.array([0.6, 0.4]), [{"p": np.array(Q.PROB[:2])}])
    out = []
    for f, p in ((two, 11), (Q.lca(), 17)):
        f.loglik, f.n_params = f.transform(df).agg(F.sum("loglik")).first()[0], p
        out.append(f)
    return out


SQL_TWO = f"{Q.SQL_FLAGS}, two AS (SELECT sum(ln(exp({num(math.log(0.6 + 1e-15))} + {Q.bern_sql(Q.FLAGS, Q.PROB, 0)}) + exp({num(math.log(0.4 + 1e-15))} + {Q.bern_sql(Q.FLAGS, Q.PROB, 1)}))) AS ll FROM flags), three AS (SELECT sum(ln(" + " + ".join(f"exp({e})" for e in Q.LCA_LOGS) + ")) AS ll FROM flags)"


@query("lr_test_scaled", f"WITH {SQL_TWO} SELECT round(2 * (three.ll - two.ll), 4) AS statistic_raw, 6 AS df, round((17 * 1.3e0 - 11 * 1.1e0) / 6, 6) AS scaling_factor, round(2 * (three.ll - two.ll) / ((17 * 1.3e0 - 11 * 1.1e0) / 6), 4) AS statistic FROM two, three")
def lr_test_scaled(spark, sf):
    t = D.lr_test(*nested(spark, sf), scaling=(1.1, 1.3))
    return spark.createDataFrame([(round(t["statistic_raw"], 4), t["df"], round(t["scaling_factor"], 6), round(t["statistic"], 4))], "statistic_raw double, df bigint, scaling_factor double, statistic double")


@query("gauss_hermite", "SELECT 1 AS node, round(-sqrt(3.0e0), 9) AS x, round(1.0e0 / 6, 9) AS w UNION ALL SELECT 2, 0.0e0, round(2.0e0 / 3, 9) UNION ALL SELECT 3, round(sqrt(3.0e0), 9), round(1.0e0 / 6, 9)")
def gauss_hermite_rule(spark, sf):
    x, w = gauss_hermite(3)
    return rounded(spark.createDataFrame([(i + 1, float(round(a, 12)) + 0.0, float(b)) for i, (a, b) in enumerate(zip(x, w))], "node bigint, x double, w double"), 9)


# ---------------------------------------------------------------- transitions

LTA_ITEMS, TIMES = ["busy", "buys"], [0, 1, 2, 3]
START, MOVES = [0.6, 0.4], [[[0.8, 0.2], [0.3, 0.7]], [[0.75, 0.25], [0.2, 0.8]], [[0.9, 0.1], [0.15, 0.85]]]
RHO = [[0.3, 0.25], [0.7, 0.8]]


def states(spark, sf) -> DataFrame:
    w = Q.weekly(spark, sf).select("user_id", "week", (F.col("view") >= 4).cast("int").alias("busy"), (F.col("purchase") >= 4).cast("int").alias("buys"))
    return panel.long_to_wide(w, id="user_id", time="week", items=LTA_ITEMS, times=TIMES)


SQL_STATES = f"{Q.SQL_WEEKLY}, states AS (SELECT user_id, " + ", ".join(f"max(CASE WHEN week = {t} THEN CASE WHEN {c} >= 4 THEN 1 ELSE 0 END END) AS {n}{t}" for t in TIMES for n, c in (("busy", "view"), ("buys", "purchase"))) + " FROM weekly GROUP BY user_id)"


def emission_sql(t: int, s: str) -> str:
    parts = []
    for j, n in enumerate(LTA_ITEMS):
        parts.append(f"coalesce(CASE WHEN {s} = 1 THEN {n}{t} * {num(math.log(RHO[0][j] / (1 - RHO[0][j])))} + {num(math.log(1 - RHO[0][j]))} ELSE {n}{t} * {num(math.log(RHO[1][j] / (1 - RHO[1][j])))} + {num(math.log(1 - RHO[1][j]))} END, 0.0e0)")
    return " + ".join(parts)


def pick(v, *index) -> str:
    """A value by status columns (1 or 2)."""
    if len(index) == 1:
        return f"CASE {index[0]} WHEN 1 THEN {num(math.log(v[0]))} ELSE {num(math.log(v[1]))} END"
    return f"CASE {index[0]} WHEN 1 THEN {pick(v[0], index[1])} ELSE {pick(v[1], index[1])} END"


SQL_PATHS = f"{SQL_STATES}, g AS (SELECT * FROM (VALUES (1), (2)) a(s0), (VALUES (1), (2)) b(s1), (VALUES (1), (2)) c(s2), (VALUES (1), (2)) d(s3)), paths AS (SELECT user_id, s0, s1, s2, s3, {pick(START, 's0')} + " + " + ".join(f"({pick(MOVES[t], f's{t}', f's{t + 1}')})" for t in range(3)) + " + " + " + ".join(emission_sql(t, f"s{t}") for t in TIMES) + " AS lp FROM states, g), total AS (SELECT user_id, ln(sum(exp(lp))) AS ll FROM paths GROUP BY user_id), pp AS (SELECT paths.*, ll, exp(lp - ll) AS p FROM paths JOIN total USING (user_id))"


def chain() -> T.Chain:
    return T.with_parameters(M.Spec([("binary", LTA_ITEMS)], 2), TIMES, START, MOVES, [{"p": np.array(RHO)}])


@query("lta_forward_backward", f"WITH {SQL_PATHS} SELECT user_id, round(any_value(ll), 6) AS loglik, " + ", ".join(f"round(sum(CASE WHEN s{t} = 1 THEN p ELSE 0 END), 6) AS g{t}" for t in TIMES) + " FROM pp GROUP BY user_id")
def lta_forward_backward(spark, sf):
    return rounded(chain().transform(states(spark, sf)).select("user_id", "loglik", *(F.col("posteriors")[t][0].alias(f"g{t}") for t in TIMES)))


@query("lta_viterbi", f"WITH {SQL_PATHS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(lp, 9) DESC, s3, s2, s1, s0) AS i FROM paths) SELECT user_id, s0, s1, s2, s3 FROM b WHERE i = 1")
def lta_viterbi(spark, sf):
    return rounded(chain().transform(states(spark, sf), "viterbi").select("user_id", *(F.col("statuses")[t].alias(f"s{t}") for t in TIMES)))


@query("lta_xi_counts", f"WITH {SQL_PATHS} " + " UNION ALL ".join(f"SELECT {t + 1} AS occasion, s{t} AS from_status, s{t + 1} AS to_status, round(sum(p), 6) AS count FROM pp GROUP BY s{t}, s{t + 1}" for t in range(3)))
def lta_xi_counts(spark, sf):
    return rounded(T.transition_counts(chain(), states(spark, sf)))


def prevalence(t: int) -> list[float]:
    p = np.array(START)
    for m in MOVES[:t]:
        p = p @ np.array(m)
    return p.tolist()


@query("status_prevalences", f"WITH {SQL_PATHS} " + " UNION ALL ".join(f"SELECT {t + 1} AS occasion, {s} AS status, round({num(prevalence(t)[s - 1])}, 6) AS model, round(sum(CASE WHEN s{t} = {s} THEN p ELSE 0 END) / count(DISTINCT user_id), 6) AS posterior FROM pp" for t in TIMES for s in (1, 2)))
def status_prevalences(spark, sf):
    return rounded(T.status_prevalences(chain(), chain().transform(states(spark, sf))))


@query("transition_patterns", f"WITH {SQL_PATHS}, m AS (SELECT user_id, " + ", ".join(f"CASE WHEN sum(CASE WHEN s{t} = 1 THEN p ELSE 0 END) >= 0.5 THEN 1 ELSE 2 END AS s{t}" for t in TIMES) + " FROM pp GROUP BY user_id) SELECT g.s0 AS status_1, g.s1 AS status_2, g.s2 AS status_3, g.s3 AS status_4, count(m.user_id) AS n FROM g LEFT JOIN m ON g.s0 = m.s0 AND g.s1 = m.s1 AND g.s2 = m.s2 AND g.s3 = m.s3 GROUP BY ALL")
def transition_patterns(spark, sf):
    c = chain()
    df = states(spark, sf)
    c.n = float(df.count())
    p = c.transition_patterns(spark, "modal", df)
    return p.select(*(F.col(f"status_{t}").cast("bigint").alias(f"status_{t}") for t in range(1, 5)), F.round("count").cast("bigint").alias("n"))


def rate_sql(t: int, a: int) -> str:
    hit = lambda last: f"sum(CASE WHEN busy{t} = {a} AND busy{t + 1} {last} THEN 1.0e0 ELSE 0.0e0 END)"
    return f"({hit('= 1')} + 1) / ({hit('IS NOT NULL')} + 2)"


#: Busy (1) and other (2) weeks as statuses seen without error: a start g and moves to busy, m, each with one case more a way.
SQL_BUSY = f"{SQL_STATES}, busy AS (SELECT (sum(CASE WHEN busy0 = 1 THEN 1.0e0 ELSE 0.0e0 END) + 1) / (count(busy0) + 2) AS g, " + ", ".join(f"{rate_sql(t, 2 - s)} AS m{t}_{s}" for t in range(3) for s in (1, 2)) + " FROM states)"


def busy_chain(spark, sf) -> T.Chain:
    """The chain of busy weeks by their own frequencies."""
    b = lambda t: F.col(f"`busy@{t}`")
    hit = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    cells = [hit(b(0) == 1), F.count(b(0))] + [hit(c) for t in range(3) for a in (1, 0) for c in ((b(t) == a) & (b(t + 1) == 1), (b(t) == a) & b(t + 1).isNotNull())]
    n = np.array([float(v or 0) for v in states(spark, sf).agg(*cells).first()]).reshape(7, 2)
    p = (n[:, 0] + 1) / (n[:, 1] + 2)
    both = np.column_stack([p, 1 - p])
    return T.with_parameters(M.Spec([("binary", LTA_ITEMS)], 2), TIMES, both[0], both[1:].reshape(3, 2, 2), [{"p": np.array(RHO)}])


def busy_sql(t: int, a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 1 THEN CASE WHEN {a} = 1 THEN m{t}_1 ELSE m{t}_2 END ELSE 1 - CASE WHEN {a} = 1 THEN m{t}_1 ELSE m{t}_2 END END)"


@query("transition_model_patterns", f"WITH {SQL_BUSY}, q AS (SELECT * FROM (VALUES (1), (2)) a(s0), (VALUES (1), (2)) b(s1), (VALUES (1), (2)) c(s2), (VALUES (1), (2)) d(s3)) SELECT s0 AS status_1, s1 AS status_2, s2 AS status_3, s3 AS status_4, round((CASE WHEN s0 = 1 THEN g ELSE 1 - g END) * {' * '.join(busy_sql(t, f's{t}', f's{t + 1}') for t in range(3))}, 6) AS proportion FROM q, busy")
def transition_model_patterns(spark, sf):
    c = busy_chain(spark, sf)
    c.n = 1.0
    return rounded(c.transition_patterns(spark).drop("count"))


@query("transition_matrix", f"WITH {SQL_BUSY} " + " UNION ALL ".join(f"SELECT {t + 1} AS occasion, {a} AS from_status, {b} AS to_status, round({busy_sql(t, str(a), str(b))}, 6) AS probability FROM busy" for t in range(3) for a in (1, 2) for b in (1, 2)))
def transition_matrix(spark, sf):
    return rounded(busy_chain(spark, sf).transition_matrix(spark))


@query("lta_pattern_collapse", f"WITH {SQL_STATES} SELECT " + ", ".join(f"{n}{t}" for t in TIMES for n in LTA_ITEMS) + ", count(*) AS n FROM states GROUP BY ALL")
def lta_pattern_collapse(spark, sf):
    from latticore.plans import patterns as P

    cols = panel.column_names(LTA_ITEMS, TIMES)
    p = P.collapse(states(spark, sf), cols)
    return rounded(p.select(*(F.col(f"`{c}`").alias(c.replace("@", "")) for c in cols), "n"))


# ---------------------------------------------------------------- growth

VALUES = [f"value@{t}" for t in TIMES]
BETA, VAR = [[20.0, 1.0], [40.0, -2.0]], [[200.0] * 4, [300.0] * 4]
PSI, THETA = [40.0, 60.0], [250.0, 280.0]


def trajectories(spark, sf) -> DataFrame:
    return panel.long_to_wide(Q.weekly(spark, sf).select("user_id", "week", "value"), id="user_id", time="week", items=["value"], times=TIMES)


SQL_TRAJ = f"{Q.SQL_WEEKLY}, traj AS (SELECT user_id, " + ", ".join(f"max(CASE WHEN week = {t} THEN value END) AS y{t}" for t in TIMES) + " FROM weekly GROUP BY user_id)"


def lcga_fit() -> G.Growth:
    return G.Growth("gaussian", VALUES, G.polynomial(TIMES, 1), np.array([0.6, 0.4]), np.array(BETA), {"var": np.array(VAR)}, math.nan, 0, math.nan, math.nan, True)


SQL_LCGA = f"{SQL_TRAJ}, " + Q.posterior_sql([f"{num(math.log((0.6, 0.4)[c] + 1e-15))} + " + " + ".join(f"coalesce(-0.5e0 * ({num(math.log(2 * math.pi * VAR[c][t]))} + (y{t} - {num(BETA[c][0] + BETA[c][1] * t)}) * (y{t} - {num(BETA[c][0] + BETA[c][1] * t)}) / {num(VAR[c][t])}), 0.0e0)" for t in TIMES) for c in range(2)], "traj", "user_id, " + ", ".join(f"y{t}" for t in TIMES))


@query("lcga_loglik", f"WITH {SQL_LCGA} " + Q.out_sql(2, "user_id"))
def lcga_loglik(spark, sf):
    return Q.scored_out(lcga_fit().transform(trajectories(spark, sf)), ["user_id"], 2)


@query("growth_observed", f"WITH {SQL_LCGA} " + " UNION ALL ".join(f"SELECT {c + 1} AS class, {t + 1} AS occasion, round(sum(p{c + 1} * y{t}) / sum(CASE WHEN y{t} IS NOT NULL THEN p{c + 1} END), 6) AS mean FROM post" for c in range(2) for t in TIMES))
def growth_observed(spark, sf):
    return rounded(G.growth_observed(lcga_fit().transform(trajectories(spark, sf)), VALUES, 2))


@query("growth_curves", f"WITH {Q.SQL_WEEKLY}, lines AS (SELECT user_id % 2 AS h, regr_intercept(value, week) AS a, regr_slope(value, week) AS b FROM weekly GROUP BY 1) " + " UNION ALL ".join(f"SELECT CAST(h + 1 AS BIGINT) AS class, {t + 1} AS occasion, round(a + b * {t}, 6) AS expected FROM lines" for t in TIMES))
def growth_curves(spark, sf):
    """Lines of the users of even and odd number as two classes."""
    rows = Q.weekly(spark, sf).groupBy((F.col("user_id") % 2).alias("h")).agg(F.regr_intercept("value", "week").alias("a"), F.regr_slope("value", "week").alias("b")).orderBy("h").collect()
    return rounded(replace(lcga_fit(), beta=np.array([[r.a, r.b] for r in rows])).curves(spark))


def gmm_sql(c: int, slopes=None) -> str:
    """The log-joint of class c; slopes are of the growth factors by z = user_id % 2."""
    shift = [f" - {num(slopes[c][0] + slopes[c][1] * t)} * (user_id % 2)" if slopes else "" for t in TIMES]
    d = [f"(y{t} - {num(BETA[c][0] + BETA[c][1] * t)}{shift[t]})" for t in TIMES]
    n = " + ".join(f"(y{t} IS NOT NULL)::INT" for t in TIMES)
    sq, s = " + ".join(f"coalesce({x} * {x}, 0)" for x in d), " + ".join(f"coalesce({x}, 0)" for x in d)
    psi, theta = num(PSI[c]), num(THETA[c])
    return f"{num(math.log((0.6, 0.4)[c] + 1e-15))} - 0.5e0 * (({n}) * {num(math.log(2 * math.pi))} + (({n}) - 1) * ln({theta}) + ln({theta} + ({n}) * {psi}) + (({sq}) - {psi} / ({theta} + ({n}) * {psi}) * ({s}) * ({s})) / {theta})"


@query("gmm_loglik", f"WITH {SQL_TRAJ}, " + Q.posterior_sql([gmm_sql(0), gmm_sql(1)], "traj", "user_id") + " " + Q.out_sql(2, "user_id"))
def gmm_loglik(spark, sf):
    return Q.scored_out(gmm_fit().transform(trajectories(spark, sf)), ["user_id"], 2)


def gmm_fit() -> G.Growth:
    extra = {"psi": np.array([[[PSI[0]]], [[PSI[1]]]]), "theta": np.array([[THETA[0]] * 4, [THETA[1]] * 4])}
    return G.Growth("gaussian+random", VALUES, G.polynomial(TIMES, 1), np.array([0.6, 0.4]), np.array(BETA), extra, math.nan, 0, math.nan, math.nan, True)


GROWTH_SLOPES = [[1.5, -0.5], [-2.0, 0.25]]


@query("gmm_predictors_loglik", f"WITH {SQL_TRAJ}, " + Q.posterior_sql([gmm_sql(0, GROWTH_SLOPES), gmm_sql(1, GROWTH_SLOPES)], "traj", "user_id") + " " + Q.out_sql(2, "user_id"))
def gmm_predictors_loglik(spark, sf):
    g = gmm_fit()
    g.extra["slopes"], g.predictors, g.by_class = np.array(GROWTH_SLOPES)[:, :, None], ["z"], True
    return Q.scored_out(g.transform(trajectories(spark, sf).withColumn("z", (F.col("user_id") % 2).cast("double"))), ["user_id"], 2)


# ---------------------------------------------------------------- streams

LINE = ["returned", "bulk", "dear"]
LINE_P = [[0.2, 0.3, 0.6], [0.6, 0.8, 0.4]]


def line_flags(li: DataFrame) -> DataFrame:
    return li.select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_quantity") >= 25).cast("int").alias("bulk"), (F.col("l_discount") >= 0.05).cast("int").alias("dear"))


def line_fit() -> M.Fit:
    return M.with_parameters(M.Spec([("binary", LINE)], 2), np.array([0.5, 0.5]), [{"p": np.array(LINE_P)}])


SQL_LINES = "lf AS (SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS bulk, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS dear FROM lineitem), " + Q.posterior_sql([f"{num(math.log(0.5 + 1e-15))} + {Q.bern_sql(LINE, LINE_P, c)}" for c in range(2)], "lf", "l_orderkey, l_linenumber, l_shipdate")


def line_stream(spark, sf) -> DataFrame:
    return line_flags(scoring.read_stream(spark, sf, "lineitem.parquet"))


@query("stream_scoring", f"WITH {SQL_LINES} " + Q.out_sql(2, "l_orderkey, l_linenumber"))
def stream_scoring(spark, sf):
    scored = scoring.score_stream(line_fit(), line_stream(spark, sf))
    flat = scored.select("l_orderkey", "l_linenumber", "loglik", *(F.col("posterior")[c].alias(f"p{c + 1}") for c in range(2)))
    return rounded(scoring.run_available(flat))


@query("stream_windowed_classes")
def stream_windowed_classes(spark, sf):
    """Windows that the watermark has closed: no SQL, as what is late depends on the order of arrival."""
    return scoring.run_available(scoring.windowed_classes(line_fit(), line_stream(spark, sf), "l_shipdate", "30 days", "1 day").select(F.col("window.start").alias("start"), "class", "n", "mass_1", "mass_2"))


@query("batch_windowed_classes", f"WITH {SQL_LINES} SELECT date_trunc('month', l_shipdate) AS start, class, count(*) AS n, round(sum(p1), 6) AS mass_1 FROM post GROUP BY 1, 2")
def batch_windowed_classes(spark, sf):
    scored = line_fit().transform(line_flags(table(spark, sf, "lineitem")))
    return rounded(scored.groupBy(F.date_trunc("month", "l_shipdate").alias("start"), "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("posterior")[0]).alias("mass_1")))


# ---------------------------------------------------------------- whole fits


def frame(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows))


@query("fit_lca")
def fit_lca(spark, sf):
    return M.fit_mixture(Q.gaps(Q.flags(spark, sf)), Q.FLAGS, 3, "binary", n_init=8, tol=1e-7).measurement_summary(spark)


@query("fit_lpa")
def fit_lpa(spark, sf):
    return M.fit_mixture(Q.sizes(spark, sf), ["quantity", "discount"], 2, "continuous", n_init=4, tol=1e-6).measurement_summary(spark)


@query("fit_mixed")
def fit_mixed(spark, sf):
    return M.fit_mixture(Q.mixed(spark, sf), ["quantity", "returns", "returned", "bulk"], 2, {"continuous": ["quantity"], "count": ["returns"], "binary": ["returned", "bulk"]}, n_init=4, tol=1e-6).measurement_summary(spark)


@query("compare_mixtures")
def compare_mixtures(spark, sf):
    return M.compare_mixtures(Q.flags(spark, sf), Q.FLAGS, [1, 2, 3], "binary", n_init=6, tol=1e-7)[0]


@query("blrt")
def blrt(spark, sf):
    df = Q.flags(spark, sf)
    a, b = (M.fit_mixture(df, Q.FLAGS, k, "binary", n_init=4, tol=1e-6) for k in (1, 2))
    t = D.blrt(df, a, b, n_reps=19, n_init=1, tol=1e-5)
    return frame(spark, [{k: t[k] for k in ("p_value", "obs_diff", "n_reps", "n_negative")}])


@query("fit_lta")
def fit_lta(spark, sf):
    return T.fit_lta(states(spark, sf), LTA_ITEMS, TIMES, 2, n_init=6, tol=1e-7).transition_matrix(spark)


@query("fit_rmlca")
def fit_rmlca(spark, sf):
    return T.fit_rmlca(states(spark, sf), LTA_ITEMS, TIMES, 2, n_init=4, tol=1e-7).measurement_summary(spark)


@query("fit_lcga")
def fit_lcga(spark, sf):
    w = panel.long_to_wide(Q.weekly(spark, sf).select("user_id", "week", "view"), id="user_id", time="week", items=["view"], times=TIMES)
    return G.fit_lcga(w, [f"view@{t}" for t in TIMES], 2, family="poisson", n_init=4, tol=1e-7).curves(spark)


@query("fit_gmm")
def fit_gmm(spark, sf):
    return G.fit_gmm(trajectories(spark, sf), VALUES, 2, random_effects="intercept", n_init=3, tol=1e-6, max_iter=300).curves(spark)


@query("three_step_covariates")
def three_step_covariates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("dear"))
    scored = Q.cat_scored(spark, sf).join(o, "o_orderkey")
    return spark.createDataFrame(pd.concat([t.assign(correction=c) for c, t in S.compare_corrections(scored, ["dear"], 2).items()]))


@query("two_step_covariates")
def two_step_covariates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("dear"))
    return spark.createDataFrame(S.two_step_covariates(Q.cat_scored(spark, sf).join(o, "o_orderkey"), ["dear"], [0.6, 0.4]))


def segment_patterns(spark, sf) -> DataFrame:
    """Scored patterns of order features and their customer's segment, with the number of orders, n: a row depends on nothing else."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    rows = Q.coded(spark, sf).join(o, "o_orderkey").join(c, "o_custkey")
    patterns = rows.groupBy("priority", "status", "segment").agg(F.sum(F.lit(1.0)).alias("n"))
    return M.with_parameters(Q.CAT, np.array([0.6, 0.4]), [{"p": Q.CAT_P}]).transform(patterns)


@query("ml_outcome")
def ml_outcome(spark, sf):
    return spark.createDataFrame(S.ml_outcome(segment_patterns(spark, sf), "segment", 2, weight="n"))


@query("simulate")
def simulate(spark, sf):
    return spark.createDataFrame(M.simulate(Q.lca(), 1000, seed=5))


@query("joint_classes")
def joint_classes(spark, sf):
    r = T.fit_joint_classes(Q.flags(spark, sf), Q.FLAGS[:3], Q.FLAGS[2:], 2, 2, n_init=3, tol=1e-6)
    return frame(spark, [{"x": a + 1, "y": b + 1, "probability": float(r["transitions"][a, b])} for a in range(2) for b in range(2)])


@query("mcar_test")
def mcar(spark, sf):
    from latticore.plans import patterns as P

    t = P.collapse(Q.gaps(Q.flags(spark, sf)), Q.FLAGS, names=("_weight", "_rows")).toPandas()  # at most 3^5 patterns
    return frame(spark, [D.mcar_test(*M.pattern_arrays(t, Q.FLAGS), [[0, 1]] * 5)])


@query("measurement_estimates")
def measurement_estimates(spark, sf):
    from latticore.plans import patterns as P

    df = Q.flags(spark, sf)
    t = P.collapse(df, Q.FLAGS, names=("_weight", "_rows")).toPandas()
    return spark.createDataFrame(M.fit_mixture(df, Q.FLAGS, 2, "binary", n_init=4, tol=1e-8).measurement_estimates(*M.pattern_arrays(t, Q.FLAGS)).drop(columns="category"))


@query("merge_path")
def merge_path(spark, sf):
    from latticore.plans import patterns as P

    t = Q.lca().transform(P.collapse(Q.flags(spark, sf), Q.FLAGS)).select("posterior", "w").toPandas()
    return spark.createDataFrame(D.merge_path(np.stack(t["posterior"].to_numpy()), t["w"].to_numpy()))


@query("vlmr_test")
def vlmr(spark, sf):
    from latticore.plans import patterns as P

    df = Q.flags(spark, sf)
    t = P.collapse(df, Q.FLAGS, names=("_weight", "_rows")).toPandas()
    a, b = (M.fit_mixture(df, Q.FLAGS, k, "binary", n_init=4, tol=1e-9) for k in (1, 2))
    return frame(spark, [D.vlmr_test(a, b, *M.pattern_arrays(t, Q.FLAGS))])
