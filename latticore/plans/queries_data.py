"""Registered queries over the star schema: ingestion, patterns, measurement, one iteration, classification and fit.

Each query runs the library's operators; its SQL is written out on its own, from the formulas.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.operators import diagnostics as D
from latticore.operators import mixture as M
from latticore.plans import patterns as P
from latticore.registry import query
from latticore.sources import panel

FLAGS = ["returned", "discounted", "taxed", "bulk", "pending"]
COND = {"returned": "l_returnflag = 'R'", "discounted": "l_discount >= 0.09", "taxed": "l_tax >= 0.07", "bulk": "l_quantity >= 40", "pending": "l_linestatus = 'O' AND l_quantity >= 20"}
#: Classes of the fixed-parameter queries.
PI = [0.5, 0.3, 0.2]
PROB = [[0.8, 0.3, 0.25, 0.4, 0.7], [0.35, 0.6, 0.2, 0.7, 0.9], [0.6, 0.1, 0.5, 0.15, 0.4]]


def num(x: float) -> str:
    return f"({x:.17e})"


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint") else F.col(f"`{c}`") for c, t in df.dtypes))


def flags(spark, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(*(F.max(F.expr(f"CASE WHEN {COND[f]} THEN 1 ELSE 0 END")).alias(f) for f in FLAGS))


SQL_FLAGS = "flags AS (SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN {COND[f]} THEN 1 ELSE 0 END) AS {f}" for f in FLAGS) + " FROM lineitem GROUP BY l_orderkey)"


def gaps(df: DataFrame) -> DataFrame:
    return df.withColumns({f: F.when(F.col("l_orderkey") % (7 + 4 * j) != 0, F.col(f)) for j, f in enumerate(FLAGS)})


SQL_GAPS = "gaps AS (SELECT l_orderkey, " + ", ".join(f"CASE WHEN l_orderkey % {7 + 4 * j} <> 0 THEN {f} END AS {f}" for j, f in enumerate(FLAGS)) + " FROM flags)"
SOME = f"WHERE coalesce({', '.join(FLAGS)}) IS NOT NULL"


# ---------------------------------------------------------------- patterns and ingestion


@query("pattern_collapse", f"WITH {SQL_FLAGS} SELECT {', '.join(FLAGS)}, CAST(count(*) AS DOUBLE) AS w, count(*) AS n FROM flags GROUP BY {', '.join(FLAGS)}")
def pattern_collapse(spark, sf):
    return P.collapse(flags(spark, sf), FLAGS)


@query("pattern_missing", f"WITH {SQL_FLAGS}, {SQL_GAPS} SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FLAGS)}, CAST(count(*) AS DOUBLE) AS w, count(*) AS n FROM gaps GROUP BY {', '.join('gaps.' + f for f in FLAGS)}")
def pattern_missing(spark, sf):
    return P.collapse(gaps(flags(spark, sf)), FLAGS).withColumns({f: F.col(f).cast("double") for f in FLAGS})


@query("pattern_weighted", f"WITH {SQL_FLAGS} SELECT {', '.join(FLAGS)}, round(sum(o_totalprice), 2) AS w, count(*) AS n FROM flags JOIN orders ON l_orderkey = o_orderkey GROUP BY {', '.join(FLAGS)}")
def pattern_weighted(spark, sf):
    joined = flags(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(P.collapse(joined, FLAGS, "o_totalprice"), 2)


@query("pattern_expand", f"WITH {SQL_FLAGS}, {SQL_GAPS}, p AS (SELECT {', '.join(FLAGS)}, count(*) AS n FROM gaps GROUP BY ALL) SELECT l_orderkey, p.n FROM gaps JOIN p ON " + " AND ".join(f"gaps.{f} IS NOT DISTINCT FROM p.{f}" for f in FLAGS))
def pattern_expand(spark, sf):
    g = gaps(flags(spark, sf))
    return P.expand(g, P.collapse(g, FLAGS), FLAGS, ["n"]).select("l_orderkey", "n")


@query("pattern_numbered", f"WITH {SQL_FLAGS}, {SQL_GAPS}, p AS (SELECT {', '.join(FLAGS)}, count(*) AS n FROM gaps GROUP BY ALL) SELECT row_number() OVER (ORDER BY {', '.join(f + ' NULLS FIRST' for f in FLAGS)}) AS pattern_id, n FROM p")
def pattern_numbered(spark, sf):
    return rounded(P.numbered(P.collapse(gaps(flags(spark, sf)), FLAGS), FLAGS).select("pattern_id", "n"))


@query("binary_recode", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS parity, CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal <= 0 THEN 0 END AS positive FROM customer")
def binary_recode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, 2).otherwise(1).alias("parity"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("positive"))
    return panel.recode_binary(c, ["parity", "positive"])[0].select("c_custkey", F.col("parity").cast("bigint").alias("parity"), F.col("positive").cast("bigint").alias("positive"))


HINTS = ["l_linenumber", "l_quantity", "l_discount", "l_extendedprice"]


@query("measurement_hint", " UNION ALL ".join(f"SELECT '{c}' AS item, CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' WHEN bool_and({c} = floor({c})) AND min({c}) >= 0 AND count(DISTINCT {c}) <= 10 THEN 'categorical' WHEN bool_and({c} = floor({c})) AND min({c}) >= 0 THEN 'count' ELSE 'continuous' END AS family FROM lineitem" for c in HINTS))
def measurement_hint(spark, sf):
    return spark.createDataFrame(list(panel.measurement_hint(table(spark, sf, "lineitem"), HINTS).items()), "item string, family string")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("covariate_dummies", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = s[{i + 2}] THEN 1.0e0 ELSE 0.0e0 END AS d{i + 1}" for i in range(3)) + " FROM customer, (SELECT list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer)")
def covariate_dummies(spark, sf):
    df, terms = panel.dummies(table(spark, sf, "customer"), ["c_mktsegment"])
    return df.select("c_custkey", *(F.col(f"`{c}`").alias(f"d{i + 1}") for i, c in enumerate(terms["c_mktsegment"][:3])))


@query("covariate_interaction", "SELECT c_custkey, c_acctbal * (CASE WHEN c_mktsegment = s[2] THEN 1.0e0 ELSE 0.0e0 END) AS x FROM customer, (SELECT list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer)")
def covariate_interaction(spark, sf):
    df, terms = panel.dummies(table(spark, sf, "customer"), ["c_acctbal:c_mktsegment"])
    return df.select("c_custkey", F.col(f"`{terms['c_acctbal:c_mktsegment'][0]}`").alias("x"))


@query("covariates_listwise", "SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS used FROM customer")
def covariates_listwise(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("b"))
    return c.select("c_custkey", panel.predictors_observed(["a", "b"]).alias("used"))


@query("covariates_imputed", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, covar_samp(a, b) AS cab, var_samp(b) + 1e-6 AS vb FROM c) SELECT c_custkey, round(coalesce(a, ma + cab / vb * (b - mb)), 6) AS a FROM c, m""")
def covariates_imputed(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return rounded(panel.impute_conditional_means(c, ["a", "b"]).select("c_custkey", "a"))


@query("empty_row_filter", f"WITH {SQL_FLAGS}, {SQL_GAPS} SELECT l_orderkey FROM gaps WHERE coalesce(returned, discounted) IS NOT NULL")
def empty_row_filter(spark, sf):
    return panel.drop_empty(gaps(flags(spark, sf)), ["returned", "discounted"]).select("l_orderkey")


@query("weights_rescale", "SELECT o_orderkey, round(o_totalprice * (count(*) OVER ()) / (sum(o_totalprice) OVER ()), 6) AS w FROM orders")
def weights_rescale(spark, sf):
    return rounded(panel.rescale_weights(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "w"))


WEEKS, KINDS = [0, 1, 2, 3], ["view", "click", "purchase"]


def weekly(spark, sf):
    """One row per user and week (of eight days, the last open) with events: counts by kind and the mean value."""
    e = table(spark, sf, "events").withColumn("week", F.least(F.floor(F.datediff("ts", F.to_date(F.lit("2024-01-01"))) / 8), F.lit(3)).cast("int"))
    return e.groupBy("user_id", "week").agg(*(F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(k) for k in KINDS), F.avg("value").alias("value"))


SQL_WEEKLY = "weekly AS (SELECT user_id, CAST(least(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 8), 3) AS INTEGER) AS week, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in KINDS) + ", avg(value) AS value FROM events GROUP BY 1, 2)"
SQL_WIDE = "wide AS (SELECT user_id, " + ", ".join(f'max(CASE WHEN week = {t} THEN {k} END) AS "{k}@{t}"' for t in WEEKS for k in KINDS) + " FROM weekly GROUP BY user_id)"
WIDE = [f"{k}@{t}" for t in WEEKS for k in KINDS]


def wide(spark, sf):
    return panel.long_to_wide(weekly(spark, sf), id="user_id", time="week", items=KINDS, times=WEEKS)


@query("long_to_wide_panel", f"WITH {SQL_WEEKLY}, {SQL_WIDE} SELECT user_id, " + ", ".join(f'"{c}" AS {c.replace("@", "_")}' for c in WIDE) + " FROM wide")
def long_to_wide_panel(spark, sf):
    return wide(spark, sf).select("user_id", *(F.col(f"`{c}`").alias(c.replace("@", "_")) for c in WIDE))


@query("item_major_reorder", f"WITH {SQL_WEEKLY}, {SQL_WIDE} SELECT user_id, " + ", ".join(f'"{k}@{t}" AS t{t}_{k}' for t in WEEKS for k in KINDS) + " FROM wide")
def item_major_reorder(spark, sf):
    w = wide(spark, sf).select("user_id", *(F.col(f"`{k}@{t}`").alias(f"{k}{t}") for k in KINDS for t in WEEKS))
    p = panel.wide_to_panel(w, [f"{k}{t}" for k in KINDS for t in WEEKS], KINDS, WEEKS, "item_major")
    return p.select("user_id", *(F.col(f"`{k}@{t}`").alias(f"t{t}_{k}") for t in WEEKS for k in KINDS))


@query("array_to_panel", f"WITH {SQL_WEEKLY}, {SQL_WIDE} SELECT user_id, " + ", ".join(f'"{k}@{t}" AS t{t}_{k}' for t in WEEKS for k in KINDS) + " FROM wide")
def array_to_panel(spark, sf):
    w = wide(spark, sf).select("user_id", F.array(*(F.array(*(F.col(f"`{k}@{t}`") for k in KINDS)) for t in WEEKS)).alias("a"))
    p = panel.array_to_panel(w, "a", KINDS, WEEKS)
    return p.select("user_id", *(F.col(f"`{k}@{t}`").alias(f"t{t}_{k}") for t in WEEKS for k in KINDS))


@query("wave_missing", f"WITH {SQL_WEEKLY}, {SQL_WIDE} SELECT user_id, " + ", ".join(f'"view@{t}" IS NULL AS missing_{t}' for t in WEEKS) + " FROM wide")
def wave_missing(spark, sf):
    return panel.wave_missing(wide(spark, sf), KINDS, WEEKS).select("user_id", *(F.col(f"`missing@{t}`").alias(f"missing_{t}") for t in WEEKS))


@query("stack_occasions", f"WITH {SQL_WEEKLY} SELECT u.user_id, t + 1 AS occasion, {', '.join(KINDS)} FROM (SELECT DISTINCT user_id FROM weekly) u CROSS JOIN range(4) AS r(t) LEFT JOIN weekly w ON w.user_id = u.user_id AND week = t")
def stack_occasions(spark, sf):
    return rounded(panel.stack_occasions(wide(spark, sf), KINDS, WEEKS, ["user_id"]).drop("time"))


# ---------------------------------------------------------------- densities with fixed parameters


def bern_sql(items, probs, k):
    return " + ".join(f"coalesce({c} * {num(math.log(p) - math.log1p(-p))} + {num(math.log1p(-p))}, 0.0e0)" for c, p in zip(items, probs[k]))


def posterior_sql(logs: list[str], source: str, keep: str, digits: int = 6) -> str:
    """keep, loglik, p1..pK and class from the classes' log-joint expressions."""
    k = len(logs)
    inner = ", ".join(f"{e} AS l{c}" for c, e in enumerate(logs))
    top = f"greatest({', '.join(f'l{c}' for c in range(k))})" if k > 1 else "l0"
    total = " + ".join(f"exp(l{c} - top)" for c in range(k))
    cls = "CASE " + " ".join(f"WHEN l{c} = top THEN {c + 1}" for c in range(k)) + " END"
    return f"lj AS (SELECT {keep}, {inner} FROM {source}), lt AS (SELECT *, {top} AS top FROM lj), post AS (SELECT {keep}, top + ln({total}) AS loglik, " + ", ".join(f"exp(l{c} - top) / ({total}) AS p{c + 1}" for c in range(k)) + f", {cls} AS class FROM lt)"


def out_sql(k: int, keep: str, digits: int = 6) -> str:
    return f"SELECT {keep}, round(loglik, {digits}) AS loglik, " + ", ".join(f"round(p{c + 1}, {digits}) AS p{c + 1}" for c in range(k)) + " FROM post"


def scored_out(df: DataFrame, keep: list[str], k: int) -> DataFrame:
    return rounded(df.select(*keep, "loglik", *(F.col("posterior")[c].alias(f"p{c + 1}") for c in range(k))))


def log_pi(c: int, pi=PI) -> str:
    return num(math.log(pi[c] + 1e-15))


LCA = M.Spec([("binary", FLAGS)], 3)
LCA_LOGS = [f"{log_pi(c)} + {bern_sql(FLAGS, PROB, c)}" for c in range(3)]


def lca() -> M.Fit:
    return M.with_parameters(LCA, np.array(PI), [{"p": np.array(PROB)}])


SQL_LCA = f"{SQL_FLAGS}, {SQL_GAPS}, " + f"held AS (SELECT * FROM gaps {SOME}), " + posterior_sql(LCA_LOGS, "held", "l_orderkey, " + ", ".join(FLAGS))


def lca_scored(spark, sf):
    return lca().transform(panel.drop_empty(gaps(flags(spark, sf)), FLAGS))


@query("estep_bernoulli", f"WITH {SQL_LCA} " + out_sql(3, "l_orderkey"))
def estep_bernoulli(spark, sf):
    return scored_out(lca_scored(spark, sf), ["l_orderkey"], 3)


@query("modal_assignment", f"WITH {SQL_LCA} SELECT l_orderkey, class, round(greatest(p1, p2, p3), 6) AS probability FROM post")
def modal_assignment(spark, sf):
    return rounded(lca_scored(spark, sf).select("l_orderkey", "class", "probability"))


PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


def coded(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 3).alias("status"))


SQL_CODED = "coded AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS status FROM orders)"
CAT_P = np.array([[[0.3, 0.3, 0.2, 0.1, 0.1], [0.5, 0.3, 0.2, 0.0, 0.0]], [[0.1, 0.1, 0.2, 0.2, 0.4], [0.2, 0.2, 0.6, 0.0, 0.0]]])
CAT = M.Spec([("categorical", ["priority", "status"])], 2, cats={"priority": 5, "status": 3})


def cat_sql(c):
    return f"{log_pi(c, [0.6, 0.4])} + " + " + ".join("coalesce(CASE " + name + " " + " ".join(f"WHEN {v + 1} THEN {num(math.log(CAT_P[c, j, v]))}" for v in range(n)) + " END, 0.0e0)" for j, (name, n) in enumerate((("priority", 5), ("status", 3))))


SQL_CAT = f"{SQL_CODED}, " + posterior_sql([cat_sql(0), cat_sql(1)], "coded", "o_orderkey, priority, status")


def cat_scored(spark, sf):
    return M.with_parameters(CAT, np.array([0.6, 0.4]), [{"p": CAT_P}]).transform(coded(spark, sf))


@query("estep_multinoulli", f"WITH {SQL_CAT} " + out_sql(2, "o_orderkey"))
def estep_multinoulli(spark, sf):
    return scored_out(cat_scored(spark, sf), ["o_orderkey"], 2)


SQL_THRESHOLDS = " UNION ALL ".join(f"SELECT CAST(o_orderkey % 2 + 1 AS BIGINT) AS class, {v} AS threshold, round(ln(count(*) FILTER (WHERE priority > {v}) * 1.0e0 / count(*) FILTER (WHERE priority <= {v})), 6) AS logit FROM coded GROUP BY 1" for v in range(1, 5))


@query("ordinal_thresholds", f"WITH {SQL_CODED} {SQL_THRESHOLDS}")
def ordinal_thresholds(spark, sf):
    """Cumulative logits of priorities; orders of even and odd key are the classes."""
    shares = coded(spark, sf).groupBy((F.col("o_orderkey") % 2).alias("h")).agg(*(F.avg((F.col("priority") == v).cast("double")).alias(f"p{v}") for v in range(1, 6))).orderBy("h").collect()
    p = CAT_P.copy()
    p[:, 0] = [[r[f"p{v}"] for v in range(1, 6)] for r in shares]
    th = CAT.emissions()[0].thresholds({"p": p})[0]
    return rounded(spark.createDataFrame([(c + 1, v + 1, float(th[c, v])) for c in range(2) for v in range(4)], "class bigint, threshold bigint, logit double"))


def sizes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count(F.lit(1)).alias("lines"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returns"))


SQL_SIZES = "sizes AS (SELECT l_orderkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, count(*) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returns FROM lineitem GROUP BY l_orderkey)"
GAUSS = {"mean": np.array([[20.0, 0.04], [32.0, 0.06]]), "var": np.array([[60.0, 0.0006], [40.0, 0.0005]])}
LPA = M.Spec([("continuous:class", ["quantity", "discount"])], 2)


def gauss_sql(c, pi=(0.55, 0.45)):
    return f"{log_pi(c, pi)} + " + " + ".join(f"({n} - {num(GAUSS['mean'][c, j])}) * ({n} - {num(GAUSS['mean'][c, j])}) * {num(-0.5 / GAUSS['var'][c, j])} - {num(0.5 * math.log(2 * math.pi * GAUSS['var'][c, j]))}" for j, n in enumerate(("quantity", "discount")))


SQL_LPA = f"{SQL_SIZES}, " + posterior_sql([gauss_sql(0), gauss_sql(1)], "sizes", "l_orderkey, quantity, discount, lines, returns")


def lpa_scored(spark, sf):
    return M.with_parameters(LPA, np.array([0.55, 0.45]), [GAUSS]).transform(sizes(spark, sf))


@query("estep_gaussian", f"WITH {SQL_LPA} " + out_sql(2, "l_orderkey"))
def estep_gaussian(spark, sf):
    return scored_out(lpa_scored(spark, sf), ["l_orderkey"], 2)


RATE = {"rate": np.array([[3.0, 0.8], [6.0, 2.5]])}
ZERO = RATE | {"zero": np.array([[0.1, 0.3], [0.05, 0.15]])}
OVER = RATE | {"alpha": np.array([0.2, 0.6])}
COUNTS = ["lines", "returns"]


def pois_cell(n, r):
    return f"{n} * {num(math.log(r))} - {num(r)} - lgamma({n} + 1)"


def zip_cell(n, r, z):
    return f"CASE WHEN {n} = 0 THEN {num(math.log(z + (1 - z) * math.exp(-r)))} ELSE {num(math.log1p(-z))} + {pois_cell(n, r)} END"


def nb_cell(n, r, a):
    s = 1 / a
    return f"lgamma({n} + {num(s)}) - {num(math.lgamma(s))} - lgamma({n} + 1) + {num(s * math.log(s / (s + r)))} + {n} * {num(math.log(r / (s + r)))}"


def count_query(name, family, params, cell):
    logs = [f"{log_pi(c, (0.5, 0.5))} + " + " + ".join(f"({cell(n, c, j)})" for j, n in enumerate(COUNTS)) for c in range(2)]

    @query(name, f"WITH {SQL_SIZES}, " + posterior_sql(logs, "sizes", "l_orderkey") + " " + out_sql(2, "l_orderkey"))
    def run(spark, sf):
        fit = M.with_parameters(M.Spec([(family, COUNTS)], 2), np.array([0.5, 0.5]), [params])
        return scored_out(fit.transform(sizes(spark, sf)), ["l_orderkey"], 2)


count_query("estep_poisson", "count", RATE, lambda n, c, j: pois_cell(n, float(RATE["rate"][c, j])))
count_query("estep_zip", "zip", ZERO, lambda n, c, j: zip_cell(n, float(RATE["rate"][c, j]), float(ZERO["zero"][c, j])))
count_query("estep_negbin", "negbin", OVER, lambda n, c, j: nb_cell(n, float(RATE["rate"][c, j]), float(OVER["alpha"][j])))

MIXED = M.Spec([("continuous:class", ["quantity", "discount"]), ("count", COUNTS), ("binary", ["returned", "bulk"])], 2)
MIXED_P = [[0.7, 0.3], [0.4, 0.8]]


def mixed(spark, sf):
    return sizes(spark, sf).join(gaps(flags(spark, sf)).select("l_orderkey", "returned", "bulk"), "l_orderkey")


@query("estep_mixed", f"WITH {SQL_SIZES}, {SQL_FLAGS}, {SQL_GAPS}, m AS (SELECT sizes.*, returned, bulk FROM sizes JOIN gaps USING (l_orderkey)), " + posterior_sql([gauss_sql(c) + " + " + " + ".join(f"({pois_cell(n, float(RATE['rate'][c, j]))})" for j, n in enumerate(COUNTS)) + " + " + bern_sql(["returned", "bulk"], MIXED_P, c) for c in range(2)], "m", "l_orderkey") + " " + out_sql(2, "l_orderkey"))
def estep_mixed(spark, sf):
    fit = M.with_parameters(MIXED, np.array([0.55, 0.45]), [GAUSS, RATE, {"p": np.array(MIXED_P)}])
    return scored_out(fit.transform(mixed(spark, sf)), ["l_orderkey"], 2)


# ---------------------------------------------------------------- the update


def params_frame(spark, spec: M.Spec, pi, params) -> DataFrame:
    rows = [("class", "share", 0, k + 1, float(v)) for k, v in enumerate(pi)] + [(i, n, v or 0, k, x) for e, p in zip(spec.emissions(), params) for i, n, v, k, x in e.rows(p)]
    return rounded(spark.createDataFrame(rows, "item string, parameter string, category bigint, class bigint, estimate double"))


def share_sql(k: int, w: str = "1") -> str:
    return " UNION ALL ".join(f"SELECT 'class' AS item, 'share' AS parameter, CAST(0 AS BIGINT) AS category, {c + 1} AS class, round((sum({w} * p{c + 1}) + {num(1 / k)}) / (sum({w}) + 1.0e0), 6) AS estimate FROM post" for c in range(k))


def bern_update_sql(k: int, items, w: str = "1", source: str = "post") -> str:
    a = num(1 / k)
    return " UNION ALL ".join(f"SELECT '{n}' AS item, 'p' AS parameter, CAST(0 AS BIGINT) AS category, {c + 1} AS class, round((sum({w} * p{c + 1} * {n}) + {a} * sum({w} * {n}) / sum(CASE WHEN {n} IS NOT NULL THEN {w} END)) / (sum(CASE WHEN {n} IS NOT NULL THEN {w} * p{c + 1} END) + {a}), 6) AS estimate FROM {source}" for c in range(k) for n in items)


@query("mstep_bernoulli", f"WITH {SQL_LCA} {share_sql(3)} UNION ALL {bern_update_sql(3, FLAGS)}")
def mstep_bernoulli(spark, sf):
    table, fit = P.collapse(gaps(flags(spark, sf)), FLAGS).persist(), lca()  # at most 3^5 patterns, aggregated once for both sums
    pi, params = M.m_step(fit.transform(table), LCA, fit.params, M.marginals(table, LCA, "w"), "w")
    table.unpersist()
    return params_frame(spark, LCA, pi, params)


@query("mstep_multinoulli", f"WITH {SQL_CAT}, s AS (SELECT * FROM post) {share_sql(2)} UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', 'probability', {v + 1}, {c + 1}, round((sum(CASE WHEN {n} = {v + 1} THEN p{c + 1} ELSE 0 END) + 0.5e0 * sum(CASE WHEN {n} = {v + 1} THEN 1 ELSE 0 END) / count({n})) / (sum(CASE WHEN {n} IS NOT NULL THEN p{c + 1} END) + 0.5e0), 6) FROM s" for n, m in (("priority", 5), ("status", 3)) for v in range(m) for c in range(2)))
def mstep_multinoulli(spark, sf):
    df = coded(spark, sf)
    pi, params = M.m_step(cat_scored(spark, sf), CAT, [{"p": CAT_P}], M.marginals(df, CAT))
    return params_frame(spark, CAT, pi, params)


def gauss_update_sql(equal: bool) -> str:
    parts = []
    for n in ("quantity", "discount"):
        mean = [f"(sum(p{c + 1} * {n}) / sum(p{c + 1}))" for c in range(2)]
        ss = [f"(sum(p{c + 1} * {n} * {n}) - sum(p{c + 1} * {n}) * {mean[c]})" for c in range(2)]
        for c in range(2):
            var = f"(({ss[0]} + {ss[1]}) + var_pop({n})) / (sum(p1) + sum(p2) + 1.0e0)" if equal else f"({ss[c]} + 0.5e0 * var_pop({n})) / (sum(p{c + 1}) + 0.5e0)"
            parts += [f"SELECT '{n}', 'mean', CAST(0 AS BIGINT), {c + 1}, round({mean[c]}, 6) FROM post", f"SELECT '{n}', 'var', CAST(0 AS BIGINT), {c + 1}, round({var}, 6) FROM post"]
    return " UNION ALL ".join(parts)


def gauss_update(spark, sf, kind):
    spec = M.Spec([(f"continuous:{kind}", ["quantity", "discount"])], 2)
    df = sizes(spark, sf)
    pi, params = M.m_step(lpa_scored(spark, sf), spec, [GAUSS], M.marginals(df, spec))
    return params_frame(spark, spec, pi, params)


@query("mstep_gaussian", f"WITH {SQL_LPA} {share_sql(2)} UNION ALL {gauss_update_sql(False)}")
def mstep_gaussian(spark, sf):
    return gauss_update(spark, sf, "class")


@query("mstep_gaussian_equal", f"WITH {SQL_LPA} {share_sql(2)} UNION ALL {gauss_update_sql(True)}")
def mstep_gaussian_equal(spark, sf):
    return gauss_update(spark, sf, "equal")


def rate_sql(c, n, off: str = "0"):
    return f"(sum(p{c + 1} * {n}) + 0.5e0) / (sum(p{c + 1}) - {off} + 0.5e0 / avg({n}))"


def count_update(name, family, params, cell, extra):
    logs = [f"{log_pi(c, (0.5, 0.5))} + " + " + ".join(f"({cell(n, c, j)})" for j, n in enumerate(COUNTS)) for c in range(2)]
    spec = M.Spec([(family, COUNTS)], 2)

    @query(name, f"WITH {SQL_SIZES}, " + posterior_sql(logs, "sizes", "l_orderkey, lines, returns") + f" {share_sql(2)} UNION ALL " + " UNION ALL ".join(extra(c, j, n) for c in range(2) for j, n in enumerate(COUNTS)))
    def run(spark, sf):
        df = sizes(spark, sf)
        pi, new = M.m_step(M.with_parameters(spec, np.array([0.5, 0.5]), [params]).transform(df), spec, [params], M.marginals(df, spec))
        return params_frame(spark, spec, pi, new)


count_update("mstep_poisson", "count", RATE, lambda n, c, j: pois_cell(n, float(RATE["rate"][c, j])), lambda c, j, n: f"SELECT '{n}', 'rate', CAST(0 AS BIGINT), {c + 1}, round({rate_sql(c, n)}, 6) FROM post")


def zip_extra(c, j, n):
    z, r = float(ZERO["zero"][c, j]), float(RATE["rate"][c, j])
    off = f"(sum(CASE WHEN {n} = 0 THEN p{c + 1} ELSE 0 END) * {num(z / (z + (1 - z) * math.exp(-r)))})"
    return f"SELECT '{n}', 'rate', CAST(0 AS BIGINT), {c + 1}, round({rate_sql(c, n, off)}, 6) FROM post UNION ALL SELECT '{n}', 'zero', CAST(0 AS BIGINT), {c + 1}, round(({off} + 0.25e0) / (sum(p{c + 1}) + 0.5e0), 6) FROM post"


count_update("mstep_zip", "zip", ZERO, lambda n, c, j: zip_cell(n, float(RATE["rate"][c, j]), float(ZERO["zero"][c, j])), zip_extra)


# ---------------------------------------------------------------- a fixed number of iterations

ROUNDS = 3


def unrolled_sql() -> str:
    """ROUNDS iterations over the pattern table as chained CTEs: t0 holds the starts, ti the parameters after i."""
    cols = ["pi{c}"] + [f"{f}_{{c}}" for f in FLAGS]
    ctes = [SQL_FLAGS, "pat AS (SELECT " + ", ".join(FLAGS) + ", CAST(count(*) AS DOUBLE) AS w FROM flags GROUP BY ALL)", "marg AS (SELECT " + ", ".join(f"sum(w * {f}) / sum(w) AS m_{f}" for f in FLAGS) + " FROM pat)"]
    ctes.append("t0 AS (SELECT " + ", ".join(f"{num(PI[c])} AS pi{c}, " + ", ".join(f"{num(PROB[c][j])} AS {f}_{c}" for j, f in enumerate(FLAGS)) for c in range(3)) + ")")
    for i in range(ROUNDS):
        joint = [f"ln(pi{c} + 1e-15) + " + " + ".join(f"{f} * (ln({f}_{c}) - ln(1 - {f}_{c})) + ln(1 - {f}_{c})" for f in FLAGS) for c in range(3)]
        ctes.append(f"l{i} AS (SELECT {', '.join(FLAGS)}, w, " + ", ".join(f"{e} AS l{c}" for c, e in enumerate(joint)) + f" FROM pat, t{i})")
        ctes.append(f"s{i} AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2)) AS z FROM l{i})")
        ctes.append(f"r{i} AS (SELECT *, " + ", ".join(f"w * exp(l{c} - greatest(l0, l1, l2)) / z AS r{c}" for c in range(3)) + f" FROM s{i})")
        ctes.append(f"t{i + 1} AS (SELECT " + ", ".join(f"(sum(r{c}) + 1.0e0 / 3) / (sum(w) + 1) AS pi{c}, " + ", ".join(f"(sum(r{c} * {f}) + any_value(m_{f}) / 3) / (sum(r{c}) + 1.0e0 / 3) AS {f}_{c}" for f in FLAGS) for c in range(3)) + f" FROM r{i}, marg)")
    last = f"t{ROUNDS}"
    out = " UNION ALL ".join([f"SELECT 'class' AS item, 'share' AS parameter, CAST(0 AS BIGINT) AS category, {c + 1} AS class, round(pi{c}, 6) AS estimate FROM {last}" for c in range(3)] + [f"SELECT '{f}', 'p', CAST(0 AS BIGINT), {c + 1}, round({f}_{c}, 6) FROM {last}" for c in range(3) for f in FLAGS])
    return "WITH " + ", ".join(ctes) + " " + out


@query("em_lca_fixed_iters", unrolled_sql())
def em_lca_fixed_iters(spark, sf):
    fit = M.em_rounds(P.collapse(flags(spark, sf), FLAGS), LCA, np.array(PI), [{"p": np.array(PROB)}], ROUNDS)
    return params_frame(spark, LCA, fit.pi, fit.params)


def unrolled_lpa_sql() -> str:
    names = ("quantity", "discount")
    ctes = [SQL_SIZES, "marg AS (SELECT " + ", ".join(f"var_pop({n}) AS v_{n}" for n in names) + " FROM sizes)"]
    ctes.append("t0 AS (SELECT " + ", ".join(f"{num((0.55, 0.45)[c])} AS pi{c}, " + ", ".join(f"{num(GAUSS['mean'][c, j])} AS m_{n}_{c}, {num(GAUSS['var'][c, j])} AS s_{n}_{c}" for j, n in enumerate(names)) for c in range(2)) + ")")
    for i in range(2):
        joint = [f"ln(pi{c} + 1e-15) + " + " + ".join(f"(-0.5e0 * (({n} - m_{n}_{c}) * ({n} - m_{n}_{c}) / s_{n}_{c} + ln(2 * pi() * s_{n}_{c})))" for n in names) for c in range(2)]
        ctes.append(f"l{i} AS (SELECT quantity, discount, " + ", ".join(f"{e} AS l{c}" for c, e in enumerate(joint)) + f" FROM sizes, t{i})")
        ctes.append(f"r{i} AS (SELECT *, 1 / (1 + exp(l1 - l0)) AS r0, 1 / (1 + exp(l0 - l1)) AS r1 FROM l{i})")
        ctes.append(f"t{i + 1} AS (SELECT " + ", ".join(f"(sum(r{c}) + 0.5e0) / (count(*) + 1) AS pi{c}, " + ", ".join(f"sum(r{c} * {n}) / sum(r{c}) AS m_{n}_{c}, (sum(r{c} * {n} * {n}) - sum(r{c} * {n}) * (sum(r{c} * {n}) / sum(r{c})) + 0.5e0 * any_value(v_{n})) / (sum(r{c}) + 0.5e0) AS s_{n}_{c}" for n in names) for c in range(2)) + f" FROM r{i}, marg)")
    out = " UNION ALL ".join([f"SELECT 'class' AS item, 'share' AS parameter, CAST(0 AS BIGINT) AS category, {c + 1} AS class, round(pi{c}, 6) AS estimate FROM t2" for c in range(2)] + [f"SELECT '{n}', '{p}', CAST(0 AS BIGINT), {c + 1}, round({q}_{n}_{c}, 6) FROM t2" for c in range(2) for n in names for p, q in (("mean", "m"), ("var", "s"))])
    return "WITH " + ", ".join(ctes) + " " + out


@query("em_lpa_fixed_iters", unrolled_lpa_sql())
def em_lpa_fixed_iters(spark, sf):
    fit = M.em_rounds(sizes(spark, sf), LPA, np.array([0.55, 0.45]), [GAUSS], 2, None)
    return params_frame(spark, LPA, fit.pi, fit.params)


# ---------------------------------------------------------------- classification and fit


@query("class_sizes", f"WITH {SQL_LCA} " + " UNION ALL ".join(f"SELECT {c + 1} AS class, {num(PI[c])} AS proportion, round(sum(p{c + 1}), 6) AS n_expected, CAST(sum(CASE WHEN class = {c + 1} THEN 1 ELSE 0 END) AS DOUBLE) AS n_modal FROM post" for c in range(3)))
def class_sizes(spark, sf):
    return rounded(lca().class_sizes(gaps(flags(spark, sf))))


@query("classification_table", f"WITH {SQL_LCA} " + " UNION ALL ".join(f"SELECT {c + 1} AS class, " + ", ".join(f"round(sum(CASE WHEN class = {m + 1} THEN p{c + 1} ELSE 0 END), 6) AS modal_{m + 1}" for m in range(3)) + " FROM post" for c in range(3)))
def classification_table(spark, sf):
    return rounded(D.classification_table(lca_scored(spark, sf), 3))


@query("classification_error_rate", f"WITH {SQL_LCA} SELECT round(avg(1 - greatest(p1, p2, p3)), 6) AS error FROM post")
def classification_error_rate(spark, sf):
    return rounded(D.classification_error_rate(lca_scored(spark, sf)))


@query("classification_quality", f"WITH {SQL_LCA}, q AS (SELECT class, count(*) AS n, avg(greatest(p1, p2, p3)) AS avepp FROM post GROUP BY class), k AS (SELECT * FROM (VALUES " + ", ".join(f"({c + 1}, {num(PI[c])})" for c in range(3)) + ") AS v(class, proportion)) SELECT k.class, k.proportion, round(coalesce(n, 0) / (SELECT count(*) FROM post), 6) AS mcap, round(avepp, 6) AS avepp, round(avepp / (1 - avepp) / (k.proportion / (1 - k.proportion)), 6) AS occ FROM k LEFT JOIN q USING (class)")
def classification_quality(spark, sf):
    return rounded(D.classification_quality(lca_scored(spark, sf), PI))


@query("relative_entropy", f"WITH {SQL_LCA} SELECT round(-sum(" + " + ".join(f"p{c} * ln(p{c} + 1e-15)" for c in (1, 2, 3)) + "), 6) AS entropy, round(greatest(0, least(1, 1 + sum(" + " + ".join(f"p{c} * ln(p{c} + 1e-15)" for c in (1, 2, 3)) + ") / (count(*) * ln(3)))), 6) AS relative_entropy FROM post")
def relative_entropy(spark, sf):
    return rounded(D.entropy(lca_scored(spark, sf), 3))


@query("information_criteria", f"WITH {SQL_LCA}, s AS (SELECT sum(loglik) AS ll, count(*) AS n, -sum(" + " + ".join(f"p{c} * ln(p{c} + 1e-15)" for c in (1, 2, 3)) + ") AS e, 17 AS p FROM post) SELECT round(-2 * ll + 2 * p, 4) AS aic, round(-2 * ll + ln(n) * p, 4) AS bic, round(-2 * ll + (ln(n) + 1) * p, 4) AS caic, round(-2 * ll + 2 * p * (ln(n) + 1.5), 4) AS awe, round(-2 * ll + 3 * p, 4) AS aic3, round(-2 * ll + ln(n) * p + 2 * e, 4) AS icl, round(-2 * ll + p * ln((n + 2) / 24), 4) AS sabic FROM s")
def information_criteria(spark, sf):
    scored = lca_scored(spark, sf)
    s = scored.agg(F.sum("loglik").alias("ll"), F.count(F.lit(1)).alias("n")).crossJoin(D.entropy(scored, 3)).first()
    m = M.information_criteria(s.ll, 17, s.n, s.entropy, 3)
    return rounded(spark.createDataFrame([tuple(float(m[c]) for c in ("aic", "bic", "caic", "awe", "aic3", "icl", "sabic"))], "aic double, bic double, caic double, awe double, aic3 double, icl double, sabic double"), 4)


@query("bf_cmp", "WITH b(classes, bic) AS (VALUES (1, 10250.0e0), (2, 10190.0e0), (3, 10187.5e0), (4, 10201.0e0)) SELECT classes, round(exp(-bic / 2 - lead(-bic / 2) OVER (ORDER BY classes)), 6) AS bf, round(exp(-bic / 2 - (SELECT max(-bic / 2) FROM b)) / (SELECT sum(exp(-bic / 2 - (SELECT max(-bic / 2) FROM b))) FROM b), 6) AS cmp FROM b")
def bf_cmp(spark, sf):
    from pyspark.sql import Window

    b = spark.createDataFrame([(1, 10250.0), (2, 10190.0), (3, 10187.5), (4, 10201.0)], "classes int, bic double").withColumn("sic", -F.col("bic") / 2)
    every = Window.partitionBy(F.lit(1))
    e = F.exp(F.col("sic") - F.max("sic").over(every))
    return rounded(b.select("classes", F.exp(F.col("sic") - F.lead("sic").over(every.orderBy("classes"))).alias("bf"), e.alias("e")).withColumn("cmp", F.col("e") / F.sum("e").over(every)).drop("e"))


@query("profile_shift", f"WITH {SQL_LCA} " + " UNION ALL ".join(f"SELECT {c + 1} AS class, '{f}' AS item, round(sum(p{c + 1} * {f}) / sum(CASE WHEN {f} IS NOT NULL THEN p{c + 1} END), 6) AS soft, round(avg(CASE WHEN class = {c + 1} THEN {f} END), 6) AS hard FROM post" for c in range(3) for f in FLAGS))
def profile_shift(spark, sf):
    return rounded(D.profile_shift(lca_scored(spark, sf), FLAGS, 3))


def xlogx(e: str) -> str:
    return f"(CASE WHEN {e} > 0 THEN ({e}) * ln({e}) ELSE 0 END)"


@query("merge_path_gain", f"WITH {SQL_LCA} " + " UNION ALL ".join(f"SELECT {a} AS class_a, {b} AS class_b, round(sum({xlogx(f'(p{a} + p{b})')} - {xlogx(f'p{a}')} - {xlogx(f'p{b}')}), 6) AS entropy_drop FROM post" for a, b in itertools.combinations((1, 2, 3), 2)))
def merge_path_gain(spark, sf):
    return rounded(D.merge_gains(lca_scored(spark, sf), 3))


SQL_FULL = f"{SQL_FLAGS}, pat AS (SELECT {', '.join(FLAGS)}, CAST(count(*) AS DOUBLE) AS o FROM flags GROUP BY ALL), " + posterior_sql(LCA_LOGS, "pat", ", ".join(FLAGS) + ", o") + ", cells AS (SELECT o, exp(loglik) * (SELECT sum(o) FROM pat) AS e FROM post)"


@query("absolute_fit", f"WITH {SQL_FULL}, s AS (SELECT sum(o) AS n, sum(e) AS t, sum(2 * o * ln(o / e)) AS g2, sum((o - e) * (o - e) / e) AS x2, sum(o * (pow(o / e, 2.0e0 / 3) - 1)) AS cr, sum(abs(o - e)) AS d, count(*) AS n_patterns FROM cells) SELECT round(g2, 4) AS g2, round(x2 + greatest(n - t, 0), 4) AS x2, round(cr * 9 / 5, 4) AS cressie_read, round((d + greatest(n - t, 0)) / (2 * n), 6) AS dissimilarity, 14 AS df, 32 AS n_cells, n_patterns FROM s")
def absolute_fit(spark, sf):
    r = D.absolute_fit(D.expected_patterns(lca(), flags(spark, sf)), 32, 17)
    return r.select(F.round("g2", 4).alias("g2"), F.round("x2", 4).alias("x2"), F.round("cressie_read", 4).alias("cressie_read"), F.round("dissimilarity", 6).alias("dissimilarity"), "df", "n_cells", "n_patterns")


def bvr_sql() -> str:
    parts = []
    for a, b in itertools.combinations(range(5), 2):
        fa, fb = FLAGS[a], FLAGS[b]
        terms = []
        for u, v in itertools.product((0, 1), repeat=2):
            e = " + ".join(f"sum(p{c + 1}) * {num((PROB[c][a] if u else 1 - PROB[c][a]) * (PROB[c][b] if v else 1 - PROB[c][b]))}" for c in range(3))
            o = f"sum(CASE WHEN {fa} = {u} AND {fb} = {v} THEN 1 ELSE 0 END)"
            terms.append(f"({o} - ({e})) * ({o} - ({e})) / ({e})")
        parts.append(f"SELECT '{fa}' AS item_a, '{fb}' AS item_b, round({' + '.join(terms)}, 4) AS bvr FROM post WHERE {fa} IS NOT NULL AND {fb} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("bivariate_residuals", f"WITH {SQL_LCA} {bvr_sql()}")
def bivariate_residuals(spark, sf):
    return rounded(D.bivariate_residuals(lca_scored(spark, sf), FLAGS, np.array(PROB)), 4)


@query("k_deleted_ll", f"WITH {SQL_LPA}, t AS (SELECT loglik, row_number() OVER (ORDER BY loglik DESC) AS i FROM post) SELECT k AS removed, round((SELECT sum(loglik) FROM t) - coalesce((SELECT sum(loglik) FROM t WHERE i <= k), 0), 4) AS loglik FROM range(6) AS r(k)")
def k_deleted_ll(spark, sf):
    return rounded(D.k_deleted_loglik(lpa_scored(spark, sf), 5), 4)


@query("log_prior", f"WITH {SQL_FLAGS} SELECT round(" + " + ".join(f"{num(1 / 3)} * (avg({f}) * {num(math.log(PROB[c][j]))} + (1 - avg({f})) * {num(math.log1p(-PROB[c][j]))})" for c in range(3) for j, f in enumerate(FLAGS)) + f" + {num(sum(math.log(p + 1e-15) for p in PI) / 3)}, 6) AS log_prior FROM flags")
def log_prior(spark, sf):
    m = M.marginals(flags(spark, sf), LCA)
    return rounded(spark.createDataFrame([(M._log_prior(LCA, np.array(PI), lca().params, m),)], "log_prior double"))


SQL_MOMENTS = "moments AS (SELECT CASE WHEN returns > 0 THEN 1 ELSE 0 END AS g, avg(quantity) AS quantity_m, var_pop(quantity) AS quantity_v, avg(discount) AS discount_m, var_pop(discount) AS discount_v FROM sizes GROUP BY 1)"
SEPARATION_SQL = " UNION ALL ".join(f"SELECT 1 AS class_a, 2 AS class_b, '{n}' AS item, round(a.{n}_m - b.{n}_m, 6) AS difference, round((a.{n}_m - b.{n}_m) / sqrt((a.{n}_v + b.{n}_v) / 2), 6) AS d FROM moments a, moments b WHERE a.g = 0 AND b.g = 1" for n in ("quantity", "discount"))


def returns_fit(spark, sf):
    """Orders without and with returns as two classes, by their moments."""
    names = ("quantity", "discount")
    g = sizes(spark, sf).groupBy((F.col("returns") > 0).cast("int").alias("g")).agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("v", F.var_pop)))).orderBy("g").collect()
    moments = {what: np.array([[float(r[f"{n}_{k}"]) for n in names] for r in g]) for what, k in (("mean", "m"), ("var", "v"))}
    return M.with_parameters(LPA, np.array([0.55, 0.45]), [moments])


@query("class_separation", f"WITH {SQL_SIZES}, {SQL_MOMENTS} {SEPARATION_SQL}")
def class_separation(spark, sf):
    return rounded(D.class_separation(returns_fit(spark, sf), spark))


@query("skew_kurtosis", "WITH m AS (SELECT avg(quantity) AS a, avg(discount) AS b FROM sizes), " .replace("WITH m", f"WITH {SQL_SIZES}, m") + "d AS (SELECT quantity - a AS q, discount - b AS d FROM sizes, m) SELECT 'quantity' AS item, round(avg(q * q * q) / pow(avg(q * q), 1.5), 6) AS skewness, round(avg(q * q * q * q) / pow(avg(q * q), 2), 6) AS kurtosis FROM d UNION ALL SELECT 'discount', round(avg(d * d * d) / pow(avg(d * d), 1.5), 6), round(avg(d * d * d * d) / pow(avg(d * d), 2), 6) FROM d")
def skew_kurtosis(spark, sf):
    return rounded(D.skew_kurtosis(sizes(spark, sf), ["quantity", "discount"]))


@query("weighted_crosstab", f"WITH {SQL_LCA} SELECT class, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, round(sum(o_totalprice), 2) AS w FROM post JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def weighted_crosstab(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_totalprice")
    return rounded(lca_scored(spark, sf).join(o, "l_orderkey").groupBy("class", "priority").agg(F.sum("o_totalprice").alias("w")), 2)
