"""Registered fits that pass over partitions: finishes of chains, models with direct effects and equalities, binary codings other than 0 and 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latticore.operators import direct as D
from latticore.operators import extended as X
from latticore.operators import finish as FN
from latticore.operators import inference as I
from latticore.operators import jointly as J
from latticore.operators import mixture as M
from latticore.operators import transition as T
from latticore.plans import patterns as P
from latticore.plans import queries_data as Q
from latticore.plans import queries_fixed as QF
from latticore.plans import queries_model as QM
from latticore.plans.queries_data import num, rounded, table
from latticore.registry import query

CHAIN_START = [(QM.START, QM.MOVES, [{"p": np.array(QM.RHO)}])]


def coarser(sql: str, digits: int) -> str:
    """The SQL of a fit with estimates rounded to fewer digits."""
    return sql.replace(", 5) AS estimate", f", {digits}) AS estimate").replace(", 5) FROM", f", {digits}) FROM")


# ---------------------------------------------------------------- finish of a chain


@query("lta_newton_finish", coarser(QF.chain_rounds(1500), 4))
def lta_newton_finish(spark, sf):
    """Sixty rounds of Baum-Welch, then BHHH and Newton steps over partitions, against fifteen hundred rounds."""
    df = QM.states(spark, sf)
    short = T.fit_lta(df, QM.LTA_ITEMS, QM.TIMES, 2, starts=CHAIN_START, max_iter=60, tol=-1)
    done, _ = FN.finish_chain(short, df)
    return rounded(spark.createDataFrame(QF.chain_parameters(done), QF.PARAMS), 4)


# ---------------------------------------------------------------- binary codings


def twos(df, items):
    """Binary items coded 1 and 2."""
    return df.withColumns({f: F.col(f"`{f}`") + 1 for f in items})


@query("polish_recoded", coarser(QF.binary_rounds(Q.SQL_FLAGS, "flags", Q.FLAGS, QF.FINISH[0].tolist(), QF.FINISH[1][0]["p"].tolist(), 6000), 3))
def polish_recoded(spark, sf):
    """Items coded 1 and 2, polished; the class shares come from scores of the same codes."""
    raw = twos(Q.flags(spark, sf), Q.FLAGS)
    fit = M.fit_mixture(raw, Q.FLAGS, 2, "binary", starts=[QF.FINISH], max_iter=300, tol=-1)
    x, w = M.pattern_arrays(P.collapse(fit.coded(raw), Q.FLAGS, names=("_weight", "_rows")).toPandas(), Q.FLAGS)  # at most 2^5 patterns
    done = I.polish(fit, x, w)
    shares = done.transform(raw).agg(*(((F.sum(F.col("posterior")[k]) + 0.5) / (F.count(F.lit(1)) + 1)).alias(f"s{k}") for k in range(2))).first()
    rows = [("class", k + 1, float(shares[f"s{k}"])) for k in range(2)]
    rows += [(f, k + 1, float(done.params[0]["p"][k, j])) for k in range(2) for j, f in enumerate(Q.FLAGS)]
    return rounded(spark.createDataFrame(rows, QF.PARAMS), 3)


GROUP_PI, GROUP_PROB = [0.6, 0.4], [Q.PROB[0], Q.PROB[1]]


def group_rounds(rounds: int) -> str:
    """EM of two groups with the same measurement and their own class shares, as a recursion whose only row holds the parameters."""
    both, items = (0, 1), Q.FLAGS
    start = ", ".join([f"{num(GROUP_PI[c])} AS pi{g}_{c}" for g in both for c in both] + [f"{num(GROUP_PROB[c][j])} AS {f}_{c}" for c in both for j, f in enumerate(items)])
    log = lambda f, c: f"CASE WHEN {f} = 1 THEN ln({f}_{c}) ELSE ln(1 - {f}_{c}) END"
    logs = ", ".join(f"ln(CASE WHEN g = 0 THEN pi0_{c} ELSE pi1_{c} END + 1e-15) + " + " + ".join(log(f, c) for f in items) + f" AS l{c}" for c in both)
    post = "w / (1 + exp(l1 - l0)) AS r0, w / (1 + exp(l0 - l1)) AS r1"
    shares = [f"(sum(CASE WHEN g = {g} THEN r{c} ELSE 0 END) + 0.5e0) / (sum(CASE WHEN g = {g} THEN w ELSE 0 END) + 1)" for g in both for c in both]
    probs = [f"(sum(r{c} * {f}) + any_value(m_{f}) / 2) / (sum(r{c}) + 0.5e0)" for c in both for f in items]
    out = [f"SELECT {g} AS dear, 'class' AS item, {c + 1} AS class, round(pi{g}_{c}, 5) AS estimate FROM last" for g in both for c in both]
    out += [f"SELECT {g}, '{f}', {c + 1}, round({f}_{c}, 5) FROM last" for g in both for c in both for f in items]
    return f"""WITH RECURSIVE {Q.SQL_FLAGS},
pat AS (SELECT CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS g, {', '.join(items)}, CAST(count(*) AS DOUBLE) AS w FROM flags JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
marg AS (SELECT {', '.join(f'sum(w * {f}) / sum(w) AS m_{f}' for f in items)} FROM pat),
t AS (SELECT 0 AS it, {start} UNION ALL
SELECT it + 1, {', '.join(shares + probs)} FROM (SELECT *, {post} FROM (SELECT it, g, {', '.join(items)}, w, {logs} FROM pat, t WHERE it < {rounds})), marg GROUP BY it),
last AS (SELECT * FROM t WHERE it = {rounds})
{' UNION ALL '.join(out)}"""


def dear_flags(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("dear"))
    return Q.flags(spark, sf).join(o, "l_orderkey")


@query("groups_recoded", group_rounds(50))
def groups_recoded(spark, sf):
    """Items coded 1 and 2 in two groups with the same measurement, from a given start."""
    start = [(np.tile(GROUP_PI, (2, 1)), [{"p": np.array(GROUP_PROB)}])]
    fit = X.fit_groups(twos(dear_flags(spark, sf), Q.FLAGS), Q.FLAGS, "dear", 2, measurement_equal=True, starts=start, max_iter=50, tol=-1)
    rows = [(int(g), "class", c + 1, float(f.pi[c])) for g, f in fit["groups"].items() for c in range(2)]
    rows += [(int(g), item, c + 1, float(f.params[0]["p"][c, j])) for g, f in fit["groups"].items() for c in range(2) for j, item in enumerate(Q.FLAGS)]
    return rounded(spark.createDataFrame(rows, f"dear int, {QF.PARAMS.replace('bigint', 'int')}"), 5)


# ---------------------------------------------------------------- direct effects


def direct_sql() -> str:
    """One class and a covariate of two values: each half has its own share, so logits, their difference and its error have closed forms."""
    half = lambda f, g: f"avg(CASE WHEN g = {g} THEN {f} END)"
    cells = ", ".join(f"{half(f, g)} AS p{g}_{f}" for f in Q.FLAGS for g in (0, 1))
    logit = lambda p: f"ln({p} / (1 - {p}))"
    out = []
    for f in Q.FLAGS:
        v = [f"1 / (n{g} * p{g}_{f} * (1 - p{g}_{f}))" for g in (0, 1)]
        se = [f"round(sqrt({v[0]}), 5)", f"round(sqrt({v[0]} + {v[1]}), 5)"] if f == "bulk" else ["NULL", "NULL"]
        out.append(f"SELECT 'threshold' AS part, '{f}' AS item, round({logit(f'p0_{f}')}, 5) AS estimate, CAST({se[0]} AS DOUBLE) AS se FROM m")
        out.append(f"SELECT 'effect', '{f}', round({logit(f'p1_{f}')} - {logit(f'p0_{f}')}, 5), {se[1]} FROM m")
    return f"""WITH {Q.SQL_FLAGS}, x AS (SELECT flags.*, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS g FROM flags JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT {cells}, count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1 FROM x)
{' UNION ALL '.join(out)}"""


@query("direct_effects_saturated", direct_sql())
def direct_effects_saturated(spark, sf):
    """Effects of a yes-or-no covariate on every binary item of one class, and the standard errors where one item is fitted alone."""
    df, how = P.collapse(dear_flags(spark, sf), [*Q.FLAGS, "dear"], names=("_weight", "_rows")).persist(), {"measurement": "binary", "tol": 1e-13, "weight": "_weight"}  # at most 2^6 patterns
    fit = D.fit_direct_effects(df, Q.FLAGS, ["dear"], 1, effects={f: ["dear"] for f in Q.FLAGS}, **how)
    alone = D.fit_direct_effects(df, ["bulk"], ["dear"], 1, effects={"bulk": ["dear"]}, **how).estimates.set_index("part")["se"]
    df.unpersist()
    rows = [(r.part, r.item, float(r.estimate), float(alone[r.part]) if r.item == "bulk" else None) for r in fit.estimates.itertuples()]
    return rounded(spark.createDataFrame(rows, "part string, item string, estimate double, se double"), 5)


@query("direct_effects_ordinal")
def direct_effects_ordinal(spark, sf):
    """Two classes of ordinal order features of which priority depends on the customer's balance within classes."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 10000).alias("balance")), "o_custkey")
    level = lambda c, *cuts: sum(((F.col(c) > v).cast("int") for v in cuts), F.lit(1))
    rows = o.select("balance", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), level("o_totalprice", 80000, 160000).alias("price"), F.quarter("o_orderdate").alias("quarter"))
    rows = rows.withColumn("balance", F.round("balance", 1))
    fit = D.fit_direct_effects(rows, ["priority", "price", "quarter"], ["balance"], 2, effects={"priority": ["balance"]}, n_init=3, max_iter=100, tol=1e-7)
    return spark.createDataFrame(fit.estimates[["part", "item", "class", "term", "estimate", "se"]].fillna({"item": ""}))


# ---------------------------------------------------------------- equal means, own variances


def tied_rounds(rounds: int) -> str:
    """EM of a profile model in two groups: means are equal over them, weighed by the variances of the round before; shares and variances are each group's own."""
    names, both = ("quantity", "discount"), (0, 1)
    cells = [(g, c, n, j) for g in both for c in both for j, n in enumerate(names)]
    start = ", ".join([f"{num((0.55, 0.45)[c])} AS pi{g}_{c}" for g in both for c in both] + [f"{num(Q.GAUSS['mean'][c, j])} AS m_{n}_{c}" for c in both for j, n in enumerate(names)] + [f"{num(Q.GAUSS['var'][c, j])} AS s{g}_{n}_{c}" for g, c, n, j in cells])
    own = lambda v: f"CASE WHEN g = 0 THEN {v.format(0)} ELSE {v.format(1)} END"
    log = lambda n, c: f"(-0.5e0 * (({n} - m_{n}_{c}) * ({n} - m_{n}_{c}) / ({own(f's{{0}}_{n}_{c}')}) + ln(2 * pi() * ({own(f's{{0}}_{n}_{c}')}))))"
    logs = ", ".join(f"ln({own(f'pi{{0}}_{c}')} + 1e-15) + " + " + ".join(log(n, c) for n in names) + f" AS l{c}" for c in both)
    mass = [f"sum(CASE WHEN g = {g} THEN r{c} ELSE 0 END) AS n{g}_{c}" for g in both for c in both]
    mass += [f"sum(CASE WHEN g = {g} THEN r{c} * {n} ELSE 0 END) AS x{g}_{n}_{c}, sum(CASE WHEN g = {g} THEN r{c} * {n} * {n} ELSE 0 END) AS q{g}_{n}_{c}, any_value(s{g}_{n}_{c}) AS s{g}_{n}_{c}" for g, c, n, _ in cells]
    means = [f"(x0_{n}_{c} / s0_{n}_{c} + x1_{n}_{c} / s1_{n}_{c}) / (n0_{c} / s0_{n}_{c} + n1_{c} / s1_{n}_{c}) AS m_{n}_{c}" for c in both for n in names]
    new = [f"(n{g}_{c} + 0.5e0) / (n{g}_0 + n{g}_1 + 1)" for g in both for c in both] + [f"m_{n}_{c}" for c in both for n in names]
    new += [f"(q{g}_{n}_{c} - 2 * m_{n}_{c} * x{g}_{n}_{c} + n{g}_{c} * m_{n}_{c} * m_{n}_{c} + 0.5e0 * v{g}_{n}) / (n{g}_{c} + 0.5e0)" for g, c, n, _ in cells]
    at = lambda c: f"CAST(CASE WHEN k0 * pi0_1 + k1 * pi1_1 > k0 * pi0_0 + k1 * pi1_0 THEN {2 - c} ELSE {1 + c} END AS BIGINT)"
    out = [f"SELECT CAST({g} AS BIGINT) AS odd, 'class' AS item, {at(c)} AS class, round(pi{g}_{c}, 5) AS estimate FROM last, marg" for g in both for c in both]
    for g, c, n, j in cells:
        scale = (1, 100)[j]
        out += [f"SELECT {g}, '{n} mean', {at(c)}, round(m_{n}_{c} * {scale}, 4) FROM last, marg", f"SELECT {g}, '{n} var', {at(c)}, round(s{g}_{n}_{c} * {scale}, 4) FROM last, marg"]
    return f"""WITH RECURSIVE {Q.SQL_SIZES}, x AS (SELECT l_orderkey % 2 AS g, quantity, discount FROM sizes),
marg AS (SELECT {', '.join(f'var_pop(CASE WHEN g = {g} THEN {n} END) AS v{g}_{n}' for g in both for n in names)}, count(*) FILTER (WHERE g = 0) AS k0, count(*) FILTER (WHERE g = 1) AS k1 FROM x),
t AS (SELECT 0 AS it, {start} UNION ALL
SELECT it + 1, {', '.join(new)} FROM (SELECT *, {', '.join(means)} FROM (SELECT it, {', '.join(mass)} FROM
  (SELECT *, 1 / (1 + exp(l1 - l0)) AS r0, 1 / (1 + exp(l0 - l1)) AS r1 FROM (SELECT t.*, g, quantity, discount, {logs} FROM x, t WHERE it < {rounds})) GROUP BY it)), marg),
last AS (SELECT * FROM t WHERE it = {rounds})
{' UNION ALL '.join(out)}"""


@query("groups_equal_means", tied_rounds(12))
def groups_equal_means(spark, sf):
    """Profiles of odd and even orders whose means are equal and whose variances and shares are not, from a given start."""
    names = ["quantity", "discount"]
    rows = Q.sizes(spark, sf).select(*(F.col(n).alias(f"{n}@0") for n in names), (F.col("l_orderkey") % 2).alias("odd"))
    start = [(np.array([0.55, 0.45]), np.zeros((0, 2, 2)), [{k: v.copy() for k, v in Q.GAUSS.items()}])]
    fit = J.fit_lta_groups(rows, names, [0], "odd", 2, measurement="continuous", measurement_equal=False, equal="means", starts=start, max_iter=12, tol=-1)
    out = []
    for g, c in fit["groups"].items():
        p = c.params[0][0]
        for k in range(2):
            out.append((int(g), "class", k + 1, round(float(c.start[k]), 5)))
            out += [(int(g), f"{n} {what}", k + 1, round(float(p[what][k, j]) * (1, 100)[j], 4)) for j, n in enumerate(names) for what in ("mean", "var")]
    return spark.createDataFrame(out, f"odd bigint, {QF.PARAMS}")


# ---------------------------------------------------------------- chains with a covariate


def covariate_rounds(rounds: int) -> str:
    """A chain whose start and moves depend on a yes-or-no covariate: logits in either half go by Newton steps, the measurement by EM, over all paths of states."""
    items, times, both = QM.LTA_ITEMS, QM.TIMES, (0, 1)
    logit = lambda p: num(float(np.log(p[0] / p[1])))
    start = [f"{logit(QM.START)} AS g{h}" for h in both] + [f"{logit(QM.MOVES[t][a - 1])} AS u{h}_{t}_{a}" for h in both for t in times[:-1] for a in (1, 2)]
    start += [f"{num(QM.RHO[a - 1][j])} AS r_{n}_{a}" for a in (1, 2) for j, n in enumerate(items)]
    own = lambda v: f"CASE WHEN h = 0 THEN {v.format(0)} ELSE {v.format(1)} END"
    log = lambda state, v: f"-ln(1 + exp(CASE WHEN {state} = 1 THEN -1 ELSE 1 END * ({v})))"
    lp = [log("s0", own("g{0}"))]
    lp += [log(f"s{t + 1}", f"CASE WHEN s{t} = 1 THEN {own(f'u{{0}}_{t}_1')} ELSE {own(f'u{{0}}_{t}_2')} END") for t in times[:-1]]
    lp += [f"coalesce(CASE WHEN s{t} = 1 THEN {n}{t} * ln(r_{n}_1) + (1 - {n}{t}) * ln(1 - r_{n}_1) ELSE {n}{t} * ln(r_{n}_2) + (1 - {n}{t}) * ln(1 - r_{n}_2) END, 0)" for t in times for n in items]
    mass = lambda where: f"sum(CASE WHEN {where} THEN p ELSE 0 END)"
    newton = lambda v, hit, of: f"any_value({v}) + ({hit} - {of} / (1 + exp(-any_value({v})))) / ({of} / (1 + exp(-any_value({v}))) / (1 + exp(any_value({v}))))"
    new = [newton(f"g{h}", mass(f"h = {h} AND s0 = 1"), mass(f"h = {h}")) for h in both]
    new += [newton(f"u{h}_{t}_{a}", mass(f"h = {h} AND s{t} = {a} AND s{t + 1} = 1"), mass(f"h = {h} AND s{t} = {a}")) for h in both for t in times[:-1] for a in (1, 2)]
    new += [f"({' + '.join(mass(f's{t} = {a} AND {n}{t} = 1') for t in times)} + any_value(m_{n}) / 2) / ({' + '.join(mass(f's{t} = {a} AND {n}{t} IS NOT NULL') for t in times)} + 0.5e0)" for a in (1, 2) for n in items]
    names = [x.split(" AS ")[1] for x in start]
    wide = ", ".join(QF.WAVES)
    marg = ", ".join("(" + " + ".join(f"sum(coalesce({n}{t}, 0))" for t in times) + ") * 1.0e0 / (" + " + ".join(f"count({n}{t})" for t in times) + f") AS m_{n}" for n in items)
    rows = [("initial", 0, 0, "g{0}")] + [("transition", t + 1, a, f"u{{0}}_{t}_{a}") for t in times[:-1] for a in (1, 2)]
    out = []
    for part, t, a, v in rows:
        out.append(f"SELECT '{part}' AS part, {t} AS occasion, {a} AS from_status, '(intercept)' AS term, round({v.format(0)}, 4) AS estimate FROM last")
        out.append(f"SELECT '{part}', {t}, {a}, 'z', round({v.format(1)} - {v.format(0)}, 4) FROM last")
    return f"""WITH RECURSIVE {QM.SQL_STATES}, seen AS (SELECT user_id, user_id % 2 AS h, {wide} FROM states WHERE coalesce({wide}) IS NOT NULL), marg AS (SELECT {marg} FROM seen),
q AS (SELECT * FROM (VALUES (1), (2)) a(s0), (VALUES (1), (2)) b(s1), (VALUES (1), (2)) c(s2), (VALUES (1), (2)) d(s3)),
t AS (SELECT 0 AS it, {', '.join(start)} UNION ALL
SELECT it + 1, {', '.join(f'{e} AS {n}' for e, n in zip(new, names))} FROM (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY user_id) AS p
  FROM (SELECT t.*, seen.*, s0, s1, s2, s3, {' + '.join(lp)} AS lp FROM seen, q, t WHERE it < {rounds})), marg GROUP BY it),
last AS (SELECT * FROM t WHERE it = {rounds})
{' UNION ALL '.join(out)}"""


@query("lta_covariates_from_start", covariate_rounds(2))
def lta_covariates_from_start(spark, sf):
    """Start and moves that depend on a yes-or-no covariate, from a given start, round by round."""
    df = QM.states(spark, sf).withColumn("z", (F.col("user_id") % 2).cast("double"))
    fit = X.fit_lta_covariates(df, QM.LTA_ITEMS, QM.TIMES, 2, initial=["z"], transition=["z"], starts=CHAIN_START, max_iter=2, tol=-1)
    c = fit["coefficients"].fillna({"occasion": 0, "from_status": 0})
    rows = [(r.part, int(r.occasion), int(r.from_status), r.term, round(float(r.estimate), 4)) for r in c.itertuples()]
    return spark.createDataFrame(rows, "part string, occasion int, from_status int, term string, estimate double")
