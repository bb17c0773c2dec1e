"""Registered fits from given starts: a given number of rounds, or estimates with a closed form, so that SQL can follow them to the end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latticore.operators import jointly as J
from latticore.operators import mixture as M
from latticore.operators import structural as S
from latticore.operators import transition as T
from latticore.plans import queries_data as Q
from latticore.plans import queries_model as QM
from latticore.plans.queries_data import num, rounded, table
from latticore.registry import query

PARAMS = "item string, class bigint, estimate double"


def binary_rounds(ctes: str, rows: str, items: list[str], pi: list[float], prob: list[list[float]], rounds: int) -> str:
    """EM of binary items with missing cells as a recursion whose only row holds the parameters; classes then by size."""
    k = len(pi)
    classes = range(k)
    cells = [f"{f}_{c}" for c in classes for f in items]
    start = ", ".join([*(f"{num(pi[c])} AS pi{c}" for c in classes), *(f"{num(prob[c][j])} AS {f}_{c}" for c in classes for j, f in enumerate(items))])
    logs = ", ".join(f"ln(pi{c} + 1e-15) + " + " + ".join(f"coalesce(CASE WHEN {f} = 1 THEN ln(greatest({f}_{c}, 1e-15)) WHEN {f} = 0 THEN ln(greatest(1 - {f}_{c}, 1e-15)) END, 0)" for f in items) + f" AS l{c}" for c in classes)
    top = f"greatest({', '.join(f'l{c}' for c in classes)})"
    post = ", ".join(f"w * exp(l{c} - {top}) / ({' + '.join(f'exp(l{d} - {top})' for d in classes)}) AS r{c}" for c in classes)
    new = [f"(sum(r{c}) + 1.0e0 / {k}) / (sum(w) + 1)" for c in classes] + [f"(coalesce(sum(r{c} * {f}), 0) + any_value(m_{f}) / {k}) / (coalesce(sum(CASE WHEN {f} IS NOT NULL THEN r{c} END), 0) + 1.0e0 / {k})" for c in classes for f in items]
    last = f"(SELECT * FROM t WHERE it = {rounds})"
    size = lambda c: "1 + " + " + ".join(f"CASE WHEN pi{d} > pi{c} THEN 1 ELSE 0 END" for d in classes)
    out = [f"SELECT 'class' AS item, CAST({size(c)} AS BIGINT) AS class, round(pi{c}, 5) AS estimate FROM {last}" for c in classes]
    out += [f"SELECT '{f}', CAST({size(c)} AS BIGINT), round({f}_{c}, 5) FROM {last}" for c in classes for f in items]
    return f"""WITH RECURSIVE {ctes}, pat AS (SELECT {', '.join(items)}, CAST(count(*) AS DOUBLE) AS w FROM {rows} WHERE coalesce({', '.join(items)}) IS NOT NULL GROUP BY ALL),
marg AS (SELECT {', '.join(f'sum(w * {f}) / sum(CASE WHEN {f} IS NOT NULL THEN w END) AS m_{f}' for f in items)} FROM pat),
t AS (SELECT 0 AS it, {start} UNION ALL
SELECT it + 1, {', '.join(new)} FROM (SELECT *, {post} FROM (SELECT it, {', '.join(items)}, w, {logs} FROM pat, t WHERE it < {rounds})), marg GROUP BY it)
{' UNION ALL '.join(out)}"""


def class_parameters(spark, fit: M.Fit, items: list[str]):
    rows = [("class", c + 1, float(fit.pi[c])) for c in range(fit.spec.k)]
    rows += [(f, c + 1, float(fit.params[0]["p"][c, j])) for c in range(fit.spec.k) for j, f in enumerate(items)]
    return rounded(spark.createDataFrame(rows, PARAMS), 5)


START = [(np.array(Q.PI), [{"p": np.array(Q.PROB)}])]


@query("fit_lca_from_start", binary_rounds(f"{Q.SQL_FLAGS}, {Q.SQL_GAPS}", "gaps", Q.FLAGS, Q.PI, Q.PROB, 60))
def fit_lca_from_start(spark, sf):
    return class_parameters(spark, M.fit_mixture(Q.gaps(Q.flags(spark, sf)), Q.FLAGS, 3, "binary", starts=START, max_iter=60, tol=-1), Q.FLAGS)


WAVES = [f"{n}{t}" for t in QM.TIMES for n in QM.LTA_ITEMS]
RMLCA = [[0.3, 0.25] * 4, [0.7, 0.8] * 4]


@query("fit_rmlca_from_start", binary_rounds(QM.SQL_STATES, "states", WAVES, [0.6, 0.4], RMLCA, 40))
def fit_rmlca_from_start(spark, sf):
    start = [(np.array([0.6, 0.4]), [{"p": np.array(RMLCA)}])]
    return class_parameters(spark, T.fit_rmlca(QM.states(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, starts=start, max_iter=40, tol=-1), WAVES)


@query("recode_then_score", f"WITH {Q.SQL_LCA} SELECT l_orderkey, round(loglik, 6) AS loglik, class FROM post")
def recode_then_score(spark, sf):
    """Items coded 1 and 2, a fit, and scores of the same codes."""
    raw = Q.gaps(Q.flags(spark, sf)).withColumns({f: F.col(f) + 1 for f in Q.FLAGS})
    fit = M.fit_mixture(raw, Q.FLAGS, 3, "binary", starts=START, max_iter=0, tol=-1)
    scored = fit.transform(raw.where(F.coalesce(*Q.FLAGS).isNotNull()))
    return rounded(scored.select("l_orderkey", "loglik", "class"))


SQL_GAMMA = ", ".join(f"round(sum(CASE WHEN s{t} = 1 THEN p ELSE 0 END), 6) AS g{t}" for t in QM.TIMES)


@query("lta_recoded", f"WITH {QM.SQL_PATHS} SELECT user_id, round(any_value(ll), 6) AS loglik, {SQL_GAMMA} FROM pp GROUP BY user_id")
def lta_recoded(spark, sf):
    """Items coded 5 and 9 at all occasions, a chain, and its posteriors for the same codes."""
    raw = QM.states(spark, sf).withColumns({f"{n}@{t}": 5 + 4 * F.col(f"`{n}@{t}`") for n in QM.LTA_ITEMS for t in QM.TIMES})
    start = [(QM.START, QM.MOVES, [{"p": np.array(QM.RHO)}])]
    scored = T.fit_lta(raw, QM.LTA_ITEMS, QM.TIMES, 2, starts=start, max_iter=0, tol=-1).transform(raw)
    return rounded(scored.select("user_id", "loglik", *(F.col("posteriors")[t][0].alias(f"g{t}") for t in QM.TIMES)))


def chain_rounds(rounds: int, where: str = "TRUE", ordered: bool = True) -> str:
    """Baum-Welch of a chain with the same measurement at all occasions, over all paths of states; statuses then by starting share, or as they are."""
    items, times, both = QM.LTA_ITEMS, QM.TIMES, (1, 2)
    start = [*(f"{num(QM.START[a - 1])} AS s_{a}" for a in both), *(f"{num(QM.MOVES[t][a - 1][b - 1])} AS m_{t}_{a}{b}" for t in times[:-1] for a in both for b in both), *(f"{num(QM.RHO[a - 1][j])} AS r_{n}_{a}" for a in both for j, n in enumerate(items))]
    pick = lambda values, of: "CASE " + " ".join(f"WHEN {w} THEN ln({v} + 1e-300)" for v, w in zip(values, of)) + " END"
    lp = [pick([f"s_{a}" for a in both], [f"s0 = {a}" for a in both])]
    lp += [pick([f"m_{t}_{a}{b}" for a in both for b in both], [f"s{t} = {a} AND s{t + 1} = {b}" for a in both for b in both]) for t in times[:-1]]
    lp += [f"coalesce(CASE WHEN s{t} = 1 THEN {n}{t} * ln(r_{n}_1) + (1 - {n}{t}) * ln(1 - r_{n}_1) ELSE {n}{t} * ln(r_{n}_2) + (1 - {n}{t}) * ln(1 - r_{n}_2) END, 0)" for t in times for n in items]
    mass = lambda where: f"sum(CASE WHEN {where} THEN p ELSE 0 END)"
    cell = lambda t, a, b: f"({mass(f's{t} = {a} AND s{t + 1} = {b}')} + 0.25e0)"
    new = [f"({mass(f's0 = {a}')} + 0.5e0) / (sum(p) + 1)" for a in both]
    new += [f"{cell(t, a, b)} / ({cell(t, a, 1)} + {cell(t, a, 2)})" for t in times[:-1] for a in both for b in both]
    new += [f"({' + '.join(f'sum(CASE WHEN s{t} = {a} AND {n}{t} = 1 THEN p ELSE 0 END)' for t in times)} + any_value(m_{n}) / 2) / ({' + '.join(mass(f's{t} = {a} AND {n}{t} IS NOT NULL') for t in times)} + 0.5e0)" for a in both for n in items]
    names = [x.split(" AS ")[1] for x in start]
    wide = ", ".join(WAVES)
    marg = ", ".join("(" + " + ".join(f"sum(coalesce({n}{t}, 0))" for t in times) + ") * 1.0e0 / (" + " + ".join(f"count({n}{t})" for t in times) + f") AS m_{n}" for n in items)
    last = f"(SELECT * FROM t WHERE it = {rounds})"
    test = "s_1 >= s_2" if ordered else "TRUE"
    first, other = f"CASE WHEN {test} THEN {{0}} ELSE {{1}} END", f"CASE WHEN {test} THEN {{1}} ELSE {{0}} END"
    out = []
    for a, form in ((1, first), (2, other)):
        out.append(f"SELECT 'start' AS item, {a} AS class, round({form.format('s_1', 's_2')}, 5) AS estimate FROM {last}")
        out += [f"SELECT '{n}', {a}, round({form.format(f'r_{n}_1', f'r_{n}_2')}, 5) FROM {last}" for n in items]
        out += [f"SELECT 'stay{t}', {a}, round({form.format(f'm_{t}_11', f'm_{t}_22')}, 5) FROM {last}" for t in times[:-1]]
    return f"""WITH RECURSIVE {QM.SQL_STATES}, seen AS (SELECT user_id, {wide} FROM states WHERE coalesce({wide}) IS NOT NULL AND {where}), marg AS (SELECT {marg} FROM seen),
g AS (SELECT * FROM (VALUES (1), (2)) a(s0), (VALUES (1), (2)) b(s1), (VALUES (1), (2)) c(s2), (VALUES (1), (2)) d(s3)),
t AS (SELECT 0 AS it, {', '.join(start)} UNION ALL
SELECT it + 1, {', '.join(f'{e} AS {n}' for e, n in zip(new, names))} FROM (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY user_id) AS p
  FROM (SELECT it, user_id, {wide}, s0, s1, s2, s3, {' + '.join(lp)} AS lp FROM seen, g, t WHERE it < {rounds})), marg GROUP BY it)
{' UNION ALL '.join(out)}"""


@query("fit_lta_from_start", chain_rounds(15))
def fit_lta_from_start(spark, sf):
    c = T.fit_lta(QM.states(spark, sf), QM.LTA_ITEMS, QM.TIMES, 2, starts=[(QM.START, QM.MOVES, [{"p": np.array(QM.RHO)}])], max_iter=15, tol=-1)
    return rounded(spark.createDataFrame(chain_parameters(c), PARAMS), 5)


def chain_parameters(c: T.Chain) -> list[tuple]:
    rows = []
    for a in range(2):
        rows.append(("start", a + 1, float(c.start[a])))
        rows += [(n, a + 1, float(c.params[0][0]["p"][a, j])) for j, n in enumerate(QM.LTA_ITEMS)]
        rows += [(f"stay{t}", a + 1, float(c.moves[t, a, a])) for t in range(3)]
    return rows


#: Both groups' statuses in the order of their starting shares over all.
SQL_HALVES_ORDER = f"""WITH {QM.SQL_STATES}, sizes AS (SELECT user_id % 2 AS half, count(*) AS n FROM states WHERE coalesce({', '.join(WAVES)}) IS NOT NULL GROUP BY ALL),
fitted AS ({" UNION ALL ".join(f"SELECT {g} AS half, * FROM ({chain_rounds(15, f'user_id % 2 = {g}', ordered=False)})" for g in (0, 1))}),
turn AS (SELECT sum(CASE WHEN class = 1 THEN n * estimate ELSE -n * estimate END) < 0 AS turned FROM fitted JOIN sizes USING (half) WHERE item = 'start')
SELECT CAST(half AS BIGINT) AS half, item, CAST(CASE WHEN turned THEN 3 - class ELSE class END AS BIGINT) AS class, estimate FROM fitted, turn"""


@query("fit_lta_groups_from_start", SQL_HALVES_ORDER)
def fit_lta_groups_from_start(spark, sf):
    """Nothing is equal over the groups: each goes its own way from the common start."""
    halves = QM.states(spark, sf).withColumn("half", (F.col("user_id") % 2).cast("int"))
    fit = J.fit_lta_groups(halves, QM.LTA_ITEMS, QM.TIMES, "half", 2, measurement_equal=False, starts=[(QM.START, QM.MOVES, [{"p": np.array(QM.RHO)}])], max_iter=15, tol=-1)
    return rounded(spark.createDataFrame([(g, *r) for g, c in fit["groups"].items() for r in chain_parameters(c)], f"half bigint, {PARAMS}"), 5)


TWO_JOINT, TWO_X, TWO_Y = [[0.4, 0.15], [0.15, 0.3]], [[0.2, 0.3, 0.4], [0.7, 0.8, 0.6]], [[0.3, 0.2], [0.6, 0.7]]


def two_latent_sql(rounds: int) -> str:
    """EM over the four cells of two binary latent variables; classes then by size, 0 where an item is not of the variable."""
    both, xs, ys = (0, 1), Q.FLAGS[:3], Q.FLAGS[3:]
    sides = [("x", xs, TWO_X, lambda a: f"(r{a}0 + r{a}1)"), ("y", ys, TWO_Y, lambda b: f"(r0{b} + r1{b})")]
    cells = [(a, b) for a in both for b in both]
    start = [f"{num(TWO_JOINT[a][b])} AS p{a}{b}" for a, b in cells] + [f"{num(prob[c][j])} AS {f}_{c}" for _, items, prob, _ in sides for c in both for j, f in enumerate(items)]
    log = lambda f, c: f"coalesce(CASE WHEN {f} = 1 THEN ln(greatest({f}_{c}, 1e-15)) WHEN {f} = 0 THEN ln(greatest(1 - {f}_{c}, 1e-15)) END, 0)"
    logs = ", ".join(f"ln(p{a}{b} + 1e-15) + " + " + ".join([*(log(f, a) for f in xs), *(log(f, b) for f in ys)]) + f" AS l{a}{b}" for a, b in cells)
    top = f"greatest({', '.join(f'l{a}{b}' for a, b in cells)})"
    post = ", ".join(f"w * exp(l{a}{b} - {top}) / ({' + '.join(f'exp(l{c}{d} - {top})' for c, d in cells)}) AS r{a}{b}" for a, b in cells)
    new = [f"(sum(r{a}{b}) + 0.25e0) / (sum(w) + 1)" for a, b in cells]
    new += [f"(coalesce(sum({r(c)} * {f}), 0) + any_value(m_{f}) / 2) / (coalesce(sum(CASE WHEN {f} IS NOT NULL THEN {r(c)} END), 0) + 0.5e0)" for _, items, _, r in sides for c in both for f in items]
    turned = {"x": "p10 + p11 > p00 + p01", "y": "p01 + p11 > p00 + p10"}
    at = lambda side, c: f"CAST(CASE WHEN {turned[side]} THEN {2 - c} ELSE {1 + c} END AS BIGINT)"
    out = [f"SELECT 'share' AS item, {at('x', a)} AS class_x, {at('y', b)} AS class_y, round(p{a}{b}, 5) AS estimate FROM last" for a, b in cells]
    out += [f"SELECT '{f}', {at('x', c)}, 0, round({f}_{c}, 5) FROM last" for c in both for f in xs] + [f"SELECT '{f}', 0, {at('y', c)}, round({f}_{c}, 5) FROM last" for c in both for f in ys]
    out.append(f"SELECT 'log odds', 1, 1, round(CASE WHEN ({turned['x']}) = ({turned['y']}) THEN 1 ELSE -1 END * ln(p00 * p11 / (p01 * p10)), 4) FROM last")
    return f"""WITH RECURSIVE {Q.SQL_FLAGS}, {Q.SQL_GAPS}, pat AS (SELECT {', '.join(Q.FLAGS)}, CAST(count(*) AS DOUBLE) AS w FROM gaps WHERE coalesce({', '.join(Q.FLAGS)}) IS NOT NULL GROUP BY ALL),
marg AS (SELECT {', '.join(f'sum(w * {f}) / sum(CASE WHEN {f} IS NOT NULL THEN w END) AS m_{f}' for f in Q.FLAGS)} FROM pat),
t AS (SELECT 0 AS it, {', '.join(start)} UNION ALL
SELECT it + 1, {', '.join(new)} FROM (SELECT *, {post} FROM (SELECT it, {', '.join(Q.FLAGS)}, w, {logs} FROM pat, t WHERE it < {rounds})), marg GROUP BY it),
last AS (SELECT * FROM t WHERE it = {rounds})
{' UNION ALL '.join(out)}"""


@query("two_latent_from_start", two_latent_sql(40))
def two_latent_from_start(spark, sf):
    xs, ys = Q.FLAGS[:3], Q.FLAGS[3:]
    start = [(np.array(TWO_JOINT), [{"p": np.array(TWO_X)}], [{"p": np.array(TWO_Y)}])]
    fit = J.fit_two_latent(Q.gaps(Q.flags(spark, sf)), xs, ys, 2, 2, starts=start, max_iter=40, tol=-1)
    rows = [("share", a + 1, b + 1, round(float(fit["joint"][a, b]), 5)) for a in range(2) for b in range(2)]
    rows += [(f, c + 1, 0, round(float(fit["params"][0][0]["p"][c, j]), 5)) for c in range(2) for j, f in enumerate(xs)]
    rows += [(f, 0, c + 1, round(float(fit["params"][1][0]["p"][c, j]), 5)) for c in range(2) for j, f in enumerate(ys)]
    rows.append(("log odds", 1, 1, round(float(fit["coefficients"]["estimate"][0]), 4)))
    return spark.createDataFrame(rows, "item string, class_x bigint, class_y bigint, estimate double")


# ---------------------------------------------------------------- continuous items


def gauss_rounds(rounds: int) -> str:
    """EM of a latent profile model with class variances; classes then by size."""
    names, both = ("quantity", "discount"), (0, 1)
    start = ", ".join(f"{num((0.55, 0.45)[c])} AS pi{c}, " + ", ".join(f"{num(Q.GAUSS['mean'][c, j])} AS m_{n}_{c}, {num(Q.GAUSS['var'][c, j])} AS s_{n}_{c}" for j, n in enumerate(names)) for c in both)
    logs = ", ".join(f"ln(pi{c} + 1e-15) + " + " + ".join(f"(-0.5e0 * (({n} - m_{n}_{c}) * ({n} - m_{n}_{c}) / s_{n}_{c} + ln(2 * pi() * s_{n}_{c})))" for n in names) + f" AS l{c}" for c in both)
    new = ", ".join(f"(sum(r{c}) + 0.5e0) / (count(*) + 1), " + ", ".join(f"sum(r{c} * {n}) / sum(r{c}), (sum(r{c} * {n} * {n}) - sum(r{c} * {n}) * (sum(r{c} * {n}) / sum(r{c})) + 0.5e0 * any_value(v_{n})) / (sum(r{c}) + 0.5e0)" for n in names) for c in both)
    last = f"(SELECT * FROM t WHERE it = {rounds})"
    size = lambda c: f"CAST(1 + CASE WHEN pi{1 - c} > pi{c} THEN 1 ELSE 0 END AS BIGINT)"
    out = [f"SELECT 'class' AS item, {size(c)} AS class, round(pi{c}, 5) AS estimate FROM {last}" for c in both]
    out += [f"SELECT '{n} {p}', {size(c)}, round({q}_{n}_{c} * {scale}, 4) FROM {last}" for c in both for n, scale in (("quantity", 1), ("discount", 100)) for p, q in (("mean", "m"), ("var", "s"))]
    return f"""WITH RECURSIVE {Q.SQL_SIZES}, marg AS (SELECT {', '.join(f'var_pop({n}) AS v_{n}' for n in names)} FROM sizes),
t AS (SELECT 0 AS it, {start} UNION ALL
SELECT it + 1, {new} FROM (SELECT *, 1 / (1 + exp(l1 - l0)) AS r0, 1 / (1 + exp(l0 - l1)) AS r1 FROM (SELECT it, quantity, discount, {logs} FROM sizes, t WHERE it < {rounds})), marg GROUP BY it)
{' UNION ALL '.join(out)}"""


@query("fit_lpa_from_start", gauss_rounds(12))
def fit_lpa_from_start(spark, sf):
    names = ["quantity", "discount"]
    start = [(np.array([0.55, 0.45]), [{k: v.copy() for k, v in Q.GAUSS.items()}])]
    fit = M.fit_mixture(Q.sizes(spark, sf), names, 2, "continuous", variances_equal=False, starts=start, max_iter=12, tol=-1)
    rows = [("class", c + 1, round(float(fit.pi[c]), 5)) for c in range(2)]
    rows += [(f"{n} {p}", c + 1, round(float(fit.params[0][k][c, j]) * (1, 100)[j], 4)) for c in range(2) for j, n in enumerate(names) for p, k in (("mean", "mean"), ("var", "var"))]
    return spark.createDataFrame(rows, PARAMS)


# ---------------------------------------------------------------- closed forms

SQL_SPLIT = f"{Q.SQL_CAT}, z AS (SELECT post.*, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS dear FROM post JOIN orders USING (o_orderkey))"
#: Share of class 1 and n in either half; e, the error table.  Of a saturated regression the estimates are differences of logits.
SQL_STEP3 = f"""{SQL_SPLIT}, e AS (SELECT sum(p1 * p1) / sum(p1) AS e11, sum(p1 * p2) / sum(p2) AS e12 FROM z),
h AS (SELECT dear, count(*) AS n, sum(p1) / count(*) AS r FROM z GROUP BY dear),
q AS (SELECT dear, n, r, e11, e12, (r - e12) / (e11 - e12) AS q FROM h, e),
g AS (SELECT 'ML' AS correction, dear, ln(q / (1 - q)) AS b, r * (1 - r) / (n * pow((e11 - e12) * q * (1 - q), 2)) AS v FROM q
UNION ALL SELECT 'BCH', dear, ln(q / (1 - q)), 1 / (n * q * (1 - q)) FROM q UNION ALL SELECT 'none', dear, ln(r / (1 - r)), 1 / (n * r * (1 - r)) FROM q)"""


@query("three_step_saturated", f"""WITH {SQL_STEP3}
SELECT correction, '(intercept)' AS term, round(b, 4) AS estimate, round(sqrt(v), 4) AS se FROM g WHERE dear = 0
UNION ALL SELECT a.correction, 'dear', round(c.b - a.b, 4), round(sqrt(a.v + c.v), 4) FROM g a JOIN g c USING (correction) WHERE a.dear = 0 AND c.dear = 1""")
def three_step_saturated(spark, sf):
    """A regression on one yes-or-no covariate, under each correction: estimates and standard errors."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("dear"))
    scored = Q.cat_scored(spark, sf).join(o, "o_orderkey")
    rows = [(c, r.term, float(r.estimate), float(r.se)) for c, t in S.compare_corrections(scored, ["dear"], 2).items() for r in t.itertuples()]
    return rounded(spark.createDataFrame(rows, "correction string, term string, estimate double, se double"), 4)


def two_step_sql(rounds: int = 60) -> str:
    """In either half, the share of class 1 at which the score is zero, by bisection, and the information there."""
    slope = "(p1 / 0.6e0 - p2 / 0.4e0) / ({0} * p1 / 0.6e0 + (1 - {0}) * p2 / 0.4e0)"
    return f"""WITH RECURSIVE {SQL_SPLIT}, t AS (SELECT 0 AS it, dear, 1e-9 AS lo, 1 - 1e-9 AS hi FROM (SELECT DISTINCT dear FROM z) UNION ALL
SELECT it + 1, t.dear, CASE WHEN sum({slope.format('((lo + hi) / 2)')}) > 0 THEN (any_value(lo) + any_value(hi)) / 2 ELSE any_value(lo) END, CASE WHEN sum({slope.format('((lo + hi) / 2)')}) > 0 THEN any_value(hi) ELSE (any_value(lo) + any_value(hi)) / 2 END
FROM t JOIN z ON t.dear = z.dear WHERE it < {rounds} GROUP BY it, t.dear),
g AS (SELECT t.dear, any_value(ln(lo / (1 - lo))) AS b, 1 / (any_value(pow(lo * (1 - lo), 2)) * sum(pow({slope.format('lo')}, 2))) AS v FROM t JOIN z ON t.dear = z.dear WHERE it = {rounds} GROUP BY t.dear)
SELECT '(intercept)' AS term, round(b, 4) AS estimate, round(sqrt(v), 3) AS se FROM g WHERE dear = 0
UNION ALL SELECT 'dear', round(c.b - a.b, 4), round(sqrt(a.v + c.v), 3) FROM g a, g c WHERE a.dear = 0 AND c.dear = 1"""


@query("two_step_saturated", two_step_sql())
def two_step_saturated(spark, sf):
    """The same regression with the measurement held: the score is zero, and the observed information gives the errors."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("dear"))
    t = S.two_step_covariates(Q.cat_scored(spark, sf).join(o, "o_orderkey"), ["dear"], [0.6, 0.4])
    return spark.createDataFrame([(r.term, round(float(r.estimate), 4), round(float(r.se), 3)) for r in t.itertuples()], "term string, estimate double, se double")


SQL_MODAL = f"{QM.SQL_PRICED}, e AS (SELECT sum(CASE WHEN class = 1 THEN p1 ELSE 0 END) / sum(p1) AS e11, sum(CASE WHEN class = 1 THEN p2 ELSE 0 END) / sum(p2) AS e12 FROM priced), n AS (SELECT segment AS category, sum(CASE WHEN class = 1 THEN 1.0e0 ELSE 0 END) AS a, sum(CASE WHEN class = 2 THEN 1.0e0 ELSE 0 END) AS b FROM priced GROUP BY 1), m AS (SELECT category, ((1 - e12) * a - e12 * b) / (e11 - e12) AS one, (e11 * b - (1 - e11) * a) / (e11 - e12) AS two FROM n, e)"


@query("ml_outcome_saturated", f"WITH {SQL_MODAL} SELECT 1 AS class, category, round(one / (SELECT sum(one) FROM m), 4) AS proportion FROM m UNION ALL SELECT 2, category, round(two / (SELECT sum(two) FROM m), 4) FROM m")
def ml_outcome_saturated(spark, sf):
    return rounded(spark.createDataFrame(S.ml_outcome(QM.segment_patterns(spark, sf), "segment", 2, weight="n")), 4)


SQL_BCH_MEANS = ", ".join(f"sum(w{c}) AS n{c}, sum(w{c} * y) / sum(w{c}) AS m{c}" for c in (1, 2))


@query("add_outcome_bch", f"WITH {QM.SQL_PRICED}, s AS (SELECT {SQL_BCH_MEANS} FROM priced) " + " UNION ALL ".join(f"SELECT {c} AS class, round(any_value(n{c}), 3) AS n, round(any_value(m{c}), 2) AS mean, round(sqrt(sum(pow(w{c} * (y - m{c}), 2))) / any_value(n{c}), 2) AS se FROM priced, s" for c in (1, 2)))
def add_outcome_bch(spark, sf):
    from latticore.operators import inference as I

    t = I.add_outcome(QM.priced(spark, sf), "y", 2)["estimates"]
    return spark.createDataFrame([(int(r["class"]), round(float(r["n"]), 3), round(float(r["mean"]), 2), round(float(r["se"]), 2)) for _, r in t.iterrows()], "class bigint, n double, mean double, se double")


SQL_ONE = ", ".join(f"avg({f}) AS {f}" for f in Q.FLAGS)


@query("measurement_estimates_one_class", f"WITH {Q.SQL_FLAGS}, m AS (SELECT count(*) AS n, {SQL_ONE} FROM flags) " + " UNION ALL ".join(f"SELECT '{f}' AS item, round({f}, 6) AS estimate, round(sqrt({f} * (1 - {f}) / n), 6) AS se FROM m" for f in Q.FLAGS))
def measurement_estimates_one_class(spark, sf):
    from latticore.plans import patterns as P

    df = Q.flags(spark, sf)
    t = P.collapse(df, Q.FLAGS, names=("_weight", "_rows")).toPandas()  # at most 2^5 patterns
    est = M.fit_mixture(df, Q.FLAGS, 1, "binary").measurement_estimates(*M.pattern_arrays(t, Q.FLAGS))
    return rounded(spark.createDataFrame(est[["item", "estimate", "se"]]))


def merge_sql() -> str:
    xlogx = lambda p: f"(CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END)"
    pairs = [(1, 2, 3, "1+2", "1+2+3"), (1, 3, 2, "1+3", "1+3+2"), (2, 3, 1, "2+3", "1+2+3")]
    gains = " UNION ALL ".join(f"SELECT '{m}' AS merged, '{w}' AS whole, sum(o * ({xlogx(f'(p{a} + p{b})')} - {xlogx(f'p{a}')} - {xlogx(f'p{b}')})) AS gain, sum(o * (p{a} + p{b})) AS moved FROM post" for a, b, _, m, w in pairs)
    return f"""WITH {Q.SQL_FULL}, gains AS ({gains}), best AS (SELECT * FROM gains ORDER BY gain DESC LIMIT 1), now AS (SELECT sum(o) AS n, -sum(o * ({' + '.join(xlogx(f'p{c}') for c in (1, 2, 3))})) AS e FROM post)
SELECT 3 AS k, '' AS merged, round(e, 5) AS merge_entropy, 0.0e0 AS entropy_drop, 0.0e0 AS cases_merged FROM now
UNION ALL SELECT 2, merged, round(e - gain, 5), round(gain, 5), round(moved, 5) FROM now, best UNION ALL SELECT 1, whole, 0.0e0, round(e - gain, 5), round(n, 5) FROM now, best"""


@query("merge_path_given", merge_sql())
def merge_path_given(spark, sf):
    from latticore.operators import diagnostics as D
    from latticore.plans import patterns as P

    t = Q.lca().transform(P.collapse(Q.flags(spark, sf), Q.FLAGS)).select("posterior", "w").toPandas()  # at most 2^5 patterns
    path = D.merge_path(np.stack(t["posterior"].to_numpy()), t["w"].to_numpy())
    return spark.createDataFrame([(int(r.k), r.merged, *(round(float(v), 5) + 0.0 for v in (r.merge_entropy, r.entropy_drop, r.cases_merged))) for r in path.itertuples()], "k bigint, merged string, merge_entropy double, entropy_drop double, cases_merged double")


def profile_sql() -> str:
    out = []
    for n in ("quantity", "discount"):
        mu = f"(0.55e0 * a.{n}_m + 0.45e0 * b.{n}_m)"
        sd = f"sqrt(0.55e0 * (a.{n}_v + pow(a.{n}_m - {mu}, 2)) + 0.45e0 * (b.{n}_v + pow(b.{n}_m - {mu}, 2)))"
        out += [f"SELECT {c + 1} AS class, '{n}' AS item, round(({own}.{n}_m - {mu}) / {sd}, 6) AS value FROM moments a, moments b WHERE a.g = 0 AND b.g = 1" for c, own in enumerate("ab")]
    return f"WITH {Q.SQL_SIZES}, {Q.SQL_MOMENTS} " + " UNION ALL ".join(out)


@query("profile_data_given", profile_sql())
def profile_data_given(spark, sf):
    """Orders without and with returns as two profiles."""
    from latticore.operators import report as R

    return rounded(R.profile_data(Q.returns_fit(spark, sf), spark))


def mcar_sql(rounds: int) -> str:
    """EM over the 32 cells of the saturated model, then twice the sum of observed by expected logs over patterns of missing cells."""
    f = Q.FLAGS
    match = lambda a, b: " AND ".join(f"({a}.{x} IS NULL OR {a}.{x} = {b}.{x})" for x in f)
    mask = ", ".join(f"{x} IS NULL AS u_{x}" for x in f)
    masks = ", ".join(f"u_{x}" for x in f)
    cells = ", ".join(f"(VALUES (0), (1)) v_{x}({x})" for x in f)
    return f"""WITH RECURSIVE {Q.SQL_FLAGS}, {Q.SQL_GAPS}, pat AS (SELECT row_number() OVER () AS id, * FROM (SELECT {', '.join(f)}, CAST(count(*) AS DOUBLE) AS w FROM gaps {Q.SOME} GROUP BY ALL)),
cells AS (SELECT * FROM {cells}),
t AS (SELECT 0 AS it, {', '.join(f)}, 1.0e0 / 32 AS p FROM cells UNION ALL
SELECT it + 1, {', '.join(f'c_{x}' for x in f)}, sum(w * p / s) / any_value(total) FROM (SELECT it, {', '.join(f't.{x} AS c_{x}' for x in f)}, p, w, sum(p) OVER (PARTITION BY pat.id) AS s, (SELECT sum(w) FROM pat) AS total FROM pat JOIN t ON {match('pat', 't')} WHERE it < {rounds}) GROUP BY it, {', '.join(f'c_{x}' for x in f)}),
m AS (SELECT pat.*, {mask}, sum(w) OVER (PARTITION BY {', '.join(f'{x} IS NULL' for x in f)}) AS n FROM pat),
x AS (SELECT id, any_value(w) AS o, any_value(n) * sum(p) AS e FROM m JOIN t ON {match('m', 't')} WHERE it = {rounds} GROUP BY id),
d AS (SELECT sum(pow(2, {' + '.join(f'CASE WHEN u_{x} THEN 0 ELSE 1 END' for x in f)}) - 1) AS df FROM (SELECT DISTINCT {masks} FROM m))
SELECT round(sum(2 * o * ln(o / e)), 3) AS stat, CAST(any_value(df) - 31 AS BIGINT) AS df FROM x, d"""


@query("mcar_statistic", mcar_sql(80))
def mcar_statistic(spark, sf):
    from latticore.operators import diagnostics as D
    from latticore.plans import patterns as P

    t = P.collapse(Q.gaps(Q.flags(spark, sf)).where(F.coalesce(*Q.FLAGS).isNotNull()), Q.FLAGS, names=("_weight", "_rows")).toPandas()  # at most 3^5 patterns
    r = D.mcar_test(*M.pattern_arrays(t, Q.FLAGS), [[0, 1]] * 5)
    return spark.createDataFrame([(round(float(r["stat"]), 3), int(r["df"]))], "stat double, df bigint")


# ---------------------------------------------------------------- finish, later steps, groups, levels

SQL_OWES = f"{QM.SQL_PRICED}, n AS (SELECT segment, CASE WHEN x < 0 THEN 1 ELSE 0 END AS owes, sum(p1) AS n1, sum(p2) AS n2 FROM priced GROUP BY 1, 2), top AS (SELECT max(segment) AS ref FROM n)"


def slopes_sql() -> str:
    out = []
    for c in (1, 2):
        out.append(f"SELECT {c} AS class, a.segment AS category, max(CASE WHEN owes = 0 THEN ln(a.n{c} / b.n{c}) END) AS i0, max(CASE WHEN owes = 1 THEN ln(a.n{c} / b.n{c}) END) AS i1, max(CASE WHEN owes = 0 THEN 1 / a.n{c} + 1 / b.n{c} END) AS v0, max(CASE WHEN owes = 1 THEN 1 / a.n{c} + 1 / b.n{c} END) AS v1 FROM n a JOIN n b USING (owes) JOIN top ON b.segment = ref WHERE a.segment <> ref GROUP BY a.segment")
    return f"WITH {SQL_OWES}, s AS ({' UNION ALL '.join(out)}) SELECT class, category, '(intercept)' AS term, round(i0, 4) AS estimate, round(sqrt(v0), 4) AS se FROM s UNION ALL SELECT class, category, 'owes', round(i1 - i0, 4), round(sqrt(v0 + v1), 4) FROM s"


@query("outcome_slopes_categorical", slopes_sql())
def outcome_slopes_categorical(spark, sf):
    from latticore.operators import finish

    df = QM.priced(spark, sf).withColumn("owes", F.when(F.col("x") < 0, 1.0).otherwise(0.0))
    t = finish.outcome_slopes_categorical(df, "segment", ["owes"], 2, column="posterior")
    return rounded(spark.createDataFrame(t[["class", "category", "term", "estimate", "se"]]), 4)


FINISH = (np.array([0.6, 0.4]), [{"p": np.array([[0.4, 0.3, 0.3, 0.4, 0.5], [0.6, 0.5, 0.4, 0.7, 0.8]])}])


@query("lca_newton_finish", binary_rounds(Q.SQL_FLAGS, "flags", Q.FLAGS, FINISH[0].tolist(), FINISH[1][0]["p"].tolist(), 6000).replace(", 5) AS estimate", ", 3) AS estimate").replace(", 5) FROM", ", 3) FROM"))
def lca_newton_finish(spark, sf):
    """A short EM and a Newton finish in passes over the table are where thousands of rounds lead."""
    from latticore.operators import finish
    from latticore.plans import patterns as P

    df = P.collapse(Q.flags(spark, sf), Q.FLAGS, names=("_weight", "_rows")).persist()  # at most 2^5 patterns
    fit = M.fit_mixture(df, Q.FLAGS, 2, "binary", weight="_weight", weight_type="frequency", starts=[FINISH], max_iter=60, tol=-1)
    done = finish.newton_finish_table(fit, df, "_weight")
    df.unpersist()
    return rounded(class_parameters(spark, done, Q.FLAGS), 3)


SQL_HALVES = f"{Q.SQL_FLAGS}, pat AS (SELECT o_totalprice > 150000 AS dear, {', '.join(Q.FLAGS)}, CAST(count(*) AS DOUBLE) AS o FROM flags JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), " + Q.posterior_sql(Q.LCA_LOGS, "pat", "dear, " + ", ".join(Q.FLAGS) + ", o") + ", cells AS (SELECT o, exp(loglik) * sum(o) OVER (PARTITION BY dear) AS e FROM post)"


@query("absolute_fit_groups", f"WITH {SQL_HALVES} SELECT round(sum(2 * o * ln(o / e)), 3) AS g2, round(sum((o - e) * (o - e) / e) + greatest(sum(o) - sum(e), 0), 3) AS x2, CAST(64 - 1 - 34 - 1 AS BIGINT) AS df FROM cells")
def absolute_fit_groups(spark, sf):
    from latticore.operators import diagnostics as D

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") > 150000).alias("dear"))
    r = D.fit_absolute_groups({"true": Q.lca(), "false": Q.lca()}, Q.flags(spark, sf).join(o, "l_orderkey"), "dear", 34)
    return spark.createDataFrame([(round(r["g2"], 3), round(r["x2"], 3), int(r["df"]))], "g2 double, x2 double, df bigint")


@query("encode_levels", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS o_orderstatus FROM orders")
def encode_levels(spark, sf):
    from latticore.sources import panel

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    coded, _ = panel.encode_levels(o, ["o_orderpriority", "o_orderstatus"], {"o_orderstatus": ["P", "O", "F"]})
    return coded.select("o_orderkey", F.col("o_orderpriority").cast("bigint").alias("o_orderpriority"), "o_orderstatus")


@query("align_rows", f"WITH {Q.SQL_FLAGS}, {Q.SQL_GAPS} SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN gaps ON o_orderkey = l_orderkey {Q.SOME}")
def align_rows(spark, sf):
    from latticore.sources import panel

    fitted = panel.drop_empty(Q.gaps(Q.flags(spark, sf)), Q.FLAGS).select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return panel.align_rows(rows, fitted, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
