"""Registered three-step chains of a given first step, with the closed forms that saturated covariates allow."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.operators import threestep as TS
from latticore.plans.queries_data import num, table
from latticore.registry import query

ITEMS, TIMES = ["bulk", "cut"], [1, 2, 3, 4]
SHARES = [[0.55, 0.45], [0.5, 0.5], [0.5, 0.5], [0.45, 0.55]]
RHO = [[0.95, 0.8], [0.05, 0.3]]
COEFFICIENTS = "part string, occasion int, from_status int, term string, estimate double"


def lines(spark, sf) -> DataFrame:
    """Orders by their first four lines: whether a line is of many pieces, and whether it is cheaper by a twentieth or more."""
    li = table(spark, sf, "lineitem").where(F.col("l_linenumber").isin(TIMES))
    cells = {f"{n}@{t}": F.max(F.when(F.col("l_linenumber") == t, hit.cast("int"))) for t in TIMES for n, hit in (("bulk", F.col("l_quantity") >= 25), ("cut", F.col("l_discount") >= 0.05))}
    return li.groupBy("l_orderkey").agg(*(v.alias(c) for c, v in cells.items()))


def assigned_sql(times) -> str:
    """seen: p, the posterior of status 1 at each line by the line's own items, and s, whether it is assigned; rates: P(assigned 1 | true 1) and P(assigned 1 | true 2)."""

    def posterior(t: int) -> str:
        def odds(s: int) -> str:
            items = [f"coalesce(CASE WHEN {n}{t} = 1 THEN ln({num(RHO[s][j])}) ELSE CASE WHEN {n}{t} = 0 THEN ln({num(1 - RHO[s][j])}) END END, 0)" for j, n in enumerate(ITEMS)]
            return f"{num(math.log(SHARES[t - 1][s] + 1e-15))} + {' + '.join(items)}"

        return f"1 / (1 + exp(({odds(1)}) - ({odds(0)})))"

    hit = {"bulk": "l_quantity >= 25", "cut": "l_discount >= 0.05"}
    waves = ", ".join(f"max(CASE WHEN l_linenumber = {t} THEN CASE WHEN {hit[n]} THEN 1 ELSE 0 END END) AS {n}{t}" for t in TIMES for n in ITEMS)
    answered = ", ".join(f"{n}{t}" for t in times for n in ITEMS)
    p = ", ".join(f"{posterior(t)} AS p{t}" for t in times)
    s = ", ".join(f"CASE WHEN p{t} >= 0.5 THEN 1 ELSE 0 END AS s{t}" for t in times)
    rates = ", ".join(f"sum(s{t} * p{t}) / sum(p{t}) AS a{t}, sum(s{t} * (1 - p{t})) / sum(1 - p{t}) AS b{t}" for t in times)
    return f"""wide AS (SELECT l_orderkey, {waves} FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4 GROUP BY l_orderkey),
posteriors AS (SELECT l_orderkey % 2 AS h, {p} FROM wide WHERE coalesce({answered}) IS NOT NULL),
seen AS (SELECT *, {s} FROM posteriors),
rates AS (SELECT {rates} FROM seen)"""


def closed_form(times, correction: str, covariate: bool) -> str:
    """Starts and moves in either half from q, the weight of true status 1: the inverted table of errors at what is assigned, or what is assigned."""
    q = ", ".join(f"(s{t} - b{t}) / (a{t} - b{t}) AS q{t}" if correction != "none" else f"CAST(s{t} AS DOUBLE) AS q{t}" for t in times)
    pairs = list(zip(times, times[1:]))
    cells = [f"avg(q{times[0]}) AS g"]
    for t, u in pairs:
        cells += [f"sum(q{t} * q{u}) / sum(q{t}) AS m{t}_1", f"sum((1 - q{t}) * q{u}) / sum(1 - q{t}) AS m{t}_2"]
    rows = [("initial", 0, 0, "g")] + [("transition", i + 1, a, f"m{t}_{a}") for i, (t, _) in enumerate(pairs) for a in (1, 2)]
    out = []
    for part, occasion, a, v in rows:
        at = lambda h, v=v: f"max(CASE WHEN h = {h} THEN ln({v} / (1 - {v})) END)"
        out.append(f"SELECT '{part}' AS part, {occasion} AS occasion, {a} AS from_status, '(intercept)' AS term, round({at(0)}, 4) AS estimate FROM halves")
        if covariate:
            out.append(f"SELECT '{part}', {occasion}, {a}, 'z', round({at(1)} - {at(0)}, 4) FROM halves")
    return f"""WITH {assigned_sql(times)},
weights AS (SELECT {'h' if covariate else '0 AS h'}, {q} FROM seen, rates),
halves AS (SELECT h, {', '.join(cells)} FROM weights GROUP BY h)
{' UNION ALL '.join(out)}"""


def steps(spark, sf, times, *, covariate: bool, **how):
    df = lines(spark, sf).withColumn("z", (F.col("l_orderkey") % 2).cast("double"))
    given = (np.array([SHARES[t - 1] for t in times]), [{"p": np.array(RHO)}])
    z = ["z"] if covariate else []
    fit = TS.fit_three_step_lta(df, ITEMS, times, 2, initial=z, transition=z, step1=given, **how)
    c = fit["coefficients"].fillna({"occasion": 0, "from_status": 0})
    return spark.createDataFrame([(r.part, int(r.occasion), int(r.from_status), r.term, round(float(r.estimate), 4)) for r in c.itertuples()], COEFFICIENTS)


@query("three_step_bch", closed_form(TIMES, "bch", True))
def three_step_bch(spark, sf):
    """Four lines in either half: no path is spelled out here or there."""
    return steps(spark, sf, TIMES, covariate=True, correction="bch")


@query("three_step_naive", closed_form(TIMES, "none", True))
def three_step_naive(spark, sf):
    """What is assigned is taken for true, in either half."""
    return steps(spark, sf, TIMES, covariate=True, correction="none")


@query("three_step_ml_saturated", closed_form(TIMES[:2], "ml", True))
def three_step_ml_saturated(spark, sf):
    """Two lines in either half: as many probabilities as cells, so the likelihood's maximum is the inverted tables' solution."""
    return steps(spark, sf, TIMES[:2], covariate=True, correction="ml")
