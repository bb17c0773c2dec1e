"""Chains in three steps: statuses are measured at each occasion on its own, assigned, and their moves estimated with the errors of assignment held fixed.

Step one is a model of the items without moves: equal over occasions, with shares of its own at each, so that what is assigned at an occasion depends on the items of
that occasion alone.  Step two assigns statuses and makes a table of errors for each occasion, as errors depend on its shares.  Step three is a chain of the
assigned statuses, in one of three ways:

* ``ml``: an assigned status is an indicator of the true one, with the table of errors as its fixed probabilities;
* ``bch``: a case weighs on every path of true statuses by the product of the inverted tables' rows.  As each row sums to one, the likelihood needs a case's weights of
  single statuses and of pairs only, so no path is spelled out;
* ``none``: what is assigned is taken for true.

Rows become distinct paths of assigned statuses, with covariates, in one aggregation; under proportional assignment a case is on each path with the product of its
posteriors, made as one array in SQL functions and summed by path, for at most `max_paths` paths.  Step three then costs by these cells: up to `max_cells` in arrays,
above that in passes over partitions, with the same rounds and results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.functions.special import EPS, inverse, pinv, softmax
from latticore.operators import jointly as J
from latticore.operators import mixture as M
from latticore.operators import passes
from latticore.operators import transition as T
from latticore.operators.extended import forward_backward_rows
from latticore.plans import patterns as P
from latticore.sources import panel

FLOOR = 1e-6  # least entry of a table of errors


def measure(df: DataFrame, spec: M.Spec, times: Sequence, *, weight: str | None, n_init: int, seed: int) -> tuple[np.ndarray, list, dict]:
    """Step one: shares by occasion, the items' parameters, and the fit of occasions as groups."""
    stacked = panel.stack_occasions(df, spec.items, times, [weight] if weight else []).drop("time")
    stacked = stacked.withColumnsRenamed({c: f"{c}@0" for c in spec.items})
    blocks = {"continuous" if f == "continuous:class" else f: own for f, own in spec.blocks}
    fit = J.fit_lta_groups(stacked, spec.items, [0], "occasion", spec.k, measurement=blocks, weight=weight, n_init=n_init, seed=seed)
    if len(fit["groups"]) < len(times):
        raise ValueError("an occasion without an observed item")
    chains = [fit["groups"][t + 1] for t in range(len(times))]
    return np.array([c.start for c in chains]), chains[0].params[0], fit


def assign(df: DataFrame, spec: M.Spec, times: Sequence, shares: np.ndarray, params: list) -> DataFrame:
    """df with _p{t}, the posterior of each occasion by its own items, and _s{t}, its modal status from 0; an occasion without answers has its shares."""
    out = df
    for t, label in enumerate(times):
        own = replace(spec, blocks=[(f, panel.column_names(c, [label])) for f, c in spec.blocks], cats={f"{c}@{label}": v for c, v in spec.cats.items()})
        kept = [c for c in out.columns if c not in ("loglik", "class", "probability")]
        out = M.with_parameters(own, shares[t], params)._scored(out, f"_p{t}").select(*(F.col(f"`{c}`") for c in kept), f"_p{t}")
        out = out.withColumn(f"_p{t}", F.coalesce(f"_p{t}", F.array(*(F.lit(float(v)) for v in shares[t]))))
    return out.withColumns({f"_s{t}": (F.array_position(F.col(f"_p{t}"), F.array_max(f"_p{t}")) - 1).cast("int") for t in range(len(times))})


def errors(assigned: DataFrame, k: int, t_max: int, assignment: str, weight: str) -> np.ndarray:
    """P(assigned | true) by occasion (rows assigned, columns true), in one aggregation."""
    own = lambda t, s: (F.col(f"_s{t}") == s).cast("double") if assignment == "modal" else F.col(f"_p{t}")[s]
    row = assigned.agg(*(F.sum(F.col(weight) * own(t, s) * F.col(f"_p{t}")[c]) for t in range(t_max) for s in range(k) for c in range(k))).first()
    d = np.array([v or 0.0 for v in row]).reshape(t_max, k, k)
    d = np.maximum(d / np.maximum(d.sum(axis=1, keepdims=True), EPS), FLOOR)
    return d / d.sum(axis=1, keepdims=True)


def path_cells(assigned: DataFrame, k: int, t_max: int, covariates: Sequence[str], assignment: str, weight: str, max_paths: int = 10_000) -> DataFrame:
    """_s0 ..., the covariates and _w: weights of paths of assigned statuses."""
    states, keys = [f"_s{t}" for t in range(t_max)], [F.col(f"`{c}`") for c in covariates]
    if assignment == "modal":
        return assigned.groupBy(*states, *keys).agg(F.sum(weight).alias("_w"))
    if k**t_max > max_paths:
        raise ValueError(f"{k}^{t_max} paths of statuses are more than {max_paths}: assign modal statuses")
    extended = lambda paths, own: F.flatten(F.transform(paths, lambda a: F.transform(own, lambda p: a * p)))
    paths = F.array(F.col(weight))
    for t in range(t_max):  # the last occasion runs fastest
        paths = extended(paths, F.col(f"_p{t}"))
    summed = assigned.select(*keys, F.posexplode(paths).alias("_path", "_v")).groupBy("_path", *keys).agg(F.sum("_v").alias("_w")).where("_w > 0")
    return summed.select(*((F.floor(F.col("_path") / k ** (t_max - 1 - t)) % k).cast("int").alias(s) for t, s in enumerate(states)), *keys, "_w")


def _unpacked(theta: np.ndarray, k: int, t_max: int, qi: int, qt: int) -> tuple[np.ndarray, np.ndarray]:
    n = (k - 1) * (1 + qi)
    return theta[:n].reshape(k - 1, 1 + qi), theta[n:].reshape(t_max - 1, k, k - 1, 1 + qt)


def _sums(tables: np.ndarray, latent: bool, initial: list[int], transition: list[int], x: np.ndarray, w: np.ndarray, theta: np.ndarray) -> dict:
    """Log-likelihood of cells, its gradient, the information of the complete data, products of scores, and sums of the starts and moves.

    tables: by occasion and assigned status, log-densities by true status where that is latent, else the weights of true statuses.
    """
    t_max, k = len(tables), tables.shape[1]
    at, z, one = x[:, :t_max].astype(int), x[:, t_max:], np.ones((len(x), 1))
    zi, zt = np.hstack([one, z[:, initial]]), np.hstack([one, z[:, transition]])
    gamma, tau = _unpacked(theta, k, t_max, len(initial), len(transition))
    edge = np.zeros((len(x), 1))
    start = softmax(np.hstack([zi @ gamma.T, edge]))
    moves = np.stack([np.stack([softmax(np.hstack([zt @ tau[t, a].T, edge])) for a in range(k)], axis=1) for t in range(t_max - 1)]) if t_max > 1 else np.zeros((0, len(x), k, k))
    own = np.stack([tables[t][at[:, t]] for t in range(t_max)], axis=1)
    if latent:
        ll, g, xi = forward_backward_rows(own, start, moves)
    else:
        g, xi = own, own[:, :-1, :, None] * own[:, 1:, None, :]
        ll = (g[:, 0] * np.log(np.maximum(start, 1e-300))).sum(axis=1) + (xi * np.log(np.maximum(moves.transpose(1, 0, 2, 3), 1e-300))).sum(axis=(1, 2, 3))
    scores, blocks = [], []
    regressions = [(g[:, 0], start, one[:, 0], zi)] + [(xi[:, t, a], moves[t][:, a], g[:, t, a], zt) for t in range(t_max - 1) for a in range(k)]
    for hit, p, mass, d in regressions:
        scores.append(((hit - mass[:, None] * p)[:, :-1, None] * d[:, None, :]).reshape(len(d), -1))
        inner = np.einsum("n,na,ab->nab", w * mass, p, np.eye(k)) - np.einsum("n,na,nb->nab", w * mass, p, p)
        size = scores[-1].shape[1]
        blocks.append(np.einsum("nab,ni,nj->aibj", inner[:, :-1, :-1], d, d, optimize=True).reshape(size, size))
    every, ends = np.concatenate(scores, axis=1), np.cumsum([0, *(len(b) for b in blocks)])
    info = np.zeros((ends[-1], ends[-1]))
    for b, lo, hi in zip(blocks, ends, ends[1:]):
        info[lo:hi, lo:hi] = b
    return {"ll": float(w @ ll), "n": float(w.sum()), "g": w @ every, "info": info, "outer": every.T @ (every * w[:, None]), "start": w @ start, "moves": np.einsum("n,tnab->tab", w, moves)}


def _added(a: dict | None, b: dict) -> dict:
    return b if a is None else {n: a[n] + b[n] for n in b}


def _run(theta: np.ndarray, latent: bool, em_rounds: int, max_iter: int, tol: float):
    """Steps of generalised EM, then by products of scores, which at a maximum that fits the cells are the exact information; all steps exact Newton where statuses are known."""
    sums = yield theta
    done, i = False, 0
    for i in range(max_iter):
        done = bool(np.abs(sums["g"]).max() <= tol * sums["n"])
        if done:
            break
        ways, risen = (["info"] if not latent or i < em_rounds else ["outer", "info"]), False
        for how in ways:
            step = np.clip(inverse(sums[how] + 1e-12 * np.eye(len(theta))) @ sums["g"], -5, 5)
            for share in (1.0, 0.5, 0.25, 0.125, 1 / 64, 1 / 512):
                new = np.clip(theta + share * step, -25, 25)
                after = yield new
                if after["ll"] >= sums["ll"] - 1e-13 * abs(sums["ll"]):
                    theta, sums, risen = new, after, True
                    break
            if risen:
                break
        if not risen:
            break
    return {"theta": theta, "sums": sums, "iterations": i, "converged": done}


def fit_three_step_lta(df: DataFrame, items: Sequence[str], times: Sequence, n_statuses: int, *, initial: Sequence[str] = (), transition: Sequence[str] = (), correction: str = "ml", assignment: str = "modal", measurement="binary", weight: str | None = None, n_init: int = 10, seed: int = 1, step1: tuple[np.ndarray, list] | None = None, max_iter: int = 500, tol: float = 1e-9, max_cells: int = 100_000, max_paths: int = 10_000) -> dict:
    """Start and moves of statuses by three steps; both may be multinomial logits of covariates (last status as reference).

    `correction` is ml, bch (of modal statuses) or none; `step1` gives shares by occasion and the items' parameters in place of a fit.  Weights are frequencies.

    Defined cases: a case without any observed item takes no part; an occasion without answers is assigned by that occasion's shares, which its table of errors knows; a case with a null
    covariate is measured but left out of step three; an occasion that nobody answered is refused.  Where bch has no inner maximum (paths of negative weight), it
    is refused by name.  Standard errors are those of step three alone: products of scores (ml), a sandwich (bch, none); under proportional assignment there are none.
    """
    if correction not in ("ml", "bch", "none") or assignment not in ("modal", "proportional"):
        raise ValueError("correction is ml, bch or none, assignment modal or proportional")
    if correction == "bch" and assignment != "modal":
        raise ValueError("bch takes modal statuses")
    spec, k, t_max, extra = J._spec(items, measurement, n_statuses, 1.0), n_statuses, len(times), list(dict.fromkeys([*initial, *transition]))
    if assignment == "proportional" and k**t_max > max_paths:
        raise ValueError(f"{k}^{t_max} paths of statuses are more than {max_paths}: assign modal statuses")
    cols = panel.column_names(spec.items, times)
    coded, coding = T.coded_items(df, spec.blocks, spec.items, times)
    rows = panel.drop_empty(coded, cols).select(*(F.col(f"`{c}`").cast("double").alias(c) for c in [*cols, *extra]), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("_in"))
    if not any(f.startswith("continuous") for f, _ in spec.blocks):
        rows = P.collapse(rows, [*cols, *extra], "_in", names=("_sum", "_rows")).drop("_rows").withColumnRenamed("_sum", "_in")
    rows = rows.persist()
    fit = None
    if step1:
        shares, params = np.asarray(step1[0], float), step1[1]
    else:
        shares, params, fit = measure(rows, spec, times, weight="_in", n_init=n_init, seed=seed)
        spec = fit["groups"][1].spec
    assigned = assign(rows, spec, times, shares, params)
    error = errors(assigned, k, t_max, assignment, "_in")
    cells = path_cells(assigned.dropna(subset=[f"`{c}`" for c in extra]) if extra else assigned, k, t_max, extra, assignment, "_in", max_paths)
    keys = [*(f"_s{t}" for t in range(t_max)), *extra]
    latent = correction == "ml"
    tables = np.log(error) if latent else np.stack([pinv(d).T for d in error]) if correction == "bch" else np.repeat(np.eye(k)[None], t_max, axis=0)
    at = lambda names: [extra.index(c) for c in names]
    logits = lambda p: np.log(np.maximum(p[..., :-1], 1e-6)) - np.log(np.maximum(p[..., -1:], 1e-6))
    wide = lambda v, q: np.concatenate([v[..., None], np.zeros((*v.shape, q))], axis=-1).ravel()
    opened = np.stack([0.5 * np.eye(k) + 0.5 * shares[t + 1] for t in range(t_max - 1)]) if t_max > 1 else np.zeros((0, k, k))
    run = _run(np.concatenate([wide(logits(shares[0]), len(initial)), wide(logits(opened), len(transition))]), latent, 10, max_iter, tol)
    sums = lambda x, w, theta: _sums(tables, latent, at(initial), at(transition), x, w, theta)
    cells = cells.persist()
    local = cells.limit(max_cells + 1).toPandas()
    if local.empty:
        raise ValueError("no case for step three")
    if len(local) <= max_cells:
        x = local.sort_values(keys, ignore_index=True)
        best = passes.alone(run, lambda theta: sums(x[keys].to_numpy(float), x["_w"].to_numpy(float), theta))
    else:
        best = passes.together([run], cells, keys, "_w", sums, _added)[0]
    cells.unpersist()
    rows.unpersist()
    total, theta = best["sums"], best["theta"]
    if correction == "bch" and (not best["converged"] or np.abs(theta).max() > 24 or np.linalg.eigvalsh(total["info"]).min() <= 0):
        raise ValueError("bch has no inner maximum here, as paths of statuses weigh less than nothing: use ml")
    bread = inverse(total["outer"] if latent else total["info"])
    vcov = bread if latent else bread @ total["outer"] @ bread
    se = np.sqrt(np.maximum(np.diag(vcov), 0)) if assignment == "modal" else np.full(len(theta), np.nan)
    names = [("initial", None, None, c + 1, n) for c in range(k - 1) for n in ["(intercept)", *initial]]
    names += [("transition", t + 1, a + 1, c + 1, n) for t in range(t_max - 1) for a in range(k) for c in range(k - 1) for n in ["(intercept)", *transition]]
    coefficients = pd.DataFrame(names, columns=["part", "occasion", "from_status", "to_status", "term"]).assign(estimate=theta, se=se)
    gamma, tau = _unpacked(theta, k, t_max, len(initial), len(transition))
    return {"step1": fit, "params": params, "shares": shares, "error": error, "start": total["start"] / total["n"], "moves": total["moves"] / total["n"], "gamma": gamma, "tau": tau, "coefficients": coefficients, "vcov": vcov, "loglik": total["ll"], "n": total["n"], "n_params": len(theta), "cells": len(local) if len(local) <= max_cells else None, "converged": best["converged"], "iterations": best["iterations"], "coding": coding}
