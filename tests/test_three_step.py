"""Three-step chains: derivatives, paths by brute force, closed forms, recovery, partitions, and refusals."""

import itertools

import numpy as np
import pytest
from latticore.functions.special import gradient, hessian
from latticore.operators import threestep as TS
from pyspark.sql import functions as F

ERROR = np.array([[[0.9, 0.2], [0.1, 0.8]], [[0.85, 0.1], [0.15, 0.9]], [[0.8, 0.15], [0.2, 0.85]]])


def known(error):
    return np.stack([np.linalg.inv(d).T for d in error])


def cells(rng, n=40):
    return np.column_stack([rng.integers(0, 2, (n, 3)), rng.normal(size=n), rng.integers(0, 2, n)]).astype(float), rng.integers(1, 5, n).astype(float)


@pytest.mark.parametrize("latent", [True, False])
def test_sums_against_differences(latent):
    rng = np.random.default_rng(1)
    x, w = cells(rng)
    tables = np.log(ERROR) if latent else known(ERROR)
    theta = rng.normal(0, 0.5, 2 + 2 * 2 * 3)
    f = lambda t, a=x, b=w: TS._sums(tables, latent, [1], [0, 1], a, b, t)["ll"]
    s = TS._sums(tables, latent, [1], [0, 1], x, w, theta)
    assert np.allclose(s["g"], gradient(f, theta), atol=1e-5)
    each = np.stack([gradient(lambda t, i=i: f(t, x[i : i + 1], np.ones(1)), theta) for i in range(len(x))])
    assert np.allclose(s["outer"], each.T @ (each * w[:, None]), atol=1e-3)
    if not latent:
        assert np.allclose(s["info"], -hessian(f, theta), atol=1e-2)


def test_weights_of_pairs_are_those_of_all_paths():
    """The likelihood of bch over every path of true statuses, with its product of weights."""
    rng = np.random.default_rng(2)
    x, w = cells(rng)
    theta, tables = rng.normal(0, 0.5, 2 + 2 * 2 * 3), known(ERROR)
    gamma, tau = TS._unpacked(theta, 2, 3, 1, 2)
    want = 0.0
    for row, weight in zip(x, w):
        z = row[3:]
        of = lambda a, d: np.exp(np.append(a @ d, 0)) / np.exp(np.append(a @ d, 0)).sum()
        for path in itertools.product((0, 1), repeat=3):
            own = np.prod([tables[t][int(row[t])][s] for t, s in enumerate(path)])
            ll = np.log(of(gamma, np.array([1, z[1]]))[path[0]]) + sum(np.log(of(tau[t, path[t]], np.array([1, *z]))[path[t + 1]]) for t in range(2))
            want += weight * own * ll
    assert TS._sums(tables, False, [1], [0, 1], x, w, theta)["ll"] == pytest.approx(want)


@pytest.fixture(scope="module")
def panel_rows(spark):
    """12,000 cases, three occasions, four items that tell two statuses apart not too well; moves depend on z; gaps."""
    rng = np.random.default_rng(3)
    n = 12_000
    z = rng.integers(0, 2, n)
    s = (rng.random(n) < 0.4).astype(int)
    rho, answers, states = np.array([[0.8, 0.75, 0.7, 0.8], [0.2, 0.3, 0.25, 0.3]]), [], []
    for t in range(3):
        if t:
            s = np.where(rng.random(n) < np.where(z == 1, 0.35, 0.1), 1 - s, s)
        y = (rng.random((n, 4)) < rho[s]).astype(float)
        y[rng.random((n, 4)) < 0.05] = np.nan
        answers.append(y)
        states.append(s)
    x = np.concatenate(answers, axis=1)
    x[:40, 4:8] = np.nan  # an occasion without answers
    x[40:50] = np.nan  # no answers at all
    rows = [[None if np.isnan(v) else int(v) for v in r] + [float(k)] for r, k in zip(x, z)]
    df = spark.createDataFrame(rows, ", ".join([*(f"`i{j}@{t}` int" for t in range(3) for j in range(4)), "z double"])).cache()
    return df, np.stack(states, axis=1), z


ITEMS, TIMES = [f"i{j}" for j in range(4)], [0, 1, 2]
STEP1 = (np.array([[0.6, 0.4]] * 3), [{"p": np.array([[0.8, 0.75, 0.7, 0.8], [0.2, 0.3, 0.25, 0.3]])}])


def test_moves_are_recovered(panel_rows):
    df, states, z = panel_rows
    truth = [[np.mean(states[(z == h) & (states[:, 0] == a), 1] != a) for a in (0, 1)] for h in (0, 1)]
    leave, n = {}, {}
    for correction in ("ml", "bch", "none"):
        r = TS.fit_three_step_lta(df, ITEMS, TIMES, 2, transition=["z"], correction=correction, n_init=3)
        flip = r["params"][0]["p"][0, 0] < 0.5
        moves = [[np.exp(np.append(r["tau"][0, a] @ [1, h], 0)) for a in (0, 1)] for h in (0, 1)]
        off = [[1 - m[a] / m.sum() for a, m in enumerate(row)] for row in moves]
        leave[correction], n[correction] = np.array([row[::-1] if flip else row for row in off]), r["n"]
        assert r["converged"] and np.isfinite(r["coefficients"]["se"]).all() and len(r["coefficients"]) == 1 + 2 * 2 * 2
    assert set(n.values()) == {11_990.0}
    assert leave["ml"] == pytest.approx(np.array(truth), abs=0.05) and leave["bch"] == pytest.approx(np.array(truth), abs=0.05)
    assert np.abs(leave["none"] - truth).max() > 2 * np.abs(leave["ml"] - truth).max()  # what the corrections are for


def test_partitions_give_what_arrays_give(panel_rows):
    df, _, _ = panel_rows
    for correction in ("ml", "bch"):
        a, b = (TS.fit_three_step_lta(df, ITEMS, TIMES, 2, initial=["z"], correction=correction, step1=STEP1, max_cells=m, max_iter=25) for m in (100_000, 1))
        assert a["loglik"] == pytest.approx(b["loglik"], rel=1e-10) and a["coefficients"]["estimate"].to_numpy() == pytest.approx(b["coefficients"]["estimate"].to_numpy(), abs=1e-6)
        assert a["cells"] == 16 and b["cells"] is None


def test_proportional_paths_by_brute_force(panel_rows):
    df, _, _ = panel_rows
    scored = TS.assign(TS.panel.drop_empty(df, [c for c in df.columns if "@" in c]).withColumn("_in", F.lit(2.0)), TS.J._spec(ITEMS, "binary", 2, 1.0), TIMES, *STEP1).cache()
    got = {tuple(r)[:4]: r["_w"] for r in TS.path_cells(scored, 2, 3, ["z"], "proportional", "_in").collect()}
    want: dict = {}
    for r in scored.collect():
        for path in itertools.product((0, 1), repeat=3):
            key = (*path, r["z"])
            want[key] = want.get(key, 0.0) + 2.0 * r["_p0"][path[0]] * r["_p1"][path[1]] * r["_p2"][path[2]]
    assert got == pytest.approx(want)
    assert scored.where("`i0@1` is null and `i1@1` is null and `i2@1` is null and `i3@1` is null").select("_p1").first()[0] == [0.6, 0.4]
    r = TS.fit_three_step_lta(df, ITEMS, TIMES, 2, assignment="proportional", step1=STEP1)
    modal = TS.fit_three_step_lta(df, ITEMS, TIMES, 2, step1=STEP1)
    assert r["moves"] == pytest.approx(modal["moves"], abs=0.05) and r["coefficients"]["se"].isna().all()


def test_weights_are_copies_and_codes_do_not_matter(panel_rows):
    df, _, _ = panel_rows
    some = df.limit(1500).withColumn("times", (F.col("z") + 1)).cache()
    copied = some.union(some.where("z = 1"))
    recoded = some.select(*((F.col(f"`{c}`") + 1).alias(c) if "@" in c else F.col(c) for c in some.columns))
    a = TS.fit_three_step_lta(some, ITEMS, TIMES, 2, weight="times", step1=STEP1)
    for other in (TS.fit_three_step_lta(copied, ITEMS, TIMES, 2, step1=STEP1), TS.fit_three_step_lta(recoded, ITEMS, TIMES, 2, weight="times", step1=STEP1)):
        assert a["loglik"] == pytest.approx(other["loglik"], rel=1e-9) and a["moves"] == pytest.approx(other["moves"], abs=1e-5)


def test_refusals(spark, panel_rows):
    df, _, _ = panel_rows
    with pytest.raises(ValueError, match="bch takes modal"):
        TS.fit_three_step_lta(df, ITEMS, TIMES, 2, correction="bch", assignment="proportional")
    with pytest.raises(ValueError, match="paths of statuses"):
        TS.fit_three_step_lta(df, ITEMS, TIMES, 2, assignment="proportional", max_paths=7)
    with pytest.raises(ValueError, match="correction is"):
        TS.fit_three_step_lta(df, ITEMS, TIMES, 2, correction="BLAH")
    with pytest.raises(ValueError, match="no inner maximum"):  # nobody moves, but the tables say that some should seem to
        TS.fit_three_step_lta(df.select(*(F.col(f"`i{j}@0`").alias(f"i{j}@{t}") for t in TIMES for j in range(4))), ITEMS, TIMES, 2, correction="bch", step1=STEP1)
