"""Analytic scores and Hessians of mixtures and chains, as sums over rows.

A row's score is the posterior's mean of the complete data's score (Fisher's identity); its Hessian is the mean of the complete data's
Hessian plus the variance of the complete data's score (Louis' identity).  A chain's complete score is a sum over occasions, and its variance
is gathered in one forward sweep over the posterior chain.  All of it adds up over rows, so it runs over arrays or partitions alike.
"""

from __future__ import annotations

import numpy as np

from latticore.functions.special import gradient, logsumexp
from latticore.operators import emissions as E

#: Rows of a table that one sweep handles.
SWEEP = 4096


def family_scores(e: E.Emission, x: np.ndarray, p: dict, r: np.ndarray) -> np.ndarray:
    """Rows by free parameters: the posterior times the derivative of the class's log-density."""
    seen = ~np.isnan(x)
    z = np.where(seen, x, 0.0)
    if type(e) is E.Bernoulli:
        return (r[:, :, None] * np.where(seen[:, None, :], z[:, None, :] - p["p"][None], 0.0)).reshape(len(x), -1)
    if type(e) is E.Poisson:
        return (r[:, :, None] * np.where(seen[:, None, :], z[:, None, :] - p["rate"][None], 0.0)).reshape(len(x), -1)
    if type(e) is E.Categorical:
        return np.concatenate([r[:, k : k + 1] * np.where(seen[:, j : j + 1], (z[:, j : j + 1] == np.arange(1, c)) - p["p"][k, j, : c - 1], 0.0) for k in range(e.k) for j, c in enumerate(e.cats)], axis=1)
    if type(e) is E.Gaussian:
        off = np.where(seen[:, None, :], z[:, None, :] - p["mean"][None], 0.0)
        mean = (r[:, :, None] * off / p["var"][None]).reshape(len(x), -1)
        if e.kind == "unit":
            return mean
        spread = r[:, :, None] * np.where(seen[:, None, :], 0.5 * (off**2 / p["var"][None] - 1), 0.0)
        return np.concatenate([mean, spread.sum(axis=1) if e.kind == "equal" else spread.reshape(len(x), -1)], axis=1)
    return gradient(lambda t: (r * e.loglik(x, e.fixed(t, p))).sum(axis=1), e.free(p))


def _softmax_curvature(p: np.ndarray, n: float) -> np.ndarray:
    """Of n * log p by the free logits (all but the last, which is the reference)."""
    q = p[:-1]
    return -n * (np.diag(q) - np.outer(q, q))


def family_curvature(e: E.Emission, x: np.ndarray, p: dict, r: np.ndarray) -> np.ndarray:
    """Free parameters squared: the sum over rows of r times the second derivatives of the classes' log-densities."""
    seen = ~np.isnan(x)
    n = r.T @ seen  # classes x items
    if type(e) is E.Bernoulli:
        return np.diag((-n * p["p"] * (1 - p["p"])).ravel())
    if type(e) is E.Poisson:
        return np.diag((-n * p["rate"]).ravel())
    if type(e) is E.Categorical:
        return _blocks([_softmax_curvature(p["p"][k, j, :c], n[k, j]) for k in range(e.k) for j, c in enumerate(e.cats)])
    if type(e) is E.Gaussian:
        off = np.where(seen[:, None, :], np.where(seen, x, 0.0)[:, None, :] - p["mean"][None], 0.0)
        cross, square = -np.einsum("nk,nkj->kj", r, off) / p["var"], -0.5 * np.einsum("nk,nkj->kj", r, off**2) / p["var"]
        size, items = n.size, n.shape[1]
        if e.kind == "unit":
            return np.diag((-n / p["var"]).ravel())
        own = np.tile(np.arange(items), e.k) if e.kind == "equal" else np.arange(size)
        out = np.zeros((size + own.max(initial=-1) + 1,) * 2)
        at = np.arange(size)
        out[at, at] = (-n / p["var"]).ravel()
        out[at, size + own] = out[size + own, at] = cross.ravel()
        np.add.at(out, (size + own, size + own), square.ravel())
        return out
    h = gradient(lambda t: family_scores(e, x, e.fixed(t, p), r).sum(axis=0), e.free(p), 1e-5)
    return (h + h.T) / 2


def family_prior(e: E.Emission, p: dict, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the family's log-prior by its free parameters."""
    a = e.alpha / e.k
    if type(e) is E.Bernoulli:
        return (a * (m["mean"] - p["p"])).ravel(), np.diag((-a * p["p"] * (1 - p["p"])).ravel())
    if type(e) is E.Poisson:
        pull = a / np.maximum(m["mean"], 1e-10) * p["rate"]
        return (a - pull).ravel(), np.diag(-pull.ravel())
    if type(e) is E.Categorical:
        of = [(p["p"][k, j, :c], m["share"][j, :c]) for k in range(e.k) for j, c in enumerate(e.cats)]
        return np.concatenate([a * (s - s.sum() * q)[:-1] for q, s in of]), _blocks([_softmax_curvature(q, a * s.sum()) for q, s in of])
    if type(e) is E.Gaussian:
        zero = np.zeros(p["mean"].size)
        if e.kind == "unit":
            return zero, np.diag(zero)
        g, h = -0.5 * a * (1 - m["var"] / p["var"]), -0.5 * a * m["var"] / p["var"]
        g, h = (g.sum(axis=0), h.sum(axis=0)) if e.kind == "equal" else (g.ravel(), h.ravel())
        return np.concatenate([zero, g]), np.diag(np.concatenate([zero, h]))
    prior = lambda t: e.log_prior(e.fixed(t, p), m)
    return gradient(prior, e.free(p)), gradient(lambda t: gradient(prior, t), e.free(p), 1e-4)


def _blocks(parts: list[np.ndarray]) -> np.ndarray:
    out, at = np.zeros((sum(len(p) for p in parts),) * 2), 0
    for p in parts:
        out[at : at + len(p), at : at + len(p)] = p
        at += len(p)
    return out


def state_scores(emissions: list, blocks: list[np.ndarray], params: list[dict], k: int) -> np.ndarray:
    """Rows x states x free measurement parameters: the derivative of each state's log-density."""
    n, out = len(blocks[0]), []
    for s in range(k):
        one = np.zeros((n, k))
        one[:, s] = 1.0
        out.append(np.concatenate([family_scores(e, b, p, one) for e, b, p in zip(emissions, blocks, params)], axis=1))
    return np.stack(out, axis=1)


def added(a: dict | None, b: dict) -> dict:
    return b if a is None else {k: a[k] + b[k] for k in b}


def in_sweeps(sums, x: np.ndarray, w: np.ndarray) -> dict:
    """sums(x, w) of a table, a sweep of its rows at a time."""
    total = None
    for a in range(0, max(len(x), 1), SWEEP):
        total = added(total, sums(x[a : a + SWEEP], w[a : a + SWEEP]))
    return total


# ---------------------------------------------------------------- mixtures


def mixture_sums(spec, pi: np.ndarray, params: list[dict], x: np.ndarray, w: np.ndarray) -> dict:
    """ll, g, outer (scores squared) and h of a mixture over rows, by its free parameters."""

    def sums(x, w):
        emissions, blocks = spec.emissions(), spec.split(x)
        joint = np.log(pi + E.EPS)[None, :] + sum(e.loglik(b, p) for e, b, p in zip(emissions, blocks, params)) + np.zeros((len(x), 1))
        ll = logsumexp(joint)
        r = np.exp(joint - ll[:, None])
        own = np.concatenate([np.broadcast_to((np.eye(spec.k) - pi)[:, :-1], (len(x), spec.k, spec.k - 1)), state_scores(emissions, blocks, params, spec.k)], axis=2)
        mean, rw = np.einsum("nk,nkp->np", r, own), r * w[:, None]
        outer = mean.T @ (mean * w[:, None])
        curve = _blocks([_softmax_curvature(pi, w.sum()), *(family_curvature(e, b, p, rw) for e, b, p in zip(emissions, blocks, params))])
        return {"ll": float(w @ ll), "g": w @ mean, "outer": outer, "h": curve + np.einsum("nk,nkp,nkq->pq", rw, own, own, optimize=True) - outer}

    return in_sweeps(sums, x, w)


# ---------------------------------------------------------------- chains


class Packing:
    """A chain's free parameters: log-odds of the start and of each move against the last allowed status, then the measurement's.

    Moves that are exactly 0 are forbidden and have no parameter.  Measurement is that of all occasions where theirs is the
    same, else of each; with `same_moves` all occasions move alike.
    """

    def __init__(self, chain, same_moves: bool = False):
        self.chain, self.same = chain, same_moves and len(chain.moves) > 1
        self.k, self.t = chain.spec.k, len(chain.times)
        self.equal = all(np.array_equal(q[n], v) for p in chain.params for q, first in zip(p, chain.params[0]) for n, v in first.items())
        self.emissions = chain.spec.emissions()
        rows = [("start", None, chain.start)] + [(t, a, chain.moves[t, a]) for t in range(1 if self.same else len(chain.moves)) for a in range(self.k)]
        self.rows, at = [], 0
        for t, a, p in rows:
            states = np.flatnonzero(p > 0)
            self.rows.append((t, a, states, at))
            at += len(states) - 1
        self.measured = [at]
        for p in chain.params[: 1 if self.equal else self.t]:
            self.measured.append(self.measured[-1] + sum(len(e.free(q)) for e, q in zip(self.emissions, p)))
        self.size = self.measured[-1]

    def free(self) -> np.ndarray:
        c, out = self.chain, np.zeros(self.size)
        for t, a, states, at in self.rows:
            p = (c.start if a is None else c.moves[t, a])[states]
            out[at : at + len(p) - 1] = np.log(p[:-1]) - np.log(p[-1])
        for i, p in enumerate(c.params[: len(self.measured) - 1]):
            out[self.measured[i] : self.measured[i + 1]] = np.concatenate([e.free(q) for e, q in zip(self.emissions, p)])
        return out

    def at(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """Start, moves and parameters of each occasion."""
        c = self.chain
        start, moves = np.zeros(self.k), np.zeros_like(c.moves)
        for t, a, states, at in self.rows:
            e = np.exp(np.clip(np.append(theta[at : at + len(states) - 1], 0.0), -35, 35))
            if a is None:
                start[states] = e / e.sum()
            else:
                moves[slice(None) if self.same else t, a, states] = (e / e.sum()) if not self.same else (e / e.sum())[None, :]
        params = []
        for i, old in enumerate(c.params[: len(self.measured) - 1]):
            own, a = [], self.measured[i]
            for e, q in zip(self.emissions, old):
                n = len(e.free(q))
                own.append(e.fixed(theta[a : a + n], q))
                a += n
            params.append(own)
        return start, moves, params * self.t if self.equal else params

    def path_scores(self, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a start (K x P) and of moves (T - 1 x K x K x P), without the measurement's."""
        first, onward = np.zeros((self.k, self.size)), np.zeros((*moves.shape, self.size))
        for t, a, states, at in self.rows:
            p = (start if a is None else moves[t, a])[states]
            own = (np.eye(len(states)) - p)[:, :-1]
            if a is None:
                first[states, at : at + len(states) - 1] = own
            else:
                for u in range(len(moves)) if self.same else [t]:
                    onward[u, a, states, at : at + len(states) - 1] = own
        return first, onward

    def prior(self, theta: np.ndarray, alpha: float, m: list[list[dict]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-prior with its first and second derivatives."""
        start, moves, params = self.at(theta)
        value, g, h = 0.0, np.zeros(self.size), np.zeros((self.size, self.size))
        for t, a, states, at in self.rows:
            p = (start if a is None else moves[t, a])[states]
            c = alpha / self.k if a is None else alpha / (self.k * len(states))
            value += c * float(np.log(p + E.EPS).sum())
            own = slice(at, at + len(states) - 1)
            g[own] = c * (1 - len(states) * p)[:-1]
            h[own, own] = _softmax_curvature(p, c * len(states))
        for i, p in enumerate(params[: len(self.measured) - 1]):
            own = slice(self.measured[i], self.measured[i + 1])
            parts = [family_prior(e, q, mm) for e, q, mm in zip(self.emissions, p, m[i])]
            value += sum(e.log_prior(q, mm) for e, q, mm in zip(self.emissions, p, m[i]))
            g[own], h[own, own] = np.concatenate([d for d, _ in parts]), _blocks([d for _, d in parts])
        return value, g, h

    def sums(self, x: np.ndarray, w: np.ndarray, theta: np.ndarray) -> dict:
        """ll, g, outer (scores squared) and h over rows of item@time columns in order of occasions."""
        state = self.at(theta)
        return in_sweeps(lambda x, w: self._sweep(x, w, *state), x, w)

    def _sweep(self, x, w, start, moves, params) -> dict:
        from latticore.operators import transition as T

        spec, k = self.chain.spec, self.k
        j = len(spec.items)
        ll, gamma, xi = T.forward_backward(T._emissions(spec, params, x, self.t), start, moves)
        first, onward = self.path_scores(start, moves)
        blocks = [spec.split(x[:, t * j : (t + 1) * j]) for t in range(self.t)]
        square, curve = np.zeros((self.size,) * 2), np.zeros((self.size,) * 2)
        gw = gamma * w[:, None, None]
        for t, a, states, at in self.rows:
            own = slice(at, at + len(states) - 1)
            for u in range(len(moves)) if self.same and a is not None else [t]:
                curve[own, own] += _softmax_curvature((start if a is None else moves[u, a])[states], w.sum() if a is None else gw[:, u, a].sum())
        # the posterior is a chain too: `past` is the mean of the scores so far where a path is in each status
        past = None
        for t in range(self.t):
            where = self.measured[0 if self.equal else t], self.measured[1 if self.equal else t + 1]
            own = np.zeros((len(x), k, self.size))
            own[:, :, where[0] : where[1]] = state_scores(self.emissions, blocks[t], params[t], k)
            curve[where[0] : where[1], where[0] : where[1]] += _blocks([family_curvature(e, b, p, gw[:, t]) for e, b, p in zip(self.emissions, blocks[t], params[t])])
            if t == 0:
                own = own + first
                past = gamma[:, 0, :, None] * own
                square += np.einsum("nk,nkp,nkq->pq", gw[:, 0], own, own, optimize=True)
                continue
            step = xi[:, t - 1] / np.maximum(gamma[:, t - 1, :, None], 1e-300)
            before = np.einsum("nab,nap->nbp", step, past, optimize=True)
            xw = xi[:, t - 1] * w[:, None, None]
            move = onward[t - 1]
            square += np.einsum("ab,abp,abq->pq", xw.sum(axis=0), move, move, optimize=True) + np.einsum("nk,nkp,nkq->pq", gw[:, t], own, own, optimize=True)
            mixed = np.einsum("abp,abq->pq", move, np.einsum("nab,nbq->abq", xw, own, optimize=True))
            mixed += np.einsum("abp,abq->pq", np.einsum("n,nab,nap->abp", w, step, past, optimize=True), move) + np.einsum("n,nkp,nkq->pq", w, before, own, optimize=True)
            square += mixed + mixed.T
            past = before + np.einsum("nab,abp->nbp", xi[:, t - 1], move, optimize=True) + gamma[:, t, :, None] * own
        mean = past.sum(axis=1)
        outer = mean.T @ (mean * w[:, None])
        return {"ll": float(w @ ll), "g": w @ mean, "outer": outer, "h": curve + square - outer}
