"""Small-model mathematics of the axis engine, in numpy. What grows with the collection stays in Spark; these functions see the moved
items, the pairs, or sums as wide as the embedding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


def quantile(sorted_values: np.ndarray, p: float) -> float:
    """Linear interpolation at p * (n - 1)."""
    return float(np.quantile(sorted_values, min(1.0, max(0.0, p)))) if len(sorted_values) else 0.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-8)


def median_lengthscale(rows: Sequence[Sequence[float]], multiplier: float = 1.0) -> float:
    """The median distance between different rows."""
    x = np.asarray(rows, float)
    if len(x) <= 1:
        return max(0.25, multiplier)
    i, j = np.triu_indices(len(x), 1)
    d2 = ((x[i] - x[j]) ** 2).sum(axis=1)
    d2 = d2[d2 > 1e-8]
    return max(1e-3, multiplier * (float(np.sqrt(np.median(d2))) if len(d2) else 1.0))


@dataclass
class Linear:
    """A direction and a bias with the covariance of both (bias last)."""

    mu: np.ndarray
    b: float
    cov: np.ndarray
    noise: float = 0.0

    def std(self, x: np.ndarray) -> np.ndarray:
        """Predictive deviation of rows."""
        a = np.hstack([x, np.ones((len(x), 1))])
        return np.sqrt(np.maximum(self.noise + np.einsum("ij,jk,ik->i", a, self.cov, a), 1e-8))


def _facing(mu: np.ndarray, b: float, w0: np.ndarray, b0: float) -> tuple[np.ndarray, float]:
    """The posterior never points away from the prior; a vanished one falls back to it."""
    if float(mu @ w0) < 0:
        mu, b = -mu, -b
    return (w0.copy(), b0) if np.linalg.norm(mu) <= 1e-8 else (mu, b)


def fit_gaussian(w0: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, alpha: float = 1.0, sigma2: float = 0.04, beta: float = 1.0, b0: float = 0.0) -> Linear:
    """M2/M3: conjugate regression on (direction, bias): the normal equations of the observed rows are added to the prior precision.
    The sums are as wide as the embedding, so any number of rows can bring them."""
    d = len(w0)
    prior = np.append(np.full(d, alpha), beta)
    start = np.append(w0, b0)
    precision, right = np.diag(prior), prior * start
    if len(x):
        a = np.hstack([x, np.ones((len(x), 1))])
        w = np.maximum(weight, 1e-4) / sigma2
        precision = precision + (a * w[:, None]).T @ a
        right = right + a.T @ (w * y)
    cov = np.linalg.inv(precision)
    m = cov @ right if len(x) else start
    mu, b = _facing(m[:d], float(m[d]), w0, b0)
    return Linear(mu, b, cov, sigma2)


def fit_rank(w0: np.ndarray, diff: np.ndarray, weight: np.ndarray, alpha: float = 1.0, eta: float = 1.0, start: np.ndarray | None = None) -> Linear:
    """M4/M5: logistic preferences over row differences (winner less loser) with a Gaussian prior around w0: Newton steps, halved until
    the convex objective falls; the covariance is that of a Laplace approximation."""
    d = len(w0)
    w = (w0 if start is None else start).astype(float).copy()
    if not len(diff):
        return Linear(w0.copy(), 0.0, _padded(np.eye(d) / alpha))

    def objective(v: np.ndarray) -> float:
        return 0.5 * alpha * float(((v - w0) ** 2).sum()) + float((weight * softplus(-(diff @ v) / eta)).sum())

    for _ in range(40):
        p = sigmoid(diff @ w / eta)
        grad = alpha * (w - w0) - diff.T @ (weight * (1 - p)) / eta
        if np.linalg.norm(grad) <= 1e-7:
            break
        hess = alpha * np.eye(d) + (diff * (weight * p * (1 - p) / eta**2)[:, None]).T @ diff
        step = np.linalg.solve(hess, grad)
        t, now, slope = 1.0, objective(w), float(grad @ step)
        while t > 1e-6 and objective(w - t * step) > now - 1e-4 * t * slope:
            t /= 2
        w = w - t * step
    w, _ = _facing(w, 0.0, w0, 0.0)
    p = sigmoid(diff @ w / eta)
    hess = alpha * np.eye(d) + (diff * np.maximum(weight * p * (1 - p) / eta**2, 1e-8)[:, None]).T @ diff
    return Linear(w, 0.0, _padded(np.linalg.inv(hess)))


def _padded(cov: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cov) + 1, len(cov) + 1))
    out[:-1, :-1] = cov
    return out


@dataclass
class Mixture:
    """M7: a few linear rankers and how their scores are put together (max, mean, softmax, or a gate)."""

    experts: np.ndarray
    how: str = "max"
    gate: np.ndarray | None = None
    gate_bias: np.ndarray | None = None

    def scores(self, x: np.ndarray, smooth: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, expert scores, share of each expert); smooth > 0 takes a soft maximum."""
        s = x @ self.experts.T
        if self.gate is not None:
            g = _softmax(x @ self.gate.T + self.gate_bias)
            return (g * s).sum(axis=1), s, g
        if self.how == "mean" or s.shape[1] == 1:
            return s.mean(axis=1), s, np.full_like(s, 1 / s.shape[1])
        if self.how == "softmax":
            g = _softmax(s)
            return (g * s).sum(axis=1), s, g
        if smooth:
            top = s.max(axis=1, keepdims=True)
            return (top[:, 0] + smooth * np.log(np.exp((s - top) / smooth).sum(axis=1))), s, _softmax(s / smooth)
        return s.max(axis=1), s, (s == s.max(axis=1, keepdims=True)).astype(float)

    def std(self, x: np.ndarray) -> np.ndarray:
        score, s, g = self.scores(x)
        if self.gate is not None:
            return np.sqrt(np.maximum((g * (s - score[:, None]) ** 2).sum(axis=1), 1e-8))
        return s.std(axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: fixed value: how far the further experts lean towards the prior direction
LEAN = 0.15


def _across(rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """rows without their part along the prior."""
    return rows - np.outer(rows @ prior, prior)


def initial_experts(w0: np.ndarray, basis: np.ndarray, k: int) -> np.ndarray:
    """M7: the prior direction, and k - 1 directions of greatest spread across it that lean towards it, to and fro in turn. Where the
    spread has no direction left across the prior, an axis of the space stands in."""
    prior, width = unit(w0), len(w0)
    n = np.arange(k - 1)
    spread = basis[np.minimum(n, len(basis) - 1)] if len(basis) else np.eye(width)[np.minimum(n, width - 1)]
    across = _across(spread, prior)
    flat = np.linalg.norm(across, axis=1) <= 1e-6
    across[flat] = _across(np.eye(width)[np.minimum(n + 1, width - 1)], prior)[flat]
    further = LEAN * prior + np.where(n % 2 == 0, 1.0, -1.0)[:, None] * across / np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-12)
    return np.vstack([prior, *(unit(v)[None] for v in further)])


def fit_mixture(start: Mixture, w0: np.ndarray, x: np.ndarray, winner: np.ndarray, loser: np.ndarray, weight: np.ndarray, labelled: np.ndarray, target: np.ndarray, label_weight: np.ndarray, rate: float = 0.08, steps: int = 48, prior_strength: float = 0.1, l2: float = 1e-3, diversity: float = 0.05, smooth: float = 0.25) -> Mixture:
    """Adam on: mean softplus of the pairs' margins; pull of the first expert to the prior; L2; squared cosines between experts; a
    weak Huber pull of labelled scores to their targets; L2 of the gate. Experts are scaled to length 1 after each step.

    Gradients flow through d score / d expert scores, which for every way of combining is a matrix of shares (plus, for softmax and
    gates, how the shares move).
    """
    w = start.experts.copy()
    gated = start.gate is not None
    gw, gb = (start.gate.copy(), start.gate_bias.copy()) if gated else (None, None)
    k = len(w)
    moments = [np.zeros_like(p) for p in ([w, gw, gb] if gated else [w])]
    squares = [np.zeros_like(m) for m in moments]
    prior = unit(w0)
    for it in range(1, steps + 1):
        now = Mixture(w, start.how, gw, gb)
        score, s, g = now.scores(x, smooth if start.how == "max" and not gated else 0.0)
        ds = np.zeros(len(x))
        if len(winner):
            pull = -weight * sigmoid(-(score[winner] - score[loser])) / len(winner)
            np.add.at(ds, winner, pull)
            np.add.at(ds, loser, -pull)
        if len(labelled):
            gap = score[labelled] - target
            np.add.at(ds, labelled, 0.05 * label_weight * np.clip(gap, -1, 1) / len(labelled))
        share = g
        if gated:
            pass
        elif start.how == "softmax" and k > 1:
            share = g * (1 + s - score[:, None])
        grad = (ds[:, None] * share).T @ x
        grad[0] += 2 * prior_strength * (w[0] - prior)
        grad += 2 * l2 * w
        if k > 1 and diversity:
            length = np.linalg.norm(w, axis=1, keepdims=True)
            n = w / np.maximum(length, 1e-8)
            off = n @ n.T - np.eye(k)
            dn = 4 * off @ n / off.size
            grad += diversity * (dn - (dn * n).sum(axis=1, keepdims=True) * n) / np.maximum(length, 1e-8)
        grads = [grad]
        if gated:
            dlogit = ds[:, None] * g * (s - score[:, None])
            grads += [dlogit.T @ x + 0.02 * gw, dlogit.sum(axis=0) + 0.02 * gb]
        for j, (p, gr) in enumerate(zip([w, gw, gb] if gated else [w], grads, strict=True)):
            moments[j] = 0.9 * moments[j] + 0.1 * gr
            squares[j] = 0.999 * squares[j] + 0.001 * gr**2
            p -= rate * (moments[j] / (1 - 0.9**it)) / (np.sqrt(squares[j] / (1 - 0.999**it)) + 1e-8)
        if w[0] @ prior < 0:
            w[0] *= -1
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-6)
    return Mixture(w, start.how, gw, gb)


def rbf(a: np.ndarray, b: np.ndarray, length: float, amplitude: float) -> np.ndarray:
    d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
    return max(1e-8, amplitude**2) * np.exp(-0.5 * d2 / max(1e-6, length) ** 2)


@dataclass
class Residual:
    """M8: a Gaussian process on what the labels leave of the prior score."""

    support: np.ndarray
    length: float
    amplitude: float
    coefficients: np.ndarray
    root: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    jitter: float = 1e-6

    def correction(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.support, self.length, self.amplitude) @ self.coefficients if len(self.support) else np.zeros(len(x))

    def std(self, x: np.ndarray) -> np.ndarray:
        base = max(1e-8, self.amplitude**2)
        if not len(self.support):
            return np.full(len(x), np.sqrt(base))
        v = np.linalg.solve(self.root, rbf(x, self.support, self.length, self.amplitude).T)
        return np.sqrt(np.maximum(base - (v * v).sum(axis=0), self.jitter))


def fit_residual(support: np.ndarray, residual: np.ndarray, weight: np.ndarray, length: float, amplitude: float = 0.35, sigma: float = 0.08, jitter: float = 1e-6) -> Residual:
    if not len(support):
        return Residual(support, length, amplitude, np.zeros(0), jitter=jitter)
    k = rbf(support, support, length, amplitude) + np.diag(sigma**2 / np.maximum(weight, 1e-3) + jitter)
    root = np.linalg.cholesky(k)
    return Residual(support, length, amplitude, np.linalg.solve(root.T, np.linalg.solve(root, residual)), root, jitter)


#: items up to which a graph model is solved on the driver, from its list of edges; beyond, by tasks (plans/graph.py)
GRAPH_ITEMS = 200_000
#: items up to which prior variances come from a dense inverse, and probes for the estimate beyond
EXACT_ITEMS, PROBES = 3000, 128


@dataclass
class Graph:
    """M6: a Gaussian field on a neighbour graph: precision = smooth * Laplacian + prior. Only products with the precision are
    formed, from the list of edges, and systems are solved by conjugate gradients."""

    n: int
    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    smooth: float = 3.0
    prior: float = 0.05
    jitter: float = 1e-6

    def __post_init__(self) -> None:
        self.degree = np.bincount(self.src, self.w, self.n) + np.bincount(self.dst, self.w, self.n)

    def product(self, v: np.ndarray, extra: np.ndarray | float = 0.0) -> np.ndarray:
        off = np.bincount(self.src, self.w * v[self.dst], self.n) + np.bincount(self.dst, self.w * v[self.src], self.n)
        return self.smooth * (self.degree * v - off) + (self.prior + self.jitter + extra) * v

    def solve(self, right: np.ndarray, extra: np.ndarray | float = 0.0, tolerance: float = 1e-10) -> np.ndarray:
        scale = self.smooth * self.degree + self.prior + self.jitter + extra
        x = np.zeros(self.n)
        r = right.astype(float).copy()
        z = r / scale
        p, rz = z.copy(), float(r @ z)
        for _ in range(10 * int(np.sqrt(self.n)) + 200):
            if np.linalg.norm(r) <= tolerance * max(1e-30, float(np.linalg.norm(right))):
                break
            q = self.product(p, extra)
            a = rz / float(p @ q)
            x += a * p
            r -= a * q
            z = r / scale
            rz, old = float(r @ z), rz
            p = z + (rz / old) * p
        return x

    def variances(self) -> np.ndarray:
        """Prior variance of each item: the diagonal of the inverse precision. Up to EXACT_ITEMS by inversion; beyond, by PROBES random
        signs (Hutchinson's estimate, as v * solve(v) averages to the diagonal), with a fixed seed."""
        if self.n <= EXACT_ITEMS:
            dense = np.diag(self.smooth * self.degree + self.prior + self.jitter)
            np.add.at(dense, (self.src, self.dst), -self.smooth * self.w)
            np.add.at(dense, (self.dst, self.src), -self.smooth * self.w)
            return np.diag(np.linalg.inv(dense)).copy()
        g = np.random.Generator(np.random.PCG64(20260313))
        signs = (g.integers(0, 2, (PROBES, self.n)) * 2 - 1).astype(float)
        return np.maximum(np.mean([v * self.solve(v, tolerance=1e-6) for v in signs], axis=0), 1 / (self.smooth * self.degree.max() + self.prior + self.jitter))

    def mean(self, z0: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, sigma2: float) -> np.ndarray:
        """Means of all items given the observed ones."""
        extra = np.zeros(self.n)
        np.add.at(extra, at, np.maximum(weight, 1e-4) / sigma2)
        right = np.zeros(self.n)
        np.add.at(right, at, np.maximum(weight, 1e-4) / sigma2 * (y - z0[at]))
        return z0 + (self.solve(right, extra) if len(at) else 0.0)

    def posterior(self, z0: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray]:
        """(mean, variance) of all items given the observed ones; of the covariance only the columns of these are formed."""
        mean = self.mean(z0, at, y, weight, sigma2)
        columns = np.array([self.solve(np.eye(1, self.n, int(i))[0]) for i in at]).reshape(len(at), self.n)
        before = self.variances()
        if not len(at):
            return mean, before
        s = columns[:, at] + np.diag(sigma2 / np.maximum(weight, 1e-4))
        reduced = np.einsum("ij,ij->j", columns, np.linalg.solve(s, columns))
        return mean, np.maximum(before - reduced, 1e-8)
