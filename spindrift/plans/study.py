"""The evaluation study: baselines on labelled rows, refinement loops, sweeps. Tasks and settings are rows; a cell of the grid runs
where Spark puts it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics, ranks, similarity
from ..session import stored
from ..workers import shipped
from . import models


def ridge(x: np.ndarray, y: np.ndarray, lam: float = 1.0) -> tuple[np.ndarray, float]:
    """Dual ridge without intercept; the bias is the mean residual."""
    if not len(x):
        return np.zeros(x.shape[1]), 0.5
    w = x.T @ np.linalg.solve(x @ x.T + lam * np.eye(len(x)), y)
    return w, float((y - x @ w).mean())


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares with intercept, minimum norm."""
    a = np.hstack([x, np.ones((len(x), 1))])
    m = np.linalg.lstsq(a, y, rcond=None)[0]
    return m[:-1], float(m[-1])


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Evidence maximisation of noise and weight precision."""
    mx, my = x.mean(axis=0), float(y.mean())
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    t = u.T @ (y - my)
    noise, weight = 1 / max(float(y.var()), 1e-6), 1.0
    for _ in range(rounds):
        c = s * noise / (noise * s**2 + weight) * t
        gamma = float((noise * s**2 / (noise * s**2 + weight)).sum())
        rest = float(((y - my - u @ (s * c)) ** 2).sum())
        weight, noise = (gamma + 2e-6) / (float(c @ c) + 2e-6), (len(y) - gamma + 2e-6) / (rest + 2e-6)
    w = vt.T @ (s * noise / (noise * s**2 + weight) * t)
    return w, my - float(mx @ w)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.01, ratio: float = 0.5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Coordinate descent."""
    mx, my = x.mean(axis=0), float(y.mean())
    z, w, n = x - mx, np.zeros(x.shape[1]), len(y)
    r, square = y - my, ((x - mx) ** 2).sum(axis=0) / max(1, len(y))
    for _ in range(rounds):
        for j in range(len(w)):
            if square[j] > 0:
                rho = float(z[:, j] @ r) / n + square[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (square[j] + alpha * (1 - ratio))
                r += z[:, j] * (w[j] - new)
                w[j] = new
    return w, my - float(mx @ w)


def pcr(x: np.ndarray, y: np.ndarray, k: int = 8, lam: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge on the leading principal components."""
    mx = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mx, full_matrices=False)
    v = vt[:k].T
    z = (x - mx) @ v
    w = v @ np.linalg.solve(z.T @ z + lam * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return w, float(y.mean() - mx @ w)


def linear_svr(x: np.ndarray, y: np.ndarray, c: float = 1.0, eps: float = 0.05, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Epsilon-insensitive loss by averaged subgradient steps."""
    w, b = np.zeros(x.shape[1]), float(y.mean())
    aw, ab = w.copy(), b
    for t in range(1, rounds + 1):
        e = y - x @ w - b
        g = np.where(np.abs(e) > eps, np.sign(e), 0.0)
        step = 1 / (1 + t) ** 0.6
        w = w - step * (w / (c * len(y)) - x.T @ g / len(y))
        b += step * float(g.mean())
        aw, ab = aw + (w - aw) / t, ab + (b - ab) / t
    return aw, ab


def kernel_ridge(x: np.ndarray, y: np.ndarray, lam: float = 0.1) -> Callable[[np.ndarray], np.ndarray]:
    """On an RBF kernel of median length."""
    length = models.median_lengthscale(x)
    m = float(y.mean())
    a = np.linalg.solve(models.rbf(x, x, length, 1.0) + lam * np.eye(len(x)), y - m)
    return lambda z: m + models.rbf(z, x, length, 1.0) @ a


def rank_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Squared hinge on the differences of ordered pairs."""
    i, j = np.nonzero(y[:, None] - y[None] > 1e-9)
    if not len(i):
        return np.zeros(x.shape[1])
    d = x[i] - x[j]
    w = np.zeros(x.shape[1])
    top = 1 + 2 * c * float(np.linalg.norm(d, 2) ** 2) / len(d)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - d @ w)
        w -= (w - 2 * c * d.T @ slack / len(d)) / top
    return w


def prior_affine(s0: np.ndarray, y: np.ndarray, lam: float = 0.1) -> tuple[float, float]:
    """Slope and shift of the prior score, by ridge on the slope."""
    m, t = float(s0.mean()), float(y.mean())
    a = float(((s0 - m) * (y - t)).sum() / (((s0 - m) ** 2).sum() + lam))
    return a, t - a * m


def centred_ridge(x: np.ndarray, y: np.ndarray, w0: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """Ridge towards the prior direction."""
    return w0 + x.T @ np.linalg.solve(x @ x.T + lam * np.eye(len(x)), y - x @ w0)


LAMBDAS, BLENDS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0), tuple(i / 7 for i in range(8))


def calibrated_residual(x: np.ndarray, y: np.ndarray, s0: np.ndarray) -> tuple[float, float, float]:
    """(lambda, blend, error) by leaving one out: the prior's affine fit plus a share of a ridge on its residual. A larger
    share must beat having none by 0.01 of the error."""
    a, b = prior_affine(s0, y)
    rest = y - (a * s0 + b)
    base = float(np.abs(rest).mean())
    best = (LAMBDAS[-1], 0.0, base)
    for lam in LAMBDAS:
        g = x @ x.T
        h = g @ np.linalg.inv(g + lam * np.eye(len(x)))
        held_out = rest - (rest - h @ rest) / np.maximum(1 - np.diag(h), 1e-6)
        for beta in BLENDS:
            err = float(np.abs(rest - beta * held_out).mean())
            if err < best[2] - (0.01 * base if best[1] == 0 else 0):
                best = (lam, beta, err)
    return best


#: Baselines by name: (x, y) of the labelled rows to scores of any rows
BASELINES: dict[str, Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]] = {
    "label_mean": lambda x, y: lambda z: np.full(len(z), y.mean()),
    "ridge": lambda x, y: _line(ridge(x, y)),
    "ols": lambda x, y: _line(ols(x, y)),
    "bayesian_ridge": lambda x, y: _line(bayesian_ridge(x, y)),
    "elastic_net": lambda x, y: _line(elastic_net(x, y)),
    "pcr_ridge": lambda x, y: _line(pcr(x, y)),
    "linear_svr": lambda x, y: _line(linear_svr(x, y)),
    "kernel_ridge": lambda x, y: kernel_ridge(x, y),
    "rank_svm": lambda x, y: _line((rank_svm(x, y), 0.0)),
}


def _line(m: tuple[np.ndarray, float]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda z: z @ m[0] + m[1]


def score_baseline(items: DataFrame, key: str, vector: str, labelled: DataFrame, method: str, limit: int = 10_000) -> DataFrame:
    """(key, score): a baseline fitted on the labelled rows (key, y), at most `limit` of them, applied to all items in
    Arrow batches. Fewer than two labels score 0.5."""
    rows = items.join(labelled, key).select(key, F.col(vector).cast("array<double>").alias("v"), F.col("y").cast("double").alias("y")).orderBy(key).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    x, y = np.array([r["v"] for r in rows]), np.array([r["y"] for r in rows])
    predict = BASELINES[method](x, y) if len(rows) > 1 else lambda z: np.full(len(z), 0.5)

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "score": predict(np.stack(b["v"].to_numpy()).astype(float))})

    return shipped(items).select(key, F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, score double")


def knn_propagation(items: DataFrame, key: str, vector: str, labelled: DataFrame, k: int = 15, temperature: float = 12.0) -> DataFrame:
    """Mean of the k nearest labels, weighted by softmax(temperature * similarity)."""
    near = similarity.knn(items, items.join(labelled.select(key), key, "left_semi"), key, vector, k, skip_self=False)
    w = F.exp(F.lit(temperature) * (F.col("sim") - 1))
    j = near.join(labelled.select(F.col(key).alias("dst"), F.col("y").cast("double").alias("y")), "dst")
    return j.groupBy(F.col("src").alias(key)).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("score"))


@dataclass(frozen=True)
class Setting:
    alpha: float = 1.0
    sigma2: float = 0.04
    beta: float = 1.0
    policy: str = "random"
    replicate: int = 0


BUDGETS = (0, 1, 3, 5, 10, 20)


@dataclass(frozen=True)
class Step:
    """What is measured at a budget: over all items, and over those that aren't undefined."""

    budget: int
    numeric: int
    undefined: int
    spearman: float
    auroc: float
    spearman_defined: float
    auroc_defined: float


def loop(x: np.ndarray, ref: np.ndarray, w0: np.ndarray, ids: Sequence, s: Setting, budgets: Sequence[int] = BUDGETS, undefined: np.ndarray | None = None, allowed: bool = True) -> list[Step]:
    """E5: select, observe, refit on one task's items; a step at each budget. Deterministic: the random policy goes by CRC of setting
    and id.

    undefined: the items that the axis says nothing about. Where such an answer is `allowed`, it uses up a query but gives the fit no
    target; else the item is answered with its reference like any other.
    """
    from zlib import crc32

    cosine = lambda w: x @ w / np.maximum(np.linalg.norm(x, axis=1) * max(1e-8, np.linalg.norm(w)), 1e-8)
    void = np.zeros(len(x), bool) if undefined is None else undefined
    order = np.sort(cosine(w0))
    queried: list[int] = []
    out = []
    fit = models.fit_gaussian(w0, x[:0], np.zeros(0), np.zeros(0), s.alpha, s.sigma2, s.beta)
    for step in range(max(budgets) + 1):
        if step in budgets:
            z = cosine(fit.mu) + fit.b
            numeric = sum(not (allowed and void[i]) for i in queried)
            out.append(Step(step, numeric, len(queried) - numeric, _spearman(z, ref), _auroc(z, ref), _spearman(z[~void], ref[~void]), _auroc(z[~void], ref[~void])))
        rest = np.setdiff1d(np.arange(len(x)), queried).tolist()
        if not rest:
            break
        if step == max(budgets):
            continue
        if s.policy == "random":
            pick = min(rest, key=lambda i: crc32(f"{s.replicate}||{step}||{ids[i]}".encode()))
        else:
            u = fit.std(x)
            unitx = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
            nov = 1 - (unitx @ unitx[queried].T).max(axis=1) if queried else np.ones(len(x))
            scaled = lambda v: (v - v[rest].min()) / max(1e-12, v[rest].max() - v[rest].min())
            value = {"uncertainty": u, "diversity": nov}.get(s.policy, scaled(u) * (0.5 + scaled(nov)))
            pick = max(rest, key=lambda i: (value[i], -i))
        queried.append(pick)
        told = [i for i in queried if not (allowed and void[i])]
        y = np.array([models.quantile(order, float(ref[i])) for i in told])
        fit = models.fit_gaussian(w0, x[told], y, np.ones(len(told)), s.alpha, s.sigma2, s.beta)
    return out


def _ranks(v: np.ndarray) -> np.ndarray:
    _, inv, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inv]


def _spearman(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2:
        return 0.0
    p, q = _ranks(a), _ranks(b)
    return float(np.corrcoef(p, q)[0, 1]) if p.std() > 0 and q.std() > 0 else 0.0


def _auroc(score: np.ndarray, ref: np.ndarray) -> float:
    pos = ref > 0.5
    if not set(np.unique(ref)) <= {0.0, 1.0} or pos.all() or not pos.any():
        return float("nan")
    n, m = int(pos.sum()), int((~pos).sum())
    return float((_ranks(score)[pos].sum() - n * (n + 1) / 2) / (n * m))


#: items that a task of the refinement study may have: its loop runs in one Python task
TASK_ITEMS = 200_000


def _tasks(d: DataFrame, by: str) -> DataFrame:
    if d.groupBy(by).count().where(F.col("count") > TASK_ITEMS).limit(1).count():
        raise ValueError(f"tasks hold {TASK_ITEMS} items at most")
    return shipped(d)


def _given(v: float) -> float | None:
    return None if v != v else v


def sweep(items: DataFrame, key: str, vector: str, ref: str, by: str, w0: Sequence[float], settings: Sequence[Setting], undefined: str | None = None) -> DataFrame:
    """The refinement loop for every task (group of `by`) and setting, as one grouped job, over all items of a task. A
    task of more than TASK_ITEMS is refused. With `undefined`, a boolean column, each setting runs with and without such answers
    (column allowed), as Step says."""
    void = F.coalesce(F.col(undefined), F.lit(False)) if undefined else F.lit(False)
    d = items.select(by, key, vector, F.col(ref).cast("double").alias("ref"), void.alias("void"))
    grid = items.sparkSession.createDataFrame([(i, s.alpha, s.sigma2, s.beta, s.policy, s.replicate, a) for i, s in enumerate(settings) for a in ((False, True) if undefined else (True,))], "setting int, alpha double, sigma2 double, beta double, policy string, replicate int, allowed boolean")
    w = np.array(w0, float)
    columns = [by, "setting", "allowed", *Step.__dataclass_fields__]

    def cell(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, ignore_index=True)
        s = Setting(*(g[c].iloc[0] for c in ("alpha", "sigma2", "beta", "policy")), int(g["replicate"].iloc[0]))
        allowed = bool(g["allowed"].iloc[0])
        steps = loop(np.stack(g[vector].to_numpy()).astype(float), g["ref"].to_numpy(), w, g[key].tolist(), s, undefined=g["void"].to_numpy(bool), allowed=allowed)
        return pd.DataFrame([(g[by].iloc[0], int(g["setting"].iloc[0]), allowed, *map(_given, x.__dict__.values())) for x in steps], columns=columns)

    kind = items.schema[by].dataType.simpleString()
    measured = "budget int, numeric int, undefined int, spearman double, auroc double, spearman_defined double, auroc_defined double"
    return _tasks(d, by).crossJoin(F.broadcast(grid)).groupBy(by, "setting", "allowed").applyInPandas(cell, f"{by} {kind}, setting int, allowed boolean, {measured}")


def zscore(v: np.ndarray) -> np.ndarray:
    return (v - v.mean()) / v.std() if v.std() > 1e-12 else np.zeros(len(v))


def centred_scores(x: np.ndarray, y: np.ndarray, told: Sequence[int], w0: np.ndarray, lam: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and direction after the `told` items: items and targets less their means give a ridge towards the prior, whose
    z-scores are blended with the prior's. Fewer than two different targets leave the prior as it is."""
    s0 = x @ w0
    if len(np.unique(y[told])) < 2:
        return s0, w0
    c = x - x.mean(axis=0)
    w = centred_ridge(c[told], y[told] - y[told].mean(), w0, lam)
    return (1 - share) * zscore(s0) + share * zscore(c @ w), w


def centred_sweep(items: DataFrame, key: str, vector: str, ref: str, by: str, priors: dict[str, Sequence[float]], lambdas: Sequence[float], shares: Sequence[float], replicates: int, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """M23, centred and by prompts: every task, variant of the prior (name to direction) and replicate is a cell of one grouped job; a
    row for each lambda, share and budget. Items are told in order of their CRC, the same for all variants."""
    from zlib import crc32

    d = items.select(by, key, vector, F.col(ref).cast("double").alias("ref"))
    grid = items.sparkSession.createDataFrame([(v, r) for v in priors for r in range(replicates)], "variant string, replicate int")
    directions = {v: np.array(w, float) for v, w in priors.items()}
    measures = ("prior_spearman", "preservation", "direction_cosine", "direction_change", "spearman")
    columns = [by, "variant", "replicate", "lambda", "share", "budget", *measures]

    def cell(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, ignore_index=True)
        task, variant, replicate = g[by].iloc[0], g["variant"].iloc[0], int(g["replicate"].iloc[0])
        w0, x, y = directions[variant], np.stack(g[vector].to_numpy()).astype(float), g["ref"].to_numpy()
        order = sorted(range(len(g)), key=lambda i: (crc32(f"{replicate}||{g[key].iloc[i]}".encode()), i))
        s0, length = x @ w0, max(float(np.linalg.norm(w0)), 1e-12)
        before = _spearman(s0, y)
        out = []
        for lam in lambdas:
            for share in shares:
                for budget in budgets:
                    z, w = centred_scores(x, y, order[:budget], w0, lam, share)
                    near = float(w @ w0) / (max(float(np.linalg.norm(w)), 1e-12) * length)
                    out.append((task, variant, replicate, lam, share, budget, before, _spearman(s0, z), near, float(np.linalg.norm(w - w0)) / length, _spearman(z, y)))
        return pd.DataFrame(out, columns=columns)

    kind = items.schema[by].dataType.simpleString()
    return _tasks(d, by).crossJoin(F.broadcast(grid)).groupBy(by, "variant", "replicate").applyInPandas(cell, f"{by} {kind}, variant string, replicate int, lambda double, share double, budget int, " + ", ".join(f"{m} double" for m in measures))


def representations(items: DataFrame, key: str, ref: str, reps: dict[str, tuple[str, Sequence[float]]], moves: Sequence[tuple[object, float]], budgets: Sequence[int], s: Setting = Setting()) -> DataFrame:
    """The same moves (key, target in [0, 1]) replayed on several representations, each a vector column and a prior direction:
    (representation, budget, key, score, prior, ref) of all items, a written table: what is measured of it reads it many times. The fits see
    only the moved items; scores are expressions."""
    rows = {r[key]: r for r in items.where(F.col(key).isin([k for k, _ in moves])).collect()}
    told = [(k, y) for k, y in moves if k in rows]
    cells = []
    for name, (vector, w0) in reps.items():
        w, of = np.array(w0, float), F.col(vector).cast("array<double>")
        prior = V.cosine(of, V.literal(list(w)))
        for budget in budgets:
            now = told[:budget]
            x = np.array([rows[k][vector] for k, _ in now], float).reshape(len(now), len(w))
            fit = models.fit_gaussian(w, x, np.array([y for _, y in now]), np.ones(len(now)), s.alpha, s.sigma2, s.beta)
            score = V.cosine(of, V.literal(fit.mu.tolist())) + F.lit(float(fit.b))
            cells.append(F.struct(F.lit(name).alias("representation"), F.lit(budget).alias("budget"), score.alias("score"), prior.alias("prior")))
    dealt = items.repartition(key)  # a small file would be scored by one task
    return stored(dealt.select(key, F.col(ref).cast("double").alias("ref"), F.inline(F.array(*cells))).select("representation", "budget", key, "score", "prior", "ref"), "representations")


def representation_steps(scored: DataFrame) -> DataFrame:
    """How the scores of each step agree with the prior's and with the reference, in ranks."""
    by = ["representation", "budget"]
    rounded = scored.withColumns({c: F.round(c, 9) for c in ("score", "prior")})
    a, b = (metrics.spearman(rounded, "score", c, by).withColumnRenamed("spearman", f"with_{c}") for c in ("prior", "ref"))
    return a.join(b, by)


def representation_pairs(scored: DataFrame, key: str) -> DataFrame:
    """How the last scores of every two representations agree: Spearman, and share of the 10% at either end that they have in
    common."""
    last = scored.where(F.col("budget") == scored.agg(F.max("budget")).first()[0]).withColumn("score", F.round("score", 9))
    names = [r[0] for r in last.select("representation").distinct().orderBy("representation").collect()]  # as many as were named
    wide = last.groupBy(key).pivot("representation", names).agg(F.first("score"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    long = wide.select(key, F.inline(F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])))
    ranked = ranks.rank_percentile(ranks.rank_percentile(long, "x", "px", ["one", "other"]), "y", "py", ["one", "other"])
    top, low = ((F.col("px") >= 0.9, F.col("py") >= 0.9), (F.col("px") <= 0.1, F.col("py") <= 0.1))
    shared = lambda of: F.count_if(of[0] & of[1]) / F.nullif(F.count_if(of[0]), F.lit(0))
    return ranked.groupBy("one", "other").agg(metrics.pearson("px", "py").alias("spearman"), shared(top).alias("top_shared"), shared(low).alias("low_shared"))
