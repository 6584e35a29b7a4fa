"""Parameter search by tree-structured Parzen estimators (Bergstra et al., 2011), in batches of trials that one Spark job measures.

The best share of the finished trials makes a good density, the others make a bad one. Both are mixtures of a kernel for each trial and
one as wide as the ranges; a kernel is the product of one for each parameter, so that a choice is judged together with the numbers it
was tried with. Numbers have Gaussian kernels cut off at the range (in logarithms where the scale says so, integrated over a step for
whole numbers); choices have most of the mass on the trial's own. A proposal is the one of CANDIDATES draws from the good density whose
ratio of good to bad is the largest.

A batch is proposed one after another, trials without a value counting as bad, so that its proposals keep apart. Then all of it is
measured at once: the objective gets the batch's parameters and makes one pass over its tables. Trials are rows of a table that is
appended batch by batch; a search that finds trials there goes on from them, and since randomness follows from the seed and the number
of the trial, it goes on as it would have. The driver holds the trials, which are as many as were asked for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import shipped

#: trials drawn at random before densities are made, draws for each proposal, share and most of the trials that count as good
FIRST, CANDIDATES, GOOD, MOST_GOOD = 10, 48, 0.1, 25
SCHEMA = "trial long, parameters string, value double"


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


@dataclass(frozen=True)
class Number:
    """lo to hi, evenly or in logarithms; with a step only lo, lo + step, ..."""

    lo: float
    hi: float
    log: bool = False
    step: float | None = None

    def _range(self) -> tuple[float, float]:
        half = (self.step or 0) / 2
        return (math.log(self.lo - half), math.log(self.hi + half)) if self.log else (self.lo - half, self.hi + half)

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.log(x) if self.log else np.asarray(x, float)

    def _out(self, u: np.ndarray) -> np.ndarray:
        x = np.exp(u) if self.log else u
        if self.step:
            x = self.lo + np.round((x - self.lo) / self.step) * self.step
        return np.clip(x, self.lo, self.hi)

    def uniform(self, g: np.random.Generator) -> float | int:
        return self.named(self._out(np.array(g.uniform(*self._range()))))

    def named(self, x: np.ndarray) -> float | int:
        return int(round(float(x))) if self.step and float(self.step).is_integer() and float(self.lo).is_integer() else float(x)

    def kernels(self, seen: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Centres and widths: those seen, and the middle as wide as the range. A width is the larger distance to a neighbour (the ends
        of the range are neighbours too), no less than a share of the range that shrinks with the number of trials."""
        lo, hi = self._range()
        mu = np.append(self._in(np.array(seen, float)), (lo + hi) / 2)
        order = np.argsort(mu, kind="stable")
        gaps = np.diff(np.concatenate([[lo], mu[order], [hi]]))
        width = np.empty(len(mu))
        width[order] = np.maximum(gaps[:-1], gaps[1:])
        width = np.clip(width, (hi - lo) / min(100, len(mu) + 1), hi - lo)
        width[-1] = hi - lo
        return mu, width

    def draw(self, seen: Sequence[float], which: np.ndarray, g: np.random.Generator) -> np.ndarray:
        """A number from each of these kernels."""
        lo, hi = self._range()
        mu, width = self.kernels(seen)
        u = g.normal(mu[which], width[which])
        while (bad := (u < lo) | (u > hi)).any():  # each try falls in with a probability of a third or more
            u[bad] = g.normal(mu[which[bad]], width[which[bad]])
        return self._out(u)

    def density(self, seen: Sequence[float], x: np.ndarray) -> np.ndarray:
        """(x, kernels): of each kernel at x; for numbers with a step, the probability of x."""
        lo, hi = self._range()
        mu, width = self.kernels(seen)
        inside = _phi((hi - mu) / width) - _phi((lo - mu) / width)
        if self.step:
            a, b = (self._in(x + s * self.step / 2)[:, None] for s in (-1, 1))
            each = _phi((np.minimum(b, hi) - mu) / width) - _phi((np.maximum(a, lo) - mu) / width)
        else:
            each = np.exp(-0.5 * ((self._in(x)[:, None] - mu) / width) ** 2) / (width * math.sqrt(2 * math.pi))
        return each / inside


@dataclass(frozen=True)
class Choice:
    options: tuple

    def uniform(self, g: np.random.Generator):
        return self.options[int(g.integers(len(self.options)))]

    def named(self, x):
        return x

    def _shares(self, seen: Sequence) -> np.ndarray:
        """(kernels, options): each trial's own option has n + 1 parts of n + options, the others one; the last kernel is even."""
        n, m = len(seen), len(self.options)
        own = np.array([[s == o for o in self.options] for s in seen], float).reshape(n, m)
        return np.vstack([(1 + n * own) / (n + m), np.full((1, m), 1 / m)])

    def draw(self, seen: Sequence, which: np.ndarray, g: np.random.Generator) -> list:
        shares = self._shares(seen)
        return [self.options[g.choice(len(self.options), p=shares[w])] for w in which]

    def density(self, seen: Sequence, x: Sequence) -> np.ndarray:
        return self._shares(seen)[:, [self.options.index(v) for v in x]].T


Space = dict[str, Number | Choice]


@dataclass(frozen=True)
class Trial:
    number: int
    parameters: dict
    value: float | None = None


def split(trials: Sequence[Trial]) -> tuple[list[Trial], list[Trial]]:
    """(good, bad): the largest values are good, those without one, or with none that can be compared, are bad."""
    told = sorted((t for t in trials if t.value is not None and t.value == t.value), key=lambda t: (-t.value, t.number))
    n = min(math.ceil(GOOD * len(told)), MOST_GOOD)
    good = {t.number for t in told[:n]}
    return told[:n], [t for t in trials if t.number not in good]


def propose(space: Space, trials: Sequence[Trial], number: int, seed: int) -> dict:
    """Parameters of trial `number`, after `trials`, some of which may be pending."""
    g = np.random.Generator(np.random.PCG64([seed, number]))
    if sum(t.value is not None for t in trials) < FIRST:
        return {name: p.uniform(g) for name, p in space.items()}
    good, bad = split(trials)
    which = g.integers(0, len(good) + 1, CANDIDATES)
    drawn = {name: p.draw([t.parameters[name] for t in good], which, g) for name, p in space.items()}
    gain = np.log(density(space, good, drawn)) - np.log(density(space, bad, drawn))
    best = int(np.argmax(gain))
    return {name: p.named(drawn[name][best]) for name, p in space.items()}


def density(space: Space, trials: Sequence[Trial], x: dict[str, Sequence]) -> np.ndarray:
    """Of the mixture of the trials' kernels, at rows of x."""
    each = [p.density([t.parameters[name] for t in trials], x[name]) for name, p in space.items()]
    return np.prod(each, axis=0).mean(axis=1)


def batch(space: Space, trials: Sequence[Trial], n: int, seed: int) -> list[Trial]:
    """The next n trials, each proposed with the ones before it pending."""
    new: list[Trial] = []
    first = 1 + max((t.number for t in trials), default=-1)
    for i in range(n):
        new.append(Trial(first + i, propose(space, [*trials, *new], first + i, seed)))
    return new


def read(spark: SparkSession, path: str) -> list[Trial]:
    """The trials of a table; none where it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return [Trial(r["trial"], json.loads(r["parameters"]), r["value"]) for r in spark.read.schema(SCHEMA).parquet(path).orderBy("trial").collect()]


def search(spark: SparkSession, space: Space, objective: Callable[[list[dict]], Sequence[float | None]], trials: int, path: str, size: int = 8, seed: int = 20260313) -> DataFrame:
    """The table (trial, parameters as JSON, value) at `path` after as many trials, those found there included. objective: from the
    parameters of a batch to its values, which are maximised; None where a trial fails. A batch of another size continues all the same."""
    done = read(spark, path)
    while len(done) < trials:
        new = batch(space, done, min(size, trials - len(done)), seed)
        values = objective([t.parameters for t in new])
        new = [Trial(t.number, t.parameters, None if v is None or v != v else float(v)) for t, v in zip(new, values, strict=True)]
        spark.createDataFrame([(t.number, json.dumps(t.parameters, sort_keys=True), t.value) for t in new], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        done += new
    return spark.read.schema(SCHEMA).parquet(path)


def correlations(items: DataFrame, vector: str, refs: Sequence[str], directions: np.ndarray) -> np.ndarray:
    """(settings, refs): how the cosine with directions[setting, ref] correlates with each reference, over all items that have both.

    One pass: tasks send the moments of their rows, five numbers for each setting and reference."""
    s, r, _ = directions.shape
    unit = directions / np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-8)
    flat = np.ascontiguousarray(unit.reshape(s * r, -1).T)

    def moments(batches):
        import pandas as pd

        total = np.zeros((6, s * r))
        for b in batches:
            b = b[b["v"].notna()]
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(float)
            z = (x @ flat) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
            y = np.tile(b[[f"y{i}" for i in range(r)]].to_numpy(float), (1, s))
            has = ~np.isnan(y)
            y, z = np.where(has, y, 0.0), np.where(has, z, 0.0)
            total += np.stack([has.sum(0), z.sum(0), y.sum(0), (z * z).sum(0), (y * y).sum(0), (z * y).sum(0)])
        yield pd.DataFrame({"m": [total.tobytes()]})

    cols = [F.col(vector).cast("array<double>").alias("v"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(refs)]]
    found = shipped(items.select(*cols)).mapInPandas(moments, "m binary").collect()  # one row a task
    n, z, y, zz, yy, zy = sum((np.frombuffer(f["m"]).reshape(6, -1) for f in found), np.zeros((6, s * r)))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = (zy - z * y / n) / np.sqrt(np.maximum(zz - z * z / n, 0) * np.maximum(yy - y * y / n, 0))
    return np.where(np.isfinite(c), c, 0.0).reshape(s, r)
