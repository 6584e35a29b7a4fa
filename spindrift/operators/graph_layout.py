"""Two-dimensional layouts of a neighbour graph: UMAP and t-SNE, in partitioned rounds.

Both start from the exact nearest neighbours (`neighbours`), weigh the directed edges row by row, join the two directions of a pair into
one edge that one of its ends owns, so that no item owns more than its own neighbours, and start from the first two principal
components. Then positions move in rounds. In a round the plane is cut into strips, along x and y by turns, of about NODES items or as
many as MOST_PARTS strips leave; a task moves the items of its strip over some steps, with the items at the other ends of its edges held
where they were, and positions are written before the next round. So a round is two joins of the edges with positions and one shuffle;
neither positions nor edges ever meet on the driver or in one task. What all tasks know is bounded: SEEN positions by hash, from which
the strips are cut and which stand for far items in UMAP, and the cells of the field in t-SNE.

UMAP (McInnes et al., 2018): the k nearest neighbours; rho and sigma by bisection so that memberships add up to log2(k); fuzzy union;
edges are sampled by weight, each with negative samples, and the pull and push follow the usual curve.

t-SNE (van der Maaten, 2008; interpolation after Linderman et al., 2019): 3 * perplexity neighbours, with precisions by bisection;
repulsion is a field over a grid of at most GRID x GRID nodes: items are spread over the nodes around them by cubic weights, tasks add
these up, the driver convolves the nodes with the kernels by FFT, and tasks read the field back by the same weights. So a round costs
n + G^2 log G. What an item is pulled by edges that others own in other strips is summed up before the round.

Ties and odd input: items without a vector are left out; items with equal vectors start next to each other, apart by a hash. Reruns
agree but for the order in which sums of field and covariance are added up. A single item lies at the origin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workspace
from ..workers import shipped
from . import neighbours
from .layout import pca
from .ranks import _within

#: items of a strip, strips at most, positions that all tasks know
NODES, MOST_PARTS, SEEN = 1024, 2048, 4096
#: negative samples of an edge, largest pull of one, nodes of the field a side
NEGATIVES, CLIP, GRID = 5, 4.0, 1024


def bisected(total: Callable[[np.ndarray], np.ndarray], target: float, n: int, rounds: int = 64) -> np.ndarray:
    """x > 0 of n rows at which a growing function has the target value."""
    lo, hi, x = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(rounds):
        below = total(x) < target
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        x = np.where(np.isinf(hi), 2 * x, (lo + np.where(np.isinf(hi), lo, hi)) / 2)
    return x


def memberships(d: np.ndarray) -> np.ndarray:
    """UMAP: weights of rows of distances, padded with inf: exp(-(d - rho) / sigma), which add up to log2 of their number."""
    has = np.isfinite(d)
    n = has.sum(axis=1)
    rho = np.where((has & (d > 0)).any(axis=1), np.where(has & (d > 0), d, np.inf).min(axis=1), 0.0)
    beyond = np.maximum(np.where(has, d, 0) - rho[:, None], 0)
    weight = lambda s: np.where(has, np.exp(-beyond / s[:, None]), 0.0)
    sigma = bisected(lambda s: weight(s).sum(axis=1) - np.log2(np.maximum(n, 1)), 0.0, len(d))
    mean = np.where(has, d, 0).sum(axis=1) / np.maximum(n, 1)
    return weight(np.maximum(np.minimum(sigma, 1e12), np.maximum(1e-3 * mean, 1e-12)))


def conditionals(d: np.ndarray, perplexity: float) -> np.ndarray:
    """t-SNE: probabilities of rows of distances, padded with inf, whose entropy is that of the perplexity."""
    has = np.isfinite(d)
    d2 = np.where(has, d, 0) ** 2
    d2 = d2 - np.where(has, d2, np.inf).min(axis=1, initial=np.inf, keepdims=True).clip(max=1e300)

    def p(width: np.ndarray) -> np.ndarray:
        e = np.where(has, np.exp(-d2 / width[:, None]), 0.0)
        return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)

    def entropy(width: np.ndarray) -> np.ndarray:
        q = p(width)
        return -(q * np.log(np.maximum(q, 1e-300))).sum(axis=1)

    return p(np.minimum(bisected(entropy, math.log(perplexity), len(d)), 1e12))


def _weighed(near: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """(src, dst, w) of (src, dst, sim = -d^2): a row's neighbours are weighed together."""
    lists = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d2"), "dst"))).alias("l"))  # k rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("l")
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            has = np.arange(max(n, default=0)) < n[:, None]
            d = np.full(has.shape, np.inf)
            d[has] = np.sqrt(np.maximum(flat.field("d2").to_numpy(), 0))
            yield pa.RecordBatch.from_arrays([b.column("src").take(pa.array(np.repeat(np.arange(len(n)), n))), flat.field("dst"), pa.array(weigh(d)[has])], names=["src", "dst", "w"])

    return shipped(lists).mapInArrow(run, f"src {kind}, dst {kind}, w double")


def joined(directed: DataFrame, union: bool) -> DataFrame:
    """(owner, other, w): one edge for a pair. union: w + v - w * v, else the mean of both directions, one that isn't there as 0. An edge
    is owned by the end that names the other; where both do, by hash."""
    pairs = directed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("s"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.count("*").alias("c"), F.min("src").alias("src"))
    first = F.when(F.col("c") == 1, F.col("src") == F.col("a")).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0)
    w = F.col("s") - F.when(F.col("c") == 2, F.col("lo") * F.col("hi")).otherwise(F.lit(0.0)) if union else F.col("s") / 2
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), w.alias("w")).where("w > 0")


def _begin(items: DataFrame, key: str, vector: str, spread: float) -> DataFrame:
    """(id, x, y, vx, vy): the first two principal components, scaled to a deviation of `spread` along the first."""
    p = pca(items.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), vector), vector, 2)
    x, y = F.coalesce(F.get("pc", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("pc", F.lit(1)), F.lit(0.0))
    s = p.agg(F.stddev_pop(x)).first()[0] or 0.0
    shift = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) * F.lit(1e-3 * spread)
    scale = F.lit(spread / s if s > 1e-12 else 0.0)
    return p.select("id", (x * scale + shift(1)).alias("x"), (y * scale + shift(2)).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))


Step = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.random.Generator], tuple[np.ndarray, np.ndarray]]
_STATE = ["x", "y", "vx", "vy"]


def _moved(nodes: DataFrame, edges: DataFrame, extra: Callable[[Column], DataFrame] | None, n: int, turn: int, seen: np.ndarray, step: Step, seed: int) -> DataFrame:
    """One round: the nodes after step(positions, velocities, ends, weights, held positions, extra, randomness) in each strip.

    ends: (2, edges): numbers of items; those from the number of own items on are of held positions."""
    parts = min(MOST_PARTS, -(-n // NODES))
    axis = turn % 2
    at = (np.arange(1, parts) + (0.0, 0.5)[turn // 2 % 2]) / parts  # borders lie elsewhere two rounds later
    cuts = np.quantile(seen[:, axis], at).tolist() if parts > 1 else []
    part = _within(cuts, "xy"[axis]) if cuts else F.lit(0)
    placed = nodes.withColumn("part", part)
    kind = nodes.schema["id"].dataType.simpleString()
    own = placed.join(extra(part), "id", "left") if extra is not None and cuts else placed.withColumn("extra", F.lit(None).cast("array<double>"))
    ends = edges.join(nodes.select(F.col("id").alias("owner"), part.alias("at")), "owner").join(nodes.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), "other")

    def run(key: tuple, lt: pa.Table, rt: pa.Table) -> pa.Table:
        lt = lt.take(pa.compute.sort_indices(lt.column("id"))).combine_chunks()
        rt = rt.take(pa.compute.sort_indices(rt, [("owner", "ascending"), ("other", "ascending")]))  # the order of rows has no influence
        ids = lt.column("id").to_numpy()
        if not len(ids):
            return pa.table({f: pa.array([], t) for f, t in zip(["id", *_STATE], [lt.schema.field("id").type, *[pa.float64()] * 4], strict=True)})
        owner, other = rt.column("owner").to_numpy(), rt.column("other").to_numpy()
        i = np.searchsorted(ids, owner)
        j = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        held = ids[j] != other
        _, first, which = np.unique(other[held], return_index=True, return_inverse=True)
        j[held] = len(ids) + which
        xy = np.column_stack([rt.column(c).to_numpy()[held][first] for c in ("ox", "oy")]).reshape(-1, 2)
        more = np.array([e if e is not None else (0.0, 0.0, 0.0) for e in lt.column("extra").to_pylist()], float)
        g = np.random.Generator(np.random.PCG64([seed, turn, int(key[0].as_py())]))
        pos, vel = step(np.column_stack([lt.column(c).to_numpy() for c in "xy"]), np.column_stack([lt.column(c).to_numpy() for c in ("vx", "vy")]), np.stack([i, j]), rt.column("w").to_numpy(), xy, more, g)
        return pa.table([lt.column("id"), *map(pa.array, (*pos.T, *vel.T))], names=["id", *_STATE])

    return shipped(own).groupBy("part").cogroup(ends.groupBy("at")).applyInArrow(run, f"id {kind}, x double, y double, vx double, vy double")


def _seen(nodes: DataFrame, turn: int, seed: int) -> np.ndarray:
    rows = nodes.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), "id"), "id").limit(SEEN).select("x", "y").collect()
    return np.array([tuple(r) for r in rows], float).reshape(-1, 2)


# ---- UMAP


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + a * d^(2b)) is nearest to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond, by Gauss-Newton."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    v = np.array([0.0, 0.0])  # logarithms of a and b
    for _ in range(60):
        a, b = np.exp(v)
        f = 1 / (1 + a * d ** (2 * b))
        slope = -f * f * a * d ** (2 * b)
        j = np.column_stack([slope, slope * 2 * b * np.log(d)])
        v = v + np.clip(np.linalg.lstsq(j, want - f, rcond=None)[0], -0.5, 0.5)
    return float(np.exp(v[0])), float(np.exp(v[1]))


def umap_step(pos, vel, ends, weights, held, extra, g, seen, a, b, epochs, rate, fade):
    """Epochs over sampled edges: both ends of an edge pull each other (held ones stay), and its owner is pushed by samples of all items."""
    y, m = np.vstack([pos, held]), len(pos)
    for e in range(epochs):
        drawn = g.random(len(weights)) < weights
        i, j = ends[:, drawn]
        d = y[i] - y[j]
        d2 = (d * d).sum(axis=1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)
        by = np.clip(pull[:, None] * d, -CLIP, CLIP)
        move = np.zeros_like(y)
        np.add.at(move, i, by)
        np.add.at(move, j, -by)
        d = y[i][:, None] - seen[g.integers(0, len(seen), (len(i), NEGATIVES))]
        d2 = (d * d).sum(axis=2)
        np.add.at(move, i, np.clip((2 * b / ((1e-3 + d2) * (1 + a * d2**b)))[:, :, None] * d, -CLIP, CLIP).sum(axis=1))
        y[:m] += (rate - fade * e) * np.clip(move[:m], -CLIP, CLIP)
    return y[:m], vel


def umap(items: DataFrame, key: str, vector: str, k: int = 15, min_dist: float = 0.1, rounds: int = 10, epochs: int = 20, seed: int = 42) -> DataFrame:
    """V9: (key, x, y) by UMAP."""
    with workspace(items.sparkSession) as write:
        nodes = write(_begin(items, key, vector, 5.0), "nodes")
        n, kind = nodes.count(), nodes.schema["id"].dataType.simpleString()
        if n > 1:
            index = neighbours.build(items, key, vector, "sq_euclidean")
            near = neighbours.search(index, items, key, vector, min(k, n - 1))
            edges = write(joined(_weighed(near, memberships, kind), True), "edges")
            most = edges.agg(F.max("w")).first()[0] or 1.0
            edges = edges.withColumn("w", F.col("w") / F.lit(most))
            a, b = curve(min_dist)
            for turn in range(rounds):
                seen = _seen(nodes, turn, seed)
                rate = 1 - turn / rounds
                step = partial(umap_step, seen=seen, a=a, b=b, epochs=epochs, rate=rate, fade=1 / (rounds * epochs))
                nodes = write(_moved(nodes, edges, None, n, turn, seen, step, seed), "nodes")
        return write(nodes.select(F.col("id").alias(key), "x", "y"), "umap", keep=True)


# ---- t-SNE


class Field:
    """The repulsion of all items as values at the nodes of a grid."""

    def __init__(self, low: np.ndarray, gap: float, size: int):
        self.low, self.gap, self.size = low, gap, size

    @staticmethod
    def around(low: np.ndarray, high: np.ndarray, most: int) -> Field:
        """A grid that leaves room around the items; its gap is a third of a unit, or what `most` nodes a side leave."""
        room = 0.25 * float((high - low).max()) + 1.0
        wide = float((high - low).max()) + 2 * room
        size = int(np.clip(math.ceil(3 * wide) + 4, 48, most))
        return Field((low + high) / 2 - wide / 2, wide / (size - 4), size)

    def nodes(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, 16) numbers of the nodes around each item, and their cubic weights, which add up to one."""
        u = np.clip((xy - self.low) / self.gap, 0, self.size - 4.000001)  # those that have left the grid read its edge
        at = np.floor(u)
        t = (u - at)[:, None, :] + 1  # place among the four nodes 0, 1, 2, 3: between 1 and 2
        k = np.arange(4)
        w = np.ones((len(xy), 4, 2))
        for m in range(4):
            others = k != m
            w[:, others] *= (t - m) / (k[others] - m)[None, :, None]
        ix, iy = (at.astype(int)[:, None, c] + k for c in (0, 1))
        return (ix[:, :, None] * self.size + iy[:, None, :]).reshape(-1, 16), (w[:, :, None, 0] * w[:, None, :, 1]).reshape(-1, 16)

    def charges(self, xy: np.ndarray) -> np.ndarray:
        """(3, nodes): the items' mass, and mass times x and y."""
        at, w = self.nodes(xy)
        return np.stack([np.bincount(at.ravel(), (w * c).ravel(), self.size**2) for c in (1.0, xy[:, :1], xy[:, 1:])])

    def set(self, charges: np.ndarray, n: int) -> Field:
        """Convolved with 1 / (1 + d^2), which gives the normaliser z, and its square, which repels."""
        s = self.size
        away = np.minimum(np.arange(2 * s), 2 * s - np.arange(2 * s)) * self.gap
        q = 1 / (1 + away[:, None] ** 2 + away[None] ** 2)
        grids = np.fft.rfft2(charges.reshape(3, s, s), (2 * s, 2 * s))
        back = lambda f: np.fft.irfft2(f, (2 * s, 2 * s))[..., :s, :s]
        near = back(grids[0] * np.fft.rfft2(q))
        self.z = max(float((charges[0] * near.ravel()).sum()) - n, 1e-12)
        self.values = back(grids * np.fft.rfft2(q * q)).reshape(3, -1)
        return self

    def repulsion(self, xy: np.ndarray) -> np.ndarray:
        """Sum of q^2 * (own - other) over all items, over z."""
        at, w = self.nodes(xy)
        mass, x, y = ((v[at] * w).sum(axis=1) for v in self.values)
        return (mass[:, None] * xy - np.column_stack([x, y])) / self.z


def field(nodes: DataFrame, n: int, most: int = GRID) -> Field:
    """The field of all nodes: tasks send what they have on each node of the grid."""
    m = nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    f = Field.around(np.array(m[:2]), np.array(m[2:]), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, f.size**2))
        for b in batches:
            total += f.charges(np.column_stack([b.column(c).to_numpy() for c in "xy"]))
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in total]], names=["at", "q0", "q1", "q2"])

    told = shipped(nodes.select("x", "y")).mapInArrow(run, "at long, q0 double, q1 double, q2 double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("q0", "q1", "q2")]).toArrow()
    charges = np.zeros((3, f.size**2))
    charges[:, told.column("at").to_numpy()] = [told.column(c).to_numpy() for c in ("q0", "q1", "q2")]
    return f.set(charges, n)


def tsne_gradient(pos: np.ndarray, ends: np.ndarray, p: np.ndarray, held: np.ndarray, extra: np.ndarray, repulsion: np.ndarray, exaggerated: float) -> np.ndarray:
    """4 * (sum of p * q * (own - other) - repulsion) of the own items; extra: of edges that others own, the sums of p * q (1, x, y)."""
    y, m = np.vstack([pos, held]), len(pos)
    i, j = ends
    d = y[i] - y[j]
    by = (p / (1 + (d * d).sum(axis=1)))[:, None] * d
    pull = np.zeros_like(y)
    np.add.at(pull, i, by)
    np.add.at(pull, j, -by)
    return 4 * (exaggerated * (pull[:m] + extra[:, :1] * pos - extra[:, 1:]) - repulsion)


def tsne_step(pos, vel, ends, weights, held, extra, g, force, steps, rate, momentum, exaggerated):
    """Steps down the gradient with the field of the round; no item moves by more than the grid's room."""
    f = force.value
    for _ in range(steps):
        vel = momentum * vel - rate * tsne_gradient(pos, ends, weights, held, extra, f.repulsion(pos), exaggerated)
        vel = np.clip(vel, -CLIP, CLIP)
        pos = pos + vel
    return pos, vel


def pulls(nodes: DataFrame, edges: DataFrame, part: Column) -> DataFrame:
    """(id, extra): of the edges that items of other strips own, the sums of p * q (1, x, y), with map-side combine."""
    a = nodes.select(F.col("id").alias("owner"), F.col("x").alias("ax"), F.col("y").alias("ay"), part.alias("pa"))
    b = nodes.select(F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), part.alias("pb"))
    pq = F.col("w") / (1 + F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    met = edges.join(a, "owner").join(b, "other").where("pa <> pb").withColumn("pq", pq)
    return met.groupBy(F.col("other").alias("id")).agg(F.array(F.sum("pq"), F.sum(F.col("pq") * F.col("ax")), F.sum(F.col("pq") * F.col("ay"))).alias("extra"))


def perplexity_of(n: int, most: float = 30.0) -> float:
    return min(most, max(1.0, (n - 1) / 3))


def tsne(items: DataFrame, key: str, vector: str, perplexity: float = 30.0, rounds: int = 24, steps: int = 6, exaggeration: float = 12.0, width: int = 50, seed: int = 42) -> DataFrame:
    """V9: (key, x, y) by t-SNE, of the first `width` principal components."""
    spark = items.sparkSession
    d = items.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    with workspace(spark) as write:
        nodes = write(_begin(d, key, vector, 1.0), "nodes")
        n, kind = nodes.count(), nodes.schema["id"].dataType.simpleString()
        if n > 1:
            wide = d.agg(F.max(F.size(vector))).first()[0]
            reduced = write(pca(d, vector, width).select(key, F.col("pc").alias(vector)), "reduced") if wide > width else d
            p = perplexity_of(n, perplexity)
            near = neighbours.search(neighbours.build(reduced, key, vector, "sq_euclidean"), reduced, key, vector, min(n - 1, int(3 * p) + 1))
            edges = write(joined(_weighed(near, partial(conditionals, perplexity=p), kind), False).withColumn("w", F.col("w") / F.lit(float(n))), "edges")
            for turn in range(rounds):
                early = turn < rounds // 3
                seen = _seen(nodes, turn, seed)
                force = spark.sparkContext.broadcast(field(nodes, n))
                step = partial(tsne_step, force=force, steps=steps, rate=max(n / exaggeration / 4, 50.0), momentum=0.5 if early else 0.8, exaggerated=exaggeration if early else 1.0)
                moved = _moved(nodes, edges, lambda part, now=nodes: pulls(now, edges, part), n, turn, seen, step, seed)
                nodes = write(moved, "nodes")
                force.unpersist()
        return write(nodes.select(F.col("id").alias(key), "x", "y"), "tsne", keep=True)
