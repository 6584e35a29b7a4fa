"""UMAP and t-SNE: weights by brute force, gradients against exact ones, and how well neighbourhoods survive."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph_layout as G
from spindrift.operators import layout, neighbours

from .test_neighbours import clusters


def trustworthiness(x, y, k=10):
    """1 less the ranks by which neighbours in the layout aren't neighbours among the vectors, scaled."""
    n = len(x)
    far = neighbours.square_distances(x, x)
    np.fill_diagonal(far, np.inf)
    rank = far.argsort(axis=1).argsort(axis=1) + 1
    near = neighbours.square_distances(y, y)
    np.fill_diagonal(near, np.inf)
    close = near.argsort(axis=1)[:, :k]
    beyond = np.maximum(np.take_along_axis(rank, close, 1) - k, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * beyond


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(parts)


def placed(df):
    rows = sorted(df.collect(), key=lambda r: r[0])
    return np.array([(r.x, r.y) for r in rows])


def swirl(n=600, width=12, seed=3):
    """Groups along curves that two principal components can't lay out."""
    g = np.random.Generator(np.random.PCG64(seed))
    t, c = g.random(n) * 3, g.integers(0, 6, n)
    x = np.zeros((n, width))
    for i in range(6):
        own = c == i
        x[own, 2 * i % width] = np.cos(2 * t[own])
        x[own, (2 * i + 1) % width] = np.sin(2 * t[own])
        x[own, (2 * i + 2) % width] += t[own]
    return x + 0.02 * g.normal(size=x.shape)


def test_memberships_and_conditionals():
    g = np.random.Generator(np.random.PCG64(1))
    d = np.sort(g.random((40, 15)) * g.random((40, 1)) * 10, axis=1)
    d[3, 10:] = np.inf
    d[4, :4] = 0
    w = G.memberships(d)
    n = np.isfinite(d).sum(axis=1)
    assert np.allclose(w.sum(axis=1)[5:], np.log2(n)[5:], atol=1e-6) and abs(w[3].sum() - math.log2(10)) < 1e-6
    assert (w[:, 0] == 1).all() and (w[3, 10:] == 0).all() and (np.diff(w[5]) <= 0).all()
    p = G.conditionals(d, 5.0)
    entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(entropy, math.log(5), atol=1e-6) and (p[3, 10:] == 0).all()
    ratio = np.log(p[7] / p[7, 0]) / (d[7] ** 2 - d[7, 0] ** 2 + 1e-300)
    assert np.allclose(ratio[1:], ratio[1])  # Gaussian of one width
    assert np.allclose(G.conditionals(d[:, :3], 30.0), 1 / 3, atol=1e-3)  # fewer neighbours than the perplexity asks for


def test_curve():
    a, b = G.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.005  # the known values for 0.1


def test_edges_are_joined_once(spark):
    rows = [(1, 2, 0.5), (2, 1, 0.25), (1, 3, 1.0), (4, 1, 0.5)]
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    for union, want in ((True, {(1, 2): 0.5 + 0.25 - 0.125, (1, 3): 1.0, (1, 4): 0.5}), (False, {(1, 2): 0.375, (1, 3): 0.5, (1, 4): 0.25})):
        got = G.joined(df, union).collect()
        assert {(min(r.owner, r.other), max(r.owner, r.other)): r.w for r in got} == want
        assert {(r.owner, r.other) for r in got} & {(1, 3), (4, 1)} == {(1, 3), (4, 1)}


def exact(y, i, j, p):
    """Gradient of t-SNE over all pairs, with the given p."""
    d = y[:, None] - y[None]
    q = 1 / (1 + (d * d).sum(axis=2))
    np.fill_diagonal(q, 0)
    full = np.zeros((len(y), len(y)))
    full[i, j] = full[j, i] = p
    return 4 * ((full * q - q * q / q.sum())[:, :, None] * d).sum(axis=1)


@pytest.mark.parametrize("scale", [1.0, 8.0, 40.0])
def test_gradient_is_that_of_all_pairs(spark, scale):
    """500 items: the gradient by the field differs from the exact one by at most 2 percent of its length."""
    g = np.random.Generator(np.random.PCG64(6))
    y = clusters(500, 2, 9) * scale / 2
    i, j = np.triu_indices(500, 1)
    some = g.random(len(i)) < 0.05
    i, j = i[some], j[some]
    p = g.random(len(i))
    p /= 2 * p.sum()
    nodes = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(y)], "id long, x double, y double").repartition(3)
    f = G.field(nodes, 500)
    want = exact(y, i, j, p)
    got = G.tsne_gradient(y, np.stack([i, j]), p, np.zeros((0, 2)), np.zeros((500, 3)), f.repulsion(y), 1.0)
    assert np.linalg.norm(got - want) <= 0.02 * np.linalg.norm(want)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d * d).sum(axis=2))
    assert abs(f.z - (q.sum() - 500)) <= 0.01 * f.z
    # the same gradient in strips: edges of others come as sums
    part = F.when(F.col("x") > 0, F.lit(1)).otherwise(F.lit(0))
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(i, j, p, strict=True)], "owner long, other long, w double")
    extra = np.zeros((500, 3))
    for r in G.pulls(nodes, edges, part).collect():
        extra[r.id] = r.extra
    for side in (y[:, 0] > 0, y[:, 0] <= 0):
        own = np.flatnonzero(side)
        mine = side[i]
        at = {int(o): n for n, o in enumerate(own)}
        outside = np.unique(j[mine & ~side[j]])
        at |= {int(o): len(own) + n for n, o in enumerate(outside)}
        ends = np.array([[at[int(a)] for a in i[mine]], [at[int(b)] for b in j[mine]]])
        part_ = G.tsne_gradient(y[own], ends, p[mine], y[outside], extra[own], f.repulsion(y[own]), 1.0)
        assert np.allclose(part_, got[own], atol=1e-12)


def test_field_costs_n_and_not_pairs():
    """Weights of an item touch 16 nodes; the grid is bounded however far items lie apart."""
    f = G.Field.around(np.array([-1e6, -1e6]), np.array([1e6, 1e6]), 128)
    at, w = f.nodes(np.random.default_rng(1).normal(size=(1000, 2)) * 1e5)
    assert f.size == 128 and at.shape == (1000, 16) and np.allclose(w.sum(axis=1), 1) and at.min() >= 0 and at.max() < 128 * 128


@pytest.mark.parametrize("how", [G.umap, G.tsne])
def test_keeps_neighbourhoods_better_than_pca(spark, how, monkeypatch):
    monkeypatch.setattr(G, "NODES", 200)  # three strips
    x = swirl()
    df = table(spark, x)
    flat = np.array([r.pc for r in sorted(layout.pca(df, "v", 2).collect(), key=lambda r: r.id)])
    y = placed(how(df, "id", "v"))
    ours, theirs = trustworthiness(x, y), trustworthiness(x, flat)
    print(how.__name__, ours, theirs)
    assert len(y) == len(x) and np.isfinite(y).all() and ours > 0.93 and 1 - ours < (1 - theirs) / 2


def test_reruns_agree(spark):
    x = swirl(200)
    one, two = (placed(G.umap(table(spark, x, parts), "id", "v", rounds=2, epochs=5)) for parts in (1, 4))
    assert np.abs(one - two).max() < 1e-3 * np.abs(one).max()


@pytest.mark.parametrize("how", [G.umap, G.tsne])
def test_odd_tables(spark, how):
    schema = "id string, v array<float>"
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0]), ("d", [0.0, 1.0]), ("e", [1.0, 1.0])]
    df = spark.createDataFrame(rows, schema)
    got = how(df, "id", "v", rounds=2)
    assert sorted(r.id for r in got.collect()) == ["a", "c", "d", "e"] and all(math.isfinite(r.x) and math.isfinite(r.y) for r in got.collect())
    assert how(df.limit(0), "id", "v", rounds=2).count() == 0 and how(df.where("id = 'a'"), "id", "v", rounds=2).count() == 1
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(30)], schema)
    assert how(same, "id", "v", rounds=2).count() == 30
