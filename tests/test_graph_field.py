"""The graph field on tables against the dense inverse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.plans import graph as G

from .test_neighbours import clusters


def dense(n, rows, smooth, prior, jitter=1e-6):
    k = np.zeros((n, n))
    for a, b, w in rows:
        if a != b:
            k[[a, b], [b, a]] -= smooth * w
            k[a, a] += smooth * w
            k[b, b] += smooth * w
    return k + (prior + jitter) * np.eye(n)


@pytest.fixture(scope="module")
def field(spark):
    x = clusters(500, 6, 8)
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    edges = G.neighbour_edges(items, "id", "v", 4)
    rows = [(r.a, r.b, r.w) for r in edges.collect()]
    return G.Field(items.select("id"), spark.createDataFrame(rows, "a long, b long, w double"), 1.0, 0.5), rows


def test_equals_the_dense_inverse(spark, field):
    f, rows = field
    k = dense(500, rows, 1.0, 0.5)
    z0 = np.linspace(-1, 1, 500)
    observed = [(3, 0.9, 1.0), (77, -0.5, 2.0), (401, 0.2, 0.5)]
    base = spark.createDataFrame([(i, float(z)) for i, z in enumerate(z0)], "id long, z0 double")
    got = {r.id: r for r in f.posterior(base, observed, 0.04, probes=5).collect()}
    h, d = np.zeros((3, 500)), np.array([w / 0.04 for *_, w in observed])
    h[np.arange(3), [o[0] for o in observed]] = 1
    y = np.array([o[1] for o in observed])
    cov = np.linalg.inv(k + h.T @ np.diag(d) @ h)
    mean = z0 + cov @ h.T @ np.diag(d) @ (y - h @ z0)
    assert max(abs(got[i].z - mean[i]) for i in range(500)) < 1e-4
    # variances differ from the exact ones as their stated errors say: by 3 of them for nearly all items
    off = np.array([(got[i].variance - cov[i, i]) / max(got[i].error, 1e-9) for i in range(500)])
    assert (np.abs(off) < 4).mean() > 0.95
    assert all(got[o[0]].error == 0 and abs(got[o[0]].variance - cov[o[0], o[0]]) < 1e-5 for o in observed)


def test_solves_side_by_side(spark, field):
    f, rows = field
    k = dense(500, rows, 1.0, 0.5)
    g = np.random.Generator(np.random.PCG64(3))
    b = g.normal(size=(500, 3))
    b[:, 1] = 0
    right = spark.createDataFrame([(i, *(float(v) for v in r)) for i, r in enumerate(b)], "id long, s0 double, s1 double, s2 double").where("id <> 9")
    b[9] = 0
    got = {r.id: r for r in f.solve(right, ["s0", "s1", "s2"]).collect()}
    want = np.linalg.solve(k, b)
    assert max(abs(got[i][f"s{c}"] - want[i, c]) for i in range(500) for c in range(3)) < 1e-4


def test_deviation_falls_where_items_are_observed(spark):
    """A moved item's deviation falls, and so does its neighbours'; items without edges keep the prior's."""
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)] + [(5, 5, 9.0)], "a long, b long, w double")
    nodes = spark.range(15).toDF("id")
    f = G.Field(nodes, edges, 3.0, 0.5)
    z0 = nodes.select("id", F.lit(0.0).alias("z0"))
    before, after = ({r.id: r for r in f.posterior(z0, o, 0.01, probes=4).collect()} for o in ([], [(6, 1.0, 1.0)]))
    assert after[6].variance < 0.01 < before[6].variance / 5 and after[7].variance < before[7].variance
    assert abs(after[6].z - 1) < 0.1 and after[6].z > after[8].z > after[12].z > 0
    assert abs(before[14].variance - 1 / (0.5 + 1e-6)) < 1e-5 and abs(after[14].z) < 1e-9
    with pytest.raises(ValueError):
        f.posterior(z0, [(i % 12, 0.0, 1.0) for i in range(G.MOST_OBSERVED + 1)], 0.01)


def test_means_come_from_the_columns_that_are_solved(spark, field, monkeypatch):
    """Probes and observed items are solved side by side; the means need no system of their own, however an item was observed."""
    f, rows = field
    asked, solve = [], G.Field.solve
    monkeypatch.setattr(G.Field, "solve", lambda self, rights, names, *a, **b: (asked.append(list(names)), solve(self, rights, names, *a, **b))[1])
    z0 = np.linspace(-1, 1, 500)
    observed = [(3, 0.9, 1.0), (3, 0.1, 2.0), (77, -0.5, 0.0)]  # one twice, one with next to no weight
    base = spark.createDataFrame([(i, float(z)) for i, z in enumerate(z0)], "id long, z0 double")
    got = {r.id: r.z for r in f.posterior(base, observed, 0.04, probes=2).collect()}
    assert asked == [["s0", "s1", "s2", "s3", "s4"]]
    h, d = np.zeros((3, 500)), np.array([max(w, 1e-4) / 0.04 for *_, w in observed])
    h[np.arange(3), [o[0] for o in observed]] = 1
    mean = z0 + np.linalg.solve(dense(500, rows, 1.0, 0.5) + h.T @ np.diag(d) @ h, h.T @ (d * (np.array([o[1] for o in observed]) - h @ z0)))
    assert max(abs(got[i] - mean[i]) for i in range(500)) < 1e-4
