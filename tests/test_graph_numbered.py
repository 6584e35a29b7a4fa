"""M6 beyond the driver: a graph axis of more items than the driver holds, against the dense inverse."""

import numpy as np

from spindrift.operators import neighbours
from spindrift.plans import graph as G
from spindrift.plans import models
from spindrift.plans.axis import Axis

from .test_graph_field import dense
from .test_neighbours import clusters

MOVES = (("i007", 95.0), ("i041", 10.0))


def axis(spark, n=120):
    x = clusters(n, 6, 8)
    items = spark.createDataFrame([(f"i{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, v array<double>").repartition(3)
    return Axis.create(items, "id", "v", [1.0, 0.5, 0, 0, 0, 0], mode="graph")


def test_more_items_than_the_driver_holds(spark, monkeypatch):
    small = axis(spark)
    for m in MOVES:
        small = small.move(*m)
    want = {r.id: r for r in small.scores().collect()}
    monkeypatch.setattr(models, "GRAPH_ITEMS", 50)
    large, built = axis(spark), []
    build = neighbours.build
    monkeypatch.setattr(neighbours, "build", lambda *a, **b: (built.append(1), build(*a, **b))[1])
    for m in MOVES:
        large = large.move(*m)
    got = {r.id: r for r in large.scores().collect()}
    assert len(built) == 1  # moves and scores share one graph
    assert large.state.targets.keys() == small.state.targets.keys()
    assert np.allclose([large.state.targets[k] for k in large.state.targets], [small.state.targets[k] for k in small.state.targets], atol=1e-6)
    assert got.keys() == want.keys() and max(abs(got[k].z - want[k].z) for k in want) < 1e-4
    assert all(abs(got[k].std - want[k].std) < 1e-4 for k, _ in MOVES)
    (graph, ids, _), *_, weight = small.model()
    k = dense(len(ids), zip(graph.src, graph.dst, graph.w, strict=True), graph.smooth, graph.prior)
    for (i, _), w in zip(MOVES, weight, strict=True):
        k[ids.index(i), ids.index(i)] += w / 0.04
    c = np.linalg.inv(k)
    error = np.sqrt(((c * c).sum(axis=1) - np.diag(c) ** 2) / models.PROBES)  # what signs differ by
    off = np.array([got[i].std ** 2 - want[i].std ** 2 for i in ids])
    assert (np.abs(off) < 4 * error + 1e-6).mean() > 0.95


def test_items_without_edges_and_without_moves(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "a long, b long, w double")
    rows = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.2), ("c", 2, 0.3), ("d", 3, 0.4)], "id string, no long, z0 double")
    exact = np.linalg.inv(dense(4, [(0, 1, 1.0), (1, 2, 0.5)], 3.0, 0.5))
    whole = G.Numbered(rows, edges, 4, 3.0, 0.5)
    got = {r.id: r for r in whole.posterior(probes=4000).collect()}
    assert [got[k].z for k in "abcd"] == [0.1, 0.2, 0.3, 0.4]
    assert np.allclose([got[k].variance for k in "abcd"], np.diag(exact), rtol=0.1) and abs(got["d"].variance - exact[3, 3]) < 1e-9
    none = {r.id: r for r in G.Numbered(rows, edges.limit(0), 4, 3.0, 0.5).posterior([("b", 1.0, 1.0)], 0.04, 2).collect()}
    assert abs(none["b"].z - (0.2 + 0.8 * exact[3, 3] / (exact[3, 3] + 0.04))) < 1e-9 and none["a"].z == 0.1
    every = {r.id: r for r in whole.posterior([(k, 1.0, 1.0) for k in "abcd"], 0.04, 0).collect()}
    gain = exact @ np.linalg.solve(exact + 0.04 * np.eye(4), 1 - np.array([0.1, 0.2, 0.3, 0.4]))
    assert np.allclose([every[k].z for k in "abcd"], np.array([0.1, 0.2, 0.3, 0.4]) + gain, atol=1e-9)


def test_more_edges_than_a_task_holds_are_solved_as_tables(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD_EDGES", 1)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "a long, b long, w double")
    rows = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.2), ("c", 2, 0.3)], "id string, no long, z0 double")
    whole = G.Numbered(rows, edges, 3, 3.0, 0.5)
    assert not whole.held()
    got = {r.id: r for r in whole.posterior([("b", 1.0, 1.0)], 0.04, 2).collect()}
    k = np.linalg.inv(dense(3, [(0, 1, 1.0), (1, 2, 0.5)], 3.0, 0.5))
    assert np.allclose([got[i].z for i in "abc"], np.array([0.1, 0.2, 0.3]) + k[1] * 0.8 / (k[1, 1] + 0.04), atol=1e-5)
    assert abs(got["b"].variance - (k[1, 1] - k[1, 1] ** 2 / (k[1, 1] + 0.04))) < 1e-5
