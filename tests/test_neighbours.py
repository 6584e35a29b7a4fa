"""The index of cells against all pairs, its bounds, its recall, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import neighbours as N


def brute(x, ids, asked, k, metric, skip=True):
    out = set()
    for i in asked:
        if metric == "cosine":
            n = np.maximum(np.linalg.norm(x, axis=1), 1e-8)
            s = np.clip(x @ x[i] / (n * n[i]), -1, 1)
        else:
            s = -((x - x[i]) ** 2).sum(axis=1)
        s = np.round(s, 9)
        order = sorted((j for j in range(len(x)) if not (skip and j == i)), key=lambda j: (-s[j], ids[j]))[:k]
        out |= {(ids[i], ids[j], float(s[j]) + 0.0) for j in order}
    return out


def got(df):
    return {(r.src, r.dst, r.sim + 0.0) for r in df.collect()}


def clusters(n, width, groups, seed=1):
    g = np.random.Generator(np.random.PCG64(seed))
    centres = g.normal(size=(groups, width))
    return centres[g.integers(0, groups, n)] + 0.15 * g.normal(size=(n, width))


def table(spark, x, ids=None, parts=4):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], f"id {'string' if isinstance(next(iter(ids)), str) else 'long'}, v array<double>").repartition(parts)


@pytest.mark.parametrize("metric,width", [("cosine", 8), ("sq_euclidean", 8), ("sq_euclidean", 2)])
def test_exact_mode_is_exhaustive(spark, metric, width):
    """Clusters, rows alike, zero vectors, and points that are far from all centroids."""
    x = np.vstack([clusters(400, width, 7), np.zeros((3, width)), np.ones((5, width)), 30 * np.eye(width)[:2]])
    df = table(spark, x)
    index = N.build(df, "id", "v", metric)
    assert 5 < len(index.centroids) <= 21 and index.sizes.sum() == len(x)
    assert got(N.search(index, df, "id", "v", 6)) == brute(x, list(range(len(x))), range(len(x)), 6, metric)


def test_parts_of_hot_cells(spark, monkeypatch):
    """A third of all rows lie in one place; cells and queries are cut into parts of 16."""
    monkeypatch.setattr(N, "LEAST", 16)
    monkeypatch.setattr(N, "SIDE", 16)
    g = np.random.Generator(np.random.PCG64(2))
    x = np.vstack([clusters(150, 4, 5), np.ones((75, 4)) + 1e-3 * g.normal(size=(75, 4))])
    df = table(spark, x)
    assert got(N.search(N.build(df, "id", "v"), df, "id", "v", 5, probes=2)) == brute(x, list(range(len(x))), range(len(x)), 5, "cosine")


def test_reach_bounds_all_rows():
    g = np.random.Generator(np.random.PCG64(3))
    for metric in ("cosine", "sq_euclidean"):
        x = N.scaled(g.normal(size=(300, 6)), metric)
        c = N.fitted(x, 12)
        own = N._closest(x, c)
        far = np.sqrt(((x - c[own]) ** 2).sum(axis=1))
        index = N.Index(None, metric, c, np.bincount(own, minlength=len(c)), np.array([far[own == i].max(initial=0) for i in range(len(c))]), 9)
        q = N.scaled(g.normal(size=(40, 6)), metric)
        sim = q @ x.T if metric == "cosine" else -N.square_distances(q, x)
        reach = index.reach(q)
        assert all((sim[:, own == i] <= reach[:, i : i + 1] + 1e-9).all() for i in range(len(c)))


def test_recall(spark, sf):
    """At least 0.9 on clustered rows and on the given embeddings, with a part of the cells looked into."""
    x = clusters(2000, 16, 40)
    df = table(spark, x)
    index = N.build(df, "id", "v")
    asked = df.where("id % 50 = 0")
    found, all_ = (N.search(index, asked, "id", "v", 10, exact=e) for e in (False, True))
    assert N.recall(found, all_) >= 0.9 and len(index.centroids) > 8 * N.PROBES
    assert got(all_) == brute(x, list(range(2000)), range(0, 2000, 50), 10, "cosine")


def test_plane_looks_into_few_cells():
    """In the plane the bound leaves a few cells for each query, so the exact way stays linear."""
    g = np.random.Generator(np.random.PCG64(3))
    left = []
    for n in (2_000, 8_000):
        x = g.random((n, 2))
        c = N.fitted(x, int(n**0.5) + 1)
        own = N._closest(x, c)
        far = np.sqrt(((x - c[own]) ** 2).sum(axis=1))
        index = N.Index(None, "sq_euclidean", c, np.bincount(own, minlength=len(c)), np.array([far[own == i].max(initial=0) for i in range(len(c))]), 9)
        q = x[:200]
        kth = -np.sort(N.square_distances(q, x), axis=1)[:, 8]
        left.append((index.reach(q) >= kth[:, None] - N.SLACK).sum(axis=1).mean())
    assert max(left) < 12 and left[1] < left[0] * 1.3


def test_odd_tables(spark):
    schema = "id long, v array<float>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, schema)
    empty = df.limit(0)
    assert {(r.src, r.dst) for r in N.search(N.build(df, "id", "v"), df, "id", "v", 9).collect()} == {(a, b) for a in (1, 3, 4) for b in (1, 3, 4) if a != b}
    assert N.search(N.build(empty, "id", "v"), df, "id", "v", 3).count() == 0 and N.search(N.build(df, "id", "v"), empty, "id", "v", 3).count() == 0
    assert N.build(df.where("v IS NULL"), "id", "v").rows.count() == 0
    x = clusters(60, 3, 4)
    ids = [f"item {i:03d}" for i in range(60)]
    assert got(N.search(N.build(table(spark, x, ids), "id", "v"), table(spark, x, ids), "id", "v", 4)) == brute(x, ids, range(60), 4, "cosine")
    one = df.where("id = 1").withColumn("v", F.array(F.lit(0.0), F.lit(0.0)))
    assert {(r.dst, r.sim) for r in N.search(N.build(df, "id", "v"), one, "id", "v", 2, skip_self=False).collect()} == {(1, 0.0), (3, 0.0)}


def test_a_query_that_wants_most_cells_travels_to_groups_of_them(spark, monkeypatch):
    import numpy as np

    from spindrift.operators import neighbours

    sent, met = [], neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda index, asked, *a, **b: (sent.append(asked), met(index, asked, *a, **b))[1])
    x = np.random.default_rng(5).standard_normal((3000, 32))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(4).cache()
    got = neighbours.search(neighbours.build(d, "id", "v", "sq_euclidean"), d, "id", "v", 3).collect()
    d2 = ((x[:, None, :16] - x[None, :, :16]) ** 2).sum(2) + ((x[:, None, 16:] - x[None, :, 16:]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(d2[i], kind="stable")[:3]}
    assert {(r["src"], r["dst"]) for r in got} == want
    assert sent[-1].count() < 3000 * 10  # there are 55 cells
    d.unpersist()


@pytest.mark.parametrize("metric,width,names", [("cosine", 24, False), ("sq_euclidean", 24, True), ("sq_euclidean", 3, False)])
def test_rows_go_past_blocks_of_queries(spark, monkeypatch, metric, width, names):
    """Queries that want many cells, beside those that don't: small blocks, few rows looked at together, rows alike, k beyond what is near."""
    for name, v in (("FEW", 3), ("LEAST", 64), ("HELD", 64 * (8 * width + 32 * 40)), ("WAITING", 500), ("CELLS", 2000)):
        monkeypatch.setattr(N, name, v)
    g = np.random.Generator(np.random.PCG64(7))
    x = np.vstack([g.normal(size=(300, width)), clusters(100, width, 2), np.tile(g.normal(size=width), (60, 1)), np.zeros((2, width))])
    ids = [f"item {i:03d}" for i in range(len(x))] if names else list(range(len(x)))
    df = table(spark, x, ids)
    index = N.build(df, "id", "v", metric)
    swept, met = [], N._swept
    monkeypatch.setattr(N, "_swept", lambda index, asked, n, *a: (swept.append(n), met(index, asked, n, *a))[1])
    for k in (5, 40):
        assert got(N.search(index, df, "id", "v", k, probes=1)) == brute(x, ids, range(len(x)), k, metric)
    assert swept and all(0 < n < len(x) or width == 24 for n in swept)


def test_a_task_gives_the_best_of_all_rows_only(spark):
    """Queries that want most cells don't bring k rows from each of them: what the search makes are its results, and nothing ranks them."""
    x = np.random.default_rng(5).standard_normal((1500, 32))
    df = table(spark, x)
    found = N.search(N.build(df, "id", "v"), df, "id", "v", 9)
    assert "Window" not in found._jdf.queryExecution().toString()
    assert found.count() == 1500 * 9


def test_what_a_block_of_queries_keeps_is_small():
    """Two million rows that may be among the best go past 4,000 queries: a task holds a few MB of them at a time, and the right ones."""
    import tracemalloc

    g = np.random.Generator(np.random.PCG64(9))
    sim = g.random((20, 100_000))
    kept, query = N.Kept(np.full(4000, -np.inf), 5), np.tile(np.arange(4000), 25)
    tracemalloc.start()
    for i, s in enumerate(sim):
        kept.add(query, s, np.repeat(np.arange(25), 4000) + 25 * i)
    kept.settle()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    all_ = sim.reshape(500, 4000)
    assert np.array_equal(kept.settled[2].reshape(4000, 5), np.argsort(-all_, axis=0, kind="stable")[:5].T)


@pytest.mark.parametrize("metric", ["cosine", "sq_euclidean"])
def test_single_precision_leaves_out_nothing(spark, monkeypatch, metric):
    """Rows that differ by less than single precision tells, groups far from the middle of all, and vectors too long for it."""
    monkeypatch.setattr(N, "FEW", 1)
    g = np.random.Generator(np.random.PCG64(8))
    one = g.normal(size=16)
    x = np.vstack([one + 1e-4 * g.normal(size=(150, 16)), 20 * np.eye(16)[0] + g.normal(size=(80, 16)), -20 * np.eye(16)[0] + g.normal(size=(80, 16))])
    if metric == "cosine":
        x = np.vstack([x, 1e18 * g.normal(size=(4, 16)), 1e-20 * g.normal(size=(4, 16))])
    df = table(spark, x)
    swept, met = [], N._swept
    monkeypatch.setattr(N, "_swept", lambda index, asked, n, *a: (swept.append(n), met(index, asked, n, *a))[1])
    found = got(N.search(N.build(df, "id", "v", metric), df, "id", "v", 5, probes=1, decimals=8))
    s = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8) if metric == "cosine" else x
    true = s @ s.T if metric == "cosine" else -((s[:, None] - s[None]) ** 2).sum(axis=2)
    np.fill_diagonal(true, -np.inf)
    assert swept and swept[0] > len(x) // 2 and len(found) == 5 * len(x)
    fifth = np.sort(true, axis=1)[:, -5]
    assert all(abs(true[a, b] - sim) < 2e-8 and sim > fifth[a] - 2e-8 for a, b, sim in found)
