"""Edges pixel by pixel, and resampling and maps on odd shapes; the queries have SQL twins."""

import math

import numpy as np

from spindrift.operators import images as I


def brute_edges(g, weak, strong):
    h, w = g.shape
    px = lambda j, i: int(g[min(max(j, 0), h - 1), min(max(i, 0), w - 1)])
    dx, dy, m = {}, {}, {}
    for j in range(h):
        for i in range(w):
            dx[j, i] = px(j - 1, i + 1) + 2 * px(j, i + 1) + px(j + 1, i + 1) - px(j - 1, i - 1) - 2 * px(j, i - 1) - px(j + 1, i - 1)
            dy[j, i] = px(j + 1, i - 1) + 2 * px(j + 1, i) + px(j + 1, i + 1) - px(j - 1, i - 1) - 2 * px(j - 1, i) - px(j - 1, i + 1)
            m[j, i] = abs(dx[j, i]) + abs(dy[j, i])
    at = lambda j, i: m.get((j, i), 0)
    thin = set()
    for (j, i), v in m.items():
        x, y = abs(dx[j, i]), abs(dy[j, i])
        slope = math.degrees(math.atan2(y, x))
        if slope < 22.5:
            ok = v > at(j, i - 1) and v >= at(j, i + 1)
        elif slope > 67.5:
            ok = v > at(j - 1, i) and v >= at(j + 1, i)
        else:
            s = 1 if (dx[j, i] < 0) == (dy[j, i] < 0) else -1
            ok = v > at(j - 1, i - s) and v > at(j + 1, i + s)
        if ok and v > weak:
            thin.add((j, i))
    todo, out = [p for p in thin if m[p] > strong], set()
    while todo:
        p = todo.pop()
        if p not in out:
            out.add(p)
            todo += [q for a in (-1, 0, 1) for b in (-1, 0, 1) if (q := (p[0] + a, p[1] + b)) in thin and q not in out]
    return out


def test_edges():
    g = np.random.Generator(np.random.PCG64(1))
    y, x = np.mgrid[:40, :50]
    smooth = 127 + 90 * np.sin(x / 5) * np.cos(y / 7) + 8 * g.normal(size=x.shape)
    disc = np.where((x - 25) ** 2 + (y - 20) ** 2 < 150, 200, 40)
    spiral = np.where(np.abs(np.hypot(x - 25, y - 20) - np.mod(np.arctan2(y - 20, x - 25), 2 * np.pi) * 3) < 1.5, 90, 60)
    for image in (smooth, disc, spiral, g.integers(0, 256, (9, 7)), g.integers(0, 256, (1, 5)), np.zeros((3, 3))):
        image = np.clip(np.round(image), 0, 255).astype(int)
        for weak, strong in ((100, 200), (30, 400)):
            got = I.edges(image, weak, strong)
            assert {(int(j), int(i)) for j, i in zip(*np.nonzero(got), strict=True)} == brute_edges(image, weak, strong)
    assert I.edges(disc).any()


def test_share_and_resampling(spark):
    g = np.random.Generator(np.random.PCG64(2))
    shapes = {"a": (6, 9), "b": (1, 1), None: (4, 2)}
    rows, whole = [], {}
    for k, (h, w) in shapes.items():
        whole[k] = g.integers(0, 256, (h, w, 3))
        rows += [(k, i, j, *map(int, whole[k][j, i])) for j in range(h) for i in range(w)]
    df = spark.createDataFrame(rows, "item string, x int, y int, r int, g int, b int").repartition(3)
    share = {r.item: r.edges for r in I.edge_share(df).collect()}
    for k, p in whole.items():
        grey = np.floor(p @ np.array(I.EDGE_GREY) + 0.5).astype(int)
        assert abs(share[k] - len(brute_edges(grey, I.WEAK, I.STRONG)) / grey.size) < 1e-12
    for width, height in ((3, 2), (5, 7), (1, 1)):
        got = {(r.item, r.x, r.y): (r.r, r.g, r.b) for r in I.resampled(df, width, height).collect()}
        assert len(got) == 3 * width * height
        for k, p in whole.items():
            fine = p.repeat(height, axis=0).repeat(width, axis=1)  # each cell is a block of whole pixels
            h, w = p.shape[:2]
            for j in range(height):
                for i in range(width):
                    want = fine[j * h : (j + 1) * h, i * w : (i + 1) * w].reshape(-1, 3).mean(axis=0)
                    assert np.allclose(got[k, i, j], want)
    v = {r.item: r.v for r in I.colour_vectors(df, 4).collect()}
    assert all(len(x) == 48 for x in v.values()) and np.allclose(v["b"], np.tile(whole["b"][0, 0] / 255, 16))


def test_interpolation_between_cells():
    up = np.zeros((8, 4))
    for p, c, w in I._corners(8, 4):
        up[p, c] += w
    assert np.allclose(up.sum(axis=1), 1) and np.allclose(up @ [0, 1, 2, 3], [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])
    assert I._corners(3, 1) == [(0, 0, 1.0), (1, 0, 1.0), (2, 0, 1.0)]


def test_tasks_follow_the_rows_to_be_made(spark, monkeypatch):
    """A few pixels that become many are dealt out to several tasks; a large image's bands give what it gives as a whole."""
    g = np.random.Generator(np.random.PCG64(8))
    sizes = [(3, 3)] * 40 + [(70, 50)]
    rows = [(k, x, y, *(int(c) for c in g.integers(0, 256, 3))) for k, (w, h) in enumerate(sizes) for x in range(w) for y in range(h)]
    df = spark.createDataFrame(rows, "item int, x int, y int, r int, g int, b int").coalesce(1)
    whole = {(r.item, r.x, r.y): (r.r, r.g, r.b) for r in I.resampled(df, 16, 16).collect()}
    monkeypatch.setattr(I, "SPREAD", 1000)
    cut = I.resampled(df, 16, 16)
    got = {(r.item, r.x, r.y): (r.r, r.g, r.b) for r in cut.collect()}
    assert got.keys() == whole.keys() and len(got) == 41 * 256
    assert max(abs(a - b) for k in got for a, b in zip(got[k], whole[k], strict=True)) < 1e-9
    assert cut.rdd.getNumPartitions() == -(-(40 * 19 * 19 + 86 * 66) // 1000)
