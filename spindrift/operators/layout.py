"""Two-dimensional layouts: PCA, alignment, grids, packing, k-means, forces."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..workers import shipped
from .ranks import min_max, row_numbers


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """V8: projections on the first k principal components, as the column pc. The covariance is summed where the rows are (a matrix as
    wide as the vectors is all that is collected); each component's largest weight is positive."""
    told = shipped(df).select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(_moments, "n long, s binary, q binary").collect()
    n = sum(r["n"] for r in told)
    if not n:
        return df.withColumn("pc", F.array().cast("array<double>"))
    s = sum(np.frombuffer(r["s"]) for r in told)
    q = sum(np.frombuffer(r["q"]) for r in told).reshape(len(s), len(s))
    mean = s / n
    values, vectors = np.linalg.eigh(q / n - np.outer(mean, mean))
    top = vectors[:, np.argsort(-values)[:k]].T
    top = np.array([w * (1.0 if w[np.abs(w).argmax()] >= 0 else -1.0) for w in top])
    return df.withColumn("pc", F.array(*[V.dot(F.col(vector), V.literal(w)) - F.lit(float(w @ mean)) for w in top]))


def _moments(batches):
    n, s, q = 0, 0.0, 0.0
    for b in batches:
        if len(b):
            x = np.stack(b["v"].to_numpy()).astype(float)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
    if n:
        yield pd.DataFrame({"n": [n], "s": [np.asarray(s).tobytes()], "q": [np.asarray(q).tobytes()]})


def procrustes(df: DataFrame, x: str, y: str, rx: str, ry: str) -> DataFrame:
    """(x, y) turned onto a reference by the best rotation, then scaled to [0, 1] by axis: columns ax, ay."""
    m = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate((x, y, rx, ry))]).first()
    a, b, c, d = (F.col(n) - F.lit(m[i]) for i, n in enumerate((x, y, rx, ry)))
    h = df.agg(F.sum(a * c), F.sum(a * d), F.sum(b * c), F.sum(b * d)).first()
    u, _, vt = np.linalg.svd(np.array(h, float).reshape(2, 2))
    r = u @ vt
    turned = df.withColumn("tx_", a * F.lit(float(r[0, 0])) + b * F.lit(float(r[1, 0]))).withColumn("ty_", a * F.lit(float(r[0, 1])) + b * F.lit(float(r[1, 1])))
    return min_max(min_max(turned, "tx_", "ax"), "ty_", "ay").drop("tx_", "ty_")


def auto_grid(n: int) -> int:
    return max(6, ceil(sqrt(2 * n)))


def grid_cells(df: DataFrame, x: str, y: str, cells: int) -> DataFrame:
    """Gx, gy: the cell of each point. A range has cells - 1 edges, evenly spaced from its smallest to its largest value, and a
    point's cell is the number of edges at or below it: 1 to cells - 1."""
    out = df
    for c, g in ((x, "gx"), (y, "gy")):
        out = min_max(out, c, "u_", flat=0.0).withColumn(g, (F.floor(F.col("u_") * (cells - 2)) + 1).cast("int")).drop("u_")
    return out


def _ring(r: int):
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if max(abs(dx), abs(dy)) == r]


def pack(df: DataFrame, key: str, cells: int, reach: int = 5) -> DataFrame:
    """A cell (px, py) of its own for every item, near its wanted one: items in order of their cells (by rows of gy, then gx),
    then of key, take the wanted cell, else the first free one of the rings up to `reach` around it, else the first free one of the
    grid. One after the other over the whole grid, so one task does it; it gets no more items than the grid has cells, as all that
    come after them share the cell (0, 0)."""

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn_", ignore_index=True)
        free = np.ones((cells, cells), bool)
        flat, first = free.ravel(), 0
        px, py = [], []
        for gx, gy in zip(g["gx"], g["gy"], strict=True):
            spot = next(((gx + dx, gy + dy) for r in range(reach + 1) for dx, dy in _ring(r) if 0 <= gx + dx < cells and 0 <= gy + dy < cells and free[gx + dx, gy + dy]), None)
            if spot is None:
                while not flat[first]:
                    first += 1
                spot = divmod(first, cells)
            free[spot] = False
            px.append(int(spot[0]))
            py.append(int(spot[1]))
        return pd.DataFrame({key: g[key], "px": px, "py": py})

    ordered = row_numbers(df.select(key, "gx", "gy", (F.col("gy") * cells + F.col("gx")).alias("at_")), "at_", key, "rn_")
    kind = f"{key} {df.schema[key].dataType.simpleString()}, px long, py long"
    placed = shipped(ordered.where(F.col("rn_") <= cells * cells).withColumn("grid_", F.lit(0))).groupBy("grid_").applyInPandas(place, kind)
    return placed.unionByName(ordered.where(F.col("rn_") > cells * cells).select(key, F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py")))


def pack_around(df: DataFrame, key: str, x: str, y: str, centre, k: int) -> DataFrame:
    """The k items nearest to a centre item on cells around it: the centre at (0, 0), each next one on the free cell that is
    nearest to its direction, ring by ring. Only k rows are collected."""
    c = df.where(F.col(key) == centre).select(x, y).first()
    kind = f"{key} {df.schema[key].dataType.simpleString()}, px long, py long"
    if c is None:
        return df.sparkSession.createDataFrame([], kind)
    d2 = F.pow(F.col(x) - F.lit(c[0]), 2) + F.pow(F.col(y) - F.lit(c[1]), 2)
    rows = df.select(key, x, y, F.round(d2, 12).alias("d2")).orderBy("d2", key).limit(k).collect()
    scale = max(1e-9, max(r["d2"] for r in rows) ** 0.5) / max(1.0, sqrt(k) / 2)
    taken: set[tuple[int, int]] = set()
    out = []
    for r in rows:
        want = ((r[x] - c[0]) / scale, (r[y] - c[1]) / scale)
        spot = min((p for q in range(k + 1) for p in _ring(q) if q <= sqrt(k) + 1 and p not in taken), key=lambda p: ((p[0] - want[0]) ** 2 + (p[1] - want[1]) ** 2, p)) if taken else (0, 0)
        taken.add(spot)
        out.append((r[key], spot[0], spot[1]))
    return df.sparkSession.createDataFrame(out, kind)


def text_forces(items: DataFrame, texts: DataFrame, key: str, vector: str, alpha: float) -> DataFrame:
    """Each text (q, r, cx, cy) pulls by its similarity scaled to [0, 1] over all items; the pulls add up. Texts are few."""
    s = items.crossJoin(F.broadcast(texts)).withColumn("s", V.dot(F.col(vector), F.col("r")))
    span = s.groupBy("q").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    k = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    p = s.join(F.broadcast(span), "q").withColumn("k", k)
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return p.groupBy(key, "x", "y").agg(F.sum(F.col("k") * (F.col("cx") - F.col("x"))).alias("fx"), F.sum(F.col("k") * (F.col("cy") - F.col("y"))).alias("fy")).select(key, clip(F.col("x") + F.lit(alpha) * F.col("fx")).alias("x"), clip(F.col("y") + F.lit(alpha) * F.col("fy")).alias("y"))


def block_means(v: Column, size: int) -> Column:
    """Means of blocks of `size` elements."""
    d = v.cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / size).cast("int") - 1), lambda b: V.total(F.slice(d, b * size + 1, F.lit(size))) / size)


def correspondence(cells: DataFrame, image: str, x: str, y: str, vector: str, source, at: tuple[int, int]) -> DataFrame:
    """(image, x, y, cosine) of every cell of the other images to one cell of the source image; no row where that isn't there.
    Maps are compared at the resolution that they come in."""
    one = cells.where((F.col(image) == F.lit(source)) & (F.col(x) == at[0]) & (F.col(y) == at[1])).select(F.col(vector).cast("array<double>").alias("from_")).limit(1)
    return cells.where(F.col(image) != F.lit(source)).crossJoin(F.broadcast(one)).select(image, x, y, V.cosine(F.col(vector).cast("array<double>"), F.col("from_")).alias("cosine"))


def kmeans(df: DataFrame, key: str, x: str, y: str, k: int, rounds: int) -> DataFrame:
    """Centroids begin at the first k items; the lowest index wins on ties; an empty cluster keeps its centroid. A round is one
    aggregation to k rows."""
    cs = [(r[x], r[y]) for r in df.orderBy(key).limit(k).select(x, y).collect()]

    def nearest() -> Column:
        d = [F.struct(F.round(F.pow(F.col(x) - F.lit(a), 2) + F.pow(F.col(y) - F.lit(b), 2), 12).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(cs)]
        return F.array_min(F.array(*d))["i"]

    for _ in range(rounds if cs else 0):
        for r in df.groupBy(nearest().alias("c")).agg(F.avg(x).alias("x"), F.avg(y).alias("y")).collect():
            cs[r["c"]] = (r["x"], r["y"])
    return df.withColumn("cluster", nearest() if cs else F.lit(None).cast("int"))
