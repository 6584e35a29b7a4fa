"""Nearest neighbours by an index of cells.

Centroids are fitted on a sample of at most SAMPLE rows, taken by hash; every row is assigned to its nearest centroid, and a cell knows
the distance of its farthest row, its radius. A query looks into the `probes` cells that are nearest to it. What it has found there
says which other cells may hold something nearer: by the triangle inequality nothing in a cell is nearer than the distance to its
centroid less its radius. In exact mode those cells are looked into as well, so the result is that of comparing all with all; in
approximate mode they aren't, and recall is what was measured.

In many dimensions without clusters most cells must be looked into. Queries that want many are dealt out in blocks instead, and all
rows go past each block, cell by cell: a task holds its queries and the k best of each so far, and gives these alone. Comparing is then
close to all with all; what a task holds is bounded, and the results are n * k rows, not as many for each cell. Products in single
precision, less a bound of their error, leave out what isn't near enough; what is left is compared in double precision.

Rows and queries meet by cell, as matrix products in Arrow batches. A cell of more rows, or more queries, than SIDE bytes hold is cut
into parts, so no task holds a large cell. With n / cells rows in a cell, a vector travels as often as its cell is probed from
different parts, so the shuffle is linear in rows and queries as long as cells stay below the size of a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..workers import shipped
from .aggregates import best_per_group

#: bytes of vectors of one side that a task holds, cells of the matrix it looks at in one go, and the least rows of a part
SIDE, CELLS, LEAST = 16 << 20, 1 << 20, 1024
#: in exact mode all rows go past a query that wants more than FEW cells. Such queries are dealt out in BLOCKS, or as many as leave
#: HELD bytes of vectors and best rows to each; up to WAITING rows that may be among the best are looked at together
FEW, BLOCKS, HELD, WAITING, SENT = 32, 32, 64 << 20, 1 << 18, 8 << 20
#: rows that centroids are fitted on at most, centroids at most, rounds of their fit, and cells that a query looks into first
SAMPLE, MOST_CELLS, ROUNDS, PROBES = 1 << 16, 4096, 8, 4
#: how far a bound may be off by rounding; length of vectors up to which single precision tells their products
SLACK, LONG = 1e-6, 1e15


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def scaled(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows as they are compared: of length one for the cosine."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8) if metric == "cosine" else x


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[1] <= 4:
        return sum((x[:, j, None] - y[None, :, j]) ** 2 for j in range(x.shape[1]))
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(centroids))
    return np.concatenate([square_distances(x[i : i + step], centroids).argmin(axis=1) for i in range(0, len(x), step)] or [np.zeros(0, int)])


def fitted(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows, at most `cells`, from evenly spaced first ones; those that nothing is nearest to go."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        own = _closest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = sums[n > 0] / n[n > 0, None]
    return c


def best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite cells of each row, the first columns of equal ones."""
    take = min(k, sim.shape[1])
    bound = np.partition(sim, -take, axis=1)[:, -take]
    row, column = np.nonzero((sim >= bound[:, None]) & np.isfinite(sim))
    order = np.lexsort((column, -sim[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[keep], column[keep]


@dataclass(frozen=True)
class Index:
    """rows: (dst, w, cell) of all items that have a vector; of each cell its centroid, the number of its rows and its radius."""

    rows: DataFrame
    metric: str
    centroids: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    most: int  # rows or queries of a part

    def reach(self, x: np.ndarray) -> np.ndarray:
        """(x, cells): the similarity that nothing in the cell exceeds; -inf for empty cells."""
        if self.metric == "cosine":
            bound = x @ self.centroids.T + self.radius
        else:
            bound = -(np.maximum(np.sqrt(square_distances(x, self.centroids)) - self.radius, 0) ** 2)
        return np.where(self.sizes > 0, bound, -np.inf)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(x, probes): the cells with the nearest centroids, as far as there are cells that aren't empty."""
        far = np.where(self.sizes > 0, square_distances(x, self.centroids), np.inf)
        take = min(probes, int((self.sizes > 0).sum()))
        return np.argsort(far, axis=1, kind="stable")[:, :take]


def vectors(d: DataFrame, vector: str) -> Column:
    kind = d.schema[vector].dataType.simpleString()
    return F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def build(items: DataFrame, key: str, vector: str, metric: str = "cosine", cells: int | None = None) -> Index:
    """An index of all items that have a vector; about sqrt(n) cells unless said otherwise. metric: cosine or sq_euclidean."""
    d = items.where(F.col(vector).isNotNull()).select(F.col(key).alias("dst"), vectors(items, vector).alias("w"))
    n, width = d.agg(F.count("*"), F.max(F.size("w"))).first()
    cells = min(MOST_CELLS, cells or math.isqrt(n) + 1)
    sample = d.orderBy(F.xxhash64("dst")).limit(min(SAMPLE, 64 * cells)).select("w").toArrow()
    most = max(LEAST, SIDE // (8 * max(1, width or 1)))
    if not n:
        return Index(d.withColumn("cell", F.lit(0)), metric, np.zeros((0, 1)), np.zeros(0), np.zeros(0), most)
    centroids = fitted(scaled(matrix(sample.column("w")), metric), cells)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled(matrix(b.column("w")), metric)
            own = _closest(x, centroids)
            far = np.sqrt(((x - centroids[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("dst"), b.column("w"), pa.array(own.astype(np.int32)), pa.array(far)], names=["dst", "w", "cell", "far"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    rows = shipped(d).mapInArrow(assigned, f"{kinds}, cell int, far double")
    told = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    sizes, radius = np.zeros(len(centroids), int), np.zeros(len(centroids))
    for r in told:
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    return Index(rows.drop("far"), metric, centroids, sizes, radius, most)


def _parts(counts: np.ndarray, most: int) -> Column:
    """Number of parts of the column `cell`."""
    n = np.maximum(1, -(-counts // most)).astype(int)
    if (n == 1).all():
        return F.lit(1)
    return F.coalesce(F.get(F.array(*[F.lit(int(x)) for x in n]), F.col("cell")), F.lit(1))


def _met(index: Index, asked: DataFrame, counts: np.ndarray, k: int, decimals: int, skip_self: bool, kind: str, lists: bool = False) -> DataFrame:
    """(src, dst, sim): the k best of each cell of queries (src, v, cell) and rows. counts: about how many queries look into each cell.
    Queries with a column `least` get what isn't below it. lists: (src, sims) instead, a row for each query and cell."""
    of_rows, of_asked = _parts(index.sizes, index.most), _parts(counts, index.most)
    r = index.rows.withColumn("part", F.pmod(F.xxhash64("dst"), of_rows).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of_asked - 1)))
    l = asked.withColumn("block", F.pmod(F.xxhash64("src"), of_asked).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), of_rows - 1)))
    metric, slack = index.metric, max(SLACK, 10.0**-decimals)
    names = ["src", "sims"] if lists else ["src", "dst", "sim"]

    def nearest(lt: pa.Table, rt: pa.Table) -> pa.Table:
        src_kind = lt.schema.field("src").type
        out = []
        if lt.num_rows and rt.num_rows:
            rt = rt.take(pa.compute.sort_indices(rt.column("dst")))
            x, y = matrix(lt.column("v")), matrix(rt.column("w"))
            src, dst = (t.to_numpy() for t in (lt.column("src"), rt.column("dst")))
            xn, yn = (np.maximum(np.linalg.norm(m, axis=1), 1e-8) for m in (x, y))
            least = lt.column("least").to_numpy() if "least" in lt.column_names else None
            step = max(1, CELLS // len(y))
            for i in range(0, len(x), step):
                a, of = x[i : i + step], src[i : i + step]
                sim = np.clip((a @ y.T) / (xn[i : i + step, None] * yn[None]), -1, 1) if metric == "cosine" else -square_distances(a, y)
                sim = np.round(sim, decimals)
                if skip_self:
                    sim[of[:, None] == dst[None]] = -np.inf
                if least is not None:
                    sim[sim < least[i : i + step, None] - slack] = -np.inf
                row, column = best(sim, k)
                if lists:
                    ends = np.searchsorted(row, np.arange(len(a) + 1)).astype(np.int32)
                    out.append(pa.table([lt.column("src").slice(i, step), pa.ListArray.from_arrays(pa.array(ends), pa.array(sim[row, column]))], names=names))
                else:
                    out.append(pa.table([lt.column("src").take(pa.array(i + row)), rt.column("dst").take(pa.array(column)), pa.array(sim[row, column])], names=names))
        if not out:
            none = [pa.array([], src_kind), *([pa.array([], pa.list_(pa.float64()))] if lists else [pa.array([], rt.schema.field("dst").type), pa.array([], pa.float64())])]
            return pa.table(none, names=names)
        return pa.concat_tables([t.combine_chunks() for t in out])

    return shipped(l).groupBy("cell", "part", "block").cogroup(r.groupBy("cell", "part", "block")).applyInArrow(nearest, kind)


class Kept:
    """The k best rows of each query so far, ties by dst. least: a bound that a query's k best aren't below."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.kth, self.last = np.full(len(least), -np.inf), None  # the k-th best row of each query, once there are k
        self.settled, self.waiting, self.n = None, [], 0

    def add(self, query: np.ndarray, sim: np.ndarray, dst: np.ndarray) -> None:
        if self.last is not None:
            better = (sim > self.kth[query]) | ((sim == self.kth[query]) & (dst < self.last[query]))
            query, sim, dst = query[better], sim[better], dst[better]
        self.waiting.append((query, sim, dst))
        self.n += len(query)
        if self.n >= WAITING:
            self.settle()

    def settle(self) -> None:
        """What waits is put among the best."""
        if not self.n:
            return
        query, sim, dst = (np.concatenate(c) for c in zip(*([self.settled] if self.settled else []), *self.waiting, strict=True))
        order = np.lexsort((dst, -sim, query))
        query, sim, dst = query[order], sim[order], dst[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        full = place == self.k - 1
        if self.last is None:
            self.last = np.zeros(len(self.least), dst.dtype)
        self.kth[query[full]], self.last[query[full]] = sim[full], dst[full]
        self.least = np.maximum(self.least, self.kth)
        self.settled, self.waiting, self.n = (query[keep], sim[keep], dst[keep]), [], 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, cell, rows) of rows in order of both."""
    for b in batches:
        block, cell = (b.column(c).to_numpy() for c in ("block", "cell"))
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(cell) != 0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield int(block[i]), int(cell[i]), b.slice(i, j - i)


def _swept(index: Index, asked: DataFrame, n: int, k: int, decimals: int, skip_self: bool, kind: str) -> DataFrame:
    """(src, dst, sim): the k best of all rows for n queries (src, v, least), which are the same as by any other way: a block of queries
    sees all rows in order of cells, and leaves out those cells that hold nothing for it."""
    metric, slack = index.metric, max(SLACK, 10.0**-decimals)
    width = index.centroids.shape[1]
    blocks = max(1, min(BLOCKS, n // LEAST), -(-n // max(1, HELD // (8 * width + 32 * k))))
    light = [Index(None, metric, index.centroids[i : i + 1], index.sizes[i : i + 1], index.radius[i : i + 1], index.most) for i in range(len(index.centroids))]
    src, dst = asked.schema["src"].dataType, index.rows.schema["dst"].dataType
    l = asked.select(F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("cell"), "src", F.lit(None).cast(dst).alias("dst"), "v", "least")
    r = index.rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", F.lit(None).cast(src).alias("src"), "dst", F.col("w").alias("v"), F.lit(None).cast("double").alias("least"))
    plane = metric != "cosine" and width <= 4
    middle = 0.0 if metric == "cosine" else index.centroids.mean(axis=0)

    def side(x: np.ndarray, left: bool) -> np.ndarray:
        """Rows, scaled already, whose products are the similarities."""
        if metric == "cosine" or plane:
            return x
        square, one = -(x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1))
        return np.hstack([2 * x, one, square]) if left else np.hstack([x, square, one])

    def rough(x: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sides in single precision, of differences from the middle where distances are compared, and the lengths of those."""
        x = x - middle
        return side(x, left).astype(np.float32), np.linalg.norm(x, axis=1)

    def near_enough(x: np.ndarray, y: np.ndarray, least: np.ndarray, rough_x: tuple, rough_y: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, sim) of what isn't below the rows' least."""
        longest = rough_y[1].max()
        if not plane and rough_x[1].max() < LONG and longest < LONG:
            # a sum of w rounded products is off by (w + 3) / 2^24 of their sizes at most
            off = (width + 8) * 2.0**-24 * (rough_x[1] + longest) ** 2
            at = np.flatnonzero(rough_x[0] @ rough_y[0].T >= np.nextafter((least - off).astype(np.float32), np.float32(-np.inf))[:, None])
            if len(at) * 8 * width <= SENT:
                row, column = np.divmod(at, len(y))
                sim = np.einsum("ij,ij->i", side(x[row], True), side(y[column], False))
                keep = sim >= least[row]
                return row[keep], column[keep], sim[keep]
        sim = -square_distances(x, y) if plane else side(x, True) @ side(y, False).T
        at = np.flatnonzero(sim >= least[:, None])
        return *np.divmod(at, len(y)), sim.ravel()[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(_runs(batches), lambda t: t[0]):
            own, kept = [], None
            for _, cell, b in parts:
                if cell < 0:
                    own.append(b)
                    continue
                if kept is None and not own:
                    continue
                if kept is None:
                    asked = pa.Table.from_batches(own)
                    names, x = asked.column("src").to_numpy(), scaled(matrix(asked.column("v")), metric)
                    kept, kind_of = Kept(asked.column("least").to_numpy(), k), asked.schema.field("src").type
                    own, asked = [], None
                    single, length = rough(x, True)
                there, y = b.column("dst").to_numpy(zero_copy_only=False), scaled(matrix(b.column("v")), metric)
                rough_y = rough(y, False)
                wanted = np.flatnonzero(light[cell].reach(x)[:, 0] >= kept.least - slack)
                step = max(1, CELLS // len(y))
                for i in range(0, len(wanted), step):
                    some = wanted[i : i + step]
                    row, column, sim = near_enough(x[some], y, kept.least[some] - slack, (single[some], length[some]), rough_y)
                    query, near = some[row], there[column]
                    sim = np.round(np.clip(sim, -1, 1) if metric == "cosine" else np.minimum(sim, 0), decimals)
                    if skip_self:
                        other = names[query] != near
                        query, near, sim = query[other], near[other], sim[other]
                    kept.add(query, sim, near)
            if kept is not None:
                kept.settle()
                query, sim, near = kept.settled or (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
                for i in range(0, len(query), CELLS // 16):
                    at = slice(i, i + CELLS // 16)
                    yield pa.RecordBatch.from_arrays([pa.array(names[query[at]], kind_of), pa.array(near[at], b.schema.field("dst").type), pa.array(sim[at])], names=["src", "dst", "sim"])

    return shipped(l.unionByName(r)).repartitionById(blocks, "block").sortWithinPartitions("block", "cell", "dst").mapInArrow(run, kind)


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int, probes: int = PROBES, exact: bool = True, decimals: int = 9, skip_self: bool = True) -> DataFrame:
    """(src, dst, sim): the k nearest items of each query that has a vector, ties by dst. sim is the cosine, or the square distance
    with a minus. With exact=False only `probes` cells are looked into."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("src"), vectors(queries, vector).alias("v"))
    src, dst = q.schema["src"].dataType.simpleString(), index.rows.schema["dst"].dataType.simpleString()
    v = q.schema["v"].dataType.simpleString()
    kind = f"src {src}, dst {dst}, sim double"
    if not len(index.centroids):
        return q.limit(0).select("src", F.lit(None).cast(dst).alias("dst"), F.lit(0.0).alias("sim"))
    metric, step = index.metric, max(1, CELLS // len(index.centroids))
    # what the tasks need of the index: as much as its cells
    light = Index(None, metric, index.centroids, index.sizes, index.radius, index.most)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, step):
                some = b.slice(i, step)
                cells = light.probed(scaled(matrix(some.column("v")), metric), probes)
                owner = pa.array(np.repeat(np.arange(some.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([some.column("src").take(owner), some.column("v").take(owner), pa.array(cells.ravel().astype(np.int32))], names=["src", "v", "cell"])

    n = q.count()
    counts = np.zeros(len(index.sizes), int)
    if n * probes > index.most:  # more queries than a part holds: how many look into each cell
        for r in shipped(q).mapInArrow(first, f"src {src}, v {v}, cell int").groupBy("cell").count().collect():
            counts[r["cell"]] = r["count"]
    asked = shipped(q).mapInArrow(first, f"src {src}, v {v}, cell int")
    order = ["src"], [F.col("sim").desc(), F.col("dst")], k
    if not exact:
        return best_per_group(_met(index, asked, counts, k, decimals, skip_self, kind), *order)
    # what is found there says how near something must be; the cells that may hold it are looked into
    bound = _met(index, asked, counts, k, decimals, skip_self, f"src {src}, sims array<double>", lists=True).groupBy(F.col("src").alias("src_"))
    bound = bound.agg(F.get(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), F.lit(k - 1)).alias("least"))  # probes * k numbers
    both = q.join(bound, F.col("src") == F.col("src_"), "left").select("src", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    few, slack = max(1, min(step, SENT // (8 * len(index.centroids)))), max(SLACK, 10.0**-decimals)

    def wanted(b: pa.RecordBatch) -> np.ndarray:
        return (light.reach(scaled(matrix(b.column("v")), metric)) >= b.column("least").to_numpy(zero_copy_only=False)[:, None] - slack) & (light.sizes > 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, few):
                some = b.slice(i, few)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(wanted(some).sum(axis=1) > FEW)], names=["src", "v", "least", "wide"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, few):
                some = b.slice(i, few)
                own, cell = np.nonzero(wanted(some))
                owner = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(owner) for c in ("src", "v", "least")), pa.array(cell.astype(np.int32))], names=["src", "v", "least", "cell"])

    both = stored(shipped(both).mapInArrow(told, f"src {src}, v {v}, least double, wide boolean"), "asked")
    wide = both.where("wide").count()
    swept = _swept(index, both.where("wide"), wide, k, decimals, skip_self, kind) if wide else None
    if wide == n:
        return swept if swept is not None else q.limit(0).select("src", F.lit(None).cast(dst).alias("dst"), F.lit(0.0).alias("sim"))
    more = shipped(both.where("NOT wide")).mapInArrow(rest, f"src {src}, v {v}, least double, cell int")
    # into a cell look those that are about as many as its rows, and their neighbours
    counts = np.minimum(n - wide, FEW * np.maximum(index.sizes, (n - wide) // len(index.sizes)))
    found = best_per_group(_met(index, more, counts, k, decimals, skip_self, kind), *order)
    return found if swept is None else found.unionByName(swept)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    n = exact.count()
    return found.join(exact.select("src", "dst"), ["src", "dst"], "left_semi").count() / n if n else 1.0
