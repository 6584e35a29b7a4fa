"""M6 beyond the driver: the Gaussian field of a neighbour graph as a table of edges.

The precision of the field is smooth * Laplacian + prior. Its systems are solved by preconditioned conjugate gradients for several
right-hand sides side by side: a step is one join of the edges with the present directions and one aggregation, written once, and one
row of sums that tells the driver all that the next step needs, so neither items nor edges come to the driver. Prior variances, the
diagonal of the inverse, are estimated by random signs (Hutchinson): the mean over probes of v * solve(v), and the standard error that
the probes themselves show. What observed items take away from them, and how they move the means, is exact: one solved column for each
observed item, solved beside the probes.

Numbered is for items that are too many for the driver. While its edges are few enough for a task to hold them, all of them go past
groups of right-hand sides, and a task solves those of a group; beyond that it is a Field.

An item without edges has the prior's precision alone. Edges are undirected, named once; loops are left out, repeated ones add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import neighbours
from ..session import stored, workspace
from ..workers import shipped
from . import models

#: right-hand sides that are solved side by side, most steps, and observed items: each of these is a column
TOGETHER, MOST_STEPS, MOST_OBSERVED = 8, 500, 32
#: nodes and edges that a task holds at most (some 0.5 GB), and groups that right-hand sides are dealt out in
HELD_NODES, HELD_EDGES, GROUPS, SENT = 1 << 21, 1 << 23, 24, 1 << 16


def neighbour_edges(items: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, w): an edge between an item and its k nearest ones, exp(-distance / mean distance) of the cosine distances; where both name
    each other, once."""
    near = neighbours.search(neighbours.build(items, key, vector), items, key, vector, k).withColumn("d", F.least(F.greatest(1 - F.col("sim"), F.lit(0.0)), F.lit(2.0)))
    near = stored(near, "near")  # both the mean and the edges read it
    mean = near.agg(F.avg("d")).first()[0] or 1.0
    w = F.exp(-F.col("d") / F.lit(max(float(mean), 1e-3)))
    return near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(w).alias("w"))


@dataclass(frozen=True)
class Field:
    """nodes: (id); edges: (a, b, w) over them, both written tables."""

    nodes: DataFrame
    edges: DataFrame
    smooth: float = 3.0
    prior: float = 0.05
    jitter: float = 1e-6

    def _both(self) -> DataFrame:
        e = self.edges.where("a <> b")
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))

    def _diagonal(self) -> DataFrame:
        """(id, scale): the diagonal of the precision."""
        degree = self._both().groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"))
        return self.nodes.select("id").join(degree, "id", "left").select("id", (F.lit(self.smooth) * F.coalesce("degree", F.lit(0.0)) + F.lit(self.prior + self.jitter)).alias("scale"))

    def solve(self, rights: DataFrame, names: Sequence[str], extra: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
        """(id, names): the solutions for the columns `names` of rights (id, ...), nulls and absent items as 0. extra: (id, extra), what
        observations add to the diagonal. Sides are solved until what is left of each is `tolerance` of it, by the norm of
        the preconditioner."""
        spark = self.nodes.sparkSession
        k = range(len(names))
        with workspace(spark) as write:
            start = self._diagonal()
            if extra is not None:
                start = start.join(extra, "id", "left").withColumn("scale", F.col("scale") + F.coalesce("extra", F.lit(0.0))).drop("extra")
            start = start.join(rights.select("id", *names), "id", "left")
            r = [F.coalesce(F.col(n), F.lit(0.0)) for n in names]
            now = write(start.select("id", "scale", *[F.lit(0.0).alias(f"x{i}") for i in k], *[r[i].alias(f"r{i}") for i in k], *[(r[i] / F.col("scale")).alias(f"p{i}") for i in k]), "cg")
            both = write(self._both(), "edges")
            first = now.agg(*[F.coalesce(F.sum(F.col(f"r{i}") * F.col(f"p{i}")), F.lit(0.0)).alias(f"z{i}") for i in k]).first()
            rz = least = np.array([first[f"z{i}"] for i in k])
            open_ = rz > 0
            # step sizes come as a row that is joined, not as literals, so that Spark compiles the step once and not every time
            scalars = [f"{c}{i}" for c in "at" for i in k]
            for _ in range(MOST_STEPS):
                if not open_.any():
                    break
                moved = both.join(now.select(F.col("id").alias("b"), *[f"p{i}" for i in k]), "b").groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"p{i}")).alias(f"o{i}") for i in k])
                q = [F.col("scale") * F.col(f"p{i}") - F.lit(self.smooth) * F.coalesce(f"o{i}", F.lit(0.0)) for i in k]
                now = write(now.join(moved, "id", "left").select("id", "scale", *[f"{c}{i}" for c in "xrp" for i in k], *[q[i].alias(f"q{i}") for i in k]), "cg")
                pairs = [("p", "q", False), ("r", "q", True), ("q", "q", True)]
                sums = now.agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}") / (F.col("scale") if scaled else F.lit(1.0))) for a, b, scaled in pairs for i in k]).first()
                pq, rq, qq = np.array(sums, float).reshape(len(pairs), -1)
                step = np.where(open_, rz / np.where(pq > 0, pq, 1.0), 0.0)
                new = np.maximum(rz - 2 * step * rq + step**2 * qq, 0.0)
                turn = np.where(open_ & (rz > 0), new / np.where(rz > 0, rz, 1.0), 0.0)
                told = F.broadcast(spark.createDataFrame([tuple(map(float, [*step, *turn]))], ", ".join(f"{c} double" for c in scalars)))  # one row
                rest = [F.col(f"r{i}") - F.col(f"a{i}") * F.col(f"q{i}") for i in k]
                now = now.crossJoin(told).select(
                    "id", "scale", *[(F.col(f"x{i}") + F.col(f"a{i}") * F.col(f"p{i}")).alias(f"x{i}") for i in k],
                    *[rest[i].alias(f"r{i}") for i in k], *[(rest[i] / F.col("scale") + F.col(f"t{i}") * F.col(f"p{i}")).alias(f"p{i}") for i in k],
                )
                rz = new
                open_ &= rz > tolerance**2 * least
            else:
                raise RuntimeError("the system didn't settle")
            return write(now.select("id", *[F.col(f"x{i}").alias(n) for i, n in enumerate(names)]), "solved", keep=True)

    def _solved(self, rights: Sequence[Column]) -> DataFrame:
        """(id, s0, ...): the solutions for expressions over the nodes, TOGETHER at a time."""
        out = self.nodes.select("id")
        for i in range(0, len(rights), TOGETHER):
            some = {f"s{j}": r for j, r in enumerate(rights[i : i + TOGETHER], i)}
            out = out.join(self.solve(self.nodes.select("id", *[r.alias(n) for n, r in some.items()]), list(some)), "id")
        return out

    def posterior(self, z0: DataFrame, observed: Sequence[tuple] = (), sigma2: float = 0.04, probes: int = 32, seed: int = 20260313) -> DataFrame:
        """(id, z, variance, error) of all items. z0: (id, z0); observed: (id, target, weight), at most MOST_OBSERVED. error: the standard
        error of the variance, 0 for observed items."""
        if len(observed) > MOST_OBSERVED:
            raise ValueError(f"{MOST_OBSERVED} observed items at most")
        ids = [k for k, _, _ in observed]
        sign = [F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(j), "id"), F.lit(2)) == 0, 1.0).otherwise(-1.0) for j in range(probes)]
        at = [F.when(F.col("id") == F.lit(k), 1.0).otherwise(0.0) for k in ids]
        solved = self._solved([*sign, *at])
        each = F.array(*[sign[j] * F.col(f"s{j}") for j in range(probes)])
        mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / probes
        error = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (max(1, probes - 1) * probes))
        before = F.greatest(mean, 1 / F.col("scale"))  # no variance is below that of the item with all others known
        out = solved.join(self._diagonal(), "id").join(z0, "id")
        if not observed:
            return out.select("id", F.col("z0").alias("z"), before.alias("variance"), error.alias("error"))
        own = [F.col(f"s{probes + j}") for j in range(len(ids))]
        met = {r["id"]: r for r in solved.join(z0, "id").where(F.col("id").isin(ids)).collect()}  # MOST_OBSERVED rows
        between = np.array([[met[k][f"s{probes + j}"] for j in range(len(ids))] for k in ids])
        inverse = np.linalg.inv(between + np.diag([sigma2 / max(float(w), 1e-4) for *_, w in observed]))
        taken = sum((own[i] * own[j] * F.lit(float(inverse[i, j])) for i in range(len(ids)) for j in range(len(ids))), F.lit(0.0))
        gain = inverse @ np.array([float(y) - met[k]["z0"] for k, y, _ in observed])  # the same columns carry the means
        shift = sum((own[j] * F.lit(float(gain[j])) for j in range(len(ids))), F.lit(0.0))
        for j, k in enumerate(ids):  # of these the column has the variance itself
            before, error = F.when(F.col("id") == F.lit(k), own[j]).otherwise(before), F.when(F.col("id") == F.lit(k), 0.0).otherwise(error)
        return out.select("id", (F.col("z0") + shift).alias("z"),F.greatest(before - taken, F.lit(1e-8)).alias("variance"), error.alias("error"))


@dataclass(frozen=True)
class Numbered:
    """rows: (id, no, z0), no from 0 to n - 1; edges: (a, b, w) by these numbers, each once; both written tables."""

    rows: DataFrame
    edges: DataFrame
    n: int
    smooth: float = 3.0
    prior: float = 0.05
    jitter: float = 1e-6

    def held(self) -> bool:
        return self.n <= HELD_NODES and self.edges.count() <= HELD_EDGES

    def _solved(self, at: Sequence[int], known: Sequence[float], probes: int, seed: int) -> DataFrame:
        """(no, which, value): the prior's solution for item at[which]; under -1, v * solve(v) summed over the probes of a group, when
        observations add `known` to the precision of the items at; under -2 the variance with all others known."""
        n, options, jobs = self.n, (self.smooth, self.prior, self.jitter), len(at) + probes
        groups = min(GROUPS, jobs)
        marks = self.edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"))  # without edges there are groups, too
        edges = self.edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w").unionByName(marks)
        edges = edges.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def told(which: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, n, SENT):
                some = x[i : i + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(some))), pa.array(np.full(len(some), which, np.int32)), pa.array(some)], names=["no", "which", "value"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, parts = None, []
            for b in batches:
                if b.num_rows:
                    group = b.column("group")[0].as_py()
                    parts.append([b.column(c).to_numpy().copy() for c in ("a", "b", "w")])
            if group is None:
                return
            graph = models.Graph(n, *(np.concatenate(c) for c in zip(*parts, strict=True)), *options)
            parts, total, extra = [], None, np.zeros(n)
            extra[list(at)] = known
            for j in range(group, jobs, groups):
                if j < len(at):
                    yield from told(j, graph.solve(np.eye(1, n, at[j])[0]))
                else:
                    v = np.random.Generator(np.random.PCG64([seed, j - len(at)])).integers(0, 2, n) * 2.0 - 1
                    total = v * graph.solve(v, extra, tolerance=1e-6) + (0.0 if total is None else total)
            if total is not None:
                yield from told(-1, total)
            if not group:
                yield from told(-2, 1 / (graph.smooth * graph.degree + graph.prior + graph.jitter + extra))

        return shipped(edges).repartitionById(groups, "group").sortWithinPartitions("a", "b").mapInArrow(run, "no long, which int, value double")

    def posterior(self, observed: Sequence[tuple] = (), sigma2: float = 0.04, probes: int = models.PROBES, seed: int = 20260313) -> DataFrame:
        """(id, z, variance) of all items. observed: (id, target, weight), no item twice. Without probes only the means are found."""
        if not probes and not observed:
            return self.rows.select("id", F.col("z0").alias("z"), F.lit(None).cast("double").alias("variance"))
        ids = [k for k, *_ in observed]
        met = {r["id"]: r for r in self.rows.where(F.col("id").isin(ids)).collect()} if ids else {}
        at = [met[k]["no"] for k in ids]
        if not self.held():
            z0 = self.rows.select(F.col("no").alias("id"), "z0")
            out = Field(z0.select("id"), self.edges, self.smooth, self.prior, self.jitter).posterior(z0, [(i, y, w) for i, (_, y, w) in zip(at, observed, strict=True)], sigma2, max(1, probes), seed)
            return self.rows.join(out.select(F.col("id").alias("no"), "z", "variance"), "no").select("id", "z", "variance")
        which, value = F.col("which"), F.col("value")
        own = F.transform(F.array_sort(F.collect_list(F.when(which >= 0, F.struct("which", "value")))), lambda x: x["value"])
        known = [max(float(w), 1e-4) / sigma2 for *_, w in observed]
        solved = self._solved(at, known, probes, seed).groupBy("no").agg(own.alias("own"), F.sum(F.when(which == -1, value)).alias("total"), F.max(F.when(which == -2, value)).alias("least"))
        solved = stored(solved, "solved")  # a row for each item
        there = {r["no"]: r["own"] for r in solved.where(F.col("no").isin(at)).collect()} if at else {}
        between = np.array([there[i] for i in at]).reshape(len(at), len(at))
        inverse = np.linalg.inv(between + np.diag([1 / x for x in known]).reshape(between.shape))
        gain = inverse @ np.array([float(y) - met[k]["z0"] for k, y, _ in observed])

        def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                columns, no = neighbours.matrix(b.column("own")), b.column("no").to_numpy()
                z0, total, least = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("z0", "total", "least"))
                variance = np.maximum(total / max(1, probes), least)
                for j, i in enumerate(at):  # of these the columns have the variance itself
                    own = no == i
                    variance[own] = columns[own, j] - ((columns[own] @ inverse) * columns[own]).sum(axis=1)
                variance = np.maximum(variance, 1e-8)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(z0 + columns @ gain), pa.array(variance)], names=["id", "z", "variance"])

        id_ = self.rows.schema["id"].dataType.simpleString()
        return shipped(self.rows.join(solved, "no").select("id", "no", "z0", "own", "total", "least")).mapInArrow(ended, f"id {id_}, z double, variance double")
