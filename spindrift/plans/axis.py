"""The axis engine: a direction in embedding space, refined by moves. Items stay in Spark; the state is small and immutable.

An axis is created from a prior direction, takes moves (score, undefined, delete), and scores any items. apply() is a pure function
from state and event to state, so batch replay and streaming share it. Scores of linear models are native expressions; deviations
and the other models run as Arrow batches against the model's few parameters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ranks, selection, similarity
from ..session import stored
from ..workers import shipped
from . import graph, models


@dataclass(frozen=True)
class Options:
    mode: str = "gaussian"  # gaussian | rank | graph | piecewise | residual
    alpha: float = 1.0
    sigma2: float = 0.04
    beta: float = 1.0
    eta: float = 1.0
    anchor_k: int = 3
    anchor_delta: float = 0.15
    max_pairs: int = 224
    trust: float = 1.0
    gain: float = 1.0
    max_moves: int = 0
    experts: int = 3
    combine: str = "max"
    gated: bool = False
    margin: float = 0.05
    neighbours: int = 4
    residual_scale: float = 1.0
    residual_shift: float = 0.0


@dataclass(frozen=True)
class State:
    """targets: id to (target in [0, 1], weight), in order of first move; pairs: (winner, loser, weight), oldest first."""

    options: Options
    w0: tuple[float, ...]
    targets: dict[str, tuple[float, float]] = field(default_factory=dict)
    undefined: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str, float], ...] = ()

    def to_json(self) -> str:
        """Everything that scoring needs, for the same or another collection."""
        return json.dumps({"options": self.options.__dict__, "w0": list(self.w0), "targets": [[k, *v] for k, v in self.targets.items()], "undefined": list(self.undefined), "pairs": [list(p) for p in self.pairs]}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> State:
        d = json.loads(text)
        return State(Options(**d["options"]), tuple(d["w0"]), {k: (t, w) for k, t, w in d["targets"]}, tuple(d["undefined"]), tuple((a, b, w) for a, b, w in d["pairs"]))


def forget(state: State, item: str) -> State:
    """No move and no pair of the item stays."""
    return replace(state, targets={k: v for k, v in state.targets.items() if k != item}, pairs=tuple(p for p in state.pairs if item not in p[:2]))


def apply(state: State, kind: str, item: str, score: float = 0.0, current: float = 0.5, pairs: tuple[tuple[str, str, float], ...] = ()) -> State:
    """One event. score: 0..100; current: the item's present score in [0, 1]; pairs: what a rank move adds."""
    if kind in ("undefined", "exclude"):
        state = forget(state, item)
        return state if item in state.undefined else replace(state, undefined=(*state.undefined, item))
    if kind in ("delete", "remove"):
        return forget(state, item)
    o = state.options
    target = min(100.0, max(0.0, float(score))) / 100.0
    if item not in state.targets and 0 < o.max_moves <= len(state.targets):
        raise ValueError(f"no more than {o.max_moves} moves")
    weight = max(1e-3, o.trust + o.gain * abs(target - current))
    kept = (*state.pairs, *pairs)[-max(16, o.max_pairs) :]  # the oldest go first
    return replace(state, targets={**state.targets, item: (target, weight)}, undefined=tuple(u for u in state.undefined if u != item), pairs=kept)


class Axis:
    """An axis over items (key string, vector array). Items should be persisted or a table: each move is a scoring pass."""

    def __init__(self, items: DataFrame, key: str, vector: str, state: State):
        self.items, self.key, self.vector, self.state = items.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")), key, vector, state
        self.fitted: tuple[str, object] | None = None
        self.graph: graph.Numbered | tuple[models.Graph, list[str], np.ndarray] | None = None

    @staticmethod
    def create(items: DataFrame, key: str, vector: str, w0, **options) -> Axis:
        """M1."""
        return Axis(items, key, vector, State(Options(**options), tuple(float(x) for x in w0)))

    # --- parts of the state, as rows
    def prior(self) -> DataFrame:
        return self.items.withColumn("z0", V.cosine(F.col("v"), V.literal(self.state.w0)))

    def _rows(self, ids: list[str]) -> dict[str, tuple[np.ndarray, float]]:
        """Vectors and prior scores of a few items."""
        got = self.prior().where(F.col("id").isin(ids)).collect() if ids else []
        return {r["id"]: (np.array(r["v"]), float(r["z0"])) for r in got}

    def _targets(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        moved = [k for k in self.state.targets if k not in self.state.undefined]
        return moved, np.array([self.state.targets[k][0] for k in moved]), np.array([self.state.targets[k][1] for k in moved])

    def _prior_quantiles(self, ps: np.ndarray) -> np.ndarray:
        """A target is the quantile of the prior scores."""
        if not len(ps):
            return np.zeros(0)
        return np.array(self.prior().agg(F.percentile("z0", F.array(*[F.lit(float(p)) for p in ps])).alias("q")).first()["q"])

    def model(self):
        """M2, M4, M6, M7, M8: the fitted model of the present state. E6: it is fitted once for each signature of the state."""
        if self.fitted is None or self.fitted[0] != self.signature():
            self.fitted = self.signature(), self._fit()
        return self.fitted[1]

    def signature(self) -> str:
        return sha256(self.state.to_json().encode()).hexdigest()

    def _fit(self):
        o, w0 = self.state.options, np.array(self.state.w0)
        moved, p, weight = self._targets()
        if o.mode == "rank":
            rows = self._rows(sorted({x for a, b, _ in self.state.pairs for x in (a, b)}))
            pairs = [(a, b, w) for a, b, w in self.state.pairs if a in rows and b in rows]
            diff = np.array([rows[a][0] - rows[b][0] for a, b, _ in pairs]).reshape(len(pairs), len(w0))
            return models.fit_rank(w0, diff, np.array([w for *_, w in pairs]), o.alpha, o.eta)
        rows = self._rows(moved)
        at = [i for i, k in enumerate(moved) if k in rows]
        moved, p, weight = [moved[i] for i in at], p[at], weight[at]
        x = np.array([rows[k][0] for k in moved]).reshape(len(moved), len(w0))
        if o.mode == "residual":
            pct = {r["id"]: r["pct"] for r in self._prior_percent().where(F.col("id").isin(moved)).collect()} if moved else {}
            base = np.array([o.residual_scale * pct[k] + o.residual_shift for k in moved])
            return models.fit_residual(x, p - base, weight, self._lengthscale())
        y = self._prior_quantiles(p)
        if o.mode == "piecewise":
            return self._mixture(w0, moved, p, weight, y)
        if o.mode == "graph":
            return self._graph(), np.array([rows[k][1] for k in moved]), moved, y, weight
        return models.fit_gaussian(w0, x, y, weight, o.alpha, o.sigma2, o.beta)

    def _prior_percent(self) -> DataFrame:
        return ranks.rank_percentile(self.prior().select("id", "z0"), "z0", "pct")

    def _lengthscale(self, most: int = 96) -> float:
        """From `most` items, evenly spaced in the order of their ids."""
        ordered = stored(self.items.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()), "order")
        sizes = [(r["part"], r["count"]) for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()]
        n = sum(c for _, c in sizes)
        wanted, before = [], 0
        for part, c in sizes:
            wanted += [(part << 33) + i - before for i in sorted({round(k * (n - 1) / max(1, min(n, most) - 1)) for k in range(min(n, most))}) if before <= i < before + c]
            before += c
        picked = [r["id"] for r in ordered.where(F.col("at").isin(wanted)).collect()]
        return models.median_lengthscale([r["v"] for r in self.items.where(F.col("id").isin(picked)).orderBy("id").collect()])

    def _basis(self, k: int) -> np.ndarray:
        from ..operators.layout import _moments

        told = shipped(self.items.select("v")).mapInPandas(_moments, "n long, s binary, q binary").collect()
        n = sum(r["n"] for r in told)
        s, q = sum(np.frombuffer(r["s"]) for r in told), sum(np.frombuffer(r["q"]) for r in told)
        mean = s / n
        values, vectors = np.linalg.eigh(q.reshape(len(s), len(s)) / n - np.outer(mean, mean))
        return vectors[:, np.argsort(-values)[:k]].T

    def scalar_pairs(self) -> list[tuple[str, str, float]]:
        """The pairs that labels imply: between labels that differ by more than the margin, and between a label and the items that the
        prior puts just below and above its target."""
        o = self.state.options
        moved, p, weight = self._targets()
        best: dict[tuple[str, str], float] = {}

        def add(a: str, b: str, w: float) -> None:
            best[a, b] = max(best.get((a, b), 0.0), w)

        for i, a in enumerate(moved):
            for j in range(i + 1, len(moved)):
                d = p[i] - p[j]
                if abs(d) > o.margin:
                    add(*((a, moved[j]) if d > 0 else (moved[j], a)), (abs(d) + 1e-3) * float(np.sqrt(weight[i] * weight[j])))
        if moved:
            scores = self._prior_percent().where(~F.col("id").isin(list(self.state.undefined)) if self.state.undefined else F.lit(True)).select("id", F.col("pct").alias("score"))
            asked = self.items.sparkSession.createDataFrame([(m, float(t)) for m, t in zip(moved, p, strict=True)], "move string, target double")
            w = dict(zip(moved, weight, strict=True))
            for r in selection.anchors(asked, scores, o.anchor_k, o.anchor_delta).collect():
                add(*((r["move"], r["id"]) if r["side"] == "below" else (r["id"], r["move"])), 0.35 * float(w[r["move"]]))
        return [(a, b, w) for (a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0]))][: max(16, o.max_pairs)]

    def _mixture(self, w0: np.ndarray, moved: list[str], p: np.ndarray, weight: np.ndarray, y: np.ndarray) -> models.Mixture:
        o = self.state.options
        start = models.Mixture(models.initial_experts(w0, self._basis(max(1, o.experts - 1)), o.experts), o.combine, np.zeros((o.experts, len(w0))) if o.gated else None, np.zeros(o.experts) if o.gated else None)
        pairs = self.scalar_pairs()
        if not pairs:
            return start
        rows = self._rows(sorted({x for a, b, _ in pairs for x in (a, b)} | set(moved)))
        place = {k: i for i, k in enumerate(rows)}
        x = np.array([rows[k][0] for k in rows])
        return models.fit_mixture(start, w0, x, np.array([place[a] for a, _, _ in pairs]), np.array([place[b] for _, b, _ in pairs]), np.array([w for *_, w in pairs]), np.array([place[k] for k in moved], int), y, weight)

    def _graph(self) -> graph.Numbered | tuple[models.Graph, list[str], np.ndarray]:
        """It is built once for all moves. Beyond GRAPH_ITEMS it stays in tables."""
        if self.graph is None:
            self.graph = self._numbered_graph() if self.items.count() > models.GRAPH_ITEMS else self._small_graph()
        return self.graph

    def _numbered_graph(self) -> graph.Numbered:
        rows, n = ranks.numbered(self.prior().select("id", "v", "z0"), [F.col("id")], "no")
        rows = rows.withColumn("no", F.col("no") - 1)
        edges = graph.neighbour_edges(rows, "no", "v", min(self.state.options.neighbours, max(1, n - 1)))
        return graph.Numbered(stored(rows.select("id", "no", "z0"), "rows"), stored(edges, "edges"), n)

    def _small_graph(self) -> tuple[models.Graph, list[str], np.ndarray]:
        rows = self.prior().select("id", "z0", "v").orderBy("id")
        numbered, _ = ranks.numbered(self.items.select("id", "v"), [F.col("id")], "no")  # by range: no task holds all vectors
        numbered = numbered.withColumn("no", F.col("no") - 1)
        ids = [r["id"] for r in rows.select("id").collect()]
        z0 = np.array([r["z0"] for r in rows.select("z0").collect()])
        near = similarity.knn(numbered, numbered, "no", "v", min(self.state.options.neighbours, max(1, len(ids) - 1))).collect()
        src, dst, d = (np.array([f(r) for r in near]) for f in (lambda r: r["src"], lambda r: r["dst"], lambda r: min(2.0, max(0.0, 1 - r["sim"]))))
        w = np.exp(-d / max(float(d.mean()) if len(d) else 1.0, 1e-3))
        best: dict[tuple[int, int], float] = {}
        for a, b, x in zip(src, dst, w, strict=True):
            k = (int(min(a, b)), int(max(a, b)))
            best[k] = max(best.get(k, 0.0), float(x))
        e = np.array(list(best), int).reshape(-1, 2)
        return models.Graph(len(ids), e[:, 0], e[:, 1], np.array(list(best.values()))), ids, z0

    # --- scoring
    def scores(self, model=None) -> DataFrame:
        """(id, v, z, std) of all items."""
        o = self.state.options
        model = self.model() if model is None else model
        if o.mode == "graph":
            return self.items.join(self._field(model), "id").select("id", "v", "z", "std")
        if isinstance(model, models.Linear):
            z = V.cosine(F.col("v"), V.literal(model.mu)) + F.lit(model.b)
            return self._with_std(self.items.withColumn("z", z), model)
        if isinstance(model, models.Residual):
            base = self._prior_percent().select("id", (F.col("pct") * o.residual_scale + o.residual_shift).alias("base"))
            return self._with_std(self.items.join(base, "id").withColumn("z", F.col("base")).drop("base"), model)
        return self._with_std(self.items.withColumn("z", F.lit(0.0)), model)

    def _field(self, model, deviations: bool = True) -> DataFrame:
        """(id, z, std) of a graph axis; without deviations (id, z)."""
        built, _, moved, y, weight = model
        sigma2, columns = self.state.options.sigma2, ["id", "z", "std"] if deviations else ["id", "z"]
        if isinstance(built, graph.Numbered):
            out = built.posterior(list(zip(moved, y, weight, strict=True)), sigma2, models.PROBES if deviations else 0)
            return out.withColumn("std", F.sqrt("variance")).select(*columns)
        small, ids, z0 = built
        place = {k: i for i, k in enumerate(ids)}
        given = z0, np.array([place[k] for k in moved], int), y, weight, sigma2
        mean, variance = small.posterior(*given) if deviations else (small.mean(*given), 0.0)
        return self.items.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "z": mean, "std": np.sqrt(variance)})).select(*columns)

    def _with_std(self, df: DataFrame, model) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy()).astype(float)
                    if isinstance(model, models.Residual):
                        b = b.assign(z=b["z"] + model.correction(x))
                    elif isinstance(model, models.Mixture):
                        b = b.assign(z=model.scores(x)[0])
                    yield b.assign(std=model.std(x))

        return shipped(df).select("id", "v", "z").mapInPandas(run, "id string, v array<double>, z double, std double")

    def percent(self, scored: DataFrame | None = None) -> DataFrame:
        """(id, score) in [0, 1]: the rank percentile of z, at 12 digits."""
        s = self.scores() if scored is None else scored
        return ranks.rank_percentile(s.select("id", F.round("z", 12).alias("z")), "z", "score").select("id", "score")

    def _percent_of(self, item: str) -> float:
        """The score of one item: it takes two aggregations, and no order of the others."""
        scored = self._field(self.model(), deviations=False) if self.state.options.mode == "graph" else self.scores()
        z = scored.select("id", F.round("z", 12).alias("z"))
        own = z.where(F.col("id") == item).agg(F.max("z").alias("z")).first()["z"]
        tie = F.abs(F.col("z") - F.lit(own)) <= ranks.TIE
        low, ties, n = z.agg(F.count_if(~tie & (F.col("z") < F.lit(own))), F.count_if(tie), F.count("z")).first()
        return (low + (ties - 1) / 2) / (n - 1) if n > 1 else 0.5

    # --- moves
    def move(self, item: str, score: float = 0.0, kind: str = "score") -> Axis:
        """M9: the axis after one event. An unknown id is looked for by its base name, if that is unique."""
        if not self.items.where(F.col("id") == item).limit(1).count():
            base = item.rsplit("/", 1)[-1]
            found = self.items.where(F.element_at(F.split("id", "/"), -1) == base).select("id").limit(2).collect()
            if len(found) != 1:
                raise KeyError(item)
            item = found[0]["id"]
        current, pairs = 0.5, ()
        if kind == "score":
            if self.state.options.mode == "rank":
                now = self.percent()
                current = float(now.where(F.col("id") == item).first()["score"])
                pairs = self._move_pairs(now, item, min(100.0, max(0.0, score)) / 100, current)
            else:
                current = self._percent_of(item)
        after = Axis(self.items, "id", "v", apply(self.state, kind, item, score, current, pairs))
        after.graph = self.graph  # a move changes neither items nor prior
        return after

    def _move_pairs(self, now: DataFrame, item: str, target: float, current: float) -> tuple[tuple[str, str, float], ...]:
        """What a move says about others: above its neighbours below the target, below those above it, and past what it crossed."""
        o = self.state.options
        size = abs(target - current)
        weight = max(0.25, max(0.25, o.trust + o.gain * size) * (1 + 2 * size))
        open_ = now.where((F.col("id") != item) & (~F.col("id").isin(list(self.state.undefined)) if self.state.undefined else F.lit(True)))
        asked = now.sparkSession.createDataFrame([(item, float(target))], "move string, target double")
        out = [(item, r["id"], weight) if r["side"] == "below" else (r["id"], item, weight) for r in selection.anchors(asked, open_, o.anchor_k, min(0.45, max(0.01, o.anchor_delta))).orderBy("side", "d_", "id").collect()]
        most = max(2, 2 * o.anchor_k)
        crossed = open_.where(F.col("score").between(min(current, target), max(current, target))).select("id")
        n = crossed.count()
        if n:
            picked = selection.row_numbers(crossed.withColumn("k", F.lit(0)), "k", "id", "rn").where((F.col("rn") - 1) % max(1, n // most) == 0).orderBy("rn").limit(most).collect()
            out += [(item, r["id"], max(0.25, 0.9 * weight)) if target >= current else (r["id"], item, max(0.25, 0.9 * weight)) for r in picked]
        return tuple(out)

    def with_prior(self, w0, keep_moves: bool = True) -> Axis:
        """Other prompts: a new prior; the moves stay, the pairs are made anew from them."""
        fresh = Axis(self.items, "id", "v", replace(self.state, w0=tuple(float(x) for x in w0), pairs=(), targets=self.state.targets if keep_moves else {}))
        if keep_moves and self.state.options.mode == "rank":
            fresh = Axis(self.items, "id", "v", replace(fresh.state, pairs=tuple(fresh.scalar_pairs())))
        return fresh

    def project(self, items: DataFrame, key: str, vector: str) -> DataFrame:
        """Scores of other items with this model. Needs vectors of the same width; a graph has nothing to carry over."""
        if self.state.options.mode == "graph":
            raise ValueError("a graph axis can't be projected")
        other = Axis(items, key, vector, self.state)
        width = other.items.select(F.size("v").alias("n")).limit(1).first()
        if width and width["n"] != len(self.state.w0):
            raise ValueError("other width")
        return other.scores(self.model())

    # --- payload
    def payload(self, exemplars: int = 4, hotspots: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(items, deciles, hotspots): coordinates (z by its range), score of 100 and deviation of all items; diverse exemplars of
        the deciles of the defined items; the most uncertain ones around the middle."""
        s = stored(self.scores(), "scores")  # one scoring pass for what follows
        out = ranks.min_max(s.join(self.percent(s), "id"), "z", "coord").select("id", "coord", (F.col("score") * 100).alias("score100"), "std")
        defined = s.where(~F.col("id").isin(list(self.state.undefined))) if self.state.undefined else s
        d = s.join(self.percent(defined), "id").select("id", "v", "std", "score")
        return out, self._deciles(d, exemplars), self._hotspots(d, hotspots)

    def _deciles(self, d: DataFrame, k: int) -> DataFrame:
        b = d.withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int"))
        far = F.round(F.abs(F.col("score") - (F.col("bin") + F.lit(0.5)) / 10), 9)
        c = b.withColumn("far", far).withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy("far", "id"))).where("rn <= 50")
        c = c.withColumn("priority", 1 / (1 + F.col("far")))
        return selection.diverse_per_group(c, "bin", "id", "v", "priority", "rn", k).join(c.select("id", "bin", "score", "std"), ["bin", "id"])

    def _hotspots(self, d: DataFrame, k: int) -> DataFrame:
        p: Column = F.col("std") * F.exp(-F.abs(F.col("score") * 100 - 50) / 18)
        c = d.withColumn("priority", F.round(p, 12)).orderBy(F.col("priority").desc(), "id").limit(max(32, 6 * k)).withColumn("all", F.lit(0)).withColumn("rn", F.row_number().over(Window.partitionBy("all").orderBy(F.col("priority").desc(), "id")))
        return selection.diverse_per_group(c, "all", "id", "v", "priority", "rn", k).drop("all").join(c.select("id", "score", "std", "priority"), "id")
