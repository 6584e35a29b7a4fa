"""What can be plugged in: registries, axis scorers, labelling sessions, prompt variants, brush strategies, extractors."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..workers import shipped
from . import models, study
from .axis import Axis, Options, State, apply


class Registry[Entry]:
    """Named entries in order of registration; other names for them; asking for an unknown one says what there is."""

    def __init__(self, kind: str):
        self.kind, self.entries, self.aliases = kind, {}, {}

    def add(self, name: str, entry: Entry, *aliases: str) -> Entry:
        if any(n.lower() in (*self.entries, *self.aliases) for n in (name, *aliases)):
            raise ValueError(f"{self.kind} {name!r} is there already")
        self.entries[name.lower()] = entry
        self.aliases |= {a.lower(): name.lower() for a in aliases}
        return entry

    def register(self, name: str, *aliases: str) -> Callable[[Entry], Entry]:
        return lambda entry: self.add(name, entry, *aliases)

    def __getitem__(self, name: str) -> Entry:
        key = self.aliases.get(name.strip().lower(), name.strip().lower())
        if key not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.entries)}")
        return self.entries[key]

    def names(self) -> list[str]:
        return list(self.entries)


class Scorer(Protocol):
    """One kind of axis model. A state is a value; items are a table of (id, v)."""

    def begin(self, w0: Sequence[float]) -> State: ...

    def feedback(self, items: DataFrame, state: State, events: Iterable[tuple[str, float, str]]) -> State:
        """The state after events (id, score of 100, kind)."""

    def score(self, items: DataFrame, state: State) -> DataFrame:
        """(id, z, std)"""

    def export(self, state: State) -> str: ...

    def restore(self, text: str) -> State: ...


@dataclass(frozen=True)
class AxisScorer:
    """The engine's models as scorers."""

    options: Options

    def begin(self, w0: Sequence[float]) -> State:
        return State(self.options, tuple(float(x) for x in w0))

    def feedback(self, items: DataFrame, state: State, events: Iterable[tuple[str, float, str]]) -> State:
        axis = Axis(items, "id", "v", state)
        for item, score, kind in events:
            axis = axis.move(item, score, kind)
        return axis.state

    def score(self, items: DataFrame, state: State) -> DataFrame:
        return Axis(items, "id", "v", state).scores().select("id", "z", "std")

    def export(self, state: State) -> str:
        return state.to_json()

    def restore(self, text: str) -> State:
        return State.from_json(text)


class CosineScorer(AxisScorer):
    """The prior alone: moves are kept, but change no score."""

    def feedback(self, items: DataFrame, state: State, events: Iterable[tuple[str, float, str]]) -> State:
        for item, score, kind in events:
            state = apply(state, kind, item, score)
        return state

    def score(self, items: DataFrame, state: State) -> DataFrame:
        return items.select("id", V.cosine(F.col("v"), V.literal(state.w0)).alias("z"), F.lit(0.0).alias("std"))


SCORERS: Registry[Scorer] = Registry("scorer")
for _mode in ("gaussian", "rank", "graph", "piecewise", "residual"):
    SCORERS.add(_mode, AxisScorer(Options(mode=_mode)))
SCORERS.add("cosine", CosineScorer(Options()), "prior")


#: fits of a session: (labelled vectors, labels in [0, 1], prior scores of the labelled) to a function of (vectors, prior scores)
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class Session:
    """A method that learns from one label after the other. Labels are what a person gives; predictions run over all items."""

    fit: Fit
    prior: tuple[float, ...]
    labels: tuple[tuple[str, tuple[float, ...], float], ...] = field(default=())

    def observe(self, item: str, vector: Sequence[float], label: float) -> Session:
        """A second label of an item takes the place of the first."""
        kept = tuple(x for x in self.labels if x[0] != item)
        return replace(self, labels=(*kept, (item, tuple(float(v) for v in vector), float(label))))

    def predict(self, items: DataFrame) -> DataFrame:
        """(id, score): the prior scores as long as nothing is labelled."""
        w0, unit = np.array(self.prior), models.unit
        of = lambda x: (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)) @ unit(w0)
        x, y = np.array([v for _, v, _ in self.labels]), np.array([label for *_, label in self.labels])
        model = self.fit(x, y, of(x)) if len(y) else lambda x, s: s

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = np.stack(b["v"].to_numpy()).astype(float)
                    yield pd.DataFrame({"id": b["id"], "score": model(v, of(v)).astype(float)})

        return shipped(items.select("id", "v")).mapInPandas(run, "id string, score double")


def _linear(solve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]]) -> Fit:
    def fit(x: np.ndarray, y: np.ndarray, s: np.ndarray):
        w, b = solve(x, y)
        return lambda x, s: x @ w + b

    return fit


def _affine(x: np.ndarray, y: np.ndarray, s: np.ndarray):
    a, b = study.prior_affine(s, y)
    return lambda x, s: a * s + b


def _pairwise(x: np.ndarray, y: np.ndarray, s: np.ndarray, pull: float = 1.0, rounds: int = 200):
    """A direction that ranks labelled pairs, drawn to the prior: logistic loss of the differences, by gradient steps."""
    i, j = np.nonzero(y[:, None] > y[None] + 1e-9)
    diff = x[i] - x[j]
    start = np.linalg.lstsq(x, s, rcond=None)[0] if len(x) else np.zeros(x.shape[1])
    w = np.zeros(x.shape[1])
    step = 1.0 / (pull + 0.25 * float((diff**2).sum()) / max(1, len(diff)) + 1e-9)
    for _ in range(rounds if len(diff) else 0):
        margin = diff @ (start + w)
        w -= step * (pull * w / max(1, len(diff)) - (diff * (1 / (1 + np.exp(np.clip(margin, -30, 30))))[:, None]).mean(axis=0))
    return lambda x, s: s + x @ w


SESSIONS: Registry[Fit] = Registry("session")
SESSIONS.add("prior", lambda x, y, s: lambda x, s: s)
SESSIONS.add("ridge", _linear(study.ridge), "label only")
SESSIONS.add("ols", _linear(study.ols))
SESSIONS.add("bayesian ridge", _linear(study.bayesian_ridge))
SESSIONS.add("prior affine", _affine)
SESSIONS.add("prior pairwise", _pairwise)


def session(method: str, prior: Sequence[float]) -> Session:
    return Session(SESSIONS[method], tuple(float(x) for x in prior))


# A concept's high and low texts, one variant of prompts each
Prompts = Callable[[str, str, str], tuple[list[str], list[str]]]
PROMPTS: Registry[Prompts] = Registry("prompt variant")
PROMPTS.add("anchors", lambda concept, high, low: ([high], [low]))
PROMPTS.add("template", lambda concept, high, low: ([f"an image that is {high}"], [f"an image that is {low}"]))
PROMPTS.add("ensemble", lambda concept, high, low: ([t.format(high) for t in ("{}", "a photo of {}", "something {}")], [t.format(low) for t in ("{}", "a photo of {}", "something {}")]))
PROMPTS.add("concept", lambda concept, high, low: ([f"{concept}: {high}"], [f"{concept}: {low}"]))


def prompt_rows(concepts: DataFrame, concept: str, high: str, low: str, variants: Sequence[str]) -> DataFrame:
    """(concept, variant, side, no, text) of the concepts' prompts: as many rows as a person has named."""
    kinds = [PROMPTS[v] for v in variants]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(c, v, side, n, text) for c, h, low_ in zip(b[concept], b[high], b[low], strict=True) for v, k in zip(variants, kinds, strict=True) for side, texts in zip(("high", "low"), k(c, h, low_), strict=True) for n, text in enumerate(texts)]
            yield pd.DataFrame(out, columns=["concept", "variant", "side", "no", "text"])

    return shipped(concepts.select(concept, high, low)).mapInPandas(run, "concept string, variant string, side string, no long, text string")


# Which items a brush at a point labels: (x and y in pixels of an item, centre, radius) to a condition
Brush = Callable[[Column, Column, tuple[float, float], float], Column]
BRUSHES: Registry[Brush] = Registry("brush")
BRUSHES.add("disc", lambda x, y, at, r: F.pow(x - at[0], 2) + F.pow(y - at[1], 2) <= r * r)
BRUSHES.add("square", lambda x, y, at, r: (F.abs(x - at[0]) <= r) & (F.abs(y - at[1]) <= r))
BRUSHES.add("diamond", lambda x, y, at, r: F.abs(x - at[0]) + F.abs(y - at[1]) <= r)


def brushed(items: DataFrame, centre: tuple[float, float], radius: float, width: float, height: float, strategy: str | Brush = "disc") -> DataFrame:
    """The ids of the items (id, x, y in [0, 1]) that the strategy labels."""
    brush = BRUSHES[strategy] if isinstance(strategy, str) else strategy
    return items.where(brush(F.col("x") * width, F.col("y") * height, centre, radius)).select("id")


# Functions that make a vector of an item's pixels (rows of r, g, b in [0, 255]); made once in each worker, behind a lock
Extractor = Callable[[np.ndarray], np.ndarray]
EXTRACTORS: Registry[Callable[[], Extractor]] = Registry("extractor")
EXTRACTORS.add("means", lambda: lambda px: px.mean(axis=0) / 255)
EXTRACTORS.add("histogram", lambda: lambda px: np.concatenate([np.bincount(np.minimum(px[:, c].astype(int) // 32, 7), minlength=8) / len(px) for c in range(3)]))
_MADE: dict[str, Extractor] = {}
_LOCK = threading.Lock()


def extractor(name: str) -> Extractor:
    with _LOCK:
        if name not in _MADE:
            _MADE[name] = EXTRACTORS[name]()
        return _MADE[name]


def embed(pixels: DataFrame, item: str, method: str, *channels: str) -> DataFrame:
    """(item, v): the extractor's vector of each item's pixels. The pixels of an item meet in one row."""
    EXTRACTORS[method]  # an unknown one is an error here, not in a worker
    rows = pixels.groupBy(item).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in channels])).alias("px"))
    schema = T.StructType([rows.schema[item], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f: Any = extractor(method)
        for b in batches:
            yield pd.DataFrame({item: b[item], "v": [f(np.stack(p)).tolist() for p in b["px"]]})

    return shipped(rows).mapInPandas(run, schema)
