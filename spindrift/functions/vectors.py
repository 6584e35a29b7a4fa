"""Vector kernels over array columns; all arithmetic in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column, eps: float = 1e-8) -> Column:
    """V1."""
    n = norm(a) + F.lit(eps)
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """V2: in [-1, 1]; 0 for a zero vector."""
    c = dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))
    return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """V3: 1 where either vector is zero."""
    zero = (norm(a) <= 1e-8) | (norm(b) <= 1e-8)
    return F.when(zero, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - cosine(a, b)))


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def fuse(a: Column, b: Column, wa: float, wb: float) -> Column:
    """V4: both vectors side by side, scaled by the roots of their shares."""
    t = max(wa + wb, 1e-12)
    sa, sb = (wa / t) ** 0.5, (wb / t) ** 0.5
    return F.concat(F.transform(a.cast("array<double>"), lambda x: x * F.lit(sa)), F.transform(b.cast("array<double>"), lambda x: x * F.lit(sb)))


def mean_vector(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean by position, combined before the shuffle: (by, v)."""
    e = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return e.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def label_direction(df: DataFrame, vector: str, positive: Column) -> list[float]:
    """V5: mean of the positive rows less the mean of the others; one vector on the driver, as wide as the embedding."""
    rows = {r["p"]: r["v"] for r in mean_vector(df.withColumn("p", positive), vector, ["p"]).collect()}
    dim = len(next(iter(rows.values()), []))
    a, b = rows.get(True) or [0.0] * dim, rows.get(False) or [0.0] * dim
    return [x - y for x, y in zip(a, b, strict=True)]


def label_axis(dp: Column, dn: Column, max_dp: Column, max_dn: Column) -> Column:
    """Dn / (dn + dp); with labels of one side only 1 - dp / max, or dn / max; without labels 0.5."""
    inf = F.lit(float("inf"))
    return F.when((dp == inf) & (dn == inf), F.lit(0.5)).when(dn == inf, 1 - dp / F.greatest(max_dp, F.lit(1e-9))).when(dp == inf, dn / F.greatest(max_dn, F.lit(1e-9))).otherwise(dn / (dn + dp + F.lit(1e-9)))


def concept_positive(dp: Column, dn: Column, tolerance: float, max_dp: Column) -> Column:
    """With both sides dp < r * dn, r = 10 ** ((p - 50) / 50); with positives only dp <= p percent of the largest."""
    inf = F.lit(float("inf"))
    return F.when(dn == inf, dp <= max_dp * F.lit(tolerance / 100)).otherwise(dp < dn * F.lit(10 ** ((tolerance - 50) / 50)))


def rbf(a: Column, b: Column, length: float, amplitude: float) -> Column:
    """V17."""
    d2 = total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))
    return F.lit(max(1e-8, amplitude * amplitude)) * F.exp(-0.5 * d2 / F.lit(max(1e-6, length) ** 2))


def expected_level(df: DataFrame, vector: str, anchors: Sequence[Sequence[float]], scale: float = 12.0) -> DataFrame:
    """softmax(scale * cosine) over a few anchor vectors: the expected position in [0, 1] and the best anchor's position."""
    sims = F.array(*[cosine(F.col(vector), literal(a)) * F.lit(scale) for a in anchors])
    k = max(1, len(anchors) - 1)
    x = df.withColumn("s_", sims).withColumn("m_", F.array_max("s_")).withColumn("e_", F.transform("s_", lambda v: F.exp(v - F.col("m_"))))
    places = literal([i / k for i in range(len(anchors))])
    return x.withColumn("expected", dot(F.col("e_"), places) / total(F.col("e_"))).withColumn("argmax", (F.array_position("s_", F.col("m_")) - 1) / F.lit(float(k))).drop("s_", "m_", "e_")


def text_force(x: Column, y: Column, sim: Column, cx: float, cy: float, alpha: float) -> tuple[Column, Column]:
    """A pull towards a centre by the positive part of the similarity, clipped to [0, 1]."""
    pull = F.lit(alpha) * F.greatest(sim, F.lit(0.0))
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return clip(x + pull * (F.lit(cx) - x)), clip(y + pull * (F.lit(cy) - y))
