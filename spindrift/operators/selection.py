"""Sorts, limits, samples, and greedy selections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import shipped
from .aggregates import best_per_group
from .ranks import row_numbers


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def cap_pairs(pairs: DataFrame, cap: int) -> DataFrame:
    """The heaviest pairs (w, then i, j), at least 16."""
    return pairs.orderBy(F.col("w").desc(), "i", "j").limit(max(16, cap))


def keep_recent(df: DataFrame, by: Sequence[str], seq: str, cap: int) -> DataFrame:
    """The most recent rows of each group."""
    return best_per_group(df, by, [F.col(seq).desc()], cap)


def anchors(moves: DataFrame, scores: DataFrame, k: int, band: float) -> DataFrame:
    """For each move (move, target) the k items nearest to its target in score on either side, within the band; where the band
    is empty, on the whole side. scores: (id, score). Moves are few; they are broadcast."""
    j = scores.join(F.broadcast(moves), (F.col("id") != F.col("move")) & (F.col("score") != F.col("target")))
    d = F.round(F.abs(F.col("score") - F.col("target")), 9)
    j = j.withColumn("side", F.when(F.col("score") < F.col("target"), "below").otherwise("above")).withColumn("d_", d)
    inside = (F.col("side") == "below") & (F.col("score") >= F.col("target") - band) | (F.col("side") == "above") & (F.col("score") <= F.col("target") + band)
    # nearest first, so those inside the band come before all others, and are all that stays if there are any
    top = best_per_group(j.withColumn("in_", inside), ["move", "side"], [F.col("d_"), F.col("id")], k)
    any_in = F.max("in_").over(Window.partitionBy("move", "side"))
    return top.withColumn("any_", any_in).where("NOT any_ OR in_").drop("any_", "in_")


def next_query(items: DataFrame, queried: DataFrame, key: str, policy: str, uncertainty: str = "u", novelty: str = "nov", seed: str = "seed") -> DataFrame:
    """T4: the item to ask about next, the queried ones excluded. random goes by hash; hybrid is the scaled uncertainty times
    (0.5 + the scaled novelty)."""
    open_ = items.join(queried.select(key).distinct(), key, "left_anti")
    if policy == "random":
        return open_.orderBy(hash_order(key, seed), key).limit(1)
    if policy in ("uncertainty", "diversity"):
        return open_.orderBy(F.col(uncertainty if policy == "uncertainty" else novelty).desc(), key).limit(1)
    span = open_.agg(F.min(uncertainty).alias("ul"), F.max(uncertainty).alias("uh"), F.min(novelty).alias("nl"), F.max(novelty).alias("nh"))
    scaled = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(0.0))
    s = scaled(uncertainty, "ul", "uh") * (0.5 + scaled(novelty, "nl", "nh"))
    return open_.crossJoin(F.broadcast(span)).withColumn("score", s).orderBy(F.col("score").desc(), key).limit(1).drop("ul", "uh", "nl", "nh")


def representatives(df: DataFrame, by: str, kind: str, order: str, quota: int) -> DataFrame:
    """T5: per group one of each kind first, in order of kind, then others until the quota."""
    first = F.row_number().over(Window.partitionBy(by, kind).orderBy(order))
    d = df.withColumn("f_", F.when(first == 1, 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("f_", F.when(F.col("f_") == 0, F.col(kind)), order))
    return d.withColumn("r_", rank).where(F.col("r_") <= quota).drop("f_", "r_")


def diverse(vectors: np.ndarray, priority: np.ndarray, k: int) -> list[int]:
    """Positions of a greedy diverse pick: the largest priority first, then the largest 0.72 * priority + 0.28 * least cosine
    distance to the picked; priorities are scaled to [0, 1], the first wins on ties."""
    n = len(vectors)
    if n <= k:
        return list(range(n))
    p = priority - priority.min()
    p = p / p.max() if p.max() > 1e-8 else np.ones(n)
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.maximum(norm, 1e-8)[:, None]
    picked = [int(p.argmax())]
    far = np.full(n, np.inf)
    while len(picked) < k:
        d = np.where((norm > 1e-8) & (norm[picked[-1]] > 1e-8), np.maximum(0.0, 1 - np.clip(unit @ unit[picked[-1]], -1, 1)), 1.0)
        far = np.minimum(far, d)
        score = 0.72 * p + 0.28 * far
        score[picked] = -np.inf
        picked.append(int(score.argmax()))
    return picked


def diverse_per_group(candidates: DataFrame, by: str, key: str, vector: str, priority: str, order: str, k: int) -> DataFrame:
    """T6 for each group of a bounded candidate list (tens of rows): key with its place in the pick."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, ignore_index=True)
        at = diverse(np.stack(g[vector].to_numpy()).astype(float), g[priority].to_numpy(float), k)
        return pd.DataFrame({by: g[by].iloc[0], key: g[key].to_numpy()[at], "place": np.arange(1, len(at) + 1)})

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (by, key)}
    return shipped(candidates).groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, {key} {kinds[key]}, place long")


def farthest_points(df: DataFrame, key: str, x: str, y: str, k: int) -> list[str]:
    """Ids, the farthest from the centroid first, then each time the one whose least distance to the picked is largest; ties by
    id. One distributed pass for each pick; only the picked points are on the driver."""
    pts = df.select(key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cx, cy = pts.agg(F.avg(x), F.avg(y)).first()
    if cx is None:
        return []
    d = lambda a, b: F.pow(F.col(x) - F.lit(a), 2) + F.pow(F.col(y) - F.lit(b), 2)
    picked = [pts.orderBy(F.round(d(cx, cy), 12).desc(), key).first()]
    while picked[0] is not None and len(picked) < k:
        least = F.least(*[d(p[x], p[y]) for p in picked]) if len(picked) > 1 else d(picked[0][x], picked[0][y])
        row = pts.where(~F.col(key).isin([p[key] for p in picked])).orderBy(F.round(least, 12).desc(), key).first()
        if row is None:
            break
        picked.append(row)
    return [p[key] for p in picked if p is not None]


def evenly_spaced(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """K rows at even steps of an order, both ends included."""
    n = df.count()
    want = sorted({round(i * (n - 1) / max(1, k - 1)) + 1 for i in range(min(k, n))})
    return row_numbers(df, order, tie, "rn_").where(F.col("rn_").isin(want))


def low_mid_high(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """K lowest, k highest, and k nearest the middle rank of those left, with their slot."""
    n = df.count()
    r = row_numbers(df, value, tie, "rn_")
    low, high = F.col("rn_") <= k, F.col("rn_") > n - k
    ends = r.where(low | high).withColumn("slot", F.when(low, "low").otherwise("high"))
    mid = r.where(~(low | high)).orderBy(F.abs(F.col("rn_") - (n + 1) / 2), "rn_").limit(k).withColumn("slot", F.lit("median"))
    return ends.unionByName(mid)


def balanced_sample(df: DataFrame, label: str, key: str, seed: str, limit: int | None = None) -> DataFrame:
    """One of each label in turn, in hash order within a label, until the limit; of no label more than the limit are ranked
    after the shuffle."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key, seed), key))
    d = df.withColumn("turn", turn)
    return d.where(F.col("turn") <= limit).orderBy("turn", label).limit(limit) if limit else d


def near_percentile(df: DataFrame, value: str, tie: str, target: float, used: Sequence = ()) -> DataFrame:
    """The unused row whose rank is nearest to a percentile."""
    n = df.count()
    at = 1 + target * (n - 1)
    r = row_numbers(df, value, tie, "rn_")
    return r.where(~F.col(tie).isin(list(used)) if used else F.lit(True)).orderBy(F.abs(F.col("rn_") - F.lit(at)), "rn_").limit(1)


def calibration_examples(df: DataFrame, key: str, value: str, targets: Sequence[float]) -> DataFrame:
    """For each target in turn the nearest row that no target before it took; when all rows are taken, any row.

    The k nearest rows of each target are enough for k targets, so at most k * k rows reach the driver.
    """
    k = len(targets)
    near = [df.select(key, value).orderBy(F.abs(F.col(value) - F.lit(float(t))), key).limit(k).collect() for t in targets]
    used: set = set()
    out = []
    for t, rows in zip(targets, near, strict=True):
        row = next((r for r in rows if r[key] not in used), rows[0] if rows else None)
        if row is not None:
            used.add(row[key])
            out.append((float(t), row[key], float(row[value])))
    return df.sparkSession.createDataFrame(out, f"target double, {key} {df.schema[key].dataType.simpleString()}, {value} double")


def sort_by_distance(df: DataFrame, key: str, vector: str, ref) -> DataFrame:
    """Ascending Euclidean distance to one row's vector; an unknown row leaves df as it is."""
    found = df.where(F.col(key) == ref).select(F.col(vector).cast("array<double>").alias("ref_")).limit(1)
    if not found.count():
        return df
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.col("ref_"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return df.crossJoin(F.broadcast(found)).withColumn("distance", d).drop("ref_").orderBy("distance", key)
