"""Predicates and set algebra over items: slices, lassos, isolate and exclude, concept chains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def row_matches(pattern: str, cols: Sequence[str]) -> Column:
    """A case-insensitive pattern over the cells joined by blanks."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).rlike(f"(?i){pattern}")


def percent_slice(df: DataFrame, value: str, lo: float, hi: float, least: float = 0.5) -> DataFrame:
    """Rows whose value lies in [lo, hi] percent of the column's range; a slice narrower than `least` percent is no slice."""
    if hi - lo < least:
        return df
    span = df.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    x = df.crossJoin(F.broadcast(span))
    at = lambda p: F.col("lo_") + (F.col("hi_") - F.col("lo_")) * F.lit(p / 100.0)
    return x.where(F.col(value).between(at(lo), at(hi))).drop("lo_", "hi_")


def compose(items: DataFrame, key: str, slices: Sequence[tuple[str, DataFrame]], filters: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Items in every slice (the first one of each axis counts), then through the filters in order: isolate keeps, exclude drops."""
    seen: set[str] = set()
    for axis, ids in slices:
        if axis not in seen:
            seen.add(axis)
            items = items.join(ids, key, "left_semi")
    for mode, ids in filters:
        items = items.join(ids, key, "left_semi" if mode == "isolate" else "left_anti")
    return items


def in_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule on clamped coordinates; fewer than three corners hold nothing."""
    if len(points) < 3:
        return F.lit(False)
    x, y = S.clamp(x), S.clamp(y)
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 == y2:
            continue
        crosses = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        left = x < F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
        odd = odd + (crosses & left).cast("int")
    return odd % 2 == 1


def in_window(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float, margin: float = 0.0) -> Column:
    """Within the rectangle and its margin; y is counted from the top."""
    down = F.lit(1.0) - y
    return x.between(F.lit(x0 - margin), F.lit(x1 + margin)) & down.between(F.lit(y0 - margin), F.lit(y1 + margin))


def viewport(centre: float, size: float) -> tuple[float, float]:
    """A window of fixed size around a centre, pushed back into [0, 1]."""
    lo = min(max(centre - size / 2, 0.0), max(0.0, 1.0 - size))
    return lo, min(1.0, lo + size)


def sanitize_axes(coords: DataFrame, axis: str, key: str, value: str, valid: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Finite values clamped to [0, 1], of valid items; axes with fewer than `least` go."""
    x = coords.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < F.lit(float("inf")))).withColumn(value, S.clamp(F.col(value)))
    if valid is not None:
        x = x.join(valid, key, "left_semi")
    enough = x.groupBy(axis).agg(F.count("*").alias("c_")).where(F.col("c_") >= least).select(axis)
    return x.join(enough, axis, "left_semi")


def binary_mask(df: DataFrame, value: str, positives: Sequence[str] = (), out: str = "positive") -> DataFrame:
    """Listed values, else numbers above 0 where every row parses, else the words that stand for true."""
    if positives:
        return df.withColumn(out, F.trim(value).isin(*positives))
    num = S.parse_number(F.col(value))
    whole = df.agg(F.bool_and(num.isNotNull()).alias("all_"))
    words = F.lower(F.trim(value)).isin(*S.TRUE_WORDS, "positive", "pos")
    return df.crossJoin(F.broadcast(whole)).withColumn(out, F.when(F.col("all_"), num > 0).otherwise(words)).drop("all_")


def undefined_band(x: Column, width: float) -> Column:
    """P11."""
    return x.between(F.lit(max(0.0, 0.5 - width / 2)), F.lit(min(1.0, 0.5 + width / 2)))


def brush(df: DataFrame, strokes: DataFrame, radius: float, width: float, height: float) -> DataFrame:
    """Items within `radius` pixels of a stroke (no, px, py, label); the last label wins. Strokes are what a hand draws."""
    d2 = F.pow(F.col("x") * width - F.col("px"), 2) + F.pow(F.col("y") * height - F.col("py"), 2)
    hit = df.join(F.broadcast(strokes), d2 <= radius * radius)
    return hit.groupBy("id").agg(F.max_by("label", "no").alias("label"))


def bin_between(x: Column, bins: int, lo: int, hi: int) -> Column:
    """P16."""
    return F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).between(lo, hi)


def topmost(df: DataFrame, px: float, py: float) -> DataFrame:
    """Of the boxes (x0, y0, x1, y1) around a point the one drawn last."""
    hit = df.where((F.col("x0") <= px) & (F.col("x1") >= px) & (F.col("y0") <= py) & (F.col("y1") >= py))
    return hit.agg(F.max_by("id", "draw_order").alias("id"))


def select_named(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """The rows with the wanted names; a name that no row has is an error."""
    found = {r[0] for r in df.where(F.col(key).isin(*wanted)).select(key).distinct().collect()}
    missing = [w for w in wanted if w not in found]
    if missing:
        raise ValueError(f"no rows for {missing}")
    return df.where(F.col(key).isin(*wanted))


def ordered_union(parts: Sequence[DataFrame], value: str) -> DataFrame:
    """Values of all parts without case-insensitive repeats; the first one (by part, then n) stays. Parts have (n, value)."""
    every = reduce(lambda a, b: a.unionByName(b), [p.select(F.lit(i).alias("part_"), "n", value) for i, p in enumerate(parts)])
    best = every.groupBy(F.lower(value).alias("key_")).agg(F.min_by(F.struct("part_", "n", value), F.struct("part_", "n")).alias("b"))
    return best.select(F.col("b.part_").alias("part"), "b.n", F.col(f"b.{value}").alias(value))


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all parts, with the part's name; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(tag, F.lit(k)) for k, d in parts.items()])


def chain(sets: Sequence[DataFrame], operators: Sequence[str], key: str) -> DataFrame:
    """U4: a left fold of id sets by AND and OR."""
    out = sets[0].select(key).distinct()
    for op, s in zip(operators, sets[1:], strict=True):
        s = s.select(key).distinct()
        out = out.join(s, key, "left_semi") if op == "AND" else out.union(s).distinct()
    return out


def union_and_complement(items: DataFrame, key: str, positives: Sequence[DataFrame], negatives: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All that any positive selection holds; all items that no negative selection holds."""
    union = lambda ds: reduce(lambda a, b: a.union(b), [d.select(key) for d in ds]).distinct()
    return union(positives), items.join(union(negatives), key, "left_anti")
