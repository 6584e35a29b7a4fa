"""Window helpers beyond ranks: differences, first values, spines, curves, density grids, hash samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_difference(value: str, by: Sequence[str], order: str) -> Column:
    """Value less the one before it in its group."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))


def group_first(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """The group's first value in that order, at every row."""
    return F.first(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def at_every(df: DataFrame, steps: DataFrame) -> DataFrame:
    """df's rows at each of a few steps."""
    return df.crossJoin(F.broadcast(steps))


def height_on_curve(df: DataFrame, value: str, curve: DataFrame, lo: float, step: float, out: str = "height") -> DataFrame:
    """The curve (i, density) at each value, linear between grid points. The grid is small by its parameter."""
    n = curve.count()
    at = (F.col(value) - F.lit(lo)) / F.lit(step)
    a = curve.select(F.col("i").alias("ia_"), F.col("density").alias("ya_"))
    b = curve.select(F.col("i").alias("ib_"), F.col("density").alias("yb_"))
    p = df.withColumn("at_", at).withColumn("ia_", F.floor("at_")).withColumn("ib_", F.least(F.floor("at_") + 1, F.lit(n - 1)))
    p = p.join(F.broadcast(a), "ia_").join(F.broadcast(b), "ib_")
    return p.withColumn(out, F.col("ya_") + (F.col("yb_") - F.col("ya_")) * (F.col("at_") - F.floor("at_"))).drop("at_", "ia_", "ib_", "ya_", "yb_")


def density_grid(df: DataFrame, cells: int, radius: int, x: str = "x", y: str = "y") -> DataFrame:
    """Each point is shared among its four cells by distance, cells are blurred by a Gaussian in x and then in y with clamped
    edges, and scaled to a largest value of 1. Points only meet as sums of cells."""
    fx, fy = F.least(F.greatest(F.col(x), F.lit(0.0)), F.lit(1.0)) * (cells - 1), F.least(F.greatest(F.col(y), F.lit(0.0)), F.lit(1.0)) * (cells - 1)
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(fx.alias("fx"), fy.alias("fy")).withColumn("ix", F.floor("fx")).withColumn("iy", F.floor("fy"))
    u, v = F.col("fx") - F.col("ix"), F.col("fy") - F.col("iy")
    corner = lambda dx, dy, w: F.struct(F.least(F.col("ix") + dx, F.lit(cells - 1)).alias("gx"), F.least(F.col("iy") + dy, F.lit(cells - 1)).alias("gy"), w.alias("w"))
    grid = p.select(F.inline(F.array(corner(0, 0, (1 - u) * (1 - v)), corner(1, 0, u * (1 - v)), corner(0, 1, (1 - u) * v), corner(1, 1, u * v)))).groupBy("gx", "gy").agg(F.sum("w").alias("w"))
    from math import exp

    weights = [exp(-0.5 * (k / max(radius / 2, 1e-9)) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        # a cell gives to the cells that read it; those beyond an edge read the edge cell again
        reads = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("kw")) for k, w in zip(range(-radius, radius + 1), weights, strict=True)])
        spine = df.sparkSession.range(cells).select(F.col("id").alias("to")).select("to", F.inline(reads)).select("to", F.least(F.greatest(F.col("to") + F.col("k"), F.lit(0)), F.lit(cells - 1)).alias(axis), "kw")
        grid = grid.join(F.broadcast(spine), axis).groupBy(F.col("to").alias(axis), other).agg(F.sum(F.col("w") * F.col("kw")).alias("w"))
    return grid.select("gx", "gy", (F.col("w") / F.max("w").over(Window.partitionBy())).alias("density"))


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of seed and key: a sample that doesn't depend on the order of rows."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
