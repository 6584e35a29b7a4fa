"""Grouped reports and summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std_count(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A1: mean, sample deviation and count of each value; null keys form groups."""
    return df.groupBy(*by).agg(*[f(F.col(v)).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))])


def mean_sem(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A3: mean, and standard error where there are two values or more."""
    n = F.count(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("sem"), n.alias("n"))


def t_tail(t: float, dof: float) -> float:
    """P(T > t) of Student's t, by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    x = dof / (dof + t * t)

    def half(a: float, b: float, x: float) -> float:
        if x <= 0:
            return 0.0
        if x >= 1:
            return 1.0
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
        if x > (a + 1) / (a + b + 2):
            return 1 - half(b, a, 1 - x)
        tiny = 1e-300
        f = c = 1.0
        d = 0.0
        for i in range(400):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            f *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return front * (f - 1) / a

    p = 0.5 * half(dof / 2, 0.5, x)
    return p if t >= 0 else 1 - p


def t_test(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """A4: one-sided one-sample test that the mean of `delta` is above 0. One row a group reaches the probability function."""
    told = df.groupBy(*by).agg(F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("sd"), F.count(delta).alias("n")).withColumn("sem", F.col("sd") / F.sqrt("n"))

    @F.pandas_udf("double")
    def tail(mean: pd.Series, sem: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(m / s, k - 1) if k > 1 and s and s > 0 else None for m, s, k in zip(mean, sem, n, strict=True)], dtype="float64")

    return told.withColumn("p", tail("mean", "sem", F.col("n").cast("double")))


def pivot_mean(df: DataFrame, by: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """A5: means of one value with a column for each of the listed values."""
    return df.groupBy(*by).pivot(column, list(values)).agg(F.avg(value))


def pivot_distinct(df: DataFrame, by: Sequence[str], column: str, values: Sequence, key: str) -> DataFrame:
    """Distinct keys with a column for each of the listed values, 0 where there are none."""
    return df.groupBy(*by).pivot(column, list(values)).agg(F.count_distinct(key)).fillna(0)


def gain_over_best(df: DataFrame, ours: str, baselines: Sequence[str]) -> DataFrame:
    """Mean, median and share of wins of ours less the best baseline of the row."""
    gain = F.col(ours) - F.greatest(*[F.col(b) for b in baselines])
    return df.select(gain.alias("g")).agg(F.avg("g").alias("mean_gain"), F.median("g").alias("median_gain"), F.avg((F.col("g") > 0).cast("int")).alias("win_rate"))


def curve_area(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Trapezoid area over the span of x; a single point has its own value."""
    w = Window.partitionBy(*by).orderBy(x)
    s = df.select(*by, x, y, ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a_"))
    span = F.max(x) - F.min(x)
    return s.groupBy(*by).agg(F.when(span > 0, F.sum("a_") / F.nullif(span, F.lit(0))).otherwise(F.max(y)).alias("area"))


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's groups to n before it shuffles."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn_") <= n).drop("rn_")


def value_counts(df: DataFrame, column: str, at_least: int, most: int | None) -> DataFrame:
    """Values with a count of at_least or more, frequent ones first, at most `most`."""
    c = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= at_least).orderBy(F.col("n").desc(), column)
    return c.limit(most) if most else c


def infer_field_types(long: DataFrame, total: int) -> DataFrame:
    """(field, value) strings to type, coverage, ratio, distinct values. Numeric needs 85 % of the non-blank values (at least
    one) to parse; then 12 distinct values make it continuous, 3 ordinal; all else is categorical."""
    v = F.nullif(F.trim("value"), F.lit(""))
    x = v.try_cast("double")
    num = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    g = long.select("field", v.alias("v"), num.alias("x")).where(F.col("v").isNotNull()).groupBy("field").agg(F.count("v").alias("coverage"), F.count("x").alias("numbers"), F.count_distinct(F.round("x", 6)).alias("dx"), F.count_distinct(F.lower("v")).alias("unique_values"))
    need = F.greatest(F.lit(1), F.floor(F.col("coverage") * 0.85))
    kind = F.when((F.col("numbers") >= need) & (F.col("dx") >= 12), "continuous").when((F.col("numbers") >= need) & (F.col("dx") >= 3), "ordinal").otherwise("categorical")
    return g.select("field", kind.alias("type"), "coverage", (F.col("coverage") / F.lit(max(total, 1))).alias("coverage_ratio"), "unique_values")


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float, extra: Sequence[Column] = ()) -> DataFrame:
    """Equal bins over [lo, hi], the last one closed, values outside clamped, empty bins present."""
    width = (hi - lo) / bins or 1.0
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), *extra)
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").fillna(0, ["n"])


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """A37."""
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("weighted_mean"))


def progression(df: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """Per configuration the curve, last less first, mean, least step, number of decreases."""
    w = Window.partitionBy(*by).orderBy(step)
    s = df.select(*by, step, value, (F.col(value) - F.lag(value).over(w)).alias("d_"))
    return s.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(step, value))), lambda x: F.format_string("%.4f", x[value])), "|").alias("curve"), (F.max_by(value, step) - F.min_by(value, step)).alias("gain"), F.avg(value).alias("mean"), F.min("d_").alias("least_step"), F.count_if(F.col("d_") < -1e-9).alias("decreases"))


def compress_histogram(df: DataFrame, n: int, target: int) -> DataFrame:
    """N bins (bin, n, label) into `target`: bin k takes source bins floor(k*n/target) up to the next boundary, at least one;
    counts add up, up to three labels are joined, of more the first and the last are named."""
    k = F.explode(F.sequence(F.lit(0), F.lit(target - 1)))
    edges = df.sparkSession.range(1).select(k.alias("k")).withColumn("lo", F.floor(F.col("k") * n / target)).withColumn("hi", F.greatest(F.col("lo") + 1, F.floor((F.col("k") + 1) * n / target)))
    j = df.join(F.broadcast(edges), (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi")))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("bin", "label"))), lambda x: x["label"])
    g = j.groupBy("k").agg(F.sum("n").alias("n"), labels.alias("l"))
    return g.select("k", "n", F.when(F.size("l") <= 3, F.array_join("l", ", ")).otherwise(F.concat(F.element_at("l", 1), F.lit(" ... "), F.element_at("l", -1))).alias("label"))


def label_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, min, 5 %, mean, median, 95 %, max, population deviation."""
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), p(0.05).alias("p05"), F.avg(value).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each value column."""
    return df.unpivot(list(ids), list(values), name, value)
