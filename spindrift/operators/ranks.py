"""Rank and window operators. Whole-table ranks are found in two phases, so that no task sorts the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: a whole-table rank is worked off in stretches of the value range of about ROWS rows, or as many as MOST stretches leave; the first
#: look at a table is for STRETCHES of them
ROWS, STRETCHES, MOST = 4096, 200, 4000
#: values that follow each other by this or less are ties
TIE = 1e-12


def thinned(cuts: Sequence, parts: int) -> list:
    """Of the cuts into len(cuts) + 1 equal parts those that leave about `parts`."""
    return [cuts[i * (len(cuts) + 1) // parts - 1] for i in range(1, parts)]


def _cuts(df: DataFrame, value: str) -> list | None:
    """About the quantiles of a column's values, some of them equal where a value is frequent; None if there are no values."""
    at = lambda n: [i / n for i in range(1, n)]
    n, cuts = df.agg(F.count(value), F.percentile_approx(value, at(STRETCHES), 1000)).first()
    if not n:
        return None
    parts = min(MOST, max(1, n // ROWS))
    return thinned(cuts, parts) if parts <= STRETCHES else df.agg(F.percentile_approx(value, at(parts), 10 * parts)).first()[0]


def _stretch(df: DataFrame, value: str, on: str | None = None) -> Column | None:
    """Number of the value's stretch of the range; None if the table has no value. The bounds are about the quantiles of all
    rows; where they lie has no influence on results, as ties never part. `on`: the column to tell the stretch of."""
    cuts = _cuts(df, value)
    return None if cuts is None else _within(cuts, on or value)


def _within(cuts: Sequence, on: str) -> Column:
    """Number of the stretch between the cuts that a column lies in."""
    cuts = sorted(set(cuts))
    if cuts and isinstance(cuts[0], float):  # a cut lies a tie's width above a value, and no two cuts divide values that are tied
        cuts = [c + TIE for c, after in zip(cuts, [*cuts[1:], float("inf")], strict=True) if after - c > 2 * TIE]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(on) <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _ranked(df: DataFrame, value: str, by: Sequence[str], tie: float) -> DataFrame | None:
    """(by0_, ..., value_, low_, ties_, n_, c_): each distinct value of a group with the numbers of smaller, equal and all values, and of
    its own rows; None without values. Values are counted first; the counts are ranked by group and stretch, so neither a table nor a
    large group is sorted by one task."""
    stretch = _stretch(df, value, "value_")
    if stretch is None:
        return None
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(f"by{i}_") for i, b in enumerate(by)], F.col(value).alias("value_")).agg(F.count("*").alias("c_")).withColumn("part_", stretch)
    own = [f"by{i}_" for i in range(len(by))]
    before = Window.partitionBy(*own).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    offsets = counts.groupBy(*own, "part_").agg(F.sum("c_").alias("s_")).select(*[F.col(c).alias(f"o{c}") for c in own], F.col("part_").alias("opart_"), F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("before_"), F.sum("s_").over(Window.partitionBy(*own)).alias("n_"))
    inside = Window.partitionBy(*own, "part_").orderBy("value_")
    gap = F.col("value_").cast("double") - F.lag("value_").over(inside).cast("double")
    ranked = counts.select("*", F.coalesce(F.sum("c_").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in_"), F.when(gap <= tie, 0).otherwise(1).alias("new_"))
    run = Window.partitionBy(*own, "part_", "run_")
    ranked = ranked.withColumn("run_", F.sum("new_").over(inside)).withColumns({"in_": F.min("in_").over(run), "ties_": F.sum("c_").over(run)})
    same = (F.col("part_") == F.col("opart_")) if not own else reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in own], F.col("part_") == F.col("opart_"))
    ranked = ranked.join(offsets if own else F.broadcast(offsets), same)
    return ranked.select(*own, "value_", (F.col("in_") + F.col("before_")).alias("low_"), "ties_", "n_", "c_")


def with_rank(df: DataFrame, value: str, by: Sequence[str] = (), low: str = "rank_low", ties: str = "rank_ties", n: str = "rank_n", tie: float = TIE, counted: DataFrame | None = None) -> DataFrame:
    """df with the number of smaller values, of equal values (the row included) and of all, in its group or the whole table.
    Rows without a value have none of these and aren't counted. Values that follow each other by `tie` or less are equal. counted: the
    same rows as df, where they are cheaper to come by than df itself, which is then read once."""
    keep = df.columns
    ranked = _ranked(df if counted is None else counted, value, by, tie)
    if ranked is None:
        return df.select(*keep, *[F.lit(None).cast("long").alias(c) for c in (low, ties, n)])
    ranked = ranked.select(*[f"by{i}_" for i in range(len(by))], "value_", F.col("low_").alias(low), F.col("ties_").alias(ties), F.col("n_").alias(n))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"by{i}_")) for i, b in enumerate(by)], F.col(value) == F.col("value_"))
    out = df.join(ranked, on, "left").select(*keep, low, ties, n)
    return out.select(*keep, *[F.when(F.col(value).isNotNull(), F.col(c)).alias(c) for c in (low, ties, n)])


def rank_percentile(df: DataFrame, value: str, out: str = "pct", by: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """Mid-rank over n - 1; a single row has 0.5. counted: as with_rank has it."""
    r = with_rank(df, value, by, counted=counted)
    pct = F.when(F.col("rank_n") == 1, F.lit(0.5)).otherwise((F.col("rank_low") + (F.col("rank_ties") - 1) / 2) / F.nullif(F.col("rank_n") - 1, F.lit(0)))
    return r.withColumn(out, F.when(F.col("rank_n").isNotNull(), pct)).drop("rank_low", "rank_ties", "rank_n")


def average_rank(df: DataFrame, value: str, out: str = "avg_rank", by: Sequence[str] = ()) -> DataFrame:
    """1-based, ties share the mean."""
    r = with_rank(df, value, by)
    return r.withColumn(out, F.col("rank_low") + (F.col("rank_ties") + 1) / 2).drop("rank_low", "rank_ties", "rank_n")


def _crowded(cuts: Sequence) -> list:
    """Values that fill a stretch between these cuts by themselves, none of them near another."""
    often = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    near = {i for i in range(len(often) - 1) if float(often[i + 1]) - float(often[i]) <= 2 * TIE}
    return [v for i, v in enumerate(often) if i not in near and i - 1 not in near]


def row_numbers(df: DataFrame, value: str, tie: str | Sequence[str], out: str = "rn", descending: bool = False, first: Sequence[str] = ()) -> DataFrame:
    """1, 2, ... over the whole table by `first`, value, then tie: counted stretch by stretch, with offsets. Nulls of value come last.

    The rows of a value that fills a stretch by itself, and those without a value, are cut by the stretches of a numeric tie.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    keyed = df.withColumn("v_", -F.col(value) if descending else F.col(value))
    cuts = _cuts(keyed, "v_")
    stretch = None if cuts is None else _within(cuts, "v_")
    part = F.when(F.col("v_").isNull(), F.lit(MOST + 1)).otherwise(F.lit(0) if stretch is None else stretch)
    often = _crowded(cuts) if cuts else []
    finer = F.lit(0)
    if isinstance(df.schema[ties[0]].dataType, T.NumericType) and (often or stretch is None or keyed.where("v_ IS NULL").limit(1).count()):
        cut = _stretch(keyed, ties[0])
        if cut is not None:
            # the tie's stretch is told once, not for each crowded value, or the plan is as large as their product
            own = F.col("v_") + F.lit(0.0) if often and isinstance(often[0], float) else F.col("v_")  # a set of many tells -0.0 from 0.0
            finer = F.when(F.col("v_").isNull() | own.isin([v + 0.0 if isinstance(v, float) else v for v in often]), F.when(F.col(ties[0]).isNull(), F.lit(1)).otherwise(cut + 2))
            # in a stretch smaller values come before the crowded one, and those within a tie's width above it after
            for v in often if often and isinstance(often[0], float) else []:
                finer = finer.when((F.col("v_") > F.lit(v)) & (F.col("v_") <= F.lit(v + TIE)), F.lit(MOST + 3))
            finer = finer.otherwise(F.lit(0))
    keyed = keyed.withColumns({"part_": part, "finer_": finer})
    at = [*first, "part_", "finer_"]
    before = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    offsets = keyed.groupBy(*at).agg(F.count("*").alias("s_")).select(*[F.col(c).alias(f"o{i}_") for i, c in enumerate(at)], F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy(*at).orderBy("v_", *ties)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o{i}_")) for i, c in enumerate(at)])
    return keyed.withColumn("in_", F.row_number().over(inside)).join(offsets if first else F.broadcast(offsets), same).select(*df.columns, (F.col("in_") + F.col("before_")).alias(out))


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> tuple[DataFrame, int]:
    """(df with 1, 2, ... over the whole table by `order`, of any kinds of columns; number of rows). Rows are dealt out by range, sorted
    and written; a row's number is its place within its partition and the rows of the partitions before."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    rows = stored(rows, "numbered")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(F.shiftright("at_", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    if not before:
        return rows.withColumn(out, F.lit(None).cast("long")).drop("at_"), 0
    offsets = df.sparkSession.createDataFrame(before, "part_ long, before_ long")
    joined = rows.join(F.broadcast(offsets), F.shiftright("at_", 33) == F.col("part_"))
    return joined.select(*df.columns, (F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(out)), total


def descending_rank(df: DataFrame, value: str, tie: str, out: str = "rank_desc") -> DataFrame:
    """Distinct ranks 1..n, largest first, ties in order of `tie`."""
    return row_numbers(df, value, tie, out, descending=True)


def ntile(df: DataFrame, value: str, tie: str, bins: int, out: str = "bin") -> DataFrame:
    """Chunks as equal as can be, the larger ones first, without a single-task window."""
    n = df.count()
    r = row_numbers(df, value, tie, "rn_")
    small, extra = divmod(n, bins)
    i = F.col("rn_") - 1
    edge = extra * (small + 1)
    chunk = F.when(i < edge, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - edge) / max(small, 1))) if extra else F.floor(i / max(small, 1))
    return r.withColumn(out, (chunk + 1).cast("int")).drop("rn_")


def quantile(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation at p * (n - 1), p clamped to [0, 1]: (by, q: an array). Exact, from counted and ranked values, so
    that no task holds all values of a group."""
    ps = [min(1.0, max(0.0, p)) for p in probs]
    ranked = _ranked(df.select(*by, F.col(value).cast("double").alias(value)), value, by, -1.0)
    if ranked is None:
        return df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in ps])).alias("q"))  # no values: nulls
    at = [F.lit(p) * (F.col("n_") - 1) for p in ps]
    holds = lambda k: (F.col("low_") <= k) & (k < F.col("low_") + F.col("ties_"))
    found = [F.max(F.when(holds(f(x)), F.col("value_"))).alias(f"{f.__name__}{i}_") for i, x in enumerate(at) for f in (F.floor, F.ceil)]
    told = ranked.groupBy(*[f"by{i}_" for i in range(len(by))]).agg(F.first("n_").alias("n_"), *found)
    part = lambda i, x: F.col(f"floor{i}_") + (F.col(f"ceil{i}_") - F.col(f"floor{i}_")) * (x - F.floor(x))
    return told.select(*[F.col(f"by{i}_").alias(b) for i, b in enumerate(by)], F.array(*[part(i, x) for i, x in enumerate(at)]).alias("q"))


def zscore(df: DataFrame, value: str, out: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population deviation; a constant column is 0."""
    if by:
        w = Window.partitionBy(*by)
        m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
        return df.withColumn(out, F.when(s > 1e-12, (F.col(value) - m) / s).otherwise(F.lit(0.0)))
    told = df.agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"))
    return df.crossJoin(F.broadcast(told)).withColumn(out, F.when(F.col("s_") > 1e-12, (F.col(value) - F.col("m_")) / F.col("s_")).otherwise(F.lit(0.0))).drop("m_", "s_")


def min_max(df: DataFrame, value: str, out: str = "norm", flat: float = 0.5) -> DataFrame:
    """To [0, 1] by the column's range; a constant column is `flat`."""
    told = df.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    span = F.col("hi_") - F.col("lo_")
    return df.crossJoin(F.broadcast(told)).withColumn(out, F.when(F.col(value).isNull(), F.lit(None)).when(span > 1e-12, (F.col(value) - F.col("lo_")) / span).otherwise(F.lit(flat))).drop("lo_", "hi_")


def fill_gaps(df: DataFrame, at: str, value: str, by: Sequence[str] = (), out: str = "filled") -> DataFrame:
    """Missing values are interpolated between the nearest present ones; beyond the ends the nearest is carried. Each stretch of
    `at` is looked at by itself; what it lacks at its ends comes from the others' first and last values, one row a stretch."""
    stretch = _stretch(df, at)
    t = df.withColumn("part_", F.lit(0) if stretch is None else stretch)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(at).alias("a")))
    w = Window.partitionBy(*by, "part_").orderBy(at)
    t = t.withColumns({"lo_": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "hi_": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    ends = df.withColumn("part_", F.lit(0) if stretch is None else stretch).where(F.col(value).isNotNull()).groupBy(*by, "part_").agg(F.max_by(known, at).alias("last_"), F.min_by(known, at).alias("first_"))
    parts = t.select(*by, "part_").distinct().withColumnsRenamed({b: f"p{i}_" for i, b in enumerate(by)}).withColumnRenamed("part_", "ppart_")
    same = lambda x, y: reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{y}{i}_")) for i, b in enumerate(by)], F.col(x) == F.col(f"{y}part_"))
    over = Window.partitionBy(*[f"p{i}_" for i in range(len(by))]).orderBy("ppart_")
    told = parts.join(ends, same("part_", "p"), "left")
    told = told.select(*[f"p{i}_" for i in range(len(by))], "ppart_", F.last("last_", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"), F.first("first_", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after_"))
    t = t.join(told if by else F.broadcast(told), same("part_", "p")).withColumns({"lo_": F.coalesce("lo_", "before_"), "hi_": F.coalesce("hi_", "after_")})
    line = F.col("lo_.v") + (F.col("hi_.v") - F.col("lo_.v")) * (F.col(at) - F.col("lo_.a")) / F.nullif(F.col("hi_.a") - F.col("lo_.a"), F.lit(0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("lo_").isNull(), F.col("hi_.v")).when(F.col("hi_").isNull(), F.col("lo_.v")).otherwise(line)
    return t.select(*df.columns, filled.alias(out))


def kde(df: DataFrame, value: str, grid: int, bandwidth: float | None = None, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Gaussian kernel curve over a grid, peak 1. The kernel meets each distinct value once, and a task sends one row a grid point."""
    points = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    if bandwidth is None:
        n = df.where(F.col(value).isNotNull()).count()
        bandwidth = min(10.0, max(2.4, 70.0 / (n + 6) ** 0.5))
    x = F.lit(lo) + F.col("i") * F.lit((hi - lo) / (grid - 1))
    g = df.sparkSession.range(grid).select(F.col("id").alias("i")).withColumn("x", x)
    dense = points.crossJoin(F.broadcast(g)).groupBy("i", "x").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.lit(bandwidth), 2))).alias("d"))
    return dense.select("i", "x", (F.col("d") / F.max("d").over(Window.partitionBy())).alias("density"))
