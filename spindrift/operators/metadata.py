"""Loosely typed metadata: melting, key matching, upserts, axes from fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranks import numbered


def melt_strings(df: DataFrame, key: str, fields: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    """(key, field, value) as trimmed strings, blanks dropped."""
    long = df.select(F.col(key), *[F.trim(F.col(f).cast("string")).alias(f) for f in fields]).unpivot([key], list(fields), name, value)
    return long.where(F.col(value).isNotNull() & (F.col(value) != ""))


def normalize_rows(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with a key; every cell trimmed, blanks null."""
    cell = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return df.select(*[cell(c).alias(c) for c in (key, *fields)]).where(F.col(key).isNotNull())


#: The forms under which a key is looked for, best first
def key_forms(key: Column) -> list[Column]:
    slashes = F.replace(key, F.lit("\\"), F.lit("/"))
    base = S.basename(slashes)
    return [f for k in (key, slashes, base, S.stem(base)) for f in (k, F.lower(k))]


def match_keys(rows: DataFrame, row_key: str, items: DataFrame, item_id: str) -> DataFrame:
    """Rows with the item that their key names; the best form wins, then the first item (by id); rows without one are dropped.

    A form of a row meets the smallest item id that registers the same form, so common forms cost one row on the items' side. Of equal
    forms of a key only the best one is looked for. The registry is as large as the items, which Spark can't tell from the size of a
    compressed file: it is never broadcast.
    """
    forms = lambda c: F.posexplode(F.array_distinct(F.array(*key_forms(c)))).alias("prio", "form")
    registry = items.select(F.col(item_id).alias("item_"), forms(F.col(item_id))).where("form IS NOT NULL").groupBy("form").agg(F.min("item_").alias("item_"))
    asked = rows.select("*", forms(F.col(row_key))).where("form IS NOT NULL")
    hit = asked.join(registry.hint("merge"), "form")
    best = hit.groupBy(*rows.columns).agg(F.min_by("item_", F.struct("prio", "item_")).alias(item_id if item_id not in rows.columns else "matched_id"))
    return best


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn_ = 1").drop("rn_")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row a key; non-blank new cells win, new keys are added. Old keys keep their first row (smallest cells in field order)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    has = lambda d, f: F.col(f).cast("string") if f in d.columns else F.lit(None).cast("string")
    a = old.select(F.col(key).alias("k_"), *[has(old, f).alias(f"o_{f}") for f in fields])
    b = new.select(F.col(key).alias("n_"), *[has(new, f).alias(f"w_{f}") for f in fields])
    j = a.join(b, F.col("k_") == F.col("n_"), "full_outer")
    return j.select(F.coalesce("k_", "n_").alias(key), *[F.coalesce(blank(F.col(f"w_{f}")), F.col(f"o_{f}")).alias(f) for f in fields])


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose keys come anew are dropped, the new ones added."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def ordered_bins(long: DataFrame, field: str, key: str, value: str) -> DataFrame:
    """coordinate of each item on a field's ordered values: (index + 1) / n plus a jitter of (u - 1) / 2n, where u is a hash of
    field and item; values are in numeric order if all parse, else in case-insensitive order. Label ticks are at (index + 0.75) / n.
    Values are numbered by range, so there may be as many as there are rows."""
    v = long.groupBy(value).agg(F.lit(1).alias("one_")).drop("one_")
    x = F.col(value).try_cast("double")
    numeric = v.agg(F.bool_and(x.isNotNull()).alias("num_"))
    told = v.crossJoin(F.broadcast(numeric))
    idx, n = numbered(told, [F.when(F.col("num_"), F.col(value).try_cast("double")), F.lower(value), F.col(value)], "idx")
    j = long.join(idx.select(F.col(value).alias("v_"), F.col("idx") - 1, F.lit(n).alias("n")).toDF("v_", "idx", "n"), F.col(value) == F.col("v_"))
    u = S.unit_hash(F.concat(F.lit(f"{field}|"), F.col(key).cast("string")))
    return j.select(*long.columns, S.clamp((F.col("idx") + 1) / F.col("n") + (u - 1) / (2 * F.col("n"))).alias("coord"), ((F.col("idx") + 0.75) / F.col("n")).alias("tick"))


def nearest_label(df: DataFrame, value: str, positions: Sequence[tuple[str, float]], out: str = "label") -> DataFrame:
    """The label whose position is nearest, the first one on ties. Labels are the few ticks of an axis."""
    arr = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(i).alias("i"), F.lit(n).alias("l")) for i, (n, p) in enumerate(positions)])
    d = F.transform(arr, lambda x: F.struct(F.abs(F.col(value) - x["p"]).alias("d"), x["i"].alias("i"), x["l"].alias("l")))
    return df.withColumn(out, F.array_min(d)["l"])


def asof_budget(requests: DataFrame, logged: DataFrame, by: Sequence[str], want: str, have: str) -> DataFrame:
    """The requested step if logged, else the largest below it, else the smallest."""
    j = requests.join(logged.select(*by, have).distinct(), list(by))
    return j.groupBy(*by, want).agg(F.coalesce(F.max(F.when(F.col(have) <= F.col(want), F.col(have))), F.min(have)).alias("resolved"))


def exact_then_basename(left: DataFrame, key: str, right: DataFrame, right_key: str, value: str) -> DataFrame:
    """Value by exact key, else by base name where that is unique on the right."""
    exact = right.select(F.col(right_key).alias("k_"), F.col(value).alias("v1_"))
    unique = right.groupBy(S.basename(F.col(right_key)).alias("b_")).agg(F.count("*").alias("c_"), F.min(value).alias("v2_")).where("c_ = 1").drop("c_")
    j = left.join(exact, F.col(key) == F.col("k_"), "left").withColumn("b0_", S.basename(F.col(key))).join(unique, F.col("b0_") == F.col("b_"), "left")
    return j.select(*left.columns, F.coalesce("v1_", "v2_").alias(value))


def segments(spans: DataFrame, by: str) -> DataFrame:
    """(by, seg_start, seg_end, score, active) from spans (by, start, end, score, active): the stretches between distinct
    boundaries, with the best score of the spans that hold them and whether any of those is active.

    Boundaries of a group are numbered, and a span is cut into the dyadic ranges that make it up, two a level at most; a stretch lies in
    one range a level. So spans and stretches meet at ranges, as n log n rows that are combined before they are shuffled: no span meets
    all the stretches that it holds, and a group is dealt out over as many tasks as it has ranges.
    """
    edges = spans.select(by, F.explode(F.array("start", "end")).alias("at")).where("at IS NOT NULL").distinct()
    edges, _ = numbered(edges, [F.col(by), F.col("at")], "no")
    first = edges.groupBy(F.col(by).alias("by_")).agg(F.min("no").alias("first_"))
    edges = edges.join(first, F.col(by).eqNullSafe(F.col("by_"))).select(by, "at", (F.col("no") - F.col("first_")).alias("no"))
    after = edges.select(F.col(by).alias("by_"), (F.col("no") - 1).alias("no_"), F.col("at").alias("seg_end"))
    seg = edges.join(after, F.col(by).eqNullSafe(F.col("by_")) & (F.col("no") == F.col("no_"))).select(by, F.col("at").alias("seg_start"), "seg_end", "no")
    levels = max(1, (seg.agg(F.max("no")).first()[0] or 0).bit_length())
    number = lambda c: edges.select(F.col(by).alias(f"by_{c}"), F.col("at").alias(f"at_{c}"), F.col("no").alias(f"no_{c}"))
    s = spans
    for c in ("start", "end"):
        s = s.join(number(c), F.col(by).eqNullSafe(F.col(f"by_{c}")) & (F.col(c) == F.col(f"at_{c}")))

    def ranges(level: int) -> Column:
        lo, hi = F.floor((F.col("no_start") + (1 << level) - 1) / (1 << level)), F.floor(F.col("no_end") / (1 << level))
        own = lambda odd, at: F.when((lo < hi) & (odd % 2 == 1), F.struct(F.lit(level).alias("level"), at.cast("long").alias("range")))
        return F.array(own(lo, lo), own(hi, hi - 1))

    held = s.select(by, "score", "active", F.explode(F.filter(F.flatten(F.array(*[ranges(i) for i in range(levels)])), lambda x: x.isNotNull())).alias("r"))
    held = held.groupBy(F.col(by).alias("by_"), F.col("r.level").alias("level"), F.col("r.range").alias("range")).agg(F.max("score").alias("score"), F.bool_or("active").alias("active"))
    at = F.inline(F.array(*[F.struct(F.lit(i).alias("level_"), F.floor(F.col("no") / (1 << i)).cast("long").alias("range_")) for i in range(levels)]))
    j = seg.select(by, "seg_start", "seg_end", at).join(held, F.col(by).eqNullSafe(F.col("by_")) & (F.col("level") == F.col("level_")) & (F.col("range") == F.col("range_")))
    return j.groupBy(by, "seg_start", "seg_end").agg(F.max("score").alias("score"), F.bool_or("active").alias("active"))


def is_discrete_axis(df: DataFrame, value: str, key: str, first: int = 600) -> DataFrame:
    """whether an axis holds few values: at most max(6, sqrt(n)) distinct thousandths among its first items."""
    head = df.orderBy(key).limit(first)
    return head.agg(F.count_distinct(F.round(F.col(value) * 1000)).alias("distinct"), F.count("*").alias("n")).withColumn("discrete", F.col("distinct") <= F.greatest(F.lit(6.0), F.sqrt("n")))


def export_join(rows: DataFrame, row_key: str, row_no: str, items: DataFrame, item_id: str) -> DataFrame:
    """Rows with the item that has their key: the id itself, else its lower-case base name, else its lower-case stem; the first
    item of each form wins."""

    def forms(c: Column) -> Column:
        base = S.basename(c)
        return F.array(*[F.struct(F.lit(i).alias("prio"), f.alias("form")) for i, f in enumerate((c, F.lower(base), F.lower(S.stem(base))))])

    registry = items.select(F.col(item_id), F.inline(forms(F.col(item_id)))).groupBy("prio", "form").agg(F.min(item_id).alias(item_id))
    hit = rows.select("*", F.inline(forms(F.col(row_key)))).join(registry.hint("merge"), ["prio", "form"])  # as large as the items: never broadcast
    return hit.groupBy(*rows.columns).agg(F.min_by(item_id, F.struct("prio", item_id)).alias(item_id))
