"""Line dedup by distinct-site spread, in DataFrame functions only.

Each line that has a word is known by a 128-bit hash. One aggregation merges a HyperLogLog sketch of the sites (sources) of each
line, with the smallest document id that has it; sketches are built and merged before the shuffle, so a line that stands in a
third of all rows costs one small row a task. Lines whose estimate lies near the threshold are counted exactly by their distinct
(line, site) pairs; the others are safely on one side. A line with SITES sites or more is cross-site boilerplate: it stays in
its first document (smallest id) and goes from all others. Nothing else of a text changes: the other lines keep their order.

Nulls: a null text has no lines and stays null; a null source is a site of its own; a row without id is never a line's first
document. Rows that share an id count as one document. Blank lines are never boilerplate. A text whose lines all go is left
empty, its row stays. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_small, materialize, scratch

SITES = 8
#: log2 of the sketch's registers: a standard error of 1.6 %. Estimates within NEAR of the threshold are counted exactly.
REGISTERS, NEAR = 12, 0.10
WORD = r"[^\x20\x09-\x0D]"


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def spread(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """(lines, boilerplate): thin (id, site, line) rows, and (line, first) of the lines with `sites` sites or more."""
    lines = df.select(F.col(key).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"), F.explode(F.split(F.col(text), "\n", -1)).alias("words"))
    lines = materialize(lines.where(F.col("words").rlike(WORD)).select("id", "site", _key(F.col("words")).alias("line")), "lines")
    by = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", REGISTERS)).alias("about"), F.min("id").alias("first"))
    low, high = sites * (1 - NEAR) - 1, sites * (1 + NEAR) + 1
    by = materialize(by.where(F.col("about") >= low), "spread")
    near = by.where(F.col("about") <= high)
    exact = join_small(lines.select("line", "site"), near.select("line"), "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= sites)
    certain = by.where(F.col("about") > high).select("line", "first")
    return lines, materialize(certain.unionByName(near.join(exact, "line", "left_semi").select("line", "first")), "boilerplate")


def _drops(df: DataFrame, key: str, text: str, site: str, sites: int) -> DataFrame:
    """(id, drop: the lines that go from the document)."""
    lines, boilerplate = spread(df, key, text, site, sites)
    hits = join_small(lines, boilerplate, "line").where(F.col("first").isNull() | ~F.col("id").eqNullSafe(F.col("first")))
    return hits.groupBy("id").agg(F.collect_set("line").alias("drop"))


def drop_boilerplate(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, removed: str | None = None) -> DataFrame:
    """df with the boilerplate lines gone from `text`; `removed`, if named, says how many lines went."""
    id_, drop = fresh(df.columns, "id_"), fresh(df.columns, "drop_")
    with scratch(df.sparkSession):
        drops = _drops(df, key, text, site, sites).select(F.col("id").alias(id_), F.col("drop").alias(drop))
        drops = materialize(drops, "drops", keep=True)
    # joined the same way at any size: a broadcast of the drops would depend on how many documents they come from
    both = df.join(drops.hint("merge"), F.col(key).eqNullSafe(F.col(id_)), "left")
    all_lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(all_lines, lambda x: ~(x.rlike(WORD) & F.array_contains(F.col(drop), _key(x))))
    new = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    count = [F.when(F.col(drop).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size(kept)).cast("long").alias(removed)] if removed else []
    return both.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c != removed], *count)


def with_length(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The column that states a text's length, made true again."""
    kind = df.schema[n_chars].dataType
    return df.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(kind))
