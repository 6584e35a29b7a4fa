"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize


#: a node with more neighbours than this is hot: its edges stay where they are, and its minimum is sent to them
HOT, SALTS = 256, 16


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the smallest neighbour m of u, u itself included.

    The minimum is combined before it is shuffled. Edges of hot nodes aren't shuffled again: these nodes are few (a HOT-th of the edges
    at most), so their minima are broadcast, or, beyond the size that join_small allows, joined with their edges salted.
    """
    told = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    hot = told.where(F.col("c") > HOT).select("u", "m")
    n = len(hot.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect())
    if not n:
        return edges.join(told.drop("c"), "u")
    if n <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
        return edges.join(hot, "u").unionByName(edges.join(hot.select("u"), "u", "left_anti").join(told.where(F.col("c") <= HOT).drop("c"), "u"))
    both = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return both.join(told.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["u", "salt"]).drop("salt")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node that can be reached."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
