"""Neighbour searches and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours


def knn(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", decimals: int = 9, skip_self: bool = True, exact: bool = True) -> DataFrame:
    """(src, dst, sim) of the k nearest right rows of each left row; ties by dst. Rows without a vector have no neighbours.

    By an index of cells over the right rows (`neighbours`); exact unless said otherwise. Ids may be of any kind that has an order.
    metric: cosine (largest first), or sq_euclidean (smallest first, given as sim = -d2).
    """
    return neighbours.search(neighbours.build(right, key, vector, metric), left, key, vector, k, exact=exact, decimals=decimals, skip_self=skip_self)


def knn_plane(df: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """The k nearest in the plane by squared distance, ties by id, self excluded."""
    v = df.select(key, F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("v"))
    return knn(v, v, key, "v", k, "sq_euclidean").select("src", "dst", (-F.col("sim")).alias("d2"))


def label_purity(items: DataFrame, neighbours: DataFrame, key: str, label: str) -> DataFrame:
    """Mean share of neighbours with the same label, the share that chance gives (sum of squared label shares), and the purity
    scaled between chance and 1."""
    a = items.where(F.col(label).isNotNull()).select(F.col(key).alias("src"), F.col(label).alias("la"))
    b = items.where(F.col(label).isNotNull()).select(F.col(key).alias("dst"), F.col(label).alias("lb"))
    own = neighbours.join(a, "src").join(b, "dst").groupBy("src").agg(F.avg((F.col("la") == F.col("lb")).cast("int")).alias("p")).agg(F.avg("p").alias("purity"))
    shares = a.groupBy("la").agg(F.count("*").alias("c")).select(F.col("c"), F.sum("c").over(Window.partitionBy()).alias("n")).agg(F.sum(F.pow(F.col("c") / F.col("n"), 2)).alias("baseline"))
    scaled = F.when(F.col("baseline") < 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("purity") - F.col("baseline")) / (1 - F.col("baseline"))))).otherwise(F.lit(0.0))
    return own.crossJoin(shares).select("purity", "baseline", scaled.alias("norm"))


def separability(scores: DataFrame, field: str, score: str, top: int) -> DataFrame:
    """Mean of the best fields' scores, with the fields in order."""
    best = scores.orderBy(F.col(score).desc(), field).limit(top)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(field).alias("f"))))
    return best.agg(F.avg(score).alias("separability"), F.array_join(F.transform(ordered, lambda x: x["f"]), "|").alias("fields"))


def axis_pairs(coords: DataFrame, key: str, axis: str, value: str, min_overlap: int) -> DataFrame:
    """(i, j, overlap, r) for every pair of axes over the items that have both."""
    from .metrics import pearson

    a = coords.select(F.col(key).alias("id"), F.col(axis).alias("i"), F.col(value).alias("vx"))
    b = coords.select(F.col(key).alias("id"), F.col(axis).alias("j"), F.col(value).alias("vy"))
    return a.join(b, "id").where("i < j").groupBy("i", "j").agg(F.count("*").alias("overlap"), pearson("vx", "vy").alias("r")).where(F.col("overlap") >= min_overlap)


def min_distance(items: DataFrame, picked: DataFrame, key: str, dims: list[str], limit: int = 10_000) -> DataFrame:
    """Items with dp and dn, the least Euclidean distance to the picked positives and negatives (label 'pos'/'neg'), infinite where
    there are none. The picked ones are what a person has labelled: they are collected only up to `limit`."""
    rows = picked.select("label", *[F.col(d).cast("double") for d in dims]).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labelled items")

    def least(kind: str):
        own = [tuple(r[d] for d in dims) for r in rows if r["label"] == kind]
        if not own:
            return F.lit(float("inf"))
        points = F.array(*[F.array(*[F.lit(x) for x in p]) for p in own])
        d2 = lambda p: sum(((F.col(d) - p[i]) * (F.col(d) - p[i]) for i, d in enumerate(dims)), F.lit(0.0))
        return F.sqrt(F.array_min(F.transform(points, d2)))

    return items.withColumn("dp", least("pos")).withColumn("dn", least("neg"))
