"""T1 to T19."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import vectors as V
from ..operators import aggregates, ranks, selection
from .aggregates import PLANE, plane

MD5 = "md5('{s}' || {k})"


@query("T1_stable_multi_key_sort", "SELECT row_number() OVER (ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS pos, l_orderkey, l_linenumber FROM lineitem")
def _(t):
    l = t.lineitem.select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return ranks.row_numbers(l, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], "pos", True, ["l_returnflag"]).select("pos", "l_orderkey", "l_linenumber")


@query("T2_pair_list_cap", "SELECT l_orderkey AS i, l_partkey AS j, l_extendedprice AS w FROM lineitem ORDER BY w DESC, i, j LIMIT 64")
def _(t):
    return selection.cap_pairs(t.lineitem.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_extendedprice").alias("w")), 64)


@query("T3_fifo_overflow", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 16")
def _(t):
    return selection.keep_recent(t.events.select("user_id", "event_id"), ["user_id"], "event_id", 16)


POOL = "q AS (SELECT p_partkey AS id, (p_partkey * 37 % 101) / 101.0::DOUBLE AS u, (p_partkey * 53 % 89) / 89.0::DOUBLE AS nov FROM part WHERE p_partkey % 10 <> 3)"


def pool(t):
    k = F.col("p_partkey")
    p = t.part.select(k.alias("id"), (k * 37 % 101 / F.lit(101.0)).alias("u"), (k * 53 % 89 / F.lit(89.0)).alias("nov"))
    return p, p.where("id % 10 = 3")


@query("T4_query_policies", f"""
WITH {POOL}, s AS (SELECT *, (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) * (0.5 + (nov - min(nov) OVER ()) / (max(nov) OVER () - min(nov) OVER ())) AS score FROM q)
(SELECT 'diversity' AS policy, id FROM s ORDER BY nov DESC, id LIMIT 1) UNION ALL (SELECT 'uncertainty', id FROM s ORDER BY u DESC, id LIMIT 1) UNION ALL (SELECT 'hybrid', id FROM s ORDER BY score DESC, id LIMIT 1) UNION ALL (SELECT 'random', id FROM s ORDER BY md5('seed' || id), id LIMIT 1)""")
def _(t):
    p, asked = pool(t)
    parts = [selection.next_query(p, asked, "id", policy).select(F.lit(policy).alias("policy"), "id") for policy in ("diversity", "uncertainty", "hybrid", "random")]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@query("T5_representative_tasks", """
WITH f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) = 1 THEN 0 ELSE 1 END AS f FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY f, CASE WHEN f = 0 THEN p_brand END NULLS FIRST, p_partkey) AS rn FROM f)
SELECT p_type, p_partkey FROM r WHERE rn <= 12""")
def _(t):
    return selection.representatives(t.part.select("p_type", "p_brand", "p_partkey"), "p_type", "p_brand", "p_partkey", 12).select("p_type", "p_partkey")


@query("T6_greedy_diverse_selection")
def _(t):
    c = aggregates.best_per_group(t.embeddings.select("label", "vec_id", "embedding", F.round(F.col("embedding")[0].cast("double"), 6).alias("p")), ["label"], [F.col("p").desc(), F.col("vec_id")], 50)
    return selection.diverse_per_group(c, "label", "vec_id", "embedding", "p", "vec_id", 4)


@query("T7_farthest_point_selection")
def _(t):
    ids = selection.farthest_points(plane(t), "id", "x", "y", 6)
    return t.spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "place int, id long")


@query("T8_evenly_spaced_picks", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE rn IN (SELECT CAST(round_even(i * (SELECT count(*) - 1 FROM customer) / 7.0, 0) AS BIGINT) + 1 FROM range(0, 8) s(i))")
def _(t):
    return selection.evenly_spaced(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 8).select("c_custkey")


@query("T9_low_median_high", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer), e AS (SELECT *, CASE WHEN rn <= 5 THEN 'low' WHEN rn > n - 5 THEN 'high' END AS slot FROM r)
SELECT c_custkey, slot FROM e WHERE slot IS NOT NULL UNION ALL (SELECT c_custkey, 'median' FROM e WHERE slot IS NULL ORDER BY abs(rn - (n + 1) / 2.0), rn LIMIT 5)""")
def _(t):
    return selection.low_mid_high(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5).select("c_custkey", "slot")


@query("T10_balanced_round_robin", "SELECT doc_id, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s1' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 100")
def _(t):
    return selection.balanced_sample(t.documents.select("doc_id", "source"), "source", "doc_id", "s1", 100).select("doc_id", "turn")


@query("T11_simple_random_sample", "SELECT doc_id FROM documents ORDER BY md5('s2' || doc_id), doc_id LIMIT 50")
def _(t):
    return t.documents.select("doc_id").orderBy(selection.hash_order("doc_id", "s2"), "doc_id").limit(50)


@query("T12_move_catalog", "SELECT label, vec_id, turn FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('s3' || vec_id), vec_id) AS turn FROM embeddings) WHERE turn <= 3")
def _(t):
    return selection.balanced_sample(t.embeddings.select("label", "vec_id"), "label", "vec_id", "s3").where("turn <= 3")


@query("T13_pick_near_percentile", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE o_orderkey <> 7 ORDER BY abs(rn - (1 + 0.731 * (n - 1))), rn LIMIT 1")
def _(t):
    return selection.near_percentile(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.731, [7]).select("o_orderkey")


@query("T14_top_farthest_per_class", f"WITH {PLANE} SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY round(x * x + y * y, 9) DESC, id) AS rn FROM p) WHERE rn <= 2")
def _(t):
    d = F.round(F.col("x") * F.col("x") + F.col("y") * F.col("y"), 9)
    return aggregates.best_per_group(plane(t), ["label"], [d.desc(), F.col("id")], 2).select("label", "id")


@query("T15_histogram_bin_samples", "SELECT bin, p_partkey FROM (SELECT p_partkey, CAST(least(floor((p_retailprice - 900) / 120), 9) AS INT) AS bin, row_number() OVER (PARTITION BY least(floor((p_retailprice - 900) / 120), 9) ORDER BY round(abs((p_retailprice - 900) / 120 - least(floor((p_retailprice - 900) / 120), 9) - 0.5), 6), p_size, p_partkey) AS rn FROM part) WHERE rn <= 4")
def _(t):
    x = (F.col("p_retailprice") - 900) / 120
    b = F.least(F.floor(x), F.lit(9)).cast("int")
    p = t.part.select("p_partkey", "p_size", b.alias("bin"), F.round(F.abs(x - b - F.lit(0.5)), 6).alias("far"))
    return aggregates.best_per_group(p, ["bin"], [F.col("far"), F.col("p_size"), F.col("p_partkey")], 4).select("bin", "p_partkey")


@query("T17_calibration_examples")
def _(t):
    p = t.part.select("p_partkey", F.round((F.col("p_size") - 1) / F.lit(49.0), 6).alias("v"))
    return selection.calibration_examples(p, "p_partkey", "v", [i / 10 for i in range(11)])


@query("T18_text_search", "SELECT vec_id, round(greatest(sim, 0), 6) AS sim FROM (SELECT vec_id, list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 17)) AS sim FROM embeddings) ORDER BY round(greatest(sim, 0), 6) DESC, vec_id LIMIT 40")
def _(t):
    q = t.embeddings.where("vec_id = 17").select(F.col("embedding").alias("q"))
    sim = F.round(F.greatest(V.dot(F.col("embedding"), F.col("q")), F.lit(0.0)), 6)
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", sim.alias("sim")).orderBy(F.col("sim").desc(), "vec_id").limit(40)


@query("T19_sort_by_similarity", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 5)), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS distance FROM embeddings")
def _(t):
    return selection.sort_by_distance(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 5).select("vec_id", F.round("distance", 6).alias("distance"))
