"""V1 to V18, V21, V22 and the flagship."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import graph_layout, layout, ranks
from .aggregates import PLANE, plane
from .joins import LABELLED, labelled

D = "list_transform({0}, lambda x: x::DOUBLE)"
E = D.format("embedding")
DOT = "list_inner_product({0}, {1})"


@query("V1_l2_normalise", f"SELECT vec_id, list_transform({E}[1:3], lambda x: round(x / (sqrt(list_inner_product({E}, {E})) + 0.00000001), 6)) AS head FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.transform(F.slice(V.normalize(F.col("embedding")), 1, 3), lambda x: S.rounded(x, 6)).alias("head"))


CENTRES = "c AS (SELECT (label = 3) AS p, pos, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), w AS (SELECT list(a.x - b.x ORDER BY a.pos) AS w FROM c a JOIN c b ON a.pos = b.pos AND a.p AND NOT b.p)"
COSINE = f"list_inner_product({E}, w) / (sqrt(list_inner_product({E}, {E})) * sqrt(list_inner_product(w, w)))"
SCORED = CENTRES + f", s AS (SELECT vec_id, round({COSINE}, 6) AS z FROM embeddings, w)"
EXACTLY_SCORED = CENTRES + f", s AS (SELECT vec_id, {COSINE} AS z FROM embeddings, w)"


def direction(t):
    return V.label_direction(t.embeddings, "embedding", F.col("label") == 3)


def scored(t):
    return t.embeddings.select("vec_id", F.round(V.cosine(F.col("embedding"), V.literal(direction(t))), 6).alias("z"))


@query("V2_cosine_to_direction", f"WITH {SCORED} SELECT vec_id, z FROM s")
def _(t):
    return scored(t)


@query("V3_cosine_distance", f"SELECT vec_id, round(greatest(0, 1 - list_inner_product({E}, r) / (sqrt(list_inner_product({E}, {E})) * sqrt(list_inner_product(r, r)))), 6) AS d FROM embeddings, (SELECT {E} AS r FROM embeddings WHERE vec_id = 9)")
def _(t):
    r = t.embeddings.where("vec_id = 9").select(F.col("embedding").alias("r"))
    return t.embeddings.crossJoin(F.broadcast(r)).select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("r")), 6).alias("d"))


@query("V4_feature_fusion", f"SELECT vec_id, round(list_sum(list_transform({E}[1:32], lambda x: x * sqrt(0.7))) + list_sum(list_transform({E}[33:64], lambda x: x * sqrt(0.3))), 6) AS total, 64 AS dim FROM embeddings")
def _(t):
    f = V.fuse(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), 0.7, 0.3)
    return t.embeddings.select("vec_id", f.alias("f")).select("vec_id", F.round(V.total(F.col("f")), 6).alias("total"), F.size("f").alias("dim"))


@query("V5_class_centroids", "SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def _(t):
    return V.mean_vector(t.embeddings, "embedding", ["label"]).select("label", F.posexplode("v").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


DECILES = f"""
WITH {SCORED}, r AS (SELECT vec_id, z, round((rank() OVER (ORDER BY z) - 1 + (count(*) OVER (PARTITION BY z) - 1) / 2.0) / (count(*) OVER () - 1), 9) AS pct FROM s),
b AS (SELECT *, CAST(least(floor(pct * 10), 9) AS INT) AS bin FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY round(abs(pct - (bin + 0.5) / 10), 9), vec_id) AS rn FROM b)
SELECT bin, vec_id, z, round(pct * 100, 6) AS score FROM n WHERE rn <= 4"""


@query("V5_W1_W6_label_axis_deciles", DECILES)
def _(t):
    r = ranks.rank_percentile(scored(t), "z").withColumn("pct", F.round("pct", 9)).withColumn("bin", F.least(F.floor(F.col("pct") * 10), F.lit(9)).cast("int"))
    far = F.round(F.abs(F.col("pct") - (F.col("bin") + F.lit(0.5)) / 10), 9)
    top = r.withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy(far, "vec_id"))).where("rn <= 4")
    return top.select("bin", "vec_id", "z", F.round(F.col("pct") * 100, 6).alias("score"))


@query("V6_zero_shot_expected_level", f"WITH a AS (SELECT list({E} ORDER BY vec_id) AS a FROM embeddings WHERE vec_id < 4), c AS (SELECT vec_id, list_transform(a, lambda v: 12.0 * list_inner_product({E}, v) / (sqrt(list_inner_product({E}, {E})) * sqrt(list_inner_product(v, v)))) AS s FROM embeddings, a), e AS (SELECT vec_id, s, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM c) SELECT vec_id, round((e[2] / 3 + e[3] * 2 / 3 + e[4]) / list_sum(e), 5) AS expected, round((list_position(s, list_max(s)) - 1) / 3.0, 6) AS argmax FROM e")
def _(t):
    anchors = [r[0] for r in t.embeddings.where("vec_id < 4").orderBy("vec_id").select("embedding").collect()]
    return V.expected_level(t.embeddings.select("vec_id", "embedding"), "embedding", anchors).select("vec_id", F.round("expected", 5).alias("expected"), F.round("argmax", 6).alias("argmax"))


@query("V7_zero_shot_continuous_anchors", f"WITH p AS (SELECT (SELECT {E} FROM embeddings WHERE vec_id = 1) AS hi, (SELECT {E} FROM embeddings WHERE vec_id = 2) AS lo), s AS (SELECT vec_id, list_inner_product({E}, hi) AS sh, list_inner_product({E}, lo) AS sl FROM embeddings, p) SELECT vec_id, round(sh - sl, 6) AS z, CASE WHEN sh >= sl THEN 'high' ELSE 'low' END AS side FROM s")
def _(t):
    e = t.embeddings
    a = {r[0]: r[1] for r in e.where("vec_id IN (1, 2)").select("vec_id", "embedding").collect()}
    sh, sl = V.dot(F.col("embedding"), V.literal(a[1])), V.dot(F.col("embedding"), V.literal(a[2]))
    return e.select("vec_id", sh.alias("sh"), sl.alias("sl")).select("vec_id", F.round(F.col("sh") - F.col("sl"), 6).alias("z"), F.when(F.col("sh") >= F.col("sl"), "high").otherwise("low").alias("side"))


@query("V8_pca_two_components")
def _(t):
    return layout.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 2).select("vec_id", F.round(F.col("pc")[0], 4).alias("x"), F.round(F.col("pc")[1], 4).alias("y"))


@query("V9_umap")
def _(t):
    return graph_layout.umap(t.embeddings, "vec_id", "embedding").select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("V9_tsne")
def _(t):
    return graph_layout.tsne(t.embeddings, "vec_id", "embedding").select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("V10_align_and_normalise")
def _(t):
    p = plane(t).select("id", "x", "y", (-F.col("y")).alias("rx"), F.col("x").alias("ry"))
    return layout.procrustes(p, "x", "y", "rx", "ry").select("id", F.round("ax", 5).alias("x"), F.round("ay", 5).alias("y"))


@query("V11_grid_binning", f"WITH {PLANE}, m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT id, CAST(floor((x - x0) / (x1 - x0) * 14) + 1 AS INT) AS gx, CAST(floor((y - y0) / (y1 - y0) * 14) + 1 AS INT) AS gy FROM p, m")
def _(t):
    return layout.grid_cells(plane(t), "x", "y", 16).select("id", "gx", "gy")


@query("V11_collision_packing")
def _(t):
    return layout.pack(layout.grid_cells(plane(t), "x", "y", 64), "id", 64).select("id", "px", "py")


@query("V12_local_packing")
def _(t):
    return layout.pack_around(plane(t), "id", "x", "y", 9, 24).select("id", "px", "py")


@query("V13_text_force", f"SELECT vec_id, round(least(greatest(x + 0.4 * greatest(s, 0) * (0.7 - x), 0), 1), 6) AS x, round(least(greatest(y + 0.4 * greatest(s, 0) * (0.2 - y), 0), 1), 6) AS y FROM (SELECT vec_id, (embedding[1]::DOUBLE + 1) / 2 AS x, (embedding[2]::DOUBLE + 1) / 2 AS y, list_inner_product({E}, r) AS s FROM embeddings, (SELECT {E} AS r FROM embeddings WHERE vec_id = 4))")
def _(t):
    r = t.embeddings.where("vec_id = 4").select(F.col("embedding").alias("r"))
    e = F.col("embedding")
    x, y = V.text_force((e[0].cast("double") + 1) / 2, (e[1].cast("double") + 1) / 2, V.dot(e, F.col("r")), 0.7, 0.2, 0.4)
    return t.embeddings.crossJoin(F.broadcast(r)).select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("V14_multi_text_forces", f"""
WITH q AS (SELECT vec_id AS q, {E} AS r, 0.2 + 0.3 * vec_id AS cx, 0.8 - 0.3 * vec_id AS cy FROM embeddings WHERE vec_id < 3), s AS (SELECT e.vec_id, q, cx, cy, (embedding[1]::DOUBLE + 1) / 2 AS x, (embedding[2]::DOUBLE + 1) / 2 AS y, list_inner_product({E}, r) AS s FROM embeddings e, q),
n AS (SELECT *, (s - min(s) OVER (PARTITION BY q)) / (max(s) OVER (PARTITION BY q) - min(s) OVER (PARTITION BY q)) AS k FROM s)
SELECT vec_id, round(least(greatest(any_value(x) + 0.3 * sum(k * (cx - x)), 0), 1), 6) AS x, round(least(greatest(any_value(y) + 0.3 * sum(k * (cy - y)), 0), 1), 6) AS y FROM n GROUP BY vec_id""")
def _(t):
    q = t.embeddings.where("vec_id < 3").select(F.col("vec_id").alias("q"), F.col("embedding").alias("r"), (F.lit(0.2) + F.lit(0.3) * F.col("vec_id")).alias("cx"), (F.lit(0.8) - F.lit(0.3) * F.col("vec_id")).alias("cy"))
    return layout.text_forces(t.embeddings.select("vec_id", "embedding", ((F.col("embedding")[0].cast("double") + 1) / 2).alias("x"), ((F.col("embedding")[1].cast("double") + 1) / 2).alias("y")), q, "vec_id", "embedding", 0.3).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("V15_axis_from_labels", f"WITH {LABELLED} SELECT id, round(dn / (dn + dp + 0.000000001), 6) AS v FROM d")
def _(t):
    inf = F.lit(float("inf"))
    return labelled(t).select("id", F.round(V.label_axis(F.col("dp"), F.col("dn"), inf, inf), 6).alias("v"))


@query("V16_concept_inference", f"WITH {LABELLED} SELECT id, dp < dn * pow(10, 0.2) AS positive FROM d")
def _(t):
    return labelled(t).select("id", V.concept_positive(F.col("dp"), F.col("dn"), 60.0, F.lit(1.0)).alias("positive"))


@query("V17_rbf_kernel", f"SELECT vec_id, round(0.25 * exp(-0.5 * list_sum(list_transform(list_zip({E}, r), lambda p: (p[1] - p[2]) ** 2)) / 0.64), 6) AS k FROM embeddings, (SELECT {E} AS r FROM embeddings WHERE vec_id = 6)")
def _(t):
    r = t.embeddings.where("vec_id = 6").select(F.col("embedding").alias("r"))
    return t.embeddings.crossJoin(F.broadcast(r)).select("vec_id", F.round(V.rbf(F.col("embedding"), F.col("r"), 0.8, 0.5), 6).alias("k"))


@query("V18_median_lengthscale", f"WITH s AS (SELECT vec_id, {E} AS e FROM embeddings WHERE vec_id IN (SELECT CAST(trunc(i * (SELECT count(*) - 1 FROM embeddings) / 95.0) AS BIGINT) FROM range(0, 96) r(i))) SELECT round(sqrt(median(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2)))), 6) AS lengthscale FROM s a JOIN s b ON a.vec_id < b.vec_id")
def _(t):
    from ..plans.models import median_lengthscale

    n = t.embeddings.count()
    want = sorted({int(i * (n - 1) / 95) for i in range(96)})
    rows = [r[1] for r in t.embeddings.where(F.col("vec_id").isin(want)).select("vec_id", "embedding").orderBy("vec_id").collect()]
    return t.spark.createDataFrame([(round(median_lengthscale(rows), 6),)], "lengthscale double")


@query("V20_block_mean_pooling", "SELECT vec_id, list_transform(range(0, 8), lambda b: round(list_avg(list_transform(embedding[b * 8 + 1:b * 8 + 8], lambda x: x::DOUBLE)), 6)) AS pooled FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.transform(layout.block_means(F.col("embedding"), 8), lambda x: S.rounded(x, 6)).alias("pooled"))


@query("V20_dense_correspondence", """
WITH c AS (SELECT vec_id // 16 AS image, vec_id % 4 AS x, vec_id // 4 % 4 AS y, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), f AS (SELECT e AS f FROM c WHERE image = 0 AND x = 2 AND y = 1)
SELECT image, x, y, round(list_inner_product(e, f) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(f, f))), 6) AS cosine FROM c, f WHERE image <> 0""")
def _(t):
    cells = t.embeddings.select(F.expr("vec_id div 16").alias("image"), (F.col("vec_id") % 4).alias("x"), (F.expr("vec_id div 4") % 4).alias("y"), "embedding")
    return layout.correspondence(cells, "image", "x", "y", "embedding", 0, (2, 1)).select("image", "x", "y", F.round("cosine", 6).alias("cosine"))


@query("V21_kmeans_first_k")
def _(t):
    return layout.kmeans(plane(t), "id", "x", "y", 3, 8).select("id", "cluster")


@query("V22_base_axes", f"WITH {PLANE} SELECT 'base:x' AS axis, id, x AS value FROM p UNION ALL SELECT 'base:y', id, y FROM p")
def _(t):
    return plane(t).select("id", F.col("x").alias("base:x"), F.col("y").alias("base:y")).unpivot(["id"], ["base:x", "base:y"], "axis", "value")


@query("V23_method_names", "SELECT * FROM (VALUES ('CLIP, dino', 'clip,dino'), ('all', 'clip,dino,siglip'), ('dinov2,clip,DINO', 'dino,clip')) v(asked, methods)")
def _(t):
    from ..plans.config import parse_methods

    asked = ["CLIP, dino", "all", "dinov2,clip,DINO"]
    return t.spark.createDataFrame([(a, ",".join(parse_methods(a))) for a in asked], "asked string, methods string")
