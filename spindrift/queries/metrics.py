"""A16 to A24, A32, A33, A35, A36."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import metrics, ranks


def scored(t):
    """Documents with labels: n_chars as the score, quality and toxic as references."""
    return t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score")).join(t.labels, "doc_id")


SCORED = "scored AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("A16_pearson", "SELECT p_type, round(CASE WHEN stddev_pop(p_size) * stddev_pop(p_retailprice) > 1e-12 THEN covar_pop(p_size, p_retailprice) / (stddev_pop(p_size) * stddev_pop(p_retailprice)) ELSE 0.0 END, 6) AS r FROM part GROUP BY p_type")
def _(t):
    return t.part.groupBy("p_type").agg(F.round(metrics.pearson("p_size", "p_retailprice"), 6).alias("r"))


@query("A16_pearson_constant_is_zero", "SELECT 0.0::DOUBLE AS r, CAST(NULL AS DOUBLE) AS r_null")
def _(t):
    p = t.part.withColumn("one", F.lit(1.0))
    return p.agg(metrics.pearson("p_size", "one").alias("r"), metrics.pearson("p_size", "one", None).alias("r_null"))


PCT = "(rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / (count(*) OVER () - 1)"


@query("A17_spearman", f"WITH r AS (SELECT {PCT.format(v='p_size')} AS a, {PCT.format(v='p_retailprice')} AS b FROM part) SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS spearman FROM r")
def _(t):
    return metrics.spearman(t.part.select("p_size", "p_retailprice"), "p_size", "p_retailprice").select(F.round("spearman", 6).alias("spearman"))


@query("A18_kendall", f"""
WITH {SCORED}, p AS (SELECT sign(a.score - b.score) AS s FROM scored a JOIN scored b ON a.quality - b.quality > 0.000001)
SELECT count(*) AS valid, round(avg(s), 6) AS tau, round((count(*) FILTER (WHERE s > 0) + count(*) FILTER (WHERE s = 0) / 2.0) / count(*), 6) AS accuracy FROM p""")
def _(t):
    s = scored(t).select("doc_id", "score", "quality")
    return metrics.kendall(s, "doc_id", "score", "quality").select("valid", F.round("tau", 6).alias("tau"), F.round("accuracy", 6).alias("accuracy"))


@query("A19_auroc", f"""
WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM scored)
SELECT sum(quality)::BIGINT AS n_pos, (count(*) - sum(quality))::BIGINT AS n_neg, round((sum(ar) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auroc FROM r""")
def _(t):
    return metrics.auroc(scored(t), "score", "quality").select("n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


@query("A19_auroc_by_language", """
WITH s AS (SELECT lang, CAST(n_chars AS DOUBLE) AS score, toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS ar FROM s)
SELECT lang, round(CASE WHEN sum(toxic) > 0 AND sum(toxic) < count(*) THEN (sum(ar) FILTER (WHERE toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * (count(*) - sum(toxic))) END, 6) AS auroc FROM r GROUP BY lang""")
def _(t):
    s = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(t.labels, "doc_id")
    return metrics.auroc(s, "score", "toxic", ["lang"]).select("lang", F.round("auroc", 6).alias("auroc"))


TOP = """
WITH k AS (SELECT greatest(1, CAST(round_even(0.1 * count(*), 0) AS BIGINT)) AS k FROM part),
a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT (SELECT k FROM k)), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT (SELECT k FROM k)),
c AS (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT (SELECT k FROM k)), d AS (SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT (SELECT k FROM k)),
n AS (SELECT (SELECT count(*) FROM a WHERE p_partkey IN (FROM b)) AS top, (SELECT count(*) FROM c WHERE p_partkey IN (FROM d)) AS low)
"""


@query("A20_top_k_precision", TOP + "SELECT k, round((top + low) / (2.0 * k), 6) AS precision FROM n, k")
def _(t):
    return metrics.extreme_overlap(t.part.select("p_partkey", "p_retailprice", "p_size"), "p_partkey", "p_retailprice", "p_size", 0.1).select(F.col("k").cast("long").alias("k"), F.round("precision", 6).alias("precision"))


@query("A21_top_k_jaccard", TOP + "SELECT round(top / (2.0 * k - top), 6) AS jaccard_top FROM n, k")
def _(t):
    return metrics.extreme_overlap(t.part.select("p_partkey", "p_retailprice", "p_size"), "p_partkey", "p_retailprice", "p_size", 0.1).select(F.round("jaccard_top", 6).alias("jaccard_top"))


@query("A22_isotonic_mae")
def _(t):
    s = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(t.labels, "doc_id")
    return metrics.isotonic_mae(s, "score", "quality", ["lang"]).select("lang", F.round("mae", 6).alias("mae"))


@query("A23_weighted_kappa", """
WITH r AS (SELECT (p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) AS a, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part),
o AS (SELECT CAST(least(floor(a * 5), 4) AS INT) AS i, CAST(least(floor(b * 5), 4) AS INT) AS j, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT sum((x.i - y.j) ** 2 * x.n * y.n / (SELECT sum(n) FROM o)) AS we FROM (SELECT i, sum(n) AS n FROM o GROUP BY i) x, (SELECT j, sum(n) AS n FROM o GROUP BY j) y)
SELECT round(1 - (SELECT sum((i - j) ** 2 * n) FROM o) / we, 6) AS kappa FROM e""")
def _(t):
    p = ranks.min_max(ranks.min_max(t.part.select("p_size", "p_retailprice"), "p_size", "a"), "p_retailprice", "b")
    return metrics.weighted_kappa(p, "a", "b").select(F.round("kappa", 6).alias("kappa"))


@query("A24_axis_gradient", """
WITH b AS (SELECT ntile(10) OVER (ORDER BY p_retailprice, p_partkey) AS bin, p_size FROM part), m AS (SELECT bin, avg(p_size) AS m FROM b GROUP BY bin), s AS (SELECT bin, m, m - lag(m) OVER (ORDER BY bin) AS d FROM m)
SELECT round(regr_r2(m, bin), 6) AS r2, count(*) FILTER (WHERE d < -0.000001) AS violations FROM s""")
def _(t):
    b = ranks.ntile(t.part.select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_partkey", 10)
    return metrics.axis_gradient(b, "p_size").select(F.round("r2", 6).alias("r2"), "violations")


UNCERTAIN = f"WITH u AS (SELECT p_partkey, {PCT.format(v='p_size')} AS a, {PCT.format(v='p_retailprice')} AS b, (p_partkey * 37 % 101) / 101.0::DOUBLE AS u FROM part), e AS (SELECT *, abs(a - b) AS err FROM u)"


@query("A32_uncertainty_quality", UNCERTAIN + """
, r AS (SELECT *, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS ar, CAST(err >= 0.2 AS INT) AS bad FROM e)
SELECT round(covar_pop(u, err) / (stddev_pop(u) * stddev_pop(err)), 6) AS corr, sum(bad)::BIGINT AS n_bad, round((sum(ar) FILTER (WHERE bad = 1) - sum(bad) * (sum(bad) + 1) / 2.0) / (sum(bad) * (count(*) - sum(bad))), 6) AS auroc FROM r""")
def _(t):
    p = t.part.select("p_size", "p_retailprice", (F.col("p_partkey") * 37 % 101 / F.lit(101.0)).alias("u"))
    return metrics.uncertainty_quality(p, "p_size", "p_retailprice", "u").select(F.round("corr", 6).alias("corr"), F.col("n_bad").cast("long").alias("n_bad"), F.round("auroc", 6).alias("auroc"))


@query("A33_coverage_risk", UNCERTAIN + """
, r AS (SELECT err, row_number() OVER (ORDER BY u, p_partkey) AS rn, count(*) OVER () AS n FROM e), c AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS coverage)
SELECT coverage, count(*) AS kept, round(avg(err), 6) AS risk FROM r, c WHERE rn <= greatest(2, round_even(coverage * n, 0)) GROUP BY coverage""")
def _(t):
    p = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") * 37 % 101 / F.lit(101.0)).alias("u"))
    r = ranks.rank_percentile(ranks.rank_percentile(p, "p_size", "a"), "p_retailprice", "b").withColumn("err", F.abs(F.col("a") - F.col("b")))
    return metrics.coverage_risk(r, "p_partkey", "u", "err", [0.25, 0.5, 0.75, 1.0]).select("coverage", "kept", F.round("risk", 6).alias("risk"))


@query("A35_confusion_correlation", """
WITH l AS (SELECT label, unnest(['e0', 'e1', 'e2']) AS axis, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE]) AS v FROM embeddings), c AS (SELECT DISTINCT label FROM embeddings),
x AS (SELECT axis, c.label, v, CAST(l.label = c.label AS INT) AS y FROM l, c)
SELECT axis, label, round(covar_pop(v, y) / (stddev_pop(v) * stddev_pop(y)), 6) AS corr FROM x GROUP BY axis, label""")
def _(t):
    e = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)])
    return metrics.confusion_scores(e, ["e0", "e1", "e2"], "label").select("axis", "label", F.round("corr", 6).alias("corr"))


@query("A35_confusion_trace", """
WITH l AS (SELECT label, unnest([0, 1, 2]) AS axis, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE]) AS v FROM embeddings)
SELECT round(sum(r), 6) AS trace, round(avg(r), 6) AS macro FROM (SELECT axis, covar_pop(v, CAST(label = axis AS INT)) / (stddev_pop(v) * stddev_pop(CAST(label = axis AS INT))) AS r FROM l GROUP BY axis)""")
def _(t):
    e = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(str(i)) for i in range(3)])
    d = metrics.confusion_scores(e, ["0", "1", "2"], "label").where(F.col("axis") == F.col("label").cast("string"))
    return d.agg(F.round(F.sum("corr"), 6).alias("trace"), F.round(F.avg("corr"), 6).alias("macro"))


@query("A36_argmax_accuracy", "SELECT round(avg(CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = label AS INT)), 6) AS accuracy, count(*) AS n FROM embeddings")
def _(t):
    e = t.embeddings.select("label", F.slice("embedding", 1, 10).alias("e"))
    hit = (F.array_position("e", F.array_max("e")) - 1) == F.col("label")
    return e.agg(F.round(F.avg(hit.cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))
