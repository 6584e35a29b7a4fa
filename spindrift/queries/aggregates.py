"""A1 to A15, A25 to A31, A34, A37 to A47."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import aggregates, ranks, similarity
from ..operators.metadata import melt_strings


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("A1_group_mean_std_count", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std, count(l_discount) AS l_discount_count, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(l_quantity) AS l_quantity_count FROM lineitem GROUP BY 1, 2")
def _(t):
    g = aggregates.mean_std_count(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_discount", "l_quantity"])
    return g.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) if c[-5:] != "count" else F.col(c) for c in g.columns[2:]])


@query("A2_group_mean", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("A3_mean_sem", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(p_retailprice) / sqrt(count(*)) END, 6) AS sem, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return aggregates.mean_sem(t.part, ["p_brand"], "p_retailprice").select("p_brand", *r6("mean", "sem"), "n")


DELTA = "(SELECT user_id, value - 50 AS d FROM events)"


@query("A4_t_test_moments", f"SELECT user_id, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM {DELTA} GROUP BY user_id")
def _(t):
    d = t.events.select("user_id", (F.col("value") - 50).alias("d"))
    return aggregates.t_test(d, ["user_id"], "d").select("user_id", *r6("mean", "sd", "sem"), "n")


@query("A4_t_test_p_values")
def _(t):
    d = t.events.select("user_id", (F.col("value") - 50).alias("d"))
    return aggregates.t_test(d, ["user_id"], "d").select("user_id", F.round("p", 6).alias("p"))


@query("A5_pivot_mean", "SELECT l_shipmode AS mode, round(avg(l_quantity) FILTER (WHERE l_linenumber = 1), 6) AS b1, round(avg(l_quantity) FILTER (WHERE l_linenumber = 2), 6) AS b2, round(avg(l_quantity) FILTER (WHERE l_linenumber = 3), 6) AS b3 FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1")
def _(t):
    p = aggregates.pivot_mean(t.lineitem.withColumn("mode", F.col("l_returnflag")), ["mode"], "l_linenumber", [1, 2, 3], "l_quantity")
    return p.select("mode", *[F.round(F.col(str(i)), 6).alias(f"b{i}") for i in (1, 2, 3)])


@query("A6_pivot_distinct_count", "SELECT p_brand, count(DISTINCT p_partkey) FILTER (WHERE p_type = 'ECONOMY') AS economy, count(DISTINCT p_partkey) FILTER (WHERE p_type = 'SMALL') AS small FROM part GROUP BY 1")
def _(t):
    return aggregates.pivot_distinct(t.part, ["p_brand"], "p_type", ["ECONOMY", "SMALL"], "p_partkey").select("p_brand", F.col("ECONOMY").alias("economy"), F.col("SMALL").alias("small"))


@query("A7_gain_over_best_baseline", "WITH g AS (SELECT l_quantity / 50.0 - greatest(l_discount * 10, l_tax * 10) AS g FROM lineitem) SELECT round(avg(g), 6) AS mean_gain, round(median(g), 6) AS median_gain, round(avg(CAST(g > 0 AS INT)), 6) AS win_rate FROM g")
def _(t):
    d = t.lineitem.select((F.col("l_quantity") / F.lit(50.0)).alias("o"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"))
    return aggregates.gain_over_best(d, "o", ["a", "b"]).select(*r6("mean_gain", "median_gain", "win_rate"))


MONTHS = "SELECT o_orderpriority AS method, year(o_orderdate) * 12 + month(o_orderdate) AS step, round(avg(o_totalprice), 6) AS m FROM orders GROUP BY 1, 2"


def months(t):
    step = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("step")
    return t.orders.groupBy(F.col("o_orderpriority").alias("method"), step).agg(F.round(F.avg("o_totalprice"), 6).alias("m"))


@query("A8_learning_curve_area", f"WITH m AS ({MONTHS}), s AS (SELECT method, step, m, (step - lag(step) OVER w) * (m + lag(m) OVER w) / 2 AS a FROM m WINDOW w AS (PARTITION BY method ORDER BY step)) SELECT method, round(CASE WHEN max(step) > min(step) THEN sum(a) / (max(step) - min(step)) ELSE max(m) END, 4) AS area FROM s GROUP BY method")
def _(t):
    return aggregates.curve_area(months(t), ["method"], "step", "m").select("method", F.round("area", 4).alias("area"))


@query("A9_best_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def _(t):
    return aggregates.best_per_group(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")])


@query("A10_conditional_means", "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linenumber = 1), 6) AS first, round(avg(l_quantity) FILTER (WHERE l_linenumber = 7), 6) AS final, round(avg(l_quantity) FILTER (WHERE l_linenumber = 7) - avg(l_quantity) FILTER (WHERE l_linenumber = 1), 6) AS gain FROM lineitem GROUP BY 1")
def _(t):
    at = lambda b: F.avg(F.when(F.col("l_linenumber") == b, F.col("l_quantity")))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(at(1), 6).alias("first"), F.round(at(7), 6).alias("final"), F.round(at(7) - at(1), 6).alias("gain"))


@query("A11_failing_groups", "SELECT l_orderkey, round(max(l_discount), 6) AS best FROM lineitem GROUP BY 1 HAVING max(l_discount) < 0.03")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.max("l_discount"), 6).alias("best")).where(F.col("best") < F.lit(0.03))


@query("A12_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, p_brand LIMIT 10")
def _(t):
    return aggregates.value_counts(t.part, "p_brand", 5, 10)


@query("A13_group_size_coverage", "SELECT lang, count(*) AS n, count(l.doc_id) AS matched, round(count(l.doc_id) / count(*), 6) AS coverage, count(DISTINCT lower(source)) AS sources FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def _(t):
    j = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"), F.count_distinct(F.lower("source")).alias("sources"))


@query("A14_infer_field_types", """
WITH l AS (SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS field, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS value FROM part),
g AS (SELECT field, count(*) AS coverage, count(TRY_CAST(value AS DOUBLE)) AS numbers, count(DISTINCT round(TRY_CAST(value AS DOUBLE), 6)) AS dx, count(DISTINCT lower(trim(value))) AS unique_values FROM l WHERE trim(value) <> '' GROUP BY field)
SELECT field, CASE WHEN numbers >= greatest(1, floor(coverage * 0.85)) AND dx >= 12 THEN 'continuous' WHEN numbers >= greatest(1, floor(coverage * 0.85)) AND dx >= 3 THEN 'ordinal' ELSE 'categorical' END AS type,
 coverage, round(coverage / (SELECT count(*) FROM part), 6) AS coverage_ratio, unique_values FROM g""")
def _(t):
    p = t.part
    long = melt_strings(p, "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    return aggregates.infer_field_types(long, p.count()).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("A15_min_max_normalise", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS norm FROM customer")
def _(t):
    return ranks.min_max(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("norm", 6).alias("norm"))


HIST = "SELECT CAST(s.b AS INT) AS bin, count(h.b) AS n FROM range(0, {b}) s(b) LEFT JOIN (SELECT CAST(least(greatest(floor(({v} - {lo}) / {w}), 0), {b} - 1) AS INT) AS b FROM {t}) h ON h.b = s.b GROUP BY 1"


@query("A25_histogram_fixed_bins", HIST.format(b=20, v="(p_size - 1) / 49.0::DOUBLE", lo=0, w="0.05::DOUBLE", t="part"))
def _(t):
    return aggregates.histogram(t.part.select(((F.col("p_size") - 1) / F.lit(49.0)).alias("v")), "v", 20, 0.0, 1.0)


@query("A26_histogram_over_range_with_std", """
WITH r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 12 AS w FROM customer), h AS (SELECT CAST(least(greatest(floor((c_acctbal - lo) / w), 0), 11) AS INT) AS b, c_nationkey FROM customer, r)
SELECT CAST(s.b AS INT) AS bin, count(h.b) AS n, round(avg(c_nationkey), 6) AS mean_std FROM range(0, 12) s(b) LEFT JOIN h ON h.b = s.b GROUP BY 1""")
def _(t):
    c = t.customer
    lo, hi = c.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return aggregates.histogram(c, "c_acctbal", 12, lo, hi, [F.round(F.avg("c_nationkey"), 6).alias("mean_std")])


@query("A27_selected_label_histogram", HIST.format(b=5, v="(o_totalprice - 1000) / 500000.0::DOUBLE", lo=0, w="0.2::DOUBLE", t="(SELECT * FROM orders WHERE o_orderkey % 50 = 0)"))
def _(t):
    return aggregates.histogram(t.orders.where("o_orderkey % 50 = 0").select(((F.col("o_totalprice") - 1000) / F.lit(500000.0)).alias("v")), "v", 5, 0.0, 1.0)


@query("A28_quantile_edges", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.2), 6) AS q0, round(quantile_cont(c_acctbal, 0.4), 6) AS q1, round(quantile_cont(c_acctbal, 0.6), 6) AS q2, round(quantile_cont(c_acctbal, 0.8), 6) AS q3 FROM customer GROUP BY 1")
def _(t):
    return ranks.quantile(t.customer, "c_acctbal", [0.2, 0.4, 0.6, 0.8], ["c_mktsegment"]).select("c_mktsegment", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(4)])


PLANE = "p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, CAST(label AS VARCHAR) AS label FROM embeddings)"
PLANE_KNN = PLANE + ", n AS (SELECT id, other, d2 FROM (SELECT a.id, b.id AS other, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 9) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 9), b.id) AS rn FROM p a JOIN p b ON a.id <> b.id) WHERE rn <= 8)"


def plane(t):
    e = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(e[0].cast("double"), 6).alias("x"), F.round(e[1].cast("double"), 6).alias("y"), F.col("label").cast("string").alias("label"))


PURITY = PLANE_KNN + """, u AS (SELECT n.id, avg(CAST(a.label = b.label AS INT)) AS pure FROM n JOIN p a ON a.id = n.id JOIN p b ON b.id = n.other GROUP BY n.id),
s AS (SELECT sum(f * f) AS base FROM (SELECT count(*) / (SELECT count(*) FROM p)::DOUBLE AS f FROM p GROUP BY label))
SELECT round(avg(pure), 6) AS purity, round(any_value(base), 6) AS baseline, round(least(1, greatest(0, (avg(pure) - any_value(base)) / (1 - any_value(base)))), 6) AS norm FROM u, s"""


@query("A29_knn_label_purity", "WITH " + PURITY)
def _(t):
    p = plane(t)
    return similarity.label_purity(p, similarity.knn_plane(p, "id", "x", "y", 8), "id", "label").select(*r6("purity", "baseline", "norm"))


@query("A30_separability_top3", """
WITH s AS (SELECT p_type AS field, round(max(p_size) / 50.0 * count(DISTINCT p_brand) / 25.0, 9) AS score FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, field) AS rn FROM s)
SELECT round(avg(score), 6) AS separability, string_agg(field, '|' ORDER BY rn) AS fields FROM r WHERE rn <= 3""")
def _(t):
    s = t.part.groupBy(F.col("p_type").alias("field")).agg(F.round(F.max("p_size") / F.lit(50.0) * F.count_distinct("p_brand") / F.lit(25.0), 9).alias("score"))
    return similarity.separability(s, "field", "score", 3).select(F.round("separability", 6).alias("separability"), "fields")


AXES3 = "a AS (SELECT p_partkey AS id, 0 AS ax, (p_size - 1) / 49.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, (p_retailprice - 900) / 1200.0::DOUBLE FROM part UNION ALL SELECT p_partkey, 2, (p_partkey * 37 % 101) / 101.0::DOUBLE FROM part WHERE p_partkey % 3 > 0)"


def axes3(t):
    p = t.part
    a = p.select(F.col("p_partkey").alias("id"), F.lit(0).alias("ax"), ((F.col("p_size") - 1) / F.lit(49.0)).alias("v"))
    b = p.select("p_partkey", F.lit(1), (F.col("p_retailprice") - 900) / F.lit(1200.0))
    c = p.where("p_partkey % 3 > 0").select("p_partkey", F.lit(2), F.col("p_partkey") * 37 % 101 / F.lit(101.0))
    return a.union(b).union(c)


@query("A31_recommend_scatterplots", f"""
WITH {AXES3}, j AS (SELECT x.ax AS i, y.ax AS j, x.v AS vx, y.v AS vy FROM a x JOIN a y ON x.id = y.id AND x.ax < y.ax),
r AS (SELECT i, j, count(*) AS overlap, covar_pop(vx, vy) / (stddev_pop(vx) * stddev_pop(vy)) AS r FROM j GROUP BY i, j HAVING count(*) >= 10)
SELECT i, j, overlap, round(0.6 * (1 - abs(r)) + 0.4 * overlap / (SELECT count(*) FROM part), 6) AS score FROM r ORDER BY score DESC, i, j LIMIT 2""")
def _(t):
    pairs = similarity.axis_pairs(axes3(t), "id", "ax", "v", 10)
    n = t.part.count()
    s = F.round(F.lit(0.6) * (1 - F.abs("r")) + F.lit(0.4) * F.col("overlap") / n, 6)
    return pairs.select("i", "j", "overlap", s.alias("score")).orderBy(F.col("score").desc(), "i", "j").limit(2)


@query("A34_diagnostics_bundle", "SELECT round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std, min(p_size) AS lo, max(p_size) AS hi, round(avg(p_retailprice - p_size), 6) AS residual_mean, round(sqrt(avg((p_retailprice - p_size) ** 2)), 6) AS residual_rms, round(sum(p_size * p_retailprice) / sqrt(sum(p_size * p_size) * sum(p_retailprice ** 2)), 6) AS cosine FROM part")
def _(t):
    a, b = F.col("p_size"), F.col("p_retailprice")
    return t.part.agg(F.round(F.avg(a), 6).alias("mean"), F.round(F.stddev_pop(a), 6).alias("std"), F.min(a).alias("lo"), F.max(a).alias("hi"), F.round(F.avg(b - a), 6).alias("residual_mean"), F.round(F.sqrt(F.avg((b - a) * (b - a))), 6).alias("residual_rms"), F.round(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 6).alias("cosine"))


@query("A37_weighted_mean_objective", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM lineitem")
def _(t):
    return aggregates.weighted_mean(t.lineitem, "l_discount", "l_quantity").select(*r6("weighted_mean"))


@query("A38_sweep_progression", """
WITH m AS (SELECT l_returnflag AS cfg, l_linenumber AS step, round(avg(l_discount), 9) AS m FROM lineitem GROUP BY 1, 2), d AS (SELECT *, m - lag(m) OVER (PARTITION BY cfg ORDER BY step) AS d FROM m)
SELECT cfg, string_agg(printf('%.4f', m), '|' ORDER BY step) AS curve, round(arg_max(m, step) - arg_min(m, step), 6) AS gain, round(avg(m), 6) AS mean, round(min(d), 6) AS least_step, count(*) FILTER (WHERE d < -0.000000001) AS decreases FROM d GROUP BY cfg""")
def _(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("cfg"), F.col("l_linenumber").alias("step")).agg(F.round(F.avg("l_discount"), 9).alias("m"))
    return aggregates.progression(m, ["cfg"], "step", "m").select("cfg", "curve", *r6("gain", "mean", "least_step"), "decreases")


@query("A39_groupwise_findings", "SELECT l_orderkey, min({'k': l_linenumber * 1000000 + l_partkey, 'f': l_returnflag}).f AS first_flag, count(*) FILTER (WHERE l_quantity > 40) AS findings, round(max(l_quantity / 50.0), 6) AS max_share FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("k"), F.col("l_returnflag").alias("f")))["f"].alias("first_flag"), F.count_if(F.col("l_quantity") > 40).alias("findings"), F.round(F.max(F.col("l_quantity") / F.lit(50.0)), 6).alias("max_share"))


@query("A40_top_label_shares", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, event_type, round(n / total::DOUBLE, 6) AS share, CAST(rn AS INT) AS rn FROM r WHERE rn <= 3""")
def _(t):
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    r = c.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("n").desc(), "event_type")))
    return r.where("rn <= 3").select("user_id", "event_type", F.round(F.col("n") / F.col("total"), 6).alias("share"), "rn")


@query("A41_centroid", f"WITH {PLANE} SELECT label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM p GROUP BY label")
def _(t):
    return plane(t).groupBy("label").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


@query("A42_global_uncertainty", f"WITH {AXES3}, n AS (SELECT id, (v - min(v) OVER (PARTITION BY ax)) / (max(v) OVER (PARTITION BY ax) - min(v) OVER (PARTITION BY ax)) AS u FROM a) SELECT id, round(avg(u), 6) AS uncertainty FROM n GROUP BY id")
def _(t):
    a = axes3(t)
    span = F.broadcast(a.groupBy("ax").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    u = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return a.join(span, "ax").groupBy("id").agg(F.round(F.avg(u), 6).alias("uncertainty"))


@query("A43_acceptance_checks", "SELECT 'discount_range' AS rule, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) AS violations FROM lineitem UNION ALL SELECT 'quantity_positive', count(*) FILTER (WHERE l_quantity <= 0) FROM lineitem UNION ALL SELECT 'price_above_1000', count(*) FILTER (WHERE l_extendedprice <= 1000) FROM lineitem")
def _(t):
    rules = {"discount_range": (F.col("l_discount") < 0) | (F.col("l_discount") > 1), "quantity_positive": F.col("l_quantity") <= 0, "price_above_1000": F.col("l_extendedprice") <= 1000}
    told = t.lineitem.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return told.unpivot([], list(rules), "rule", "violations")


@query("A44_active_sample_audit", "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean, sum(CAST(l_quantity <= 10 AS INT))::BIGINT AS b0, sum(CAST(l_quantity > 10 AND l_quantity <= 30 AS INT))::BIGINT AS b1, sum(CAST(l_quantity > 30 AS INT))::BIGINT AS b2 FROM lineitem GROUP BY 1, 2")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg(q), 6).alias("mean"), F.count_if(q <= 10).alias("b0"), F.count_if((q > 10) & (q <= 30)).alias("b1"), F.count_if(q > 30).alias("b2"))


@query("A45_metric_melt", """
WITH g AS (SELECT l_returnflag AS method, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1)
SELECT 'line' AS stage, method, 'discount' AS metric, discount AS value FROM g UNION ALL SELECT 'line', method, 'tax', tax FROM g UNION ALL SELECT 'order', o_orderpriority, 'price', round(avg(o_totalprice), 6) FROM orders GROUP BY 2""")
def _(t):
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("method")).agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))
    b = t.orders.groupBy(F.col("o_orderpriority").alias("method")).agg(F.round(F.avg("o_totalprice"), 6).alias("price"))
    parts = [aggregates.melt(x, ["method"], cols).withColumn("stage", F.lit(s)) for s, x, cols in (("line", a, ["discount", "tax"]), ("order", b, ["price"]))]
    return reduce(lambda x, y: x.unionByName(y), parts).select("stage", "method", "metric", "value")


@query("A46_histogram_compression", """
WITH b AS (SELECT p_size - 1 AS bin, count(*) AS n, 's' || p_size AS label FROM part GROUP BY p_size), e AS (SELECT k, floor(k * 50 / 12)::BIGINT AS lo, greatest(floor(k * 50 / 12) + 1, floor((k + 1) * 50 / 12))::BIGINT AS hi FROM range(0, 12) s(k)),
j AS (SELECT k, sum(n)::BIGINT AS n, list(label ORDER BY bin) AS l FROM b JOIN e ON bin >= lo AND bin < hi GROUP BY k)
SELECT CAST(k AS INT) AS k, n, CASE WHEN len(l) <= 3 THEN array_to_string(l, ', ') ELSE l[1] || ' ... ' || l[-1] END AS label FROM j""")
def _(t):
    b = t.part.groupBy("p_size").agg(F.count("*").alias("n")).select((F.col("p_size") - 1).alias("bin"), "n", F.concat(F.lit("s"), F.col("p_size")).alias("label"))
    return aggregates.compress_histogram(b, 50, 12)


@query("A47_label_statistics", "SELECT c_mktsegment, count(c_acctbal) AS n, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.05), 6) AS p05, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.95), 6) AS p95, max(c_acctbal) AS max, round(stddev_pop(c_acctbal), 6) AS std FROM customer GROUP BY 1")
def _(t):
    return aggregates.label_statistics(t.customer, ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "n", "min", *r6("p05", "mean", "median", "p95"), "max", *r6("std"))
