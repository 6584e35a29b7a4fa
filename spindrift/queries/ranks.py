"""W1 to W18."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ranks, windows

RANK = "rank() OVER (ORDER BY {v}) - 1 AS lo, count(*) OVER (PARTITION BY {v}) AS c, count(*) OVER () AS n"


@query("W1_rank_percentile", f"SELECT p_partkey, round((lo + (c - 1) / 2.0) / (n - 1), 9) AS pct FROM (SELECT p_partkey, {RANK.format(v='p_size')} FROM part)")
def _(t):
    return ranks.rank_percentile(t.part.select("p_partkey", "p_size"), "p_size").select("p_partkey", F.round("pct", 9).alias("pct"))


@query("W1_rank_percentile_by_group", "SELECT c_custkey, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) - 1 + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0) / (count(*) OVER (PARTITION BY c_mktsegment) - 1), 9) AS pct FROM customer")
def _(t):
    return ranks.rank_percentile(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", by=["c_mktsegment"]).select("c_custkey", F.round("pct", 9).alias("pct"))


@query("W2_average_rank", f"SELECT p_partkey, lo + (c + 1) / 2.0 AS avg_rank FROM (SELECT p_partkey, {RANK.format(v='p_size')} FROM part)")
def _(t):
    return ranks.average_rank(t.part.select("p_partkey", "p_size"), "p_size").select("p_partkey", "avg_rank")


@query("W3_descending_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank_desc FROM orders")
def _(t):
    return ranks.descending_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "rank_desc")


@query("W4_rank_global_and_in_sample", """
WITH g AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank_global FROM part)
SELECT g.p_partkey, rank_global, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank_sample FROM g JOIN part USING (p_partkey) WHERE p_brand = 'Brand#7'""")
def _(t):
    p = t.part.select("p_partkey", "p_retailprice", "p_brand")
    whole = ranks.descending_rank(p, "p_retailprice", "p_partkey", "rank_global")
    own = ranks.descending_rank(p.where("p_brand = 'Brand#7'"), "p_retailprice", "p_partkey", "rank_sample")
    return own.select("p_partkey", "rank_sample").join(whole.select("p_partkey", "rank_global"), "p_partkey")


@query("W5_quantile_from_sorted", "SELECT round(quantile_cont(c_acctbal, 0.0), 6) AS q0, round(quantile_cont(c_acctbal, 0.137), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS q2, round(quantile_cont(c_acctbal, 1.0), 6) AS q3 FROM customer")
def _(t):
    return ranks.quantile(t.customer, "c_acctbal", [-0.5, 0.137, 0.5, 1.7]).select(*[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(4)])


@query("W8_ntile_chunks", "SELECT p_partkey, ntile(7) OVER (ORDER BY p_size, p_partkey) AS bin FROM part")
def _(t):
    return ranks.ntile(t.part.select("p_partkey", "p_size"), "p_size", "p_partkey", 7).select("p_partkey", "bin")


DAILY = "SELECT event_type, CAST(ts AS DATE) AS d, round(avg(value), 9) AS m FROM events GROUP BY 1, 2"


def daily(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.round(F.avg("value"), 9).alias("m"))


@query("W9_adjacent_difference", f"""
WITH s AS (SELECT event_type, m - lag(m) OVER (PARTITION BY event_type ORDER BY d) AS x FROM ({DAILY}))
SELECT event_type, round(min(x), 6) AS min_step, count(*) FILTER (WHERE x < -0.000001) AS decreases FROM s GROUP BY event_type""")
def _(t):
    step = daily(t).withColumn("x", windows.adjacent_difference("m", ["event_type"], "d"))
    return step.groupBy("event_type").agg(F.round(F.min("x"), 6).alias("min_step"), F.count_if(F.col("x") < -1e-6).alias("decreases"))


@query("W10_gap_fill", """
WITH b AS (SELECT s.i AS bin, h.m FROM range(0, 1200) s(i) LEFT JOIN (SELECT CAST(floor(value * 10) AS INT) AS bin, avg(value) AS m FROM events WHERE event_type = 'error' GROUP BY 1) h ON h.bin = s.i),
w AS (SELECT bin, m, last_value(m IGNORE NULLS) OVER p AS lo, first_value(m IGNORE NULLS) OVER f AS hi, last_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER p AS al, first_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER f AS ah FROM b
 WINDOW p AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT CAST(bin AS BIGINT) AS bin, round(CASE WHEN m IS NOT NULL THEN m WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo ELSE lo + (hi - lo) * (bin - al) / (ah - al) END, 6) AS filled FROM w""")
def _(t):
    h = t.events.where("event_type = 'error'").groupBy(F.floor(F.col("value") * 10).cast("long").alias("bin")).agg(F.avg("value").alias("m"))
    spine = t.spark.range(1200).select(F.col("id").alias("bin"))
    return ranks.fill_gaps(spine.join(h, "bin", "left"), "bin", "m").select("bin", F.round("filled", 6).alias("filled"))


@query("W11_group_first_value", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - first_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice), 4) AS gain FROM lineitem")
def _(t):
    first = windows.group_first("l_extendedprice", ["l_orderkey"], ["l_linenumber", "l_extendedprice"])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - first, 4).alias("gain"))


@query("W12_zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def _(t):
    return ranks.zscore(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@query("W13_baseline_at_every_budget", """
WITH base AS (SELECT l_returnflag AS method, round(avg(l_discount), 6) AS score FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT DISTINCT l_linenumber AS budget FROM lineitem)
SELECT method, budget, score FROM base CROSS JOIN b""")
def _(t):
    base = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_returnflag").alias("method")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return windows.at_every(base, t.lineitem.select(F.col("l_linenumber").alias("budget")).distinct())


@query("W14_kde_curve", """
WITH v AS (SELECT value AS v, count(*) AS c FROM events GROUP BY 1), g AS (SELECT i, i * (100.0::DOUBLE / 71) AS x FROM range(0, 72) s(i)),
d AS (SELECT i, x, sum(c * exp(-0.5 * ((x - v) / 4.0::DOUBLE) ** 2)) AS d FROM g CROSS JOIN v GROUP BY i, x)
SELECT i, round(x, 6) AS x, round(d / max(d) OVER (), 6) AS density FROM d""")
def _(t):
    return ranks.kde(t.events.select("value"), "value", 72, 4.0).select("i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query("W15_kde_stack", """
WITH b AS (SELECT 1.06 * stddev_pop(c_acctbal) * pow(count(*), -0.2) AS h FROM customer), v AS (SELECT c_acctbal AS v, count(*) AS c FROM customer GROUP BY 1),
g AS (SELECT i, -1000 + i * (11000.0::DOUBLE / 127) AS x FROM range(0, 128) s(i)), d AS (SELECT i, x, sum(c * exp(-0.5 * ((x - v) / h) ** 2)) AS d FROM g CROSS JOIN v CROSS JOIN b GROUP BY i, x),
k AS (SELECT i, d / max(d) OVER () AS y FROM d), p AS (SELECT c_custkey, (c_acctbal + 1000) / (11000.0::DOUBLE / 127) AS q FROM customer)
SELECT c_custkey, round(a.y + (b2.y - a.y) * (q - floor(q)), 5) AS height FROM p JOIN k a ON a.i = CAST(floor(q) AS BIGINT) JOIN k b2 ON b2.i = least(CAST(floor(q) AS BIGINT) + 1, 127)""")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    h = c.agg(F.lit(1.06) * F.stddev_pop("c_acctbal") * F.pow(F.count("*"), F.lit(-0.2))).first()[0]
    curve = ranks.kde(c, "c_acctbal", 128, h, -1000.0, 10000.0)
    return windows.height_on_curve(c, "c_acctbal", curve, -1000.0, 11000.0 / 127).select("c_custkey", F.round("height", 5).alias("height"))


@query("W16_density_grid")
def _(t):
    points = t.embeddings.select(F.col("vec_id").alias("id"), ((F.col("embedding")[0].cast("double") + 1) / 2).alias("x"), ((F.col("embedding")[1].cast("double") + 1) / 2).alias("y"))
    return windows.density_grid(points, 32, 2).select("gx", "gy", F.round("density", 6).alias("density"))


@query("W18_hash_ordered_subsample", "SELECT event_id FROM events ORDER BY md5(concat('seed-', CAST(event_id AS VARCHAR))), event_id LIMIT 100")
def _(t):
    return windows.hash_sample(t.events.select("event_id"), "event_id", "seed-", 100)


@query("EXT_running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))
