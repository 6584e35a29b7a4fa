"""P1 to P19, U1 to U7."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import metadata, sets
from .aggregates import PLANE, plane


@query("P1_normalize_metadata_rows", "SELECT nullif(trim(p_name), '') AS p_name, nullif(trim(CASE WHEN p_size % 5 = 0 THEN '  ' ELSE ' ' || p_size || ' ' END), '') AS size, p_brand FROM part WHERE trim(p_name) <> ''")
def _(t):
    p = t.part.select("p_name", F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_size", F.lit(" "))).alias("size"), "p_brand")
    return metadata.normalize_rows(p, "p_name", ["size", "p_brand"])


@query("P2_row_matches_filter", "SELECT p_partkey FROM part WHERE regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '(?i)(RED|blue).*brand#1[0-5]?')")
def _(t):
    return t.part.where(sets.row_matches("(RED|blue).*brand#1[0-5]?", ["p_name", "p_brand", "p_type"])).select("p_partkey")


@query("P3_percent_slice", "SELECT c_custkey FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) WHERE c_acctbal BETWEEN lo + (hi - lo) * 0.2 AND lo + (hi - lo) * 0.35")
def _(t):
    return sets.percent_slice(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 20.0, 35.0).select("c_custkey")


@query("P4_subset_composition", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 40 AND p_retailprice < 1500 AND p_type IN ('ECONOMY', 'SMALL') AND p_brand <> 'Brand#3'")
def _(t):
    k = t.part.select("p_partkey")
    ids = lambda c: t.part.where(c).select("p_partkey")
    return sets.compose(k, "p_partkey", [("size", ids("p_size BETWEEN 10 AND 40")), ("price", ids("p_retailprice < 1500")), ("size", ids("p_size < 2"))], [("isolate", ids("p_type IN ('ECONOMY', 'SMALL')")), ("exclude", ids("p_brand = 'Brand#3'"))])


@query("P5_item_filter_pipeline", "SELECT vec_id FROM embeddings WHERE embedding[1] > -0.1 AND label IN (1, 2, 3) AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0)")
def _(t):
    e = t.embeddings
    ids = lambda c: e.where(c).select("vec_id")
    return sets.compose(e.select("vec_id"), "vec_id", [("x", ids(F.col("embedding")[0] > F.lit(-0.1)))], [("isolate", ids("label IN (1, 2, 3)")), ("exclude", ids("vec_id % 4 = 0"))])


POLY = [(0.45, 0.4), (0.6, 0.45), (0.55, 0.6), (0.5, 0.5), (0.42, 0.58)]


def _crossing_sql():
    parts = []
    for (x1, y1), (x2, y2) in zip(POLY, [*POLY[1:], POLY[0]], strict=True):
        parts.append(f"CAST((({y1} > y) <> ({y2} > y)) AND x < ({x2 - x1!r}) * (y - {y1}) / ({y2 - y1!r}) + {x1} AS INT)")
    return " + ".join(parts)


@query("P6_lasso", f"SELECT id FROM (SELECT vec_id AS id, (round(embedding[1]::DOUBLE, 6) + 1) / 2 AS x, (round(embedding[2]::DOUBLE, 6) + 1) / 2 AS y FROM embeddings) WHERE ({_crossing_sql()}) % 2 = 1")
def _(t):
    p = plane(t).select("id", ((F.col("x") + 1) / 2).alias("x"), ((F.col("y") + 1) / 2).alias("y"))
    return p.where(sets.in_polygon(F.col("x"), F.col("y"), POLY)).select("id")


@query("P7_window_predicate", f"WITH {PLANE} SELECT id FROM p WHERE (x + 1) / 2 BETWEEN 0.44 AND 0.58 AND 1 - (y + 1) / 2 BETWEEN 0.44 AND 0.58")
def _(t):
    p = plane(t)
    return p.where(sets.in_window((F.col("x") + 1) / 2, (F.col("y") + 1) / 2, 0.45, 0.57, 0.45, 0.57, 0.01)).select("id")


@query("P8_sanitize_axes", "SELECT user_id, event_id, round(least(greatest(v, 0), 1), 6) AS v FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value / 60 END AS v, count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 2 = 0) OVER (PARTITION BY user_id) AS c FROM events) WHERE NOT isnan(v) AND event_id % 2 = 0 AND c >= 2")
def _(t):
    e = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 60).alias("v"))
    x = sets.sanitize_axes(e, "user_id", "event_id", "v", e.where("event_id % 2 = 0").select("event_id"))
    return x.select("user_id", "event_id", F.round("v", 6).alias("v"))


@query("P9_binary_positive_mask", "SELECT c_custkey, c_acctbal > 0 AS numeric, c_nationkey % 3 = 0 AS words FROM customer")
def _(t):
    c = t.customer.select("c_custkey", F.col("c_acctbal").cast("string").alias("a"), F.when(F.col("c_nationkey") % 3 == 0, " Yes").otherwise("no").alias("b"))
    return sets.binary_mask(sets.binary_mask(c, "a", out="numeric"), "b", out="words").select("c_custkey", "numeric", "words")


@query("P10_registry_filters", "SELECT p_partkey FROM part WHERE contains(lower(p_type || '/' || p_brand || '/' || p_name), 'small') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size > 5")
def _(t):
    key = F.lower(F.concat_ws("/", "p_type", "p_brand", "p_name"))
    return t.part.where(key.contains("small") & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & (F.col("p_size") > 5)).select("p_partkey")


@query("P11_undefined_band", "SELECT p_partkey FROM part WHERE (p_size - 1) / 49.0::DOUBLE BETWEEN 0.4 AND 0.6")
def _(t):
    return t.part.where(sets.undefined_band((F.col("p_size") - 1) / F.lit(49.0), 0.2)).select("p_partkey")


@query("P12_numeric_coercion", "SELECT conv_id, turn, TRY_CAST(split_part(text, ' ', 1) AS DOUBLE) AS first_number, TRY_CAST(turn || '.5' AS DOUBLE) AS turn_number FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.get(F.split("text", " "), F.lit(0)).try_cast("double").alias("first_number"), F.concat("turn", F.lit(".5")).try_cast("double").alias("turn_number"))


@query("P13_resumable_steps", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE (l_returnflag, l_linenumber) NOT IN (SELECT (l_returnflag, l_linenumber) FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A' AND l_linenumber < 4)")
def _(t):
    grid = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
    done = grid.where("l_linestatus = 'F' AND l_returnflag = 'A' AND l_linenumber < 4").select("l_returnflag", "l_linenumber").distinct()
    return grid.join(done, ["l_returnflag", "l_linenumber"], "left_anti").select("l_returnflag", "l_linestatus", "l_linenumber")


@query("P14_field_lookup_any_case", "SELECT c_custkey, c_acctbal AS value FROM customer")
def _(t):
    from ..sources.tables import resolve_field

    c = t.customer
    return c.select("c_custkey", F.col(resolve_field(c, "C_AcctBal")).alias("value"))


@query("P15_brush_label", f"WITH {PLANE}, s AS (SELECT * FROM (VALUES (1, 300.0, 310.0, 'pos'), (2, 320.0, 330.0, 'neg'), (3, 350.0, 300.0, 'pos')) v(no, px, py, label)) SELECT id, arg_max(s.label, no) AS label FROM p, s WHERE ((x + 1) / 2 * 640 - px) ** 2 + ((y + 1) / 2 * 640 - py) ** 2 <= 1600 GROUP BY id")
def _(t):
    p = plane(t).select("id", ((F.col("x") + 1) / 2).alias("x"), ((F.col("y") + 1) / 2).alias("y"))
    strokes = t.spark.createDataFrame([(1, 300.0, 310.0, "pos"), (2, 320.0, 330.0, "neg"), (3, 350.0, 300.0, "pos")], "no int, px double, py double, label string")
    return sets.brush(p, strokes, 40.0, 640.0, 640.0)


@query("P16_histogram_bin_slice", "SELECT p_partkey FROM part WHERE least(greatest(floor(p_size / 50.0::DOUBLE * 20), 0), 19) BETWEEN 4 AND 9")
def _(t):
    return t.part.where(sets.bin_between(F.col("p_size") / F.lit(50.0), 20, 4, 9)).select("p_partkey")


@query("P17_topmost_hit", f"WITH {PLANE} SELECT arg_max(id, id * 7919 % 1009 * 1000000 + id) AS id FROM p WHERE x - 0.02 <= 0.03 AND x + 0.02 >= 0.03 AND y - 0.02 <= 0.01 AND y + 0.02 >= 0.01")
def _(t):
    p = plane(t)
    boxes = p.select("id", (F.col("x") - 0.02).alias("x0"), (F.col("x") + 0.02).alias("x1"), (F.col("y") - 0.02).alias("y0"), (F.col("y") + 0.02).alias("y1"), (F.col("id") * 7919 % 1009 * 1000000 + F.col("id")).alias("draw_order"))
    return sets.topmost(boxes, 0.03, 0.01)


@query("P18_batch_selection", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 7, 11)")
def _(t):
    names = [r[0] for r in t.nation.where("n_nationkey IN (3, 7, 11)").select("n_name").collect()]
    return sets.select_named(t.nation, "n_name", names).select("n_nationkey", "n_name")


@query("P19_viewport_window", f"WITH {PLANE} SELECT id FROM p WHERE (x + 1) / 2 BETWEEN 0.3 AND 0.5 AND (y + 1) / 2 BETWEEN 0.45 AND 0.65")
def _(t):
    (x0, x1), (y0, y1) = sets.viewport(0.4, 0.2), sets.viewport(0.55, 0.2)
    p = plane(t)
    return p.where(((F.col("x") + 1) / 2).between(round(x0, 9), round(x1, 9)) & ((F.col("y") + 1) / 2).between(round(y0, 9), round(y1, 9))).select("id")


@query("U1_ordered_union_first_wins", """
WITH a AS (SELECT 0 AS part, min(p_partkey) AS n, p_type AS v FROM part GROUP BY p_type), b AS (SELECT 1 AS part, min(p_partkey) AS n, lower(p_name) AS v FROM part GROUP BY lower(p_name) UNION ALL SELECT 1, min(p_partkey) + 100000, lower(p_type) FROM part GROUP BY p_type)
SELECT part, n, v FROM (SELECT *, row_number() OVER (PARTITION BY lower(v) ORDER BY part, n) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rn = 1""")
def _(t):
    p = t.part
    a = p.groupBy(F.col("p_type").alias("v")).agg(F.min("p_partkey").alias("n"))
    b = p.groupBy(F.lower("p_name").alias("v")).agg(F.min("p_partkey").alias("n")).unionByName(a.select(F.lower("v").alias("v"), (F.col("n") + 100000).alias("n")))
    return sets.ordered_union([a, b], "v")


@query("U2_tagged_union_all", "SELECT 'train' AS source_split, c_custkey AS id, c_name AS name, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 'test', p_partkey, p_name, p_brand FROM part")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return sets.tagged_union({"train": a, "test": b}, "source_split").select("source_split", "id", "name", "brand")


@query("U3_intersect_except", "(SELECT o_custkey FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    o, c = t.orders, t.customer
    rich = o.where("o_totalprice > 100000").select("o_custkey")
    return rich.intersect(c.where("c_acctbal > 0").select("c_custkey")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("U4_concept_chain", "SELECT DISTINCT p_partkey FROM part WHERE (p_size < 20 AND p_type = 'ECONOMY') OR p_brand = 'Brand#5'")
def _(t):
    ids = lambda c: t.part.where(c).select("p_partkey")
    return sets.chain([ids("p_size < 20"), ids("p_type = 'ECONOMY'"), ids("p_brand = 'Brand#5'")], ["AND", "OR"], "p_partkey")


@query("U5_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("U7_union_and_complement", "SELECT 'positive' AS kind, n_nationkey FROM nation WHERE n_regionkey IN (0, 2) OR n_nationkey < 3 UNION ALL SELECT 'rest', n_nationkey FROM nation WHERE NOT (n_regionkey = 1 OR n_nationkey > 20)")
def _(t):
    n = t.nation
    pos, rest = sets.union_and_complement(n.select("n_nationkey"), "n_nationkey", [n.where("n_regionkey IN (0, 2)"), n.where("n_nationkey < 3")], [n.where("n_regionkey = 1"), n.where("n_nationkey > 20")])
    return sets.tagged_union({"positive": pos, "rest": rest}, "kind").select("kind", "n_nationkey")
