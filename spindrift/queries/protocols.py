"""What can be plugged in."""

from pyspark.sql import functions as F

from ..catalog import query
from ..plans import protocols
from .aggregates import PLANE, plane
from .images import PIXELS, pixels
from .vectors import EXACTLY_SCORED, SCORED, direction


def items(t):
    return t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("X1_prior_scorer", f"WITH {SCORED} SELECT vec_id, z, 0.0::DOUBLE AS std FROM s")
def _(t):
    scorer = protocols.SCORERS["prior"]
    state = scorer.restore(scorer.export(scorer.feedback(items(t), scorer.begin(direction(t)), [("3", 95.0, "score")])))
    return scorer.score(items(t), state).select(F.col("id").cast("long").alias("vec_id"), F.round("z", 6).alias("z"), "std")


@query("X1_exported_scorer_agrees")
def _(t):
    scorer = protocols.SCORERS["gaussian"]
    state = scorer.feedback(items(t), scorer.begin(direction(t)), [("3", 95.0, "score"), ("11", 10.0, "score")])
    a, b = scorer.score(items(t), state), scorer.score(items(t), scorer.restore(scorer.export(state)))
    return a.alias("a").join(b.alias("b"), "id").agg(F.count("*").alias("n"), F.count_if((F.abs(F.col("a.z") - F.col("b.z")) < 1e-12) & (F.abs(F.col("a.std") - F.col("b.std")) < 1e-12)).alias("same"))


LABELLED = "l AS (SELECT vec_id, label / 9.0::DOUBLE AS y FROM embeddings WHERE vec_id < 24)"


@query("X2_prior_affine_session", f"""
WITH {EXACTLY_SCORED}, {LABELLED}, m AS (SELECT avg(z) AS mz, avg(y) AS my FROM l JOIN s USING (vec_id)), f AS (SELECT sum((z - mz) * (y - my)) / (sum((z - mz) ** 2) + 0.1) AS a FROM l JOIN s USING (vec_id), m)
SELECT vec_id, round(a * z + my - a * mz, 5) AS score FROM s, f, m""")
def _(t):
    told = protocols.session("prior affine", direction(t))
    for r in t.embeddings.where("vec_id < 24").orderBy("vec_id").collect():  # what a person has labelled
        told = told.observe(str(r["vec_id"]), r["embedding"], r["label"] / 9)
    return told.predict(items(t)).select(F.col("id").cast("long").alias("vec_id"), F.round("score", 5).alias("score"))


@query("X2_sessions")
def _(t):
    from functools import reduce

    rows = t.embeddings.where("vec_id < 24").orderBy("vec_id").collect()
    out = []
    for name in protocols.SESSIONS.names():
        told = protocols.session(name, direction(t))
        for r in rows:
            told = told.observe(str(r["vec_id"]), r["embedding"], r["label"] / 9)
        out.append(told.predict(items(t)).select(F.lit(name).alias("method"), F.col("id").cast("long").alias("vec_id"), F.round("score", 5).alias("score")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("X3_registries", "SELECT * FROM (VALUES ('scorer', 'gaussian'), ('scorer', 'rank'), ('scorer', 'graph'), ('scorer', 'piecewise'), ('scorer', 'residual'), ('scorer', 'cosine'), ('brush', 'disc'), ('brush', 'square'), ('brush', 'diamond'), ('extractor', 'means'), ('extractor', 'histogram')) v(kind, name)")
def _(t):
    rows = [(r.kind, n) for r in (protocols.SCORERS, protocols.BRUSHES, protocols.EXTRACTORS) for n in r.names()]
    return t.spark.createDataFrame(rows, "kind string, name string")


@query("X4_extracted_means", f"WITH {PIXELS} SELECT item, round(avg(r) / 255, 6) AS r, round(avg(g) / 255, 6) AS g, round(avg(b) / 255, 6) AS b FROM px GROUP BY item")
def _(t):
    v = F.col("v")
    return protocols.embed(pixels(t), "item", "means", "r", "g", "b").select("item", *[F.round(v[i], 6).alias(c) for i, c in enumerate("rgb")])


@query("X6_prompt_variants", """
WITH c AS (SELECT DISTINCT p_type AS concept, 'very ' || lower(p_type) AS high, 'not ' || lower(p_type) AS low FROM part), s AS (SELECT concept, 'high' AS side, high AS x FROM c UNION ALL SELECT concept, 'low', low FROM c)
SELECT concept, 'anchors' AS variant, side, 0 AS no, x AS text FROM s UNION ALL SELECT concept, 'ensemble', side, no, pre || x FROM s, (VALUES (0, ''), (1, 'a photo of '), (2, 'something ')) v(no, pre) UNION ALL SELECT concept, 'concept', side, 0, concept || ': ' || x FROM s""")
def _(t):
    c = t.part.select(F.col("p_type").alias("concept")).distinct().select("concept", F.concat(F.lit("very "), F.lower("concept")).alias("high"), F.concat(F.lit("not "), F.lower("concept")).alias("low"))
    return protocols.prompt_rows(c, "concept", "high", "low", ["anchors", "ensemble", "concept"])


@query("X8_brush_strategies", f"""
WITH {PLANE}, q AS (SELECT id, (x + 1) / 2 * 640 AS px, (y + 1) / 2 * 480 AS py FROM p)
SELECT 'disc' AS strategy, id FROM q WHERE (px - 320) ** 2 + (py - 240) ** 2 <= 900 UNION ALL SELECT 'square', id FROM q WHERE abs(px - 320) <= 30 AND abs(py - 240) <= 30 UNION ALL SELECT 'diamond', id FROM q WHERE abs(px - 320) + abs(py - 240) <= 30""")
def _(t):
    p = plane(t).select("id", ((F.col("x") + 1) / 2).alias("x"), ((F.col("y") + 1) / 2).alias("y"))
    disc, square, diamond = (protocols.brushed(p, (320.0, 240.0), 30.0, 640.0, 480.0, s).select(F.lit(s).alias("strategy"), "id") for s in protocols.BRUSHES.names()[:3])
    return disc.unionByName(square).unionByName(diamond)
