"""M1 to M26 over the embeddings."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import vectors as V
from ..plans import graph, models, search, study
from ..plans.axis import Axis, State
from ..session import folder, workspace
from .aggregates import PLANE, plane
from .vectors import SCORED, direction


def axis(t, mode="gaussian", moves=(), **options):
    a = Axis.create(t.embeddings, "vec_id", "embedding", direction(t), mode=mode, **options)
    for item, score, kind in moves:
        a = a.move(item, score, kind)
    return a


MOVES = (("3", 95.0, "score"), ("11", 10.0, "score"), ("20", 50.0, "score"), ("7", 0.0, "undefined"), ("20", 80.0, "score"), ("11", 0.0, "delete"))
SHORT = (("3", 95.0, "score"), ("11", 10.0, "score"))


def told(df):
    return df.select(F.col("id").cast("long").alias("vec_id"), F.round("z", 5).alias("z"), F.round("std", 5).alias("std"))


@query("M1_create_axis", f"WITH {SCORED} SELECT vec_id, z FROM s")
def _(t):
    return axis(t).scores().select(F.col("id").cast("long").alias("vec_id"), F.round("z", 6).alias("z"))


@query("M2_M3_gaussian_posterior")
def _(t):
    return told(axis(t, moves=SHORT).scores())


@query("M4_M5_rank_posterior")
def _(t):
    return told(axis(t, "rank", SHORT).scores())


@query("M6_graph_posterior")
def _(t):
    return told(axis(t, "graph", SHORT).scores())


@query("M6_graph_field")
def _(t):
    """The same field as a table of edges: no item or edge comes to the driver."""
    e = t.embeddings.select("vec_id", "embedding")
    with workspace(t.spark) as write:
        edges = write(graph.neighbour_edges(e, "vec_id", "embedding", 4), "graph")
        z0 = write(axis(t).scores().select(F.col("id").cast("long").alias("id"), F.col("z").alias("z0")), "prior")
        field = graph.Field(z0.select("id"), edges, prior=0.5)
        out = field.posterior(z0, [(3, 0.5, 1.0), (11, -0.5, 1.0)], probes=6)
        return write(out.select(F.col("id").alias("vec_id"), F.round("z", 5).alias("z"), F.round(F.sqrt("variance"), 4).alias("std"), F.round("error", 4).alias("error")), "field", keep=True)


@query("M7_piecewise_mixture")
def _(t):
    return told(axis(t, "piecewise", SHORT).scores())


@query("M8_residual_process")
def _(t):
    return told(axis(t, "residual", SHORT).scores())


@query("M9_M10_move_state")
def _(t):
    s = axis(t, moves=MOVES).state
    rows = [(k, v[0], round(v[1], 6), False) for k, v in s.targets.items()] + [(k, None, None, True) for k in s.undefined]
    return t.spark.createDataFrame(rows, "id string, target double, weight double, undefined boolean")


@query("M11_update_prompts")
def _(t):
    a = axis(t, moves=SHORT)
    return told(a.with_prior([-x for x in a.state.w0]).scores())


@query("M12_axis_payload")
def _(t):
    items, _, _ = axis(t, moves=SHORT).payload()
    return items.select(F.col("id").cast("long").alias("vec_id"), *[F.round(c, 5).alias(c) for c in ("coord", "score100", "std")])


@query("W6_decile_exemplars")
def _(t):
    _, deciles, _ = axis(t, moves=SHORT).payload()
    return deciles.select("bin", F.col("id").cast("long").alias("vec_id"), "place", F.round("score", 6).alias("score"))


@query("W7_hotspots")
def _(t):
    _, _, hot = axis(t, moves=SHORT).payload()
    return hot.select(F.col("id").cast("long").alias("vec_id"), "place", F.round("score", 6).alias("score"), F.round("priority", 6).alias("priority"))


@query("M13_round_trip_and_project")
def _(t):
    a = axis(t, moves=SHORT)
    again = Axis(t.embeddings, "vec_id", "embedding", State.from_json(a.state.to_json()))
    return told(again.project(t.embeddings.where("vec_id % 2 = 0"), "vec_id", "embedding"))


def labels(t):
    return t.embeddings.where("vec_id < 40").select("vec_id", (F.col("label") / F.lit(9.0)).alias("y"))


for _name in study.BASELINES:

    def _baseline(t, name=_name):
        s = study.score_baseline(t.embeddings, "vec_id", "embedding", labels(t), name)
        return s.select("vec_id", F.round("score", 5).alias("score"))

    query({"label_mean": "M19_label_mean", "ridge": "M14_label_only_ridge", "ols": "M19_ols", "bayesian_ridge": "M19_bayesian_ridge", "elastic_net": "M19_elastic_net", "pcr_ridge": "M19_pcr_ridge", "linear_svr": "M19_linear_svr", "kernel_ridge": "M18_kernel_ridge", "rank_svm": "M18_rank_svm"}[_name], "SELECT vec_id, round((SELECT avg(label / 9.0::DOUBLE) FROM embeddings WHERE vec_id < 40), 5) AS score FROM embeddings" if _name == "label_mean" else None)(_baseline)


E1 = "list_transform(a.embedding, lambda x: x::DOUBLE)"
E2 = "list_transform(b.embedding, lambda x: x::DOUBLE)"


@query("M15_knn_propagation", f"""
WITH s AS (SELECT a.vec_id AS src, b.label / 9.0::DOUBLE AS y, round(list_inner_product({E1}, {E2}) / (sqrt(list_inner_product({E1}, {E1})) * sqrt(list_inner_product({E2}, {E2}))), 9) AS sim, b.vec_id AS dst FROM embeddings a, embeddings b WHERE b.vec_id < 40),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM s)
SELECT src AS vec_id, round(sum(exp(12 * (sim - 1)) * y) / sum(exp(12 * (sim - 1))), 6) AS score FROM r WHERE rn <= 15 GROUP BY src""")
def _(t):
    return study.knn_propagation(t.embeddings, "vec_id", "embedding", labels(t)).select("vec_id", F.round("score", 6).alias("score"))


@query("M16_prompt_sessions")
def _(t):
    w = direction(t)
    pairs = t.embeddings.select("vec_id", V.cosine(F.col("embedding"), V.literal(w[:32] + [0.0] * 32)).alias("first"), V.cosine(F.col("embedding"), V.literal(w)).alias("whole"))
    return pairs.select("vec_id", F.round("first", 6).alias("first_pair"), F.round("whole", 6).alias("ensemble"))


@query("M17_prompt_ladder")
def _(t):
    steps = [r[0] for r in t.embeddings.where("vec_id < 5").orderBy("vec_id").select("embedding").collect()]
    return V.expected_level(t.embeddings.select("vec_id", "embedding"), "embedding", steps, 30.0).select("vec_id", F.round("expected", 5).alias("level"))


@query("M20_prior_affine")
def _(t):
    import numpy as np

    w = direction(t)
    d = t.embeddings.select("vec_id", V.cosine(F.col("embedding"), V.literal(w)).alias("s0"), (F.col("label") / F.lit(9.0)).alias("y"))
    rows = d.where("vec_id < 40").orderBy("vec_id").collect()
    a, b = study.prior_affine(np.array([r["s0"] for r in rows]), np.array([r["y"] for r in rows]))
    return d.select("vec_id", F.round(F.col("s0") * F.lit(a) + F.lit(b), 6).alias("score"))


@query("M21_calibrated_residual")
def _(t):
    import numpy as np

    w = np.array(direction(t))
    rows = t.embeddings.where("vec_id < 40").orderBy("vec_id").select("embedding", "label").collect()
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] / 9 for r in rows])
    lam, beta, err = study.calibrated_residual(x, y, x @ w)
    return t.spark.createDataFrame([(lam, round(beta, 6), round(err, 6))], "lambda double, blend double, error double")


def tasks(t):
    return t.embeddings.select((F.col("vec_id") % 2).alias("task"), "vec_id", "embedding", (F.col("label") == 3).cast("double").alias("ref"))


@query("E5_refinement_loop")
def _(t):
    return study.sweep(tasks(t), "vec_id", "embedding", "ref", "task", direction(t), [study.Setting(policy=p) for p in ("random", "uncertainty", "diversity", "hybrid")]).select("task", "setting", "budget", F.round("spearman", 4).alias("spearman"), F.round("auroc", 4).alias("auroc"))


@query("E5_undefined_feedback")
def _(t):
    d = tasks(t).withColumn("void", F.col("vec_id") % 5 == 0)
    return study.sweep(d, "vec_id", "embedding", "ref", "task", direction(t), [study.Setting(policy=p) for p in ("random", "uncertainty")], "void").select("task", "setting", "allowed", "budget", "numeric", "undefined", F.round("spearman", 4).alias("spearman"), F.round("spearman_defined", 4).alias("spearman_defined"))


@query("M23_centred_prompt_sweep")
def _(t):
    w = direction(t)
    priors = {"whole": w, "first": w[:32] + [0.0] * 32}  # two prompt variants of one concept
    s = study.centred_sweep(tasks(t), "vec_id", "embedding", "ref", "task", priors, (1.0, 100.0), (0.25, 1.0), 2)
    return s.groupBy("variant", "lambda", "share", "budget").agg(F.round(F.avg("spearman"), 4).alias("spearman"), F.round(F.avg("preservation"), 4).alias("preservation"), F.round(F.avg("direction_change"), 4).alias("direction_change"))


@query("M22_M23_gaussian_sweep")
def _(t):
    grid = [study.Setting(a, s, b) for a in (0.3, 1.0) for s in (0.01, 0.04) for b in (0.5, 1.0)]
    return study.sweep(tasks(t), "vec_id", "embedding", "ref", "task", direction(t), grid).groupBy("setting").agg(F.round(F.avg(F.when(F.col("budget") == 20, F.col("auroc"))), 4).alias("final_auroc"))


@query("M24_seeded_search")
def _(t):
    import numpy as np

    g = np.random.Generator(np.random.PCG64(20260313))
    trials = [study.Setting(float(10 ** g.uniform(-1, 1)), float(10 ** g.uniform(-2.5, -0.5)), float(10 ** g.uniform(-1, 1)), replicate=i) for i in range(12)]
    s = study.sweep(tasks(t), "vec_id", "embedding", "ref", "task", direction(t), trials).where("budget = 20").groupBy("setting").agg(F.avg("auroc").alias("objective"))
    return s.select("setting", F.round("objective", 4).alias("objective")).orderBy(F.col("objective").desc(), "setting").limit(3)


SPACE = {"alpha": search.Number(0.01, 10.0, log=True), "sigma2": search.Number(5e-4, 0.5, log=True), "share": search.Number(0.0, 1.0), "told": search.Number(2, 12, step=1), "targets": search.Choice(("plain", "centred"))}


def class_axes(items, named):
    """Objective of the search: how well the axes of all classes, each fitted with a trial's settings, go with the classes of all items.
    named: (class, vector) of the few items that a person has named."""
    import numpy as np

    classes = sorted({c for c, _ in named})
    x, own = np.array([v for _, v in named], float), np.array([c for c, _ in named])
    refs = items.select("embedding", *[(F.col("label") == c).cast("double").alias(f"is{c}") for c in classes])

    def direction_of(c, p):
        mine, others = np.flatnonzero(own == c)[: p["told"]], np.flatnonzero(own != c)[: 3 * p["told"]]
        told = np.concatenate([mine, others])
        y = (own[told] == c).astype(float)
        y = y - y.mean() if p["targets"] == "centred" else y
        prior = x[mine[:1]].mean(axis=0)
        fit = models.fit_gaussian(models.unit(prior), x[told], y, np.ones(len(told)), p["alpha"], p["sigma2"])
        return p["share"] * models.unit(prior) + (1 - p["share"]) * models.unit(fit.mu)

    def objective(batch):
        directions = np.array([[direction_of(c, p) for c in classes] for p in batch])
        return np.round(search.correlations(refs, "embedding", [f"is{c}" for c in classes], directions).mean(axis=1), 9).tolist()

    return objective


@query("M24_tpe_search")
def _(t):
    named = [(r[0], r[1]) for r in t.embeddings.where("vec_id < 100").orderBy("vec_id").select("label", "embedding").collect()]  # what a person has named
    trials = search.search(t.spark, SPACE, class_axes(t.embeddings, named), 40, folder(t.spark, "trials"))
    return trials.orderBy(F.col("value").desc(), "trial").limit(5).select("trial", F.round("value", 6).alias("value"), F.round(F.get_json_object("parameters", "$.share").cast("double"), 4).alias("share"), F.get_json_object("parameters", "$.targets").alias("targets"))


def replayed(t):
    w = direction(t)
    d = t.embeddings.select("vec_id", (F.col("label") / F.lit(9.0)).alias("ref"), "embedding", F.slice("embedding", 1, 32).alias("first"), F.slice("embedding", 33, 32).alias("second"))
    moves = [(r[0], r[1]) for r in d.where("vec_id < 20").orderBy("vec_id").select("vec_id", "ref").collect()]  # what a person has moved
    return study.representations(d, "vec_id", "ref", {"whole": ("embedding", w), "first": ("first", w[:32]), "second": ("second", w[32:])}, moves, study.BUDGETS)


@query("M25_representation_steps")
def _(t):
    return study.representation_steps(replayed(t)).select("representation", "budget", F.round("with_prior", 4).alias("with_prior"), F.round("with_ref", 4).alias("with_ref"))


@query("M25_representation_pairs")
def _(t):
    return study.representation_pairs(replayed(t), "vec_id").select("one", "other", *[F.round(c, 4).alias(c) for c in ("spearman", "top_shared", "low_shared")])


@query("M26_calibration_override", f"WITH {PLANE} SELECT id, CASE WHEN id % 50 = 1 THEN 0.9::DOUBLE ELSE round((x + 1) / 2, 8) END AS value FROM p")
def _(t):
    p = plane(t).select("id", F.round((F.col("x") + 1) / 2, 8).alias("value"))
    over = p.where("id % 50 = 1").select("id", F.lit(0.9).alias("forced"))
    return p.join(over, "id", "left").select("id", F.coalesce("forced", "value").alias("value"))
