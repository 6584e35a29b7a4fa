"""What plans hold: their size and their broadcasts don't follow the tables."""

from pyspark.sql import functions as F

from spindrift.operators import metadata, ranks


def test_row_numbers_with_many_crowded_values_have_a_small_plan(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", 20)
    d = spark.range(6000).select(F.col("id").alias("k"), ((F.col("id") * 37 % 60 - 30) / F.lit(60.0)).alias("v"))
    d = d.withColumn("v", F.when((F.col("v") == 0) & (F.col("k") % 2 == 0), F.lit(-0.0)).otherwise(F.col("v")))
    for descending in (False, True):
        r = ranks.row_numbers(d, "v", "k", "rn", descending=descending)
        assert r._jdf.queryExecution().logical().toString().count("CASE WHEN") < 3000
        rows = sorted(r.collect(), key=lambda x: (-x["v"] if descending else x["v"], x["k"]))
        assert [x["rn"] for x in rows] == list(range(1, 6001))


def test_match_keys_broadcasts_no_registry(spark):
    items = spark.range(50).select(F.concat(F.lit("Set/n_"), "id", F.lit(".jpg")).alias("id"))
    rows = spark.createDataFrame([(1, "set\\N_7.JPG"), (2, "x/n_8.png"), (3, "no"), (4, None), (5, "Set/n_9.jpg")], "row_id int, k string")
    got = metadata.match_keys(rows, "k", items, "id").select("row_id", "id")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "Set/n_7.jpg"), (2, "Set/n_8.jpg"), (5, "Set/n_9.jpg")]


def test_graph_model_numbers_items_in_no_single_task(spark, monkeypatch):
    from spindrift.operators import similarity
    from spindrift.plans.axis import Axis

    asked, knn = [], similarity.knn
    monkeypatch.setattr(similarity, "knn", lambda left, *a, **b: (asked.append(left), knn(left, *a, **b))[1])
    items = spark.range(60).select("id", F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(4)]).alias("v"))
    ids = [r["id"] for r in Axis.create(items, "id", "v", [1.0, 0.0, 0.0, 0.0], mode="graph").scores().collect()]
    assert len(ids) == 60
    assert "Window" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()
    rows = asked[0].select("id", "no").collect()
    assert [r["no"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(60))


def test_scores_of_representations_are_found_once(spark):
    """Ranks read a written table: no plan holds the cosines, and the second column's ranks don't find the first's again."""
    import numpy as np

    from spindrift.operators import metrics
    from spindrift.plans import study

    x = np.random.default_rng(3).standard_normal((300, 6))
    d = spark.createDataFrame([(i, float(i % 7) / 6, v.tolist()) for i, v in enumerate(x)], "id int, ref double, v array<double>")
    scored = study.representations(d, "id", "ref", {"all": ("v", [1.0] + [0.0] * 5)}, [(0, 0.2), (1, 0.9)], (0, 2))
    steps = study.representation_steps(scored)
    assert "aggregate(" not in steps._jdf.queryExecution().optimizedPlan().toString()
    got = {r["budget"]: r for r in steps.collect()}
    assert set(got) == {0, 2} and abs(got[0]["with_prior"] - 1) < 1e-9
    one = metrics.spearman(scored, "score", "ref", ["budget"])
    assert one._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter") == 2
    assert all(abs(r["spearman"] - got[r["budget"]]["with_ref"]) < 1e-9 for r in one.collect())
