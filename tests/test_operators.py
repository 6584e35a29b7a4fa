"""Behaviour that SQL doesn't check: models, greedy picks, layouts, streams, sources."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import aggregates, layout, metrics, ranks, selection, similarity
from spindrift.plans import models, study
from spindrift.plans.axis import Axis, Options, State, apply, forget
from spindrift.plans.config import parse_methods
from spindrift.sources import tables as S


@pytest.fixture(autouse=True, params=[4])
def many_stretches(request, monkeypatch):
    """Small tables are worked off in many stretches here, as large ones are."""
    from spindrift.operators import ranks as R

    monkeypatch.setattr(R, "ROWS", request.param)
    monkeypatch.setattr(metrics, "ROWS", request.param)



def percentile(values):
    n = len(values)
    return [0.5 if n == 1 else (sum(w < v for w in values) + (sum(w == v for w in values) - 1) / 2) / (n - 1) for v in values]


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 1.0], [2.0, None, 1.0, 2.0, 5.0], [float(i * 7 % 23) for i in range(400)]])
def test_rank_percentile(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {r.id: r.pct for r in ranks.rank_percentile(df, "v").collect()}
    known = [v for v in values if v is not None]
    want = dict(zip([i for i, v in enumerate(values) if v is not None], percentile(known), strict=True))
    assert all(math.isclose(got[i], p) for i, p in want.items()) and all(got[i] is None for i in got if i not in want)


def test_row_numbers_and_ntile(spark):
    rows = [(i, float(i * 37 % 11)) for i in range(503)]
    df = spark.createDataFrame(rows, "id int, v double")
    order = [i for i, v in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [r.id for r in sorted(ranks.row_numbers(df, "v", "id").collect(), key=lambda r: r.rn)] == order
    bins = {r.id: r.bin for r in ranks.ntile(df, "v", "id", 10).collect()}
    for k, part in enumerate(np.array_split(np.array(order), 10)):
        assert {bins[i] for i in part} == {k + 1}


def test_row_numbers_of_crowded_values(spark):
    rows = [(i, [None, 2.0, 2.0, 2.0 + 4e-13, 7.0 + i % 5][i * 7 % 5] if i % 3 else 2.0, "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v double, g string")
    last = lambda v: (v is None, v or 0.0)
    assert [r.id for r in ranks.row_numbers(df, "v", "id").orderBy("rn").collect()] == [i for i, v, _ in sorted(rows, key=lambda r: (last(r[1]), r[0]))]
    down = ranks.row_numbers(df, "v", ["id"], "rn", True, ["g"]).orderBy("rn").collect()
    assert [r.id for r in down] == [i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[1] is None, -(r[1] or 0.0), r[0]))]
    assert [r.rn for r in down] == list(range(1, 3001))


@pytest.mark.parametrize("eps", [0.0, 1e-6, 0.3])
def test_kendall_counts_all_pairs(spark, monkeypatch, eps):
    monkeypatch.setattr(metrics, "ASKING", 50)
    rows = [(f"g{i % 3}" if i % 7 else None, float(i * 37 % 101) if i % 4 else 5.0, float(i * 53 % 13) / 10 if i % 2 else 0.4) for i in range(900)] + [("none", None, 1.0), ("one", 1.0, 1.0), ("same", 1.0, 2.0), ("same", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, p double, r double")

    def want(of):
        of = [(p, r) for p, r in of if p is not None]
        signs = [(p > q) - (p < q) for p, r in of for q, t in of if t < r - eps]
        return len(signs), sum(signs) / len(signs), (signs.count(1) + signs.count(0) / 2) / len(signs)

    got = metrics.kendall(df, "p", "p", "r", eps=eps).first()
    assert got.valid == want([r[1:] for r in rows])[0] and np.allclose(got, want([r[1:] for r in rows]))
    groups = {r.g: tuple(r)[1:] for r in metrics.kendall(df, "p", "p", "r", ["g"], eps).collect()}
    assert set(groups) == {None, "g0", "g1", "g2"}
    assert all(np.allclose(v, want([r[1:] for r in rows if r[0] == g])) for g, v in groups.items())
    none = metrics.kendall(df.where("g = 'none'"), "p", "p", "r", eps=eps).first()
    assert tuple(none) == (0, None, None)


@pytest.mark.parametrize("metric", ["cosine", "sq_euclidean"])
def test_knn_is_exhaustive(spark, monkeypatch, metric):
    monkeypatch.setattr(similarity.neighbours, "LEAST", 16)
    monkeypatch.setattr(similarity.neighbours, "CELLS", 64)
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(120, 6)), 1)
    m[60:70] = m[3]  # ties
    rows = [(i * 3 % 127, [float(v) for v in x]) for i, x in enumerate(m)]
    df = spark.createDataFrame([*rows, (900, None)], "id long, v array<double>")
    near = similarity.knn(df, df, "id", "v", 4, metric)
    got: dict = {}
    for r in near.orderBy("src", F.col("sim").desc(), "dst").collect():
        got.setdefault(r.src, []).append((r.dst, r.sim))
    ids, norms = [i for i, _ in rows], np.linalg.norm(m, axis=1)
    sim = np.round(np.clip(m @ m.T / np.outer(norms, norms), -1, 1) if metric == "cosine" else -((m[:, None] - m[None]) ** 2).sum(axis=2), 9)
    assert set(got) == set(ids)
    for a, i in enumerate(ids):
        best = sorted(((-sim[a, b], j) for b, j in enumerate(ids) if j != i))[:4]
        assert [d for d, _ in got[i]] == [j for _, j in best] and np.allclose([s for _, s in got[i]], [-s for s, _ in best])


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(zip([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0], strict=True))], "id int, p double, r int")
    assert metrics.auroc(df, "p", "r").first().auroc == 1.0
    k = metrics.kendall(df, "id", "p", "r").first()
    assert (k.tau, k.accuracy) == (1.0, 1.0)
    tied = spark.createDataFrame([(0.5, 1), (0.5, 1), (0.5, 0), (0.5, 0)], "p double, r int")
    assert metrics.auroc(tied, "p", "r").first().auroc == 0.5
    assert metrics.auroc(tied.where("r = 1"), "p", "r").first().auroc is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.floats(0, 1)), min_size=1, max_size=20))
def test_pava_is_monotone_and_best(rows):
    x, y = [float(a) for a, _ in rows], [b for _, b in rows]
    fit = metrics.pava(x, y)
    by = {}
    for a, f in zip(x, fit, strict=True):
        assert by.setdefault(a, f) == f
    steps = [by[a] for a in sorted(by)]
    assert all(a <= b + 1e-12 for a, b in zip(steps, steps[1:], strict=False))
    assert math.isclose(sum(fit), sum(y), abs_tol=1e-9)


@pytest.mark.parametrize(("t", "dof", "p"), [(0.0, 5, 0.5), (2.015, 5, 0.05), (1.0, 1, 0.25), (-1.0, 1, 0.75), (1.6449, 1e7, 0.05)])
def test_t_tail(t, dof, p):
    assert math.isclose(aggregates.t_tail(t, dof), p, abs_tol=2e-4)


def linear_problem(n=72, seed=42):
    g = np.random.Generator(np.random.PCG64(seed))
    x = np.hstack([g.normal(size=(n, 2)), np.full((n, 1), 0.25)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_gaussian_matches_the_dual_form():
    x, w0 = linear_problem(), np.array([1.0, 0.0, 0.0])
    at, y, w = [3, 20, 41], np.array([0.9, -0.4, 0.2]), np.array([1.0, 1.5, 0.7])
    alpha, s2, beta = 0.8, 0.05, 1.3
    fit = models.fit_gaussian(w0, x[at], y, w, alpha, s2, beta)
    a = np.diag(s2 / w) + x[at] @ x[at].T / alpha + 1 / beta
    r = np.linalg.solve(a, y - x[at] @ w0)
    assert np.allclose(fit.mu, w0 + x[at].T @ r / alpha) and math.isclose(fit.b, r.sum() / beta)
    v = x[at] @ x.T / alpha + 1 / beta
    var = s2 + (x * x).sum(1) / alpha + 1 / beta - (v * np.linalg.solve(a, v)).sum(0)
    assert np.allclose(fit.std(x), np.sqrt(var))


def test_labels_lower_the_deviation():
    x, w0 = linear_problem(), np.array([1.0, 0.0, 0.0])
    none = models.fit_gaussian(w0, x[:0], np.zeros(0), np.zeros(0))
    some = models.fit_gaussian(w0, x[:6], x[:6, 1], np.ones(6))
    assert np.allclose(none.mu, w0) and (some.std(x)[:6] < none.std(x)[:6]).all()


def test_rank_is_at_the_optimum():
    x, w0 = linear_problem(), np.array([1.0, 0.2, 0.0])
    d, w = x[:10] - x[10:20], np.linspace(0.5, 2, 10)
    fit = models.fit_rank(w0, d, w, 0.6, 0.9)
    g = 0.6 * (fit.mu - w0) - d.T @ (w * models.sigmoid(-(d @ fit.mu) / 0.9)) / 0.9
    assert np.linalg.norm(g) < 1e-5


def nonlinear_problem(n=96, seed=7):
    g = np.random.Generator(np.random.PCG64(seed))
    x = np.hstack([g.uniform(-1, 1, (n, 2)), np.full((n, 1), 0.2)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, np.maximum(x[:, 0], x[:, 1])


PULL = 1.0  # holds the first expert near the prompt, so that a second one has something to add


def fitted(k):
    x, truth = nonlinear_problem()
    w0 = np.array([1.0, 0.0, 0.0])
    start = models.Mixture(models.initial_experts(w0, np.array([[0.0, 1.0, 0.0]]), k))
    g = np.random.Generator(np.random.PCG64(1))
    i, j = g.integers(0, len(x), (2, 400))
    i, j = np.where(truth[i] > truth[j], i, j), np.where(truth[i] > truth[j], j, i)
    ok = truth[i] - truth[j] > 0.05
    return models.fit_mixture(start, w0, x, i[ok], j[ok], np.ones(int(ok.sum())), np.zeros(0, int), np.zeros(0), np.zeros(0), steps=120, prior_strength=PULL, diversity=0.2), x, truth


def test_two_experts_beat_one():
    one, x, truth = fitted(1)
    two, _, _ = fitted(2)
    corr = [np.corrcoef(study._ranks(m.scores(x)[0]), study._ranks(truth))[0, 1] for m in (one, two)]
    assert corr[1] > corr[0] + 0.2
    assert np.allclose(np.linalg.norm(two.experts, axis=1), 1)


@pytest.mark.parametrize("how", ["max", "mean", "softmax", "gate"])
def test_mixture_gradient(how):
    """A step of the fit goes down the stated loss: checked by losses before and after."""
    x, truth = nonlinear_problem(40)
    w0 = np.array([1.0, 0.0, 0.0])
    e = models.initial_experts(w0, np.array([[0.0, 1.0, 0.0]]), 2)
    start = models.Mixture(e, how if how != "gate" else "max", np.zeros((2, 3)) if how == "gate" else None, np.zeros(2) if how == "gate" else None)
    order = np.argsort(-truth)
    i, j = order[:15], order[-15:]
    loss = lambda m: float(models.softplus(-(m.scores(x)[0][i] - m.scores(x)[0][j])).mean())
    end = models.fit_mixture(start, w0, x, i, j, np.ones(15), np.zeros(0, int), np.zeros(0), np.zeros(0), steps=30, prior_strength=0.0, diversity=0.0)
    assert loss(end) < loss(start)


def test_residual_moves_and_calms():
    x = linear_problem(7)
    empty = models.fit_residual(x[:0], np.zeros(0), np.zeros(0), 0.5)
    fit = models.fit_residual(x[3:4], np.array([0.6]), np.ones(1), 0.5)
    assert fit.correction(x)[3] > 0.15 and fit.std(x)[3] < empty.std(x)[3]


def test_graph_solves_the_dense_system(monkeypatch):
    g = np.random.Generator(np.random.PCG64(4))
    n = 30
    src, dst = np.arange(n - 1), np.arange(1, n)
    w = g.uniform(0.2, 1, n - 1)
    graph = models.Graph(n, src, dst, w, 2.0, 0.1)
    lap = np.zeros((n, n))
    for a, b, x in zip(src, dst, w, strict=True):
        lap[a, a] += x
        lap[b, b] += x
        lap[a, b] -= x
        lap[b, a] -= x
    k = np.linalg.inv(2.0 * lap + (0.1 + 1e-6) * np.eye(n))
    z0, at, y, weight = g.normal(size=n), np.array([4, 17]), np.array([1.0, -1.0]), np.array([1.0, 2.0])
    s = k[np.ix_(at, at)] + np.diag(0.04 / weight)
    mean, variance = graph.posterior(z0, at, y, weight, 0.04)
    assert np.allclose(mean, z0 + k[:, at] @ np.linalg.solve(s, y - z0[at]), atol=1e-6)
    assert np.allclose(variance, np.diag(k) - (k[:, at] * np.linalg.solve(s, k[at]).T).sum(1), atol=1e-6)
    assert np.allclose(graph.variances(), np.diag(k), atol=1e-9)
    monkeypatch.setattr(models, "EXACT_ITEMS", 0)
    monkeypatch.setattr(models, "PROBES", 4000)
    assert np.allclose(graph.variances(), np.diag(k), rtol=0.15)


def test_moves_are_a_pure_fold():
    s = State(Options(max_moves=2), (1.0, 0.0))
    a = apply(s, "score", "x", 140.0, 0.5)
    assert a.targets["x"][0] == 1.0 and s.targets == {}
    b = apply(apply(a, "score", "y", 30), "score", "x", 20)
    assert list(b.targets) == ["x", "y"] and b.targets["x"][0] == 0.2
    with pytest.raises(ValueError, match="no more"):
        apply(b, "score", "z", 1)
    u = apply(b, "undefined", "x")
    assert list(u.targets) == ["y"] and u.undefined == ("x",)
    assert apply(u, "score", "x", 5).undefined == ()
    r = apply(State(Options(max_pairs=16), (1.0,)), "score", "q", 1, pairs=tuple((str(i), "q", 1.0) for i in range(40)))
    assert len(r.pairs) == 16 and r.pairs[0][0] == "24" and forget(r, "24").pairs[0][0] == "25"
    assert State.from_json(b.to_json()) == b


@pytest.mark.parametrize("mode", ["gaussian", "rank", "piecewise", "residual", "graph"])
def test_axis_feedback(spark, mode):
    x = linear_problem(40)
    items = spark.createDataFrame([(f"d/i{k:02d}.png", list(map(float, r))) for k, r in enumerate(x)], "id string, v array<double>").cache()
    a = Axis.create(items, "id", "v", [1.0, 0.0, 0.0], mode=mode, experts=2)
    before = {r.id: r.score for r in a.percent().collect()}
    low = sorted(before, key=before.get)[18]  # one in the middle: a posterior never turns against its prior
    b = a.move(low.rsplit("/", 1)[-1], 85.0)  # found by its base name
    after = {r.id: r.score for r in b.percent().collect()}
    assert after[low] > before[low] + 0.02
    c = b.move("d/i05.png", kind="undefined")
    coords, deciles, hot = c.payload()
    assert coords.count() == 40 and "d/i05.png" not in {r.id for r in deciles.collect()} | {r.id for r in hot.collect()}
    if mode != "graph":
        assert b.project(items.where("id < 'd/i10'"), "id", "v").count() == 10
    with pytest.raises(KeyError):
        a.move("nothing", 3.0)


def test_diverse_pick():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [-1, 0], [0, 0]], float)
    assert selection.diverse(v, np.array([1.0, 0.95, 0.9, 0.1, 0.0]), 2) == [0, 2]
    assert selection.diverse(v, np.ones(5), 9) == [0, 1, 2, 3, 4]


def test_packing_gives_every_item_a_cell(spark):
    df = spark.createDataFrame([(i, 1 + i % 2, 1) for i in range(40)], "id int, gx int, gy int")
    got = layout.pack(df, "id", 8).collect()
    assert len({(r.px, r.py) for r in got}) == 40


def test_pca_finds_the_long_axis(spark):
    g = np.random.Generator(np.random.PCG64(8))
    x = g.normal(size=(300, 3)) @ np.diag([3, 1, 0.1]) + 5
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id int, v array<double>")
    pc = np.array([r.pc for r in layout.pca(df, "v", 2).orderBy("id").collect()])
    assert abs(np.corrcoef(pc[:, 0], x[:, 0])[0, 1]) > 0.99 and np.allclose(pc.mean(0), 0, atol=1e-8)


def test_baselines_on_a_line():
    x = linear_problem(60)
    y = x @ np.array([0.5, -0.2, 0.1]) + 0.4
    for name, fit in study.BASELINES.items():
        pred = fit(x, y)(x)
        assert name == "label_mean" or np.corrcoef(pred, y)[0, 1] > 0.9, name


def test_refinement_improves():
    x, w0 = linear_problem(120, 3), np.array([0.2, 1.0, 0.0])
    ref = np.array(percentile(list(x[:, 0])))
    rows = study.loop(x, ref, w0, list(range(120)), study.Setting(policy="uncertainty", sigma2=0.01))
    assert [r.budget for r in rows] == list(study.BUDGETS) and rows[-1].spearman > rows[0].spearman + 0.2


def test_undefined_answers_use_queries_up():
    x, w0 = linear_problem(60, 3), np.array([0.2, 1.0, 0.0])
    ref, void = np.array(percentile(list(x[:, 0]))), np.arange(60) % 2 == 0
    for policy in ("random", "uncertainty", "diversity", "hybrid"):
        s = study.Setting(policy=policy)
        plain, told, kept = (study.loop(x, ref, w0, list(range(60)), s, undefined=u, allowed=a) for u, a in ((None, True), (void, False), (void, True)))
        assert [(r.budget, r.spearman) for r in plain] == [(r.budget, r.spearman) for r in told] and not any(r.undefined for r in told)
        assert all(r.numeric + r.undefined == r.budget for r in kept) and kept[-1].undefined > 0
        assert plain[-1].spearman == plain[-1].spearman_defined and kept[0].spearman_defined == told[0].spearman_defined
    none = study.loop(x, ref, w0, list(range(60)), study.Setting(), undefined=np.ones(60, bool))
    assert len({r.spearman for r in none}) == 1 and none[-1].spearman_defined == 0.0 and none[-1].undefined == 20


def test_centred_scores_solve_the_normal_equations():
    x, w0 = linear_problem(40, 3), np.array([0.2, 1.0, 0.0])
    y, told = x @ np.array([0.5, -0.2, 0.1]) + 3, [3, 8, 1, 30, 12]
    z, w = study.centred_scores(x, y, told, w0, 0.5, 0.25)
    c = (x - x.mean(axis=0))[told]
    assert np.allclose((c.T @ c + 0.5 * np.eye(3)) @ (w - w0), c.T @ (y[told] - y[told].mean() - c @ w0))
    assert np.allclose(z, 0.75 * study.zscore(x @ w0) + 0.25 * study.zscore((x - x.mean(axis=0)) @ w))
    for few in ([], [3], [3, 3]):
        same, still = study.centred_scores(x, y, few, w0, 0.5, 0.25)
        assert np.allclose(same, x @ w0) and still is w0


def test_representations_replay_moves(spark):
    x = linear_problem(60, 3)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(r[0]), [float(r[0])]) for i, r in enumerate(x)], "id int, v array<double>, y double, one array<double>")
    moves = [(i, min(1.0, max(0.0, 0.5 + float(x[i, 0])))) for i in range(10)] + [(999, 0.5)]
    scored = study.representations(df, "id", "y", {"all": ("v", [0.2, 1.0, 0.0]), "one": ("one", [1.0])}, moves, (0, 10), study.Setting(sigma2=0.01)).persist()
    steps = {(r.representation, r.budget): r for r in study.representation_steps(scored).collect()}
    assert len(steps) == 4 and abs(steps["all", 0].with_prior - 1) < 1e-9 and steps["all", 10].with_ref > steps["all", 0].with_ref + 0.2
    pair = study.representation_pairs(scored, "id").first()
    last = {n: [r.score for r in scored.where(f"budget = 10 AND representation = '{n}'").orderBy("id").collect()] for n in ("all", "one")}
    a, b = (np.array(percentile([round(v, 9) for v in last[n]])) for n in ("all", "one"))
    assert (pair.one, pair.other) == ("all", "one") and math.isclose(pair.spearman, np.corrcoef(a, b)[0, 1], abs_tol=1e-9)
    assert math.isclose(pair.top_shared, ((a >= 0.9) & (b >= 0.9)).sum() / (a >= 0.9).sum())
    scored.unpersist()


def test_phrases_and_json():
    assert X.locate("The Red   house is big", "red house", []) == (4, 15, 0.94)
    assert X.locate("a b a b", "a b", [(0, 3)])[:2] == (4, 7)
    assert X.locate("some colourful hoses here", "colorful houses", [])[2] >= 0.72
    assert X.locate("abc", "zzz", []) is None
    assert X.first_object('x {bad ```json\n{"b": 1, "a": [1]}\n``` y') == '{"a":[1],"b":1}'
    assert X.first_object('[1] {"a": "}"}') == '{"a":"}"}' and X.first_object("none") is None and X.first_object(None) is None


def test_workbook(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>n</t></si><si><t>fox</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7</v></c></row><row><c r="A3" t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>')
    assert [r.cells for r in S.read_workbooks(spark, str(tmp_path)).collect()] == [{"name": "fox", "n": "7"}]


def test_strict_append_and_missing_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError, match="declared"):
        S.append_strict(df, str(tmp_path / "t"), spark.createDataFrame([], "id long, v string").schema)
    with pytest.raises(ValueError, match="match"):
        S.align_embeddings(df, df.where("id > 1"), "id")
    with pytest.raises(KeyError):
        S.resolve_field(df, "nothing")


def test_method_names():
    assert parse_methods("all") == ["clip", "dino", "siglip"] and parse_methods("DINOv2, clip,,dino") == ["dino", "clip"]
    with pytest.raises(ValueError, match="unknown"):
        parse_methods("magic")


def test_ties_within_the_tolerance(spark):
    v = [0.5, 0.5 + 4e-13, 0.5 - 3e-13, 0.25, 0.75, 0.75 + 1e-11]
    got = {r.id: r.pct for r in ranks.rank_percentile(spark.createDataFrame(list(enumerate(v)), "id int, v double"), "v", "pct").collect()}
    assert [got[i] for i in range(6)] == [0.4, 0.4, 0.4, 0.0, 0.8, 1.0]


def test_ranks_by_group(spark):
    """Groups, null groups and ties against a loop."""
    g = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [None, "a", "b"][i % 3], float(g.integers(0, 40)) if i % 17 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    for r in ranks.with_rank(df, "v", ["g"]).collect():
        own = [v for _, k, v in rows if k == r.g and v is not None]
        assert (r.rank_low, r.rank_ties, r.rank_n) == ((None,) * 3 if r.v is None else (sum(x < r.v for x in own), own.count(r.v), len(own)))


def test_isotonic_error_by_brute_force(spark):
    g = np.random.Generator(np.random.PCG64(9))
    rows = [(k, float(x), float(np.clip(x / 40 + g.normal(0, 0.4), 0, 1))) for k in "ab" for x in g.integers(0, 60, 400)]
    got = {r.g: r.mae for r in metrics.isotonic_mae(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    for k in "ab":
        x, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        at = np.unique(x)
        mean = np.array([y[x == a].mean() for a in at])
        weight = np.array([(x == a).sum() for a in at], float)
        # the fit at a point: the largest over starts of the smallest over ends of the means between
        cs, cw = np.append(0, np.cumsum(mean * weight)), np.append(0, np.cumsum(weight))
        fit = [max(min((cs[e + 1] - cs[b]) / (cw[e + 1] - cw[b]) for e in range(i, len(at))) for b in range(i + 1)) for i in range(len(at))]
        want = np.abs(np.clip(np.array(fit)[np.searchsorted(at, x)], 0, 1) - y).mean()
        assert abs(got[k] - want) < 1e-9


def test_cells_and_packing_order(spark):
    """Cells are counts of evenly spaced edges; items take free cells in order of wanted cells over the whole grid."""
    g = np.random.Generator(np.random.PCG64(7))
    xy = g.uniform(-1, 1, (60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id int, x double, y double")
    cells = {r.id: (r.gx, r.gy) for r in layout.grid_cells(df, "x", "y", 9).collect()}
    for c in (0, 1):
        edges = np.linspace(xy[:, c].min(), xy[:, c].max(), 8)
        assert [cells[i][c] for i in range(60)] == [int((edges <= v + 1e-12).sum()) for v in xy[:, c]]
    crowd = spark.createDataFrame([(i, 2 + i % 2, 3) for i in range(30)], "id int, gx int, gy int")
    free, want = np.ones((5, 5), bool), {}
    for i in sorted(range(30), key=lambda i: (3 * 5 + 2 + i % 2, i)):
        near = [(2 + i % 2 + dx, 3 + dy) for r in range(6) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if max(abs(dx), abs(dy)) == r]
        spot = next((p for p in near if 0 <= p[0] < 5 and 0 <= p[1] < 5 and free[p]), None)
        want[i] = spot or (0, 0)
        if spot:
            free[spot] = False
    assert {r.id: (r.px, r.py) for r in layout.pack(crowd, "id", 5).collect()} == want


def test_phrases_and_objects():
    from spindrift.functions import text as X

    assert X.locate("the part  x of it", "art x", []) is None or X.locate("the part  x of it", "art x", [])[2] < X.SPACED
    assert X.locate("the part  x of it", "\"part   x\"", []) == (4, 11, X.SPACED)
    assert X.locate("A Red   house", " 'red house' ", []) == (2, 13, X.SPACED)
    assert X.locate("red house", "red house", [(0, 3)]) is None
    assert X.first_object('x {"a": 1} ```json\n{"b": "}```{"}\n``` {"c": 3}') == '{"a":1}'
    assert X.first_object('[1, {"a": {"b": 2}}]') == '{"a":{"b":2}}' and X.first_object("{ no") is None and X.first_object(None) is None
    assert X.first_object("{} and more") == "{}" and X.first_object('```json\n{"b": "}```{"}\n```') == '{"b":"}```{"}'
    assert X.first_object('{"a":{"b":{"c":{"d":1}}}}') == '{"a":{"b":{"c":{"d":1}}}}' and X.first_object('{"a":"}"}') == '{"a":"}"}'


def test_one_item_s_score_and_the_fit_cache(spark):
    g = np.random.Generator(np.random.PCG64(12))
    x = g.normal(size=(50, 4))
    df = spark.createDataFrame([(f"i{i:02d}", list(map(float, r))) for i, r in enumerate(x)], "id string, v array<double>")
    a = Axis.create(df, "id", "v", [1.0, 0, 0, 0]).move("i07", 90.0)
    whole = {r.id: r.score for r in a.percent().collect()}
    assert all(abs(a._percent_of(i) - whole[i]) < 1e-12 for i in ("i00", "i07", "i31"))
    first = a.model()
    assert a.model() is first and a.move("i08", 10.0).model() is not first
    assert a._lengthscale() > 0 and a._lengthscale(10) > 0


def test_quantiles_are_exact(spark):
    g = np.random.Generator(np.random.PCG64(5))
    rows = [(k, float(v) if i % 11 else None) for k in "ab" for i, v in enumerate(g.normal(0, 3, 333).round(1))]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    own = {k: [v for x, v in rows if x == k and v is not None] for k in "ab"}
    for r in ranks.quantile(df, "v", ps, ["g"]).collect():
        assert np.allclose(r.q, np.quantile(own[r.g], ps))
    assert np.allclose(ranks.quantile(df, "v", ps).first().q, np.quantile(own["a"] + own["b"], ps))
    assert ranks.quantile(df.where("v IS NULL"), "v", ps).first().q is None


def test_what_is_plugged_in(spark):
    from spindrift.plans import protocols as P

    g = np.random.Generator(np.random.PCG64(2))
    x = g.normal(size=(60, 3))
    items = spark.createDataFrame([(f"i{i}", list(map(float, r))) for i, r in enumerate(x)], "id string, v array<double>")
    with pytest.raises(ValueError):
        P.SCORERS.add("GAUSSIAN", None)
    with pytest.raises(KeyError, match="cosine"):
        P.SCORERS["none"]
    s = P.SCORERS["gaussian"]
    state = s.feedback(items, s.begin([1.0, 0, 0]), [("i3", 100.0, "score"), ("i4", 0.0, "undefined")])
    again = s.restore(s.export(state))
    assert again == state and s.score(items, again).count() == 60
    plain = {r.id: r.z for r in P.SCORERS["prior"].score(items, state).collect()}
    assert np.isclose(plain["i0"], x[0, 0] / np.linalg.norm(x[0]))
    truth = 1 / (1 + np.exp(-x @ [1.0, 1.0, 0]))
    for name in P.SESSIONS.names():
        told = P.session(name, [1.0, 0, 0])
        for i in range(20):
            told = told.observe(f"i{i}", x[i], truth[i])
        assert len(told.observe("i0", x[0], 0.5).labels) == 20
        got = {r.id: r.score for r in told.predict(items).collect()}
        agreement = np.corrcoef([got[f"i{i}"] for i in range(20, 60)], truth[20:])[0, 1]
        assert agreement > (0.4 if name in ("prior", "prior affine", "ridge") else 0.8), (name, agreement)
    first = P.extractor("means")
    assert P.extractor("means") is first and np.allclose(first(np.array([[0, 255, 51], [255, 255, 51.0]])), [0.5, 1, 0.2])
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.55, 0.55), (3, 0.6, 0.5)], "id long, x double, y double")
    assert {r.id for r in P.brushed(p, (50.0, 50.0), 6.0, 100.0, 100.0, "square").collect()} == {1, 2}
    assert {r.id for r in P.brushed(p, (50.0, 50.0), 6.0, 100.0, 100.0).collect()} == {1}
    assert {r.id for r in P.brushed(p, (0, 0), 1.0, 1.0, 1.0, lambda x, y, at, r: y > 0.5).collect()} == {2}
