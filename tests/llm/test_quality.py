import re
from collections import Counter

import numpy as np
import pyarrow as pa

from spindrift.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    hit = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    base = len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)
    stretches = [set(w[i : i + Q.STRETCH]) for i in range(0, len(w) - Q.STRETCH + 1, Q.STRETCH)]
    return *base, sum(x.isascii() and not x.isalnum() for x in "".join(w)), len(set(w)), sum(map(len, stretches))


def test_counts(docs):
    texts = [r.text for r in docs.collect()] + [None, "", "\n", "a\n\na\n", "a b c a b c", "x\nx\n \n \nx", "é é é é", "a b c\n" * 3, "w " * 99, "w " * 100, " ".join(map(str, range(149))), "a,b!! é~ 1_2"]
    got = list(zip(*Q.count_texts(pa.array(texts).fill_null("")).values(), strict=True))
    assert [tuple(map(int, g)) for g in got] == [brute(t) for t in texts]


def brute_verdicts(rows):
    """{id: (distance, kept)} of (id, text, lang, source), in plain numpy, one cell at a time; the cells above come first."""
    counted = {i: brute(t) for i, t, _, _ in rows}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counted.items()}

    def stats(c):
        n, chars, _, _, _, punct, distinct, stretch = c
        length = np.log(max(n, 1)) - 6
        whole = max(n // 50 * 50, 1)
        x = [np.log(max(chars, 1) / max(n, 1)), np.arcsin(min(1, punct / max(chars, 1)) ** 0.5), np.arcsin(min(1, stretch / whole) ** 0.5), np.log(max(distinct, 1) / max(n, 1))]
        return np.array([1, length, length**2]), np.array(x), np.array([0.25 / max(n, 1), 0.25 / max(chars, 1), 0.25 / whole, 1 / max(distinct, 1) - 1 / max(n, 1)])

    told = {i: stats(c) for i, c in counted.items()}
    levels = [lambda lang, source: (), lambda lang, source: (lang,), lambda lang, source: (lang, source)]
    members = [{}, {}, {}]
    for i, _, lang, source in rows:
        if not failed[i]:
            for m, f in zip(members, levels, strict=True):
                m.setdefault(f(lang, source), []).append(i)

    def moments(ids):
        v = np.stack([np.concatenate(told[i][:2]) for i in ids])
        return v.T @ v

    def drawn(sums, above):
        total = sums + (Q.SHRINK * above if above is not None else 0)
        return total / total[0, 0]

    def estimate(average, scale):
        zz, zx, xx = average[:3, :3], average[:3, 3:], average[3:, 3:]
        coef = np.linalg.solve(zz + np.diag([0, 1e-8, 1e-8]), zx)
        cov = (xx - coef.T @ zx - zx.T @ coef + coef.T @ zz @ coef) * scale
        return coef, cov + Q.GUARD**2 * np.eye(4), np.log(np.maximum(np.linalg.eigvalsh(cov), 1e-12)).sum()

    def squared(ids, coef, cov):
        r = np.stack([told[i][1] - told[i][0] @ coef for i in ids])
        return np.einsum("ij,jk,ik->i", r, np.linalg.inv(cov), r)

    cells = [(d, k) for d in range(3) for k in members[d]]
    first = {}
    for d, k in cells:
        x = np.stack([told[i][1] for i in members[d][k]])
        middle = np.sort(x, axis=0)[(len(x) - 1) // 2]
        mad = np.sort(np.abs(x - middle), axis=0)[(len(x) - 1) // 2]
        first[d, k, 0] = np.vstack([middle, np.zeros((2, 4))]), np.diag((1.4826 * mad) ** 2 + Q.GUARD**2), np.inf
    averages = {}
    for d, k in cells:
        averages[d, k] = drawn(moments(members[d][k]), averages.get((d - 1, k[:-1])))
        first[d, k, 1] = *estimate(averages[d, k], 1.0)[:2], np.inf
    models, sums, best = first, {}, {}
    while models:
        for d, k, s in models:
            ids = members[d][k]
            dist = squared(ids, *models[d, k, s][:2])
            bins = np.clip(np.floor(np.log2(np.maximum(dist, 1e-6)) * Q.BINS_PER_OCTAVE), *Q.BINS)
            half = (len(ids) + 7) // 2
            edge = np.sort(bins)[min(half, len(ids)) - 1]
            sums[d, k, s] = moments([i for i, b in zip(ids, bins, strict=True) if b <= edge])
        after = {}
        for d, k, s in models:
            above = None
            for up in range(d):
                above = drawn(sums[up, k[:up], s], above)
            after[d, k, s] = estimate(drawn(sums[d, k, s], above), Q.HALF_SCALE)
            if (d, k) not in best or (after[d, k, s][2], s) < best[d, k][0]:
                best[d, k] = (after[d, k, s][2], s), after[d, k, s]
        models = {c: m for c, m in after.items() if m[2] < models[c][2] - Q.TOLERANCE}
    near, final = {}, {}
    for d, k in cells:
        ids = [i for i, q in zip(members[d][k], squared(members[d][k], *best[d, k][1][:2]), strict=True) if q <= Q.REWEIGHT]
        if ids:
            near[d, k] = moments(ids)
    for d, k in cells:
        above = None
        for up in range(d):
            above = drawn(near[up, k[:up]], above) if (up, k[:up]) in near else above
        final[d, k] = estimate(drawn(near[d, k], above), Q.REWEIGHT_SCALE) if (d, k) in near else best[d, k][1]
    out = {}
    for i, _, lang, source in rows:
        if (2, (lang, source)) not in final:
            out[i] = None, not failed[i]
            continue
        coef, cov, _ = final[2, (lang, source)]
        z, x, noise = told[i]
        r = x - z @ coef
        far = r @ np.linalg.inv(cov + np.diag(noise)) @ r
        out[i] = far, not failed[i] and far <= Q.CUTOFF
    return out


def test_query_and_verdicts(spark, sf, docs):
    """Counts, base rules, distances and verdicts of all documents against brute force."""
    from spindrift.llm.queries import op1_quality

    rows = {r.doc_id: r for r in op1_quality(spark, sf).collect()}
    own = [(d.doc_id, d.text, d.lang, d.source) for d in docs.collect()]
    assert len(rows) == len(own)
    want = brute_verdicts(own)
    for i, text, _, _ in own:
        r = rows[i]
        assert tuple(r[c] for c in Q.COUNTS) == brute(text)[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if want[i][0] is not None:
            assert np.isclose(r.distance, want[i][0], rtol=1e-5)
        assert r.kept == want[i][1]
    assert any(not r.kept and not r.base_failed for r in rows.values())


def test_good_documents_stay_and_junk_goes(spark, sf, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = [r for r in Q.quality_table(docs).collect() if not r.base_failed and r.doc_id in labels]
    good, junk = ([r.kept for r in passed if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.05 * len(junk)


def test_the_estimate_decides(spark, docs):
    """The verdict is no constant rule: the same texts as a majority are no outliers, and the covariance is far from the guard."""
    models = Q.fit_counted(Q.with_counts(docs)).collect()
    for r in models:
        spread = [1 / r.model[f"p{j}{j}"] for j in range(Q.DIMS)]
        assert min(spread) > 10 * Q.GUARD**2
    from pyspark.sql import functions as F

    junk = lambda i: " | ".join(f"word{chr(97 + (i * 7 + j) % 26)}{i}x{j}" for j in range(120 + i))
    rows = [(i, junk(i), "en", "s") for i in range(60)]
    prose = [(100 + i, re.sub(r" \| ", " ", junk(i)), "en", "t") for i in range(60)]
    got = {r.doc_id: r.kept for r in Q.quality_table(spark.createDataFrame(rows * 1 + prose, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got.values())  # each is like its own source
    mixed = {r.doc_id: r.kept for r in Q.quality_table(spark.createDataFrame(prose * 3 + rows[:5], "doc_id long, text string, lang string, source string").withColumn("source", F.lit("t"))).collect()}
    assert not any(mixed[i] for i in range(5)) and all(mixed[i] for i in range(100, 160))


def test_repeats_given_length(spark):
    """A text a third of whose lines stand twice has too few distinct words for its length; a short one with one repeated line stays."""
    g = np.random.Generator(np.random.PCG64(8))
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(4000)]
    line = lambda n: " ".join(g.choice(words, n)) + "."
    rows = [(i, "\n".join(line(int(g.integers(12, 20))) for _ in range(int(g.integers(6, 60))))) for i in range(300)]
    half = [line(15) for _ in range(30)]
    rows += [(1000, "\n".join(half + half[:14])), (1001, "\n".join([line(20), line(20), line(20), "a line.", "a line."]))]
    got = {r.doc_id: r for r in Q.quality_table(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000].kept and got[1001].kept
    assert sum(not got[i].kept and not got[i].base_failed for i in range(300)) <= 3


def test_chi_square_factors():
    g = np.random.Generator(np.random.PCG64(1))
    x = g.normal(size=(400_000, 4))
    d = (x**2).sum(axis=1)
    for q, scale in ((Q.HALF, Q.HALF_SCALE), (Q.REWEIGHT, Q.REWEIGHT_SCALE)):
        assert np.allclose(x[d <= q].var(axis=0) * scale, 1, atol=0.02)


def test_sampling_variances(spark):
    from pyspark.sql import functions as F

    g = np.random.Generator(np.random.PCG64(6))
    a = g.normal(0, 0.1, (4, 4))
    cov, coef = a @ a.T + 1e-4 * np.eye(4), g.normal(0, 1, (3, 4))
    p = np.linalg.inv(cov)
    z, x, v = g.normal(0, 1, (20, 2)), g.normal(0, 1, (20, 4)), g.uniform(0, 0.1, (20, 4))
    names = ["z1", "z2", *(f"x{j}" for j in range(4)), *(f"n{j}" for j in range(4))]
    model = {f"{t}{j}": float(coef[k, j]) for k, t in enumerate("abc") for j in range(4)} | {f"p{i}{j}": float(p[i, j]) for i, j in Q.UPPER}
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.hstack([z, x, v])], ", ".join(f"{c} double" for c in names))
    cols = [F.col(c) for c in names]
    got = df.select(Q.noisy_distance(cols[:2], cols[2:6], cols[6:], lambda c: F.lit(model[c])).alias("distance")).toPandas()["distance"].to_numpy()
    r = x - np.hstack([np.ones((20, 1)), z]) @ coef
    assert np.allclose(got, [e @ np.linalg.inv(cov + np.diag(n)) @ e for e, n in zip(r, v, strict=True)], rtol=1e-8)


def test_odd_and_empty(spark, odd, empty):
    from pyspark.sql import functions as F

    got = Q.quality(odd).collect()
    assert len(got) == odd.count() and not any(r.kept and r.base_failed for r in got)
    assert {r.n_words for r in got if r.text is None} == {0}
    assert set(odd.columns) | set(Q.COUNTS) | set(Q.ADDED) == set(Q.quality(odd).columns)
    assert Q.quality(empty).count() == 0 and Q.quality_table(empty).count() == 0 and Q.kept_rows(empty).count() == 0
    assert Q.quality_table(odd).count() == odd.count()
    # columns of any name are handed on as they are
    text = " ".join(f"word{i}" for i in range(80)) + "."
    names = ["n_words", "kept", "distance", "counts_of", "verdict_of", "cell_of", "model_of", "distance_of", "lang_", "source_", "m0", "p00", "z1", "x0", "q_e0", "made", "cell", "base_failed"]
    df = spark.createDataFrame([(i, f"{text} {i}", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string").select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])
    kept = Q.kept_rows(df)
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())
    one = spark.createDataFrame([(1, text, None, None), (2, text, None, "s"), (2, text, None, "s")], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in Q.quality_table(one).collect()] == [True] * 3
