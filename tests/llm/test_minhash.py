"""MinHash near-dedup against all pairs, and against its SQL twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import jaccard as J
from spindrift.llm import minhash as M

from . import oracle
from .test_jaccard import brute_sets, edited

SCHEMA = "doc_id long, text string"


def brute(rows, percent=85):
    """Components over all pairs of documents; rows of one id are one document."""
    sets = [(d, brute_sets(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(own):
        for b, t in own[i + 1 :]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets), key=repr)


def got(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.minhash_components(df, **more).collect()), key=repr)


def near_texts(n=120):
    """Copies with few and with many edits, around the threshold; a passage that all of a group share; short texts."""
    g = np.random.Generator(np.random.PCG64(11))
    base = [f"w{x}" for x in g.integers(0, 10**6, 250)]
    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(i, edited(g, base, int(g.integers(1, 7)))) for i in range(n)]
    rows += [(1000 + i, f"{passage} " + " ".join(f"u{x}" for x in g.integers(0, 10**6, int(g.integers(5, 60))))) for i in range(50)]
    rows += [(2000 + i, rows[0][1].upper() if i % 2 else rows[3][1]) for i in range(20)]
    for i in range(40):  # a text and one that goes on for about as long as the threshold allows
        words = [f"t{i}x{x}" for x in range(104)]
        rows += [(4000 + 2 * i, " ".join(words)), (4001 + 2 * i, " ".join(words + [f"more{i}x{x}" for x in range(10 + i % 15)]))]
    return rows + [(3000, "a b c"), (3001, "A  b\nc"), (3002, "a b"), (3003, ""), (3004, None), (None, "a b c"), (None, "only here"), (3005, "only here"), (3006, "a b c d e f g h i j k"), (3007, "a b c d e f g h i j")]


def test_sql_twin(spark, sf):
    oracle.same(spark, sf, "op13_minhash")


@pytest.mark.parametrize("percent", [75, 85])
def test_components(spark, percent):
    rows = near_texts()
    assert got(spark.createDataFrame(rows, SCHEMA), percent=percent) == brute(rows, percent)


def test_given_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = got(docs.select("doc_id", "text"))
    assert found == brute(rows) and sum(not k for *_, k in found) > 5


def test_blocks_and_rounds_of_stars(spark, monkeypatch):
    rows = near_texts(70)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "OPEN_PAIRS", 0.001)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_signatures_estimate_similarity():
    """Minima agree about as often as the sets are similar, and the stated bounds are what they say."""
    g = np.random.Generator(np.random.PCG64(3))
    for share in (0.2, 0.5, 0.85, 1.0):
        agree = []
        for _ in range(40):
            both = g.integers(0, 2**64, int(300 * 2 * share / (1 + share)), dtype=np.uint64)
            x, y = (np.concatenate([both, g.integers(0, 2**64, 300 - len(both), dtype=np.uint64)]) for _ in range(2))
            s = M.signatures([x, y, x[:1]])
            agree.append((s[0] == s[1]).mean())
        j = len(both) / (600 - len(both))
        assert abs(np.mean(agree) - j) < 4 * (j * (1 - j) / (40 * M.HASHES)) ** 0.5 + 1e-9
    for percent in (75, 80, 85, 90, 95, 100):
        bands, rows = M.bands_of(percent)
        assert bands * rows <= M.HASHES and (1 - (percent / 100) ** rows) ** bands <= M.MISS
    assert M.least_agreement(85) == 100 and M.least_agreement(100) == M.HASHES


def test_band_keys(spark):
    """Documents share the key of a band where they agree in all its places, and never that of another band."""
    g = np.random.Generator(np.random.PCG64(3))
    s = g.integers(0, 3, (60, M.HASHES), dtype=np.uint16)
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(s)], "id int, signature binary")
    for bands, rows in (M.bands_of(85), M.bands_of(95), (80, 2)):
        keys = np.array([r.k for r in df.select("id", M.band_keys(F.col("signature"), bands, rows).alias("k")).orderBy("id").collect()])
        cut = s[:, : bands * rows].reshape(60, bands, rows)
        for b in range(bands):
            assert ((keys[:, None, b] == keys[None, :, b]) == (cut[:, None, b] == cut[None, :, b]).all(axis=2)).all()
        assert len(np.intersect1d(keys[:, 0], keys[:, 1])) == 0


def test_the_middle_of_a_group_leads(spark):
    """Copies of a text that is there: they link with it and not with each other; few pairs are looked at."""
    g = np.random.Generator(np.random.PCG64(5))
    base = [f"w{x}" for x in range(400)]
    rows = [(500, " ".join(base))] + [(i, edited(g, base, 6)) for i in range(120)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_recall_of_banding():
    """Pairs just at the threshold share a band: of 20,000 drawn signatures with agreement by chance 0.85, none does not."""
    g = np.random.Generator(np.random.PCG64(8))
    bands, rows = M.bands_of(85)
    agree = (g.random((20_000, bands, rows)) < 0.85).all(axis=2).any(axis=1)
    enough = (g.random((20_000, M.HASHES)) < 0.85).sum(axis=1) >= M.least_agreement(85)
    assert agree.all() and enough.all()


def test_odd_empty_and_one_of_each(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert M.minhash_components(empty).count() == 0 and M.one_of_each(empty).count() == 0
    kept = M.one_of_each(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(None) == sum(d is None for d, _ in rows)
    assert sorted(i for i in ids if i is not None) == sorted({c for d, _, c, _ in brute(rows) if d is not None and c == d})
    for call in (M.minhash_components, J.jaccard_components):
        with pytest.raises(ValueError):
            call(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_id_with_several_texts_keeps_its_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, b), (5, a), (5, b), (9, f"{a} more"), (7, a)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nothing_is_left_behind(spark, docs):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    out = M.minhash_components(docs)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() == docs.count()
