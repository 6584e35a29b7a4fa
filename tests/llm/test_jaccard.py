import re

import numpy as np
import pyarrow as pa

from spindrift.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
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
            if 4 * min(len(s), len(t)) >= 3 * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= 75 * (len(s) + len(t) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=repr)


def test_sets(docs):
    texts = [r.text for r in docs.collect()] + [None, "", "a", "A b C d", "a b c d e f", "É é A a b c d e"]
    sizes = [len(s) for _, s in J.shingle_sets(pa.array(texts))]
    assert sizes == [len(brute_sets(t)) for t in texts]


def edited(g, words, n):
    words = list(words)
    for i in g.choice(len(words), n, replace=False):
        words[i] = f"e{g.integers(1e9)}"
    return " ".join(words)


def near_rows(n=150):
    """Groups of copies with few and with many edits, around the threshold, and a passage that all of a group share."""
    g = np.random.Generator(np.random.PCG64(11))
    base = [f"w{x}" for x in g.integers(0, 10**6, 120)]
    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(i, edited(g, base, int(g.integers(1, 7)))) for i in range(n)]
    rows += [(1000 + i, f"{passage} " + " ".join(f"u{x}" for x in g.integers(0, 10**6, int(g.integers(5, 60))))) for i in range(60)]
    rows += [(2000 + i, rows[0][1].upper() if i % 2 else rows[3][1]) for i in range(20)]
    return rows + [(3000, "a b c"), (3001, "A  b\nc"), (3002, "a b"), (3003, ""), (3004, None), (None, "a b c"), (None, "only here"), (3005, "only here")]


def test_components(spark):
    rows = near_rows()
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == [(d, n, c) for d, n, c in want]


def test_other_ways_agree(spark, monkeypatch):
    """Square blocks, rounds of stars, and the way for hot tokens, forced on small data."""
    rows = near_rows(80)
    want = brute(rows)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "OPEN_PAIRS", 0.01)
    monkeypatch.setattr(J, "HOT_LEVEL", 1)
    monkeypatch.setattr(J, "FREQUENT", 2)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_bitmaps_bound_the_difference():
    g = np.random.Generator(np.random.PCG64(2))
    for n in (1, 50, 300, 2000):
        a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], g.integers(0, 2**63, n).astype(np.uint64)]))
        x, y = J.parity_bitmap(a), J.parity_bitmap(b)
        w = min(len(x), len(y))
        assert np.bitwise_count(J.folded(x, w) ^ J.folded(y, w)).sum() <= len(np.setxor1d(a, b))
        assert J._common(a.tobytes(), b.tobytes(), np.uint64) == len(np.intersect1d(a, b))


def test_odd_empty_and_one_of_each(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert J.jaccard_components(empty).count() == 0 and J.one_of_each(empty).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert sorted(named) == sorted({c for d, _, c in brute(rows) if d is not None and c == d})
    assert ids.count(None) == sum(d is None for d, _ in rows)


def test_frequent_tokens(spark, monkeypatch):
    """Counts by merged runs are the counts, however often the runs are cut; the rarest levels go where there is no room."""
    g = np.random.Generator(np.random.PCG64(2))
    values = (g.zipf(1.3, 30_000) % 5000 * 858_993).astype(np.uint32)
    runs = []
    for part in np.array_split(values, 7):
        v, c = np.unique(part, return_counts=True)
        runs += list(J._cut(v, c.astype(np.uint32), J.RANGES))
    df = spark.createDataFrame(runs, "part int, run binary")
    v, c = np.unique(values, return_counts=True)
    want = {int(x): int(np.log2(n)) for x, n in zip(v, c, strict=True) if n >= J.FREQUENT}
    for merged in (1 << 22, 8):  # the second: ranges are cut and dealt out again
        monkeypatch.setattr(J, "MERGED", merged)
        x, level = J._frequent(df, len(values))
        assert dict(zip(x.tolist(), level.tolist(), strict=True)) == want and (np.diff(x.astype(np.int64)) > 0).all()
    monkeypatch.setattr(J, "MOST_FREQUENT", len(want) // 2)
    x, level = J._frequent(df, len(values))
    assert 0 < len(x) <= len(want) // 2 and set(level.tolist()) == {y for y in want.values() if y >= level.min()}
    tokens = (np.append(x[:3], np.uint32(1)).astype(np.uint64) << np.uint64(32)) | np.uint64(77)
    assert J.token_levels(tokens, x, level).tolist() == [*level[:3].tolist(), 0]


def test_id_with_several_texts_keeps_its_links(spark):
    """One id on two rows: a copy of a smaller document, and a text that another document is near to."""
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, b), (5, a), (5, b), (9, f"{a} more"), (7, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_hot_nodes(spark, monkeypatch):
    """Stars with a hot centre, by either way of joining its minimum."""
    from spindrift.llm import graph

    links = [(0, i) for i in range(1, 60)] + [(100 + i, 100 + i + 1) for i in range(9)] + [(59, 200), (200, 201)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {**{i: 0 for i in range(60)}, 200: 0, 201: 0, **{100 + i: 100 for i in range(10)}}
    for hot, rows in ((256, 50_000), (4, 50_000), (4, 0)):
        monkeypatch.setattr(graph, "HOT", hot)
        monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
        assert {r.node: r.component for r in graph.components(df).collect()} == want


def test_nothing_is_left_behind(spark, docs):
    """Of all tables that were written on the way only the result's is left."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    out = J.jaccard_components(docs)
    after = set(os.listdir(folder)) - before
    assert len(after) == 1 and out.count() == docs.count()
