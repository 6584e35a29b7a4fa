import re

from spindrift.llm import lines as L


def brute(rows, sites):
    """(id, cleaned text) of rows (id, text, source)."""
    spread, first = {}, {}
    for d, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if re.search(L.WORD, x):
                spread.setdefault(x, set()).add(s)
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    bad = {x for x, s in spread.items() if len(s) >= sites}
    clean = lambda d, t: None if t is None else "\n".join(x for x in t.split("\n") if not (x in bad and (d is None or d != first.get(x))))
    return sorted(((d, clean(d, t)) for d, t, _ in rows), key=repr)


def run(df, sites):
    return sorted(((r.doc_id, r.text) for r in L.drop_boilerplate(df, sites=sites).collect()), key=repr)


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for sites in (2, 3, 8):
        assert run(docs, sites) == brute(rows, sites)


def test_odd_and_empty(odd, empty):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert run(odd, 8) == brute(rows, 8) and run(odd, 2) == brute(rows, 2)
    out = L.drop_boilerplate(odd, removed="n_removed")
    assert out.columns == [c for c in odd.columns if c != "n_removed"] + ["n_removed"]
    assert sum(r.n_removed for r in out.collect()) == 10  # the line stays in its first document, -5
    assert L.drop_boilerplate(empty).count() == 0


def test_sketches_and_exact_counts_agree(spark):
    """Around the threshold, and far above it, where the sketch alone decides."""
    rows = [(s * 100 + k, f"line {k}", f"s{s}") for k in (5, 7, 8, 9, 11, 60) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, bad = L.spread(df)
    assert bad.count() == 4
    assert run(df, 8) == brute(rows, 8)
