from collections import Counter
import re

from spindrift.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Reshare the excess by weight until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(rows, got):
    sizes, count = {}, {}
    for d, s, t in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + n
        count[d, s, n] = count.get((d, s, n), 0) + 1
    want = brute_targets(sizes)
    seen = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        share = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r["size"] == 0 and r.copies == 0 or r.copies in (int(share + 1e-9), int(share + 1e-9) + (share % 1 > 1e-9))
        seen[r.doc_id, r.source, r["size"]] = seen.get((r.doc_id, r.source, r["size"]), 0) + 1
    assert seen == count
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max([r["size"] for r in own], default=0) + 1e-6


def test_query(spark, sf, docs):
    from spindrift.llm.queries import op8_mixing

    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = M.mix_table(docs).collect()
    check(rows, got)
    again = {(r.doc_id, r.taken) for r in op8_mixing(spark, sf).repartition(7).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "RESERVE", 6)
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None), " ".join(["w"] * (i * 7919 % 83))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(M.pivotal, "__defaults__", (7, 5))
    check([(a, b, c) for a, b, c in rows], M.mix_table(df).collect())


def test_caps_chain(spark):
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 500), ("d", 3), ("e", 0), ("z", 40)])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check([(a, b, c) for a, b, c in rows], M.mix_table(df).collect())


def test_odd_and_empty(odd, empty):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    got = M.mix_table(odd).collect()
    check(rows, got)
    assert M.mix_table(empty).count() == 0 and M.mix(empty).count() == 0
    mixed = M.mix(odd).collect()
    assert len(mixed) == sum(r.copies for r in got) and odd.columns == M.mix(odd).columns
    assert all(WORD.search(r.text or "") for r in mixed)


def test_mix_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    names = ["id_", "source_", "size_", "copies_", "copy_", "mark_of", "source_of", "size_of", "copies_of", "rows_of", "copy_of", "own_mark", "size", "id", "taken", "target"]
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (1 + i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])
    got = M.mix(df)
    assert got.columns == df.columns
    assert all(r[n] == f"{n} of {r.doc_id}" for r in got.collect() for n in names)


def test_rows_alike_throughout(spark):
    """Thousands of equal rows, with and without id: the words that are taken stay near the target, nothing else comes up."""
    rows = [(None, "hot", "same words here")] * 3000 + [(7, "hot", "same id and text")] * 500 + [(i, "cold", " ".join(["w"] * (i % 9 + 1))) for i in range(400)] + [(8, "cold", "a"), (8, "cold", "b"), (8, "cold", "c d")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in ("hot", "cold")}
    got = M.mix(df).collect()
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(sum(len(r.text.split()) for r in got if r.source == s) - want[s]) <= 9
    assert {tuple(r) for r in got} <= set(rows)
    assert max(Counter(tuple(r) for r in got if r.doc_id not in (None, 7)).values()) <= 3


def test_rows_that_differ_by_nulls_maps_or_parts_of_seconds(spark):
    """Each row comes as often as its own copies say: none is taken for another."""
    import datetime

    at = datetime.datetime(2026, 1, 2, 3, 4, 5)
    rows = [(1, "a b", "s", "x", None, {"k": 1}, at), (1, "a b", "s", None, "x", {"k": 1}, at), (1, "a b", "s", None, "x", {"k": 2}, at), (1, "a b", "s", None, "x", None, at), (1, "a b", "s", None, None, {}, at), (1, "a b", "s", None, None, {}, at.replace(microsecond=1))]
    rows = [r for r in rows for _ in range(1 + len(r[5] or {}))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, t1 string, t2 string, m map<string,int>, at timestamp")
    shown = lambda r: (r.t1, r.t2, None if r.m is None else tuple(r.m.items()), r.at)
    whole = Counter((r[3], r[4], None if r[5] is None else tuple(r[5].items()), r[6]) for r in rows)
    assert Counter(map(shown, M.mix(df).collect())) == whole  # one source: its share is 1
    other = spark.createDataFrame([(i, "w " * 5, "t", None, None, {"k": i}, at) for i in range(40)], df.schema)
    got = Counter(map(shown, M.mix(df.unionByName(other)).collect()))
    assert all(got[k] % n == 0 or n > 1 for k, n in whole.items()) and all(got[k] <= 3 * n for k, n in whole.items())
    by = Counter(r.source for r in M.mix(df.unionByName(other)).collect())
    want = brute_targets({"s": 2 * len(rows), "t": 200})
    assert abs(2 * by["s"] - want["s"]) <= 2 and abs(5 * by["t"] - want["t"]) <= 5


def test_copies_of_each_row_are_those_of_its_mark(spark, docs):
    """The pipeline's multiset of rows and copies is that of the table of copies, row by row."""
    twice = docs.limit(40).unionByName(docs.limit(10))
    marked = twice.withColumn("mark", M._mark(twice))
    want = {}
    for r in M.mix_table(marked, "mark").collect():
        want[bytes(r.mark)] = want.get(bytes(r.mark), 0) + r.copies
    got = M.mix(twice)
    found = Counter(bytes(r.mark) for r in got.withColumn("mark", M._mark(got)).collect())
    assert found == {k: n for k, n in want.items() if n}


def test_text_ids(spark, docs):
    from pyspark.sql import functions as F

    got = M.mix_table(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert got.count() == docs.count() and all(r.doc_id.startswith("d") for r in got.collect())
