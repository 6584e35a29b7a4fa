import hashlib
import re

from pyspark.sql import functions as F

from spindrift.llm import syncmers as S


def brute_positions(hashes_inner, n):
    """Closed syncmers by definition, from the hashes of the inner substrings."""
    out = []
    for i in range(n - S.K + 1):
        inner = hashes_inner[i : i + S.K - S.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_choice_is_by_definition(spark, docs):
    texts = docs.limit(60).select("doc_id", "text")
    got = S.anchors(texts, "text", "a", "pos").select("doc_id", "a", "pos").collect()
    tok = texts.select("doc_id", F.regexp_extract_all("text", F.lit(rf"[^\x20\x09-\x0D]{{1,{S.TOKEN}}}"), F.lit(0)).alias("t"))
    h = tok.select("doc_id", F.transform("t", lambda t: F.xxhash64(t)).alias("h"))
    inner = {r.doc_id: r for r in h.select("doc_id", F.size("h").alias("n"), F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))).alias("g")).collect()}
    for r in got:
        i = inner[r.doc_id]
        if i.n >= S.K:
            assert list(r.pos) == brute_positions(i.g, i.n)
            assert len(r.a) == len(r.pos) > 0
        else:
            assert len(r.a) == i.n


def test_short_texts_have_anchors(spark):
    """A text of 8 tokens or a few more may have no closed syncmer; its tokens stand in, so that unrelated texts aren't alike."""
    rows = [(i, " ".join(f"{chr(97 + j)}{i}" for j in range(8 + i % 5))) for i in range(100)]
    a = S.anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "a", "pos")
    n = F.size(F.split("text", " "))
    assert a.where(F.size("a") == n).count() > 10  # those without a closed syncmer
    got = a.select("*", S.fingerprint(F.col("a")).alias("f")).collect()
    assert all(len(r.a) == len(r.pos) > 0 for r in got) and len({r.f for r in got}) == 100
    pairs = a.alias("x").join(a.alias("y"), F.col("x.doc_id") < F.col("y.doc_id"))
    assert pairs.where(S.likeness(F.col("x.a"), F.col("y.a")) > 0).count() == 0
    blank = spark.createDataFrame([(None,), ("",), (" \t\n",)], "text string")
    assert [r.a for r in S.anchors(blank, "text", "a").collect()] == [[]] * 3


def test_context_free(spark):
    passage = " ".join(f"w{i * 7 % 101}" for i in range(60))
    df = spark.createDataFrame([(1, f"some words before {passage} and after"), (2, f"quite another beginning of it {passage}")], "doc_id long, text string")
    a = S.anchors(df, "text", "a", "p").collect()
    shared = set(a[0].a) & set(a[1].a)
    inside = [x >> 4 for x, p in zip(a[0].a, a[0].p, strict=True) if 3 <= p <= 3 + 60 - S.K]
    assert inside and set(inside) <= {x >> 4 for x in a[0].a} & {x >> 4 for x in a[1].a} and len(shared) >= len(inside) - 1
    pairs = S.anchors(S.anchors(df, "text", "a", "p").alias("x").select(F.col("a").alias("la"), F.col("p").alias("lp"), "doc_id", "text"), "text", "b", "q")
    two = pairs.where("doc_id = 1").select("la", "lp").crossJoin(pairs.where("doc_id = 2").select(F.col("b").alias("rb"), F.col("q").alias("rq")))
    shifts = {r["shift"] for r in S.positional_matches(two, "la", "lp", "rb", "rq").collect()}
    assert shifts == {4}  # 3 tokens before the passage in one text, 7 in the other


def brute_next(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def brute_anchors(text, hashed):
    """[(28 bits of the hash, position)] by definition; hashed maps tuples of tokens to xxhash64 values as the operator forms them."""
    tok = re.findall(rf"[^\x20\x09-\x0D]{{1,{S.TOKEN}}}", text)
    n = len(tok)
    h = [hashed[(t,)] for t in tok]
    inner = [hashed[tuple(h[i : i + S.S])] for i in range(n - S.S + 1)]
    starts = brute_positions(inner, n)
    if not starts:
        return [(x >> 36 & 0xFFFFFFF, i) for i, x in enumerate(h)]
    parts = [*range(0, S.K - S.S + 1, S.S)]
    return [(hashed[tuple([*(inner[i + j] for j in parts), *h[i + parts[-1] + S.S : i + S.K]])] >> 36 & 0xFFFFFFF, i) for i in starts]


class Hashes(dict):
    """xxhash64 of strings or of rows of longs with Spark's seed, by the xxhash library."""

    def __missing__(self, key):
        import xxhash

        seed = 42
        for x in key:
            raw = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
        self[key] = seed - (1 << 64) if seed >= 1 << 63 else seed
        return self[key]


def placed(anchors):
    return [(h, min(15, anchors[k + 1][1] - p) if k + 1 < len(anchors) else 0) for k, (h, p) in enumerate(anchors)]


def alike(a, b):
    a, b = set(placed(a)), set(placed(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_by_brute_force(spark, sf, docs):
    from spindrift.llm.queries import op2_syncmers

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in op2_syncmers(spark, sf).collect()}
    hashed, known = Hashes(), {}
    of = lambda t: known[t] if t in known else known.setdefault(t, brute_anchors(t, hashed))
    for (i, t), (_, nxt) in brute_next(rows):
        n = len(t)
        edited = t[: n - n // 4] + nxt[: n // 4]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        told = lambda t: "".join(f"{h << 4 | g:08x}" for h, g in placed(of(t)))
        assert r.fingerprint == told(t) and r.edited_fingerprint == told(edited)
        assert abs(r.near_edited - alike(of(t), of(edited))) < 1e-12 and abs(r.near_next - alike(of(t), of(nxt))) < 1e-12
        if n > 600 and len(set(re.findall(r"\S+", t))) > 60 and t != nxt:
            assert r.near_edited > 0.35 > r.near_next
    assert sum(len(r.fingerprint) for r in got.values()) < 0.4 * sum(r.n_chars for r in got.values())


def test_place_counts(spark):
    """The same passages in another order share fewer placed anchors than hashes."""
    a, b = (" ".join(f"{c}{i * 7 % 101}" for i in range(80)) for c in "ab")
    df = S.anchors(spark.createDataFrame([(f"{a} {b}",), (f"{b} {a}",)], "text string"), "text", "x")
    x, y = (r.x for r in df.collect())
    assert len({v >> 4 for v in x} & {v >> 4 for v in y}) > len(set(x) & set(y)) > 0


def test_next_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    monkeypatch.setattr(S, "ONE_TASK", 2)
    monkeypatch.setattr(S, "CUTS", 3)
    ids = [3, 4, 9, 10, 11, 12, 500, 501, 502, 10_000, 10_001, -7, -6, *range(600, 640), 2**60]
    rows = [(i, f"text of {i} and more words") for i in ids] + [(9, "another text of 9"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.next_document(df, "doc_id", "text", lambda d: d, []).collect()
    assert sorted((r.doc_id, r.text, r.next_text) for r in got if r.doc_id is not None) == sorted((a[0], a[1], b[1]) for a, b in brute_next(rows))
    assert [r.next_text for r in got if r.doc_id is None] == [None]


def test_uneven_ids_make_even_stretches(spark):
    """One id far away doesn't put all others into one stretch."""
    df = spark.range(20_000).select("id").union(spark.range(2**60, 2**60 + 1))
    sizes = [r["count"] for r in S.with_stretch(df, "id", 20_001, "s").groupBy("s").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3 * S.BUCKET_ROWS


def test_odd_and_empty(spark, odd, empty):
    got = S.fingerprint_edited(odd).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    one = S.fingerprint_edited(odd.where("doc_id = 5")).collect()[0]
    assert one.near_next == 1.0  # a single document follows itself
    assert S.fingerprint_edited(empty).count() == 0
