"""Span segments, gaps and ordered values: no task holds a group, results by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import metadata, ranks


def brute_segments(rows):
    out = set()
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        at = sorted({x for r in own for x in r[1:3]})
        for a, b in zip(at, at[1:], strict=False):
            held = [r for r in own if r[1] <= a and b <= r[2]]
            if held:
                out.add((u, a, b, max(r[3] for r in held), any(r[4] for r in held)))
    return out


def test_segments_of_a_hot_group(spark):
    """One user has nearly all spans; some are nested, alike, or touch; one stretch is in no span."""
    rng = random.Random(3)
    rows = [(1, a, a + rng.choice([1, 2, 7, 40, 900]), rng.randrange(1000), rng.random() < 0.1) for a in (rng.randrange(3000) for _ in range(1200))]
    rows += [(2, 0, 5, 1, False), (2, 5, 9, 3, True), (2, 20, 21, 2, False), (None, 1, 4, 7, True), (None, 2, 3, 9, False), (3, 0, 1, 5, False)]
    df = spark.createDataFrame(rows, "u long, start long, end long, score long, active boolean").repartition(3)
    assert {tuple(r) for r in metadata.segments(df, "u").collect()} == brute_segments(rows)
    assert metadata.segments(df.limit(0), "u").count() == 0


def test_spans_are_cut_into_few_ranges(spark):
    """A span over a hundred thousand boundaries meets some thirty ranges: rows grow with n log n."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("u"), F.col("id").alias("start"), (F.col("id") + n).alias("end"), (F.col("id") % 977).alias("score"), F.lit(False).alias("active"))
    got = metadata.segments(df, "u")
    assert got.count() == 2 * n - 1
    r = got.where(f"seg_start = {n}").first()  # held by all spans but the first
    assert (r.seg_end, r.score) == (n + 1, 976)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_gaps(spark, by):
    rng = random.Random(5)
    rows = [(g, i, rng.uniform(0, 9) if rng.random() < p else None) for g, p in ((1, 0.5), (2, 0.01), (3, 0.0)) for i in range(400)]
    rows = [(g, i + (0 if by else 400 * g), v) for g, i, v in rows]
    got = {(r.g, r.at): r.filled for r in ranks.fill_gaps(spark.createDataFrame(rows, "g int, at int, v double").repartition(3), "at", "v", by).collect()}
    for g in (1, 2, 3):
        own = [r for r in rows if r[0] == g] if by else rows
        known = [(a, v) for _, a, v in own if v is not None]
        for _, a, v in [r for r in own if r[0] == g]:
            lo, hi = max((k for k in known if k[0] <= a), default=None), min((k for k in known if k[0] >= a), default=None)
            want = v if v is not None else None if not known else hi[1] if lo is None else lo[1] if hi is None else lo[1] + (hi[1] - lo[1]) * (a - lo[0]) / (hi[0] - lo[0])
            assert got[g, a] is want is None or abs(got[g, a] - want) < 1e-9


def test_numbers_over_any_columns(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["b", "a", None, "Z"]), rng.randrange(50)) for _ in range(500)]
    df, n = ranks.numbered(spark.createDataFrame(rows, "s string, i int").repartition(4), [F.col("s").asc_nulls_last(), F.col("i").desc()], "no")
    got = [(r.s, r.i) for r in sorted(df.collect(), key=lambda r: r.no)]
    assert n == 500 and got == sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1])) and {r.no for r in df.collect()} == set(range(1, 501))
    empty, none = ranks.numbered(df.limit(0).select("s", "i"), [F.col("s")], "no")
    assert none == 0 and empty.count() == 0
