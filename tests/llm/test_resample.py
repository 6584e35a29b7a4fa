"""Importance resampling against zlib, re and math, and against its SQL twin."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import resample as R
from spindrift.llm.textbytes import blocks

from . import oracle

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, most):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, share=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = ([0] * buckets for _ in range(2))
    for own, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in runs(x, most)[1]:
                own[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for d, x in rows:
        words, found = runs(x, most)
        w = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    meant = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(meant[: share * len(meant) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(((r[0], r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_sql_twin(spark, sf):
    oracle.same(spark, sf, "op11_resample")


def test_whole_tables(spark, sf, docs):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = R.resample_table(docs.repartition(5), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got(df) == brute(rows, target)
    assert sum(r["rank"] is not None for r in df.collect()) == 10 * sum(len(runs(t, 1)[0]) >= 20 for _, t in rows) // 100 > 0


@pytest.mark.parametrize("most", [1, 3])
def test_crc_of_all_lengths(most):
    rng = np.random.Generator(np.random.PCG64(5))
    long = "".join(rng.choice(list("abCZ09é日🙂"), 3 * R.PIECE))
    texts = [long[:n] for n in (0, 1, 2, R.PIECE - 1, R.PIECE, R.PIECE + 1, 2 * R.PIECE, 3 * R.PIECE)] + [None, " ", "a", "A-b", "--a  B\n\nc--", "x" * 100_000 + " y"]
    texts += ["".join(rng.choice(list("ab Z.\n9é[~\x7f\x80"), 50)) for _ in range(200)]
    found = []
    for block in blocks(pa.array(texts).slice(0), 64):
        per = [[] for _ in range(block.n)]
        for crcs, bounds in R.features(block, most):
            for t in range(block.n):
                per[t] += crcs[bounds[t] : bounds[t + 1]].tolist()
        found += per
    assert found == [[zlib.crc32(f.encode()) for f in runs(t, most)[1]] for t in texts]


def test_longer_runs_and_few_buckets(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    target = ["the old town", None, "", "a river and the old town by the sea"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([(x,) for x in target], "passage string")
    assert got(R.resample_table(df, t, target_text="passage", most=3, buckets=97, share=33, least=3, seed=1)) == brute(rows, target, 3, 97, 33, 3, 1)


def test_odd_and_empty(spark, odd, empty, docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for least in (0, 2):
        assert got(R.resample_table(odd, docs, share=50, least=least)) == brute(rows, [r.text for r in docs.collect()], share=50, least=least)
    assert got(R.resample_table(odd, empty, least=1)) == brute(rows, [], least=1)
    assert R.resample_table(empty, docs).count() == 0 and R.drawn(empty, docs).count() == 0
    with pytest.raises(ValueError):
        R.resample_table(odd, docs, buckets=R.MOST_BUCKETS + 1)


def test_ties_and_copies(spark, docs):
    """A third of all rows alike in text, others alike in id too: each has a rank of its own, smaller ids first."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 40 + [(None, text)] * 40 + [(i, text) for i in range(100)] + [(1000 + i, f"{text} own {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = R.resample_table(df, docs, share=70)
    assert got(out) == brute(rows, [r.text for r in docs.collect()], share=70)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == list(range(1, 169))


def test_drawn_rows_keep_everything(spark, docs, odd):
    table = R.resample_table(docs, docs.limit(20))
    want = {r.doc_id for r in table.collect() if r["rank"]}
    found = R.drawn(docs, docs.limit(20))
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == want and found.count() == len(want)
    assert set(found.collect()) <= set(docs.collect())
    few = R.drawn(odd, docs, share=50, least=1)
    assert few.columns == odd.columns and set(few.collect()) <= set(odd.collect()) and few.count()


def test_text_ids(spark, docs):
    from pyspark.sql import functions as F

    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert R.resample_table(named, docs).where("rank IS NOT NULL").count() == R.drawn(named, docs).count() > 0
