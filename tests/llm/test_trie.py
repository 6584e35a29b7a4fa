"""The prefix trie against one made of dictionaries, and against its SQL twin."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.llm import trie as X

from . import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    members = {}
    for c, said in convs.items():
        path = tuple(t[2:] for t in sorted(said))
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    ends = {c: tuple(t[2:] for t in sorted(said)) for c, said in convs.items()}
    children, ended = {p: [] for p in members}, {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for c, p in ends.items():
        ended[p].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ended[p])) for p, m in members.items()), key=repr)


def got(df, **names):
    nodes, ends = X.prefix_trie(df, **names)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in X.with_ends(nodes, ends).collect()), key=repr)


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_sql_twin(spark, sf):
    oracle.same(spark, sf, "op12_trie")


def test_sql_twin_on_short_and_absent_openings(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 else "assistant", rng.choice("abc") * (t + 1)) for c in range(300) if c % 40 and c % 7 for t in range(rng.choice([1, 1, 2, 3, 6]))]
    rows += [(c, 0, "user", "only turn") for c in (40, 80)]
    for name, df in (("conversations", table(spark, rows)), ("documents", spark.range(1)), ("benchmark", spark.range(1)), ("pages", spark.range(1))):
        df.coalesce(1).write.parquet(f"{tmp_path}/parts/{name}")
        next((tmp_path / "parts" / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    oracle.same(spark, str(tmp_path), "op12_trie")


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", range(3))
def test_shared_openings(spark, seed):
    """Few different turns, so that conversations share openings, end within others, and branch at every depth."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", rng.choice(["a", "b b", "", "c\tc c"][: rng.choice([1, 2, 4])])) for c in range(-20, 200) for t in range(rng.choice([1, 2, 5, 9]))]
    rng.shuffle(rows)
    assert got(table(spark, rows)) == brute(rows)


def test_hot_groups_and_long_conversations(spark):
    """A third of all conversations are alike; two conversations of thousands of turns part late, and cross partitions."""
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)]
    rows += [(c, t, "user", f"long {t}" if t < 2500 else f"{c}") for c in (9001, 9002) for t in range(2600)]
    rows += [(1000 + c, 0, "user", f"own {c}") for c in range(800)]
    df = table(spark, rows, 7)
    before = spark.sparkContext.getConf().get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = got(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, None, "user", None), (1, 2, None, "x"), (1, 2, None, "x"), (2, None, None, ""), (3, 5, "user", " \t\n"), (3, 5, "assistant", "tie by role"), (3, -5, "user", "first")]
    rows += [(4, 0, "user", "word " * 60_000), (5, 0, "user", "word " * 60_000), (-6, 0, "üser", "日本 🙂")]
    clash = ["conv", "pos", "words", "x1", "node1", "depth", "chain", "own", "run", "part_", "one_", "left", "saved"]
    df = table(spark, rows).select("*", *[F.lit(f"old {c}").alias(c) for c in clash])
    assert got(df) == brute(rows)
    renamed = df.selectExpr("conv_id AS `the id`", "turn AS n", "role AS who", "text AS said")
    assert got(renamed, key="the id", turn="n", role="who", text="said") == brute(rows)
    assert got(table(spark, [])) == [] and got(table(spark, [(None, 1, "a", "b")])) == []
    with pytest.raises(ValueError):
        X.prefix_trie(df.withColumn("conv_id", F.col("conv_id").cast("string")))


def test_texts_and_running(spark):
    rows = [(c, t, "user", f"{t} {c % 3 if t > 1 else 0}") for c in range(30) for t in range(4)]
    df = table(spark, rows)
    nodes, _ = X.prefix_trie(df)
    said = {(r.conv_id, r.depth): (r.role, r.text) for r in X.texts_of(nodes, df).collect()}
    assert said == {(c, d): ("user", f"{d - 1} {c % 3 if d > 2 else 0}") for c, d in {(r.conv_id, r.depth) for r in nodes.collect()} if d}
    out = X.running(spark.createDataFrame([(i % 2 if i < 50 else 7, i, i * 37 % 11) for i in range(400)], "g long, i long, v long"), "g", [F.col("i")], ["g", "i", "v"], {"s": "v"}, {"x": "v"}).collect()
    s, x = {}, {}
    for r in sorted(out, key=lambda r: (r.g, r.i)):
        s[r.g], x[r.g] = s.get(r.g, 0) + r.v, x.get(r.g, 0) ^ r.v
        assert (r.s, r.x) == (s[r.g], x[r.g])
