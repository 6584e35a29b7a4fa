"""The pipeline against the brute-force versions of its stages."""

import hashlib

import public_tokenizers as P
import sentencepiece

import corpus_pipeline
from pyspark.sql import functions as F

from spindrift.llm.common import materialize

from . import test_jaccard, test_lines, test_mixing


def test_stages(spark, sf, docs):
    from spindrift.llm import quality
    from spindrift.llm.common import materialize

    table = {r.doc_id for r in quality.quality_table(docs).where("kept").collect()}
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, sf), "stage")
        kept.append(now.collect())
    assert all(corpus_pipeline.STAGES[i][1] and set(r.asDict()) == set(docs.columns) for i in range(4) for r in kept[i][:1])
    assert {r.doc_id for r in kept[0]} == table
    assert sorted(((r.doc_id, r.text) for r in kept[1]), key=repr) == test_lines.brute([(r.doc_id, r.text, r.source) for r in kept[0]], 8)
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in kept[1]])
    assert sorted(r.doc_id for r in kept[2]) == sorted(d for d, _, c in groups if d == c)
    want = test_mixing.brute_targets({s: sum(len(test_mixing.WORD.findall(r.text)) for r in kept[2] if r.source == s) for s in {r.source for r in kept[2]}})
    for s, target in want.items():
        own = [len(test_mixing.WORD.findall(r.text)) for r in kept[2] if r.source == s]
        assert abs(sum(len(test_mixing.WORD.findall(r.text)) for r in kept[3] if r.source == s) - target) <= max(own)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in kept[3]}
    assert sorted(r.doc_id for r in kept[4]) == sorted(r.doc_id for r in kept[3])
    for r in kept[4]:
        ids = lib.encode(texts[r.doc_id])
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_run(spark, sf):
    df = corpus_pipeline.run(spark, sf)
    assert df.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(df.columns)


def test_odd_and_empty(spark, sf, odd, empty):
    """Nulls, blanks, very long texts, repeated rows: what each stage keeps is told from the one before."""
    prose = lambda i: " ".join(f"w{i}x{j}" for j in range(90)) + "."
    long = " ".join(f"word{j}" for j in range(50_000))
    more = [(40, prose(40), None, None, None), (41, prose(41), "en", "s1", 3), (41, prose(41), "en", "s1", 3), (42, prose(41), "de", "s2", 3), (None, prose(43), "en", None, 1), (44, long, "en", "s1", 1)]
    more = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(None).cast("string").alias(c) for c in odd.columns[5:]])
    for start, stays in ((odd.unionByName(more), {40, 41, None, 44}), (empty, set())):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            was = now
            now = materialize(stage(spark, was, sf), "stage")
            assert i == 4 or now.columns == start.columns
            ids = [r.doc_id for r in now.select("doc_id").collect()]
            if i == 2:
                assert len(ids) == len(stays) and set(ids) == stays  # all others are too short, or copies
        assert set(ids) <= stays
        lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        texts = {r.doc_id: r.text for r in was.collect()}
        assert all(list(r.ids) == lib.encode(texts[r.doc_id]) for r in now.collect())


def test_columns_of_any_name_are_handed_on(spark, sf, docs):
    """Columns with names that operators use inside keep their values through the stages that return documents."""
    names = ["source_", "lang_", "m0", "p00", "n_words", "kept", "distance", "id_", "size_", "copies_", "copy_", "id", "size", "component_id", "n_shingles", "drop_", "line", "counts_of", "verdict_of", "mark_of", "made", "taken"]
    now = docs.select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = materialize(stage(spark, now, sf), "stage")
        assert now.columns == columns and now.count() > 20
    assert all(r[n] == f"{n} of {r.doc_id}" for r in now.collect() for n in names)


def test_run_leaves_its_result_only(spark, sf):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, sf)
    after = set(os.listdir(folder)) - before
    assert len(after) == 1 and os.listdir(f"{folder}/{after.pop()}") == ["4"]


def test_local_session_without_a_shared_folder(tmp_path):
    """Where spark.checkpoint.dir isn't set, a local session gets a folder of its own; operators that write tables run."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from spindrift.llm import lines, mixing
from spindrift.session import folder, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
docs = spark.createDataFrame([(i, f"a line\\nown words {i}", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
assert lines.drop_boilerplate(docs, removed="n").agg({"n": "sum"}).first()[0] == 11
assert mixing.mix(docs).count() > 0 and folder(spark, "x").startswith(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark)
print("done")
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "done" in ran.stdout, ran.stderr[-2000:]
