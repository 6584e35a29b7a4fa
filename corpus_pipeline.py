"""The corpus pipeline: documents in, encoded documents out. Each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import jaccard, lines, mixing, pieces, quality
from spindrift.llm.common import remove, scratch, shared_dir
from spindrift.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of many sources; n_chars follows the text."""
    done = lines.drop_boilerplate(docs)
    return (lines.with_length(done) if "n_chars" in docs.columns else done).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as many times as the mix takes them."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of ids and of what they decode to."""
    return pieces.with_pieces(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("piece_bpe_32k.model"), ids="ids").drop("text")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing sources", source_mix), ("SentencePiece", encode)]

#: estimates, rounding and encoding can't be said in SQL; tests/llm hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        if i:
            remove(spark, [f"{base}/{i - 1}"])  # the stage that read it has been written
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
