import pytest


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank and very long texts, repeated rows, a clashing column for every operator."""
    long = " ".join(f"word{i % 977}" for i in range(40_000)) + " " + "x" * 50_000
    line = "a line that stands in many sources of this small table"
    rows = [(None, None, None, None, None), (1, None, "en", "s1", 3), (2, "", "en", None, 0), (3, " \t\n\x0b\x0c\r ", None, "s2", 6), (4, long, "en", "s1", len(long)), (5, "héllo wörld 日本 🙂", "en", "s1", 1)]
    rows += [(6, "same row twice", "en", "s1", 14)] * 2 + [(7, "one id", "en", "s1", 6), (7, "two texts of one id", "en", "s2", 19), (None, "a text without id", "en", "s1", 17), (-5, f"{line}\nnegative id\n\n{line}", "en", "s0", 1)]
    rows += [(20 + i, f"own words {i} of document {i}\n{line}\nend {i}", "en", f"s{i}", 1) for i in range(10)]
    df = spark.createDataFrame(rows, DOC)
    clash = ["n_words", "kept", "distance", "fingerprint", "n_tokens", "ids_sha256", "host", "spans", "copies", "taken", "id", "n_shingles", "component_id", "n_removed", "drop", "N_Bytes", "size", "grp"]
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"old {c}").alias(c) for c in clash])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
