"""Rounded lists are those of the SQL twins, negative zeros and halves included."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import catalog
from spindrift.functions.scalars import rounded


def bits(x):
    return tuple(map(bits, x)) if isinstance(x, list | tuple) else repr(float(x))


def test_rounded_is_what_sql_gives(spark):
    x = [-2e-7, -0.0, 0.0, 2e-7, 0.0000005, -0.0000005, 0.1234565, 1.0000005, -1.0000005, 2.5e-6, 12345.6789015, 1e300, -1e300, 5e-324]
    x += (np.random.default_rng(3).integers(-(10**7), 10**7, 400) / 2e6).tolist()  # many lie at a half
    got = [r["r"] for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").orderBy("i").select(rounded(F.col("x"), 6).alias("r")).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x]).fetchall()]
    assert list(map(bits, got)) == list(map(bits, want))
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double").select(rounded(F.col("x"), 6).alias("r")).collect()
    assert str([r["r"] for r in odd]) == "[None, inf, nan]"


def same(spark, tmp_path, name, vectors):
    rows = [(i, i % 10, v.astype("float32").tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(bits, df.collect())) == sorted(map(bits, want))


@pytest.mark.parametrize("name", ["V20_map_pooling", "V20_block_mean_pooling"])
def test_means_that_round_to_nothing_or_lie_at_a_half(spark, tmp_path, name):
    g = np.random.default_rng(4)
    vectors = g.integers(-(1 << 12), 1 << 12, (160, 64)) / float(1 << 13)  # means of four or eight have a half at the seventh digit, now and then
    vectors[:32] *= 2.0**-20  # two whole maps
    same(spark, tmp_path, name, vectors)
