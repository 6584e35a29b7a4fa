"""Of lines that its order leaves equal always the same one is taken, however the rows lie."""

import duckdb

from spindrift import catalog


def test_ties_of_the_first_line_are_settled(spark, tmp_path):
    for name, quantities in (("a", (7.0, 3.0, 5.0)), ("b", (3.0, 5.0, 7.0)), ("c", (5.0, 7.0, 3.0))):
        spark.createDataFrame([(1,)], "p_partkey long").write.parquet(f"{tmp_path}/{name}/part.parquet")
        lines = [(1, 4, 2, q) for q in quantities]
        spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got = catalog.queries()["J2_left_align_first_row"](spark, f"{tmp_path}/{name}").collect()
        assert [tuple(r) for r in got] == [(1, 4, 3.0)]


def test_lines_without_order_or_number_come_last(spark, tmp_path):
    """As the SQL has it, whose ORDER BY puts missing values last."""
    spark.createDataFrame([(i,) for i in range(1, 6)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, None, 1, 7.0), (1, 4, 2, 3.0), (2, 4, None, 5.0), (2, 4, 6, 6.0), (3, None, None, 1.0), (3, None, 3, 2.0), (4, None, 2, 8.0), (None, 1, 1, 9.0)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("part", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.oracle_sql()["J2_left_align_first_row"]).fetchall())
    got = catalog.queries()["J2_left_align_first_row"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == want == [(1, 4, 3.0), (2, 4, 6.0), (3, None, 2.0), (4, None, 8.0), (5, None, None)]
