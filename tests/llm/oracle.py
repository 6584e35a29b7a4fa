"""A query against its SQL twin, both over the same folder."""

import duckdb

from spindrift.llm.queries import ORACLE, QUERIES


def rows(found, columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=repr)


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    want = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    assert rows([r.asDict() for r in got.collect()], columns) == rows(want, columns)
