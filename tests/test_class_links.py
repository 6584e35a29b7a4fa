"""Pairs of rows by membership hold what the pairs themselves say."""

import pytest
from pyspark.sql import functions as F

from spindrift import catalog
from spindrift.operators import metrics, ranks


@pytest.mark.parametrize("rows", [16, 4096])
def test_links_are_those_of_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "ROWS", rows)  # many stretches, or one
    keep = [(i * 7 % 301, i * 11 % 9) for i in range(300)]
    d = spark.createDataFrame([*keep, (400, None), (None, 3)], "k int, c int")
    pairs = [(a, b) for a in keep for b in keep if a[0] < b[0] and abs(a[1] - b[1]) > 3]
    got = {(r["k"], r["c"]): tuple(r)[2:] for r in metrics.class_links(d, "k", "c", lambda a, b: F.abs(a - b) > 3).collect()}
    own = lambda x: [p for p in pairs if x in p]
    want = {x: (len(own(x)), sum(p[0] == x for p in own(x)), sum(min(p, key=lambda y: y[1]) != x for p in own(x))) for x in keep}
    assert got == want | {(400, None): (0, 0, 0), (None, 3): (0, 0, 0)}
    assert sum(v[1] for v in got.values()) == len(pairs)


@pytest.mark.parametrize(("name", "table"), [("J12_exhaustive_pairs", "supplier"), ("J18_label_pairs", "labels")])
def test_rows_are_as_many_as_the_table_has(spark, sf, name, table):
    assert catalog.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
