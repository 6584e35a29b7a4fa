"""All queries of the engine by name, with their SQL twins. A query gets Tables, whose attributes are the input tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
FLAGSHIP = "V5_W1_W6_label_axis_deciles"


class Tables:
    """tables.part is the DataFrame of part.parquet; only the columns that a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query; sql is the same in DuckDB."""

    def keep(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is there twice")
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return keep


def _load() -> None:
    from . import queries  # noqa: F401  registers all


def _run(f: Callable[[Tables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: partial(_run, f) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()[FLAGSHIP](spark, sf_dir)
