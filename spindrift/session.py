"""Spark session with the settings that the engine wants."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "spindrift", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in wanted.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may go without it, and then has one of its own
    for as long as the application runs; Spark doesn't let that setting be made later."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        found = _OWN[app]
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the executors share."""
    return f"{shared_dir(spark)}/spindrift-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows reads it, and doesn't compute it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """write(df, name, keep=False) writes df in the shared folder and reads it back: its lineage ends there. Those that aren't to be kept
    are deleted at the end; a kept one is what the caller gets, and deletes."""
    paths: list[str] = []

    def write(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = folder(spark, name)
        if not keep:
            paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        for p in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
