"""Append-only logs with compare-and-set commits, in any store that Spark writes to.

A log is a folder: rows as Parquet under data/, and commits/ with one numbered manifest for each commit, which names the rows it adds.
Rows count once their manifest is there. A writer writes its rows, then claims the next number by a rename that fails where the number
is taken (on a local disk by a link, which is atomic there). Who loses reads the log again, checks again that its rows may be added,
and tries the next number: so no row is lost, none comes twice, and what was checked holds for the log as it is when the commit lands.

A manifest may name the batch of a stream that it stands for. A batch that is there already isn't written again, so a stream that is
started anew after a kill appends each batch once.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: tries of a commit, each after another writer's commit
TRIES = 1000


class Taken(Exception):
    """Another writer has the number."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; Taken if there is one."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    to = hadoop.Path(path)
    fs = to.getFileSystem(conf)
    aside = hadoop.Path(to.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(fs.makeQualified(aside).toUri().getPath(), fs.makeQualified(to).toUri().getPath())
            except FileExistsError:
                raise Taken(path) from None
        else:
            if fs.exists(to) or not fs.rename(aside, to):
                raise Taken(path)
    finally:
        fs.delete(aside, False)


@dataclass(frozen=True)
class Log:
    spark: SparkSession
    path: str
    schema: T.StructType | str

    def _files(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        return sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json") and not n.startswith("."))

    def manifests(self) -> list[dict]:
        """All commits in order; one small file each."""
        files = self._files()
        if not files:
            return []
        rows = self.spark.read.text([f"{self.path}/commits/{f}" for f in files], wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["number"])

    def rows(self, manifests: list[dict] | None = None) -> DataFrame:
        """The rows of all commits, or of those given."""
        paths = [f"{self.path}/data/{m['data']}" for m in (self.manifests() if manifests is None else manifests)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def append(self, df: DataFrame, check: Callable[[DataFrame, DataFrame], None] | None = None, stream: str | None = None, batch: int | None = None) -> int | None:
        """Add rows; the number of their commit. check(log, new) raises where the new rows can't follow what the log has. With a stream
        and a batch number: None where that batch is there."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")
        try:
            for _ in range(TRIES):
                there = self.manifests()
                if stream is not None and any(m["stream"] == stream and m["batch"] == batch for m in there):
                    break
                if check:
                    check(self.rows(there), new)
                number = there[-1]["number"] + 1 if there else 0
                try:
                    put_if_absent(self.spark, f"{self.path}/commits/{number:012d}.json", json.dumps({"number": number, "data": name, "stream": stream, "batch": batch}))
                    return number
                except Taken:
                    continue
            else:
                raise RuntimeError("the log is written to all the time")
        except BaseException:
            self._drop(name)
            raise
        self._drop(name)
        return None

    def forget(self, manifests: list[dict]) -> None:
        """Takes commits out of the log, with their rows; the last one must stay, as numbers go on from it."""
        for m in manifests:
            self._delete(f"commits/{m['number']:012d}.json")
            self._drop(m["data"])

    def _drop(self, name: str) -> None:
        self._delete(f"data/{name}")

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def snapshot_rules(log: DataFrame, new: DataFrame, axis: str = "axis", seq: str = "seq", kind: str = "kind") -> None:
    """An axis is created once, before anything else of it. The first axis that breaks this is named."""
    first = F.min_by(kind, seq).alias("first")
    told = new.groupBy(axis).agg(first, F.count_if(F.col(kind) == "create").alias("creates"))
    both = told.join(log.groupBy(axis).agg(F.lit(True).alias("there")), axis, "left").withColumn("there", F.coalesce("there", F.lit(False)))
    twice = both.where((F.col("creates") > 1) | F.col("there") & (F.col("creates") > 0)).orderBy(axis).limit(1).collect()
    if twice:
        raise ValueError(f"axis {twice[0][axis]} has been created already")
    bare = both.where(~F.col("there") & (F.col("first") != "create")).orderBy(axis).limit(1).collect()
    if bare:
        raise ValueError(f"axis {bare[0][axis]} has no baseline before {bare[0]['first']}")


def write_stream(df: DataFrame, log: Log, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream appended to a log, each batch once, however often it is started anew."""
    writer = df.writeStream.foreachBatch(lambda rows, batch: log.append(rows, stream=name, batch=batch) and None).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()
