"""Sources and sinks: metadata tables, keyed scans, column-oriented JSON, workbooks, run logs, libraries, artifacts."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator, Sequence
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import shipped
from .log import Log


def list_items(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(id, path, bytes) of the files under a folder; the id is the file name. The contents aren't read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(path).select(F.element_at(F.split("path", "/"), -1).alias("id"), "path", F.col("length").alias("bytes"))


def read_metadata(spark: SparkSession, path: str, key: str = "image") -> DataFrame:
    """S3: a CSV with a header; names and cells trimmed, all strings; the key column is found in any case and comes first. Without one
    the table is empty."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    names = [c.strip().lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    found = next((c for c in names if c.lower() == key), None)
    if found is None:
        return spark.createDataFrame([], f"{key} string")
    return df.select(F.trim(F.coalesce(f"`{found}`", F.lit(""))).alias(key), *[F.trim(F.coalesce(f"`{c}`", F.lit(""))).alias(c) for c in names if c != found])


def read_rows(spark: SparkSession, path: str, fmt: str, key: str = "image") -> DataFrame:
    """An upload as "csv", as a "json" array of rows, or as "jsonl" lines; the header is the union of the rows' keys."""
    if fmt == "csv":
        return read_metadata(spark, path, key)
    df = spark.read.json(path, primitivesAsString=True, multiLine=fmt == "json")
    return df.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns])


def write_metadata(df: DataFrame, path: str, key: str = "image") -> None:
    """The key first, blanks for what is missing."""
    cols = [key, *(c for c in df.columns if c != key)]
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def metadata_by_key(df: DataFrame, key: str, order: Sequence[Column], wanted: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """The last row of each key, of the wanted keys only, other columns with a prefix."""
    if wanted is not None:
        df = df.join(wanted.select(key).distinct(), key, "left_semi")
    last = df.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn_ = 1").drop("rn_")
    return last.select(key, *[F.col(c).alias(prefix + c) for c in last.columns if c != key])


def _column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def workbook_rows(data: bytes) -> list[list[str]]:
    """The first sheet of an XLSX file as rows of strings."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        text = lambda e: "".join(x.text or "" for x in e.iter() if tag(x) == "t")
        shared = [text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        out = []
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if tag(e) == "row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(e for e in row if tag(e) == "c"):
                value = next((x.text or "" for x in c if tag(x) == "v"), "")
                kind = c.get("t")
                cells[_column_number(c.get("r", "")) if c.get("r") else i] = shared[int(value)] if kind == "s" and value else text(c) if kind == "inlineStr" else value
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The workbooks of a folder, as workbooks() has them."""
    return workbooks(spark.read.format("binaryFile").load(path).select("path", "content"))


def workbooks(files: DataFrame) -> DataFrame:
    """(path, row, cells map<string,string>) of the first sheets of (path, content); the first row names the columns, blank cells
    go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"], strict=True):
                rows = workbook_rows(data)
                head = [h.strip() for h in rows[0]] if rows else []
                for i, r in enumerate(rows[1:]):
                    cells = {h: v.strip() for h, v in zip(head, r, strict=False) if h and v.strip()}
                    if cells:
                        out.append((p, i, cells))
            yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return shipped(files).mapInPandas(run, "path string, row int, cells map<string,string>")


def archive_members(files: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """(path, member, content) of the files in zip archives (path, content); folders are left out. A member that unpacks to more
    than most_bytes is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(BytesIO(data)) as z:
                    for m in z.infolist():
                        if m.file_size > most_bytes:
                            raise ValueError(f"{m.filename} in {p} is too large")
                        if not m.is_dir():
                            yield pd.DataFrame({"path": [p], "member": [m.filename], "content": [z.read(m)]})

    return shipped(files).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def columnar_json(df: DataFrame, text: str) -> DataFrame:
    """Column-oriented JSON {column: {row: value}} to (row, column, value); rows in numeric order have their number in row_no."""
    m = F.from_json(F.col(text), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    long = df.select(F.explode(m).alias("column", "cells")).select("column", F.explode("cells").alias("row", "value"))
    return long.withColumn("row_no", F.col("row").try_cast("long"))


def delimited_text(df: DataFrame, line: str, names: Sequence[str]) -> DataFrame:
    """Lines split at white space into named columns."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    return df.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def decode_selected(df: DataFrame, key: str, encoded: str, wanted: DataFrame) -> DataFrame:
    """Only the selected rows' base64 cells are decoded; the rest of the file is read for its keys alone."""
    return df.join(wanted.select(key).distinct(), key, "left_semi").select(key, F.unbase64(encoded).alias("data"))


def align_embeddings(embeddings: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """An item for each embedding by id; missing or additional ids are an error."""
    a = embeddings.select(key).exceptAll(items.select(key)).limit(1).count()
    b = items.select(key).exceptAll(embeddings.select(key)).limit(1).count()
    if a or b:
        raise ValueError("embeddings and items don't match")
    return items.join(embeddings, key)


def read_through(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path, computed and written first if it isn't there."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def missing(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is still to be computed."""
    return wanted.join(have, list(keys), "left_anti")


def append_strict(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Rows in the declared columns and types; any other columns are an error."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"columns {df.columns} are not the declared ones {schema.names}")
    df.write.mode("append").parquet(path)


def append_migrating(df: DataFrame, path: str) -> None:
    """New columns may come; old rows have nulls there when read back with read_migrated."""
    df.write.mode("append").parquet(path)


def read_migrated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def load_run(df: DataFrame, run_id: str) -> DataFrame:
    """The rows of one run; on a table partitioned by run_id only its files are read."""
    return df.where(F.col("run_id").cast("string") == F.lit(run_id))


def latest_run(df: DataFrame, at: str = "ts_utc") -> DataFrame:
    """The run with the latest time, the last one by name on ties."""
    return df.agg(F.max_by("run_id", F.struct(at, "run_id")).alias("run_id"))


def json_lines(df: DataFrame, path: str) -> None:
    """Appended rows of JSON."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, axis_id: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df.where(F.col("axis_id") == axis_id) if axis_id else df


def library(df: DataFrame) -> DataFrame:
    """Entries that have a name, last updated first."""
    return df.where(F.col("name").isNotNull() & (F.trim("name") != "")).orderBy(F.coalesce("updated", "created").desc_nulls_last(), "name")


def replace_table(df: DataFrame, path: str) -> None:
    """A new version of the table under `path`: a commit of a log, of which the last one counts. So readers find the old version or
    the new one at any time. The version before stays for those that read it; older ones go."""
    log = Log(df.sparkSession, path, df.schema)
    log.append(df)
    log.forget(log.manifests()[:-2])


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table that is replaced as a whole."""
    there = Log(spark, path, T.StructType([])).manifests()
    if not there:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/data/{there[-1]['data']}")


def activity_lines(df: DataFrame, ts: str, action: str, detail: str) -> DataFrame:
    """One line an action, line ends escaped."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r", ""), "\n", r"\\\\n")
    return df.select(F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] ["), flat(action), F.lit("] ["), flat(detail), F.lit("]")).alias("value"))


def to_json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """S23."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def artifact(axes: DataFrame, subset: Sequence[str], recommendations: DataFrame, most: int = 20) -> str:
    """One versioned JSON document of axes, the subset and the best recommendations. Axes are what a person has made."""
    rec = recommendations.orderBy(F.col("score").desc(), "i", "j").limit(most)
    return json.dumps({"version": 1, "axes": [json.loads(r) for r in axes.toJSON().collect()], "subset": list(subset), "recommendations": [json.loads(r) for r in rec.toJSON().collect()]}, sort_keys=True)


def migrate_library(current: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Legacy entries whose key (any case) isn't there yet are added."""
    old = legacy.withColumn("k_", F.lower(key))
    return current.unionByName(old.join(current.select(F.lower(key).alias("k_")), "k_", "left_anti").drop("k_"), allowMissingColumns=True)


def limited_log(df: DataFrame, by: Sequence[str], key: str, limit: int, seed: str) -> DataFrame:
    """At most `limit` rows of each group, by hash."""
    from ..operators.aggregates import best_per_group
    from ..operators.selection import hash_order

    return best_per_group(df, by, [hash_order(key, seed), F.col(key)], limit)


def inventory(items: DataFrame, dataset: str, descriptions: DataFrame) -> DataFrame:
    """Items of each dataset, with its description or a stand-in."""
    return items.groupBy(dataset).agg(F.count("*").alias("items")).join(F.broadcast(descriptions), dataset, "left").withColumn("description", F.coalesce("description", F.concat(F.lit("Dataset "), F.col(dataset))))


def resolve_field(df: DataFrame, name: str) -> str:
    """The column of that name in any case."""
    found = [c for c in df.columns if c.lower() == name.strip().lower()]
    if not found:
        raise KeyError(name)
    return found[0]
