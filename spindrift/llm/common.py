"""What the operators of this subpackage share: cut lineage, size-checked joins, safe column names."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workers
from ..session import shared_dir

#: bytes of a batch that Spark hands to Python, unless the session says otherwise: each task holds some copies of one
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
#: Small tables (one row per cell, source, rule ...) are broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 50_000


def shipped(df: DataFrame) -> DataFrame:
    """df, ready for Python workers: they get this package, and batches of a size that suits texts."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, f"{_BATCH_DEFAULT}b") in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT)):
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return workers.shipped(df)


class _Open(threading.local):
    def __init__(self):
        self.scopes: list[list[str]] = []


_OPEN = _Open()
#: of so many tables that are written, each last one is followed by a release
RELEASE = 6
_WRITTEN = count(1)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, but for those to keep, which go to the scope around, if any.

    Nothing that outlives the scope may read the others: what an operator returns is made of kept tables and its input only.
    """
    _OPEN.scopes.append([])
    try:
        yield
    finally:
        remove(spark, _OPEN.scopes.pop())


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrift-{tag}-{uuid.uuid4().hex}"
    scopes = _OPEN.scopes[:-1] if keep else _OPEN.scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    if next(_WRITTEN) % RELEASE == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Plans, broadcasts and shuffles that nothing refers to any more go when the driver collects garbage. Operators of many small jobs
    ask for that now and then, so that the driver holds what is in use and not what has been."""
    gc.collect()
    spark._jvm.System.gc()


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table that is small as a rule. It is counted first and broadcast only up to `limit` rows; beyond that Spark shuffles and splits skewed keys."""
    return df.join(F.broadcast(small) if len(small.limit(limit + 1).select(F.lit(1)).collect()) <= limit else small, on, how)


def fresh(taken: Sequence[str], name: str) -> str:
    """A column name that none of `taken` has (case-insensitive)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"{name}_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: the new ones win."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def derived(df: DataFrame, text: str, fields: Sequence[T.StructField], start: Callable[[], Callable[[pa.Array], Sequence]], into: str | None = None) -> DataFrame:
    """df with columns that Python derives from one text column, in Arrow batches; null texts come as empty ones.

    Only the texts go to Python and only what is derived comes back: the other columns stay in the JVM. start() is called once for
    each task and gives the function from the texts of a batch to one array or list for each field. Columns of these names are replaced;
    with `into`, all that is new is one struct column of that name.
    """
    names = [f.name for f in fields]
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}

    @F.arrow_udf(T.StructType(list(fields)))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for texts in batches:
            made = work(pc.fill_null(texts, ""))
            yield pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds[f.dataType]) for v, f in zip(made, fields, strict=True)], names=names)

    made = into or fresh([*df.columns, *names], "made")
    # not deterministic to the optimizer: a filter on what is derived must not derive it twice
    whole = shipped(df).withColumn(made, run.asNondeterministic()(F.col(f"`{text}`")))
    if into:
        return whole
    low = {n.lower() for n in names}
    return whole.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low], *[F.col(f"`{made}`.`{n}`") for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
