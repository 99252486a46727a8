"""Intermediate tables in the cluster's shared folder, their removal, and the folder itself."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a row group of staged tables, which writing and reading tasks hold in memory.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set a temporary one does, but only if all of Spark
    is in this process, as in tests; executors on other hosts couldn't read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


_staged: dict[str, set[str]] = {}
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)
#: While staged tables are written: jobs remove their shuffle files when they end, rather than when the driver next collects
#: its garbage, and Python workers get batches of few bytes, which both sides hold whole.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WHILE}
    for k, v in _WHILE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _width(field: T.StructField) -> Column:
    """Bytes of a row's column, about."""
    x, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.ArrayType):
        inside = kind.elementType
        return F.coalesce((8 * len(inside.fields) + 16 if isinstance(inside, T.StructType) else 8) * F.size(x), F.lit(0)) + 16
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)) + 8
    return F.lit(8) if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)) else F.coalesce(F.octet_length(F.to_json(F.struct(x))), F.lit(0)) + 8


def _measure(df: DataFrame) -> tuple[Column, Column]:
    row = sum((_width(f) for f in df.schema.fields), F.lit(32))
    return F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("bytes")


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes they take as a broadcast side): as stage() has found them, or counted in a job."""
    found = getattr(df, "_measured", None)
    return found or tuple(df.agg(*_measure(df)).first())


def stage(df: DataFrame, measure: bool = False, also: Column | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and reread: lineage ends there, every executor can read it, and a
    lost executor costs no recomputation. A writing task buffers ROW_GROUP bytes at most. Operators delete what none of
    their further steps reads (unstage); what a result still reads goes with release() or when Python ends. measure: rows and
    bytes are counted on the way, and the aggregate `also` is worked out (found in _also)."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stratalog-stage-{uuid.uuid4().hex}"
    seen = Observation()
    written = df.observe(seen, *_measure(df), (F.lit(0) if also is None else also).alias("also")) if measure else df
    with writing(spark):
        written.write.option("parquet.block.size", str(ROW_GROUP)).parquet(at)
    if not _staged:
        atexit.register(_release_all)
    _staged.setdefault(spark.sparkContext.applicationId, set()).add(at)
    if (scope := _scope.get()) is not None:
        scope.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    if measure:
        found = seen.get
        out._measured, out._also = (found["rows"], found["bytes"]), found["also"]
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _staged.get(spark.sparkContext.applicationId, set()).discard(at)


def unstage(*frames: DataFrame) -> None:
    """Deletes what stage() has written for these, once nothing that is still to run reads them."""
    for df in frames:
        _delete(df.sparkSession, df._staged_at)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The tables that stage() writes inside, in this thread; for release(). Other queries' tables aren't among them."""
    made: list[str] = []
    outer = _scope.get()
    before = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(before)
        if outer is not None:
            outer += made


@contextlib.contextmanager
def keeping(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """For an operator: of the tables that stage() writes inside, only those put into the list stay when it ends."""
    kept: list[DataFrame] = []
    with scope() as made:
        yield kept
    stay = {df._staged_at for df in kept}
    release(spark, [at for at in made if at not in stay])


def release(spark: SparkSession, made: list[str]) -> None:
    """Deletes a scope's tables; DataFrames built on them can't be read afterwards."""
    known = _staged.get(spark.sparkContext.applicationId, set())
    for at in [x for x in made if x in known]:
        _delete(spark, at)


def _release_all() -> None:
    """What results of this application still read goes when Python ends, if Spark is still there."""
    spark = SparkSession.getActiveSession()
    if spark and SparkContext._active_spark_context:
        with contextlib.suppress(Py4JError, OSError):
            release(spark, list(_staged.get(spark.sparkContext.applicationId, ())))
