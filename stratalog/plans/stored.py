"""Queries through a store: the event log written as four sorted runs, then read, pinned, compacted and opened again.

A store is made once for each application and folder of tables, in the shared scratch folder; queries that change one have
their own. Keys and values come out as text, in the form of the log that the catalogue's queries read directly."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans.fixtures import events_log
from stratalog.schema import StoreConfig
from stratalog.sources.files import Files
from stratalog.sources.scratch import shared_dir
from stratalog.store import Store, WriteBatch

#: Runs that the log is written as; compaction is left to the queries that ask for it.
PARTS = 4
CONFIG = StoreConfig(level0_file_limit=PARTS, inline_compaction=False, compression="zstd")

_made: dict[tuple[str, str, str], Store] = {}


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark and SparkContext._active_spark_context:
        with contextlib.suppress(Py4JError, OSError):
            for (application, _, _), store in _made.items():
                if application == spark.sparkContext.applicationId:
                    Files(spark, store.path).delete("")


def store(spark: SparkSession, sf_dir: str, use: str = "read") -> Store:
    """The store of a use: put and delete operations numbered as the events are, in PARTS bulk loads."""
    name = (spark.sparkContext.applicationId, sf_dir, use)
    if name not in _made:
        if not _made:
            atexit.register(_clean)
        out = Store(spark, f"{shared_dir(spark)}/stratalog-store-{uuid.uuid4().hex}", CONFIG)
        log = events_log(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("seq").alias("at"))
        last = log.agg(F.max("at")).first()[0] or 0
        for i in range(PARTS):
            out.load(log.where((F.col("at") > last * i // PARTS) & (F.col("at") <= last * (i + 1) // PARTS)), ["at"])
        _made[name] = out
    return _made[name]


def text(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("string") for c in ("key", "value") if c in frame.columns})


def small_writes(spark: SparkSession, sf_dir: str) -> Store:
    """A store written by single operations: nations put, those of region 0 deleted, region 1's overwritten in one batch."""
    name = (spark.sparkContext.applicationId, sf_dir, "small")
    if name not in _made:
        if not _made:
            atexit.register(_clean)
        out = Store(spark, f"{shared_dir(spark)}/stratalog-store-{uuid.uuid4().hex}", StoreConfig(group_commit=8, inline_compaction=False))
        nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
        for n in nations:
            out.put(b"nation:%02d" % n.n_nationkey, n.n_name.encode())
        for n in nations:
            if n.n_regionkey == 0:
                out.delete(b"nation:%02d" % n.n_nationkey)
        batch = WriteBatch()
        for n in nations:
            if n.n_regionkey == 1:
                batch.put(b"nation:%02d" % n.n_nationkey, b"again")
        out.write_batch(batch)
        out.sync()
        _made[name] = out
    return _made[name]
