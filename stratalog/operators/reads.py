"""Reads of a version log (key, seq, value): plans without any input or output of their own.

A null value is a deletion. The bound on seq always lies below the choice of the newest version and the test for a deletion
above it; Catalyst pushes key ranges through both to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.keys import prefix_successor


def versions(log: DataFrame, lo=None, hi=None, snapshot: int | None = None) -> DataFrame:
    """All versions with lo <= key < hi and seq <= snapshot; None is no bound."""
    if lo is not None:
        log = log.where(F.col("key") >= F.lit(lo))
    if hi is not None:
        log = log.where(F.col("key") < F.lit(hi))
    return log if snapshot is None else log.where(F.col("seq") <= F.lit(snapshot))


def newest(log: DataFrame, lo=None, hi=None, snapshot: int | None = None, tie: list[Column] | None = None) -> DataFrame:
    """Each key's newest visible version, deletions included. tie orders versions of equal seq, the winner first."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"), *(tie or []))
    return versions(log, lo, hi, snapshot).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def scan(log: DataFrame, lo=None, hi=None, snapshot: int | None = None, tie: list[Column] | None = None) -> DataFrame:
    """Live (key, value) pairs of the range in key order."""
    return newest(log, lo, hi, snapshot, tie).where("value is not null").select("key", "value").orderBy("key")


def scan_prefix(log: DataFrame, prefix, snapshot: int | None = None) -> DataFrame:
    """Live pairs whose key begins with the prefix; an empty prefix is the whole log."""
    return scan(log, prefix if len(prefix) else None, prefix_successor(prefix), snapshot)


def lookup(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The key's newest visible version (no row, or one with a null value for a deletion): a top-1 without a shuffle of the log."""
    return versions(log, snapshot=snapshot).where(F.col("key") == F.lit(key)).orderBy(F.desc("seq")).limit(1)


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The key's live pair, or no row."""
    return lookup(log, key, snapshot).where("value is not null").select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live pairs of the keys in a table with a column key; Spark broadcasts it where it is small."""
    return newest(log.join(keys.select("key").distinct(), "key", "left_semi"), snapshot=snapshot).where("value is not null").select("key", "value")


def history(log: DataFrame, lo=None, hi=None) -> DataFrame:
    """All versions of the range by key, newest first."""
    return versions(log, lo, hi).orderBy("key", F.desc("seq"))


def read(log: DataFrame) -> DataFrame:
    """Key and value of every version, with no choice among them."""
    return log.select("key", "value")


def run_scan(log: DataFrame, lo=None, hi=None, snapshot: int | None = None) -> DataFrame:
    """Newest version of each key of the range with deletions kept."""
    return newest(log, lo, hi, snapshot).select("key", "value").orderBy("key")


def lookup_status(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """key, status (found, deleted or absent), value of each distinct key asked for."""
    asked = keys.select("key").distinct()
    found = newest(log.join(asked, "key", "left_semi"), snapshot=snapshot).select("key", "value", F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "absent").when(F.col("value").isNull(), "deleted").otherwise("found")
    return asked.join(found, "key", "left").select("key", status.alias("status"), "value")


def asof_lookup(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe (key, snap and any other columns) with seq and value of the key's newest version of seq <= snap, if it is
    live. Probes and versions are sorted together by key and number, once, and each probe takes the last version before it;
    no probe meets more than that one version."""
    event = log.select("key", F.col("seq").alias("_at"), F.lit(0).alias("_kind"), F.struct("seq", "value").alias("_version"), F.lit(None).cast(probes.schema).alias("_probe"))
    ask = probes.select("key", F.col("snap").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(event.schema["_version"].dataType).alias("_version"), F.struct(*probes.columns).alias("_probe"))
    until = Window.partitionBy("key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = event.unionAll(ask).withColumn("_seen", F.last("_version", ignorenulls=True).over(until))
    return seen.where("_kind = 1 and _seen.value is not null").select("_probe.*", "_seen.seq", "_seen.value")


def exists_count(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """How many of the keys are live; a key asked for twice counts twice."""
    counts = keys.groupBy("key").agg(F.count("*").alias("_asked"))
    return multi_get(log, keys, snapshot).join(counts, "key").agg(F.coalesce(F.sum("_asked"), F.lit(0)).cast("long").alias("n"))


def del_count(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """How many keys a deletion of these would remove: live ones, each once."""
    return multi_get(log, keys, snapshot).agg(F.count("*").alias("n"))


def size(log: DataFrame) -> DataFrame:
    """Versions, and bytes of their keys and values."""
    return log.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.octet_length("key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"),
    )


def changes(log: DataFrame, after: int, until: int) -> DataFrame:
    """Change feed: versions with after < seq <= until in commit order."""
    return log.where((F.col("seq") > after) & (F.col("seq") <= until)).orderBy("seq", "key")
