"""Merges of version logs: batches, dense sequence numbers for bulk loads, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.reads import newest
from stratalog.sources.scratch import stage


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as a column of df has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def batch_collapse(ops: DataFrame, seq: Column | int, order: str = "op_idx") -> DataFrame:
    """One version per key and batch (seq): the key's last operation wins. seq is a number or an expression on ops."""
    seq = F.lit(seq).cast("long") if isinstance(seq, int) else seq
    last = Window.partitionBy("_seq", "key").orderBy(F.desc(order))
    numbered = ops.withColumn("_seq", seq).withColumn("_rank", F.row_number().over(last))
    return numbered.where("_rank = 1").select("key", F.col("_seq").alias("seq"), "value")


def unversioned(rows: DataFrame) -> DataFrame:
    """Rows (key, value) as versions of number 0, older than any other."""
    return rows.select("key", F.lit(0).cast("long").alias("seq"), "value")


def number_densely(ops: DataFrame, order: list[str], after: int) -> DataFrame:
    """ops with seq after + 1, after + 2, ... in the order of the columns, without a single-partition window: rows are
    range-sorted and written, each part counted, and the counts (one number a part) turned into offsets. Counts and numbers
    come from the same files, so rows that tie, or an executor that is lost in between, change nothing."""
    number, part = fresh(ops, "_id"), fresh(ops, "_part")
    ranged = stage(ops.orderBy(*order).withColumn(number, F.monotonically_increasing_id()))
    of = F.shiftright(number, 33)
    offsets, total = [], after
    for p, n in sorted(ranged.groupBy(of.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    side = ops.sparkSession.createDataFrame(offsets or [(0, after)], f"{part} long, _offset long")
    numbered = ranged.withColumn(part, of.cast("long")).join(F.broadcast(side), part)
    out = numbered.withColumn("seq", F.col("_offset") + F.col(number) - F.shiftleft(part, 33) + 1).select(*(c for c in ops.columns if c != "seq"), "seq")
    out._staged_at = ranged._staged_at
    return out


def compact(log: DataFrame, floor: int | None = None, drop_tombstones: bool = False, tie: list[Column] | None = None) -> DataFrame:
    """Versions that a snapshot at the floor or later may need: those above the floor, and each key's newest at or below it.
    Without a floor (no live snapshot) that is the newest version of each key. drop_tombstones leaves out a deletion that
    is a key's oldest kept version; it holds only without a floor, as a snapshot might still have to see it. tie orders
    versions of equal seq, the winner first; losers go."""
    if floor is None:
        order = Window.partitionBy("key").orderBy(F.desc("seq"), *(tie or []))
        kept = log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
        return kept.where("value is not null") if drop_tombstones else kept
    if tie:
        same = Window.partitionBy("key", "seq").orderBy(*tie)
        log = log.withColumn("_same", F.row_number().over(same)).where("_same = 1").drop("_same")
    # what is above the floor stays as it is and needs no shuffle, however many versions a key has
    return log.where(F.col("seq") > F.lit(floor)).unionAll(newest(log, snapshot=floor))
