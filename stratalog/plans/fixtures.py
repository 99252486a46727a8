"""Version logs made from the test tables; keys and values are strings here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per event; errors delete their user's key."""
    return _read(spark, sf_dir, "events").selectExpr(
        "format_string('user:%06d', user_id) as key", "event_id + 1 as seq", "case when event_type <> 'error' then concat_ws('|', event_type, props) end as value"
    )


EVENTS = """log as (select printf('user:%06d', user_id) as key, event_id + 1 as seq,
  case when event_type <> 'error' then concat_ws('|', event_type, props) end as value from events)"""


def conversation_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per conversation, one operation per turn; short turns delete."""
    return _read(spark, sf_dir, "conversations").selectExpr("role as key", "conv_id + 1 as batch", "turn as op_idx", "case when length(text) >= 40 then text end as value")


OPS = "ops as (select role as key, conv_id + 1 as seq, turn as op_idx, case when length(text) >= 40 then text end as value from conversations)"


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without sequence numbers (all 0): the newest run of the lowest level wins."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "format_string('cust:%08d', o_custkey) as key", "0L as seq", "case when o_orderstatus = 'F' then 1 else 0 end as level", "o_orderkey as run_no",
        "case when o_orderstatus <> 'P' then o_orderpriority end as value",
    )


RUNS = """runs as (select printf('cust:%08d', o_custkey) as key, 0 as seq, case when o_orderstatus = 'F' then 1 else 0 end as level, o_orderkey as run_no,
  case when o_orderstatus <> 'P' then o_orderpriority end as value from orders)"""
