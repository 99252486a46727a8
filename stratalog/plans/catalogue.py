"""Query catalogue: each operator over the version logs of the test tables, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import merge, reads
from stratalog.plans import stored
from stratalog.plans.fixtures import EVENTS, OPS, RUNS, conversation_ops, events_log, order_runs

SNAP, KEY, LO, HI, PREFIX, ABSENT = 5000, "user:000017", "user:000010", "user:000050", "user:00001", "user:00001x"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def _live(where: str = "true", more: str = "true") -> str:
    """Live pairs: the bound below the ranking, the deletion test above it."""
    return f"""with {EVENTS}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log where {where})
select key, value from ranked where rn = 1 and value is not null and {more}"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys asked for: every customer's number, some twice, most absent."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("format_string('user:%06d', c_custkey) as key")
    return keys.unionAll(keys.where("key like '%6'"))


_ASKED = """keys as (select printf('user:%06d', c_custkey) as key from customer),
asked as (select * from keys union all select * from keys where key like '%6')"""


@_query(_live())
def latest_state(spark, d):
    return reads.scan(events_log(spark, d))


@_query(_live(f"seq <= {SNAP}"))
def scan_at(spark, d):
    return reads.scan(events_log(spark, d), snapshot=SNAP)


@_query(_live(f"key = '{KEY}'"))
def get_latest(spark, d):
    return reads.get(events_log(spark, d), KEY)


@_query(_live(f"key = '{KEY}' and seq <= {SNAP}"))
def get_at(spark, d):
    return reads.get(events_log(spark, d), KEY, SNAP)


@_query(_live(f"key = '{ABSENT}'"))
def get_missing(spark, d):
    return reads.get(events_log(spark, d), ABSENT)


@_query(f"with {EVENTS}, {_ASKED}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log where key in (select key from asked)) select key, value from ranked where rn = 1 and value is not null")
def multi_get(spark, d):
    return reads.multi_get(events_log(spark, d), _asked(spark, d))


@_query(_live(f"key >= '{LO}' and key < '{HI}'"))
def scan_range(spark, d):
    return reads.scan(events_log(spark, d), LO, HI)


@_query(_live(f"key >= '{LO}' and key < '{HI}' and seq <= {SNAP}"))
def scan_range_at(spark, d):
    return reads.scan(events_log(spark, d), LO, HI, SNAP)


@_query(_live(f"key >= '{LO}'"))
def scan_unbounded(spark, d):
    return reads.scan(events_log(spark, d), LO)


@_query(_live("false"))
def scan_inverted(spark, d):
    return reads.scan(events_log(spark, d), HI, LO)


@_query(_live(f"starts_with(key, '{PREFIX}')"))
def scan_prefix(spark, d):
    return reads.scan_prefix(events_log(spark, d), PREFIX)


@_query(_live(f"starts_with(key, '{PREFIX}') and seq <= {SNAP}"))
def scan_prefix_at(spark, d):
    return reads.scan_prefix(events_log(spark, d), PREFIX, SNAP)


@_query(f"with {EVENTS} select key, seq, value from log where key >= '{LO}' and key < '{HI}'")
def history(spark, d):
    return reads.history(events_log(spark, d), LO, HI)


@_query(f"with {EVENTS} select key, seq, value from log")
def scan_versions(spark, d):
    return reads.history(events_log(spark, d))


@_query(f"with {EVENTS}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log) select key, value from ranked where rn = 1")
def run_scan_with_tombstones(spark, d):
    return reads.run_scan(events_log(spark, d))


@_query(f"with {EVENTS} select key, value from log")
def run_read(spark, d):
    return reads.read(events_log(spark, d))


@_query(
    f"""with {EVENTS}, {_ASKED}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log)
select a.key, case when r.key is null then 'absent' when r.value is null then 'deleted' else 'found' end as status, r.value
from (select distinct key from asked) a left join (select * from ranked where rn = 1) r on a.key = r.key"""
)
def lookup_status(spark, d):
    return reads.lookup_status(events_log(spark, d), _asked(spark, d))


@_query(
    f"""with {EVENTS}, probes as (select event_id as probe, printf('user:%06d', user_id) as key, event_id - 500 as snap from events)
select p.probe, p.snap, p.key, l.seq, l.value from probes p asof join log l on p.key = l.key and p.snap >= l.seq where l.value is not null"""
)
def asof_lookup(spark, d):
    """A probe for each event: what its user's key was 500 events before."""
    probes = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id as probe", "format_string('user:%06d', user_id) as key", "event_id - 500 as snap")
    return reads.asof_lookup(events_log(spark, d), probes).select("probe", "snap", "key", "seq", "value")


_BATCHED = f"{OPS}, ranked as (select *, row_number() over (partition by seq, key order by op_idx desc) as rn from ops), batched as (select key, seq, value from ranked where rn = 1)"


@_query(f"with {_BATCHED} select * from batched")
def batch_collapse(spark, d):
    return merge.batch_collapse(conversation_ops(spark, d), F.col("batch"))


@_query(f"with {_BATCHED}, newest as (select *, row_number() over (partition by key order by seq desc) as rn from batched) select key, value from newest where rn = 1 and value is not null")
def batch_latest(spark, d):
    return reads.scan(merge.batch_collapse(conversation_ops(spark, d), F.col("batch")))


_NEWEST = f"with {EVENTS}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log) select key, seq, value from ranked where rn = 1"


@_query(_NEWEST)
def compact_latest(spark, d):
    return merge.compact(events_log(spark, d))


@_query(f"{_NEWEST} and value is not null")
def compact_drop_tombstones(spark, d):
    return merge.compact(events_log(spark, d), drop_tombstones=True)


_FLOOR = f"""with {EVENTS}, ranked as (select *, row_number() over (partition by key, seq <= {SNAP} order by seq desc) as rn from log),
kept as (select key, seq, value from ranked where seq > {SNAP} or rn = 1)"""


@_query(f"{_FLOOR} select * from kept")
def compact_gc_floor(spark, d):
    return merge.compact(events_log(spark, d), SNAP)


@_query(_live(f"seq <= {SNAP}"))
def compact_then_read_at_floor(spark, d):
    return reads.scan(merge.compact(events_log(spark, d), SNAP), snapshot=SNAP)


@_query(f"with {RUNS}, ranked as (select *, row_number() over (partition by key order by seq desc, level, run_no desc) as rn from runs) select key, value from ranked where rn = 1 and value is not null")
def seq0_collision(spark, d):
    return reads.scan(order_runs(spark, d), tie=[F.asc("level"), F.desc("run_no")])


_ALIVE = f"{EVENTS}, {_ASKED}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log), live as (select key from ranked where rn = 1 and value is not null)"


@_query(f"with {_ALIVE} select count(*) as n from asked join live on asked.key = live.key")
def exists_count(spark, d):
    return reads.exists_count(events_log(spark, d), _asked(spark, d))


@_query(f"with {_ALIVE} select count(*) as n from (select distinct key from asked) a join live on a.key = live.key")
def del_count(spark, d):
    return reads.del_count(events_log(spark, d), _asked(spark, d))


@_query(f"select key from ({_live(f"starts_with(key, '{PREFIX}')")}) t")
def keys_pattern(spark, d):
    return reads.scan_prefix(events_log(spark, d), PREFIX).select("key")


@_query(f"with {RUNS} select cast(level as bigint) as level, count(*) as entries, cast(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) as bigint) as bytes from runs group by level")
def level_stats(spark, d):
    size = F.octet_length("key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0))
    return order_runs(spark, d).groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))


@_query(f"with {EVENTS} select count(value) as puts, count(*) - count(value) as deletes, max(seq) as sequence from log")
def op_counters(spark, d):
    return events_log(spark, d).agg(F.count("value").alias("puts"), (F.count("*") - F.count("value")).alias("deletes"), F.max("seq").alias("sequence"))


@_query(f"with {EVENTS} select count(*) as entries, cast(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) as bigint) as bytes from log")
def log_size(spark, d):
    return reads.size(events_log(spark, d))


@_query(f"with {EVENTS} select key, seq, value from log where seq > {SNAP} - 100 and seq <= {SNAP}")
def change_feed(spark, d):
    return reads.changes(events_log(spark, d), SNAP - 100, SNAP)


@_query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) + 100 as seq from orders")
def bulk_sequence(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    return merge.number_densely(orders, ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "seq")


# Through a store


@_query(_live())
def store_latest_state(spark, d):
    return stored.text(stored.store(spark, d).scan())


@_query(_live(f"key = '{KEY}'"))
def store_get(spark, d):
    """A single lookup by its value, as a table."""
    value = stored.store(spark, d).get(KEY.encode())
    return spark.createDataFrame([(KEY, value.decode())] if value is not None else [], "key string, value string")


@_query(_live(f"key >= '{LO}' and key < '{HI}'"))
def store_scan_range(spark, d):
    return stored.text(stored.store(spark, d).scan(LO.encode(), HI.encode()))


@_query(_live(f"starts_with(key, '{PREFIX}')"))
def store_scan_prefix(spark, d):
    return stored.text(stored.store(spark, d).scan_prefix(PREFIX.encode()))


@_query(_live(f"seq <= {SNAP}"))
def store_snapshot_scan(spark, d):
    """Time travel by a number; the pin may go once the plan is made, as runs aren't deleted by reads."""
    store = stored.store(spark, d)
    with store.snapshot_at(min(SNAP, store.current_sequence())) as snapshot:
        return stored.text(store.scan(snapshot=snapshot))


@_query(_live(f"starts_with(key, '{PREFIX}') and seq <= {SNAP}"))
def store_snapshot_prefix(spark, d):
    store = stored.store(spark, d)
    with store.snapshot_at(min(SNAP, store.current_sequence())) as snapshot:
        return stored.text(store.scan_prefix(PREFIX.encode(), snapshot))


@_query(f"with {EVENTS}, {_ASKED}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log where key in (select key from asked)) select key, value from ranked where rn = 1 and value is not null")
def store_multi_get(spark, d):
    store = stored.store(spark, d)
    asked = _asked(spark, d).select(F.col("key").cast("binary").alias("key"))
    return stored.text(reads.multi_get(store.versions(), asked, store.current_sequence()))


@_query(f"with {EVENTS} select key, seq, value from log where key >= '{LO}' and key < '{HI}'")
def store_history(spark, d):
    return stored.text(stored.store(spark, d).history(LO.encode(), HI.encode()))


@_query(_live())
def store_reopened(spark, d):
    """Another store object on the same folder, which knows only what the manifest says."""
    return stored.text(stored.Store(spark, stored.store(spark, d).path, stored.CONFIG).scan())


def _compacted(spark, d):
    """A store with its four runs merged while a snapshot is live."""
    store = stored.store(spark, d, "compacted")
    if 0 in store._manifest.levels():
        with store.snapshot_at(min(SNAP, store.current_sequence())):
            store.compact_now()
    return store


@_query(f"{_FLOOR} select * from kept")
def store_compacted_versions(spark, d):
    return stored.text(_compacted(spark, d).history())


@_query(_live(f"seq <= {SNAP}"))
def store_compacted_snapshot(spark, d):
    store = _compacted(spark, d)
    return stored.text(store.scan(snapshot=store.snapshot_at(min(SNAP, store.current_sequence()))))


@_query(f"with {EVENTS}, ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log) select key, seq, value from ranked where rn = 1 and value is not null")
def store_merged_versions(spark, d):
    """Merged with no snapshot live: deletions go, as no run lies below."""
    store = stored.store(spark, d, "merged")
    store.compact_now()
    return stored.text(store.history())


@_query(f"with {EVENTS} select count(value) as puts, count(*) - count(value) as deletes, max(seq) as sequence, cast({stored.PARTS} as bigint) as runs, cast(0 as bigint) as live_snapshots from log")
def store_counters(spark, d):
    stats = stored.store(spark, d).stats()
    return spark.createDataFrame([(stats.puts_total, stats.deletes_total, stats.sequence, stats.total_sstables(), stats.live_snapshots)], "puts long, deletes long, sequence long, runs long, live_snapshots long")


@_query("select printf('nation:%02d', n_nationkey) as key, case when n_regionkey = 1 then 'again' else n_name end as value from nation where n_regionkey <> 0")
def store_small_writes(spark, d):
    """Puts, deletions and a batch that are still in the log, read after another store object has replayed it."""
    path = stored.small_writes(spark, d).path
    return stored.text(stored.Store(spark, path, stored.CONFIG).scan())


@_query("""with ops as (select n_nationkey + 1 as seq, printf('nation:%02d', n_nationkey) as key, n_name as value from nation
  union all select 25 + row_number() over (order by n_nationkey), printf('nation:%02d', n_nationkey), null from nation where n_regionkey = 0
  union all select 26 + (select count(*) from nation where n_regionkey = 0), printf('nation:%02d', n_nationkey), 'again' from nation where n_regionkey = 1)
select key, cast(seq as bigint) as seq, value from ops""")
def store_small_writes_history(spark, d):
    """Every version with its number; a batch has one number."""
    return stored.text(stored.small_writes(spark, d).history())
