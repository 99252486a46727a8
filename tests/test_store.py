import random
import threading

import pytest

from stratalog.operators import merge, reads
from stratalog.schema import StoreConfig
from stratalog.sources.cache import RunCache
from stratalog.store import Store, WriteBatch

SMALL = StoreConfig(memtable_size_threshold=400, compaction_size_threshold=2000, level0_file_limit=2, inline_compaction=False)


def pairs(frame):
    return {bytes(r["key"]): bytes(r["value"]) for r in frame.collect()}


def test_snapshot_keeps_values_over_flush_and_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.put(b"a", b"1")
    store.put(b"gone", b"x")
    snap = store.snapshot()
    store.put(b"a", b"2")
    store.delete(b"gone")
    store.put(b"later", b"y")
    store.flush()
    store.put(b"a", b"3")
    store.flush()
    store.compact_now()
    assert [x.level for x in store.stats().levels] == [1]
    assert (store.get(b"a"), store.get(b"a", snap), store.get(b"gone"), store.get(b"gone", snap), store.get(b"later", snap)) == (b"3", b"1", None, b"x", None)
    assert pairs(store.scan(snapshot=snap)) == {b"a": b"1", b"gone": b"x"}
    assert pairs(store.scan()) == {b"a": b"3", b"later": b"y"}
    assert store.stats().live_snapshots == 1
    snap.close()
    assert store.stats().live_snapshots == 0


def test_time_travel_and_restart(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    marks = []
    for v in (b"v1", b"v2", b"v3"):
        store.put(b"k", v)
        marks.append(store.current_sequence())
    assert [store.get(b"k", store.snapshot_at(m)) for m in marks] == [b"v1", b"v2", b"v3"]
    assert pairs(store.scan(snapshot=store.snapshot_at(0))) == {}
    with pytest.raises(ValueError):
        store.snapshot_at(marks[-1] + 1)
    store.flush()
    store.put(b"k", b"v4")
    store.close()
    again = Store(spark, str(tmp_path), SMALL)
    assert again.current_sequence() == marks[-1] + 1
    assert again.get(b"k", again.snapshot_at(marks[0])) == b"v1"
    assert again.get(b"k") == b"v4"
    assert again.put(b"k", b"v5") == marks[-1] + 2


def test_checkpoint_stays_after_deferred_compaction_and_restart(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    for i in range(2):
        store.put(b"k", b"%d" % i)
        store.flush()
    store.put(b"k", b"new")
    mark = store.current_sequence()
    store.compact_now()
    again = Store(spark, str(tmp_path), SMALL)
    assert again.get(b"k", again.snapshot_at(mark)) == b"new"


def test_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.put(b"stale", b"s")
    before = store.snapshot()
    seq = store.write_batch(WriteBatch().put(b"k", b"first").put(b"b", b"2").delete(b"stale").put(b"k", b"second"))
    assert seq == before.seq + 1 and store.write_batch(WriteBatch()) is None and store.current_sequence() == seq
    assert pairs(store.scan()) == {b"k": b"second", b"b": b"2"}
    assert pairs(store.scan(snapshot=before)) == {b"stale": b"s"}
    assert store.stats().batches_total == 1 and store.stats().puts_total == 1
    again = Store(spark, str(tmp_path), SMALL)
    assert pairs(again.scan()) == {b"k": b"second", b"b": b"2"}


def test_ranges_and_binary_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    keys = [b"", b"\x00", b"\x01", b"k", b"k\xff", b"k\xff\xff", b"\xff", b"\xff\xff"]
    for k in keys:
        store.put(k, b"")
    store.delete(b"\x01")
    for flushed in (False, True):
        if flushed:
            store.flush()
        live = [k for k in keys if k != b"\x01"]
        assert list(pairs(store.scan())) == sorted(live)
        assert list(pairs(store.scan_prefix(b"k\xff"))) == [b"k\xff", b"k\xff\xff"]
        assert list(pairs(store.scan_prefix(b"\xff"))) == [b"\xff", b"\xff\xff"]
        assert pairs(store.scan(b"z", b"a")) == {} and pairs(store.scan(b"k", b"k")) == {}
        assert list(pairs(store.scan(b"\x00", b"k\xff"))) == [b"\x00", b"k"]
        assert store.get(b"") == b"" and store.get(b"\x01") is None and store.get(b"nothing") is None


def test_orphans_go_and_missing_runs_raise(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.put(b"a", b"1")
    store.flush()
    orphan = tmp_path / "runs" / "L0_9-orphan"
    orphan.mkdir()
    (orphan / "part-0.parquet").write_bytes(b"torn")
    (tmp_path / "wal" / ".half").write_bytes(b"torn")
    again = Store(spark, str(tmp_path), SMALL)
    assert not orphan.exists() and pairs(again.scan()) == {b"a": b"1"}
    for run in (tmp_path / "runs").iterdir():
        run.rename(tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path), SMALL)


def test_tombstones_go_only_without_lower_runs_and_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    for _ in range(2):
        store.put(b"a", b"1")
        store.flush()
    store.compact_now()
    store.delete(b"a")
    store.flush()
    store.put(b"b", b"1")
    store.flush()
    store._merge_level(0, store._manifest.levels()[0])
    assert store.get(b"a") is None and store.history(b"a", b"b").count() == 2  # level 1 still holds the value
    store._merge_level(1, store._manifest.levels()[1])
    assert store.history(b"a", b"b").count() == 0
    assert store.vacuum() and pairs(store.scan()) == {b"b": b"1"}
    with pytest.raises(ValueError):
        store.snapshot_at(1, strict=True)
    assert not store.snapshot_at(1).exact


@pytest.mark.parametrize("compression", ["zstd", "lz4_raw"])
def test_model_with_restarts(spark, tmp_path, compression):
    rng = random.Random(0xC0FFEE)
    config = StoreConfig(memtable_size_threshold=4000, compaction_size_threshold=16 << 10, level0_file_limit=3, compression=compression, group_commit=16)
    state, history, seq = {}, {0: {}}, 0
    for _ in range(5):
        with Store(spark, str(tmp_path), config) as store:
            for _ in range(300):
                k = b"key%02d" % rng.randrange(100)
                if rng.random() < 0.2:
                    seq = store.delete(k)
                    state.pop(k, None)
                else:
                    v = b"v%d" % rng.randrange(1000)
                    seq = store.put(k, v)
                    state[k] = v
                history[seq] = dict(state)
            assert pairs(store.scan()) == state
            assert pairs(store.scan_prefix(b"key1")) == {k: v for k, v in state.items() if k.startswith(b"key1")}
            exact = [s for s in history if s >= store._manifest.history_floor]
            at = exact[len(exact) // 2]
            assert pairs(store.scan(b"key05", b"key20", store.snapshot_at(at, strict=True))) == {k: v for k, v in history[at].items() if b"key05" <= k < b"key20"}
            some = [b"key%02d" % i for i in range(0, 100, 30)]
            assert [store.get(k) for k in some] == [state.get(k) for k in some]


def test_deletions_stay_deleted_over_restarts_at_every_stage(spark, tmp_path):
    """Deleted in the log only, after a flush, after a compaction, and with the deletion itself compacted."""
    stages = [lambda s: None, lambda s: s.flush(), lambda s: (s.flush(), s.compact_now())]
    with Store(spark, str(tmp_path), SMALL) as store:
        for i, before in enumerate(stages):
            for j, after in enumerate(stages):
                key = b"k%d%d" % (i, j)
                store.put(key, b"v")
                before(store)
                store.delete(key)
                after(store)
        store.put(b"kept", b"v")
    again = Store(spark, str(tmp_path), SMALL)
    keys = [b"k%d%d" % (i, j) for i in range(3) for j in range(3)]
    assert [again.get(k) for k in keys[::2]] == [None] * 5 and pairs(again.scan()) == {b"kept": b"v"}


def test_levels_and_batches_survive_restarts(spark, tmp_path):
    config = StoreConfig(memtable_size_threshold=1 << 20, compaction_size_threshold=1000, level0_file_limit=2, inline_compaction=False, compression="lz4_raw")
    with Store(spark, str(tmp_path), config) as store:
        for part in range(4):
            batch = WriteBatch()
            for i in range(100):
                batch.put(b"key%05d" % (part * 50 + i), b"value%d" % part)
            seq = store.write_batch(batch)
            store.flush()
            if part % 2:
                store.compact_now()
        store.put(b"last", b"x")
    again = Store(spark, str(tmp_path), config)
    levels = {x.level: x.num_sstables for x in again.stats().levels}
    assert max(levels) >= 1 and again.current_sequence() == seq + 1
    want = {b"key%05d" % i: b"value%d" % min(3, i // 50) for i in range(250)} | {b"last": b"x"}
    assert pairs(again.scan()) == want and again.get(b"key00120") == b"value2"


def test_snapshot_is_stable_under_concurrent_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path), StoreConfig(memtable_size_threshold=300, level0_file_limit=2, inline_compaction=True, group_commit=8))
    for i in range(20):
        store.put(b"k%02d" % i, b"first")
    snapshot, failed = store.snapshot(), []

    def write(t):
        for i in range(40):
            store.put(b"k%02d" % (i % 20), b"t%d" % t) if i % 3 else store.delete(b"k%02d" % (i % 20))

    def read():
        for _ in range(3):
            if pairs(store.scan(snapshot=snapshot)) != {b"k%02d" % i: b"first" for i in range(20)}:
                failed.append("changed")

    threads = [threading.Thread(target=write, args=(t,)) for t in range(2)] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and pairs(store.scan(snapshot=snapshot)) == {b"k%02d" % i: b"first" for i in range(20)}


def test_repeated_keys_need_an_order(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    ops = spark.createDataFrame([(0, b"a", b"1"), (1, b"b", b"2"), (2, b"a", b"3")], "n long, key binary, value binary")
    with pytest.raises(ValueError):
        store.write_frame(ops)
    assert store.current_sequence() == 0 and pairs(store.scan()) == {} and not [r for r in store.files.names("runs")]
    assert store.write_frame(ops, "n") == 1 and pairs(store.scan()) == {b"a": b"3", b"b": b"2"}
    assert store.write_frame(ops.where("n > 0")) == 2 and store.stats().batches_total == 2


def test_counters_count_operations(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    ops = spark.createDataFrame([(i, b"k%d" % i, None if i % 5 == 0 else b"v") for i in range(10)], "n long, key binary, value binary")
    assert store.load(ops, ["n"]) == 10
    assert store.multi_get([b"k1", b"k2", b"k0"]).count() == 2
    store.get(b"k1")
    stats = store.stats()
    assert (stats.puts_total, stats.deletes_total, stats.gets_total, stats.batches_total) == (8, 2, 4, 0)


def test_unversioned_rows_are_older_than_all(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.put(b"b", b"new")
    store.write_unversioned(spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"c", None)], "key binary, value binary"))
    assert pairs(store.scan()) == {b"a": b"1", b"b": b"new"} and store.current_sequence() == 1
    with pytest.raises(ValueError):
        store.write_unversioned(spark.createDataFrame([(b"z", b"1")], "key binary, value binary"))
    assert [(bytes(r.key), r.value and bytes(r.value)) for r in reads.read(store.history()).collect()] == [(b"a", b"1"), (b"b", b"new"), (b"b", b"2"), (b"c", None)]


def test_a_whole_log_keeps_its_numbers(spark, tmp_path):
    log = spark.createDataFrame([(b"a", 3, b"1"), (b"a", 7, None), (b"b", 0, b"2")], "key binary, seq long, value binary")
    store = Store(spark, str(tmp_path), SMALL)
    with pytest.raises(ValueError):
        store.import_versions(log.unionAll(log.where("seq = 7")))
    assert store.import_versions(log) == 7 and pairs(store.scan()) == {b"b": b"2"} and store.get(b"a", store.snapshot_at(5)) == b"1"
    assert store.put(b"a", b"3") == 8
    with pytest.raises(ValueError):
        store.import_versions(log)


def test_filters_are_probed_without_reading_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.load(spark.range(2000).selectExpr("id", "cast(format_string('key%06d', 2 * id) as binary) as key", "cast('v' as binary) as value"), ["id"])
    assert all(store.might_contain(b"key%06d" % (2 * i)) for i in range(0, 2000, 400))
    assert sum(store.might_contain(b"key%06d" % (2 * i + 1)) for i in range(0, 1000, 25)) < 6
    assert not store.might_contain(b"absent") and not store.might_contain(b"zzz")
    store.put(b"zzz", b"1")
    assert store.might_contain(b"zzz")


def test_hot_runs_stay_in_memory_within_the_bound(spark, tmp_path):
    store = Store(spark, str(tmp_path), StoreConfig(block_cache_size=1 << 20, inline_compaction=False, level0_file_limit=2))
    for i in range(3):
        store.put(b"k%d" % i, b"v")
        store.flush()
    for _ in range(2):
        assert len(pairs(store.scan())) == 3
    stats = store.cache_stats()
    assert (stats.hits, stats.misses, stats.runs) == (3, 3, 3) and 0 < stats.used_bytes <= 1 << 20
    store.compact_now()
    assert store.cache_stats().runs == 0 and store.cache_stats().used_bytes == 0 and store.get(b"k1") == b"v"
    store.close()
    assert store.cache_stats().runs == 0
    cache = RunCache(10)
    frames = {n: spark.range(1) for n in "abc"}
    assert cache.get("big", 11, lambda: frames["a"]) is None
    for n in "aba":
        cache.get(n, 4, lambda n=n: frames[n])
    cache.get("c", 4, lambda: frames["c"])  # b was used longest ago
    assert list(cache._held) == ["a", "c"] and cache.used == 8
    cache.clear()
    assert cache.used == 0 and not frames["a"].is_cached


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bounds_reach_the_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "cast(format_string('key%06d', id) as binary) as key", "cast('v' as binary) as value")
    for part in range(4):
        store.load(rows(part * 1000, part * 1000 + 1000), ["id"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # of the plan's text, from the frame's start on
    frame = store.scan(b"key000100", b"key000200", store.snapshot_at(3500))
    assert "LessThanOrEqual(seq,3500)" in plan(frame) and "GreaterThanOrEqual(key" in plan(frame) and "LessThan(key" in plan(frame)
    assert len(frame.inputFiles()) == len(store._read([store._manifest.runs[0]]).inputFiles()) and frame.count() == 100
    assert "EqualTo(key" in plan(reads.lookup(store.versions(), bytearray(b"key000100")))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_versions_above_the_floor_are_not_shuffled(spark, tmp_path):
    log = spark.createDataFrame([(b"k", i, b"v") for i in range(100)], "key binary, seq long, value binary")
    out = merge.compact(log, 40)
    assert out.count() == 60 and plan(out).count("Exchange") == 1 and "WindowGroupLimit" in plan(out)


def test_as_of_is_one_sort(spark):
    log = spark.createDataFrame([("a", 3, "x"), ("a", 5, None), ("a", 9, "y"), ("b", 1, "z")], "key string, seq long, value string")
    probes = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate([("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 8), ("a", 9), ("b", 99), ("c", 5), (None, 1), ("b", None), ("a", 4)])], "probe long, key string, snap long")
    out = reads.asof_lookup(log, probes)
    assert sorted((r.probe, r.seq, r.value) for r in out.collect()) == [(1, 3, "x"), (2, 3, "x"), (5, 9, "y"), (6, 1, "z"), (10, 3, "x")]
    made = plan(reads.asof_lookup(log, probes))
    assert made.count("Exchange") == 1 and "Join" not in made


def test_numbers_are_dense_with_ties_and_leave_no_files(spark, tmp_path):
    ops = spark.range(1000).selectExpr("id % 7 as o", "id as _id", "id as seq").repartition(5)
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    out = merge.number_densely(ops, ["o"], 10)
    rows = out.collect()
    assert sorted(r.seq for r in rows) == list(range(11, 1011)) and out.columns == ["o", "_id", "seq"]
    assert [r.o for r in sorted(rows, key=lambda r: r.seq)] == sorted(r.o for r in rows)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_verbose_stores_say_what_they_do(spark, tmp_path, caplog):
    with caplog.at_level("INFO", "stratalog.store"):
        for verbose in (False, True):
            store = Store(spark, str(tmp_path / str(verbose)), StoreConfig(verbose=verbose))
            store.put(b"k", b"v")
            store.flush()
            assert ("flushed 1 versions" in caplog.text) == verbose


def test_bulk_writes_and_stream_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.put(b"a", b"old")
    ops = spark.createDataFrame([(0, b"a", b"1"), (1, b"b", b"2"), (2, b"a", None)], "n long, key binary, value binary")
    seq = store.write_frame(ops, "n", ("s", 0))
    assert seq == 2 and pairs(store.scan()) == {b"b": b"2"}
    assert store.write_frame(ops, "n", ("s", 0)) is None and store.current_sequence() == 2
    assert store.load(ops, ["n"]) == 5
    assert [(bytes(r.key), r.seq) for r in store.history().collect()] == [(b"a", 5), (b"a", 3), (b"a", 2), (b"a", 1), (b"b", 4), (b"b", 2)]
    assert store.load(ops.limit(0), ["n"]) is None


def test_writers_and_background_compactor(spark, tmp_path):
    store = Store(spark, str(tmp_path), StoreConfig(memtable_size_threshold=300, level0_file_limit=2, inline_compaction=False))
    compactor = store.spawn_compactor(0.05)
    threads = [threading.Thread(target=lambda t=t: [store.put(b"t%d:%d" % (t, i), b"v" * 8) for i in range(15)]) for t in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    compactor.stop()
    assert compactor.error_count() == 0 and store.scan().count() == 45 and store.current_sequence() == 45


def test_group_commit_is_lost_before_sync_only(spark, tmp_path):
    config = StoreConfig(group_commit=3)
    store = Store(spark, str(tmp_path), config)
    for i in range(4):
        store.put(b"k%d" % i, b"v")
    assert Store(spark, str(tmp_path), config).scan().count() == 3
    store.sync()
    assert Store(spark, str(tmp_path), config).scan().count() == 4


def test_config_is_checked():
    for bad in ({"level0_file_limit": 0}, {"compaction_size_threshold": 0}, {"compression": "lz4raw"}, {"block_cache_size": -1}):
        with pytest.raises(ValueError):
            StoreConfig(**bad)
