"""A store of versions: a short log and table of recent writes on the driver, immutable Parquet runs, one manifest.

Writes get a sequence number each (a batch one for all of its operations) and are durable when their log file is there:
after every commit, or after every group_commit of them. A flush writes the recent versions as a sorted run of level 0, and
publishing the manifest commits it; the log files go afterwards and, as every row carries its number, replaying them
changes nothing. Bulk writes (DataFrames) become runs directly. One process writes a store; readers in it get a fixed file
list with each DataFrame. Files that no manifest names are invisible; opening the store removes them."""

from __future__ import annotations

import base64
import json
import logging
import threading
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.keys import prefix_successor
from stratalog.operators import merge, reads
from stratalog.schema import VERSIONS, StoreConfig
from stratalog.sources import bloom
from stratalog.sources import manifest as manifests
from stratalog.sources.cache import CacheStats, RunCache
from stratalog.sources.files import Files
from stratalog.sources.manifest import Manifest, Run
from stratalog.sources.scratch import unstage
from stratalog.stats import COUNTERS, LevelStats, StorageStats

log = logging.getLogger(__name__)

#: Rows of a Parquet page of a run; files are sorted, so reads of a key range leave out all pages beside it.
PAGE_ROWS = 1000


class WriteBatch:
    """Operations that are committed together; of several on one key the last holds."""

    def __init__(self):
        self.ops: list[tuple[bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((bytes(key), None))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def is_empty(self) -> bool:
        return not self.ops


class Snapshot:
    """A pinned sequence number; released by close(), the end of a with block, or the garbage collector. exact is False
    where compaction has merged history at or below it, so keys changed since may be missing."""

    def __init__(self, store: Store, seq: int, exact: bool):
        self.seq, self.exact = seq, exact
        self._release = weakref.finalize(self, store._unpin, seq)

    def sequence(self) -> int:
        return self.seq

    def close(self) -> None:
        self._release()

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Recent:
    """Versions not yet in a run, newest last for each key."""

    def __init__(self):
        self.keys: dict[bytes, list[tuple[int, bytes | None]]] = {}
        self.bytes = self.entries = 0

    def insert(self, key: bytes, seq: int, value: bytes | None) -> None:
        known = self.keys.setdefault(key, [])
        if known and known[-1][0] == seq:
            self.bytes -= len(key) + len(known.pop()[1] or b"")
            self.entries -= 1
        known.append((seq, value))
        self.bytes += len(key) + len(value or b"")
        self.entries += 1

    def get(self, key: bytes, snapshot: int | None) -> tuple[bool, bytes | None]:
        """(whether there is a visible version, its value)."""
        for seq, value in reversed(self.keys.get(key, ())):
            if snapshot is None or seq <= snapshot:
                return True, value
        return False, None

    def rows(self) -> list[tuple[bytes, int, bytes | None]]:
        return [(bytearray(k), s, None if v is None else bytearray(v)) for k in sorted(self.keys) for s, v in reversed(self.keys[k])]


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None):
        self.spark, self.config = spark, config or StoreConfig()
        self.files = Files(spark, path)
        self.path = self.files.root
        self._lock = threading.RLock()
        self._pins: dict[int, int] = {}
        self._counts = dict.fromkeys(COUNTERS, 0)
        self._recent, self._unlogged = Recent(), []
        self._cache = RunCache(self.config.block_cache_size)
        self._open()

    def _tell(self, *said) -> None:
        log.log(logging.INFO if self.config.verbose else logging.DEBUG, *said)

    def _open(self) -> None:
        for folder in ("manifest", "wal", "runs"):
            self.files.make(folder)
        self._manifest = manifests.load(self.files) or manifests.publish(self.files, Manifest())
        live = {r.name for r in self._manifest.runs}
        there = set(self.files.names("runs"))
        if missing := live - there:
            raise FileNotFoundError(f"runs named in the manifest are missing: {sorted(missing)}")
        for name in there - live:
            self.files.delete(f"runs/{name}")
        self._seq = self._manifest.last_seq
        for name in self.files.names("wal"):
            if not name.endswith(".json"):
                self.files.delete(f"wal/{name}")
                continue
            for seq, key, value in json.loads(self.files.read(f"wal/{name}")):
                self._seq = max(self._seq, seq)
                if seq > self._manifest.flushed_seq:
                    self._recent.insert(base64.b64decode(key), seq, None if value is None else base64.b64decode(value))
        self._flush_if_full()

    # Writes

    def put(self, key: bytes, value: bytes) -> int:
        with self._lock:
            seq = self._apply([(bytes(key), bytes(value))])
            self._counts["puts"] += 1
            self._flush_if_full()
            return seq

    def delete(self, key: bytes) -> int:
        """Records the deletion whether or not there is such a key."""
        with self._lock:
            seq = self._apply([(bytes(key), None)])
            self._counts["deletes"] += 1
            self._flush_if_full()
            return seq

    def write_batch(self, batch: WriteBatch) -> int | None:
        """All operations at one number; an empty batch does nothing."""
        if batch.is_empty():
            return None
        with self._lock:
            seq = self._apply(list(dict(batch.ops).items()))
            self._counts["batches"] += 1
            self._flush_if_full()
            return seq

    def _apply(self, ops: list[tuple[bytes, bytes | None]]) -> int:
        seq = self._seq + 1
        text = lambda b: None if b is None else base64.b64encode(b).decode()
        self._unlogged.append([(seq, text(k), text(v)) for k, v in ops])
        if len(self._unlogged) >= self.config.group_commit:
            try:
                self.sync()
            except Exception:
                self._unlogged.pop()
                raise
        self._seq = seq
        for k, v in ops:
            self._recent.insert(k, seq, v)
        return seq

    def sync(self) -> None:
        """Makes every commit so far durable."""
        with self._lock:
            if self._unlogged:
                rows = [r for commit in self._unlogged for r in commit]
                self.files.publish(f"wal/{rows[0][0]:020d}-{uuid.uuid4().hex}.json", json.dumps(rows).encode())
                self._unlogged = []

    def close(self) -> None:
        self.sync()
        with self._lock:
            self._cache.clear()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # Bulk writes

    def write_frame(self, ops: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> int | None:
        """One batch from a DataFrame (key, value and, if keys repeat, a column that orders them); its number, or None if it
        is empty or that stream batch is already in the store. Raises if keys repeat and nothing orders them."""
        with self._lock:
            if stream and self._manifest.streams.get(stream[0], -1) >= stream[1]:
                return None
            self.flush()
            seq = self._seq + 1
            rows = merge.batch_collapse(ops, seq, order) if order else ops.select("key", F.lit(seq).cast("long").alias("seq"), "value")
            run = self._bulk(rows, stream, [] if order else ["key"])
            self._counts["batches"] += run is not None
            return run and seq

    def load(self, ops: DataFrame, order: list[str]) -> int | None:
        """Puts and deletes in the order of the columns, each with a number of its own; the last one, or None if there are none."""
        with self._lock:
            self.flush()
            numbered = merge.number_densely(ops, order, self._seq)
            run = self._bulk(numbered.select("key", "seq", "value"), None)
            unstage(numbered)
            if run is None:
                return None
            deleted = self._read([run]).where("value is null").count()
            self._counts["puts"] += run.rows - deleted
            self._counts["deletes"] += deleted
            return run.max_seq

    def import_versions(self, rows: DataFrame) -> int | None:
        """A whole version log (key, seq, value) with its own numbers, such as sources.legacy reads, into a store that has none;
        its last number. Raises if a key has two versions of one number."""
        with self._lock:
            if self._manifest.runs or self._seq:
                raise ValueError("only a store without versions takes a whole log")
            run = self._bulk(rows, None, ["key", "seq"])
            return run and run.max_seq

    def write_unversioned(self, rows: DataFrame) -> None:
        """Rows (key, value) without numbers, as versions of number 0 that any other version of a key hides. Raises if keys
        repeat, or if the store has such rows already, as nothing would order them."""
        with self._lock:
            if any(r.min_seq == 0 for r in self._manifest.runs):
                raise ValueError("the store has unversioned rows already")
            self.flush()
            self._bulk(merge.unversioned(rows), None, ["key"])

    def _bulk(self, rows: DataFrame, stream: tuple[str, int] | None, distinct: list[str] = []) -> Run | None:  # noqa: B006
        run = self._write_run(rows, 0, self._manifest.next_run)
        streams = self._manifest.streams | ({stream[0]: stream[1]} if stream else {})
        if run is None:
            if stream:
                self._publish(streams=streams)
            return None
        if distinct and not self._read([run]).groupBy(*distinct).count().where("count > 1").isEmpty():
            self.files.delete(f"runs/{run.name}")
            raise ValueError(f"{' and '.join(distinct)} repeat, and nothing orders the rows")
        seq = max(self._seq, run.max_seq)
        self._publish(runs=(*self._manifest.runs, run), next_run=run.number + 1, last_seq=seq, flushed_seq=seq, streams=streams)
        self._seq = seq
        self._compact_inline()
        return run

    # Runs

    def _write_run(self, rows: DataFrame, level: int, number: int, most: int | None = None) -> Run | None:
        """A sorted run on disk; not part of the store until a manifest names it. most: rows at most, where that is known
        (each file's key filter is sized for them)."""
        keys = max(1000, min(self.config.bloom_keys, self.config.bloom_keys if most is None else most))
        name = f"L{level}_{number}-{uuid.uuid4().hex}"
        at = f"{self.path}/runs/{name}"
        writer = rows.select(*(F.col(f.name).cast(f.dataType) for f in VERSIONS)).sortWithinPartitions("key", F.desc("seq")).write
        writer.option("compression", self.config.compression).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(keys)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(at)
        edges = self.spark.read.schema(VERSIONS).parquet(at).agg(F.count("*"), F.hex(F.min("key")), F.hex(F.max("key")), F.min("seq"), F.max("seq")).first()
        if not edges[0]:
            self.files.delete(f"runs/{name}")
            return None
        return Run(name, level, number, edges[0], self.files.size(f"runs/{name}"), *edges[1:])

    def _publish(self, **changes) -> None:
        self._manifest = manifests.publish(self.files, self._manifest.changed(**changes))

    def flush(self) -> None:
        """Recent versions become a run of level 0."""
        with self._lock:
            self.sync()
            if not self._recent.entries:
                return
            logs = self.files.names("wal")
            rows = self.spark.createDataFrame(self._recent.rows(), VERSIONS).coalesce(1)
            run = self._write_run(rows, 0, self._manifest.next_run, self._recent.entries)
            self._publish(runs=(*self._manifest.runs, run), next_run=run.number + 1, last_seq=self._seq, flushed_seq=self._seq)
            self._recent = Recent()
            self._counts["flushes"] += 1
            for name in logs:
                self.files.delete(f"wal/{name}")
            self._tell("flushed %d versions to %s", run.rows, run.name)

    def _flush_if_full(self) -> None:
        if self._recent.bytes >= self.config.memtable_size_threshold:
            self.flush()
            self._compact_inline()

    # Compaction

    def should_compact(self, level: int, runs: list[Run]) -> bool:
        if level == 0:
            return len(runs) >= self.config.level0_file_limit
        return bool(runs) and sum(r.bytes for r in runs) >= self.config.compaction_size_threshold * self.config.level_multiplier**level

    def _compact_inline(self) -> None:
        if self.config.inline_compaction:
            self._compact(0)

    def compact_now(self) -> None:
        """Runs what is due on every level."""
        with self._lock:
            self.sync()
            level = 0
            while level <= max(self._manifest.levels(), default=-1):
                self._compact(level)
                level += 1

    def _compact(self, level: int) -> None:
        while self.should_compact(level, runs := self._manifest.levels().get(level, [])):
            self._merge_level(level, runs)
            level += 1

    def _merge_level(self, level: int, runs: list[Run]) -> None:
        """One run of the next level from a level's runs; deletions go where no run lies below and no snapshot is live."""
        floor = min(self._pins, default=None)
        lowest = all(r.level <= level for r in self._manifest.runs)
        merged = merge.compact(self._read(runs), floor, lowest and floor is None)
        size = sum(r.bytes for r in runs)
        parts = max(1, size // (128 << 20))
        merged = merged.repartitionByRange(int(parts), "key") if parts > 1 else merged.coalesce(1)
        run = self._write_run(merged, level + 1, self._manifest.next_run, sum(r.rows for r in runs))
        gone = {r.name for r in runs}
        kept = tuple(r for r in self._manifest.runs if r.name not in gone)
        past = self._manifest.last_seq if floor is None else floor
        self._publish(runs=(*kept, *([run] if run else [])), next_run=self._manifest.next_run + 1, history_floor=max(self._manifest.history_floor, past))
        for name in gone:
            self._cache.purge(name)
        self._counts["compactions"] += 1
        self._tell("compacted %d runs of level %d", len(runs), level)

    def vacuum(self) -> list[str]:
        """Deletes the files of merged runs and old manifests. Not while a DataFrame made before may still be read."""
        with self._lock:
            live = {r.name for r in self._manifest.runs}
            gone = [n for n in self.files.names("runs") if n not in live]
            for n in gone:
                self.files.delete(f"runs/{n}")
            for v in manifests.versions(self.files):
                if v < self._manifest.version:
                    self.files.delete(f"manifest/{v:020d}.json")
            return gone

    def spawn_compactor(self, interval: float) -> Compactor:
        return Compactor(self, interval)

    # Reads

    def _read(self, runs: Iterable[Run], hold: bool = False) -> DataFrame:
        """hold: runs that fit the cache stay in memory."""
        frames, rest = [], []
        for r in runs:
            frame = self._cache.get(r.name, r.bytes, lambda r=r: self._read([r])) if hold and self._cache.limit else None
            (rest if frame is None else frames).append(frame or f"{self.path}/runs/{r.name}")
        if rest:
            frames.append(self.spark.read.schema(VERSIONS).parquet(*rest))
        out = frames[0] if frames else self.spark.createDataFrame([], VERSIONS)
        for frame in frames[1:]:
            out = out.unionAll(frame)
        return out

    def might_contain(self, key: bytes) -> bool:
        """False only if no version of the key is there: recent ones are known, runs have key bounds and filters."""
        with self._lock:
            if bytes(key) in self._recent.keys:
                return True
            runs = [r for r in self._manifest.runs if r.may_hold(key, key + b"\0", None)]
            return any(bloom.might_hold(self.spark, self.files, f"runs/{r.name}", bytes(key)) for r in runs)

    def cache_stats(self) -> CacheStats:
        with self._lock:
            return self._cache.stats()

    def versions(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: int | None = None) -> DataFrame:
        """The version log at this moment, from the runs that may hold rows of the range."""
        with self._lock:
            frame = self._read([r for r in self._manifest.runs if r.may_hold(lo, hi, snapshot)], hold=True)
            if self._recent.entries:
                frame = frame.unionAll(self.spark.createDataFrame(self._recent.rows(), VERSIONS))
            return frame

    def _bound(self, snapshot: Snapshot | None) -> int:
        return self._seq if snapshot is None else snapshot.seq

    def get(self, key: bytes, snapshot: Snapshot | None = None) -> bytes | None:
        with self._lock:
            self._counts["gets"] += 1
            bound = self._bound(snapshot)
            there, value = self._recent.get(bytes(key), bound)
            if there:
                return value
            runs = [r for r in self._manifest.runs if r.may_hold(key, key + b"\0", bound)]
            frame = self._read(runs, hold=True) if runs else None
        row = reads.lookup(frame, bytearray(key), bound).first() if frame is not None else None
        return None if row is None or row["value"] is None else bytes(row["value"])

    get_at = get

    def multi_get(self, keys: Iterable[bytes], snapshot: Snapshot | None = None) -> DataFrame:
        """The live pairs of the keys, each once; every key asked for counts as a lookup."""
        rows = [(bytearray(k),) for k in keys]
        asked = self.spark.createDataFrame(rows, "key binary")
        with self._lock:
            self._counts["gets"] += len(rows)
            return reads.multi_get(self.versions(), asked, self._bound(snapshot))

    def scan(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Live pairs with lo <= key < hi in key order; an inverted range is empty."""
        with self._lock:
            self._counts["scans"] += 1
            bound = self._bound(snapshot)
            edge = lambda b: None if b is None else bytearray(b)
            return reads.scan(self.versions(lo, hi, bound), edge(lo), edge(hi), bound)

    scan_at = scan

    def scan_prefix(self, prefix: bytes, snapshot: Snapshot | None = None) -> DataFrame:
        return self.scan(prefix or None, prefix_successor(prefix), snapshot)

    scan_prefix_at = scan_prefix

    def history(self, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        return reads.history(self.versions(lo, hi), None if lo is None else bytearray(lo), None if hi is None else bytearray(hi))

    def current_sequence(self) -> int:
        """The last number given out; a checkpoint that outlives this process."""
        with self._lock:
            self.sync()
            return self._seq

    def snapshot(self) -> Snapshot:
        with self._lock:
            return self._pin(self.current_sequence())

    def snapshot_at(self, seq: int, strict: bool = False) -> Snapshot:
        """Time travel. strict: raise if compaction has merged history there."""
        with self._lock:
            if not 0 <= seq <= self.current_sequence():
                raise ValueError(f"sequence {seq} is not between 0 and the current {self._seq}")
            if strict and seq < self._manifest.history_floor:
                raise ValueError(f"history below {self._manifest.history_floor} has been merged")
            return self._pin(seq)

    def _pin(self, seq: int) -> Snapshot:
        self._pins[seq] = self._pins.get(seq, 0) + 1
        return Snapshot(self, seq, seq >= self._manifest.history_floor)

    def _unpin(self, seq: int) -> None:
        with self._lock:
            self._pins[seq] -= 1
            if not self._pins[seq]:
                del self._pins[seq]

    def stats(self) -> StorageStats:
        with self._lock:
            gauges = {"sequence": self._seq, "live_snapshots": sum(self._pins.values()), "memtable_bytes": self._recent.bytes, "memtable_entries": self._recent.entries}
            levels = [LevelStats(k, len(v), sum(r.bytes for r in v)) for k, v in sorted(self._manifest.levels().items())]
            return StorageStats(dict(self._counts), gauges, levels)


class Compactor:
    """Compacts in the background until stopped or the store is gone."""

    def __init__(self, store: Store, interval: float):
        self.errors, self._stop, self._store = 0, threading.Event(), weakref.ref(store)
        self._thread = threading.Thread(target=self._run, args=(interval,), daemon=True)
        self._thread.start()

    def _run(self, interval: float) -> None:
        while not self._stop.wait(interval) and (store := self._store()) is not None:
            try:
                store.compact_now()
            except Exception:
                self.errors += 1
                log.exception("compaction failed")
            del store

    def error_count(self) -> int:
        return self.errors

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
