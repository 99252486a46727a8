"""Counters and gauges of a store, and their Prometheus text."""

from __future__ import annotations

from dataclasses import dataclass, field

COUNTERS = {
    "puts": "Puts applied.",
    "deletes": "Deletes applied.",
    "batches": "Write batches applied.",
    "gets": "Point lookups served.",
    "scans": "Range and prefix scans served.",
    "flushes": "Memtable flushes to level 0.",
    "compactions": "Compactions of a level.",
}
GAUGES = {
    "sequence": "Last sequence number given out.",
    "live_snapshots": "Snapshots that pin versions.",
    "memtable_bytes": "Bytes of keys and values not yet in a run.",
    "memtable_entries": "Versions not yet in a run.",
}


@dataclass(frozen=True)
class LevelStats:
    level: int
    num_sstables: int
    bytes: int


@dataclass(frozen=True)
class StorageStats:
    counters: dict[str, int]
    gauges: dict[str, int]
    levels: list[LevelStats] = field(default_factory=list)

    def __getattr__(self, name: str) -> int:
        if name.endswith("_total") and name[:-6] in COUNTERS:
            return self.counters[name[:-6]]
        if name in GAUGES:
            return self.gauges[name]
        raise AttributeError(name)

    def total_sstables(self) -> int:
        return sum(x.num_sstables for x in self.levels)

    def total_sstable_bytes(self) -> int:
        return sum(x.bytes for x in self.levels)

    def to_prometheus(self, prefix: str = "lsm_") -> str:
        """Text format 0.0.4."""
        lines = []
        for kind, names, values, end in (("counter", COUNTERS, self.counters, "_total"), ("gauge", GAUGES, self.gauges, "")):
            for name, text in names.items():
                full = f"{prefix}{name}{end}"
                lines += [f"# HELP {full} {text}", f"# TYPE {full} {kind}", f"{full} {values[name]}"]
        for name, text, value in (("sstables", "Runs of a level.", "num_sstables"), ("sstable_bytes", "Bytes of a level's runs.", "bytes")):
            lines += [f"# HELP {prefix}{name} {text}", f"# TYPE {prefix}{name} gauge"]
            lines += [f'{prefix}{name}{{level="{x.level}"}} {getattr(x, value)}' for x in self.levels]
        return "\n".join(lines) + "\n"
