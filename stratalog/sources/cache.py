"""Hot runs in the executors' memory: persisted DataFrames, least recently used first out, within a bound of bytes on disk."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CacheStats:
    hits: int
    misses: int
    used_bytes: int
    runs: int


class RunCache:
    """Runs don't change, so one that is held is never stale; a run larger than the bound is never held. A lost executor's
    part is read again from the run's files."""

    def __init__(self, limit: int):
        self.limit, self.used, self.hits, self.misses = limit, 0, 0, 0
        self._held: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    def get(self, name: str, size: int, read: Callable[[], DataFrame]) -> DataFrame | None:
        """The run's rows, held from now on; None if it is too large to hold."""
        if size > self.limit:
            return None
        if name in self._held:
            self.hits += 1
            self._held.move_to_end(name)
            return self._held[name][0]
        self.misses += 1
        while self.used + size > self.limit:
            self.purge(next(iter(self._held)))
        frame = read().persist(StorageLevel.MEMORY_AND_DISK)
        self._held[name], self.used = (frame, size), self.used + size
        return frame

    def purge(self, name: str) -> None:
        if name in self._held:
            frame, size = self._held.pop(name)
            frame.unpersist()
            self.used -= size

    def clear(self) -> None:
        for name in list(self._held):
            self.purge(name)

    def stats(self) -> CacheStats:
        return CacheStats(self.hits, self.misses, self.used, len(self._held))
