"""Row type of a version log and the configuration of a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A null value is a deletion; an empty one is not.
VERSIONS = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), True)])

CODECS = ("none", "snappy", "gzip", "zstd", "lz4", "lz4_raw")


@dataclass(frozen=True)
class StoreConfig:
    """Sizes are in bytes. Defaults are larger than an embedded store's, as every run is a distributed write."""

    memtable_size_threshold: int = 512 << 10
    compaction_size_threshold: int = 64 << 20
    level_multiplier: int = 4
    level0_file_limit: int = 4
    compression: str = "zstd"
    group_commit: int = 1
    inline_compaction: bool = True
    bloom_keys: int = 1_000_000
    #: Runs up to this many bytes in all stay in the executors' memory after a read; 0 for none.
    block_cache_size: int = 0
    #: Flushes and compactions are logged as information rather than for debugging only.
    verbose: bool = False

    def __post_init__(self):
        least = {"memtable_size_threshold": 1, "compaction_size_threshold": 1, "level_multiplier": 2, "level0_file_limit": 1, "group_commit": 1, "bloom_keys": 1, "block_cache_size": 0}
        for name, low in least.items():
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be {low} at least")
        if self.compression not in CODECS:
            raise ValueError(f"compression is one of {', '.join(CODECS)}")
