"""What the operators share: table reads, shared-folder staging, checked broadcasts, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.sources.scratch import keeping, measured, release, scope, shared_dir, stage, unstage, writing

__all__ = ["keeping", "measured", "release", "scope", "shared_dir", "stage", "unstage", "writing"]

#: Bytes a broadcast side may take, measured; beyond it the same join runs as a shuffle join.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as a column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same_name(columns: list[str], name: str) -> str | None:
    """The column of that name as it is written there; Spark doesn't tell upper from lower case."""
    return next((c for c in columns if c.lower() == name.lower()), None)


def small(df: DataFrame, limit: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if its measured bytes are within the limit, else as it is (a shuffle join then). of: a table
    that df is a part of, measured in its stead."""
    return F.broadcast(df) if measured(df if of is None else of)[1] <= limit else df


class Memo(dict):
    """What make gives for a key, remembered; looking up fills it, and a full one starts anew."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        out = self[key] = self.make(key)
        return out


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives memory back to the system when it ends. Python workers live on between tasks, and what
    they have freed but still hold counts as the executor's memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of about `size` bytes of text (one row at least), with the texts in UTF-8; null texts are empty."""
    texts = batch.column(text).cast(pa.large_binary()).to_pylist()
    at = held = 0
    for i, t in enumerate(texts):
        if t is None:
            texts[i] = t = b""
        if held and held + len(t) > size:
            yield batch.slice(at, i - at), texts[at:i]
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield batch.slice(at), texts[at:]


_BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 16)

        def powers(base: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            return out

        _powers, _inverses = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash of each word, first word of each text and the number of words, byte start and end of each word, the bytes).

    A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All words of the slice are hashed at once: with prefix
    sums of byte * base**place, a word's hash is a difference of two of them, moved to place 0 and finalised."""
    joined = b"\n".join(texts) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    _tables(len(b) + 1)
    white = _WHITE[b]
    edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]  # the last byte is white, so runs come in pairs
    if lower:
        b = _LOWER[b]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[: len(b)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    return hashes, first, starts, ends, joined


def grams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of n consecutive words; len(hashes) - n + 1 of them, none if there are fewer words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, seed, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return mix(out)
