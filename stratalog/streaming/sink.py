"""Structured Streaming into a store, and a running view of a stream of versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.store import Store


def store_sink(store: Store, stream_id: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch (key, value; a null value deletes) is one atomic batch. The manifest that commits
    it also records (stream_id, batch number), so a batch that comes again changes nothing."""

    def write(frame: DataFrame, batch: int) -> None:
        store.write_frame(frame, order, (stream_id, batch))

    return write


def write_stream(frame: DataFrame, store: Store, stream_id: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Starts a query that takes what is available and ends."""
    return frame.writeStream.foreachBatch(store_sink(store, stream_id, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_view(versions: DataFrame) -> DataFrame:
    """Streaming newest version per key (complete or update mode); deletions have a null value. max_by keeps a null value
    of the newest version."""
    return versions.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
