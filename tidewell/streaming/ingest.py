"""Streams of records into a store: each micro-batch is one commit, made once even if a batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources.store import KVStore


def stream_put(store: KVStore, records: DataFrame, checkpoint: str, *order: str, source: str = "stream", once: bool = False) -> StreamingQuery:
    """Starts writing a stream of (key, value, order...) to the store. once: only what is there now."""

    def commit(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.put_many(batch, *order, epoch=(source, epoch))

    writer = records.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
