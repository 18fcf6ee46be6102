"""Incremental snapshots from a stream: every micro-batch is one snapshot.

The state is the datastore's tables, so a restarted query goes on where the last
commit was; a batch that was committed before is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chunking
from ..sources.store import Datastore


def chunks_with_data(streams: DataFrame, avg: int) -> DataFrame:
    """Chunks of streams (stream_id, data), each with its bytes."""
    return chunking.chunk_streams(streams, avg, with_data=True)


def snapshot_stream(streams: DataFrame, store: Datastore, ns: str, name: str, checkpoint: str, avg: int = 4096) -> StreamingQuery:
    """Start a query that commits each batch of streams as snapshot (ns, host, name, batch number)."""

    def commit(batch: DataFrame, number: int) -> None:
        ref = (ns, "host", name, number)
        done = store.snapshots().where((F.col("ns") == ns) & (F.col("id") == name) & (F.col("time") == number))
        if done.isEmpty() and not batch.isEmpty():
            store.commit(ref, chunks_with_data(batch, avg))

    return streams.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
