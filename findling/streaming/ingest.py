"""Near-real-time ingestion: a stream of documents into an index, one refresh for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import Index


def ingest_stream(stream: DataFrame, index: Index, key: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Upserts a stream's rows by ``key``. Without an interval it takes what is there and ends."""

    def batch(df: DataFrame, epoch: int) -> None:
        index.publish(df, key)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
