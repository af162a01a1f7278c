"""Write requests as a stream into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import requests
from ..sources.store import Store


def ingest(bodies: DataFrame, store: Store, checkpoint: str, *, body: str = "body", available_now: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Append each micro-batch of requests.  Samples of any age are taken: nothing is dropped as late; of samples of one series and
    time, the one of the later batch counts when the store is read through ``dedup_last`` or compacted."""

    def add(batch: DataFrame, number: int) -> None:
        # of a batch's samples of one series and time the last written stays: by request, series and place in it
        store.append(requests.last_written(requests.samples(batch, body)).withColumn("ingest_seq", F.lit(number).cast("long")))

    writer = bodies.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
