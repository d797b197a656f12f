"""Recording as a stream: sources in, committed batches out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from streamloom.sources.session import RecordingSession


def sources(streams: list[DataFrame]) -> DataFrame:
    """Several sources behind one seam."""
    return reduce(DataFrame.unionByName, streams)


def record(stream: DataFrame, session: RecordingSession, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends every micro-batch to the session, once: a batch that is repeated after a failure has its name already."""

    def write(batch: DataFrame, number: int) -> None:
        session.append(batch, f"batch-{number:012d}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def publish(stream: DataFrame, checkpoint: str, local: Callable[[DataFrame], None], bridges: list[Callable[[DataFrame], None]], outcomes: list | None = None) -> StreamingQuery:
    """Fans each micro-batch out: the local sink decides, a bridge's failure is noted and doesn't stop the others."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            local(batch)
            for i, bridge in enumerate(bridges):
                try:
                    bridge(batch)
                    status = "dispatched"
                except Exception as e:
                    status = f"degraded: {type(e).__name__}"
                if outcomes is not None:
                    outcomes.append((number, i, status))
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()
