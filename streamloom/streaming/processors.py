"""The stateful operators on Structured Streaming: state by source, in bounded size, with checkpoints of the engine's own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SOURCE = ["topic_id", "node_id", "publisher_id", "publisher_epoch"]
#: transformWithState needs this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

WRITER_SCHEMA = "topic_id long, node_id long, publisher_id long, publisher_epoch long, arrival long, source_sequence long, kind string, gap_first long, gap_last long"


class WriterProcessor(StatefulProcessor):
    """Drops duplicates of a source and reports gaps before the row that shows them; the state is the last sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            sequence = int(row.source_sequence)
            if last is not None and sequence <= last:
                continue
            if last is not None and sequence > last + 1:
                out.append((*key, row.arrival, last + 1, "gap", last + 1, sequence - 1))
            out.append((*key, row.arrival, sequence, "record", None, None))
            last = sequence
        if last is not None:
            self.last.update((last,))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in WRITER_SCHEMA.split(", ")])
        yield frame.astype({"gap_first": "Int64", "gap_last": "Int64"})

    def close(self) -> None:
        pass


def written_stream(arrivals: DataFrame) -> DataFrame:
    """Records and gaps of a stream of arrivals."""
    return arrivals.groupBy(*SOURCE).transformWithStateInPandas(WriterProcessor(), WRITER_SCHEMA, "Append", "None")


DEDUP_SCHEMA = "topic_id long, node_id long, publisher_id long, publisher_epoch long, arrival long, source_sequence long, decision string, highest long"


class DedupProcessor(StatefulProcessor):
    """A receiver's window for one source: accepts out of order within a distance, closes the prefix, refuses the rest.

    The state is the contiguous mark and the accepted sequences beyond it, at most `distance` of them; it is
    dropped after `ttl_ms` without traffic.
    """

    def __init__(self, distance: int = 4096, ttl_ms: int = 60_000):
        self.distance, self.ttl_ms = distance, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "highest long, beyond array<long>", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        highest, beyond = (self.window.get() if self.window.exists() else (0, []))
        beyond, out = set(beyond), []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            n = int(row.source_sequence)
            if n <= highest:
                decision = "duplicate" if highest - n < self.distance else "nack"
            elif n - highest > self.distance:
                decision = "nack"
            else:
                decision = "duplicate" if n in beyond else "accept"
            if decision == "accept":
                beyond.add(n)
                while highest + 1 in beyond:
                    highest += 1
                    beyond.discard(highest)
            out.append((*key, row.arrival, n, decision, highest))
        self.window.update((highest, sorted(beyond)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DEDUP_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def deduplicated_stream(arrivals: DataFrame, distance: int = 4096, ttl_ms: int = 0) -> DataFrame:
    """The decision on every arrival."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return arrivals.groupBy(*SOURCE).transformWithStateInPandas(DedupProcessor(distance, ttl_ms), DEDUP_SCHEMA, "Append", mode)


RETRANSMIT_SCHEMA = "topic_id long, node_id long, publisher_id long, publisher_epoch long, sequence long, event string"


class RetransmitProcessor(StatefulProcessor):
    """Outstanding frames of a source: sent frames are kept until acknowledged, refused beyond `most`, and expire by timer."""

    def __init__(self, most: int = 4096, max_age_ms: int = 30_000):
        self.most, self.max_age_ms = most, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "sequence long", "enqueued long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        there = {k[0]: v[0] for k, v in self.frames.iterator()}
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            n = int(row.sequence)
            if row.kind == "frame":
                if len(there) >= self.most:
                    out.append((*key, n, "refused"))
                    continue
                there[n] = now
                self.frames.updateValue((n,), (now,))
                self.handle.registerTimer(now + self.max_age_ms)
                out.append((*key, n, "outstanding"))
                continue
            upto = -1 if pd.isna(row.highest) else int(row.highest)
            for s in sorted(s for s in there if s <= upto or (row.kind == "accepted" and s == n)):
                del there[s]
                self.frames.removeKey((s,))
                out.append((*key, s, "acknowledged"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RETRANSMIT_SCHEMA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        old = [k[0] for k, v in self.frames.iterator() if now - v[0] >= self.max_age_ms]
        for s in old:
            self.frames.removeKey((s,))
        yield pd.DataFrame([(*key, s, "expired") for s in old], columns=[c.split()[0] for c in RETRANSMIT_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def outstanding_stream(traffic: DataFrame, most: int = 4096, max_age_ms: int = 30_000) -> DataFrame:
    """traffic: source, arrival, kind (frame, accepted, nack), sequence, highest. What happens to every frame."""
    return traffic.groupBy(*SOURCE).transformWithStateInPandas(RetransmitProcessor(most, max_age_ms), RETRANSMIT_SCHEMA, "Append", "ProcessingTime")


def snapshot_stream(records: DataFrame) -> DataFrame:
    """The last record of each topic and partition, kept by a running aggregate (complete or update mode)."""
    rest = F.struct("ingestion_sequence", "ingestion_ts_ns", "payload")
    return records.groupBy("topic_id", "partition_id").agg(F.max_by(rest, "ingestion_sequence").alias("r")).select("topic_id", "partition_id", "r.*")


def lease_stream(heartbeats: DataFrame, duration: str) -> DataFrame:
    """Leases that ran out: sessions of heartbeats of an owner that ended before the watermark."""
    sessions = heartbeats.withWatermark("ts", "0 seconds").groupBy("owner_id", F.session_window("ts", duration)).agg(F.count("*").alias("heartbeats"))
    return sessions.select("owner_id", F.col("session_window.end").alias("expired_at"), "heartbeats")


def windowed_counts(records: DataFrame, width: str, late: str) -> DataFrame:
    """Counts by topic and event-time window; the watermark only bounds state."""
    return records.withWatermark("ts", late).groupBy("topic_id", F.window("ts", width)).agg(F.count("*").alias("records")).select("topic_id", F.col("window.start").alias("start"), "records")
